"""Text measures: tokens, sentences, ratios, cleaning, rounding as the reference rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space beyond ASCII, and words that say nothing in headings.
UNICODE_SPACE = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOPWORDS = ("the", "and", "for", "with", "from", "that", "this", "your", "about", "into", "over", "under", "are", "was", "were", "can", "has", "have", "had", "you", "our", "out", "all")


def clean(x: Column) -> Column:
    """White space runs to one space, trimmed; empty to null."""
    return F.nullif(F.trim(F.regexp_replace(x, UNICODE_SPACE + "+", " ")), F.lit(""))


def word_tokens(x: Column, cap: int | None = None) -> Column:
    """Lower-case runs of ASCII word characters (in the first ``cap`` characters, if it is given)."""
    return F.filter(F.split(F.lower(x if cap is None else F.substring(x, 1, cap)), r"\W+"), lambda t: t != "")


def heading_tokens(x: Column) -> Column:
    t = F.regexp_replace(x, "<[^<>]*>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(t, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def unique_sentences(x: Column) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(F.split(x, "[.!?]+"), lambda s: F.lower(F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))), lambda s: s != "")))


def unique_token_ratio(x: Column) -> Column:
    t = word_tokens(x)
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def js_round(x: Column) -> Column:
    """Half up, toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def grid(x: Column, digits: int = 6) -> Column:
    """Floor onto a grid, the same in any engine."""
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def escape_html(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def duration_seconds(x: Column) -> Column:
    """'24h' to seconds; anything but digits and one of h, m, d, s is null."""
    n = F.regexp_extract(x, r"^(\d+)[hmds]$", 1).try_cast("bigint")
    unit = F.create_map(*[F.lit(v) for kv in (("h", 3600), ("m", 60), ("d", 86400), ("s", 1)) for v in kv])
    return n * F.try_element_at(unit, F.regexp_extract(x, r"^\d+([hmds])$", 1))


def plugin_table(name: Column) -> Column:
    return F.concat(F.replace(name, F.lit("-"), F.lit("_")), F.lit("_plugin"))


def short_hash(x: Column) -> Column:
    return F.substring(F.sha1(x), 1, 16)


def job_key(fields: Column) -> Column:
    """Identity of a job from a struct of its command, target and flags."""
    return F.sha2(F.to_json(fields), 256)
