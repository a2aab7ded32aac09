"""Heading health: structure of each page, groups over the pages, score and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions.text import UNICODE_SPACE, grid, heading_tokens, jaccard, js_round, short_hash
from gossamer.operators.scoring import heading_score, heading_status
from gossamer.session import materialize

HEADING = r"(?i)<h([1-6])\b[^<>]*>([\s\S]*?)</h\1>"
#: Fixed value: a section with fewer words, but any, is thin.
THIN_WORDS = 80
#: Fixed value: first headings are similar from this Jaccard similarity of their tokens on.
SIMILAR = 0.7


def heading_text(x: Column) -> Column:
    t = F.regexp_replace(x, "<[^<>]*>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(t, UNICODE_SPACE + "+", " "))


def sections(html: Column) -> Column:
    """(level, text, words) of every heading in order, with the words up to the next one."""
    found = F.regexp_extract_all(html, F.lit(HEADING), 0)
    after = F.split(html, HEADING, -1)
    part = lambda h, k: F.regexp_extract(h, HEADING, k)
    return F.transform(found, lambda h, i: F.named_struct(F.lit("level"), part(h, 1).cast("int"), F.lit("text"), heading_text(part(h, 2)), F.lit("words"), F.size(heading_tokens(F.get(after, i + 1)))))


def level_entropy(levels: Column) -> Column:
    """Entropy in bits of the counts of the six levels."""
    n = F.size(levels)
    share = lambda k: F.size(F.filter(levels, lambda x: x == k)) / n
    out = F.lit(0.0)
    for p in map(share, range(1, 7)):
        out = out - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return F.when(n > 0, grid(out, 3)).otherwise(F.lit(0.0))


def page_structure(pages: DataFrame) -> DataFrame:
    """(id, secs, metrics, h1, h2_set, pattern) of the pages that have a url and html."""
    p = pages.where((F.coalesce("html", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).select("id", sections(F.col("html")).alias("secs"))
    p = p.withColumn("levels", F.transform("secs", lambda s: s.level))
    n = F.size("levels")
    rest = F.greatest(n - 1, F.lit(0))
    p = p.withColumn("steps", F.zip_with(F.slice("levels", F.lit(2), rest), F.slice("levels", F.lit(1), rest), lambda b, a: b - a))
    count = lambda xs, f: F.size(F.filter(xs, f))
    n1 = count("levels", lambda x: x == 1)
    moved = F.aggregate("steps", F.lit(0), lambda s, x: s + F.abs(x))
    of = lambda k: F.transform(F.filter("secs", lambda s: s.level == k), lambda s: F.lower(s.text))
    return p.select(
        "id", "secs", (n1 == 0).cast("int").alias("missing_h1"), (n1 > 1).cast("int").alias("multiple_h1"), level_entropy(F.col("levels")).alias("entropy"),
        F.when(n > 0, grid(count("levels", lambda x: x <= 2) / n, 3)).otherwise(F.lit(0.0)).alias("fragmentation"), F.when(n > 1, grid(moved / (n - 1), 3)).otherwise(F.lit(0.0)).alias("volatility"),
        count("steps", lambda x: x > 1).alias("hierarchy_skips"), count("steps", lambda x: x < -1).alias("reverse_jumps"), count("secs", lambda s: (s.words > 0) & (s.words < THIN_WORDS)).alias("thin_sections"),
        F.nullif(F.coalesce(F.try_element_at(of(1), F.lit(1)), F.lit("")), F.lit("")).alias("h1"),
        short_hash(F.array_join(F.array_sort(F.filter(of(2), lambda t: t != "")), "|")).alias("h2_set"), short_hash(F.array_join(F.transform("levels", lambda x: x.cast("string")), ">")).alias("pattern"),
    )


def section_risk(p: DataFrame) -> DataFrame:
    """(id, section_risk): for each section in order, how often its heading and length occur elsewhere, 0 to 1."""
    s = p.select("id", F.posexplode("secs").alias("i", "s")).select("id", "i", short_hash(F.concat(F.lower("s.text"), F.lit(":"), F.col("s.words").cast("string"))).alias("key"))
    size = s.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    risk = F.least(F.lit(1.0), (F.col("n") - 1) / 5)
    return s.join(size, "key").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", grid(risk, 3).alias("r")))), lambda x: x.r).alias("section_risk"))


def similar_headings(h1: DataFrame) -> DataFrame:
    """(h1, others): how many other first headings are similar to each of the distinct ``h1``.

    Headings of one token set are one row of the join. Two similar sets share one of their rarest
    tokens: of n, the first n - ceil(0.7 n) + 1 by falling rarity.
    """
    sets = materialize(h1.select("h1", F.array_sort(F.array_distinct(heading_tokens(F.col("h1")))).alias("t")).where(F.size("t") > 0), "token-sets")
    classes = sets.groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    words = classes.select("t", "copies", F.explode("t").alias("w"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    ranked = words.join(often, "w").groupBy("t", "copies").agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("r"))
    n = F.size("t")
    ranked = ranked.withColumn("r", F.slice("r", F.lit(1), n - F.ceil(n * SIMILAR - 1e-9).cast("int") + 1))
    rare = materialize(ranked.select("t", "copies", F.explode("r").alias("x")).select("t", "copies", F.col("x.w").alias("w")), "rare-tokens")
    x, y = rare, rare.select("w", F.col("t").alias("u"), F.col("copies").alias("more"))
    near = (F.col("t") != F.col("u")) & (F.least(F.size("t"), F.size("u")) >= F.greatest(F.size("t"), F.size("u")) * SIMILAR - 1e-9)
    pairs = x.join(y, "w").where(near).where(jaccard(F.col("t"), F.col("u")) >= SIMILAR).select("t", "u", "more").distinct()
    like = pairs.groupBy("t").agg(F.sum("more").alias("more"))
    found = classes.join(like, "t", "left").select("t", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("others"))
    return sets.join(found, "t").select("h1", "others")


def heading_health(pages: DataFrame) -> DataFrame:
    """One row per page of (id, url, html) that has html and a url: metrics, group sizes, score and status.

    A page without a first heading is in no group of equal or similar first headings (size 0).
    """
    p = materialize(page_structure(pages), "headings")
    h1 = materialize(p.where("h1 IS NOT NULL").groupBy("h1").agg(F.count(F.lit(1)).alias("duplicate_h1_group")), "first-headings")
    groups = h1.join(similar_headings(h1.select("h1")), "h1", "left").select("h1", "duplicate_h1_group", (F.coalesce("others", F.lit(0)) + 1).alias("similar_h1_group"))
    with_h1 = p.where("h1 IS NOT NULL").select("id", "h1").join(groups, "h1").drop("h1")
    out = p.join(with_h1, "id", "left").join(section_risk(p), "id", "left")
    for key, name in (("h2_set", "identical_h2_set_group"), ("pattern", "duplicate_pattern_group")):
        out = out.join(p.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key)
    size = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumn("duplicate_h1_group", size("duplicate_h1_group")).withColumn("similar_h1_group", size("similar_h1_group")).withColumn("section_risk", F.coalesce("section_risk", F.array().cast("array<double>")))
    c = F.col
    score = heading_score(c("missing_h1") == 1, c("multiple_h1") == 1, c("hierarchy_skips"), c("reverse_jumps"), c("entropy"), c("fragmentation"), c("volatility"), c("thin_sections"), c("duplicate_h1_group"), c("similar_h1_group"), c("identical_h2_set_group"), c("duplicate_pattern_group"))
    return out.withColumn("score", score).withColumn("status", heading_status(F.col("score"))).drop("secs", "h1", "h2_set", "pattern")


def heading_summary(health: DataFrame) -> DataFrame:
    """One row over the evaluated pages."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return health.agg(
        F.coalesce(js_round(F.avg("score")), F.lit(0)).alias("avg_score"), F.count(F.lit(1)).alias("evaluated_pages"), total("missing_h1").alias("total_missing"), total("multiple_h1").alias("total_multiple"),
        total("hierarchy_skips").alias("total_skips"), total("reverse_jumps").alias("total_reverse_jumps"), total("thin_sections").alias("total_thin_sections"),
        F.coalesce(grid(F.avg("entropy"), 3), F.lit(0.0)).alias("avg_entropy"), F.count_if(F.col("status") == "Poor").alias("poor_pages"),
    )
