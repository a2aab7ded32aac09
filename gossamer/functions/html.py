"""On-page signals by regular expressions: for well-formed pages they never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions.text import clean, unique_sentences, word_count

#: Entities that are decoded, '&amp;' last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: What titles and texts of missing pages say.
MISSING_TITLES = ("404", "not found", "error", "doesn't exist", "unavailable", "invalid")
MISSING_BODIES = ("page not found", "404 error")


def decode_entities(x: Column) -> Column:
    for k, v in ENTITIES:
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def without(html: Column, *tags: str) -> Column:
    """HTML without comments and without these elements."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for t in tags:
        out = F.regexp_replace(out, rf"(?is)<{t}[^>]*>.*?</{t}>", " ")
    return out


def strip_tags(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, r"<[^>]*>", " "))


def body_text(html: Column, *skip: str) -> Column:
    body = F.regexp_replace(without(html, "head", "script", "style", *skip), r"(?is)^.*?<body[^>]*>|</body>.*$", "")
    return F.trim(F.regexp_replace(strip_tags(body), r"\s+", " "))


def first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def title(html: Column) -> Column:
    return F.trim(decode_entities(first(html, r"(?is)<title[^>]*>(.*?)</title>")))


def text_status(value: Column, short: int, long: int) -> Column:
    n = F.length(value)
    return F.when(value.isNull() | (n == 0), "missing").when(n < short, "too_short").when(n > long, "too_long").otherwise("ok")


def meta(html: Column, name: str, attr: str = "name") -> Column:
    return decode_entities(first(html, rf'(?is)<meta[^>]*{attr}="{name}"[^>]*content="([^"]*)"'))


def h1s(html: Column) -> Column:
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), 1)
    return F.filter(F.transform(raw, lambda h: F.trim(F.regexp_replace(strip_tags(h), r"\s+", " "))), lambda h: h != "")


def h1_status(n: Column) -> Column:
    return F.when(n == 0, "critical").when(n > 1, "warning").otherwise("ok")


def headings(html: Column) -> Column:
    """(level, text) of every heading, in order."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), 1)
    return F.transform(raw, lambda h: F.named_struct(F.lit("level"), F.substring(h, 3, 1).cast("int"), F.lit("text"), F.trim(F.regexp_replace(strip_tags(h), r"\s+", " "))))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)


def zone_links(html: Column) -> Column:
    """(url, weight) of links: 0.7 in nav and header, 0.4 in footer, else 1.0; the largest of each url."""
    pick = lambda t: F.flatten(F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)(<{t}[^>]*>.*?</{t}>)"), 1), links))
    rest = links(without(html, "nav", "header", "footer"))
    give = lambda xs, w: F.transform(xs, lambda u: F.named_struct(F.lit("url"), u, F.lit("weight"), F.lit(w)))
    return F.concat(give(pick("nav"), 0.7), give(pick("header"), 0.7), give(pick("footer"), 0.4), give(rest, 1.0))


def image_alts(html: Column) -> Column:
    """Counts of images, of those without alt, and of those with a blank alt."""
    imgs = F.regexp_extract_all(html, F.lit(r"(?i)(<img[^>]*>)"), 1)
    none = F.filter(imgs, lambda i: ~i.rlike(r"(?i)\salt\s*="))
    blank = F.filter(imgs, lambda i: i.rlike(r"""(?i)\salt\s*=\s*("\s*"|'\s*')"""))
    return F.struct(F.size(imgs).alias("total"), F.size(none).alias("missing"), F.size(blank).alias("blank"))


def content(html: Column) -> Column:
    """Words, unique sentences and text share of the body without chrome."""
    t = body_text(html, "nav", "footer")
    return F.struct(word_count(t).alias("words"), unique_sentences(t).alias("sentences"), F.when(F.length(html) > 0, F.length(t) / F.length(html)).otherwise(F.lit(0.0)).alias("ratio"))


def soft404(html: Column, out_links: Column) -> Column:
    """Score 0 to 1 (two digits) and reasons that a page is a missing page served as found."""
    t, h = F.lower(F.coalesce(title(html), F.lit(""))), F.lower(F.coalesce(F.try_element_at(h1s(html), F.lit(1)), F.lit("")))
    b = body_text(html, "noscript", "iframe")
    n = word_count(b)
    any_of = lambda x, ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.contains(x, p))
    hit = lambda x: F.try_element_at(F.filter(F.array(*[F.lit(p) for p in MISSING_TITLES]), lambda p: F.contains(x, p)), F.lit(1))
    rules = [
        (any_of(t, MISSING_TITLES), 0.4, F.concat(F.lit("title_contains_"), hit(t))), (any_of(h, MISSING_TITLES), 0.3, F.concat(F.lit("h1_contains_"), hit(h))),
        (any_of(F.lower(b), MISSING_BODIES), 0.2, F.lit("body_error_phrase")), (n < 50, 0.3, F.lit("very_low_word_count")), ((n >= 50) & (n < 150), 0.1, F.lit("low_word_count")), (out_links == 0, 0.2, F.lit("no_outbound_links")),
    ]
    total = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w, _ in rules), F.lit(0.0))
    return F.struct(F.least(F.lit(1.0), F.floor(total * 100 + 0.5) / 100).alias("score"), F.concat_ws(", ", *[F.when(c, r) for c, _, r in rules]).alias("reason"))


def signals(html: Column) -> Column:
    """Language, canonical, Open Graph, Twitter, hreflang and JSON-LD block counts."""
    return F.struct(
        first(html, r'(?is)<html[^>]*\slang="([^"]*)"').alias("lang"), first(html, r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"').alias("canonical"),
        clean(title(html)).alias("title"), meta(html, "og:title", "property").alias("og_title"), meta(html, "og:url", "property").alias("og_url"), meta(html, "twitter:card").alias("twitter_card"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?is)(<link[^>]*hreflang=)"), 1)).alias("hreflang"),
        F.size(F.regexp_extract_all(html, F.lit(r'(?is)(<script[^>]*type="application/ld\+json"[^>]*>)'), 1)).alias("jsonld"),
    )
