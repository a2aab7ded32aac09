"""Scores of pages and sites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.text import clamp, grid, js_round

#: Weights of the health penalties.
HEALTH_WEIGHTS = {
    "orphans": 50, "broken_links": 100, "redirect_chains": 20, "duplicate_clusters": 25, "thin_content": 15, "missing_h1": 10,
    "noindex_misuse": 20, "canonical_conflicts": 10, "low_internal_links": 10, "excessive_links": 5, "blocked_by_robots": 100, "crawl_traps": 50,
}
#: Penalties of which any makes a site critical.
CRITICAL = ("orphans", "broken_links", "redirect_chains", "duplicate_clusters", "canonical_conflicts", "noindex_misuse", "blocked_by_robots")
#: Patterns of pages of little value.
LOW_VALUE = (r"(?i)[?&](page|p)=\d+", r"(?i)/(page|tag|tags|category|categories)/", r"(?i)[?&](q|query|search|filter|sort)=", r"(?i)/search(/|\?|$)")
LOW_VALUE_TYPES = ("pagination", "tag", "category", "filter", "search", "archive")


def thin_content(words: Column, ratio: Column, duplication: Column) -> Column:
    w = F.when(words >= 300, F.lit(0.0)).otherwise(100 - F.least(F.lit(100.0), words / 300 * 100))
    r = F.when(ratio >= 0.2, F.lit(0.0)).otherwise(100 - F.least(F.lit(100.0), ratio / 0.2 * 100))
    return grid(clamp(0.4 * w + 0.35 * r + 0.25 * duplication), 2)


def text_status_score(status: Column) -> Column:
    return F.when(status == "ok", F.lit(100.0)).when(status == "duplicate", F.lit(45.0)).when(status.isin("too_short", "too_long"), F.lit(60.0)).otherwise(F.lit(0.0))


def page_seo(title: Column, description: Column, h1: Column, words: Column, ratio: Column, thin: Column, images: Column, bad_alts: Column, structured: Column, external: Column, blocked: Column) -> Column:
    """0 to 100 with two digits; ``h1`` is a score, ``structured`` one of valid, invalid, none."""
    quality = F.least(F.lit(100.0), words / 600 * 100) * 0.7 + F.least(F.lit(100.0), ratio * 500) * 0.3
    alts = F.greatest(F.lit(0.0), 100 - bad_alts / F.greatest(F.lit(1), images) * 100)
    data = F.when(structured == "valid", F.lit(100.0)).when(structured == "invalid", F.lit(40.0)).otherwise(F.lit(30.0))
    balance = F.greatest(F.lit(0.0), 100 - F.abs(external - 0.3) * 200)
    total = (text_status_score(title) + text_status_score(description)) / 2 * 0.15 + h1 * 0.1 + quality * 0.2 + (100 - thin) * 0.2 + alts * 0.1 + data * 0.1 + balance * 0.15
    return F.when(blocked, F.lit(0.0)).otherwise(grid(clamp(total), 2))


def site_score(seo: Column, authority: Column, entropy: Column, orphan_share: Column, any_blocked: Column) -> Column:
    """overall, 0 if any page is blocked: 0.7 of the mean page score and 0.3 of structure."""
    structure = clamp(authority * 40 + F.greatest(F.lit(0.0), 100 - F.abs(entropy - 2) * 25) * 0.35 + (100 - orphan_share * 100) * 0.25)
    return F.when(any_blocked, F.lit(0.0)).otherwise(grid(seo * 0.7 + structure * 0.3, 2))


def site_scores(pages: DataFrame, deg: DataFrame, metrics: DataFrame, top: int = 10) -> DataFrame:
    """One row: seo (mean page score), authority (mean of the first ``top``), entropy, orphan_share and overall.

    ``pages`` has seo and blocked, ``deg`` in_links, ``metrics`` is the row of ``graph.graph_metrics``.
    """
    from gossamer.operators.graph import authority

    c = F.col
    most = deg.agg(F.max("in_links").alias("_most"))
    # the first pages by links in are the first by authority, which rises with them
    first = deg.orderBy(c("in_links").desc_nulls_last()).limit(top).crossJoin(F.broadcast(most)).agg(F.coalesce(F.avg(authority(c("in_links"), c("_most"))), F.lit(0.0)).alias("authority"))
    seo = pages.agg(F.coalesce(F.avg("seo"), F.lit(0.0)).alias("seo"), F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("_blocked"))
    share = F.coalesce(F.try_divide(c("orphans"), c("pages")), F.lit(0.0))
    # one row each
    one = seo.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(metrics.select("entropy", share.alias("orphan_share"))))
    return one.select("seo", "authority", "entropy", "orphan_share", site_score(c("seo"), c("authority"), c("entropy"), c("orphan_share"), c("_blocked")).alias("overall"))


def health(pages: Column, counts: dict[str, Column]) -> Column:
    """score (one digit), label and penalties of a row of issue counts."""
    safe = F.greatest(pages, F.lit(1)).cast("double")
    fine = {k: F.greatest(F.lit(0.0), F.least(F.lit(float(w)), F.coalesce(counts[k], F.lit(0)) / safe * w)) for k, w in HEALTH_WEIGHTS.items() if k in counts}
    score = grid(clamp(100 - sum(fine.values(), F.lit(0.0))), 1)
    critical = F.lit(False)
    for k in CRITICAL:
        if k in counts:
            critical = critical | (F.coalesce(counts[k], F.lit(0)) > 0)
    return F.struct(score.alias("score"), health_label(score, critical).alias("label"), F.map_from_arrays(F.array(*[F.lit(k) for k in fine]), F.array(*fine.values())).alias("penalties"))


def health_label(score: Column, critical: Column) -> Column:
    return F.when((score >= 75) & critical, "Needs Attention").when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 50, "Needs Attention").otherwise("Critical")


def low_value(url: Column, page_type: Column, noindex: Column) -> Column:
    hit = F.coalesce(F.lower(page_type).isin(*LOW_VALUE_TYPES), F.lit(False)) | F.coalesce(noindex, F.lit(False))
    for p in LOW_VALUE:
        hit = hit | url.rlike(p)
    return hit


def orphan_severity(kind: Column, status: Column, in_links: Column, words: Column, structured: Column, depth: Column, commercial: Column, noindex: Column, duplicate: Column, page_type: Column) -> Column:
    base = F.when(kind == "hard", 90).when(kind == "crawl-only", F.when(status == 0, 50).otherwise(70)).when(kind == "near", F.when(in_links <= 1, 70).otherwise(60)).when(kind == "soft", 50).otherwise(0)
    flag = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    w = F.coalesce(words, F.lit(0))
    plus = F.least(F.lit(20), flag(w > 800, 10) + flag(structured, 10) + flag(depth <= 2, 10) + flag(commercial, 10))
    minus = F.least(F.lit(20), flag((w > 0) & (w < 300), 20) + flag(noindex, 20) + flag(duplicate, 20) + flag(F.lower(page_type).isin("archive", "pagination"), 20))
    total = base + plus - minus
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(status == 0, F.least(total, F.lit(60))).otherwise(total)))


def impact_level(score: Column) -> Column:
    return F.when(score <= 39, "low").when(score <= 69, "medium").when(score <= 89, "high").otherwise("critical")


def annotate_orphans(nodes: DataFrame, edges: DataFrame, min_inbound: int = 2, root: str | None = None) -> DataFrame:
    """Adds orphan_type (null if none): hard, crawl-only, near or soft.

    ``nodes`` has id, url, canonical, depth, in_links, in_sitemap, robots_excluded and low_value.
    Links in count for the canonical target. A page is a soft orphan if all its links come from
    pages of little value.
    """
    group = F.coalesce("canonical", "url")
    inbound = F.sum("in_links").over(Window.partitionBy(group))
    src = nodes.select(F.col("id").alias("src"), F.col("low_value").alias("_low"))
    soft = edges.join(src, "src").groupBy("dst").agg(F.bool_and("_low").alias("_all_low")).withColumnRenamed("dst", "id")
    home = (F.col("depth") == 0) | (F.col("url") == F.lit(root)) if root else (F.col("depth") == 0)
    out = nodes.withColumn("inbound", inbound).join(soft, "id", "left")
    kind = (
        F.when(home | F.coalesce("robots_excluded", F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("inbound") == 0, F.when(F.coalesce("in_sitemap", F.lit(False)), "crawl-only").otherwise("hard"))
        .when(F.col("inbound") <= min_inbound, "near").when(F.coalesce("_all_low", F.lit(False)), "soft")
    )
    return out.withColumn("orphan_type", kind).drop("_all_low")


def heading_score(missing_h1: Column, multiple_h1: Column, skips: Column, reverse: Column, entropy: Column, fragmentation: Column, volatility: Column, thin: Column, same_h1: Column, similar_h1: Column, same_h2: Column, same_pattern: Column) -> Column:
    group = lambda n, most, each: F.when(n > 1, F.least(F.lit(most), (n - 1) * each)).otherwise(0)
    risk = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similar_h1 - 1) * 0.15 + (same_h2 - 1) * 0.2 + (same_pattern - 1) * 0.2)) * 1000 + 0.5) / 1000
    s = 100 - F.when(missing_h1, 20).otherwise(0) - F.when(multiple_h1, 6).otherwise(0) - skips * 8 - reverse * 6 - js_round(entropy * 7) - js_round(fragmentation * 20) - js_round(volatility * 6) - thin * 4
    s = s - group(same_h1, 16, 3) - group(similar_h1, 8, 2) - group(same_h2, 10, 2) - group(same_pattern, 12, 2) - js_round(risk * 12)
    return F.greatest(F.lit(0), F.least(F.lit(100), s))


def heading_status(score: Column) -> Column:
    return F.when(score >= 80, "Healthy").when(score >= 55, "Moderate").otherwise("Poor")


def signals_page_score(jsonld: Column, og: Column, lang: Column, hreflang: Column, broken: Column) -> Column:
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return clamp(one(jsonld, 35) + one(og, 25) + one(lang, 20) + one(hreflang, 10) - one(broken, 15))


def security_headers(h: Column) -> Column:
    """Score 0 to 100 of a map of lower-case header names, and which headers are valid."""
    get = lambda k: F.nullif(F.try_element_at(h, F.lit(k)), F.lit(""))
    checks = [
        ("hsts", get("strict-transport-security").contains("max-age="), 30), ("csp", get("content-security-policy").isNotNull(), 25),
        ("frame", F.upper(get("x-frame-options")).isin("DENY", "SAMEORIGIN"), 15), ("sniff", F.lower(get("x-content-type-options")) == "nosniff", 15),
        ("referrer", get("referrer-policy").isNotNull(), 10), ("permissions", get("permissions-policy").isNotNull(), 5),
    ]
    ok = [(n, F.coalesce(c, F.lit(False)), w) for n, c, w in checks]
    return F.struct(sum((F.when(c, w).otherwise(0) for _, c, w in ok), F.lit(0)).alias("score"), *[c.alias(n) for n, c, _ in ok])


def transport_audit(tls: Column, https: Column, cert_ok: Column, days_left: Column, header_score: Column, hsts: Column, csp: Column, h2: Column, compressed: Column, ttfb: Column, redirects: Column, size: Column, ipv6: Column, ips: Column) -> Column:
    """score, grade and issues of a site's transport; any critical issue caps the score at 39."""
    expired, soon = https & (days_left < 0), https & days_left.between(0, 29)
    transport = F.when(expired, 0).otherwise(F.when(tls >= 1.2, 15).otherwise(0) + F.when(https & cert_ok, 15).otherwise(0) - F.when(soon, 5).otherwise(0))
    speed = F.when(h2, 5).otherwise(0) + F.when(compressed, 5).otherwise(0) + F.when(ttfb < 800, 10).otherwise(0) + F.when(redirects <= 3, 5).otherwise(0) + F.when(size < 1024 * 1024, 5).otherwise(0)
    base = F.when(ipv6, 10).otherwise(0) + F.when(ips > 1, 10).otherwise(0)
    rules = [
        ("tls-old", tls < 1.2), ("no-https", tls.isNull() & ~https), ("cert-expiring-soon", soon), ("cert-expired", expired), ("cert-invalid", https & ~cert_ok), ("hsts-missing", ~hsts), ("csp-missing", ~csp),
        ("no-h2", ~h2), ("no-compression", ~compressed), ("slow-ttfb", ttfb >= 800), ("too-many-redirects", redirects > 3), ("large-html", size >= 1024 * 1024), ("no-ipv6", ~ipv6), ("single-ip", ips <= 1),
    ]
    issues = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    critical = F.arrays_overlap(issues, F.array(F.lit("no-https"), F.lit("cert-expired"), F.lit("cert-invalid")))
    total = transport + header_score / 100.0 * 20 + speed + base
    score = js_round(F.when(critical, F.least(total, F.lit(39.0))).otherwise(total))
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    return F.struct(score.alias("score"), grade.alias("grade"), issues.alias("issues"))


def og_mismatches(pages: DataFrame) -> DataFrame:
    """(url, reason): Open Graph titles and urls that differ from the page's, trimmed, without case."""
    same = lambda a, b: F.lower(F.trim(F.col(a))) == F.lower(F.trim(F.col(b)))
    filled = lambda *cs: F.forall(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cs]), lambda x: x != "")
    found = F.array(F.when(filled("og_title", "title") & ~same("og_title", "title"), F.lit("title_mismatch")), F.when(filled("og_url", "canonical") & ~same("og_url", "canonical"), F.lit("url_mismatch")))
    return pages.select("url", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("reason"))


def signals_summary(records: DataFrame) -> DataFrame:
    """One row: coverage in percent, distinct schema types, authority gap and the site's score.

    ``records`` has og, lang, hreflang, jsonld (booleans), schema_types, pagerank and authority.
    """
    share = lambda c: grid(F.count_if(c) / F.count(F.lit(1)) * 100, 2).alias(c)
    impact = F.col("pagerank") * 0.6 + F.col("authority") * 0.4
    gap = records.where("not jsonld").select((impact * 2).alias("g")).orderBy(F.col("g").desc()).limit(10).agg(F.least(F.lit(100.0), F.coalesce(F.sum("g"), F.lit(0.0))).alias("gap"))
    types = records.select(F.explode("schema_types").alias("t")).agg(F.count_distinct("t").alias("types"))
    one = records.agg(share("og"), share("lang"), share("hreflang"), share("jsonld")).crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(types))  # one row each
    score = F.col("jsonld") * 0.35 + F.col("og") * 0.25 + F.col("lang") * 0.15 + F.col("hreflang") * 0.1 + (1 - F.col("gap") / 100) * 10 + F.least(F.lit(1.0), F.col("types") / 12) * 15
    return one.withColumn("score", grid(clamp(score), 2))


def schema_groups(records: DataFrame) -> DataFrame:
    """(schema_hash, size, urls): pages by the hash of their structured data; no hash, no group."""
    g = records.where(F.coalesce(F.col("schema_hash"), F.lit("")) != "").groupBy("schema_hash")
    return g.agg(F.count(F.lit(1)).alias("size"), F.min("url").alias("first"))


def top_schema_types(records: DataFrame, limit: int = 10) -> DataFrame:
    return records.select(F.explode("schema_types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "type").limit(limit)


def same_og(records: DataFrame, limit: int = 10) -> DataFrame:
    """(og_hash, size): the largest groups of pages that say the same in Open Graph."""
    g = records.where(F.col("og_hash").isNotNull()).groupBy("og_hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return g.orderBy(F.col("size").desc(), "og_hash").limit(limit)


def signals_fixes(records: DataFrame, limit: int = 10) -> DataFrame:
    """(impact, type, url): pages whose missing signals cost most, the worst first in each kind."""
    weigh = F.col("pagerank") * 0.6 + F.col("authority") * 0.4
    kinds = [("high", "missing_jsonld", ~F.col("jsonld"), weigh), ("high", "missing_og", ~F.col("og"), F.col("authority")), ("medium", "missing_lang", ~F.col("lang"), weigh)]
    parts = [records.where(c).select(F.lit(i).alias("impact"), F.lit(t).alias("type"), "url", w.alias("w")).orderBy(F.col("w").desc(), "url").limit(limit) for i, t, c, w in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("impact", "type", "url")


def issue_counts(pages: DataFrame) -> DataFrame:
    """One row of issue counters over internal pages.

    ``pages`` has internal, status, crawl_status, trap, redirects, canonical, url, noindex, in_links,
    out_links, depth, n_h1, words, external_ratio, missing_alts and broken_links.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("bigint")
    c = F.col
    broken = (c("status") >= 400) | ((c("status") == 0) & c("crawl_status").isin("network_error", "failed_after_retries", "fetched_error"))
    bare = lambda x: F.regexp_replace(c(x), "/$", "")
    return pages.where("internal").agg(
        (n(broken) + F.coalesce(F.sum("broken_links"), F.lit(0))).cast("bigint").alias("broken_links"), n(c("redirects") > 1).alias("redirect_chains"), n((c("canonical") != c("url")) & (bare("canonical") != bare("url"))).alias("canonical_conflicts"),
        n(c("noindex") & c("status").between(200, 299)).alias("noindex_misuse"), n((c("in_links") == 1) & (c("depth") > 0)).alias("low_internal_links"), n(c("out_links") > 150).alias("excessive_links"), n(c("n_h1") == 0).alias("missing_h1"),
        n(c("words") < 200).alias("thin_content"), n(c("external_ratio") > 0.6).alias("high_external_ratio"), n(c("missing_alts") > 0).alias("image_alt_missing"), n(c("crawl_status").isin("blocked", "blocked_by_robots")).alias("blocked_by_robots"), n(c("trap")).alias("crawl_traps"),
        n((c("in_links") > 5) & (c("out_links") < 3)).alias("strong_under_linking"),
    )
