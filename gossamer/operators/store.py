"""Queries over a store of crawled sites, as functions of its tables with parameters.

Identifiers of snapshots are unique, so a side that is one snapshot is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gossamer.functions.url import lookup_candidates
from gossamer.operators.ranking import hits_eligible, rank_eligible

#: Crawl statuses, issue types with their severity and weight, thresholds.
FETCHED_STATES = ("fetched", "cached", "fetched_error")
FAILED_STATES = ("network_error", "failed_after_retries", "fetched_error")
SESSION_FETCHED = ("fetched", "fetched_error", "network_error", "failed_after_retries", "blocked_by_robots")
ISSUES = {
    "Broken Link": ("Critical", 80), "Redirect Chain": ("Warning", 40), "Indexability Risk": ("Warning", 30), "Thin Content": ("Warning", 25), "Low Word Count": ("Warning", 30),
    "Duplicate Content": ("Info", 10), "Orphan Page": ("Warning", 20), "Canonical Conflict": ("Warning", 15), "Page": ("Info", 0),
}
THIN_SCORE, LOW_WORDS = 70, 200


@dataclass(frozen=True)
class Store:
    """sites, snapshots, pages, metrics (one row a page and snapshot), edges and plugin_rows."""

    sites: DataFrame
    snapshots: DataFrame
    pages: DataFrame
    metrics: DataFrame
    edges: DataFrame
    plugin_rows: DataFrame


# -- scans ----------------------------------------------------------------------------------------


def snapshot_pages(st: Store, snapshot: int) -> DataFrame:
    """Pages that a cumulative snapshot shows: those of its site first seen in it or before."""
    s = st.snapshots.where(F.col("id") == snapshot).select("site_id", F.col("id").alias("snapshot_id"))
    return st.pages.join(F.broadcast(s), "site_id").where(F.coalesce("first_seen", "last_seen") <= F.col("snapshot_id"))


def run_pages(st: Store, snapshot: int) -> DataFrame:
    """Pages that a snapshot has metrics of."""
    return st.pages.join(snapshot_metrics(st, snapshot).select(F.col("page_id").alias("id")), "id", "left_semi")


def snapshot_edges(st: Store, snapshot: int) -> DataFrame:
    return st.edges.where(F.col("snapshot_id") == snapshot)


def snapshot_metrics(st: Store, snapshot: int) -> DataFrame:
    return st.metrics.where(F.col("snapshot_id") == snapshot)


def pages_by_urls(st: Store, urls: DataFrame) -> DataFrame:
    """Pages whose url is among ``urls`` (a column ``url``)."""
    return st.pages.join(urls.select(F.col("url").alias("normalized_url")), "normalized_url", "left_semi")


def sites_by_domain(st: Store, pattern: str) -> DataFrame:
    return st.sites.where(F.col("domain").like(pattern))


def latest_snapshots(st: Store) -> DataFrame:
    """The newest complete snapshot of each site that is not of a single page."""
    w = Window.partitionBy("site_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return st.snapshots.where(full_run()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def full_run() -> Column:
    return (F.col("status") == "completed") & (F.col("run_type") != "single")


def snapshot_counts(st: Store) -> DataFrame:
    return st.snapshots.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.max(full_run().cast("int")).alias("has_full"))


def graph_nodes(st: Store, snapshot: int) -> DataFrame:
    """(url, crawl_status, incremental_status): what a snapshot did with each page that it shows."""
    m = snapshot_metrics(st, snapshot).select(F.col("page_id").alias("id"), "crawl_status", F.lit(True).alias("_has"))
    state = F.when(F.col("first_seen") == F.col("snapshot_id"), "new").when(F.col("crawl_status") == "cached", "unchanged").when(F.col("_has"), "changed").otherwise("absent")
    return snapshot_pages(st, snapshot).join(m, "id", "left").select(F.col("normalized_url").alias("url"), F.coalesce("crawl_status", F.lit("none")).alias("crawl_status"), state.alias("incremental_status"))


def graph_edges(st: Store, snapshot: int) -> DataFrame:
    """(src, dst, weight) by url, each pair once with its largest weight."""
    e = snapshot_edges(st, snapshot).groupBy("source_page_id", "target_page_id").agg(F.max("weight").alias("weight"))
    name = lambda k, c: st.pages.select(F.col("id").alias(k), F.col("normalized_url").alias(c))
    return e.join(name("source_page_id", "src"), "source_page_id").join(name("target_page_id", "dst"), "target_page_id").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def latest_plugin_rows(st: Store, plugin: str) -> DataFrame:
    """The newest row of a plugin for each page."""
    w = Window.partitionBy("url_id").orderBy(F.col("id").desc())
    return st.plugin_rows.where(F.col("plugin") == plugin).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fresh_plugin_rows(st: Store, plugin: str, max_age_hours: int = 24) -> DataFrame:
    return st.plugin_rows.where((F.col("plugin") == plugin) & (F.col("age_seconds") <= max_age_hours * 3600))


def latest_reports(st: Store) -> DataFrame:
    return st.plugin_rows.groupBy("plugin", "snapshot_id").agg(F.max("id").alias("report_id"))


def latest_rows_of_pages(st: Store) -> DataFrame:
    return st.plugin_rows.groupBy("url_id", "plugin").agg(F.max("id").alias("latest"))


def lookup_pages(st: Store, candidates: DataFrame) -> DataFrame:
    """(query_id, id): the page of the first candidate url (query_id, pos, url) that is one."""
    hit = candidates.join(st.pages.select("id", F.col("normalized_url").alias("url")), "url")
    return hit.groupBy("query_id").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))


# -- predicates -----------------------------------------------------------------------------------


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def broken() -> Column:
    """Over pages joined with metrics; null where nothing tells."""
    c = F.col
    return (c("http_status") >= 400) | ((c("http_status") == 0) & c("crawl_status").isin(*FAILED_STATES)) | c("security_error").isNotNull()


def fetch_route(status: Column) -> Column:
    return F.when(status == 304, "cached").when(status == 0, "error").when(status >= 300, "fetched_error").when(status == 200, "parse").otherwise("ignored")


def canonical_conflict(origin: str, canonical: str = "canonical_url", url: str = "normalized_url") -> Column:
    """The issue list's form: the canonical is another page, with and without the origin, up to one slash at the end."""
    c, u = F.col(canonical), F.col(url)
    full = F.concat(F.lit(origin), u)
    bare = lambda x: F.regexp_replace(x, "/$", "")
    return F.coalesce((c != "") & (c != u) & (c != full) & (bare(c) != bare(full)), F.lit(False))


def canonical_elsewhere(origin: str, canonical: str = "canonical_url", url: str = "normalized_url") -> Column:
    """The overview's form: as above, with no slash counted at all."""
    c, u = F.col(canonical), F.col(url)
    full = F.concat(F.lit(origin), u)
    bare = lambda x: F.replace(x, F.lit("/"), F.lit(""))
    return F.coalesce((c != u) & (c != full) & (c != F.concat(full, F.lit("/"))) & (bare(c) != bare(full)), F.lit(False))


def pages_with_metrics(st: Store, snapshot: int | None = None) -> DataFrame:
    m = st.metrics if snapshot is None else snapshot_metrics(st, snapshot)
    return st.pages.join(m.withColumnRenamed("page_id", "id"), "id")


def broken_pages(st: Store, snapshot: int) -> DataFrame:
    return pages_with_metrics(st, snapshot).where(broken())


def session_stats(st: Store) -> DataFrame:
    n = lambda *states: F.count_if(F.col("crawl_status").isin(*states))
    return st.metrics.groupBy("snapshot_id").agg(n(*SESSION_FETCHED).alias("fetched"), n("cached").alias("cached"), n("skipped").alias("skipped"))


def ranked_pages(st: Store) -> DataFrame:
    """Pages that take part in PageRank."""
    none = F.lit(None)
    return st.pages.where(rank_eligible(F.col("noindex") == 1, none.cast("boolean"), none.cast("double"), F.col("canonical_url"), F.col("normalized_url"), F.col("http_status")))


def hits_pages(st: Store) -> DataFrame:
    """Pages that take part in HITS."""
    return st.pages.where(hits_eligible(F.col("http_status"), F.col("redirect_chain").isNotNull(), F.col("noindex") == 1))


def issues(st: Store, snapshot: int, origin: str, search: str | None = None) -> DataFrame:
    """(id, url, pagerank_score, last_seen, issue_type, severity, impact_score) of a snapshot's internal pages: the first issue that holds.

    Pages are those of the snapshot's site; ``search`` keeps urls that it is a part of, with % and _ as in LIKE.
    """
    c = F.col
    words = c("word_count") > 0
    rules = [
        ("Broken Link", broken()), ("Redirect Chain", c("redirect_chain").isNotNull()), ("Indexability Risk", c("noindex") == 1), ("Thin Content", words & (c("thin_content_score") > THIN_SCORE)),
        ("Low Word Count", words & (c("word_count") < LOW_WORDS)), ("Duplicate Content", words & (c("duplicate_type") != "none")), ("Orphan Page", c("link_role") == "orphan"), ("Canonical Conflict", canonical_conflict(origin)),
    ]
    kind = F.coalesce(*[F.when(rule, name) for name, rule in rules], F.lit("Page"))
    facts = F.create_map(*[x for k, (sev, w) in ISSUES.items() for x in (F.lit(k), F.struct(F.lit(sev).alias("severity"), F.lit(w).alias("weight")))])
    s = st.snapshots.where(c("id") == snapshot).select(F.col("id").alias("snapshot_id"), "site_id", F.col("created_at").alias("last_seen_at"))
    pages = pages_with_metrics(st, snapshot).where("is_internal = 1")
    if search:
        pages = pages.where(F.lower("normalized_url").like(f"%{search.lower()}%"))
    rows = pages.join(F.broadcast(s), ["snapshot_id", "site_id"]).withColumn("issue_type", kind).withColumn("_f", F.try_element_at(facts, F.col("issue_type")))
    impact = F.floor(c("_f.weight") * (0.5 + F.coalesce(c("pagerank_score"), F.lit(0.0)) / 200.0) + 0.5)
    return rows.select("id", c("normalized_url").alias("url"), "pagerank_score", c("last_seen_at").alias("last_seen"), "issue_type", c("_f.severity").alias("severity"), impact.alias("impact_score"))


def problems(found: DataFrame, domain: str) -> DataFrame:
    """Of ``issues`` what is a problem; information on absolute urls that do not name the site's domain is none."""
    foreign = F.col("url").startswith("http") & ~F.contains("url", F.lit(domain)) & (F.col("severity") == "Info")
    return found.where((F.col("issue_type") != "Page") & ~foreign)


def issue_list(st: Store, snapshot: int, origin: str, domain: str, severity: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the issue list by falling PageRank: of one severity; else all pages that a search finds; else the problems."""
    found = issues(st, snapshot, origin, search)
    if severity and severity != "All":
        found = found.where(F.col("severity") == severity)
    elif not search:
        found = problems(found, domain)
    return found.orderBy(F.col("pagerank_score").desc_nulls_last(), "url").offset(offset).limit(limit)


def sorted_issues(found: DataFrame, by: str, descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the issue list by any column; ties by url."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_first()
    return found.orderBy(order, "url").offset(offset).limit(limit)


def search(st: Store, needle: str) -> DataFrame:
    """Pages whose url holds the needle, whatever its case."""
    return st.pages.where(F.contains(F.lower("normalized_url"), F.lit(needle.lower())))


def page_badges(st: Store, snapshot: int) -> DataFrame:
    status, rank = F.col("http_status"), F.col("pagerank_score")
    badge = F.when((status >= 400) | (status == 0), "Critical").when(rank >= 80, "Good").when(rank >= 50, "Warning").otherwise("Critical")
    return pages_with_metrics(st, snapshot).select("id", badge.alias("badge"))


def conflicts(st: Store, origin: str) -> DataFrame:
    """The two forms of a canonical conflict, side by side."""
    return st.pages.select("id", canonical_conflict(origin).cast("int").alias("by_slash"), canonical_elsewhere(origin).cast("int").alias("by_all_slashes"))


# -- joins ----------------------------------------------------------------------------------------


def page_runs(st: Store, status: str = "completed") -> DataFrame:
    """(id, word_count, run_type) of each page in each snapshot of a status."""
    s = st.snapshots.where(F.col("status") == status).select(F.col("id").alias("snapshot_id"), "run_type")
    return pages_with_metrics(st).join(s, "snapshot_id").select("id", "word_count", "run_type")


def pages_left_metrics(st: Store, snapshot: int) -> DataFrame:
    return st.pages.join(snapshot_metrics(st, snapshot).select(F.col("page_id").alias("id"), "word_count"), "id", "left").select("id", "word_count")


def page_changes(st: Store, old: int, new: int) -> DataFrame:
    """(page_id, change): added and removed between two snapshots."""
    a, b = (snapshot_metrics(st, s).select("page_id") for s in (old, new))
    return b.join(a, "page_id", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "page_id", "left_anti").withColumn("change", F.lit("removed")))


def _run_states(st: Store, snapshot: int) -> DataFrame:
    """(url, bad, well) of a snapshot's pages, by the comparison's own rules."""
    bad = (F.col("http_status") >= 400) | F.col("crawl_status").isin("network_error", "fetched_error")
    well = (F.col("http_status") >= 200) & (F.col("http_status") < 400) & (F.col("crawl_status") == "fetched")
    no = F.lit(False)
    return pages_with_metrics(st, snapshot).select(F.col("normalized_url").alias("url"), F.coalesce(bad, no).alias("bad"), F.coalesce(well, no).alias("well"))


def newly_broken(st: Store, old: int, new: int) -> DataFrame:
    """url of pages broken in the new snapshot that are not there or not broken in the old one."""
    return _run_states(st, new).where("bad").join(_run_states(st, old).where("bad"), "url", "left_anti").select("url")


def resolved(st: Store, old: int, new: int) -> DataFrame:
    """url of pages broken in the old snapshot that the new one has fetched well."""
    return _run_states(st, old).where("bad").join(_run_states(st, new).where("well"), "url", "left_semi").select("url")


def site_pages_of(st: Store, snapshot: int) -> DataFrame:
    """Pages of the site that a snapshot belongs to."""
    return st.pages.join(F.broadcast(st.snapshots.where(F.col("id") == snapshot).select("site_id")), "site_id", "left_semi")


def edge_targets(st: Store, below: float = 1.0) -> DataFrame:
    """(id, target_url) of links lighter than ``below``."""
    return st.edges.where(F.col("weight") < below).join(st.pages.select(F.col("id").alias("target_page_id"), F.col("normalized_url").alias("target_url")), "target_page_id").select("id", "target_url")


def trends(st: Store, site: int, include_single: bool = False) -> DataFrame:
    """(id, date, pages, health, orphans, broken, clusters) of a site's snapshots; single pages' runs only if asked for."""
    runs = st.snapshots.where(F.col("site_id") == site)
    runs = runs if include_single else runs.where("run_type <> 'single'")
    n = pages_with_metrics(st).where(F.col("site_id") == site).where(broken()).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("broken"))
    c = st.metrics.groupBy("snapshot_id").agg(F.count_distinct("duplicate_cluster_id").alias("clusters"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    runs = runs.select(F.col("id").alias("snapshot_id"), F.col("created_at").alias("date"), F.col("node_count").alias("pages"), F.col("health_score").alias("health"), F.col("orphan_count").alias("orphans"))
    return runs.join(n, "snapshot_id", "left").join(c, "snapshot_id", "left").select(F.col("snapshot_id").alias("id"), "date", "pages", "health", zero("orphans"), zero("broken"), zero("clusters"))


def soft_orphans(st: Store) -> DataFrame:
    """(id, all_low_value): is every page that links here kept from the index?"""
    low = st.pages.select(F.col("id").alias("source_page_id"), (F.coalesce(F.col("noindex"), F.lit(0)) == 1).alias("low"))
    return st.edges.where("target_page_id is not null").join(low, "source_page_id").groupBy(F.col("target_page_id").alias("id")).agg(F.min(F.col("low").cast("int")).alias("all_low_value"))


def links_to_broken(st: Store, least: int = 400) -> DataFrame:
    bad = st.pages.where(F.col("http_status") >= least).select(F.col("id").alias("target_page_id"))
    return st.edges.join(bad, "target_page_id", "left_semi").groupBy(F.col("source_page_id").alias("id")).agg(F.count_distinct("target_page_id").alias("broken_targets"))


def previous_snapshots(st: Store) -> DataFrame:
    """(id, previous_id, delta of the health score) of a site's snapshots, single pages apart."""
    w = Window.partitionBy("site_id").orderBy("id")
    return st.snapshots.where("run_type <> 'single'").select("id", F.lag("id").over(w).alias("previous_id"), (F.col("health_score") - F.lag("health_score").over(w)).alias("delta"))


def neighbourhood(st: Store, snapshot: int, limit: int = 10) -> DataFrame:
    """(page, direction, url, score): the first neighbours of each page over internal links in either direction, by url."""
    e = snapshot_edges(st, snapshot).where("rel = 'internal'").select("id", "source_page_id", "target_page_id")
    both = e.select(F.col("target_page_id").alias("page"), F.lit("in").alias("direction"), F.col("source_page_id").alias("other"), "id").unionByName(e.select(F.col("source_page_id").alias("page"), F.lit("out").alias("direction"), F.col("target_page_id").alias("other"), "id"))
    named = both.where("page is not null").withColumnRenamed("id", "edge").join(st.pages.select(F.col("id").alias("other"), F.col("normalized_url").alias("url")), "other")
    scored = named.join(snapshot_metrics(st, snapshot).select(F.col("page_id").alias("other"), F.col("pagerank_score").alias("score")), "other", "left")
    place = F.row_number().over(Window.partitionBy("page", "direction").orderBy("url", "edge"))
    return scored.withColumn("_rn", place).where(F.col("_rn") <= limit).select("page", "direction", "url", "score")


# -- one page -------------------------------------------------------------------------------------


def resolve_page(st: Store, site: int, origin: str, url: str) -> DataFrame:
    """The page of a site that a url stands for (path or address, with or without a slash at the end): one row or none."""
    mine = st.pages.where(F.col("site_id") == site)
    forms = st.pages.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.posexplode(lookup_candidates(F.lit(url), F.lit(origin))).alias("pos", "normalized_url"))
    hit = mine.join(F.broadcast(forms), "normalized_url").groupBy("query_id").agg(F.min_by("id", F.struct("pos", "id")).alias("id"))
    return mine.join(F.broadcast(hit.select("id")), "id", "left_semi")


def inlinks(st: Store, snapshot: int, page: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """(source_url, source_pagerank, link_type, follow_state) of internal links to a page, by falling PageRank of their source."""
    e = snapshot_edges(st, snapshot).where((F.col("target_page_id") == page) & (F.col("rel") == "internal")).select("source_page_id", "rel", F.col("id").alias("edge"))
    rows = e.join(st.pages.select(F.col("id").alias("source_page_id"), F.col("normalized_url").alias("source_url")), "source_page_id")
    rows = rows.join(snapshot_metrics(st, snapshot).select(F.col("page_id").alias("source_page_id"), F.col("pagerank_score").alias("source_pagerank")), "source_page_id", "left")
    return rows.orderBy(F.col("source_pagerank").desc_nulls_last(), "source_url", "edge").offset(offset).limit(limit).select("source_url", "source_pagerank", F.col("rel").alias("link_type"), F.lit("Follow").alias("follow_state"))


def outlinks(st: Store, snapshot: int, page: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """(target_url, status, type, follow) of all links from a page, by falling status of their target."""
    e = snapshot_edges(st, snapshot).where(F.col("source_page_id") == page).select("target_page_id", "rel", F.col("id").alias("edge"))
    rows = e.join(st.pages.select(F.col("id").alias("target_page_id"), F.col("normalized_url").alias("target_url"), F.col("http_status").alias("status")), "target_page_id")
    rows = rows.orderBy(F.col("status").desc_nulls_last(), "target_url", "edge").offset(offset).limit(limit)
    return rows.select("target_url", "status", F.col("rel").alias("type"), F.when(F.col("rel") == "nofollow", 0).otherwise(1).alias("follow"))


def page_view(st: Store, snapshot: int, site: int, origin: str, url: str) -> DataFrame:
    """One row (or none) on the page that a url stands for: id, url, status, depth, scores, internal links in and
    out, and the latest completed snapshot that has measured any form of the url."""
    c, zero = F.col, F.lit(0)
    page = resolve_page(st, site, origin, url)
    m = snapshot_metrics(st, snapshot).select(c("page_id").alias("id"), "pagerank_score", "auth_score", "hub_score")
    ids = F.broadcast(page.select("id"))
    e = snapshot_edges(st, snapshot).where("rel = 'internal'")
    ins = e.select(c("target_page_id").alias("id")).join(ids, "id").groupBy("id").agg(F.count(F.lit(1)).alias("inlinks"))
    outs = e.select(c("source_page_id").alias("id")).join(ids, "id").groupBy("id").agg(F.count(F.lit(1)).alias("outlinks"))
    forms = st.pages.sparkSession.range(1).select(F.explode(lookup_candidates(F.lit(url), F.lit(origin))).alias("normalized_url"))
    done = st.snapshots.where((c("site_id") == site) & (c("status") == "completed")).select(c("id").alias("snapshot_id"))
    seen = pages_with_metrics(st).join(F.broadcast(forms), "normalized_url", "left_semi").join(F.broadcast(done), "snapshot_id", "left_semi").agg(F.max("snapshot_id").alias("latest_snapshot"))
    # every side is one row by now
    one = page.join(m, "id", "left").join(ins, "id", "left").join(outs, "id", "left").crossJoin(F.broadcast(seen))
    scores = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("pagerank_score", "auth_score", "hub_score")]
    return one.select("id", c("normalized_url").alias("url"), "http_status", F.coalesce("depth", zero).alias("depth"), *scores, F.coalesce("inlinks", zero).alias("inlinks"), F.coalesce("outlinks", zero).alias("outlinks"), "latest_snapshot")


def page_cluster(st: Store, snapshot: int, page: int, limit: int = 10) -> DataFrame:
    """(url) of the first pages, by url, that share a page's duplicate cluster."""
    m = snapshot_metrics(st, snapshot).where("duplicate_cluster_id is not null").select(F.col("page_id").alias("id"), "duplicate_cluster_id")
    own = m.where(F.col("id") == page).select("duplicate_cluster_id")
    others = m.where(F.col("id") != page).join(F.broadcast(own), "duplicate_cluster_id", "left_semi")
    return st.pages.select("id", F.col("normalized_url").alias("url")).join(others, "id", "left_semi").select("url").orderBy("url").limit(limit)


# -- aggregates -----------------------------------------------------------------------------------


def overview(st: Store, snapshot: int, origin: str) -> DataFrame:
    """One row of counts over the internal pages of a snapshot."""
    c = F.col
    chain = F.coalesce(F.json_array_length("redirect_chain"), F.lit(0)) > 1
    counts = {
        "crawled": c("crawl_status").isin(*FETCHED_STATES), "broken": broken(), "server_errors": c("http_status") >= 500, "redirect_chains": chain, "noindex_pages": c("noindex") == 1,
        "canonical_issues": canonical_elsewhere(origin), "blocked_robots": c("crawl_status") == "blocked_by_robots", "crawl_traps": c("crawl_trap_flag") == 1,
    }
    return pages_with_metrics(st, snapshot).where("is_internal = 1").agg(F.count(F.lit(1)).alias("total_pages"), *[F.count_if(v).alias(k) for k, v in counts.items()])


def issue_facts(st: Store, snapshot: int, origin: str, parsed: DataFrame) -> DataFrame:
    """What ``scoring.issue_counts`` counts, of a snapshot's pages; ``parsed`` is (id, n_h1, missing_alts) of pages with html."""
    c = F.col
    e = snapshot_edges(st, snapshot)
    outside = e.groupBy(c("source_page_id").alias("id")).agg((F.count_if(c("rel") == "external") / F.count(F.lit(1))).alias("external_ratio"))
    bad = st.pages.where("http_status >= 400").select(c("id").alias("target_page_id"))
    to_bad = e.join(bad, "target_page_id", "left_semi").groupBy(c("source_page_id").alias("id")).agg(F.count_distinct("target_page_id").alias("broken_links"))
    rows = pages_with_metrics(st, snapshot)
    for more in (link_counts(st, snapshot, None, True), outside, to_bad, parsed):
        rows = rows.join(more, "id", "left")
    whole = F.when(c("canonical_url").startswith("/"), F.concat(F.lit(origin), c("canonical_url"))).otherwise(c("canonical_url"))
    return rows.select(
        "id", (c("is_internal") == 1).alias("internal"), c("http_status").alias("status"), "crawl_status", (c("crawl_trap_flag") == 1).alias("trap"), F.coalesce(F.json_array_length("redirect_chain"), F.lit(0)).alias("redirects"),
        whole.alias("canonical"), F.when(c("normalized_url").startswith("/"), F.concat(F.lit(origin), c("normalized_url"))).otherwise(c("normalized_url")).alias("url"), (c("noindex") == 1).alias("noindex"), "in_links", "out_links", "depth", "n_h1", c("word_count").alias("words"),
        F.coalesce("external_ratio", F.lit(0.0)).alias("external_ratio"), "missing_alts", F.coalesce("broken_links", F.lit(0)).alias("broken_links"),
    )


def duplicate_pages(st: Store) -> DataFrame:
    return st.metrics.groupBy("snapshot_id").agg(F.count_if(F.col("duplicate_cluster_id").isNotNull() & (F.col("is_cluster_primary") == 0)).alias("duplicates"))


def cluster_and_link_counts(st: Store) -> DataFrame:
    links = st.edges.where("rel = 'internal'").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("internal_links"))
    return st.metrics.groupBy("snapshot_id").agg(F.count_distinct("duplicate_cluster_id").alias("clusters")).join(links, "snapshot_id")


def depth_histogram(st: Store, snapshot: int) -> DataFrame:
    return snapshot_pages(st, snapshot).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def cluster_sizes(st: Store, snapshot: int) -> DataFrame:
    sizes = snapshot_metrics(st, snapshot).where("duplicate_cluster_id is not null").groupBy("duplicate_cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def depth_lists(pages: DataFrame, depth: str = "depth", score: str = "score", name: str = "url") -> DataFrame:
    """(depth, pages): the names of each depth by falling score, as one list."""
    each = pages.groupBy(F.col(depth).alias("depth")).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(name).alias("u")))).alias("l"))
    return each.select("depth", F.transform("l", lambda x: x.u).alias("pages"))


def broken_and_clusters(st: Store) -> DataFrame:
    return pages_with_metrics(st).groupBy("snapshot_id").agg(F.count_if(broken()).alias("broken"), F.count_distinct("cluster_id").alias("clusters"))


def last_snapshots(st: Store) -> DataFrame:
    return st.metrics.groupBy("page_id").agg(F.max("snapshot_id").alias("last_snapshot"))


def link_counts(st: Store, snapshot: int, rel: str | None = "internal", distinct: bool = False) -> DataFrame:
    """(id, in_links, out_links) of every page in a snapshot's links."""
    e = snapshot_edges(st, snapshot)
    e = e if rel is None else e.where(F.col("rel") == rel)
    n = lambda c: F.count_distinct(c) if distinct else F.count(F.lit(1))
    i = e.groupBy(F.col("target_page_id").alias("id")).agg(n("source_page_id").alias("in_links"))
    o = e.groupBy(F.col("source_page_id").alias("id")).agg(n("target_page_id").alias("out_links"))
    return st.pages.select("id").join(i, "id", "left").join(o, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_links", "out_links")])


def equity(st: Store, snapshot: int) -> DataFrame:
    """(id, equity): internal links out to internal links in, either counted up to 10."""
    e = link_counts(st, snapshot)
    ratio = F.least("out_links", F.lit(10)) * 1e6 / F.least("in_links", F.lit(10))
    return e.select("id", F.when(F.col("in_links") == 0, F.lit(0.0)).otherwise(F.floor(ratio + 0.5) / 1e6).alias("equity"))


def exact_groups(st: Store) -> DataFrame:
    return st.pages.groupBy("content_hash").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("representative")).where("size > 1")


def canonical_inlinks(st: Store) -> DataFrame:
    """(target, inbound): links in from distinct pages, added up over the pages of one canonical."""
    n = st.edges.groupBy(F.col("target_page_id").alias("id")).agg(F.count_distinct("source_page_id").cast("double").alias("n"))
    return st.pages.join(n, "id", "left").groupBy(F.coalesce("canonical_url", "normalized_url").alias("target")).agg(F.sum(F.coalesce("n", F.lit(0.0))).alias("inbound"))


def sites_summary(st: Store) -> DataFrame:
    facts = st.snapshots.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.max(F.struct("id", "node_count", "health_score")).alias("s"))
    return st.sites.select(F.col("id").alias("site_id"), "domain").join(facts, "site_id").select("domain", "n_snapshots", F.col("s.id").alias("latest_snapshot"), "s.node_count", "s.health_score")


def sites_latest_full(st: Store) -> DataFrame:
    full = st.snapshots.where(full_run()).groupBy(F.col("site_id").alias("id")).agg(F.max("id").alias("latest_full"))
    return st.sites.select("id", "domain").join(full, "id", "left")


def group_severity(st: Store) -> DataFrame:
    """(content_hash, severity): high where canonicals are missing or disagree."""
    g = st.pages.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("canonical_url").isNull()).alias("none"), F.count_distinct("canonical_url").alias("names"))
    return g.where("n > 1").select("content_hash", F.when((F.col("none") > 0) | (F.col("names") > 1), "high").otherwise("low").alias("severity"))


# -- order and limits -----------------------------------------------------------------------------


def top_pages(st: Store, snapshot: int, limit: int = 10) -> DataFrame:
    """(url, pagerank_score, auth_score, hub_score) of the internal pages of the highest PageRank."""
    rows = pages_with_metrics(st, snapshot).where("is_internal = 1").select(F.col("normalized_url").alias("url"), "pagerank_score", "auth_score", "hub_score")
    return rows.orderBy(F.col("pagerank_score").desc_nulls_last(), "url").limit(limit)


def depth_places(st: Store, snapshot: int) -> DataFrame:
    """(depth, url, status, score, place): places of internal pages within a depth by PageRank score."""
    w = Window.partitionBy("depth").orderBy(F.col("pagerank_score").desc_nulls_last(), "normalized_url")
    rows = pages_with_metrics(st, snapshot).where("is_internal = 1")
    return rows.select("depth", F.col("normalized_url").alias("url"), F.col("http_status").alias("status"), F.coalesce("pagerank_score", F.lit(0.0)).alias("score"), F.row_number().over(w).alias("place"))


def history(st: Store, site: int) -> DataFrame:
    return st.snapshots.where(F.col("site_id") == site).select("id", "created_at", "node_count", "health_score")


def dashboard_site(st: Store) -> DataFrame:
    """The domain with the newest snapshot."""
    s = st.snapshots.select("site_id", "created_at", F.col("id").alias("snapshot"))
    return st.sites.select(F.col("id").alias("site_id"), "domain").join(s, "site_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("snapshot").desc()).limit(1).select("domain")


# -- comparisons ----------------------------------------------------------------------------------


def compare_graphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed, changed_status, changed_canonical (a page may have both), same.

    Both sides have id, status and canonical; a canonical that comes or goes is a change.
    """
    a = old.select("id", F.col("status").alias("s0"), F.col("canonical").alias("c0"), F.lit(True).alias("a"))
    b = new.select("id", F.col("status").alias("s1"), F.col("canonical").alias("c1"), F.lit(True).alias("b"))
    both = F.col("a") & F.col("b")
    found = F.array(
        F.when(F.col("a").isNull(), "added"), F.when(F.col("b").isNull(), "removed"),
        F.when(both & ~F.col("s0").eqNullSafe(F.col("s1")), "changed_status"), F.when(both & ~F.col("c0").eqNullSafe(F.col("c1")), "changed_canonical"),
    )
    changes = F.filter(found, lambda x: x.isNotNull())
    return a.join(b, "id", "full_outer").select("id", F.explode(F.when(F.size(changes) > 0, changes).otherwise(F.array(F.lit("same")))).alias("change"))


def metric_deltas(old: DataFrame, new: DataFrame, names: tuple[str, ...] = ("entropy", "orphans", "efficiency")) -> DataFrame:
    """(metric, old, new, delta) of two one-row tables of graph metrics."""
    side = lambda df, c: df.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("metric", c))
    return side(old, "old").join(side(new, "new"), "metric").withColumn("delta", F.col("new") - F.col("old"))


def compare_counts(st: Store, old: int, new: int) -> DataFrame:
    """One row: pages added, removed, newly broken and resolved."""
    a, b = (_run_states(st, s).select("url") for s in (old, new))
    parts = {"added": b.join(a, "url", "left_anti"), "removed": a.join(b, "url", "left_anti"), "newly_broken": newly_broken(st, old, new), "resolved": resolved(st, old, new)}
    rows = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*[F.count_if(F.col("part") == k).alias(k) for k in parts])


def compare_view(st: Store, site: int, old: int, new: int, limit: int = 50) -> DataFrame:
    """One row: pages added and removed, the change of the health score, and the first urls newly broken and
    resolved, as lists by url. No row unless both snapshots are the site's."""
    health = lambda s: F.max(F.when(F.col("id") == s, F.coalesce("health_score", F.lit(0.0))))
    both = st.snapshots.where((F.col("site_id") == site) & F.col("id").isin(old, new))
    delta = both.agg(F.count_distinct("id").alias("_n"), (health(new) - health(old)).alias("health_delta")).where(F.col("_n") == len({old, new})).drop("_n")
    urls = lambda df, k: df.orderBy("url").limit(limit).agg(F.array_sort(F.collect_list("url")).alias(k))
    counts = compare_counts(st, old, new).select("added", "removed")
    # every side is one row
    return counts.crossJoin(F.broadcast(delta)).crossJoin(F.broadcast(urls(newly_broken(st, old, new), "new_broken"))).crossJoin(F.broadcast(urls(resolved(st, old, new), "resolved_broken")))


def missing_pages(st: Store, old: int, new: int) -> DataFrame:
    """page_id of pages that the old snapshot has and the new one has not."""
    return snapshot_metrics(st, old).select("page_id").distinct().join(snapshot_metrics(st, new).select("page_id"), "page_id", "left_anti")


def event_series(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    return events.groupBy(F.dayofmonth(ts).alias("day"), F.col(kind).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


# -- changes of state -----------------------------------------------------------------------------


def create_site(sites: DataFrame, domain: str, created_at: Column) -> DataFrame:
    """The sites with one more, unless the domain is there already."""
    row = sites.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"), F.max((F.col("domain") == domain).cast("int")).alias("_has")).where("coalesce(_has, 0) = 0")
    return sites.unionByName(row.select("id", F.lit(domain).alias("domain"), created_at.cast(sites.schema["created_at"].dataType).alias("created_at")), allowMissingColumns=True)


def update_site(sites: DataFrame, domain: str, **values) -> DataFrame:
    """A site's preferences; values that are None stay as they were."""
    mine = F.col("domain") == domain
    given = {k: v for k, v in values.items() if v is not None}
    out = sites
    for k, v in given.items():
        before = F.col(k) if k in sites.columns else F.lit(None)
        out = out.withColumn(k, F.when(mine, F.lit(v)).otherwise(before))
    return out


def delete_site(st: Store, site: int) -> Store:
    """The store without a site and all that belongs to it."""
    gone = st.snapshots.where(F.col("site_id") == site).select(F.col("id").alias("snapshot_id"))
    of = lambda df: df.join(gone, "snapshot_id", "left_anti").select(*df.columns)
    return Store(st.sites.where(F.col("id") != site), st.snapshots.where(F.col("site_id") != site), st.pages.where(F.col("site_id") != site), of(st.metrics), of(st.edges), of(st.plugin_rows))


def reset(st: Store) -> Store:
    """The store with all its tables empty."""
    return Store(*[getattr(st, f).limit(0) for f in ("sites", "snapshots", "pages", "metrics", "edges", "plugin_rows")])


def create_snapshot(snapshots: DataFrame, site: int, run_type: str, status: str, created_at: Column) -> DataFrame:
    """The snapshots with one more, whose id is the next."""
    row = snapshots.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", F.lit(site).cast(snapshots.schema["site_id"].dataType).alias("site_id"), F.lit(run_type).alias("run_type"), F.lit(status).alias("status"), created_at.cast(snapshots.schema["created_at"].dataType).alias("created_at")
    )
    return snapshots.unionByName(row, allowMissingColumns=True)


def update_snapshot(snapshots: DataFrame, snapshot: int, **values: Column) -> DataFrame:
    """One snapshot's columns set (status, created_at, scores); all others stay."""
    mine = F.col("id") == snapshot
    return snapshots.select(*[F.when(mine, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in snapshots.columns])


def write_back_scores(snapshots: DataFrame, plugin_rows: DataFrame) -> DataFrame:
    """Snapshots with ``total_score``: the health score with weight 100 and plugin scores with theirs, one digit."""
    r = plugin_rows.where("score is not null").groupBy(F.col("snapshot_id").alias("id")).agg(F.sum(F.col("score") * F.col("weight")).alias("_w"), F.sum("weight").alias("_t"))
    total = F.floor((F.col("health_score") * 100 + F.coalesce("_w", F.lit(0.0))) / (100 + F.coalesce("_t", F.lit(0.0))) * 10 + 0.5) / 10
    return snapshots.join(r, "id", "left").withColumn("total_score", total).drop("_w", "_t")
