"""The store's operators over the test tables. Their SQL, which shares nothing with them, is in ``site_queries``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.operators import graph as G
from gossamer.operators import mutations as M
from gossamer.operators import scoring as C
from gossamer.operators import store as O
from gossamer.plans import testbed
from gossamer.plans.site_queries import DOMAIN, ORIGIN
from gossamer.plugins import blend, roll_up
from gossamer.session import table


def _graph(st: O.Store, snapshot: int) -> DataFrame:
    """id, depth and links of the pages of a snapshot, for its metrics."""
    n = O.run_pages(st, snapshot).select("id", "depth")
    e = O.snapshot_edges(st, snapshot).select(F.col("source_page_id").alias("src"), F.col("target_page_id").alias("dst"), "weight")
    return G.degrees(G.build_graph(n, e))


def _blended(st: O.Store) -> DataFrame:
    r = roll_up(st.plugin_rows, "snapshot_id").select(F.col("snapshot_id").alias("id"), "weighted", "weights")
    return st.snapshots.join(r, "id", "left").select("id", blend(F.col("health_score"), F.col("weighted"), F.col("weights")).alias("total_score"))


def _variants(st: O.Store) -> DataFrame:
    raw = F.concat(F.col("normalized_url"), F.lit("/"))
    both = F.array(F.struct(F.lit(0).alias("pos"), raw.alias("url")), F.struct(F.lit(1).alias("pos"), F.regexp_replace(raw, "/$", "").alias("url")))
    return O.lookup_pages(st, st.pages.select(F.col("id").alias("query_id"), F.explode(both).alias("v")).select("query_id", "v.*"))


def _health_labels(st: O.Store) -> DataFrame:
    return st.snapshots.select("id", C.health_label(F.col("health_score"), F.col("orphan_count") > 0).alias("label"))


def _side(st: O.Store, snapshot: int) -> DataFrame:
    return O.snapshot_metrics(st, snapshot).select(F.col("page_id").alias("id"), F.col("crawl_status").alias("status"), F.col("duplicate_cluster_id").alias("canonical"))


def _without(st: O.Store, snapshot: int) -> dict[str, DataFrame]:
    return M.delete_snapshot(snapshot, st.snapshots, st.pages, st.edges, st.metrics, st.plugin_rows)


OPERATORS: dict[str, Callable[[O.Store], DataFrame]] = {
    "a1_pages_cumulative": lambda st: O.snapshot_pages(st, 20).select("id", "normalized_url", "http_status"),
    "a1_pages_single": lambda st: O.run_pages(st, 21).select("id", "normalized_url", "http_status"),
    "a3_page_identity": lambda st: O.snapshot_pages(st, 31).select("id", "normalized_url"),
    "a4_edges_of_snapshot": lambda st: O.snapshot_edges(st, 20).select("source_page_id", "target_page_id", "weight", "rel"),
    "a5_metrics_of_snapshot": lambda st: O.snapshot_metrics(st, 20).select("page_id", "crawl_status", "word_count", "pagerank_score"),
    "a6_pages_by_urls": lambda st: O.pages_by_urls(st, st.pages.select(F.concat(F.lit("/u/"), (F.col("id") * 2 % 300).cast("string")).alias("url"))).select("id", "normalized_url"),
    "a7_sites_by_domain": lambda st: O.sites_by_domain(st, "%.example.%").select("id", "domain"),
    "a8_latest_snapshot": lambda st: O.latest_snapshots(st).select("site_id", "id"),
    "a8_snapshot_counts": O.snapshot_counts,
    "a9_graph_nodes": lambda st: O.graph_nodes(st, 20),
    "a9_graph_edges": lambda st: O.graph_edges(st, 20),
    "a19_plugin_rows_latest": lambda st: O.latest_plugin_rows(st, "signals").select("url_id", "id", "score"),
    "a19_plugin_rows_max_age": lambda st: O.fresh_plugin_rows(st, "signals", 24).select("id", "url_id", "score"),
    "a20_plugin_report_latest": O.latest_reports,
    "a21_page_by_variants": _variants,
    "p4_retryable": lambda st: st.pages.select("http_status", O.retryable(F.col("http_status")).alias("retryable")).distinct(),
    "p5_broken_pages": lambda st: O.broken_pages(st, 20).select("id"),
    "p7_session_stats": O.session_stats,
    "p8_rank_eligible": lambda st: O.ranked_pages(st).select("id"),
    "p9_hits_eligible": lambda st: O.hits_pages(st).select("id"),
    "p11_issue_classifier": lambda st: O.issues(st, 40, ORIGIN).select("url", "issue_type", "severity", "impact_score"),
    "p12_canonical_conflicts": lambda st: O.conflicts(st, ORIGIN),
    "p13_search": lambda st: O.search(st, "U/1").select("id", "normalized_url"),
    "p11_issues_of_severity": lambda st: O.issue_list(st, 40, ORIGIN, DOMAIN, "Warning", limit=20, offset=5).select("url", "issue_type", "severity", "impact_score"),
    "p11_issues_searched": lambda st: O.issue_list(st, 40, ORIGIN, DOMAIN, search="U/1_", limit=20).select("url", "issue_type", "severity", "impact_score"),
    "p14_problems_only": lambda st: O.problems(O.issues(st, 40, ORIGIN), DOMAIN).select("url", "severity"),
    "p16_page_badges": lambda st: O.page_badges(st, 20),
    "p17_health_labels": _health_labels,
    "p20_fetch_routing": lambda st: st.pages.select("id", O.fetch_route(F.col("http_status")).alias("route")),
    "j2_pages_metrics_snapshots": O.page_runs,
    "j4_left_join_metrics": lambda st: O.pages_left_metrics(st, 20),
    "j5_added_removed": lambda st: O.page_changes(st, 20, 22),
    "j6_newly_broken": lambda st: O.newly_broken(st, 20, 22),
    "j7_resolved": lambda st: O.resolved(st, 20, 22),
    "j8_scalar_subquery": lambda st: O.site_pages_of(st, 20).select("id"),
    "j10_url_hash_join": O.edge_targets,
    "j11_trends_default_zero": lambda st: O.trends(st, 1),
    "j11_trends_with_single": lambda st: O.trends(st, 2, include_single=True),
    "j15_soft_orphans": O.soft_orphans,
    "j16_links_to_broken": O.links_to_broken,
    "j17_previous_snapshot": O.previous_snapshots,
    "j18_neighbourhood": lambda st: O.neighbourhood(st, 20, 10),
    "e1_overview": lambda st: O.overview(st, 20, ORIGIN),
    "e2_duplicate_pages": O.duplicate_pages,
    "e3_cluster_and_link_counts": O.cluster_and_link_counts,
    "e4_depth_histogram": lambda st: O.depth_histogram(st, 40),
    "e5_cluster_sizes": lambda st: O.cluster_sizes(st, 20),
    "e7_broken_and_clusters": O.broken_and_clusters,
    "e8_last_snapshot_of_page": O.last_snapshots,
    "e9_link_counts": lambda st: O.link_counts(st, 20),
    "e10_plugin_rollup": lambda st: roll_up(st.plugin_rows, "plugin", "snapshot_id"),
    "e11_score_blend": _blended,
    "e16_exact_clusters": O.exact_groups,
    "e17_canonical_inlinks": O.canonical_inlinks,
    "e25_sites_summary": O.sites_summary,
    "e26_sites_latest_full": O.sites_latest_full,
    "e29_cluster_severity": O.group_severity,
    "t1_top_pagerank": lambda st: O.top_pages(st, 20, 10),
    "t3_inlinks_page": lambda st: O.inlinks(st, 20, 12, 50),
    "t3_outlinks_page": lambda st: O.outlinks(st, 20, 12, 50),
    "t3_page_view": lambda st: O.page_view(st, 20, 1, ORIGIN, f"{ORIGIN}/u/12/"),
    "t3_page_cluster": lambda st: O.page_cluster(st, 20, 12),
    "t4_depth_pages": lambda st: O.depth_places(st, 20),
    "t5_retention": lambda st: st.snapshots.select("id").join(M.retained(st.snapshots).select("id"), "id", "left_anti"),
    "t8_history": lambda st: O.history(st, 1),
    "t9_dashboard_site": O.dashboard_site,
    "t10_sorted_issues": lambda st: O.sorted_issues(O.issues(st, 40, ORIGIN), "impact_score", True, 50).select("url", "issue_type", "impact_score"),
    "h_url_set_difference": lambda st: O.missing_pages(st, 20, 22),
    "g10_compare_graphs": lambda st: O.compare_graphs(_side(st, 20), _side(st, 22)),
    "g10_metric_deltas": lambda st: O.metric_deltas(G.graph_metrics(_graph(st, 20)), G.graph_metrics(_graph(st, 22))).select("metric", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("old", "new", "delta")]),
    "g12_compare_counts": lambda st: O.compare_counts(st, 20, 22),
    "g12_compare_view": lambda st: O.compare_view(st, 1, 20, 22).withColumns({c: F.array_join(c, " ") for c in ("new_broken", "resolved_broken")}),
    "m2_metrics_replace": lambda st: M.replace_rows(O.snapshot_metrics(st, 20).select("page_id", "word_count"), O.snapshot_metrics(st, 22).select("page_id", "word_count"), ["page_id"]),
    "m4_snapshot_delete": lambda st: _without(st, 20)["pages"].select("id", "first_seen", "last_seen"),
    "m4_metrics_after_delete": lambda st: _without(st, 20)["metrics"].select("snapshot_id", "page_id"),
    "m4_edges_after_delete": lambda st: _without(st, 20)["edges"].select("id"),
    "m6_snapshot_status": lambda st: O.update_snapshot(O.create_snapshot(st.snapshots, 2, "completed", "running", F.lit("2030-01-01 00:00:00")), 20, status=F.lit("failed")).select("id", "site_id", "run_type", "status"),
    "m7_edges_delete_by_source": lambda st: st.edges.where(~F.coalesce((F.col("snapshot_id") == 20) & (F.col("source_page_id") % 3 == 0), F.lit(False))).select("id"),
    "m8_score_write_back": lambda st: O.write_back_scores(st.snapshots, st.plugin_rows).select("id", "total_score"),
    "m9_cache_through": lambda st: M.cache_through(st.pages.select("id"), st.plugin_rows.where("plugin = 'signals'").select(F.col("url_id").alias("id")).distinct().withColumn("source", F.lit("cached")), "id", lambda miss: miss.withColumn("source", F.lit("compute"))),
    "m10_site_changes": lambda st: O.update_site(O.create_site(O.create_site(O.delete_site(st, 1).sites, "gamma.example.net", F.lit("2030-01-01 00:00:00")), "beta.example.org", F.lit("2030-01-01 00:00:00")), "beta.example.org", preferred="https").select("id", "domain", "preferred"),
    "m10_pages_after_site_delete": lambda st: O.delete_site(st, 1).metrics.select("page_id", "snapshot_id"),
    "x10_plugin_rows_of_pages": O.latest_rows_of_pages,
    "l13_equity_ratio": lambda st: O.equity(st, 20),
}


def _bound(operator: Callable[[O.Store], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(testbed.store(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _bound(v) for k, v in OPERATORS.items()}
QUERIES["r6_trend_series"] = lambda spark, sf_dir: O.event_series(table(spark, sf_dir, "events"))
