"""What the store's operators have to return, as SQL for DuckDB.

Keys start with the survey's operator ids; the operators that answer are in ``operators.store``.
"""

from __future__ import annotations

DOMAIN = "alpha.example.com"
ORIGIN = f"https://{DOMAIN}"
BROKEN = "(p.http_status >= 400 OR (p.http_status = 0 AND m.crawl_status IN ('network_error', 'failed_after_retries', 'fetched_error')) OR p.security_error IS NOT NULL)"
#: Pages of a run by url: is it broken, was it fetched well, as the comparison has it.
RUNS = """runs AS (SELECT m.snapshot_id AS run, p.normalized_url AS url, coalesce(p.http_status >= 400, FALSE) OR coalesce(m.crawl_status IN ('network_error', 'fetched_error'), FALSE) AS bad,
        coalesce(p.http_status BETWEEN 200 AND 399 AND m.crawl_status = 'fetched', FALSE) AS well FROM metrics m JOIN site_pages p ON p.id = m.page_id)"""
VISIBLE = "JOIN snapshots s ON s.site_id = p.site_id AND coalesce(p.first_seen, p.last_seen) <= s.id"

ISSUES = f"""SELECT p.id, p.normalized_url AS url, m.pagerank_score, s.created_at AS last_seen,
    CASE WHEN p.http_status >= 400 OR (p.http_status = 0 AND m.crawl_status IN ('network_error', 'failed_after_retries', 'fetched_error')) OR p.security_error IS NOT NULL THEN 'Broken Link'
      WHEN p.redirect_chain IS NOT NULL THEN 'Redirect Chain' WHEN p.noindex = 1 THEN 'Indexability Risk' WHEN m.word_count > 0 AND m.thin_content_score > 70 THEN 'Thin Content'
      WHEN m.word_count > 0 AND m.word_count < 200 THEN 'Low Word Count' WHEN m.word_count > 0 AND m.duplicate_type IS NOT NULL AND m.duplicate_type <> 'none' THEN 'Duplicate Content'
      WHEN m.link_role = 'orphan' THEN 'Orphan Page'
      WHEN p.canonical_url NOT IN ('', p.normalized_url, '{ORIGIN}' || p.normalized_url) AND regexp_replace(p.canonical_url, '/$', '') <> regexp_replace('{ORIGIN}' || p.normalized_url, '/$', '') THEN 'Canonical Conflict'
      ELSE 'Page' END AS issue_type
    FROM metrics m JOIN site_pages p ON p.id = m.page_id JOIN snapshots s ON s.id = m.snapshot_id WHERE m.snapshot_id = 40 AND p.site_id = s.site_id AND p.is_internal = 1"""
SCORED = f"""SELECT i.*, CASE issue_type WHEN 'Broken Link' THEN 'Critical' WHEN 'Page' THEN 'Info' WHEN 'Duplicate Content' THEN 'Info' ELSE 'Warning' END AS severity,
    CAST(floor((CASE issue_type WHEN 'Broken Link' THEN 80 WHEN 'Redirect Chain' THEN 40 WHEN 'Indexability Risk' THEN 30 WHEN 'Thin Content' THEN 25 WHEN 'Low Word Count' THEN 30
      WHEN 'Duplicate Content' THEN 10 WHEN 'Orphan Page' THEN 20 WHEN 'Canonical Conflict' THEN 15 ELSE 0 END) * (5e-1 + coalesce(pagerank_score, 0) / 2e2) + 5e-1) AS BIGINT) AS impact_score FROM ({ISSUES}) i"""

SQL: dict[str, str] = {
    # scans
    "a1_pages_cumulative": f"SELECT p.id, p.normalized_url, p.http_status FROM site_pages p {VISIBLE} WHERE s.id = 20",
    "a1_pages_single": "SELECT p.id, p.normalized_url, p.http_status FROM site_pages p WHERE EXISTS (SELECT 1 FROM metrics m WHERE m.page_id = p.id AND m.snapshot_id = 21)",
    "a3_page_identity": f"SELECT p.id, p.normalized_url FROM site_pages p {VISIBLE} WHERE s.id = 31",
    "a4_edges_of_snapshot": "SELECT source_page_id, target_page_id, weight, rel FROM edges WHERE snapshot_id = 20",
    "a5_metrics_of_snapshot": "SELECT page_id, crawl_status, word_count, pagerank_score FROM metrics WHERE snapshot_id = 20",
    "a6_pages_by_urls": "WITH w AS (SELECT DISTINCT '/u/' || CAST(o_custkey % 300 AS STRING) AS url FROM (SELECT user_id * 2 AS o_custkey FROM ev) t) SELECT p.id, p.normalized_url FROM site_pages p WHERE p.normalized_url IN (SELECT url FROM w)",
    "a7_sites_by_domain": "SELECT id, domain FROM sites WHERE domain LIKE '%.example.%'",
    "a8_latest_snapshot": "SELECT site_id, id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id DESC) AS rn FROM snapshots WHERE status = 'completed' AND run_type <> 'single') t WHERE rn = 1",
    "a8_snapshot_counts": "SELECT site_id, count(*) AS n_snapshots, max(CASE WHEN run_type <> 'single' AND status = 'completed' THEN 1 ELSE 0 END) AS has_full FROM snapshots GROUP BY site_id",
    "a9_graph_nodes": f"""SELECT p.normalized_url AS url, coalesce(m.crawl_status, 'none') AS crawl_status,
        CASE WHEN p.first_seen = s.id THEN 'new' WHEN m.crawl_status = 'cached' THEN 'unchanged' WHEN m.page_id IS NOT NULL THEN 'changed' ELSE 'absent' END AS incremental_status
        FROM site_pages p {VISIBLE} LEFT JOIN metrics m ON m.page_id = p.id AND m.snapshot_id = s.id WHERE s.id = 20""",
    "a9_graph_edges": "SELECT a.normalized_url AS src, b.normalized_url AS dst, max(e.weight) AS weight FROM edges e JOIN site_pages a ON a.id = e.source_page_id JOIN site_pages b ON b.id = e.target_page_id WHERE e.snapshot_id = 20 GROUP BY a.normalized_url, b.normalized_url",
    "a19_plugin_rows_latest": "SELECT url_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY id DESC) AS rn FROM plugin_rows WHERE plugin = 'signals') t WHERE rn = 1",
    "a19_plugin_rows_max_age": "SELECT id, url_id, score FROM plugin_rows WHERE plugin = 'signals' AND age_seconds <= 24 * 3600",
    "a20_plugin_report_latest": "SELECT plugin, snapshot_id, max(id) AS report_id FROM plugin_rows GROUP BY plugin, snapshot_id",
    "a21_page_by_variants": """WITH q AS (SELECT id AS user_id, normalized_url || '/' AS raw FROM site_pages),
        c AS (SELECT user_id, 0 AS pos, raw AS url FROM q UNION ALL SELECT user_id, 1, regexp_replace(raw, '/$', '') FROM q)
        SELECT user_id AS query_id, id FROM (SELECT c.user_id, p.id, row_number() OVER (PARTITION BY c.user_id ORDER BY c.pos) AS rn FROM c JOIN site_pages p ON p.normalized_url = c.url) t WHERE rn = 1""",
    # predicates
    "p4_retryable": "SELECT DISTINCT http_status, http_status = 429 OR http_status BETWEEN 500 AND 599 AS retryable FROM site_pages",
    "p5_broken_pages": f"SELECT p.id FROM site_pages p JOIN metrics m ON m.page_id = p.id WHERE m.snapshot_id = 20 AND {BROKEN}",
    "p7_session_stats": "SELECT snapshot_id, count(*) FILTER (WHERE crawl_status IN ('fetched', 'fetched_error', 'network_error', 'failed_after_retries', 'blocked_by_robots')) AS fetched, count(*) FILTER (WHERE crawl_status = 'cached') AS cached, count(*) FILTER (WHERE crawl_status = 'skipped') AS skipped FROM metrics GROUP BY snapshot_id",
    "p8_rank_eligible": "SELECT id FROM site_pages WHERE noindex = 0 AND http_status < 400 AND http_status <> 0 AND (canonical_url IS NULL OR canonical_url = normalized_url)",
    "p9_hits_eligible": "SELECT id FROM site_pages WHERE http_status IN (200, 0) AND redirect_chain IS NULL AND noindex = 0",
    "p11_issue_classifier": f"SELECT url, issue_type, severity, impact_score FROM ({SCORED}) t",
    "p12_canonical_conflicts": f"""SELECT id, CASE WHEN canonical_url NOT IN ('', normalized_url, '{ORIGIN}' || normalized_url) AND regexp_replace(canonical_url, '/$', '') <> regexp_replace('{ORIGIN}' || normalized_url, '/$', '') THEN 1 ELSE 0 END AS by_slash,
        CASE WHEN canonical_url NOT IN (normalized_url, '{ORIGIN}' || normalized_url, '{ORIGIN}' || normalized_url || '/') AND replace(canonical_url, '/', '') <> replace('{ORIGIN}' || normalized_url, '/', '') THEN 1 ELSE 0 END AS by_all_slashes FROM site_pages""",
    "p13_search": "SELECT id, normalized_url FROM site_pages WHERE lower(normalized_url) LIKE lower('%U/1%')",
    "p11_issues_of_severity": f"SELECT url, issue_type, severity, impact_score FROM ({SCORED}) t WHERE severity = 'Warning' ORDER BY pagerank_score DESC NULLS LAST, url LIMIT 20 OFFSET 5",
    "p11_issues_searched": f"SELECT url, issue_type, severity, impact_score FROM ({SCORED}) t WHERE url ILIKE '%U/1_%' ORDER BY pagerank_score DESC NULLS LAST, url LIMIT 20",
    "p14_problems_only": f"SELECT url, severity FROM ({SCORED}) t WHERE issue_type <> 'Page' AND NOT (url LIKE 'http%' AND url NOT LIKE '%{DOMAIN}%' AND severity = 'Info')",
    "p16_page_badges": """SELECT p.id, CASE WHEN p.http_status >= 400 OR p.http_status = 0 THEN 'Critical' WHEN m.pagerank_score >= 80 THEN 'Good' WHEN m.pagerank_score >= 50 THEN 'Warning' ELSE 'Critical' END AS badge
        FROM site_pages p JOIN metrics m ON m.page_id = p.id WHERE m.snapshot_id = 20""",
    "p17_health_labels": "SELECT id, CASE WHEN orphan_count > 0 AND health_score >= 75 THEN 'Needs Attention' WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 75 THEN 'Good' WHEN health_score >= 50 THEN 'Needs Attention' ELSE 'Critical' END AS label FROM snapshots",
    "p20_fetch_routing": "SELECT id, CASE WHEN http_status = 304 THEN 'cached' WHEN http_status = 0 THEN 'error' WHEN http_status >= 300 THEN 'fetched_error' WHEN http_status = 200 THEN 'parse' ELSE 'ignored' END AS route FROM site_pages",
    # joins
    "j2_pages_metrics_snapshots": "SELECT p.id, m.word_count, s.run_type FROM site_pages p JOIN metrics m ON m.page_id = p.id JOIN snapshots s ON s.id = m.snapshot_id WHERE s.status = 'completed'",
    "j4_left_join_metrics": "SELECT p.id, m.word_count FROM site_pages p LEFT JOIN metrics m ON m.page_id = p.id AND m.snapshot_id = 20",
    "j5_added_removed": """WITH a AS (SELECT page_id FROM metrics WHERE snapshot_id = 20), b AS (SELECT page_id FROM metrics WHERE snapshot_id = 22)
        SELECT page_id, 'added' AS change FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = b.page_id) UNION ALL SELECT page_id, 'removed' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page_id = b.page_id)""",
    "j6_newly_broken": f"WITH {RUNS} SELECT url FROM runs WHERE run = 22 AND bad EXCEPT SELECT url FROM runs WHERE run = 20 AND bad",
    "j7_resolved": f"WITH {RUNS} SELECT url FROM runs WHERE run = 20 AND bad INTERSECT SELECT url FROM runs WHERE run = 22 AND well",
    "j8_scalar_subquery": "SELECT p.id FROM site_pages p WHERE p.site_id = (SELECT max(site_id) FROM snapshots WHERE id = 20)",
    "j10_url_hash_join": "SELECT e.id, b.normalized_url AS target_url FROM edges e JOIN site_pages b ON b.id = e.target_page_id WHERE e.weight < 1",
    "j11_trends_default_zero": f"""SELECT s.id, s.created_at AS date, s.node_count AS pages, s.health_score AS health, coalesce(s.orphan_count, 0) AS orphans, coalesce(b.n, 0) AS broken, coalesce(c.n, 0) AS clusters FROM snapshots s
        LEFT JOIN (SELECT m.snapshot_id, count(*) AS n FROM metrics m JOIN site_pages p ON p.id = m.page_id WHERE p.site_id = 1 AND {BROKEN} GROUP BY m.snapshot_id) b ON b.snapshot_id = s.id
        LEFT JOIN (SELECT snapshot_id, count(DISTINCT duplicate_cluster_id) AS n FROM metrics GROUP BY snapshot_id) c ON c.snapshot_id = s.id WHERE s.site_id = 1 AND s.run_type <> 'single'""",
    "j11_trends_with_single": f"""SELECT s.id, s.created_at AS date, s.node_count AS pages, s.health_score AS health, coalesce(s.orphan_count, 0) AS orphans, coalesce(b.n, 0) AS broken, coalesce(c.n, 0) AS clusters FROM snapshots s
        LEFT JOIN (SELECT m.snapshot_id, count(*) AS n FROM metrics m JOIN site_pages p ON p.id = m.page_id WHERE p.site_id = 2 AND {BROKEN} GROUP BY m.snapshot_id) b ON b.snapshot_id = s.id
        LEFT JOIN (SELECT snapshot_id, count(DISTINCT duplicate_cluster_id) AS n FROM metrics GROUP BY snapshot_id) c ON c.snapshot_id = s.id WHERE s.site_id = 2""",
    "j15_soft_orphans": "SELECT e.target_page_id AS id, min(CASE WHEN p.noindex = 1 THEN 1 ELSE 0 END) AS all_low_value FROM edges e JOIN site_pages p ON p.id = e.source_page_id WHERE e.target_page_id IS NOT NULL GROUP BY e.target_page_id",
    "j16_links_to_broken": "SELECT e.source_page_id AS id, count(DISTINCT e.target_page_id) AS broken_targets FROM edges e JOIN site_pages p ON p.id = e.target_page_id WHERE p.http_status >= 400 GROUP BY e.source_page_id",
    "j17_previous_snapshot": "SELECT id, lag(id) OVER (PARTITION BY site_id ORDER BY id) AS previous_id, health_score - lag(health_score) OVER (PARTITION BY site_id ORDER BY id) AS delta FROM snapshots WHERE run_type <> 'single'",
    "j18_neighbourhood": """SELECT page, direction, url, score FROM (SELECT t.page, t.direction, p.normalized_url AS url, m.pagerank_score AS score, row_number() OVER (PARTITION BY t.page, t.direction ORDER BY p.normalized_url, t.id) AS rn FROM (
        SELECT target_page_id AS page, 'in' AS direction, source_page_id AS other, id FROM edges WHERE snapshot_id = 20 AND rel = 'internal' AND target_page_id IS NOT NULL
        UNION ALL SELECT source_page_id, 'out', target_page_id, id FROM edges WHERE snapshot_id = 20 AND rel = 'internal') t
        JOIN site_pages p ON p.id = t.other LEFT JOIN metrics m ON m.page_id = p.id AND m.snapshot_id = 20) u WHERE rn <= 10""",
    # aggregates
    "e1_overview": f"""SELECT count(*) AS total_pages, count(*) FILTER (WHERE m.crawl_status IN ('fetched', 'cached', 'fetched_error')) AS crawled, count(*) FILTER (WHERE {BROKEN}) AS broken,
        count(*) FILTER (WHERE p.http_status >= 500) AS server_errors, count(*) FILTER (WHERE p.redirect_chain IS NOT NULL AND json_array_length(p.redirect_chain) > 1) AS redirect_chains,
        count(*) FILTER (WHERE p.noindex = 1) AS noindex_pages, count(*) FILTER (WHERE p.canonical_url NOT IN (p.normalized_url, '{ORIGIN}' || p.normalized_url, '{ORIGIN}' || p.normalized_url || '/') AND replace(p.canonical_url, '/', '') <> replace('{ORIGIN}' || p.normalized_url, '/', '')) AS canonical_issues,
        count(*) FILTER (WHERE m.crawl_status = 'blocked_by_robots') AS blocked_robots, count(*) FILTER (WHERE p.crawl_trap_flag = 1) AS crawl_traps
        FROM metrics m JOIN site_pages p ON p.id = m.page_id WHERE m.snapshot_id = 20 AND p.is_internal = 1""",
    "e2_duplicate_pages": "SELECT snapshot_id, count(*) FILTER (WHERE duplicate_cluster_id IS NOT NULL AND is_cluster_primary = 0) AS duplicates FROM metrics GROUP BY snapshot_id",
    "e3_cluster_and_link_counts": "SELECT m.snapshot_id, count(DISTINCT m.duplicate_cluster_id) AS clusters, max(e.n) AS internal_links FROM metrics m JOIN (SELECT snapshot_id, count(*) AS n FROM edges WHERE rel = 'internal' GROUP BY snapshot_id) e ON e.snapshot_id = m.snapshot_id GROUP BY m.snapshot_id",
    "e4_depth_histogram": f"SELECT p.depth, count(*) AS n FROM site_pages p {VISIBLE} WHERE s.id = 40 GROUP BY p.depth",
    "e5_cluster_sizes": "SELECT size, count(*) AS n FROM (SELECT duplicate_cluster_id, count(*) AS size FROM metrics WHERE snapshot_id = 20 AND duplicate_cluster_id IS NOT NULL GROUP BY duplicate_cluster_id) t GROUP BY size",
    "e7_broken_and_clusters": f"SELECT m.snapshot_id, count(*) FILTER (WHERE {BROKEN}) AS broken, count(DISTINCT m.cluster_id) AS clusters FROM metrics m JOIN site_pages p ON p.id = m.page_id GROUP BY m.snapshot_id",
    "e8_last_snapshot_of_page": "SELECT page_id, max(snapshot_id) AS last_snapshot FROM metrics GROUP BY page_id",
    "e9_link_counts": """SELECT p.id, coalesce(i.n, 0) AS in_links, coalesce(o.n, 0) AS out_links FROM site_pages p
        LEFT JOIN (SELECT target_page_id AS id, count(*) AS n FROM edges WHERE rel = 'internal' AND snapshot_id = 20 GROUP BY target_page_id) i ON i.id = p.id
        LEFT JOIN (SELECT source_page_id AS id, count(*) AS n FROM edges WHERE rel = 'internal' AND snapshot_id = 20 GROUP BY source_page_id) o ON o.id = p.id""",
    "e10_plugin_rollup": "SELECT plugin, snapshot_id, sum(score * weight) AS weighted, sum(weight) AS weights, count(score) AS n FROM plugin_rows WHERE score IS NOT NULL GROUP BY plugin, snapshot_id",
    "e11_score_blend": """WITH r AS (SELECT snapshot_id, sum(score * weight) AS w, sum(weight) AS t FROM plugin_rows WHERE score IS NOT NULL GROUP BY snapshot_id)
        SELECT s.id, floor((s.health_score * 100 + coalesce(r.w, 0)) / (100 + coalesce(r.t, 0)) * 10 + 5e-1) / 10 AS total_score FROM snapshots s LEFT JOIN r ON r.snapshot_id = s.id""",
    "e16_exact_clusters": "SELECT content_hash, count(*) AS size, min(id) AS representative FROM site_pages GROUP BY content_hash HAVING count(*) > 1",
    "e17_canonical_inlinks": "SELECT coalesce(p.canonical_url, p.normalized_url) AS target, sum(coalesce(i.n, 0)) AS inbound FROM site_pages p LEFT JOIN (SELECT target_page_id AS id, CAST(count(DISTINCT source_page_id) AS DOUBLE) AS n FROM edges GROUP BY target_page_id) i ON i.id = p.id GROUP BY coalesce(p.canonical_url, p.normalized_url)",
    "e25_sites_summary": "SELECT t.domain, t.n_snapshots, s.id AS latest_snapshot, s.node_count, s.health_score FROM (SELECT d.domain, d.id, count(*) AS n_snapshots, max(s.id) AS latest FROM sites d JOIN snapshots s ON s.site_id = d.id GROUP BY d.domain, d.id) t JOIN snapshots s ON s.id = t.latest",
    "e26_sites_latest_full": "SELECT d.id, d.domain, max(s.id) AS latest_full FROM sites d LEFT JOIN snapshots s ON s.site_id = d.id AND s.run_type <> 'single' AND s.status = 'completed' GROUP BY d.id, d.domain",
    "e29_cluster_severity": """SELECT content_hash, CASE WHEN count(*) FILTER (WHERE canonical_url IS NULL) > 0 OR count(DISTINCT canonical_url) > 1 THEN 'high' ELSE 'low' END AS severity FROM site_pages GROUP BY content_hash HAVING count(*) > 1""",
    # order and limits
    "t1_top_pagerank": "SELECT p.normalized_url AS url, m.pagerank_score, m.auth_score, m.hub_score FROM metrics m JOIN site_pages p ON p.id = m.page_id WHERE m.snapshot_id = 20 AND p.is_internal = 1 ORDER BY m.pagerank_score DESC NULLS LAST, p.normalized_url LIMIT 10",
    "t3_inlinks_page": """WITH sources AS (SELECT id, source_page_id AS page_id, rel FROM edges WHERE snapshot_id = 20 AND target_page_id = 12 AND rel = 'internal'), ranks AS (SELECT page_id, pagerank_score FROM metrics WHERE snapshot_id = 20)
        SELECT p.normalized_url AS source_url, ranks.pagerank_score AS source_pagerank, sources.rel AS link_type, 'Follow' AS follow_state FROM sources JOIN site_pages p ON p.id = sources.page_id LEFT JOIN ranks USING (page_id) ORDER BY 2 DESC NULLS LAST, 1, sources.id LIMIT 50""",
    "t3_outlinks_page": """WITH targets AS (SELECT id, target_page_id AS page_id, rel FROM edges WHERE snapshot_id = 20 AND source_page_id = 12)
        SELECT p.normalized_url AS target_url, p.http_status AS status, targets.rel AS type, CAST(targets.rel <> 'nofollow' AS INT) AS follow FROM targets JOIN site_pages p ON p.id = targets.page_id ORDER BY 2 DESC NULLS LAST, 1, targets.id LIMIT 50""",
    "t3_page_view": """SELECT p.id, p.normalized_url AS url, p.http_status, coalesce(p.depth, 0) AS depth, coalesce(m.pagerank_score, 0) AS pagerank_score, coalesce(m.auth_score, 0) AS auth_score, coalesce(m.hub_score, 0) AS hub_score,
        (SELECT count(*) FROM edges e WHERE e.snapshot_id = 20 AND e.target_page_id = p.id AND e.rel = 'internal') AS inlinks, (SELECT count(*) FROM edges e WHERE e.snapshot_id = 20 AND e.source_page_id = p.id AND e.rel = 'internal') AS outlinks,
        (SELECT max(x.snapshot_id) FROM metrics x JOIN site_pages q ON q.id = x.page_id JOIN snapshots s ON s.id = x.snapshot_id WHERE s.site_id = 1 AND s.status = 'completed' AND q.normalized_url IN ('/u/12/', '/u/12', 'https://alpha.example.com/u/12', 'https://alpha.example.com/u/12/')) AS latest_snapshot
        FROM site_pages p LEFT JOIN metrics m ON m.page_id = p.id AND m.snapshot_id = 20 WHERE p.site_id = 1 AND p.normalized_url = '/u/12'""",
    "t3_page_cluster": "SELECT p.normalized_url AS url FROM metrics m JOIN site_pages p ON m.page_id = p.id WHERE m.snapshot_id = 20 AND p.id <> 12 AND m.duplicate_cluster_id = (SELECT x.duplicate_cluster_id FROM metrics x WHERE x.snapshot_id = 20 AND x.page_id = 12) ORDER BY p.normalized_url LIMIT 10",
    "t4_depth_pages": "SELECT p.depth, p.normalized_url AS url, p.http_status AS status, coalesce(m.pagerank_score, 0) AS score, row_number() OVER (PARTITION BY p.depth ORDER BY m.pagerank_score DESC NULLS LAST, p.normalized_url) AS place FROM site_pages p JOIN metrics m ON m.page_id = p.id WHERE m.snapshot_id = 20 AND p.is_internal = 1",
    "t5_retention": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY site_id, CASE WHEN run_type = 'single' THEN 1 ELSE 0 END ORDER BY created_at DESC, id DESC) AS rn FROM snapshots) t WHERE rn > 5",
    "t8_history": "SELECT id, created_at, node_count, health_score FROM snapshots WHERE site_id = 1",
    "t9_dashboard_site": "SELECT domain FROM sites d JOIN snapshots s ON s.site_id = d.id ORDER BY s.created_at DESC NULLS LAST, s.id DESC LIMIT 1",
    "t10_sorted_issues": f"SELECT url, issue_type, impact_score FROM ({SCORED}) t ORDER BY impact_score DESC NULLS LAST, url LIMIT 50",
    "h_url_set_difference": "SELECT page_id FROM metrics WHERE snapshot_id = 20 EXCEPT SELECT page_id FROM metrics WHERE snapshot_id = 22",
    # comparisons
    "g10_compare_graphs": """WITH a AS (SELECT page_id, crawl_status, duplicate_cluster_id AS c FROM metrics WHERE snapshot_id = 20), b AS (SELECT page_id, crawl_status, duplicate_cluster_id AS c FROM metrics WHERE snapshot_id = 22),
        j AS (SELECT coalesce(a.page_id, b.page_id) AS id, a.page_id AS x, b.page_id AS y, a.crawl_status IS DISTINCT FROM b.crawl_status AS s, a.c IS DISTINCT FROM b.c AS c FROM a FULL OUTER JOIN b ON a.page_id = b.page_id)
        SELECT id, 'added' AS change FROM j WHERE x IS NULL UNION ALL SELECT id, 'removed' FROM j WHERE y IS NULL UNION ALL SELECT id, 'changed_status' FROM j WHERE x = y AND s
        UNION ALL SELECT id, 'changed_canonical' FROM j WHERE x = y AND c UNION ALL SELECT id, 'same' FROM j WHERE x = y AND NOT s AND NOT c""",
    "g10_metric_deltas": """WITH n AS (SELECT m.snapshot_id AS s, p.id, p.depth FROM metrics m JOIN site_pages p ON p.id = m.page_id WHERE m.snapshot_id IN (20, 22)),
        e AS (SELECT DISTINCT x.snapshot_id AS s, x.source_page_id AS src, x.target_page_id AS dst FROM edges x JOIN n a ON a.s = x.snapshot_id AND a.id = x.source_page_id JOIN n b ON b.s = x.snapshot_id AND b.id = x.target_page_id),
        g AS (SELECT n.s, n.id, n.depth, (SELECT count(*) FROM e WHERE e.s = n.s AND e.dst = n.id) AS i, (SELECT count(*) FROM e WHERE e.s = n.s AND e.src = n.id) AS o FROM n),
        t AS (SELECT s, count(*) AS n FROM g GROUP BY s), h AS (SELECT g.s, -sum(1e0 / t.n * log2(k.c / CAST(t.n AS DOUBLE))) AS entropy FROM g JOIN t ON t.s = g.s JOIN (SELECT s, o, count(*) AS c FROM g GROUP BY s, o) k ON k.s = g.s AND k.o = g.o GROUP BY g.s),
        v AS (SELECT s, 'entropy' AS metric, entropy AS v FROM h UNION ALL SELECT s, 'orphans', CAST(count(*) FILTER (WHERE i = 0 AND depth > 0) AS DOUBLE) FROM g GROUP BY s UNION ALL SELECT s, 'efficiency', count(*) FILTER (WHERE depth <= 3) / CAST(count(*) AS DOUBLE) FROM g GROUP BY s)
        SELECT a.metric, floor(a.v * 1e6 + 5e-1) / 1e6 AS old, floor(b.v * 1e6 + 5e-1) / 1e6 AS new, floor((b.v - a.v) * 1e6 + 5e-1) / 1e6 AS delta FROM v a JOIN v b ON a.metric = b.metric AND a.s = 20 AND b.s = 22""",
    "g12_compare_counts": f"""WITH {RUNS}, n AS (SELECT url FROM runs WHERE run = 22 AND bad EXCEPT SELECT url FROM runs WHERE run = 20 AND bad), r AS (SELECT url FROM runs WHERE run = 20 AND bad INTERSECT SELECT url FROM runs WHERE run = 22 AND well),
        sides AS (SELECT url, bool_or(run = 20) AS before, bool_or(run = 22) AS after FROM runs WHERE run IN (20, 22) GROUP BY url)
        SELECT (SELECT count(*) FROM sides WHERE after AND NOT before) AS added, (SELECT count(*) FROM sides WHERE before AND NOT after) AS removed, (SELECT count(*) FROM n) AS newly_broken, (SELECT count(*) FROM r) AS resolved""",
    "g12_compare_view": f"""WITH {RUNS}, n AS (SELECT url FROM runs WHERE run = 22 AND bad EXCEPT SELECT url FROM runs WHERE run = 20 AND bad), r AS (SELECT url FROM runs WHERE run = 20 AND bad INTERSECT SELECT url FROM runs WHERE run = 22 AND well),
        sides AS (SELECT url, bool_or(run = 20) AS before, bool_or(run = 22) AS after FROM runs WHERE run IN (20, 22) GROUP BY url)
        SELECT (SELECT count(*) FROM sides WHERE after AND NOT before) AS added, (SELECT count(*) FROM sides WHERE before AND NOT after) AS removed,
        (SELECT sum(CASE id WHEN 22 THEN 1 ELSE -1 END * coalesce(health_score, 0)) FROM snapshots WHERE id IN (20, 22)) AS health_delta,
        coalesce((SELECT string_agg(url, ' ' ORDER BY url) FROM (SELECT url FROM n ORDER BY url LIMIT 50)), '') AS new_broken, coalesce((SELECT string_agg(url, ' ' ORDER BY url) FROM (SELECT url FROM r ORDER BY url LIMIT 50)), '') AS resolved_broken""",
    # state after changes
    "m2_metrics_replace": "SELECT page_id, word_count FROM metrics WHERE snapshot_id = 22 UNION ALL SELECT page_id, word_count FROM metrics o WHERE snapshot_id = 20 AND NOT EXISTS (SELECT 1 FROM metrics n WHERE n.snapshot_id = 22 AND n.page_id = o.page_id)",
    "m4_snapshot_delete": "SELECT * FROM (SELECT id, nullif(first_seen, 20) AS first_seen, nullif(last_seen, 20) AS last_seen FROM site_pages) t WHERE first_seen IS NOT NULL OR last_seen IS NOT NULL",
    "m4_metrics_after_delete": "SELECT m.snapshot_id, m.page_id FROM metrics m WHERE m.snapshot_id <> 20 AND m.page_id NOT IN (SELECT id FROM site_pages WHERE nullif(first_seen, 20) IS NULL AND nullif(last_seen, 20) IS NULL)",
    "m4_edges_after_delete": """WITH gone AS (SELECT id FROM site_pages WHERE nullif(first_seen, 20) IS NULL AND nullif(last_seen, 20) IS NULL)
        SELECT e.id FROM edges e WHERE e.snapshot_id <> 20 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = e.source_page_id OR gone.id = e.target_page_id)""",
    "m6_snapshot_status": "SELECT id, site_id, run_type, CASE WHEN id = 20 THEN 'failed' ELSE status END AS status FROM snapshots UNION ALL SELECT max(id) + 1, 2, 'completed', 'running' FROM snapshots",
    "m8_score_write_back": "SELECT s.id, floor((s.health_score * 100 + coalesce((SELECT sum(score * weight) FROM plugin_rows r WHERE r.snapshot_id = s.id), 0)) / (100 + coalesce((SELECT sum(weight) FROM plugin_rows r WHERE r.snapshot_id = s.id AND score IS NOT NULL), 0)) * 10 + 5e-1) / 10 AS total_score FROM snapshots s",
    "m10_site_changes": "SELECT id, domain, 'https' AS preferred FROM sites WHERE id <> 1 UNION ALL SELECT max(id) + 1, 'gamma.example.net', NULL FROM sites WHERE id <> 1",
    "m10_pages_after_site_delete": "SELECT page_id, snapshot_id FROM metrics WHERE snapshot_id NOT IN (SELECT id FROM snapshots WHERE site_id = 1)",
    "m7_edges_delete_by_source": "SELECT id FROM edges WHERE NOT (snapshot_id = 20 AND source_page_id % 3 = 0)",
    "m9_cache_through": "SELECT p.id, CASE WHEN c.url_id IS NULL THEN 'compute' ELSE 'cached' END AS source FROM site_pages p LEFT JOIN (SELECT DISTINCT url_id FROM plugin_rows WHERE plugin = 'signals') c ON c.url_id = p.id",
    "r6_trend_series": "SELECT dayofmonth(ts) AS day, event_type, count(*) AS n FROM events GROUP BY dayofmonth(ts), event_type",
    "x10_plugin_rows_of_pages": "SELECT url_id, plugin, max(id) AS latest FROM plugin_rows GROUP BY url_id, plugin",
    "l13_equity_ratio": """SELECT p.id, CASE WHEN coalesce(i.n, 0) = 0 THEN 0e0 ELSE floor(least(coalesce(o.n, 0), 10) * 1e6 / least(i.n, 10) + 5e-1) / 1e6 END AS equity FROM site_pages p
        LEFT JOIN (SELECT target_page_id AS id, count(*) AS n FROM edges WHERE snapshot_id = 20 AND rel = 'internal' GROUP BY target_page_id) i ON i.id = p.id
        LEFT JOIN (SELECT source_page_id AS id, count(*) AS n FROM edges WHERE snapshot_id = 20 AND rel = 'internal' GROUP BY source_page_id) o ON o.id = p.id""",
}
