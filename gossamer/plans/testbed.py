"""Site tables derived from the test tables, as SQL that both engines read, and the store made of them.

Users are pages, days are snapshots (one per day and site), consecutive events are links.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gossamer.operators.store import Store

VIEWS: dict[str, str] = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(user_id % 2 + 1 AS BIGINT) AS site_id, CAST(dayofmonth(ts) * 2 + user_id % 2 AS BIGINT) AS snapshot_id FROM events",
    "sites": "SELECT site_id AS id, CASE WHEN site_id = 1 THEN 'alpha.example.com' ELSE 'beta.example.org' END AS domain, min(ts) AS created_at FROM ev GROUP BY site_id",
    "snapshots": """SELECT snapshot_id AS id, site_id, CASE WHEN snapshot_id % 7 = 0 THEN 'single' WHEN snapshot_id % 2 = 0 THEN 'completed' ELSE 'incremental' END AS run_type,
        CASE WHEN snapshot_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, min(ts) AS created_at, count(DISTINCT user_id) AS node_count, count(*) AS edge_count,
        CAST(count(*) % 101 AS DOUBLE) AS health_score, CAST(count(*) % 7 AS BIGINT) AS orphan_count FROM ev GROUP BY snapshot_id, site_id""",
    "site_pages": """SELECT user_id AS id, site_id, CASE WHEN user_id % 31 = 5 THEN 'https://alpha.example.com/u/' WHEN user_id % 37 = 4 THEN 'https://other.example.net/u/' ELSE '/u/' END || CAST(user_id AS STRING) AS normalized_url,
        CASE WHEN user_id % 82 = 6 THEN 20 ELSE min(snapshot_id) END AS first_seen, CASE WHEN user_id % 82 = 6 THEN 20 ELSE max(snapshot_id) END AS last_seen,
        CAST(CASE user_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 200 END AS BIGINT) AS http_status,
        CASE WHEN user_id % 7 = 0 THEN '/u/' || CAST(user_id - 1 AS STRING) WHEN user_id % 7 = 1 THEN '/u/' || CAST(user_id AS STRING) || '/'
        WHEN user_id % 7 = 2 THEN 'https://alpha.example.com/u/' || CAST(user_id AS STRING) WHEN user_id % 7 = 3 THEN 'https://alpha.example.com/u/' || CAST(user_id AS STRING) || '/' WHEN user_id % 7 = 4 THEN '/u/' || CAST(user_id AS STRING) END AS canonical_url,
        CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS noindex, CASE WHEN user_id % 10 = 1 THEN '[{"url":"/a"},{"url":"/b"}]' WHEN user_id % 10 = 4 THEN '[{"url":"/a"}]' END AS redirect_chain,
        CASE WHEN user_id % 23 = 0 THEN 'blocked_ip' END AS security_error, CAST(user_id % 6 AS BIGINT) AS depth, CASE WHEN user_id % 13 = 0 THEN 0 ELSE 1 END AS is_internal,
        CASE WHEN user_id % 19 = 0 THEN 1 ELSE 0 END AS crawl_trap_flag, CASE WHEN user_id % 5 = 0 THEN 'h' || CAST(user_id % 8 AS STRING) ELSE 'u' || CAST(user_id AS STRING) END AS content_hash
        FROM ev GROUP BY user_id, site_id""",
    "metrics": """SELECT snapshot_id, user_id AS page_id, CASE max(event_type) WHEN 'error' THEN 'network_error' WHEN 'view' THEN 'cached' WHEN 'signup' THEN 'blocked_by_robots' ELSE 'fetched' END AS crawl_status,
        count(*) * 60 AS word_count, CAST(user_id % 101 AS DOUBLE) AS thin_content_score, CAST((user_id * 37 + snapshot_id) % 101 AS DOUBLE) AS pagerank_score,
        CASE WHEN user_id % 4 = 0 THEN 'c' || CAST(user_id % 9 AS STRING) END AS duplicate_cluster_id, CASE WHEN user_id % 4 = 0 THEN 'near' ELSE 'none' END AS duplicate_type,
        CASE WHEN user_id % 8 = 0 THEN 1 ELSE 0 END AS is_cluster_primary, CASE WHEN user_id % 3 = 0 THEN CAST(user_id % 5 AS BIGINT) END AS cluster_id,
        CASE WHEN user_id % 9 = 0 THEN 'power' WHEN user_id % 9 = 1 THEN 'hub' ELSE 'peripheral' END AS link_role,
        CAST((user_id * 13 + snapshot_id) % 17 AS DOUBLE) AS auth_score, CAST((user_id * 5 + snapshot_id) % 19 AS DOUBLE) AS hub_score FROM ev WHERE user_id % 29 <> 7 GROUP BY snapshot_id, user_id""",
    "edges": """SELECT event_id AS id, snapshot_id, user_id AS source_page_id, lead(user_id) OVER (PARTITION BY snapshot_id ORDER BY ts, event_id) AS target_page_id,
        CASE event_type WHEN 'click' THEN 7e-1 WHEN 'view' THEN 4e-1 ELSE 1e0 END AS weight, CASE event_type WHEN 'error' THEN 'external' ELSE 'internal' END AS rel FROM ev""",
    "plugin_rows": """SELECT l.doc_id AS id, CAST(l.doc_id % 5 AS BIGINT) AS snapshot_id, CAST(l.doc_id % 40 AS BIGINT) AS url_id, CASE WHEN l.doc_id % 3 = 0 THEN 'signals' ELSE 'page-speed' END AS plugin,
        CASE WHEN l.doc_id % 11 = 0 THEN NULL ELSE CAST(l.quality * 100 AS DOUBLE) END AS score, CAST(1 + l.toxic AS DOUBLE) AS weight, l.doc_id * 60 AS age_seconds FROM labels l""",
}

BASE = ("events", "labels")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = BASE) -> None:
    """Temp views of the tables and of everything derived from them."""
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def store(spark: SparkSession, sf_dir: str) -> Store:
    register(spark, sf_dir)
    return Store(*[spark.table(t) for t in ("sites", "snapshots", "site_pages", "metrics", "edges", "plugin_rows")])


def for_duckdb(sql: str) -> str:
    """The same query with the derived tables as common table expressions."""
    ctes = ",\n".join(f"{k} AS ({v.replace('AS STRING', 'AS VARCHAR')})" for k, v in VIEWS.items())
    body = sql.replace("AS STRING", "AS VARCHAR").strip()
    return f"WITH {ctes},\n{body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"WITH {ctes}\n{body}"
