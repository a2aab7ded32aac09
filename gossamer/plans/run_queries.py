"""Whole runs over the test tables: crawls, committed stores, streams; with their SQL where it can say them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.plans import testbed
from gossamer.plans.data_queries import NORM
from gossamer.plugins import Plugin, Registry
from gossamer.session import scratch, table
from gossamer.sources import committed, crawling, formats, runs
from gossamer.sources.connectors import expand_sitemaps
from gossamer.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SITE = "https://site.example.com"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return keep


def site_archive(spark: SparkSession, d: str) -> DataFrame:
    """Every row of pages as a recorded response /p/<id>, with links to four more pages before its own; every ninth moved."""
    k = F.col("page_id")
    at = lambda x: F.concat(F.lit(f"{SITE}/p/"), x.cast("string"))
    links = F.concat(*[F.concat(F.lit('<a href="/p/'), (4 * k + i).cast("string"), F.lit('">next</a>')) for i in range(1, 5)])
    body = F.concat(F.lit("<body>"), links, F.coalesce("html", F.lit("")))
    moved = k % 9 == 8
    final = F.when(moved, k - 1).otherwise(k)
    hop = F.array(F.struct(at(k).alias("url"), F.lit(301).alias("status"), at(k - 1).alias("target")))
    none = F.lit(None)
    return table(spark, d, "pages").select(
        at(k).alias("url"), F.when(final % 11 == 10, 404).otherwise(200).cast("int").alias("status"), none.cast("string").alias("state"), at(final).alias("final_url"),
        F.when(moved, hop).otherwise(F.array().cast("array<struct<url:string,status:int,target:string>>")).alias("redirect_chain"), F.concat(F.lit("e"), k.cast("string")).alias("etag"), none.cast("string").alias("last_modified"),
        F.lit(0).alias("retries"), F.length(body).cast("long").alias("bytes"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), body.alias("body"),
    )


ROBOTS = "User-agent: *\nDisallow: /p/7\nAllow: /p/77"


@query("g2_crawl_site", """WITH RECURSIVE s AS (SELECT CAST(page_id AS BIGINT) AS id FROM pages),
    n AS (SELECT k.id, s.id IS NOT NULL AND NOT (('/p/' || k.id) LIKE '/p/7%' AND ('/p/' || k.id) NOT LIKE '/p/77%') AS answers, CASE WHEN k.id % 9 = 8 THEN k.id - 1 ELSE k.id END AS final
      FROM (SELECT unnest(range(0, 4 * (SELECT max(id) FROM s) + 6)) AS id) k LEFT JOIN s ON s.id = k.id),
    c AS (SELECT n.*, 0 AS depth FROM n WHERE id = 0 OR (id % 50 = 3 AND id IN (SELECT id FROM s)) UNION SELECT t.*, c.depth + 1 FROM c JOIN n t ON t.id BETWEEN 4 * c.id + 1 AND 4 * c.id + 4 WHERE c.depth < 3 AND c.answers AND c.final % 11 <> 10),
    v AS (SELECT id, answers, final, min(depth) AS depth FROM c GROUP BY ALL),
    told AS (SELECT id, depth, CASE WHEN answers AND final <> id THEN 301 ELSE 0 END AS status FROM v
      UNION ALL SELECT final, depth, CASE WHEN final % 11 = 10 THEN 404 ELSE 200 END FROM v WHERE answers
      UNION ALL SELECT unnest(range(4 * id + 1, 4 * id + 5)), depth + 1, 0 FROM v WHERE answers AND final % 11 <> 10)
    SELECT '/p/' || id AS url, CAST(min(depth) AS INT) AS depth, CAST(max(status) AS INT) AS status FROM told GROUP BY id""")
def _(spark, d):
    """Pages that a crawl of four levels queues, reads or sees a link to; the tests compare all else with a plain queue."""
    return site_crawl(spark, d).pages.where(F.col("url").startswith("/p/")).select("url", "depth", "status")


@query("g2_crawl_visits")
def _(spark, d):
    """The first 120 visits of the same crawl in their order, as a limit leaves them."""
    # one window over as many rows as the crawl's limit
    turn = F.row_number().over(Window.orderBy("depth", "place"))
    return site_crawl(spark, d, limit=120).visits.select(turn.alias("turn"), "depth", "url", "blocked")


def site_crawl(spark: SparkSession, d: str, **options) -> crawling.Crawl:
    pages = table(spark, d, "pages")
    sitemap = pages.where("page_id % 50 = 3").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("loc"), F.col("page_id").alias("place"))
    chosen = crawling.Options(**({"limit": 1_000_000, "depth": 3} | options))
    return crawling.crawl(spark, f"{SITE}/p/0", crawling.from_archive(site_archive(spark, d)), chosen, ROBOTS, sitemap)


# -- the committed store --------------------------------------------------------------------------


def committed_testbed(spark: SparkSession, d: str) -> committed.CommittedStore:
    """The test tables' store as version 1 of a committed one in the shared folder."""
    st = testbed.store(spark, d)
    store = committed.CommittedStore(spark, scratch(spark, "store"))

    def fill(c: committed.Change) -> None:
        for name in committed.SCHEMAS:
            rows = getattr(st, name)
            c.put(name, rows.select(*[x for x in rows.columns if x in c.read(name).columns]))

    store.commit(fill, "the test tables")
    return store


def _totals(st, **ids: str) -> DataFrame:
    """(name, n, total): rows of each table and the sum of one of its columns."""
    parts = [getattr(st, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(k).cast("bigint").alias("total")).select("name", "n", "total") for name, k in ids.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("m4_committed_delete", testbed.for_duckdb("""WITH gone AS (SELECT id FROM site_pages WHERE nullif(first_seen, 20) IS NULL AND nullif(last_seen, 20) IS NULL)
    SELECT 'snapshots' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM snapshots WHERE id <> 20
    UNION ALL SELECT 'pages', count(*), CAST(sum(id) AS BIGINT) FROM site_pages WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'metrics', count(*), CAST(sum(page_id) AS BIGINT) FROM metrics WHERE snapshot_id <> 20 AND page_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'edges', count(*), CAST(sum(id) AS BIGINT) FROM edges e WHERE snapshot_id <> 20 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.id IN (e.source_page_id, e.target_page_id))
    UNION ALL SELECT 'plugin_rows', count(*), CAST(sum(id) AS BIGINT) FROM plugin_rows WHERE snapshot_id <> 20 AND url_id NOT IN (SELECT id FROM gone)"""))
def _(spark, d):
    store = committed_testbed(spark, d)
    committed.delete_site_snapshot(store, 1, 20)
    return _totals(store.load(), snapshots="id", pages="id", metrics="page_id", edges="id", plugin_rows="id")


@query("m1_committed_merge", testbed.for_duckdb("""WITH u AS (SELECT normalized_url AS url, CASE WHEN id % 4 = 0 THEN 410 ELSE 0 END AS status, depth + 1 AS depth FROM site_pages WHERE site_id = 1 AND id % 3 = 0
      UNION ALL SELECT '/new/' || id, 200, 9 FROM site_pages WHERE site_id = 1 AND id % 3 = 1)
    SELECT coalesce(p.normalized_url, u.url) AS url, p.id, CASE WHEN p.id IS NULL THEN 900 ELSE p.first_seen END AS first_seen, CASE WHEN u.url IS NULL THEN p.last_seen ELSE 900 END AS last_seen,
      CASE WHEN coalesce(u.status, 0) <> 0 THEN u.status ELSE p.http_status END AS http_status, CAST(least(p.depth, u.depth) AS BIGINT) AS depth
    FROM (SELECT * FROM site_pages WHERE site_id = 1) p FULL OUTER JOIN u ON u.url = p.normalized_url"""))
def _(spark, d):
    """Pages of site 1 after a merge; ids of new pages are not given."""
    store = committed_testbed(spark, d)
    mine = store.load().pages.where("site_id = 1")
    known = mine.where("id % 3 = 0").select(F.col("normalized_url").alias("url"), F.when(F.col("id") % 4 == 0, 410).otherwise(0).alias("status"), (F.col("depth") + 1).alias("depth"))
    fresh = mine.where("id % 3 = 1").select(F.concat(F.lit("/new/"), F.col("id").cast("string")).alias("url"), F.lit(200).alias("status"), F.lit(9).alias("depth"))
    store.commit(lambda c: committed.merge_pages(c, 1, 900, known.unionByName(fresh)))
    out = store.load().pages.where("site_id = 1")
    return out.select(F.col("normalized_url").alias("url"), F.when(F.col("first_seen") != 900, F.col("id")).alias("id"), "first_seen", "last_seen", "http_status", "depth")


@query("b13_replayed_batches", "SELECT event_type AS plugin, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def _(spark, d):
    """Events as four batches of a stream, two of which are sent again, one of them late."""
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("plugin"))
    store = committed.CommittedStore(spark, scratch(spark, "store"))
    write = store.append_stream("plugin_rows", "events")
    for batch in (0, 1, 1, 2, 3, 0):
        write(events.where(F.col("id") % 4 == batch), batch)
    return store.load().plugin_rows.groupBy("plugin").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


# -- events of runs -------------------------------------------------------------------------------


@query("r5_run_sessions", """WITH e AS (SELECT user_id AS run, ts, event_type AS k, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS first FROM events),
    s AS (SELECT *, sum(first) OVER (PARTITION BY run ORDER BY ts RANGE UNBOUNDED PRECEDING) AS part FROM e),
    c AS (SELECT run, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS events, count(*) FILTER (WHERE k = 'click') AS enqueued, count(*) FILTER (WHERE k = 'view') AS started, count(*) FILTER (WHERE k = 'purchase') AS succeeded, count(*) FILTER (WHERE k = 'error') AS failed, count(*) FILTER (WHERE k = 'signup') AS limits FROM s GROUP BY run, part)
    SELECT *, started - succeeded - failed AS active, least(100, CAST(floor(1e2 * (succeeded + failed) / greatest(enqueued, started, succeeded + failed, 1) + 5e-1) AS BIGINT)) AS percent FROM c""")
def _(spark, d):
    """Users are runs, and a day without an event ends a session."""
    kinds = {"enqueued": "click", "started": "view", "succeeded": "purchase", "failed": "error", "limits": "signup"}
    e = table(spark, d, "events")
    out = limiter.run_sessions(e.withColumnRenamed("user_id", "run"), kind="event_type", gap="1 day", kinds=kinds)
    return out.withColumns({c: F.col(c).cast(e.schema["ts"].dataType) for c in ("start", "end")})


@query("r5_live_counts", "SELECT user_id AS run, event_type AS type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1, 2, 3")
def _(spark, d):
    e = table(spark, d, "events")
    out = limiter.live_counts(e.select(F.col("user_id").alias("run"), F.col("event_type").alias("type"), "ts"), width="1 hour")
    return out.withColumn("start", F.col("start").cast(e.schema["ts"].dataType))


@query("x2_whole_run", SQL["g2_crawl_site"].split("told AS (")[0].rstrip().rstrip(",") + """
    SELECT '/p/' || final AS url, 10e0 * depth AS score, 1e0 AS weight FROM v WHERE answers AND final % 11 <> 10""")
def _(spark, d):
    """Rows that a plugin keeps of the pages that a whole run has parsed; another plugin fails, a third sets the depth."""
    keeps = Plugin("keeps", scores=True, hooks={"on_page_parsed": lambda ctx, parsed: parsed.select("url", (F.col("depth") * 10.0).alias("score"))})
    fails = Plugin("fails", hooks={"on_graph_built": lambda ctx, g: 1 / 0})
    policy = Plugin("policy", hooks={"on_crawl_start": lambda ctx: ctx.policy.update(depth=3)})
    store = committed.CommittedStore(spark, scratch(spark, "store"))
    pages = table(spark, d, "pages")
    sitemap = pages.where("page_id % 50 = 3").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string")).alias("loc"), F.col("page_id").alias("place"))
    runs.run_crawl(spark, store, f"{SITE}/p/0", crawling.from_archive(site_archive(spark, d)), Registry([keeps, fails, policy]), crawling.Options(limit=1_000_000, depth=1), ROBOTS, sitemap)
    st = store.load()
    return st.plugin_rows.where("plugin = 'keeps'").join(st.pages.select(F.col("id").alias("url_id"), F.col("normalized_url").alias("url")), "url_id").select("url", "score", "weight")


# -- files in their own formats -------------------------------------------------------------------


def _as_files(texts: DataFrame, label: str) -> str:
    """Each text of a one-column table as a file of its own; the folder."""
    folder = scratch(texts.sparkSession, label)
    texts.write.option("maxRecordsPerFile", 1).text(folder)
    formats.register(texts.sparkSession)
    return folder


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in groups of at most a hundred, each of which becomes a file."""
    return table(spark, d, "supplier").withColumn("part", F.floor(F.col("s_suppkey") / 100))


@query("a10_graph_format", "SELECT 's' || s_suppkey AS source, 'n' || s_nationkey AS target, s_suppkey % 10 / 1e1 AS weight FROM supplier WHERE s_suppkey % 10 >= 5")
def _(spark, d):
    """Exported graphs read as a format; the bound on the weight is pushed to the reader."""
    node, edge = F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("n"), F.col("s_nationkey"))
    nodes = F.collect_list(F.struct(node.alias("url"), F.lit(1).alias("depth"), F.lit(200).alias("status")))
    edges = F.collect_list(F.struct(node.alias("source"), edge.alias("target"), (F.col("s_suppkey") % 10 / 10).alias("weight")))
    texts = _suppliers(spark, d).groupBy("part").agg(F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges"))).alias("text")).select("text")
    return spark.read.format("graph-json").load(_as_files(texts, "graphs")).where("kind = 'edge' and weight >= 0.5").select("source", "target", "weight")


@query("a12_robots_format", "SELECT 'disallow' AS kind, '/s/' || s_suppkey AS value FROM supplier")
def _(spark, d):
    rules = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("Disallow: /s/"), F.col("s_suppkey")))), "\n")
    texts = _suppliers(spark, d).groupBy("part").agg(F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\n"), rules, F.lit("\nSitemap: http://e/s.xml")).alias("text")).select("text")
    return spark.read.format("robots").load(_as_files(texts, "robots")).where("agent = '*'").select("kind", "value")


@query("a13_sitemap_format", "SELECT 'http://e/' || s_suppkey || '?a=1&b=2' AS loc FROM supplier")
def _(spark, d):
    locs = F.array_join(F.collect_list(F.concat(F.lit("<url><loc>http://e/"), F.col("s_suppkey"), F.lit("?a=1&amp;b=2</loc></url>"))), "")
    texts = _suppliers(spark, d).groupBy("part").agg(F.concat(F.lit("<urlset>"), locs, F.lit("</urlset>")).alias("text")).select("text")
    return spark.read.format("sitemap").load(_as_files(texts, "sitemaps")).where("kind = 'url'").select("loc")


@query("a13_sitemap_expansion", f"SELECT DISTINCT {NORM} AS url FROM pages WHERE {NORM} IS NOT NULL")
def _(spark, d):
    """An index of indexes of the pages' addresses, ten a file and ten files an index, opened to the last."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("k"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    loc = lambda tag, x: F.concat(F.lit(f"<{tag}><loc>"), x, F.lit(f"</loc></{tag}>"))
    whole = lambda root, x: F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list(x), ""), F.lit(f"</{root}>")).alias("xml")
    named = lambda name, k: F.concat(F.lit(name), k.cast("string"))
    pages = p.groupBy(F.floor(F.col("k") / 10).alias("f")).agg(whole("urlset", loc("url", F.col("u"))))
    files = pages.select(named("f", F.col("f")).alias("url"), "xml")
    middle = pages.groupBy(F.floor(F.col("f") / 10).alias("g")).agg(whole("sitemapindex", loc("sitemap", named("f", F.col("f")))))
    first = middle.groupBy().agg(whole("sitemapindex", loc("sitemap", named("g", F.col("g"))))).select(F.lit("root").alias("url"), "xml")
    every = files.unionByName(middle.select(named("g", F.col("g")).alias("url"), "xml")).unionByName(first)
    return expand_sitemaps(every, ["root"], limit=1_000_000).select("url")
