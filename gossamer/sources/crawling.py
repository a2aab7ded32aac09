"""A crawl as a loop over levels: frontier, robots, fetch, parse, enqueue, in the order of one queue.

A queue that is read from the front and written at the back is read level by level, so a level is one
table and the place in it is the order. Each level leaves two tables below the crawl's folder: what was
queued, and what came of it. A crawl that is run again with the same folder goes on from the last whole table,
and fetches nothing again that is there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import html as H
from gossamer.functions import html_udf
from gossamer.functions import url as U
from gossamer.operators.mutations import fold_pages
from gossamer.operators.scoring import thin_content
from gossamer.plugins import Registry
from gossamer.session import bounded_batches, scratch
from gossamer.sources.connectors import Robots
from gossamer.sources.fetching import FETCHED, parsed_as_html

#: Limits of a crawl that nobody has set, and the depth that nobody can set more than.
PAGES, DEPTH, MOST_DEPTH = 500, 5, 10

Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    limit: int = PAGES
    depth: int = DEPTH
    ignore_robots: bool = False
    strip_query: bool = False
    allowed: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()
    subdomains: bool = False
    registry: Registry = field(default_factory=Registry)


@dataclass(frozen=True)
class Crawl:
    """pages by url (path of the site, address elsewhere), edges, metrics of pages, visits in their order, and what was
    parsed (url, depth, status, parsed)."""

    pages: DataFrame
    edges: DataFrame
    metrics: DataFrame
    visits: DataFrame
    crawled: int
    limit_reached: bool
    folder: str
    parsed: DataFrame | None = None


def from_archive(responses: DataFrame) -> Fetch:
    """Fetching from a table of recorded responses (rows of ``FETCHED``, one a url): one join a level.

    A url that the table has not is a network error; a matching etag is answered with 304.
    """
    names = [x.split(" ")[0] for x in FETCHED.replace("array<struct<url:string,status:int,target:string>>", "x").replace("map<string,string>", "x").split(", ")]

    def fetch(urls: DataFrame) -> DataFrame:
        asked = urls.select("url", F.col("etag").alias("_asked"))
        same = F.coalesce(F.col("etag") == F.col("_asked"), F.lit(False))
        got = asked.join(responses.select(*names), "url", "left")
        given = {
            "status": F.when(same, F.lit(304)).otherwise(F.col("status")), "body": F.when(~same, F.col("body")), "final_url": F.coalesce("final_url", "url"),
            "state": F.when(F.col("status").isNull(), F.coalesce("state", F.lit("network_error"))),
        }
        return got.select(*[given.get(n, F.col(n)).alias(n) for n in names])

    return fetch


def _whole(spark: SparkSession, path: str) -> bool:
    """Has a table been written to the end?"""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def crawl(spark: SparkSession, start: str, fetch: Fetch, options: Options = Options(), robots: str | None = None, sitemap: DataFrame | None = None, previous: tuple[DataFrame, DataFrame] | None = None, folder: str | None = None) -> Crawl:
    """Pages reachable from ``start`` (an address) over links within its site.

    ``fetch`` maps (url, etag, last_modified) to rows of ``FETCHED``; it is asked once for every url, and again only
    for urls of a task or level that was lost. The queue
    starts with ``start`` and then the urls of ``sitemap`` (loc, and place for their order), all of depth 0. A page that
    ``robots`` (a robots.txt) blocks is not fetched but counts towards the limit; with ``ignore_robots`` it is fetched
    and marked. Links of a page are queued in their order, each url once, if they are of the site, in scope,
    no deeper than allowed, and no plugin objects. ``previous`` is (pages, links) of an earlier crawl: pages with url, etag, last_modified
    and attributes, links (src, dst); a page that answers 304 keeps its attributes and links. ``folder`` is where the levels
    are kept, below the shared folder; the same folder takes up a crawl that was stopped.
    """
    bounded_batches(spark)
    first = U.normalize_one(start, strip_query=options.strip_query)
    if first is None:
        raise ValueError(f"no address to start from: {start}")
    site = spark.range(1).select(U.origin(F.lit(first))).first()[0]
    root = site.split("://", 1)[1].split(":")[0]
    deepest = min(options.depth, MOST_DEPTH)
    rules = Robots(robots) if robots else None
    folder = folder or scratch(spark, "crawl")

    def stored(u: Column) -> Column:
        return U.to_path(u, F.lit(site))

    def in_scope(u: Column) -> Column:
        return U.scope(u, F.lit(root), list(options.allowed) or None, list(options.denied) or None, options.subdomains) == "allowed"

    def write_queue(rows: DataFrame, level: int) -> None:
        """``rows`` is (url, at) with each url once; the place follows the order of ``at``."""
        ordered = rows.orderBy("at").select(F.monotonically_increasing_id().alias("place"), "url", F.lit(level).alias("depth"))
        ordered.write.mode("overwrite").parquet(f"{folder}/queue-{level}")

    def seeds() -> DataFrame:
        one = spark.range(1).select(stored(F.lit(first)).alias("url"), F.lit(-1).cast("long").alias("at"))
        if sitemap is not None:
            u = U.normalize_url_udf(F.col("loc"), F.lit(site), options.strip_query)
            one = one.unionByName(sitemap.select(stored(u).alias("url"), F.col("place").cast("long").alias("at")).where("url is not null"))
        return one.where(in_scope(F.col("url"))).groupBy("url").agg(F.min("at").alias("at"))

    def visit(todo: DataFrame) -> DataFrame:
        absolute = U.to_absolute(F.col("url"), F.lit(site))
        blocked = ~rules.allowed(F.regexp_extract(absolute, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)) if rules else F.lit(False)
        todo = todo.withColumn("blocked", blocked).withColumn("asked", absolute)
        tags = ("etag", "last_modified")
        if previous is not None:
            todo = todo.join(previous[0].select("url", *tags), "url", "left")
        else:
            todo = todo.withColumns({c: F.lit(None).cast("string") for c in tags})
        ask = todo if options.ignore_robots else todo.where("not blocked")
        got = fetch(ask.select(F.col("asked").alias("url"), *tags)).withColumnRenamed("url", "asked")
        html = F.when((F.col("status") == 200) & parsed_as_html(F.col("headers")), F.col("body"))
        full = U.normalize_url_udf(F.col("final_url"), F.lit(site), options.strip_query)
        got = got.withColumn("final", full).withColumn("html", html)
        text = H.content(F.col("html"))
        got = got.withColumn("parsed", F.when(F.col("html").isNotNull(), html_udf.parse_html(F.coalesce("html", F.lit("")), F.col("final"))))
        got = got.select("asked", "status", "state", stored(F.col("final")).alias("final"), "redirect_chain", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), "retries", "bytes", "parsed", text.words.alias("words"), thin_content(text.words.cast("double"), text.ratio, F.lit(0.0)).alias("thin"))
        return todo.drop(*tags).join(got, "asked", "left").drop("asked")

    def links_of(done: DataFrame) -> DataFrame:
        """(place, depth, src, pos, dst, internal): what the pages of a level link to, without themselves."""
        u = F.col("l.url")
        u = U.normalize_url(u, True) if options.strip_query else u
        out = done.where("parsed is not null and final is not null").select("place", "depth", F.col("final").alias("src"), F.posexplode("parsed.links").alias("pos", "l")).select("place", "depth", "src", "pos", stored(u).alias("dst"), U.is_internal(u, F.lit(site)).alias("internal"))
        if previous is not None:
            same = done.where("status = 304").select("place", "depth", F.col("url").alias("src"))
            # a link of the earlier crawl may be of a form that is normalised now
            old = previous[1].select("src", stored(U.normalize_url_udf(F.col("dst"), F.lit(site), options.strip_query)).alias("dst")).where("dst is not null").distinct()
            old = old.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("l"))
            again = same.join(old, "src").select("place", "depth", "src", F.posexplode("l").alias("pos", "dst")).withColumn("internal", F.lit(True))
            out = out.unionByName(again)
        return out.where("dst <> src")

    crawled, reached, levels = 0, False, 0
    for level in range(deepest + 1):
        queue, visited = f"{folder}/queue-{level}", f"{folder}/visited-{level}"
        if not _whole(spark, queue):
            if level == 0:
                write_queue(seeds(), 0)
            else:
                found = links_of(spark.read.parquet(f"{folder}/visited-{level - 1}")).where("internal").groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("place", "pos")).alias("at"))
                known = spark.read.parquet(*[f"{folder}/queue-{k}" for k in range(level)]).select("url")
                fresh = found.join(known, "url", "left_anti").where(in_scope(F.col("url")) & options.registry.should_enqueue(F.col("url"), F.lit(level)))
                write_queue(fresh, level)
        todo = spark.read.parquet(queue)
        n, left = todo.count(), options.limit - crawled
        if n == 0:
            break
        if left <= 0:
            reached = True
            break
        if n > left:
            reached = True
            todo = todo.orderBy("place").limit(left)
        if not _whole(spark, visited):
            visit(todo).write.mode("overwrite").parquet(visited)
        crawled, levels = crawled + min(n, left), level + 1
        if reached:
            break
    queued = spark.read.parquet(*[f"{folder}/queue-{k}" for k in range(max(levels, 1)) if _whole(spark, f"{folder}/queue-{k}")])
    if not levels:
        raise ValueError("nothing is in scope")
    done = spark.read.parquet(*[f"{folder}/visited-{k}" for k in range(levels)])
    links = links_of(done)
    hops = _hops(done, site, options.strip_query)
    return Crawl(_pages(queued, done, links, hops, site, previous), _edges(links, hops), _metrics(done, previous), done.select("depth", "place", "url", "blocked"), crawled, reached, folder, done.where("parsed is not null").select(F.coalesce("final", "url").alias("url"), "depth", "status", "parsed"))


def _hops(done: DataFrame, site: str, strip_query: bool = False) -> DataFrame:
    """(place, depth, src, dst, status, and whether both are of the site) of every redirect that was followed."""
    hop = done.where("status is null or status <> 304").select("place", "depth", F.posexplode("redirect_chain").alias("hop", "r"))
    full = lambda c: U.normalize_url_udf(F.col(c), F.lit(site), strip_query)
    hop = hop.select("place", "depth", "hop", "r.status", full("r.url").alias("a"), full("r.target").alias("b")).where("a is not null and b is not null")
    inside = lambda c: U.is_internal(F.col(c), F.lit(site))
    path = lambda c: U.to_path(F.col(c), F.lit(site))
    return hop.select("place", "depth", "hop", "status", path("a").alias("src"), path("b").alias("dst"), inside("a").alias("src_in"), inside("b").alias("dst_in"))


def _edges(links: DataFrame, hops: DataFrame) -> DataFrame:
    """(src, dst, weight, rel) of links and redirects."""
    rel = lambda c: F.when(F.col(c), "internal").otherwise("external").alias("rel")
    return links.select("src", "dst", F.lit(1.0).alias("weight"), rel("internal")).unionByName(hops.select("src", "dst", F.lit(1.0).alias("weight"), rel("dst_in")))


def _outcome(status: str = "status", state: str = "state") -> tuple[Column, Column]:
    """(is it an error, is it a page) of a visit."""
    error = F.col(state).isNotNull() | (F.col(status) >= 300) & (F.col(status) != 304)
    return F.coalesce(error, F.lit(False)), F.col("parsed").isNotNull()


def _metrics(done: DataFrame, previous: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """(url, crawl_status, word_count, thin_content_score, external_link_ratio) of visited pages; of a url that was
    visited under several names, the last."""
    error, page = _outcome()
    p = F.col("parsed")
    ratio = F.try_divide(p.external_links, p.internal_links + p.external_links)
    kept = F.when(F.col("blocked") & F.col("status").isNull() & F.col("state").isNull(), F.lit("blocked_by_robots")).when(F.col("status") == 304, "cached").when(error, F.coalesce("state", F.lit("fetched_error"))).when(page & F.col("blocked"), "blocked_by_robots").when(page, "fetched")
    rows = done.select(F.coalesce("final", "url").alias("url"), kept.alias("crawl_status"), F.when(page, F.col("words")).cast("long").alias("word_count"), F.when(page, F.col("thin")).alias("thin_content_score"), F.when(page, F.coalesce(ratio, F.lit(0.0))).alias("external_link_ratio"), F.struct("depth", "place").alias("at")).where("crawl_status is not null")
    if previous is not None:
        names = [c for c in ("word_count", "thin_content_score", "external_link_ratio") if c in previous[0].columns]
        old = previous[0].select("url", *[F.col(c).alias(f"_{c}") for c in names])
        rows = rows.join(old, "url", "left").withColumns({c: F.when(F.col("crawl_status") == "cached", F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).drop(*[f"_{c}" for c in names])
    return rows.groupBy("url").agg(F.max_by(F.struct("crawl_status", "word_count", "thin_content_score", "external_link_ratio"), "at").alias("m")).select("url", "m.*")


#: What a page keeps of its last visit.
KEPT = {"canonical": "string", "nofollow": "int", "content_hash": "string", "simhash": "bigint", "etag": "string", "last_modified": "string", "bytes": "bigint", "security_error": "string"}


def _pages(queued: DataFrame, done: DataFrame, links: DataFrame, hops: DataFrame, site: str, previous: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """All pages that were queued, visited or linked to, folded from what each step tells about them."""
    c = F.col
    error, page = _outcome()

    def told(df: DataFrame, step: int, url: Column, depth: Column, status: Column | int = 0, **more: Column) -> DataFrame:
        every = {"noindex": "int", "retries": "int", "is_internal": "int"} | KEPT
        at = F.struct(c("depth").alias("level"), "place", F.lit(step).alias("step"), more.pop("nth", F.lit(0)).alias("nth"))
        known = F.lit(status) if isinstance(status, int) else status
        return df.select(url.alias("url"), depth.alias("depth"), F.coalesce(known.cast("int"), F.lit(0)).alias("status"), at.alias("at"), *[more.get(k, F.lit(None)).cast(t).alias(k) for k, t in every.items()])

    p = c("parsed")
    final = F.coalesce("final", "url")
    steps = [
        told(queued, 0, c("url"), c("depth")),
        told(hops, 1, c("src"), c("depth"), c("status"), is_internal=c("src_in"), nth=c("hop")),
        told(hops, 2, c("dst"), c("depth"), is_internal=c("dst_in"), nth=c("hop")),
        told(done.where(error), 3, final, c("depth"), c("status"), security_error=c("state"), retries=c("retries")),
        told(done.where((c("status") == 200) & ~page), 3, final, c("depth"), c("status")),
        told(done.where(page), 3, final, c("depth"), c("status"), noindex=p.noindex, nofollow=p.nofollow, canonical=p.canonical, content_hash=p.content_hash, simhash=p.simhash, etag=c("new_etag"), last_modified=c("new_modified"), retries=c("retries"), bytes=c("bytes")),
        told(links, 4, c("dst"), c("depth") + 1, is_internal=c("internal"), nth=c("pos")),
    ]
    if previous is not None:
        old = previous[0]
        had = {k: c(f"_{k}") for k in ("noindex", *KEPT) if k in old.columns}
        same = done.where("status = 304").select("place", "depth", final.alias("final"), "url").join(old.select("url", *[c(k).alias(f"_{k}") for k in ("status", *had) if k in old.columns]), "url")
        steps.append(told(same, 3, c("final"), c("depth"), c("_status") if "status" in old.columns else 200, **had))
    rows = steps[0]
    for s in steps[1:]:
        rows = rows.unionByName(s)
    # the fold wants a snapshot's names; a crawl is one snapshot
    out = fold_pages(rows.withColumns({"first_seen": F.lit(0), "last_seen": F.lit(0)}), "url", "at").drop("first_seen", "last_seen")
    return out.withColumn("is_internal", F.coalesce("is_internal", U.is_internal(c("url"), F.lit(site)).cast("int")))
