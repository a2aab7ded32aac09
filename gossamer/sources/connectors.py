"""Sources at the edge: graph JSON, sitemaps, robots rules, PageSpeed reports, fetched pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gossamer.functions.url import normalize_url
from gossamer.operators.graph import SiteGraph
from gossamer.session import materialize


def read_graph_json(spark: SparkSession, path: str) -> SiteGraph:
    """nodes and edges of an exported graph; missing edges are none, a missing weight is 1."""
    schema = "nodes array<struct<url:string,depth:int,status:int>>, edges array<struct<source:string,target:string,weight:double>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select(F.col("n.url").alias("id"), "n.depth", "n.status")
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return SiteGraph(nodes, edges)


def sitemap_urls(xml: Column) -> Column:
    """loc values of a urlset or sitemapindex text; other text has none."""
    ok = xml.rlike(r"(?i)<(urlset|sitemapindex)[\s>]")
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.when(ok, locs).otherwise(F.array().cast("array<string>"))


def sitemap_parts(xml: Column) -> Column:
    """(index, locs): the files of an index, or the urls of any other sitemap; what does not look like XML has none."""
    looks = F.ltrim(F.regexp_replace(xml, r"^\s+", "")).startswith("<")
    one = r"(?is)<{tag}\b[^>]*>(?:(?!</{tag}>).)*?<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"
    locs = lambda tag: F.filter(F.transform(F.regexp_extract_all(xml, F.lit(one.replace("{tag}", tag)), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u != "")
    none = F.array().cast("array<string>")
    files = F.when(looks, locs("sitemap")).otherwise(none)
    index = F.coalesce(F.size(files) > 0, F.lit(False))
    return F.struct(index.alias("index"), F.coalesce(F.when(index, files).when(looks, locs("url")), none).alias("locs"))


def expand_sitemaps(files: DataFrame, roots: list[str], limit: int = 50) -> DataFrame:
    """(url, place) of the pages that sitemaps lead to, each once; ``files`` is (url, xml), ``roots`` names the first of them.

    An index leads to its files, level by level in the order of their names there; at most ``limit`` files are opened, first
    come, and none twice. Every file is told apart and taken to pieces once. ``place`` follows that order; urls are
    normalised, and what is no address is left out.
    """
    spark = files.sparkSession
    one = lambda df: df.groupBy("url").agg(F.first("xml").alias("xml"))
    parts = materialize(one(files.where("xml is not null")).select("url", sitemap_parts(F.col("xml")).alias("p")).select("url", "p.*"), "sitemaps")
    names = list(dict.fromkeys(roots))
    level = spark.createDataFrame([(u, 0, i) for i, u in enumerate(names)], "url string, up long, pos int")
    seen, opened = None, 0
    while True:
        # no level has more rows than the limit leaves
        fresh = level if seen is None else level.join(seen.select("url"), "url", "left_anti")
        fresh = fresh.orderBy("up", "pos").limit(limit - opened)
        now = materialize(fresh.select("url", (F.lit(opened) + F.row_number().over(Window.orderBy("up", "pos"))).cast("long").alias("place")), "sitemap-level")
        n = now.count()
        opened += n
        if n == 0:
            break
        read = now.join(parts, "url", "left")
        seen = read if seen is None else seen.unionByName(read)
        level = read.where("index").select(F.col("place").alias("up"), F.posexplode("locs").alias("pos", "url")).groupBy("url").agg(F.min(F.struct("up", "pos")).alias("m")).select("url", "m.*")
    if seen is None:
        return spark.createDataFrame([], "url string, place long")
    urls = seen.where("not index").select("place", F.posexplode("locs").alias("pos", "loc"))
    found = urls.select(normalize_url(F.col("loc")).alias("url"), F.shiftleft("place", 32).bitwiseOR(F.col("pos").cast("long")).alias("place"))
    return found.where("url is not null").groupBy("url").agg(F.min("place").alias("place"))


class Robots:
    """Rules of a robots.txt for one agent: the longest matching rule wins, allow on a tie."""

    def __init__(self, text: str, agent: str = "*"):
        groups: dict[str, list[tuple[bool, str]]] = {}
        self.sitemaps: list[str] = []
        self.delays: dict[str, float] = {}
        names: list[str] = []
        fresh = True
        for line in text.splitlines():
            k, _, v = line.split("#", 1)[0].partition(":")
            k, v = k.strip().lower(), v.strip()
            if k == "user-agent":
                names = [v.lower()] if not fresh or not names else [*names, v.lower()]
                fresh = True
                groups.setdefault(v.lower(), [])
                continue
            if k == "sitemap":
                self.sitemaps.append(v)
            elif k in ("allow", "disallow"):
                fresh = False
                for n in names:
                    if v:
                        groups[n].append((k == "allow", v))
            elif k == "crawl-delay":
                fresh = False
                for n in names:
                    try:
                        self.delays[n] = float(v)
                    except ValueError:
                        pass
        key = agent.lower() if agent.lower() in groups else "*"
        self.rules = groups.get(key, [])
        self.delay = self.delays.get(key)

    def allowed(self, path: Column) -> Column:
        """A path is allowed if no rule blocks it as it is, nor with a slash behind it."""

        def one(p: Column) -> Column:
            best = F.lit(True)
            for allow, rule in sorted(self.rules, key=lambda r: (len(r[1]), r[0])):
                pattern = "^" + re.escape(rule).replace(r"\*", ".*")
                best = F.when(p.rlike(pattern[:-2] + "$" if rule.endswith("$") else pattern), F.lit(allow)).otherwise(best)
            return best

        return one(path) & (path.endswith("/") | one(F.concat(path, F.lit("/"))))


def pagespeed_summary(report: Column) -> Column:
    """Score 0 to 100, LCP seconds, CLS, TBT milliseconds and the vitals verdict of a report."""
    get = lambda p: F.get_json_object(report, p)
    num = lambda p: get(p).try_cast("double")
    audit = lambda a: num(f"$.lighthouseResult.audits.{a}.numericValue")
    return F.struct(
        F.floor(num("$.lighthouseResult.categories.performance.score") * 100 + 0.5).alias("score"), (F.floor(audit("largest-contentful-paint") / 10 + 0.5) / 100).alias("lcp_s"),
        (F.floor(audit("cumulative-layout-shift") * 1000 + 0.5) / 1000).alias("cls"), F.floor(audit("total-blocking-time") + 0.5).alias("tbt_ms"),
        F.when(get("$.loadingExperience.overall_category") == "FAST", "PASS").otherwise("FAIL").alias("vitals"),
    )
