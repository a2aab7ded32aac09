"""Plugins: declared tables, hooks over pages and graphs, and weighted scores."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = {"id", "snapshot_id", "url_id", "score", "weight", "created_at"}
KINDS = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType()}
#: The points of a run at which plugins are called: of a page alone, of a crawl alone, of both.
PAGE_ONLY, CRAWL_ONLY, ANY = {"on_page"}, {"on_crawl_start", "on_page_parsed", "on_graph_built", "on_metrics", "on_report", "should_enqueue"}, {"on_init", "on_discovery"}


@dataclass
class Plugin:
    """on_page maps pages to rows; on_metrics maps a graph to rows; should_enqueue is a predicate."""

    name: str
    columns: dict[str, str] = field(default_factory=dict)
    scores: bool = False
    hooks: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        unknown = set(self.hooks) - PAGE_ONLY - CRAWL_ONLY - ANY
        if unknown:
            raise ValueError(f"unknown hooks: {sorted(unknown)}")

    def schema(self) -> T.StructType:
        bad = RESERVED & set(self.columns)
        if bad:
            raise ValueError(f"reserved column names: {sorted(bad)}")
        fixed = [T.StructField("id", T.LongType()), T.StructField("snapshot_id", T.LongType()), T.StructField("url_id", T.LongType())]
        return T.StructType([*fixed, *[T.StructField(k, KINDS[v]) for k, v in self.columns.items()], T.StructField("score", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("created_at", T.TimestampType())])


class Registry:
    def __init__(self, plugins: list[Plugin] | None = None):
        self.plugins: dict[str, Plugin] = {}
        for p in plugins or []:
            self.add(p)

    def add(self, p: Plugin) -> None:
        if p.name in self.plugins:
            raise ValueError(f"a plugin is named {p.name} already")
        p.schema()
        self.plugins[p.name] = p

    def discover(self, group: str = "gossamer.plugins") -> None:
        for e in entry_points(group=group):
            self.add(e.load())

    def run(self, hook: str, scope: str, *args) -> dict[str, object]:
        """Results of a hook by plugin; a failing plugin is logged and left out."""
        if hook in (CRAWL_ONLY if scope == "page" else PAGE_ONLY):
            return {}
        out = {}
        for p in self.plugins.values():
            if hook in p.hooks:
                try:
                    out[p.name] = p.hooks[hook](*args)
                except Exception:
                    logging.getLogger(__name__).exception("plugin %s failed in %s", p.name, hook)
        return out

    def should_enqueue(self, url: Column, depth: Column) -> Column:
        """The first plugin with an opinion decides."""
        votes = [p.hooks["should_enqueue"](url, depth) for p in self.plugins.values() if "should_enqueue" in p.hooks]
        return F.coalesce(*votes, F.lit(True))


class Namespace:
    """A plugin's own tables below a folder: rows of its declared columns, and reports.

    It writes as its plugin alone, for one snapshot, and reads nobody else's rows.
    """

    def __init__(self, spark: SparkSession, path: str, plugin: Plugin, snapshot_id: int):
        self.spark, self.plugin, self.snapshot_id = spark, plugin, snapshot_id
        if not re.fullmatch(r"[A-Za-z0-9_-]+", plugin.name):
            raise ValueError(f"no name for a table: {plugin.name}")
        self.path = f"{path}/{plugin.name.replace('-', '_')}_plugin"

    def append(self, rows: DataFrame) -> None:
        """Rows of the plugin (url_id, its columns, score, weight); ids go on from the largest."""
        schema = self.plugin.schema()
        foreign = set(rows.columns) - {f.name for f in schema.fields}
        if foreign:
            raise ValueError(f"columns that {self.plugin.name} has not declared: {sorted(foreign)}")
        if "snapshot_id" in rows.columns and not rows.where(~F.col("snapshot_id").eqNullSafe(F.lit(self.snapshot_id))).isEmpty():
            raise ValueError("rows of another snapshot")
        last = self.rows().agg(F.max("id")).first()[0] or 0
        # ids need not be dense: they rise with the row's place
        fixed = {"id": F.lit(last + 1) + F.monotonically_increasing_id(), "snapshot_id": F.lit(self.snapshot_id), "created_at": F.current_timestamp()}
        value = lambda f: fixed.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(1.0 if f.name == "weight" else None))
        rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        """All rows of the plugin, an empty table before the first."""
        try:
            return self.spark.read.schema(self.plugin.schema()).parquet(f"{self.path}/rows")
        except AnalysisException:
            return self.spark.createDataFrame([], self.plugin.schema())

    def report(self, report: DataFrame) -> None:
        """Append a report (one JSON a row) of the snapshot."""
        text = F.to_json(F.struct(*report.columns))
        report.select(F.lit(self.snapshot_id).alias("snapshot_id"), F.lit(self.plugin.name).alias("plugin"), text.alias("report")).write.mode("append").parquet(f"{self.path}/reports")

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/reports")


def roll_up(rows: DataFrame, *keys: str) -> DataFrame:
    """Weighted score sums of rows that have a score."""
    return rows.where(F.col("score").isNotNull()).groupBy(*keys).agg(F.sum(F.col("score") * F.col("weight")).alias("weighted"), F.sum("weight").alias("weights"), F.count("score").alias("n"))


def blend(core: Column, weighted: Column, weights: Column) -> Column:
    """Core score with weight 100 and plugin scores with theirs, one digit."""
    return F.floor((core * 100 + F.coalesce(weighted, F.lit(0.0))) / (100 + F.coalesce(weights, F.lit(0.0))) * 10 + 0.5) / 10


def signals_plugin() -> Plugin:
    from gossamer.functions.html import signals
    from gossamer.operators.scoring import signals_page_score

    def on_page(pages: DataFrame) -> DataFrame:
        s = pages.select(F.col("page_id").alias("url_id"), signals(F.col("html")).alias("s"))
        return s.select("url_id", "s.*", signals_page_score(F.col("s.jsonld") > 0, F.col("s.og_title").isNotNull(), F.col("s.lang").isNotNull(), F.col("s.hreflang") > 0, F.lit(False)).alias("score"))

    return Plugin("signals", {"lang": "TEXT", "jsonld": "INTEGER"}, True, {"on_page": on_page})


def pagespeed_plugin(fetch: Callable[[str], str]) -> Plugin:
    """Scores of a PageSpeed service: ``fetch`` gives the report of a url."""
    from gossamer.sources.connectors import pagespeed_summary

    def on_page(pages: DataFrame) -> DataFrame:
        report = F.pandas_udf(lambda u: u.map(fetch), "string")
        s = pages.select(F.col("page_id").alias("url_id"), pagespeed_summary(report("url")).alias("s"))
        return s.select("url_id", "s.lcp_s", "s.cls", "s.tbt_ms", "s.vitals", F.col("s.score").cast("double").alias("score"))

    return Plugin("pagespeed", {"lcp_s": "REAL", "cls": "REAL", "tbt_ms": "REAL", "vitals": "TEXT"}, True, {"on_page": on_page})


def exporter_plugin(formats: str | bool | None, path: str) -> Plugin:
    """Writes the crawl in the chosen formats when its report is done."""
    from gossamer.sources.exports import export_crawl, export_formats

    return Plugin("exporter", hooks={"on_report": lambda url, nodes, edges, metrics, report: export_crawl(export_formats(formats), path, url, nodes, edges, metrics, report)})


def reporter_plugin() -> Plugin:
    """The crawl's insight row and its text."""
    from gossamer.sources.exports import insight

    return Plugin("reporter", hooks={"on_report": lambda url, nodes, edges, metrics, report: insight(metrics, report)})
