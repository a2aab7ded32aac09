"""Sinks: tables as CSV, JSON, Markdown and HTML, page analyses, and one-row insight reports."""

from __future__ import annotations

import html as _html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page of HTML or Markdown.
SHOWN = 2000


def export_formats(option: str | bool | None) -> list[str]:
    return ["json"] if option is True else [x.strip().lower() for x in option.split(",") if x.strip()] if option else []


def nodes_table(nodes: DataFrame) -> DataFrame:
    """URL, Depth, Status (0 is Pending/Limit), links in and out, PageRankScore."""
    return nodes.select(F.col("url").alias("URL"), F.col("depth").alias("Depth"), F.when(F.col("status") == 0, "Pending/Limit").otherwise(F.col("status").cast("string")).alias("Status"), F.col("in_links").alias("InboundLinks"), F.col("out_links").alias("OutboundLinks"), F.col("score").alias("PageRankScore"))


def edges_table(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.col("weight").alias("Weight"))


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted where needed; a quote inside is doubled."""
    df.write.option("header", "true").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def top_linked(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """The pages with most links in."""
    return nodes.orderBy(F.col("in_links").desc(), "url").limit(limit)


def top_ranked(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """The pages with the highest scores."""
    return nodes.orderBy(F.col("score").desc_nulls_last(), "url").limit(limit)


def report_authority(nodes: DataFrame) -> DataFrame:
    """Adds what the report draws: authority (the score's share of 100, else by links in) and radius."""
    most = nodes.agg(F.max("in_links").alias("_most"))
    by_links = F.when(F.col("_most") > 0, F.ln(1 + F.col("in_links")) / F.ln(1 + F.col("_most"))).otherwise(F.lit(0.0))
    out = nodes.crossJoin(F.broadcast(most)).withColumn("authority", F.coalesce(F.col("score") / 100, by_links)).drop("_most")  # one row
    return out.withColumn("radius", 5 + 15 * F.col("authority"))


#: Issues of a crawl that make its report critical.
CRITICAL = ("orphan_pages", "broken_links", "redirect_chains", "duplicate_clusters", "canonical_conflicts", "accidental_noindex", "blocked_by_robots")


def has_critical(counts: DataFrame) -> Column:
    """Is any of the critical counters that ``counts`` has above 0?"""
    return F.greatest(F.lit(0), *[F.coalesce(F.col(c), F.lit(0)) for c in CRITICAL if c in counts.columns]) > 0


def insight(metrics: DataFrame, counts: DataFrame) -> DataFrame:
    """The one-row report of a crawl: metrics and issue counts side by side, and whether it is critical."""
    return metrics.crossJoin(F.broadcast(counts)).withColumn("critical", has_critical(counts))  # one row each


def render_insight(report: dict, health: dict, top: list[tuple[str, float]]) -> str:
    """The report as lines of text."""
    lines = [f"Health {health['score']:.1f} ({health['label']})", f"Pages {report['pages']}, links {report['edges']}, depth {report['max_depth']}", ""]
    lines += [f"  {k.replace('_', ' ')}: {report[k]}" for k in report if k not in ("pages", "edges", "max_depth", "critical") and isinstance(report[k], int) and report[k]]
    return "\n".join([*lines, "", "Top authority", *[f"  {u}   {s:.3f}" for u, s in top[:10]]]) + "\n"


def crawl_markdown(url: str, metrics: dict, linked: list[tuple[str, int]], ranked: list[tuple[str, float]]) -> str:
    """The crawl's summary in Markdown: totals, most linked and highest ranked pages."""
    lines = [f"# Crawl of {url}", "", f"- Pages: {metrics['pages']}", f"- Links: {metrics['edges']}", f"- Deepest page: {metrics['max_depth']}", f"- Average depth: {metrics['avg_depth']:.2f}", f"- Efficiency: {100 * metrics['efficiency']:.1f}%", f"- Orphans: {metrics['orphans']}"]
    lines += ["", "## Most linked", "", *[f"{i}. {u} ({n})" for i, (u, n) in enumerate(linked, 1)]]
    return "\n".join([*lines, "", "## Highest ranked", "", *[f"{i}. {u} ({s:.3f})" for i, (u, s) in enumerate(ranked, 1)]]) + "\n"


def embed(data: object) -> str:
    """JSON that no markup can break out of."""
    return json.dumps(data, default=str).replace("<", "\\u003c")


def html_report(title: str, data: dict) -> str:
    """A page with its data embedded; nodes lose their html."""
    nodes = [{k: v for k, v in n.items() if k != "html"} for n in data.get("nodes", [])]
    body = embed(data | {"nodes": nodes} if "nodes" in data else data)
    return f"<!doctype html><title>{_html.escape(title)}</title><script id=data type=application/json>{body}</script>"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file of text below ``path``, through Spark's writer."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)


def write_pages(rows: DataFrame, order: list[Column], render: Callable[[list[dict]], str], path: str, size: int = SHOWN) -> None:
    """All rows in their order as texts of at most ``size`` rows each, a file a text, rendered by all tasks."""
    names = rows.columns
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    lists = placed.groupBy(F.floor(F.col("_at") / size).alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_at", F.to_json(F.struct(*names)).alias("row")))).alias("rows"))

    @F.udf("string")
    def text(found):
        # to_json leaves nulls out
        return render([dict.fromkeys(names) | json.loads(r.row) for r in found])

    lists.sortWithinPartitions("_page").select(text("rows").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def export_crawl(formats: list[str], path: str, url: str, nodes: DataFrame, edges: DataFrame, metrics: DataFrame, report: DataFrame, shown: int = SHOWN) -> list[str]:
    """Write a crawl in each format; the folders written.

    ``nodes`` has id, url, depth, status, in_links, out_links and score. Tables are written by all tasks; what is rendered by the
    driver are one-row reports and top-ten lists, and for html a page of the first ``shown`` nodes. If there are more, the folder
    report-pages has them all, as many a page.
    """
    spark, done = nodes.sparkSession, []
    put = lambda name, write: (write(f"{path}/{name}"), done.append(name))
    for f in formats:
        if f == "json":
            for name, df in (("graph-nodes.json", nodes), ("graph-edges.json", edges), ("metrics.json", metrics), ("report.json", report)):
                put(name, lambda p, df=df: write_json(df, p))
        elif f == "csv":
            put("nodes.csv", lambda p: write_csv(nodes_table(nodes), p))
            put("edges.csv", lambda p: write_csv(edges_table(edges), p))
        elif f == "markdown":
            text = crawl_markdown(url, metrics.first().asDict(), [(r["url"], r["in_links"]) for r in top_linked(nodes).collect()], [(r["url"], r["score"]) for r in top_ranked(nodes).collect() if r["score"] is not None])
            put("summary.md", lambda p: write_text(spark, text, p))
        elif f == "html":
            ranked, whole = report_authority(nodes), metrics.first().asDict()
            first = [r.asDict() for r in top_ranked(ranked, shown + 1).collect()]
            put("report.html", lambda p: write_text(spark, html_report(url, {"nodes": first[:shown], "metrics": whole}), p))
            if len(first) > shown:
                put("report-pages", lambda p: write_pages(ranked, [F.col("score").desc_nulls_last(), F.col("url")], lambda rows: html_report(url, {"nodes": rows}), p, shown))
        else:
            raise ValueError(f"unknown export format {f}")
    return done


# -- analyses of pages ------------------------------------------------------------------------------

#: Modules of an analysis and the columns that they own.
MODULES = {"seo": ("title", "title_status", "description", "description_status", "internal_links", "external_links", "schema_types"), "content": ("words", "sentences", "ratio"), "accessibility": ("images", "missing_alts")}
BLANK = {"title_status": "missing", "description_status": "missing", "words": 0, "sentences": 0, "ratio": 0.0, "internal_links": 0, "external_links": 0, "images": 0, "missing_alts": 0, "n_h1": 0}


def mask_modules(pages: DataFrame, modules: dict[str, bool]) -> DataFrame:
    """Columns of modules that are off get their empty values; first headings need seo or content."""
    gone = {c for m, cs in MODULES.items() if not modules.get(m, True) for c in cs}
    if not modules.get("seo", True) and not modules.get("content", True):
        gone.add("n_h1")
    kind = {f.name: f.dataType for f in pages.schema.fields}
    return pages.select(*[F.lit(BLANK.get(c)).cast(kind[c]).alias(c) if c in gone else F.col(c) for c in pages.columns])


def drop_modules(pages: DataFrame, modules: dict[str, bool]) -> DataFrame:
    """As exported: columns of modules that are off are left out, ratios have three digits."""
    gone = {c for m, cs in MODULES.items() if not modules.get(m, True) for c in cs}
    if not modules.get("seo", True) and not modules.get("content", True):
        gone.add("n_h1")
    short = lambda c: (F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) if c in ("ratio", "external_ratio") else F.col(c)
    return pages.select(*[short(c) for c in pages.columns if c not in gone])


#: Column titles of the analysis table, in order.
ANALYSIS_TITLES = ("URL", "SEO Score", "Thin Score", "HTTP Status", "Title", "Title Length", "Meta Description", "Desc Length", "Word Count", "Internal Links", "External Links", "Canonical")


def analysis_table(pages: DataFrame) -> DataFrame:
    """The twelve columns of an analysis; status 0 is Pending/Limit, missing texts are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    status = F.when(F.col("status") == 0, "Pending/Limit").otherwise(F.col("status").cast("string"))
    values = [F.col("url"), F.col("seo"), F.col("thin"), status, text("title"), F.length(text("title")), text("description"), F.length(text("description")), F.col("words"), F.col("internal_links"), F.col("external_links"), text("canonical")]
    return pages.select(*[v.alias(t) for v, t in zip(values, ANALYSIS_TITLES)])


def analysis_lines(pages: DataFrame) -> DataFrame:
    """The same as lines of CSV, where only titles and descriptions are quoted."""
    t = analysis_table(pages)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return t.select(F.concat_ws(",", *[quoted(c) if c in ("Title", "Meta Description") else F.col(c).cast("string") for c in t.columns]).alias("line"))


def analysis_markdown(summary: dict, rows: list[dict]) -> str:
    head = ["# Page analysis", "", f"- Pages: {summary['pages']}", f"- Mean page score: {summary['seo']:.1f}", f"- Thin pages: {summary['thin']}", f"- Duplicate titles: {summary['same_titles']}", "", "| URL | SEO Score | Thin Score | Title | Description | Canonical |", "| :--- | :--- | :--- | :--- | :--- | :--- |"]
    return "\n".join(head + [f"| {r['url']} | {r['seo']} | {r['thin']} | {r['title_status']} | {r['description_status']} | {r['canonical'] or '-'} |" for r in rows]) + "\n"


def analysis_html(summary: dict, rows: list[dict]) -> str:
    cell = lambda v: f"<td>{_html.escape(str(v), quote=False)}</td>"
    body = "".join("<tr>" + "".join(cell(r[c]) for c in ("url", "seo", "thin", "title_status", "description_status")) + "</tr>" for r in rows)
    return f"<!doctype html><title>Page analysis</title><p>{summary['pages']} pages, mean score {summary['seo']:.1f}</p><table>{body}</table>"


def export_analysis(formats: list[str], path: str, pages: DataFrame, modules: dict[str, bool] | None = None, shown: int = SHOWN) -> list[str]:
    """Write an analysis in each format; Markdown and HTML list the first ``shown`` pages by url; if there are more, the
    folders analysis-md-pages and analysis-html-pages list them all, as many a text."""
    spark, done = pages.sparkSession, []
    summary = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.avg("seo"), F.lit(0.0)).alias("seo"), F.count_if(F.col("thin") >= 70).alias("thin"), F.count_if(F.col("title_status") == "duplicate").alias("same_titles")).first().asDict()
    first = lambda: [r.asDict() for r in pages.orderBy("url").limit(shown).collect()]
    listed = pages.select("url", "seo", "thin", "title_status", "description_status", "canonical")
    for f in formats:
        if f == "json":
            write_json(drop_modules(pages, modules or {}), f"{path}/analysis.json")
        elif f == "csv":
            write_csv(analysis_table(pages), f"{path}/analysis.csv")
        elif f == "markdown":
            write_text(spark, analysis_markdown(summary, first()), f"{path}/analysis.md")
            if summary["pages"] > shown:
                write_pages(listed, [F.col("url")], lambda rows: analysis_markdown(summary, rows), f"{path}/analysis-md-pages", shown)
        elif f == "html":
            write_text(spark, analysis_html(summary, first()), f"{path}/analysis.html")
            if summary["pages"] > shown:
                write_pages(listed, [F.col("url")], lambda rows: analysis_html(summary, rows), f"{path}/analysis-html-pages", shown)
        else:
            raise ValueError(f"unknown export format {f}")
        done.append(f)
    return done


def append_batches(stream: DataFrame, path: str, checkpoint: str, query: str = "crawl"):
    """Append a stream's batches to a table: the buffered writer of a crawl that is running.

    A batch is a partition of its own (query, batch), which a batch that is sent again takes the place of.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
