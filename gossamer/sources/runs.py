"""A whole run: plugins are set up, a site is crawled, saved, measured, scored and reported.

Plugins are called in one order: on_init, on_crawl_start, (should_enqueue, as the crawl's predicate), on_page_parsed,
on_graph_built, on_metrics, on_report. A plugin that fails is noted and left out of that call; the run goes on.
"""

from __future__ import annotations

import dataclasses
import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions import url as U
from gossamer.operators import graph as G
from gossamer.operators import ranking as R
from gossamer.operators import scoring as C
from gossamer.operators import store as O
from gossamer.plugins import CRAWL_ONLY, PAGE_ONLY, Registry
from gossamer.sources import committed, crawling
from gossamer.sources.exports import insight

#: What a plugin may set of a crawl before it starts.
POLICY = ("limit", "depth", "ignore_robots", "allowed", "denied", "subdomains", "strip_query")


@dataclass
class Context:
    """What plugins are called with. ``terminate`` ends the run before the crawl; ``policy`` changes the crawl's options."""

    url: str
    scope: str
    command: str = "crawl"
    snapshot_id: int | None = None
    terminate: bool = False
    policy: dict = field(default_factory=dict)
    failures: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Run:
    snapshot_id: int
    crawl: crawling.Crawl | None
    nodes: DataFrame | None
    edges: DataFrame | None
    metrics: DataFrame | None
    report: DataFrame | None
    failures: list[tuple[str, str, str]]


def call(registry: Registry, hook: str, context: Context, *args) -> dict[str, object]:
    """Results of a hook by plugin. Hooks of the other scope are passed over; what fails is noted in the context."""
    if hook in (CRAWL_ONLY if context.scope == "page" else PAGE_ONLY):
        return {}
    out = {}
    for p in registry.plugins.values():
        if hook in p.hooks:
            try:
                out[p.name] = p.hooks[hook](*args)
            except Exception as e:
                logging.getLogger(__name__).exception("plugin %s failed in %s", p.name, hook)
                context.failures.append((p.name, hook, str(e)))
    return out


def keep_rows(store: committed.CommittedStore, registry: Registry, context: Context, hook: str, results: dict[str, object]) -> None:
    """Rows (url_id, score, weight, or url for the page) that plugins have returned, as one commit for each plugin.

    A plugin's rows are worked out here, so this is where one that fails late shows.
    """
    for name, rows in results.items():
        if not isinstance(rows, DataFrame):
            continue
        try:
            if "url_id" not in rows.columns:
                pages = store.load().pages.select(F.col("normalized_url").alias("url"), F.col("id").alias("url_id"), "site_id")
                site = store.load().snapshots.where(F.col("id") == context.snapshot_id).select("site_id")
                rows = rows.join(pages.join(F.broadcast(site), "site_id"), "url")
            value = lambda c, d: F.col(c) if c in rows.columns else F.lit(d)

            def add(c: committed.Change, rows=rows, name=name, value=value) -> None:
                first = committed.next_id(c.read("plugin_rows"))
                c.append("plugin_rows", rows.select((F.lit(first) + F.monotonically_increasing_id()).alias("id"), F.lit(context.snapshot_id).alias("snapshot_id"), "url_id", F.lit(name).alias("plugin"), value("score", None).cast("double").alias("score"), value("weight", 1.0).cast("double").alias("weight"), F.lit(0).alias("age_seconds")), context.snapshot_id)

            store.commit(add, f"rows of {name}", retries=3)
        except Exception as e:
            logging.getLogger(__name__).exception("rows of plugin %s failed after %s", name, hook)
            context.failures.append((name, hook, str(e)))


def measure(store: committed.CommittedStore, snapshot: int, parsed: DataFrame | None = None, origin: str = "") -> tuple[G.SiteGraph, DataFrame, DataFrame]:
    """PageRank, HITS, links and health of a snapshot's pages, committed to its metrics and its row.

    Returns the graph (nodes with their scores), one row of graph metrics and one row of issue counts.
    """
    st = store.load()
    c = F.col
    pages = st.pages.join(O.snapshot_metrics(st, snapshot).select(c("page_id").alias("id"), "crawl_status", "word_count", "external_link_ratio"), "id")
    nodes = pages.select("id", c("normalized_url").alias("url"), c("depth").cast("int").alias("depth"), c("http_status").alias("status"), "noindex", "canonical_url", "redirect_chain", "is_internal", "crawl_status", "word_count", "external_link_ratio")
    edges = O.snapshot_edges(st, snapshot).where("rel = 'internal'").select(c("source_page_id").alias("src"), c("target_page_id").alias("dst"), "weight")
    g = G.build_graph(nodes, edges)
    deg = G.degrees(g)
    none = F.lit(None)
    same = lambda x: U.to_path(x, F.lit(origin))
    ranks = R.pagerank(nodes.where(R.rank_eligible(c("noindex") == 1, none.cast("boolean"), none.cast("double"), same(c("canonical_url")), c("url"), c("status"))), g.edges)
    roles = R.hits(nodes.where(R.hits_eligible(c("status"), c("redirect_chain").isNotNull(), c("noindex") == 1)), g.edges)
    traps = U.trap_flags(nodes.where("is_internal = 1 and status in (0, 200)").select("id", U.to_absolute(c("url"), F.lit(origin)).alias("u")), "u", "id").select("id", (c("trap_risk") > 0.4).alias("trap"))
    facts = deg.join(ranks.select("id", c("score").alias("pagerank_score")), "id", "left").join(roles, "id", "left").join(traps, "id", "left")
    heads = parsed.groupBy("url").agg(F.max_by(F.struct(F.size("parsed.h1s").alias("n_h1"), (c("parsed.missing_alts") + c("parsed.blank_alts")).alias("missing_alts")), "depth").alias("p")).select("url", "p.*") if parsed is not None else None
    facts = facts.join(heads, "url", "left") if heads is not None else facts.withColumns({"n_h1": none.cast("int"), "missing_alts": none.cast("int")})
    scored = committed_facts(store, snapshot, facts)
    counts = C.issue_counts(scored.select((c("is_internal") == 1).alias("internal"), "status", "crawl_status", "trap", F.lit(0).alias("redirects"), same(c("canonical_url")).alias("canonical"), "url", (c("noindex") == 1).alias("noindex"), "in_links", "out_links", "depth", "n_h1", c("word_count").alias("words"), c("external_link_ratio").alias("external_ratio"), "missing_alts", F.lit(0).alias("broken_links")))
    whole = G.graph_metrics(deg)
    names = [x for x in C.HEALTH_WEIGHTS if x in counts.columns]
    # one row each
    health = counts.crossJoin(F.broadcast(whole.select(c("pages").alias("_pages"), c("orphans").alias("_orphans")))).select(C.health(c("_pages"), {x: c(x) for x in names}).score.alias("s"), "_orphans").first()
    store.commit(lambda ch: committed.update_snapshot(ch, snapshot, health_score=F.lit(health[0]), orphan_count=F.lit(health[1])), f"health of {snapshot}", retries=3)
    return G.SiteGraph(scored, g.edges), whole, counts


def committed_facts(store: committed.CommittedStore, snapshot: int, facts: DataFrame) -> DataFrame:
    """Scores of pages as a commit to the snapshot's metrics; all of a page's other metrics stay."""
    from gossamer.session import materialize

    facts = materialize(facts, "scored")
    new = {"pagerank_score": F.col("f.pagerank_score"), "auth_score": F.col("f.auth"), "hub_score": F.col("f.hub"), "link_role": F.col("f.role")}

    def change(ch: committed.Change) -> None:
        old = ch.read("metrics", snapshot).where(F.col("snapshot_id") == snapshot)
        joined = old.alias("m").join(facts.alias("f"), F.col("m.page_id") == F.col("f.id"), "left")
        ch.put("metrics", joined.select(*[new.get(n, F.col(f"m.{n}")).alias(n) for n in old.columns]), snapshot)

    store.commit(change, f"scores of {snapshot}", retries=3)
    return facts


def run_crawl(spark: SparkSession, store: committed.CommittedStore, url: str, fetch: crawling.Fetch, registry: Registry | None = None, options: crawling.Options = crawling.Options(), robots: str | None = None, sitemap: DataFrame | None = None, created_at: Column | None = None, command: str = "crawl") -> Run:
    """Crawl a site and save, measure, score and report it, with its plugins called on the way.

    on_init and on_crawl_start take the context, on_page_parsed the context and what was parsed (url, depth, status, parsed), on_graph_built and
    on_metrics the context and the graph, on_report (url, nodes, edges, metrics, report). Rows that the middle ones return are kept as the plugin's,
    and those with a score count in the snapshot's total.
    """
    registry = registry or Registry()
    context = Context(url, "crawl", command)
    nothing = lambda: Run(0, None, None, None, None, None, context.failures)
    for hook in ("on_init", "on_crawl_start"):
        call(registry, hook, context, context)
        if context.terminate:
            return nothing()
    unknown = set(context.policy) - set(POLICY)
    if unknown:
        raise ValueError(f"no options of a crawl: {sorted(unknown)}")
    chosen = dataclasses.replace(options, registry=registry, **context.policy)
    found = crawling.crawl(spark, url, fetch, chosen, robots, sitemap)
    origin = spark.range(1).select(U.origin(F.lit(U.normalize_one(url)))).first()[0]
    domain = origin.split("://", 1)[1].removeprefix("www.")
    context.snapshot_id = committed.save_crawl(store, domain, found, created_at=created_at)
    keep_rows(store, registry, context, "on_page_parsed", call(registry, "on_page_parsed", context, context, found.parsed))
    st = store.load()
    plain = G.SiteGraph(st.pages.join(O.snapshot_metrics(st, context.snapshot_id).select(F.col("page_id").alias("id")), "id", "left_semi"), O.graph_edges(st, context.snapshot_id))
    keep_rows(store, registry, context, "on_graph_built", call(registry, "on_graph_built", context, context, plain))
    graph, metrics, counts = measure(store, context.snapshot_id, found.parsed, origin)
    keep_rows(store, registry, context, "on_metrics", call(registry, "on_metrics", context, context, graph))

    def total(c: committed.Change) -> None:
        blended = O.write_back_scores(c.read("snapshots").drop("total_score"), c.read("plugin_rows"))
        # other snapshots keep the total that they were given
        kept = c.read("snapshots").select("id", F.col("total_score").alias("_old"))
        c.put("snapshots", blended.join(kept, "id").withColumn("total_score", F.when(F.col("id") == context.snapshot_id, F.col("total_score")).otherwise(F.col("_old"))).drop("_old"))

    store.commit(total, f"total of {context.snapshot_id}", retries=3)
    nodes = graph.nodes.select("id", "url", "depth", "status", "in_links", "out_links", F.col("pagerank_score").alias("score"))
    report = insight(metrics, counts)
    call(registry, "on_report", context, url, nodes, graph.edges, metrics, report)
    return Run(context.snapshot_id, found, nodes, graph.edges, metrics, report, context.failures)
