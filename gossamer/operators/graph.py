"""Link graphs: building, degrees, metrics, collapsing, breadth-first depth, redirects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.session import materialize, side, spread


@dataclass
class SiteGraph:
    """nodes(id, ...) and edges(src, dst, weight), each edge once with its largest weight."""

    nodes: DataFrame
    edges: DataFrame


def build_graph(nodes: DataFrame, edges: DataFrame, node: str = "id") -> SiteGraph:
    """Edges once each with their largest weight (1.0 where null), without dangling ends."""
    ids = nodes.select(F.col(node).alias("_n"))
    kept = edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, F.col("dst") == ids["_n"], "left_semi")
    return SiteGraph(nodes, kept.groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight")))


def degrees(g: SiteGraph, node: str = "id") -> DataFrame:
    """Nodes with in_links and out_links, counted over distinct edges."""
    ends = g.edges.select(F.col("src").alias("_n"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(g.edges.select(F.col("dst").alias("_n"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = ends.groupBy("_n").agg(F.sum("i").cast("bigint").alias("in_links"), F.sum("o").cast("bigint").alias("out_links"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return g.nodes.join(n, g.nodes[node] == n["_n"], "left").select(*[g.nodes[c] for c in g.nodes.columns], zero("in_links"), zero("out_links"))


def authority(in_links: Column, largest: Column) -> Column:
    return F.when(largest > 0, F.ln(1 + in_links) / F.ln(1 + largest)).otherwise(F.lit(0.0))


def graph_metrics(deg: DataFrame, max_depth: int = 3) -> DataFrame:
    """One row: totals, depths, efficiency, orphan counts and out-degree entropy.

    ``deg`` has id, depth, in_links, out_links. A page is near-orphan with one link in at ``max_depth`` or deeper, deep
    beyond ``max_depth``; depth 0 is the home page and no orphan.
    """
    spread = deg.groupBy("out_links").agg(F.count(F.lit(1)).alias("n"))
    total = deg.count()
    p = F.col("n") / F.lit(float(max(total, 1)))
    entropy = spread.agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))
    count = lambda c: F.count_if(c).cast("bigint")
    inner = F.col("depth") > 0
    one = deg.agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("out_links"), F.lit(0)).cast("bigint").alias("edges"), F.max("depth").cast("int").alias("max_depth"),
        F.avg(F.col("depth").cast("double")).alias("avg_depth"), F.avg(F.col("out_links").cast("double")).alias("avg_out"),
        (F.count_if(F.col("depth") <= max_depth) / F.count(F.lit(1))).alias("efficiency"),
        count((F.col("in_links") == 0) & inner).alias("orphans"), count((F.col("in_links") == 1) & (F.col("depth") >= max_depth)).alias("near_orphans"), count(F.col("depth") > max_depth).alias("deep"),
    )
    return one.crossJoin(F.broadcast(entropy))  # one row each


def collapse(g: SiteGraph, members: DataFrame) -> SiteGraph:
    """Point edges at the representatives of their targets; self-loops that arise go.

    ``members`` is (id, representative).
    """
    m = side(members.select(F.col("id").alias("dst"), "representative"))
    moved = g.edges.join(m, "dst", "left").select("src", F.coalesce("representative", "dst").alias("dst"), "weight", (F.col("src") == F.col("dst")).alias("loop"))
    # a task that sums up a large split of a compressed table would hold all its edges
    moved = spread(materialize(moved.where("src <> dst or loop").drop("loop"), "collapsed"), "src", "dst")
    return SiteGraph(g.nodes, moved.groupBy("src", "dst").agg(F.max("weight").alias("weight")))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, limit: int | None = None) -> DataFrame:
    """(id, depth): least number of steps from a seed, level by level; seeds have depth 0.

    ``limit`` stops at so many pages; within the last level the smallest ids stay.
    """
    frontier = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "bfs")
    seen = frontier
    for d in range(1, max_depth + 1):
        if limit is not None and seen.count() >= limit:
            break
        step = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if limit is None else seen.orderBy("depth", "id").limit(limit)


def redirect_edges(pages: DataFrame, chain: str = "redirect_chain", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each hop of a chain of (url, status, target) as an edge, with the ``keep`` columns of its page."""
    return pages.select(*keep, F.posexplode(chain).alias("hop", "r")).select(*keep, "hop", F.col("r.url").alias("src"), F.col("r.target").alias("dst"), F.col("r.status").alias("status"))


def follow_redirects(hops: DataFrame, starts: DataFrame, max_hops: int = 5) -> DataFrame:
    """(url, final, n_hops, outcome) with outcome ok, loop or too_many; fragments do not count."""
    bare = lambda c: F.regexp_replace(c, "#.*$", "")
    live = starts.select("url", F.col("url").alias("final"), F.array(bare(F.col("url"))).alias("path"))
    table = side(materialize(hops.select(bare(F.col("src")).alias("_from"), F.col("dst").alias("_to")), "hops"))
    ended = []
    for _ in range(max_hops + 1):
        j = live.join(table, bare(F.col("final")) == F.col("_from"), "left")
        loop = F.array_contains("path", bare(F.col("_to")))
        full = F.size("path") > max_hops
        state = F.when(F.col("_to").isNull(), "ok").when(loop, "loop").when(full, "too_many").otherwise("")
        go = state == ""
        # what has ended is joined no more
        step = materialize(j.select("url", F.when(go, F.col("_to")).otherwise(F.col("final")).alias("final"), F.when(go, F.concat("path", F.array(bare(F.col("_to"))))).otherwise(F.col("path")).alias("path"), state.alias("outcome")), "redirects")
        ended.append(step.where("outcome <> ''"))
        live = step.where("outcome = ''").drop("outcome")
        if live.isEmpty():
            break
    now = reduce(DataFrame.unionByName, ended)
    return now.select("url", "final", (F.size("path") - 1).alias("n_hops"), "outcome")
