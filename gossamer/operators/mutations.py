"""Changes to the store as pure queries: the state after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_pages(updates: DataFrame, key: str = "url", order: str = "ordinal") -> DataFrame:
    """Upserts in order, column by column: first_seen keeps the first value, last_seen the last,
    status the last that is not 0, flags the largest, depth the smallest, the rest the last not null."""
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col(order))).alias(c)
    known = lambda c: F.col(c).isNotNull()
    special = {"first_seen", "last_seen", "status", "noindex", "retries", "trap_flag", "depth", key, order}
    rest = [c for c in updates.columns if c not in special]
    has = set(updates.columns)
    out = [F.min_by("first_seen", order).alias("first_seen"), F.max_by("last_seen", order).alias("last_seen")]
    out.append(F.coalesce(F.max_by(F.when(F.col("status") != 0, F.col("status")), F.when(F.col("status") != 0, F.col(order))), F.max("status")).alias("status"))
    if "noindex" in has:
        out.append(F.coalesce(F.max_by(F.when(F.col("status") != 0, F.col("noindex")), F.when(F.col("status") != 0, F.col(order))), F.min_by("noindex", order)).alias("noindex"))
    out += [F.max(c).alias(c) for c in ("retries", "trap_flag") if c in has]
    out += [F.min("depth").alias("depth")] if "depth" in has else []
    return updates.groupBy(key).agg(*out, *[last(c, known(c)) for c in rest])


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows of ``new`` take the place of those of ``old``."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def reconcile_urls(pages: DataFrame, edges: DataFrame, path: Column) -> tuple[DataFrame, DataFrame]:
    """Pages that are one path become the page with the smallest id; edges follow."""
    w = Window.partitionBy("site_id", "_path")
    keyed = pages.withColumn("_path", path).withColumn("_to", F.min("id").over(w))
    kept = keyed.where(F.col("id") == F.col("_to")).withColumn("normalized_url", F.col("_path")).drop("_path", "_to")
    m = keyed.select(F.col("id").alias("_id"), "_to")
    moved = edges.join(m, edges["source_page_id"] == m["_id"], "left").withColumn("source_page_id", F.coalesce("_to", "source_page_id")).drop("_id", "_to")
    return kept, moved.join(m, moved["target_page_id"] == m["_id"], "left").withColumn("target_page_id", F.coalesce("_to", "target_page_id")).drop("_id", "_to")


def retained(snapshots: DataFrame, keep: int = 5, keep_single: int = 5, protected: int | None = None) -> DataFrame:
    """Newest snapshots of each site: so many full ones and so many single ones."""
    single = F.col("run_type") == "single"
    place = F.row_number().over(Window.partitionBy("site_id", single).orderBy(F.col("created_at").desc(), F.col("id").desc()))
    ok = F.col("_place") <= F.when(single, keep_single).otherwise(keep)
    if protected is not None:
        ok = ok | (F.col("id") == protected)
    return snapshots.withColumn("_place", place).where(ok).drop("_place")


def delete_snapshot(snapshot_id: int, snapshots: DataFrame, pages: DataFrame, edges: DataFrame, metrics: DataFrame, plugin_rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The store without a snapshot.

    Pages forget that they were first or last seen in it; pages that no snapshot is named for any more go,
    and with them and with the snapshot their metrics, edges and plugin rows.
    """
    forget = lambda c: F.when(F.col(c) != snapshot_id, F.col(c)).alias(c)
    cleared = pages.select(*[forget(c) if c in ("first_seen", "last_seen") else F.col(c) for c in pages.columns])
    gone = F.col("first_seen").isNull() & F.col("last_seen").isNull()
    ids = cleared.where(gone).select(F.col("id").alias("_gone"))

    def rest(df: DataFrame, *keys: str) -> DataFrame:
        out = df.where(F.col("snapshot_id") != snapshot_id)
        for k in keys:
            out = out.join(ids, F.col(k) == F.col("_gone"), "left_anti")
        return out

    out = {"snapshots": snapshots.where(F.col("id") != snapshot_id), "pages": cleared.where(~gone), "metrics": rest(metrics, "page_id"), "edges": rest(edges, "source_page_id", "target_page_id")}
    return out if plugin_rows is None else out | {"plugin_rows": rest(plugin_rows, "url_id")}


def may_delete_snapshot(snapshots: DataFrame, site: int, snapshot_id: int) -> None:
    """Raises unless the snapshot is one of several of its site."""
    mine = snapshots.where(F.col("site_id") == site)
    n, there = mine.agg(F.count(F.lit(1)), F.count_if(F.col("id") == snapshot_id)).first()
    if not there:
        raise LookupError(f"site {site} has no snapshot {snapshot_id}")
    if n <= 1:
        raise ValueError("the only snapshot of a site cannot be deleted")


def incremental(answers: DataFrame, links: DataFrame, before: DataFrame, old_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, links) of a second crawl.

    ``answers`` has id, status and attributes, ``before`` the attributes of the first crawl. A page
    that answers 304 takes its attributes from ``before`` (crawl_status cached) and its links out
    from ``old_links``, with weight 1 and without links to itself; without a row there it is left out.
    Others are fetched.
    """
    same = answers.where(F.col("status") == 304).select("id").join(before, "id").withColumn("crawl_status", F.lit("cached"))
    fresh = answers.where(F.col("status") != 304).withColumn("crawl_status", F.lit("fetched")).drop("status")
    replayed = old_links.join(same.select(F.col("id").alias("src")), "src", "left_semi").where("src <> dst").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))
    return same.unionByName(fresh, allowMissingColumns=True), replayed.unionByName(links.select("src", "dst", "weight"))


def cache_through(wanted: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cached rows where there are any, computed ones elsewhere."""
    misses = compute(wanted.join(cache.select(key).distinct(), key, "left_anti"))
    return cache.join(wanted.select(key).distinct(), key, "left_semi").unionByName(misses, allowMissingColumns=True)


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, change, old, new, severity) of pages: added, removed, status, content, noindex."""
    a, b = old.select("url", *[F.col(c).alias(f"o_{c}") for c in ("status", "content_hash", "noindex")], F.lit(True).alias("_o")), new.select("url", "status", "content_hash", "noindex", F.lit(True).alias("_n"))
    j = a.join(b, "url", "full_outer")
    both = F.col("_o") & F.col("_n")
    row = lambda c, kind, o, n, sev: F.when(c, F.struct(F.lit(kind).alias("change"), o.cast("string").alias("old"), n.cast("string").alias("new"), F.lit(sev).alias("severity")))
    none = F.lit(None)
    changes = F.array(
        row(F.col("_o").isNull(), "added", none, none, "low"), row(F.col("_n").isNull(), "removed", none, none, "low"),
        row(both & ~F.col("status").eqNullSafe(F.col("o_status")), "status", F.col("o_status"), F.col("status"), "high"),
        row(both & ~F.col("content_hash").eqNullSafe(F.col("o_content_hash")), "content", F.col("o_content_hash"), F.col("content_hash"), "medium"),
        row(both & ~F.col("noindex").eqNullSafe(F.col("o_noindex")), "noindex", F.col("o_noindex"), F.col("noindex"), "high"),
    )
    return j.select("url", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("url", "c.*")
