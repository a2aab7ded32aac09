"""A store of crawls that is changed by whole commits: tables of Parquet parts, and one manifest for each version.

A change writes its parts beside the others, where no version names them, and then publishes a manifest that
does. Publishing fails if the next version is there already, so of two changes of one version one wins and
the other is told; readers see a version before a change or after it. The folder has to be one in which a file can be
renamed or linked in one step without replacing another (HDFS, or a disk that all share).

A part may bear a key (the snapshot of edges and metrics, the site of pages): what concerns one key opens its
parts only, and to delete a snapshot is to leave parts out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.operators.mutations import fold_pages, may_delete_snapshot, retained
from gossamer.operators.store import Store

#: So many full and single runs of a site are kept.
KEEP, KEEP_SINGLE = 5, 5

SCHEMAS = {
    "sites": "id bigint, domain string, created_at timestamp",
    "snapshots": "id bigint, site_id bigint, run_type string, status string, created_at timestamp, node_count bigint, edge_count bigint, limit_reached int, health_score double, orphan_count bigint, total_score double",
    "pages": """id bigint, site_id bigint, normalized_url string, first_seen bigint, last_seen bigint, http_status bigint, canonical_url string, noindex int, nofollow int, content_hash string, simhash bigint, etag string, last_modified string,
        retries int, bytes bigint, security_error string, redirect_chain string, depth bigint, is_internal int, crawl_trap_flag int""",
    "metrics": """snapshot_id bigint, page_id bigint, crawl_status string, word_count bigint, thin_content_score double, external_link_ratio double, pagerank_score double, auth_score double, hub_score double, link_role string,
        duplicate_cluster_id string, duplicate_type string, is_cluster_primary int, cluster_id bigint""",
    "edges": "id bigint, snapshot_id bigint, source_page_id bigint, target_page_id bigint, weight double, rel string",
    "plugin_rows": "id bigint, snapshot_id bigint, url_id bigint, plugin string, score double, weight double, age_seconds bigint",
}

#: The column that a part's key is of.
KEYS = {"pages": "site_id", "metrics": "snapshot_id", "edges": "snapshot_id", "plugin_rows": "snapshot_id"}


class Conflict(RuntimeError):
    """Somebody else has published the next version first; nothing of the change is left."""


@dataclass(frozen=True)
class Part:
    path: str
    key: int | None = None


class Folder:
    """The few file operations of a commit, over whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Put a file there whole, unless one of its name is there."""
        draft = self._at(f"{name}.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._at(name)
        try:
            if self.fs.getUri().getScheme() == "file":
                # renaming replaces here, linking does not
                nio, disk = self.jvm.java.nio.file, self.jvm.java.io.File
                local = lambda p: disk(p.toUri().getPath()).toPath()
                try:
                    nio.Files.createLink(local(final), local(draft))
                except Exception as e:  # noqa: BLE001 - py4j wraps what Java throws
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
                return True
            return bool(not self.fs.exists(final) and self.fs.rename(draft, final))
        finally:
            self.fs.delete(draft, False)

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Change:
    """What one commit will make of a version. Tables that are read include what the change has written."""

    def __init__(self, store: CommittedStore, base: dict):
        self.store, self.spark, self.base = store, store.spark, base
        self.tables = {k: [Part(*p) for p in v] for k, v in base["tables"].items()}
        self.streams, self.written = dict(base["streams"]), []

    def read(self, name: str, key: int | None = None) -> DataFrame:
        return self.store._frame(name, [p for p in self.tables[name] if key is None or p.key in (None, key)])

    def _write(self, name: str, rows: DataFrame, key: int | None) -> Part:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        foreign = set(rows.columns) - set(schema.names)
        if foreign:
            raise ValueError(f"{name} has no columns {sorted(foreign)}")
        where = f"data/{name}-{uuid.uuid4().hex}"
        self.written.append(where)
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.store.path}/{where}")
        return Part(where, key)

    def append(self, name: str, rows: DataFrame, key: int | None = None) -> None:
        self.tables[name] = [*self.tables[name], self._write(name, rows, key)]

    def put(self, name: str, rows: DataFrame, key: int | None = None) -> None:
        """Rows take the place of the table, or of all that it has of a key; parts of no key lose the key's rows."""
        part, kept = self._write(name, rows, key), []
        for p in self.tables[name] if key is not None else ():
            if p.key is None:
                every, mine = self.store._frame(name, [p]), F.col(KEYS[name]).eqNullSafe(F.lit(key))
                p = p if every.where(mine).isEmpty() else self._write(name, every.where(~mine), None)
            if p.key != key:
                kept.append(p)
        self.tables[name] = [*kept, part]

    def drop(self, name: str, key: int) -> None:
        self.tables[name] = [p for p in self.tables[name] if p.key != key]

    def discard(self) -> None:
        for where in self.written:
            self.store.folder.remove(where)


class CommittedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, or of the last one; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "note": "", "tables": {k: [] for k in SCHEMAS}, "streams": {}}
        return json.loads(self.folder.read(f"versions/{version:012d}.json"))

    def _frame(self, name: str, parts: list[Part]) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p.path}" for p in parts])

    def load(self, version: int | None = None) -> Store:
        m = self.manifest(version)
        return Store(*[self._frame(k, [Part(*p) for p in m["tables"][k]]) for k in ("sites", "snapshots", "pages", "metrics", "edges", "plugin_rows")])

    def commit(self, change: Callable[[Change], object], note: str = "", retries: int = 0, base: int | None = None) -> int:
        """The version that ``change`` makes of the last one (or of ``base``). A change that comes too late is made
        again from the version that came first as often as ``retries`` says, and then raises Conflict. A change that
        changes nothing makes no version."""
        for _ in range(retries + 1):
            c = Change(self, self.manifest(base))
            try:
                change(c)
                tables = {k: [[p.path, p.key] for p in v] for k, v in c.tables.items()}
                if tables == c.base["tables"] and c.streams == c.base["streams"]:
                    return c.base["version"]
                version = c.base["version"] + 1
                done = self.folder.publish(f"versions/{version:012d}.json", json.dumps({"version": version, "note": note, "tables": tables, "streams": c.streams}))
            except BaseException:
                c.discard()
                raise
            if done:
                return version
            c.discard()
            base = None
        raise Conflict(f"version {version} is there already")

    def append_stream(self, name: str, query: str, retries: int = 100) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: rows of a batch, once. The manifest says how far each query has come, in the
        same step as it names the rows, so that a batch that is sent again is left out."""

        def write(rows: DataFrame, batch: int) -> None:
            def add(c: Change) -> None:
                if c.streams.get(query, -1) < batch:
                    c.append(name, rows)
                    c.streams[query] = batch

            self.commit(add, f"{query} {batch}", retries)

        return write

    def compact(self, name: str) -> int:
        """A version in which each key of a table is one part."""

        def one(c: Change) -> None:
            for key in {p.key for p in c.tables[name]}:
                parts = [p for p in c.tables[name] if p.key == key]
                if len(parts) > 1:
                    whole = c._write(name, self._frame(name, parts), key)
                    c.tables[name] = [p for p in c.tables[name] if p not in parts] + [whole]

        return self.commit(one, f"compact {name}")

    def vacuum(self, keep: int = 10) -> list[str]:
        """Removes the manifests but for the last ``keep``, and the parts that these do not name. Only where nobody writes or
        reads an older version."""
        all_ = self.versions()
        last = all_[-keep:]
        named = {p[0] for v in last for parts in self.manifest(v)["tables"].values() for p in parts}
        gone = [f"versions/{v:012d}.json" for v in all_[:-keep]] + [f"data/{n}" for n in self.folder.names("data") if f"data/{n}" not in named]
        for name in gone:
            self.folder.remove(name)
        return gone


# -- changes --------------------------------------------------------------------------------------


def next_id(df: DataFrame, column: str = "id") -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def create_site(c: Change, domain: str, created_at: Column) -> int:
    """The id of a domain's site, which is made if there is none."""
    sites = c.read("sites")
    known = sites.where(F.col("domain") == domain).agg(F.min("id")).first()[0]
    if known is None:
        known = next_id(sites)
        c.append("sites", c.spark.range(1).select(F.lit(known).alias("id"), F.lit(domain).alias("domain"), created_at.alias("created_at")))
    return known


def merge_pages(c: Change, site: int, snapshot: int, updates: DataFrame) -> None:
    """Upsert of a site's pages by url. ``updates`` has url, status and any of the pages' columns, one row a url.

    What is new takes an id and is first seen now; what is known keeps its id and first sight, the smallest depth, its last status
    that is not 0, its largest flags, and of all else the last value that is not null.
    """
    names = {"normalized_url": "url", "http_status": "status", "crawl_trap_flag": "trap_flag"}
    back = {v: k for k, v in names.items()}
    old = c.read("pages", site).where(F.col("site_id") == site)
    columns = [n for n in old.columns if n not in ("id", "site_id")]
    before = old.select(F.lit(0).alias("ordinal"), *[F.col(n).alias(names.get(n, n)) for n in columns])
    foreign = set(updates.columns) - set(before.columns)
    if foreign:
        raise ValueError(f"pages have no columns {sorted(foreign)}")
    seen = updates.withColumns({"ordinal": F.lit(1), "first_seen": F.lit(snapshot).cast("long"), "last_seen": F.lit(snapshot).cast("long")})
    folded = fold_pages(before.unionByName(seen, allowMissingColumns=True), "url", "ordinal")
    # a snapshot that was deleted leaves pages that are known without a first sight
    ids = old.select(F.col("normalized_url").alias("url"), "id")
    merged = folded.join(ids, "url", "left").withColumn("id", F.coalesce("id", F.lit(next_id(c.read("pages"))) + F.monotonically_increasing_id()))
    c.put("pages", merged.select("id", F.lit(site).alias("site_id"), *[F.col(n).alias(back.get(n, n)) for n in merged.columns if n != "id"]), site)


def replace_metrics(c: Change, snapshot: int, rows: DataFrame) -> None:
    """Rows (page_id and metrics) take the place of those of the same pages in a snapshot."""
    old = c.read("metrics", snapshot).where(F.col("snapshot_id") == snapshot)
    new = rows.withColumn("snapshot_id", F.lit(snapshot).cast("long"))
    c.put("metrics", new.unionByName(old.join(new.select("page_id"), "page_id", "left_anti"), allowMissingColumns=True), snapshot)


def update_snapshot(c: Change, snapshot: int, **values: Column) -> None:
    rows = c.read("snapshots")
    c.put("snapshots", rows.select(*[F.when(F.col("id") == snapshot, values[n]).otherwise(F.col(n)).alias(n) if n in values else F.col(n) for n in rows.columns]))


def delete_snapshot(c: Change, snapshot: int) -> None:
    """A snapshot goes with its metrics, edges and plugin rows; pages forget it, and those that no snapshot
    is named for go with what is left of theirs. Parts of the snapshot are left out; others are written again only if they have rows to lose."""
    c.put("snapshots", c.read("snapshots").where(F.col("id") != snapshot))
    gone = None
    for part in c.tables["pages"]:
        rows = c.store._frame("pages", [part])
        named = (F.col("first_seen") == snapshot) | (F.col("last_seen") == snapshot) | (F.col("first_seen").isNull() & F.col("last_seen").isNull())
        if rows.where(named).isEmpty():
            continue
        cleared = rows.withColumns({n: F.when(F.col(n) != snapshot, F.col(n)) for n in ("first_seen", "last_seen")})
        lost = F.col("first_seen").isNull() & F.col("last_seen").isNull()
        ids = cleared.where(lost).select(F.col("id").alias("_gone"))
        gone = ids if gone is None else gone.unionByName(ids)
        kept = c._write("pages", cleared.where(~lost), part.key)
        c.tables["pages"] = [kept if p == part else p for p in c.tables["pages"]]
    for name, keys in {"metrics": ("page_id",), "edges": ("source_page_id", "target_page_id"), "plugin_rows": ("url_id",)}.items():
        c.drop(name, snapshot)
        for part in c.tables[name]:
            rows = c.store._frame(name, [part])
            left = rows.where(F.col("snapshot_id") != snapshot)
            of_gone = None
            for k in keys if gone is not None else ():
                left = left.join(gone, F.col(k) == F.col("_gone"), "left_anti")
                hit = rows.select(F.col(k).alias("_gone")).join(gone, "_gone", "left_semi")
                of_gone = hit if of_gone is None else of_gone.unionByName(hit)
            if (part.key is None and not rows.where(F.col("snapshot_id") == snapshot).isEmpty()) or (of_gone is not None and not of_gone.isEmpty()):
                kept = c._write(name, left, part.key)
                c.tables[name] = [kept if p == part else p for p in c.tables[name]]


def delete_site_snapshot(store: CommittedStore, site: int, snapshot: int, retries: int = 3) -> int:
    """As asked for by hand: refused for the only snapshot of a site."""

    def change(c: Change) -> None:
        may_delete_snapshot(c.read("snapshots"), site, snapshot)
        delete_snapshot(c, snapshot)

    return store.commit(change, f"delete snapshot {snapshot}", retries)


def save_crawl(store: CommittedStore, domain: str, crawl, run_type: str = "completed", created_at: Column | None = None, keep: int = KEEP, keep_single: int = KEEP_SINGLE, retries: int = 3) -> int:
    """A crawl as one commit: its site, a new snapshot, merged pages, edges and metrics; snapshots beyond those that are
    kept go in the same step. Returns the snapshot's id."""
    made: list[int] = []
    now = F.current_timestamp() if created_at is None else created_at

    def change(c: Change) -> None:
        site = create_site(c, domain, now)
        snapshot = next_id(c.read("snapshots"))
        renamed = {"canonical": "canonical_url"}
        pages = crawl.pages
        known = {"url", "status", "trap_flag", *T.StructType.fromDDL(SCHEMAS["pages"]).names}
        merge_pages(c, site, snapshot, pages.select(*[F.col(n).alias(renamed.get(n, n)) for n in pages.columns if renamed.get(n, n) in known]))
        ids = c.read("pages", site).select(F.col("normalized_url").alias("url"), "id")
        end = lambda df, url, name: df.join(ids.select(F.col("url").alias(url), F.col("id").alias(name)), url)
        edges = end(end(crawl.edges, "src", "source_page_id"), "dst", "target_page_id").select((F.lit(next_id(c.read("edges"))) + F.monotonically_increasing_id()).alias("id"), F.lit(snapshot).alias("snapshot_id"), "source_page_id", "target_page_id", "weight", "rel")
        c.append("edges", edges, snapshot)
        c.append("metrics", end(crawl.metrics, "url", "page_id").drop("url").withColumn("snapshot_id", F.lit(snapshot)), snapshot)
        row = c.spark.range(1).select(
            F.lit(snapshot).alias("id"), F.lit(site).alias("site_id"), F.lit(run_type).alias("run_type"), F.lit("completed").alias("status"), now.alias("created_at"),
            F.lit(c.read("metrics", snapshot).count()).alias("node_count"), F.lit(c.read("edges", snapshot).count()).alias("edge_count"), F.lit(int(crawl.limit_reached)).alias("limit_reached"),
        )
        c.append("snapshots", row)
        snapshots = c.read("snapshots").where(F.col("site_id") == site)
        old = snapshots.join(retained(snapshots, keep, keep_single, snapshot).select("id"), "id", "left_anti")
        # as many as were over the limit before, which is one as a rule
        for r in old.select("id").orderBy("id").collect():
            delete_snapshot(c, r.id)
        made.append(snapshot)

    store.commit(change, f"crawl of {domain}", retries)
    return made[-1]
