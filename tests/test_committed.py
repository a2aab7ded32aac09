"""Commits, conflicts, replays and cascades of the committed store."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from gossamer.operators import store as O
from gossamer.sources import committed as K
from gossamer.sources import crawling
from gossamer.sources.crawling import Crawl

PAGES = "url string, status long, depth long, canonical_url string, noindex int, is_internal int"


@pytest.fixture
def store(spark, tmp_path):
    return K.CommittedStore(spark, f"file://{tmp_path}/store")


def crawl_of(spark, pages, edges=(), metrics=()):
    return Crawl(
        spark.createDataFrame([(*p, None, 0, 1) for p in pages], PAGES), spark.createDataFrame(list(edges), "src string, dst string, weight double, rel string"),
        spark.createDataFrame(list(metrics), "url string, crawl_status string, word_count long, thin_content_score double, external_link_ratio double"), None, len(pages), False, "",
    )


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def test_crawls_become_versions_and_pages_are_merged(spark, store):
    one = crawl_of(spark, [("/", 200, 0), ("/a", 200, 1)], [("/", "/a", 1.0, "internal")], [("/", "fetched", 10, 0.0, 0.0), ("/a", "fetched", 20, 0.0, 0.0)])
    two = crawl_of(spark, [("/", 0, 0), ("/b", 404, 1), ("/a", 500, 2)], [("/", "/b", 1.0, "internal"), ("/b", "/nowhere", 1.0, "internal")], [("/b", "fetched_error", None, None, None)])
    assert K.save_crawl(store, "e.com", one, created_at=at(1)) == 1
    assert K.save_crawl(store, "e.com", two, created_at=at(2)) == 2
    assert store.versions() == [1, 2]
    st = store.load()
    got = {r.normalized_url: (r.first_seen, r.last_seen, r.http_status, r.depth) for r in st.pages.collect()}
    assert got == {"/": (1, 2, 200, 0), "/a": (1, 2, 500, 1), "/b": (2, 2, 404, 1)}
    ids = {r.normalized_url: r.id for r in st.pages.collect()}
    assert len(set(ids.values())) == 3
    old = store.load(1)
    assert {r.normalized_url: r.id for r in old.pages.collect()} == {u: ids[u] for u in ("/", "/a")}
    assert [(r.snapshot_id, r.source_page_id, r.target_page_id) for r in st.edges.orderBy("id").collect()] == [(1, ids["/"], ids["/a"]), (2, ids["/"], ids["/b"])]
    assert [(r.id, r.node_count, r.edge_count) for r in st.snapshots.orderBy("id").collect()] == [(1, 2, 1), (2, 1, 1)]
    # the store's own queries run over it
    assert [r.url for r in O.newly_broken(st, 1, 2).collect()] == ["/b"]


def test_rows_of_a_key_leave_parts_without_one(spark, store):
    rows = lambda *r: spark.createDataFrame([*r], "snapshot_id long, page_id long, word_count long")
    store.commit(lambda c: c.put("metrics", rows((1, 1, 1), (1, 2, 1), (2, 1, 1))))
    store.commit(lambda c: K.replace_metrics(c, 1, rows((1, 2, 5)).drop("snapshot_id")))
    assert sorted(tuple(r) for r in store.load().metrics.select("snapshot_id", "page_id", "word_count").collect()) == [(1, 1, 1), (1, 2, 5), (2, 1, 1)]


def test_retention_is_part_of_the_commit(spark, store):
    for day in range(1, 5):
        K.save_crawl(store, "e.com", crawl_of(spark, [("/", 200, 0), (f"/{day}", 200, 1)], [("/", f"/{day}", 1.0, "internal")], [("/", "fetched", 1, 0.0, 0.0), (f"/{day}", "fetched", 1, 0.0, 0.0)]), created_at=at(day), keep=2)
    st = store.load()
    assert sorted(r.id for r in st.snapshots.collect()) == [3, 4]
    assert sorted(r.normalized_url for r in st.pages.collect()) == ["/", "/3", "/4"]
    assert {r.snapshot_id for r in st.edges.collect()} == {r.snapshot_id for r in st.metrics.collect()} == {3, 4}
    assert len(store.versions()) == 4 and sorted(r.id for r in store.load(2).snapshots.collect()) == [1, 2]


def test_of_two_writers_one_is_told_and_leaves_nothing(spark, store):
    K.save_crawl(store, "e.com", crawl_of(spark, [("/", 200, 0)], [], [("/", "fetched", 1, 0.0, 0.0)]), created_at=at(1))
    both, results = threading.Barrier(2), {}

    def writer(name):
        def change(c):
            c.append("plugin_rows", c.spark.range(3).select("id", F.lit(1).alias("snapshot_id"), F.lit(name).alias("plugin")))
            both.wait(60)

        try:
            results[name] = store.commit(change)
        except K.Conflict as e:
            results[name] = e

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    won = [n for n, r in results.items() if r == 2]
    lost = [n for n, r in results.items() if isinstance(r, K.Conflict)]
    assert len(won) == len(lost) == 1
    assert {(r.plugin, r.id) for r in store.load().plugin_rows.collect()} == {(won[0], i) for i in range(3)}
    # what the loser wrote is gone: every folder is named by a version
    named = {p[0].split("/")[1] for v in store.versions() for parts in store.manifest(v)["tables"].values() for p in parts}
    assert set(store.folder.names("data")) == named
    assert not [n for n in store.folder.names("versions") if not n.endswith(".json")]
    # made again from the version that came first, it succeeds
    store.commit(lambda c: c.append("plugin_rows", c.spark.range(1).select("id", F.lit(lost[0]).alias("plugin"))), base=1, retries=1)
    assert store.load().plugin_rows.count() == 4


def test_failed_change_leaves_nothing(spark, store):
    def change(c):
        c.append("sites", c.spark.range(1).select("id"))
        raise KeyError("stop")

    with pytest.raises(KeyError):
        store.commit(change)
    assert store.versions() == [] and store.folder.names("data") == []
    with pytest.raises(ValueError, match="no columns"):
        store.commit(lambda c: c.append("sites", c.spark.range(1).withColumn("else", F.lit(1))))
    assert store.load().sites.count() == 0


def test_readers_keep_their_version(spark, store):
    store.commit(lambda c: c.put("sites", c.spark.range(2).select("id")))
    reader = store.load().sites
    store.commit(lambda c: c.put("sites", c.spark.range(5).select("id")))
    assert reader.count() == 2 and store.load().sites.count() == 5


def test_the_only_snapshot_is_not_deleted(spark, store):
    K.save_crawl(store, "e.com", crawl_of(spark, [("/", 200, 0)], [], [("/", "fetched", 1, 0.0, 0.0)]), created_at=at(1))
    with pytest.raises(ValueError, match="only snapshot"):
        K.delete_site_snapshot(store, 1, 1)
    K.save_crawl(store, "e.com", crawl_of(spark, [("/x", 200, 0)], [], [("/x", "fetched", 1, 0.0, 0.0)]), created_at=at(2))
    K.delete_site_snapshot(store, 1, 1)
    st = store.load()
    assert [r.normalized_url for r in st.pages.collect()] == ["/x"] and [r.snapshot_id for r in st.metrics.collect()] == [2]


def test_metrics_are_replaced_by_page(spark, store):
    K.save_crawl(store, "e.com", crawl_of(spark, [("/", 200, 0), ("/a", 200, 1)], [], [("/", "fetched", 1, 0.0, 0.0), ("/a", "fetched", 2, 0.0, 0.0)]), created_at=at(1))
    ids = {r.normalized_url: r.id for r in store.load().pages.collect()}
    new = spark.createDataFrame([(ids["/a"], 77)], "page_id long, word_count long")
    store.commit(lambda c: K.replace_metrics(c, 1, new))
    store.commit(lambda c: K.update_snapshot(c, 1, health_score=F.lit(55.5)))
    st = store.load()
    assert {r.page_id: (r.word_count, r.crawl_status) for r in st.metrics.collect()} == {ids["/"]: (1, "fetched"), ids["/a"]: (77, None)}
    assert st.snapshots.first().health_score == 55.5


def test_batches_that_are_sent_again_are_left_out(spark, store, tmp_path):
    write = store.append_stream("plugin_rows", "q")
    batch = lambda lo, hi: spark.range(lo, hi).select("id", F.lit("p").alias("plugin"))
    write(batch(0, 3), 0)
    write(batch(0, 3), 0)
    write(batch(3, 5), 1)
    write(batch(0, 3), 0)
    store.append_stream("plugin_rows", "other")(batch(5, 6), 0)
    assert sorted(r.id for r in store.load().plugin_rows.collect()) == [0, 1, 2, 3, 4, 5]
    assert store.manifest()["streams"] == {"q": 1, "other": 0}


def test_stream_whose_progress_is_lost_leaves_no_row_twice(spark, store, tmp_path):
    """The batch was written, then the query died before its own log said so: it is run again."""
    src = str(tmp_path / "in")
    write = store.append_stream("plugin_rows", "q")
    died = []

    def dies_after_writing(rows, batch):
        write(rows, batch)
        if not died:
            died.append(batch)
            raise RuntimeError("lost")

    def run(fn):
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
        q = rows.select("id", F.lit("p").alias("plugin")).writeStream.foreachBatch(fn).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()

    spark.range(0, 50).coalesce(1).write.mode("append").parquet(src)
    spark.range(50, 80).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="lost"):
        run(dies_after_writing)
    run(dies_after_writing)
    assert sorted(r.id for r in store.load().plugin_rows.collect()) == list(range(80))


def test_compaction_and_vacuum(spark, store):
    for k in range(4):
        store.commit(lambda c, k=k: c.append("edges", c.spark.range(k, k + 1).select("id", F.lit(k % 2).alias("snapshot_id")), k % 2))
    store.compact("edges")
    assert len(store.manifest()["tables"]["edges"]) == 2
    gone = store.vacuum(1)
    assert len([g for g in gone if g.startswith("data/")]) == 4
    assert sorted((r.id, r.snapshot_id) for r in store.load().edges.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_a_crawl_and_its_second_run(spark, store):
    html = {"content-type": "text/html"}
    table = {"https://e.com/": ("/a", "/b"), "https://e.com/a": ("/",), "https://e.com/b": ()}

    def fetch(urls):
        from gossamer.sources.fetching import fetch_pages

        def send(u, headers):
            if u not in table:
                return {"status": 404}
            return {"status": 200, "headers": html, "body": "<body>" + "".join(f'<a href="{x}">x</a>' for x in table[u])}

        return fetch_pages(urls, send, retries=0)

    s1 = K.save_crawl(store, "e.com", crawling.crawl(spark, "https://e.com", fetch), created_at=at(1))
    table["https://e.com/a"] = ("/c",)
    s2 = K.save_crawl(store, "e.com", crawling.crawl(spark, "https://e.com", fetch), created_at=at(2))
    st = store.load()
    assert O.compare_counts(st, s1, s2).first().asDict() == {"added": 1, "removed": 0, "newly_broken": 1, "resolved": 0}
