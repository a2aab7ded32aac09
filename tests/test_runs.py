"""Whole runs with plugins: order, scope, failures, policies and scores."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gossamer.plugins import Plugin, Registry, exporter_plugin
from gossamer.sources import committed, crawling, runs
from gossamer.sources.fetching import fetch_pages

SITE = "https://e.com"
PAGES = {"/": ("/a", "/b", "/private"), "/a": ("/", "/b"), "/b": ("/a", "/c"), "/c": (), "/private": ("/hidden",)}


def fetch(urls):
    def send(u, headers):
        path = u.removeprefix(SITE)
        if path not in PAGES:
            return {"status": 404}
        return {"status": 200, "headers": {"content-type": "text/html"}, "body": "<html><body><h1>t</h1><p>" + "word " * 250 + "</p>" + "".join(f'<a href="{x}">x</a>' for x in PAGES[path]) + "</body></html>"}

    return fetch_pages(urls, send, retries=0)


@pytest.fixture
def store(spark, tmp_path):
    return committed.CommittedStore(spark, f"file://{tmp_path}/store")


def test_four_plugins_in_one_run_one_of_which_fails(spark, store, tmp_path):
    calls = []
    note = lambda name, hook, out=None: lambda *a: (calls.append((name, hook)), out(*a) if out else None)[1]
    scores = Plugin("scores", scores=True, hooks={
        "on_init": note("scores", "on_init"), "on_page_parsed": note("scores", "on_page_parsed", lambda ctx, parsed: parsed.select("url", (F.size("parsed.links") * 10.0).alias("score"))),
        "on_metrics": note("scores", "on_metrics"), "on_report": note("scores", "on_report"), "on_page": note("scores", "on_page"),
    })
    fails = Plugin("fails", hooks={
        "on_init": note("fails", "on_init", lambda ctx: 1 / 0), "on_graph_built": note("fails", "on_graph_built"),
        # what fails only when rows are worked out
        "on_metrics": lambda ctx, g: g.nodes.select(F.col("id").alias("url_id"), F.raise_error(F.lit("late")).cast("double").alias("score")),
    })
    policy = Plugin("policy", hooks={"on_crawl_start": note("policy", "on_crawl_start", lambda ctx: ctx.policy.update(depth=2)), "should_enqueue": lambda url, depth: F.when(url == "/c", F.lit(False))})
    out = str(tmp_path / "out")
    run = runs.run_crawl(spark, store, SITE, fetch, Registry([scores, fails, policy, exporter_plugin("json", out)]), robots="User-agent: *\nDisallow: /private")
    order = ["on_init", "on_crawl_start", "on_page_parsed", "on_graph_built", "on_metrics", "on_report"]
    assert [h for _, h in calls] == sorted((h for _, h in calls), key=order.index) and {h for _, h in calls} == set(order)
    assert [(p, h) for p, h, _ in run.failures] == [("fails", "on_init"), ("fails", "on_metrics")] and "late" in run.failures[1][2]
    st = store.load()
    pages = {r.normalized_url: r.id for r in st.pages.collect()}
    assert set(pages) == {"/", "/a", "/b", "/c", "/private"}
    status = {r.page_id: r.crawl_status for r in st.metrics.collect()}
    assert {u: status.get(i) for u, i in pages.items()} == {"/": "fetched", "/a": "fetched", "/b": "fetched", "/c": None, "/private": "blocked_by_robots"}
    assert {r.url_id: r.score for r in st.plugin_rows.where("plugin = 'scores'").collect()} == {pages["/"]: 30.0, pages["/a"]: 20.0, pages["/b"]: 20.0}
    assert st.plugin_rows.where("plugin = 'fails'").count() == 0
    row = st.snapshots.first()
    assert row.total_score == pytest.approx((row.health_score * 100 + 70) / 103, abs=0.06) and 0 < row.health_score <= 100
    ranked = {r.page_id: r.pagerank_score for r in st.metrics.collect()}
    assert ranked[pages["/"]] is not None and ranked[pages["/private"]] is None
    assert all(json.loads(r.value) for r in spark.read.text(f"{out}/graph-nodes.json").collect())


@pytest.mark.parametrize("hook", ["on_init", "on_crawl_start"])
def test_a_plugin_may_end_the_run_before_the_crawl(spark, store, hook):
    stop = Plugin("stop", hooks={hook: lambda ctx: setattr(ctx, "terminate", True)})
    run = runs.run_crawl(spark, store, SITE, lambda u: 1 / 0, Registry([stop]))
    assert run.snapshot_id == 0 and store.versions() == []


def test_policy_that_is_no_option_is_refused(spark, store):
    odd = Plugin("odd", hooks={"on_crawl_start": lambda ctx: ctx.policy.update(colour="red")})
    with pytest.raises(ValueError, match="colour"):
        runs.run_crawl(spark, store, SITE, fetch, Registry([odd]))


def test_hooks_of_the_other_scope_are_passed_over():
    seen = []
    r = Registry([Plugin("p", hooks={"on_page": lambda *a: seen.append("page"), "on_report": lambda *a: seen.append("report"), "on_init": lambda *a: seen.append("init")})])
    for scope in ("page", "crawl"):
        for hook in ("on_init", "on_page", "on_report"):
            runs.call(r, hook, runs.Context("u", scope), None)
    assert seen == ["init", "page", "init", "report"]


def test_second_run_is_a_second_snapshot(spark, store):
    one = runs.run_crawl(spark, store, SITE, fetch)
    two = runs.run_crawl(spark, store, SITE, fetch)
    st = store.load()
    assert (one.snapshot_id, two.snapshot_id) == (1, 2)
    scores = {(r.snapshot_id, r.page_id): r.pagerank_score for r in st.metrics.collect()}
    assert {p: s for (n, p), s in scores.items() if n == 1} == {p: s for (n, p), s in scores.items() if n == 2}
    totals = {r.id: (r.health_score, r.total_score) for r in st.snapshots.collect()}
    assert totals[1] == totals[2]
