"""Rules of the store's queries, on a small store made by hand."""

from __future__ import annotations

import pytest

from gossamer.operators import mutations as M
from gossamer.operators import store as O

ORIGIN, DOMAIN = "https://a.example.com", "a.example.com"


@pytest.fixture(scope="module")
def st(spark):
    """Two sites; site 1 has snapshots 1 to 4 (4 of a single page), site 2 only snapshot 9."""
    sites = spark.createDataFrame([(1, DOMAIN, "2024-01-01"), (2, "b.example.org", "2024-01-01")], "id long, domain string, created_at string")
    snapshots = spark.createDataFrame(
        [(1, 1, "completed", "completed", "2024-01-01", 3, 80.0, 1), (2, 1, "completed", "completed", "2024-01-02", 4, 70.0, None), (3, 1, "incremental", "completed", "2024-01-03", 4, None, 0), (4, 1, "single", "completed", "2024-01-04", 1, 50.0, 0), (9, 2, "completed", "completed", "2024-01-05", 1, 10.0, 0)],
        "id long, site_id long, run_type string, status string, created_at string, node_count long, health_score double, orphan_count long",
    )
    page = "id long, site_id long, normalized_url string, first_seen long, last_seen long, http_status long, canonical_url string, noindex int, redirect_chain string, security_error string, depth long, is_internal int, crawl_trap_flag int, content_hash string"
    rows = [
        (10, 1, "/only-first", 1, 1, 200), (11, 1, "/never-measured", 2, 2, 200), (12, 1, "/both", 1, 2, 200), (13, 1, "/gone", 1, 2, 404), (14, 1, "/new-broken", 2, 2, 500), (15, 1, "https://x.example.net/", 1, 2, 404), (16, 1, "https://a.example.com/abs", 1, 2, 200), (17, 1, "https://other.example.net/abs", 1, 2, 200), (90, 2, "/both", 9, 9, 500),
    ]
    pages = spark.createDataFrame([(*r, None, 0, None, None, 1, 0 if r[0] == 15 else 1, 0, f"h{r[0]}") for r in rows], page)
    metric = "snapshot_id long, page_id long, crawl_status string, word_count long, thin_content_score double, pagerank_score double, duplicate_cluster_id string, duplicate_type string, is_cluster_primary int, cluster_id long, link_role string, auth_score double, hub_score double"
    seen = [
        (1, 10, "fetched", 500, 0.0, 10.0), (1, 12, "network_error", 500, 0.0, 20.0), (1, 13, "fetched_error", 0, 0.0, 5.0), (1, 15, "fetched_error", 0, 0.0, 99.0),
        (2, 12, "fetched", 500, 0.0, 30.0), (2, 13, "fetched_error", 0, 0.0, 5.0), (2, 14, "fetched_error", 0, 0.0, 1.0), (2, 15, "fetched_error", 0, 0.0, 99.0), (2, 16, "fetched", 500, 0.0, 3.0), (2, 17, "fetched", 500, 0.0, 2.0), (4, 12, "fetched", 1, 0.0, 1.0), (9, 90, "fetched_error", 0, 0.0, 50.0),
    ]
    dup = {16: "near", 17: "near"}
    metrics = spark.createDataFrame([(*r, "c1" if r[1] in dup else None, dup.get(r[1], "none"), 0, None, "peripheral", 0.5, 0.25) for r in seen], metric)
    edges = spark.createDataFrame(
        [(1, 2, 13, 12, 1.0, "internal"), (2, 2, 16, 12, 1.0, "internal"), (3, 2, 12, 12, 1.0, "internal"), (4, 2, 12, 15, 1.0, "external"), (5, 2, 12, 13, 1.0, "nofollow"), (6, 2, 17, 12, 1.0, "external"), (7, 1, 10, 12, 1.0, "internal"), (8, 2, 12, 10, 1.0, "internal")],
        "id long, snapshot_id long, source_page_id long, target_page_id long, weight double, rel string",
    )
    plugin_rows = spark.createDataFrame([(1, 1, 10, "p", 1.0, 1.0, 0), (2, 2, 12, "p", 1.0, 1.0, 0)], "id long, snapshot_id long, url_id long, plugin string, score double, weight double, age_seconds long")
    return O.Store(sites, snapshots, pages, metrics, edges, plugin_rows)


def test_issues_are_of_internal_pages_of_the_site(st):
    got = {r.url: r.issue_type for r in O.issues(st, 2, ORIGIN).collect()}
    assert got == {"/both": "Page", "/gone": "Broken Link", "/new-broken": "Broken Link", "https://a.example.com/abs": "Duplicate Content", "https://other.example.net/abs": "Duplicate Content"}


def test_problems_keep_the_sites_own_absolute_urls(st):
    urls = lambda **kw: [r.url for r in O.issue_list(st, 2, ORIGIN, DOMAIN, **kw).collect()]
    assert urls() == ["/gone", "https://a.example.com/abs", "/new-broken"]
    assert urls(severity="Info") == ["/both", "https://a.example.com/abs", "https://other.example.net/abs"]
    assert urls(search="OTHER") == ["https://other.example.net/abs"]
    assert urls(search="abs", severity="All") == ["https://a.example.com/abs", "https://other.example.net/abs"]
    assert urls(limit=1, offset=1) == ["https://a.example.com/abs"]


def test_comparison(st):
    assert [r.url for r in O.newly_broken(st, 1, 2).collect()] == ["/new-broken"]
    assert [r.url for r in O.resolved(st, 1, 2).collect()] == ["/both"]
    assert O.compare_counts(st, 1, 2).first().asDict() == {"added": 3, "removed": 1, "newly_broken": 1, "resolved": 1}
    assert O.compare_view(st, 1, 1, 2).first().asDict() == {"added": 3, "removed": 1, "health_delta": -10.0, "new_broken": ["/new-broken"], "resolved_broken": ["/both"]}
    assert O.compare_view(st, 1, 1, 9).collect() == []
    assert O.compare_view(st, 1, 2, 3).first().health_delta == -70.0


def test_trends_are_of_one_site(st):
    rows = lambda **kw: sorted((r.id, r.orphans, r.broken, r.clusters) for r in O.trends(st, 1, **kw).collect())
    assert rows() == [(1, 1, 2, 0), (2, 0, 3, 1), (3, 0, 0, 0)]
    assert rows(include_single=True)[-1] == (4, 0, 0, 0)


def test_links_of_a_page(st):
    got = [(r.source_url, r.source_pagerank) for r in O.inlinks(st, 2, 12).collect()]
    assert got == [("/both", 30.0), ("/gone", 5.0), ("https://a.example.com/abs", 3.0)]
    assert [(r.target_url, r.status, r.follow) for r in O.outlinks(st, 2, 12).collect()] == [("/gone", 404, 0), ("https://x.example.net/", 404, 1), ("/both", 200, 1), ("/only-first", 200, 1)]
    assert [r.source_url for r in O.inlinks(st, 2, 12, limit=1, offset=2).collect()] == ["https://a.example.com/abs"]


@pytest.mark.parametrize("url", ["/both", "/both/", "https://a.example.com/both", "https://a.example.com/both/"])
def test_page_view_resolves_every_form(st, url):
    assert O.page_view(st, 2, 1, ORIGIN, url).first().asDict() == {"id": 12, "url": "/both", "http_status": 200, "depth": 1, "pagerank_score": 30.0, "auth_score": 0.5, "hub_score": 0.25, "inlinks": 3, "outlinks": 2, "latest_snapshot": 4}


def test_page_view_of_an_unknown_url_is_empty(st):
    assert O.page_view(st, 2, 1, ORIGIN, "/nowhere").collect() == []
    assert [r.url for r in O.page_cluster(st, 2, 16).collect()] == ["https://other.example.net/abs"]
    assert O.page_cluster(st, 2, 12).collect() == []


def test_top_pages_and_depths_leave_external_pages_out(st):
    assert [r.url for r in O.top_pages(st, 2, 2).collect()] == ["/both", "/gone"]
    assert "https://x.example.net/" not in {r.url for r in O.depth_places(st, 2).collect()}


def test_neighbourhood_and_equity_are_over_internal_links(st):
    got = {(r.direction, r.url, r.score) for r in O.neighbourhood(st, 2).where("page = 12").collect()}
    assert got == {("in", "/both", 30.0), ("in", "/gone", 5.0), ("in", "https://a.example.com/abs", 3.0), ("out", "/both", 30.0), ("out", "/only-first", None)}
    assert {r.id: r.equity for r in O.equity(st, 2).collect()}[12] == pytest.approx(2 / 3, abs=1e-6)


def test_deleted_snapshot_takes_only_pages_that_nothing_names(st):
    out = M.delete_snapshot(1, st.snapshots, st.pages, st.edges, st.metrics, st.plugin_rows)
    assert {r.id: (r.first_seen, r.last_seen) for r in out["pages"].where("id in (10, 11, 12)").collect()} == {11: (2, 2), 12: (None, 2)}
    assert out["metrics"].where("snapshot_id = 1 or page_id = 10").count() == 0
    assert sorted(r.id for r in out["edges"].collect()) == [1, 2, 3, 4, 5, 6]
    assert [r.id for r in out["plugin_rows"].collect()] == [2]


def test_the_only_snapshot_of_a_site_stays(st):
    M.may_delete_snapshot(st.snapshots, 1, 2)
    with pytest.raises(ValueError, match="only snapshot"):
        M.may_delete_snapshot(st.snapshots, 2, 9)
    with pytest.raises(LookupError):
        M.may_delete_snapshot(st.snapshots, 2, 1)


def test_replayed_links_leave_out_links_to_oneself(spark):
    answers = spark.createDataFrame([(1, 304, None)], "id long, status int, words long")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    before, old = spark.createDataFrame([(1, 5)], "id long, words long"), spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    _, links = M.incremental(answers, none, before, old)
    assert [tuple(r) for r in links.collect()] == [(1, 2, 1.0)]


def test_similar_titles_equal_all_pairs(spark):
    import random

    from gossamer.operators.duplicates import similar_titles

    rng = random.Random(4)
    words = [f"w{k}" for k in range(14)]
    rows = [(i, ["common", *rng.sample(words, rng.randint(1, 6))]) for i in range(120)] + [(200, []), (201, ["common"]), (202, ["common"]), (203, None)]
    sets = [(i, set(t or [])) for i, t in rows]
    for least in (0.5, 0.7, 0.8):
        want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) / len(x | y) >= least}
        got = [tuple(r) for r in similar_titles(spark.createDataFrame(rows, "id long, tokens array<string>"), least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_reset_empties_every_table(st):
    empty = O.reset(st)
    assert all(getattr(empty, n).count() == 0 and getattr(empty, n).columns == getattr(st, n).columns for n in ("sites", "snapshots", "pages", "metrics", "edges", "plugin_rows"))


def test_graph_files_are_read(spark, tmp_path):
    import json

    from gossamer.sources.connectors import read_graph_json

    path = tmp_path / "g.json"
    path.write_text(json.dumps({"nodes": [{"url": "a", "depth": 0, "status": 200}, {"url": "b"}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a", "weight": 0.4}]}, indent=1))
    g = read_graph_json(spark, str(path))
    assert sorted(map(tuple, g.nodes.collect())) == [("a", 0, 200), ("b", None, None)]
    assert sorted(map(tuple, g.edges.collect())) == [("a", "b", 1.0), ("b", "a", 0.4)]
    path.write_text('{"nodes": []}')
    assert read_graph_json(spark, str(path)).edges.collect() == []


def test_plugins_are_found_by_their_entry_points(monkeypatch):
    from gossamer import plugins as P

    class Entry:
        def load(self):
            return P.Plugin("found")

    monkeypatch.setattr(P, "entry_points", lambda group: [Entry()] if group == "gossamer.plugins" else [])
    r = P.Registry()
    r.discover()
    assert list(r.plugins) == ["found"]
    with pytest.raises(ValueError, match="named found"):
        r.discover()
