"""The crawl loop against one plain queue."""

from __future__ import annotations

import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from gossamer.functions.html_udf import parse_page
from gossamer.functions.url import normalize_one
from gossamer.plugins import Plugin, Registry
from gossamer.sources import crawling
from gossamer.sources.fetching import FETCHED, fetch_one, fetch_pages

SITE = "https://s.example.com"
HTML = {"content-type": "text/html; charset=utf-8"}


def answers() -> dict[str, dict]:
    """A site with a tree, cycles, redirects, errors, other hosts, other types and rules for robots."""
    page = lambda *links, head="": {"status": 200, "headers": HTML, "body": f"<html><head>{head}</head><body><p>{'word ' * len(links)}</p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body></html>"}
    out = {f"{SITE}/n/{k}": page(f"/n/{2 * k + 1}", f"/n/{2 * k + 2}/", f"{SITE}/n/{k // 2}?utm_source=x", "/n/0#top") for k in range(40)}
    out |= {
        f"{SITE}/": page("/n/0", "/old", "/text", "/gone", "/private/a", "https://else.example.org/x", "/loop", "/moved-out", "/hidden", "/away", "mailto:x@example.com", "/", "/empty", "/n/3"),
        f"{SITE}/old": {"status": 301, "headers": {"location": "/older"}}, f"{SITE}/older": {"status": 302, "headers": {"location": "/n/30"}},
        f"{SITE}/text": {"status": 200, "headers": {"content-type": "text/plain"}, "body": "<a href='/never'>x</a>"}, f"{SITE}/gone": {"status": 404, "headers": HTML, "body": "no"},
        f"{SITE}/private/a": page("/private/b"), f"{SITE}/private/b": page(), f"{SITE}/loop": {"status": 301, "headers": {"location": "/loop"}},
        f"{SITE}/moved-out": {"status": 301, "headers": {"location": "https://else.example.org/landing"}}, "https://else.example.org/landing": page("https://s.example.com/n/39", "/own"),
        f"{SITE}/hidden": page("/n/38", head='<meta name="robots" content="noindex, nofollow">'), f"{SITE}/empty": {"status": 204, "headers": HTML}, f"{SITE}/seeded": page("/n/37"), f"{SITE}/deep": page("/deeper"),
    }
    return out


def sender(table, asked=None):
    def send(url, headers):
        if asked is not None:
            with open(asked, "a") as f:
                f.write(url + "\n")
        if url not in table:
            raise OSError(url)
        r = table[url]
        if headers.get("If-None-Match") and r.get("etag") == headers["If-None-Match"]:
            return {"status": 304}
        return {**r, "headers": {**(r.get("headers") or {}), **({"etag": r["etag"]} if r.get("etag") else {})}}

    return send


def plain(table, start, limit=500, depth=5, blocked=lambda p: False, ignore=False, sitemap=(), refuse=lambda u, d: False, site=SITE, get=None):
    """One queue, one page at a time."""
    store = lambda u: re.sub(rf"^{site}(?=/)", "", u)
    get = get or (lambda u: fetch_one(u, sender(table), retries=0))
    queue, seen, pages, edges, visits, reached = deque(), set(), {}, [], [], False

    def page(u, d, status=0):
        old = pages.get(u)
        pages[u] = (min(d, old[0]), status or old[1]) if old else (d, status)

    def put(u, d):
        if u not in seen and (u.startswith("/")):
            seen.add(u)
            queue.append((u, d))
            page(u, d)

    put(store(normalize_one(start)), 0)
    for u in sitemap:
        put(store(normalize_one(u, site)), 0)
    metrics = {}
    while queue:
        if len(visits) >= limit:
            reached = True
            break
        u, d = queue.popleft()
        no = blocked(u)
        visits.append(u)
        if no:
            metrics[u] = "blocked_by_robots"
            if not ignore:
                continue
        r = get(site + u)
        final = store(normalize_one(r["final_url"]))
        for hop in r["redirect_chain"]:
            a, b = store(normalize_one(hop["url"])), store(normalize_one(hop["target"]))
            page(a, d, hop["status"])
            page(b, d)
            edges.append((a, b, "internal" if b.startswith("/") else "external"))
        if r["status"] is None or r["status"] >= 300:
            page(final, d, r["status"] or 0)
            metrics[final] = r["state"] or "fetched_error"
        elif r["status"] == 200:
            page(final, d, 200)
            if "text/html" in r["headers"].get("content-type", ""):
                metrics[final] = "blocked_by_robots" if no else "fetched"
                for x in parse_page(r["body"], normalize_one(r["final_url"]))["links"]:
                    t = store(x["url"])
                    if t == final:
                        continue
                    page(t, d + 1)
                    edges.append((final, t, "internal" if t.startswith("/") else "external"))
                    if t.startswith("/") and d + 1 <= depth and not refuse(t, d + 1):
                        put(t, d + 1)
    return pages, sorted(edges), visits, metrics, reached


def same(c, want):
    pages, edges, visits, metrics, reached = want
    assert [r.url for r in c.visits.orderBy("depth", "place").collect()] == visits
    assert {r.url: (r.depth, r.status) for r in c.pages.collect()} == pages
    assert sorted((r.src, r.dst, r.rel) for r in c.edges.collect()) == edges
    assert {r.url: r.crawl_status for r in c.metrics.collect()} == metrics
    assert (c.crawled, c.limit_reached) == (len(visits), reached)


@pytest.fixture
def fetch():
    return lambda urls: fetch_pages(urls, sender(answers()), retries=0)


ROBOTS = "User-agent: *\nDisallow: /private\nDisallow: /n/1"


@pytest.mark.parametrize("kw", [{}, {"limit": 1}, {"limit": 7}, {"limit": 15, "depth": 2}, {"depth": 0}, {"depth": 3, "ignore_robots": True}], ids=str)
def test_crawl_equals_a_plain_queue(spark, fetch, kw):
    sitemap = spark.createDataFrame([("/seeded", 1), (f"{SITE}/deep", 0), ("https://else.example.org/y", 2), ("/n/0", 3)], "loc string, place int")
    c = crawling.crawl(spark, SITE, fetch, crawling.Options(**kw), ROBOTS, sitemap)
    ignore = kw.pop("ignore_robots", False)
    # /n/1 is a prefix, so /n/10 to /n/19 are blocked as well
    same(c, plain(answers(), SITE, blocked=lambda p: p.startswith(("/private", "/n/1")), ignore=ignore, sitemap=[f"{SITE}/deep", "/seeded", "/n/0"], **kw))


def test_plugins_may_refuse_urls(spark, fetch):
    even = Plugin("even", hooks={"should_enqueue": lambda url, depth: F.when(url.rlike("[02468]$"), F.lit(False))})
    c = crawling.crawl(spark, SITE, fetch, crawling.Options(registry=Registry([even])))
    same(c, plain(answers(), SITE, refuse=lambda u, d: u[-1] in "02468"))


def test_archive_answers_like_the_transport(spark):
    rows = [fetch_one(u, sender(answers()), retries=0) for u in [*answers(), f"{SITE}/never"]]
    archive = spark.createDataFrame([tuple(r[k] for k in ("url", "status", "state", "final_url", "redirect_chain", "etag", "last_modified", "retries", "bytes", "headers", "body")) for r in rows], FETCHED)
    same(crawling.crawl(spark, SITE, crawling.from_archive(archive)), plain(answers(), SITE))


def test_stopped_crawl_goes_on_and_fetches_nothing_twice(spark, tmp_path):
    asked, folder = str(tmp_path / "asked"), str(tmp_path / "crawl")
    calls = []

    def stops(urls):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("the driver is lost")
        return fetch_pages(urls, sender(answers(), asked), retries=0)

    with pytest.raises(RuntimeError):
        crawling.crawl(spark, SITE, stops, folder=folder)
    before = open(asked).read().split()
    assert before
    c = crawling.crawl(spark, SITE, stops, folder=folder)
    want = plain(answers(), SITE)
    same(c, want)
    later = open(asked).read().split()[len(before) :]
    requested = {SITE + u for u in want[2]}
    assert not {u for u in later if u in requested} & {u for u in before if u in requested} - {f"{SITE}/older", f"{SITE}/n/30", f"{SITE}/loop"}
    # a third run finds everything done
    again = crawling.crawl(spark, SITE, lambda urls: 1 / 0, folder=folder)
    same(again, want)


def test_second_crawl_keeps_what_has_not_changed(spark):
    table = answers()
    for k in range(3):
        table[f"{SITE}/n/{k}"]["etag"] = f"e{k}"
    fetch = lambda urls: fetch_pages(urls, sender(table), retries=0)
    one = crawling.crawl(spark, SITE, fetch)
    before = one.pages.join(one.metrics, "url", "left")
    two = crawling.crawl(spark, SITE, fetch, previous=(before, one.edges.where("rel = 'internal'").select("src", "dst")))
    a, b = ({r.url: r.crawl_status for r in c.metrics.collect()} for c in (one, two))
    assert {u for u in a if a[u] != b[u]} == {"/n/0", "/n/1", "/n/2"} and b["/n/1"] == "cached"
    facts = lambda c: sorted((r.url, r.depth, r.status, r.content_hash, r.etag) for r in c.pages.collect())
    assert facts(one) == facts(two)
    words = lambda c: {r.url: r.word_count for r in c.metrics.collect()}
    assert words(one) == words(two)
    assert sorted(set(tuple(r) for r in one.edges.select("src", "dst").collect())) == sorted(set(tuple(r) for r in two.edges.select("src", "dst").collect()))


def test_crawls_over_pages_equal_a_plain_queue(spark):
    from gossamer.plans import run_queries as Q

    sf = "/root/testdata/sf0.01"
    rows = {r.url: r.asDict(recursive=True) for r in Q.site_archive(spark, sf).collect()}
    lost = lambda u: {"url": u, "status": None, "state": "network_error", "final_url": u, "redirect_chain": [], "headers": {}, "body": None}
    seeds = [f"/p/{k}" for k in range(3, 250, 50)]
    rule = lambda p: p.startswith("/p/7") and not p.startswith("/p/77")
    for limit in (120, 1_000_000):
        want = plain(None, f"{Q.SITE}/p/0", limit, 3, rule, sitemap=seeds, site=Q.SITE, get=lambda u: rows.get(u) or lost(u))
        same(Q.site_crawl(spark, sf, limit=limit), want)
        if limit == 120:
            got = Q.QUERIES["g2_crawl_visits"](spark, sf).orderBy("turn").collect()
            assert [r.url for r in got] == want[2]


def test_queries_can_be_left_out(spark):
    table = {f"{SITE}/": {"status": 200, "headers": HTML, "body": '<body><a href="/a?x=1">x</a><a href="/a?x=2">y</a><a href="/r?z=1">z</a></body>'}, f"{SITE}/a": {"status": 200, "headers": HTML, "body": "<body></body>"}, f"{SITE}/r": {"status": 301, "headers": {"location": "/a?from=r"}}}
    table[f"{SITE}/a?from=r"] = table[f"{SITE}/a"]
    c = crawling.crawl(spark, f"{SITE}/?q=1", lambda urls: fetch_pages(urls, sender(table), retries=0), crawling.Options(strip_query=True))
    assert {r.url: (r.depth, r.status) for r in c.pages.collect()} == {"/": (0, 200), "/a": (1, 200), "/r": (1, 301)}
    assert sorted({(r.src, r.dst) for r in c.edges.collect()}) == [("/", "/a"), ("/", "/r"), ("/r", "/a")]


def test_start_that_is_no_address(spark, fetch):
    with pytest.raises(ValueError, match="no address"):
        crawling.crawl(spark, "mailto:x", fetch)
