"""Fetching, exports, plugin tables, limiters, and paths that depend on size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.functions.html_udf import parse_page
from gossamer.operators import duplicates as D
from gossamer.operators import ranking as R
from gossamer.operators.graph import SiteGraph
from gossamer.plugins import Namespace, Plugin, Registry, exporter_plugin, pagespeed_plugin, reporter_plugin
from gossamer.session import is_local, unset
from gossamer.sources import exports, fetching
from gossamer.streaming import limiter as L

# -- fetching -------------------------------------------------------------------------------------


def answers(table, log):
    """A transport that answers from a table of lists, one entry a request."""

    def send(url, headers):
        log.append((url, dict(headers)))
        r = table[url].pop(0) if len(table[url]) > 1 else table[url][0]
        if isinstance(r, Exception):
            raise r
        return r

    return send


def test_fetch_follows_redirects_and_sends_conditions_once():
    log, waits = [], []
    page = {"status": 200, "headers": {"ETag": "x", "Last-Modified": "y"}, "body": "hi é"}
    send = answers({"http://a/": [{"status": 302, "headers": {"location": "/b#f"}}], "http://a/b#f": [{"status": 503}, ConnectionError("reset"), page]}, log)
    got = fetching.fetch_one("http://a/", send, "e0", "m0", sleep=waits.append)
    assert (got["status"], got["state"], got["final_url"], got["etag"], got["last_modified"], got["bytes"], got["retries"]) == (200, None, "http://a/b#f", "x", "y", 5, 2)
    assert got["redirect_chain"] == [{"url": "http://a/", "status": 302, "target": "http://a/b#f"}]
    assert log[0][1] == {"If-None-Match": "e0", "If-Modified-Since": "m0"} and all(h == {} for _, h in log[1:])
    assert len(waits) == 2 and 0.45 <= waits[0] <= 0.55 and 0.9 <= waits[1] <= 1.1


@pytest.mark.parametrize(
    ("table", "state"),
    [
        ({"http://a/": [{"status": 301, "headers": {"location": "http://a/#x"}}]}, "redirect_loop"),
        ({f"http://a/{i or ''}": [{"status": 301, "headers": {"location": f"http://a/{i + 1}"}}] for i in range(9)}, "redirect_limit_exceeded"),
        ({"http://a/": [{"status": 200, "body": b"x" * 101}]}, "oversized"),
        ({"http://a/": [{"status": 500}]}, "failed_after_retries"),
        ({"http://a/": [ValueError("odd")]}, "network_error"),
        ({"http://a/": [ConnectionRefusedError()]}, "proxy_connection_failed"),
        ({"http://a/": [fetching.Blocked()]}, "blocked_internal_ip"),
    ],
)
def test_fetch_outcomes_without_a_status(table, state):
    got = fetching.fetch_one("http://a/", answers(table, []), max_bytes=100, sleep=lambda s: None)
    assert got["state"] == state and got["status"] is None


def test_scope_stops_a_redirect_and_304_has_no_body():
    send = answers({"http://a/": [{"status": 301, "headers": {"location": "http://b/"}}], "http://c/": [{"status": 304, "body": "x"}]}, [])
    got = fetching.fetch_one("http://a/", send, scope=lambda u: "allowed" if "//a" in u else "blocked_by_domain_filter")
    assert got["state"] == "blocked_by_domain_filter" and len(got["redirect_chain"]) == 1
    assert fetching.fetch_one("http://c/", send)["body"] == ""


def test_resolver_prefers_https_then_http_and_remembers():
    only_http = answers({"https://a.com/": [OSError()], "http://a.com/": [{"status": 200, "body": ""}]}, [])
    assert fetching.resolve("a.com", only_http) == ("http://a.com/", "http://a.com/")
    assert fetching.resolve("a.com", only_http, "https://www.a.com/") == ("https://www.a.com/",) * 2
    assert fetching.resolve("http://a.com/x", only_http) == ("http://a.com/x", "http://a.com/x")
    assert fetching.resolve("a.com", answers({"https://a.com/": [OSError()], "http://a.com/": [OSError()]}, [])) == ("https://a.com", None)


def test_a_host_is_asked_no_faster_than_its_rate(spark, tmp_path):
    log = str(tmp_path / "log")

    def send(u, headers):
        import time

        with open(log, "a") as f:
            f.write(f"{time.time():.4f} {u}\n")
        return {"status": 200, "headers": {}, "body": ""}

    urls = spark.createDataFrame([(f"http://h{k % 2}.com/{k}",) for k in range(10)], "url string").repartition(5)
    assert fetching.fetch_pages(urls, send, rate=1.0, crawl_delay=0.2).where("status = 200").count() == 10
    times: dict[str, list[float]] = {}
    for line in open(log):
        t, u = line.split()
        times.setdefault(u[7:9], []).append(float(t))
    # one second apart: the crawl delay is the shorter of the two
    assert all(b - a > 0.9 for ts in times.values() for a, b in zip(sorted(ts), sorted(ts)[1:]))
    both = sorted(t for ts in times.values() for t in ts)
    assert both[-1] - both[0] < 8


def test_pagespeed_is_tried_three_times():
    waits, log = [], []
    url = "https://www.googleapis.com/pagespeedonline/v5/runPagespeed?url=u&key=k&strategy=mobile"
    assert fetching.pagespeed_report("u", "k", answers({url: [{"status": 500}, {"status": 500}, {"status": 200, "body": "{}"}]}, log), sleep=waits.append) == "{}"
    assert len(log) == 3 and waits == [0.5, 1.0]


def test_probe_summary(spark):
    probe = '{"url":"https://a/","tls":{"protocol":"TLSv1.3","authorized":true,"validTo":"2030-01-31T00:00:00Z"},"http":{"version":"2","encoding":"br"},"timing":{"ttfb":12.5},"redirects":["a"],"size":77,"dns":{"a":["1"],"aaaa":["2"]}}'
    r = spark.createDataFrame([(probe,), ("{}",)], "p string").select(fetching.probe_summary(F.col("p")).alias("s")).select("s.*", fetching.days_left(F.col("s.valid_to"), F.lit("2030-01-01 12:00:00")).alias("days")).collect()
    assert (r[0]["tls"], r[0]["https"], r[0]["cert_ok"], r[0]["h2"], r[0]["compressed"], r[0]["ttfb"], r[0]["redirects"], r[0]["size"], r[0]["ipv6"], r[0]["ips"], r[0]["days"]) == (1.3, True, True, True, True, 12.5, 1, 77, True, 2, 29)
    assert r[1]["tls"] is None and r[1]["ips"] == 0 and r[1]["ipv6"] is False


def test_probes_of_sites_are_audited(spark):
    def resolve(name, kind):
        table = {("a.com", "a"): ["93.1.1.1", "93.1.1.2"], ("a.com", "aaaa"): ["2001:db8::1"], ("93.1.1.1", "ptr"): ["host.a.com"], ("b.com", "a"): ["93.1.1.3"]}
        if (name, kind) not in table:
            raise OSError(name)
        return table[name, kind]

    def send(u):
        good = {"strict-transport-security": "max-age=63072000; includeSubDomains", "content-security-policy": "default-src 'self'", "x-frame-options": "DENY", "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "permissions-policy": "x", "content-encoding": "br"}
        if u == "http://a.com/":
            return {"status": 301, "headers": {"Location": "https://a.com/"}, "timings": {"total": 40.0}}
        if u == "https://a.com/":
            return {"status": 200, "headers": good, "body": "é" * 10, "version": "2.0", "tls": {"protocol": "TLSv1.3", "authorized": True, "validTo": "2030-06-01T00:00:00Z"}, "timings": {"ttfb": 100.0, "total": 120.0}}
        if u.startswith("http://loop.com"):
            return {"status": 302, "headers": {"location": u + "x"}}
        if u == "http://b.com/":
            return {"status": 200, "headers": {}, "body": "x" * (2 << 20), "timings": {"ttfb": 900.0, "total": 950.0}}
        if u == "http://c.com/":
            return {"status": 301, "headers": {"location": "http://10.0.0.1/"}}
        raise OSError(u)

    urls = spark.createDataFrame([(f"http://{h}.com/",) for h in ("a", "b", "c", "loop", "down")], "url string")
    probes = fetching.probe_sites(urls, resolve, send, inside=lambda host: host.startswith("10."))
    import json

    a = json.loads(probes.where("url = 'http://a.com/'").first().probe)
    assert a["dns"] == {"a": ["93.1.1.1", "93.1.1.2"], "aaaa": ["2001:db8::1"], "cname": [], "reverse": ["host.a.com"]} and a["url"] == "https://a.com/" and a["size"] == 20
    assert a["redirects"] == [{"url": "http://a.com/", "status": 301, "location": "https://a.com/"}] and a["timing"] == {"ttfb": 100.0, "total": 160.0, "redirects": 40.0}
    got = {r.url[7:-5]: r for r in fetching.audit_sites(probes, F.lit("2030-01-01 00:00:00")).collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": None, "c": "blocked_internal_ip", "loop": "too_many_redirects", "down": "network_error"}
    assert got["a"].grade == "A" and got["a"].issues == []
    assert got["b"].score <= 39 and {"no-https", "hsts-missing", "no-h2", "slow-ttfb", "large-html", "no-ipv6", "single-ip"} <= set(got["b"].issues)
    assert got["down"].score is None and got["down"].issues is None


# -- the parser -----------------------------------------------------------------------------------


def test_parser_reads_attributes_however_they_are_quoted():
    p = parse_page("<title> A  b </title><meta name=description content='d'><body><h1>x <b>y</b></h1><h1> </h1><a href=/a>1</a><a href='http://o.com/' rel=nofollow>2</a><a href=\"mailto:x\">3</a><img src=1><img alt=' '><img alt=\"t\">", "http://www.e.com/p")
    assert (p["title"], p["description"], p["h1s"], p["images"], p["missing_alts"], p["blank_alts"]) == ("A b", "d", ["x y"], 3, 1, 1)
    assert (p["internal_links"], p["external_links"], p["nofollow_links"]) == (1, 1, 1)


# -- exports --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crawl(spark):
    nodes = spark.createDataFrame([(1, "/", 0, 200, 1, 2, 90.0, "<p>"), (2, "/<a>", 1, 0, 2, 0, 10.0, None), (3, "/b,c", 1, 404, 0, 1, None, None)], "id long, url string, depth int, status int, in_links long, out_links long, score double, html string")
    edges = spark.createDataFrame([("/", "/<a>", 1.0), ("/", "/b,c", 0.5)], "src string, dst string, weight double")
    metrics = spark.createDataFrame([(3, 3, 1, 2 / 3, 1.0, 1)], "pages long, edges long, max_depth int, avg_depth double, efficiency double, orphans long")
    counts = spark.createDataFrame([(1, 0)], "broken_links long, redirect_chains long")
    return nodes, edges, metrics, counts


def test_crawl_exports_of_every_format(spark, crawl, tmp_path):
    nodes, edges, metrics, counts = crawl
    report = exports.insight(metrics, counts)
    assert report.first()["critical"] and not exports.insight(metrics, counts.withColumn("broken_links", F.lit(0))).first()["critical"]
    path = f"file://{tmp_path}/x"
    done = Registry([exporter_plugin("JSON, csv,markdown,html", path), reporter_plugin()]).run("on_report", "crawl", "http://e/", nodes, edges, metrics, report)
    assert set(done) == {"exporter", "reporter"} and len(done["exporter"]) == 8
    assert spark.read.json(f"{path}/graph-nodes.json").count() == 3
    csv = spark.read.option("header", "true").option("escape", '"').csv(f"{path}/nodes.csv").orderBy("URL").collect()
    assert [r["Status"] for r in csv] == ["200", "Pending/Limit", "404"] and csv[2]["URL"] == "/b,c"
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/summary.md").collect())
    assert "Average depth: 0.67" in text and "1. /<a> (2)" in text and "1. / (90.000)" in text
    page = "\n".join(r[0] for r in spark.read.text(f"{path}/report.html").collect())
    assert "\\u003ca>" in page and "<p>" not in page and page.count("<script") == 1
    assert exports.export_formats(True) == ["json"] and exports.export_formats(None) == []
    with pytest.raises(ValueError):
        exports.export_crawl(["pdf"], path, "u", nodes, edges, metrics, report)


def test_analysis_exports(spark, tmp_path):
    rows = [("http://e/1", 88.5, 10.0, 0, 'say "x"', "ok", None, "missing", 300, 9, 0.12345, 3, 1, None, 1, 2, 0), ("http://e/<2>", 10.0, 90.0, 200, None, "missing", "d", "ok", 5, 1, 0.5, 0, 2, "http://e/1", 0, 0, 0)]
    pages = spark.createDataFrame(rows, "url string, seo double, thin double, status int, title string, title_status string, description string, description_status string, words int, sentences int, ratio double, internal_links int, external_links int, canonical string, images int, missing_alts int, n_h1 int")
    assert exports.analysis_lines(pages).orderBy("line").first()[0] == 'http://e/1,88.5,10.0,Pending/Limit,"say ""x""",7,"",0,300,3,1,'
    masked = exports.mask_modules(pages, {"seo": False, "content": False}).orderBy("url").first()
    assert (masked["title"], masked["title_status"], masked["words"], masked["ratio"], masked["images"]) == (None, "missing", 0, 0.0, 1)
    short = exports.drop_modules(pages, {"accessibility": False})
    assert "images" not in short.columns and short.orderBy("url").first()["ratio"] == 0.123
    assert exports.export_analysis(["json", "csv", "markdown", "html"], f"file://{tmp_path}/a", pages) == ["json", "csv", "markdown", "html"]
    page = "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/a/analysis.html").collect())
    assert "http://e/&lt;2&gt;" in page and "2 pages" in page
    assert "| http://e/1 | 88.5 |" in "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/a/analysis.md").collect())


def test_reports_of_many_pages_are_whole(spark, tmp_path):
    nodes = spark.range(25).select("id", F.concat(F.lit("/"), F.col("id")).alias("url"), F.lit(1).alias("depth"), F.lit(200).alias("status"), F.lit(1).alias("in_links"), F.lit(1).alias("out_links"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).cast("double").alias("score"), F.lit("<p>").alias("html"))
    metrics = spark.createDataFrame([(25, 3)], "pages long, edges long")
    path = f"file://{tmp_path}/x"
    assert exports.export_crawl(["html"], path, "http://e/", nodes, None, metrics, None, shown=10) == ["report.html", "report-pages"]
    import json
    import re

    read = lambda folder: [r[0] for r in spark.read.option("wholetext", "true").text(f"{path}/{folder}").collect()]
    parts = [json.loads(re.search(r"json>(.*?)</script>", t, re.S).group(1))["nodes"] for t in read("report-pages")]
    assert all(1 <= len(p) <= 10 for p in parts) and sorted(n["id"] for p in parts for n in p) == list(range(25))
    key = lambda n: (n["score"] is None, -(n["score"] or 0), n["url"])
    assert all([key(n) for n in p] == sorted(key(n) for n in p) for p in parts) and all("html" not in n for p in parts for n in p)
    pages = nodes.select("url", F.lit(1.0).alias("seo"), F.lit(2.0).alias("thin"), F.lit("ok").alias("title_status"), F.lit("ok").alias("description_status"), F.lit(None).cast("string").alias("canonical"))
    exports.export_analysis(["markdown", "html"], path, pages, shown=10)
    assert sum(t.count("| 1.0 | 2.0 |") for t in read("analysis-md-pages")) == sum(t.count("<tr>") for t in read("analysis-html-pages")) == 25


def test_a_batch_that_is_sent_again_is_in_the_table_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)

    def run(log):
        q = exports.append_batches(rows(), out, str(tmp_path / log))
        q.processAllAvailable()
        q.stop()

    run("log")
    # the log of the query is lost: all batches are sent again
    run("other-log")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_insight_text():
    text = exports.render_insight({"pages": 3, "edges": 2, "max_depth": 1, "broken_links": 4, "redirect_chains": 0, "critical": True}, {"score": 71.25, "label": "Good"}, [("/", 0.5)])
    assert "Health 71.2 (Good)" in text and "broken links: 4" in text and "redirect" not in text and "/   0.500" in text


# -- plugin tables --------------------------------------------------------------------------------


def test_plugin_tables_are_its_own(spark, tmp_path):
    p = Plugin("page-speed", {"lcp": "REAL"}, True)
    a, b = (Namespace(spark, f"file://{tmp_path}", p, s) for s in (1, 2))
    assert a.rows().count() == 0
    rows = spark.createDataFrame([(7, 1.5, 80.0), (8, None, None)], "url_id long, lcp double, score double")
    a.append(rows)
    b.append(rows.limit(1))
    got = a.rows().orderBy("id").collect()
    assert [r["snapshot_id"] for r in got] == [1, 1, 2] and len({r["id"] for r in got}) == 3 and got[0]["weight"] == 1.0
    for bad in (rows.withColumn("other", F.lit(1)), rows.withColumn("snapshot_id", F.lit(9))):
        with pytest.raises(ValueError):
            a.append(bad)
    a.report(spark.createDataFrame([(1, "x")], "n int, t string"))
    assert a.reports().first()["report"] == '{"n":1,"t":"x"}'
    with pytest.raises(ValueError):
        Namespace(spark, "x", Plugin("../a"), 1)
    with pytest.raises(ValueError):
        Plugin("p", hooks={"on_something": print})


def test_pagespeed_plugin(spark):
    report = '{"lighthouseResult":{"categories":{"performance":{"score":0.93}},"audits":{"largest-contentful-paint":{"numericValue":1234},"cumulative-layout-shift":{"numericValue":0.1},"total-blocking-time":{"numericValue":9.6}}},"loadingExperience":{"overall_category":"FAST"}}'
    r = pagespeed_plugin(lambda u: report).hooks["on_page"](spark.createDataFrame([(3, "u")], "page_id long, url string")).first()
    assert tuple(r) == (3, 1.23, 0.1, 10.0, "PASS", 93.0)


# -- limiters -------------------------------------------------------------------------------------


def requests(spark, times, **more):
    rows = [(i, k, float(t)) for i, (k, t) in enumerate(times)]
    return spark.createDataFrame(rows, "id long, key string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


def test_token_bucket_waits_whole_intervals_and_heeds_crawl_delays(spark):
    df = requests(spark, [("a", 0), ("a", 0.1), ("a", 5), ("a", 5), ("a", 5.5), ("b", 0), ("b", 0), ("b", 20)]).withColumn("delay", F.when(F.col("key") == "b", 4.0))
    got = [r["wait_s"] for r in L.token_bucket(df, rate=2.0, crawl_delay="delay").orderBy("id").collect()]
    # a: two tokens, then one each half second; b: a token every four seconds, two at first
    assert got == [0, 0, 0, 0, 0, 0, 0, 0]
    got = [r["wait_s"] for r in L.token_bucket(df, rate=1.0, crawl_delay="delay").orderBy("id").collect()]
    assert got == [0, 1, 0, 1, 1.5, 0, 4, 0]


def test_limiters_match_plain_loops_across_pauses(spark):
    rng = random.Random(3)
    times, t = [], 0.0
    for _ in range(300):
        t += rng.choice([0.0, 0.2, 1.0, 3.0, 12.0])
        times.append((rng.choice("ab"), t))
    allowed, emitted, held, last = [], [], {}, {}
    for k, t in times:
        held[k] = [x for x in held.get(k, []) if x > t - 5]
        allowed.append(len(held[k]) < 3)
        held[k] += [t] if allowed[-1] else []
        emitted.append(k not in last or t - last[k] >= 2 - 1e-9)
        last[k] = t if emitted[-1] else last[k]
    df = requests(spark, times)
    assert [r["allowed"] for r in L.rate_limit(df, limit=3, window_s=5).orderBy("id").collect()] == allowed
    assert [r["emitted"] for r in L.throttle(df, gap_ms=2000).orderBy("id").collect()] == emitted


# -- paths that depend on size ----------------------------------------------------------------------


def test_pagerank_and_hits_agree_in_both_forms(spark):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id long")
    edges = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 55, 300), rng.integers(0, 60, 300), rng.random(300))], "src long, dst long, weight double").dropDuplicates(["src", "dst"])
    one, two = ({r["id"]: r["rank"] for r in R.pagerank(nodes, edges, local_edges=k, tol=1e-3).collect()} for k in (10**6, 0))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-12
    one, two = ({r["id"]: tuple(r)[1:3] for r in R.hits(nodes, edges, rounds=4, local_edges=k).collect()} for k in (10**6, 0))
    assert max(abs(x - y) for i in one for x, y in zip(one[i], two[i])) < 1e-9


@pytest.mark.parametrize("distance", [3, 10])
def test_hot_bands_lose_no_pair(spark, monkeypatch, distance):
    monkeypatch.setattr(D, "HOT_BAND", 6)
    rng = random.Random(distance)
    hashes = set()
    for _ in range(40):
        h = 0x1234 | rng.getrandbits(4) << 30
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(64)
        hashes.add(h - (1 << 64) if h >> 63 else h)
    rows = list(enumerate(sorted(hashes)))
    bands = lambda h: [(h >> 16 * i) & 0xFFFF for i in range(4)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= distance and any(p == q for p, q in zip(bands(x % 2**64), bands(y % 2**64)))}
    got = [tuple(r) for r in D.similar_pairs(spark.createDataFrame(rows, "id long, h long"), distance).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_collapsed_graph_points_at_representatives(spark):
    nodes = spark.createDataFrame([(1, "/a", "x", 5, 0.9, None, 1), (2, "/b", "x", 5, 0.9, "/b", 0), (3, "/c", "y", 9, 0.1, None, 0)], "id long, url string, content_hash string, h long, unique_token_ratio double, canonical string, in_links long")
    edges = spark.createDataFrame([(3, 1, 1.0), (2, 1, 0.5)], "src long, dst long, weight double")
    members, g = D.duplicate_pipeline(SiteGraph(nodes, edges))
    assert {(r["id"], r["type"], r["severity"], r["representative"], r["collapse_into"]) for r in members.collect()} == {(1, "exact", "high", 2, 2), (2, "exact", "high", 2, None)}
    assert {tuple(r) for r in g.edges.collect()} == {(3, 2, 1.0)}


def test_submitted_settings_win():
    assert unset({"a": "1", "b": "2"}, {"b": "3"}) == {"a": "1"}
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[1,1,1]") and not is_local("spark://x")
