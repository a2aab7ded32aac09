"""Expected values worked out by hand, and invariants."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def test_normalize_url_general_case():
    from gossamer.functions.url import normalize_one as n

    assert n("HTTPS://Example.com:443//a//b/?utm_source=x&b=2&a=1#frag") == "https://example.com/a/b?a=1&b=2"
    assert n("/x/../y/", "http://e.com/q") == "http://e.com/y"
    assert n("mailto:a@b.c") is None and n("http://e.com/a.PDF") is None and n("") is None
    assert n("http://e.com:8080") == "http://e.com:8080/" and n("http://e.com/?q=1", strip_query=True, to_path=True) == "/"


def test_normalize_url_columns_agree_with_python(spark):
    from gossamer.functions.url import normalize_one, normalize_url

    urls = ["http://A.com//x/?b=1&a=2&utm_x=1", "https://a.com:443/", "https://a.com/p.jpg", "ftp://a.com/", "http://a.com/x#y", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(normalize_url(F.col("u"))).collect()]
    assert got == [normalize_one(u) for u in urls]


def test_simhash_and_fnv():
    from gossamer.functions.simhash import fnv1a, simhashes

    assert hex(int(fnv1a(["hello"])[0])) == "0xa430d84680aabd0b"
    one, none, void, turned, other = simhashes(["a b c", "", None, "c b a", "a b d"]).tolist()
    assert none == void == 0 and one == turned != other
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (1, 0, 30, 400, 7)]
    for t, got in zip(texts, simhashes(texts).tolist()):
        votes = [0] * 64
        for w in t.split():
            h = int(fnv1a([w])[0])
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
        assert got % (1 << 64) == sum(1 << i for i, v in enumerate(votes) if v > 0)
    assert simhashes(["a b c d"], cap=5).tolist() == [one]


def test_metrics_of_nine_nodes(spark):
    from gossamer.operators import graph as G

    out = {0: 4, 1: 3, 2: 1, 3: 1}
    rows, k = [], 0
    for degree, n in out.items():
        for _ in range(n):
            rows.append((k, min(k, 4), 1, degree))
            k += 1
    deg = spark.createDataFrame(rows, "id int, depth int, in_links long, out_links long")
    m = G.graph_metrics(deg).first()
    expect = -sum(n / 9 * math.log2(n / 9) for n in out.values())
    assert abs(m["entropy"] - expect) < 1e-9 and m["pages"] == 9 and m["deep"] == sum(r[1] > 3 for r in rows)


def test_edge_weight_is_the_largest_and_degrees_are_distinct(spark):
    from gossamer.operators import graph as G

    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.8), ("a", "z", 1.0)], "src string, dst string, weight double")
    g = G.build_graph(nodes, edges)
    assert [tuple(r) for r in g.edges.collect()] == [("a", "b", 0.8)]
    assert {r["id"]: (r["in_links"], r["out_links"]) for r in G.degrees(g).collect()} == {"a": (0, 1), "b": (1, 0)}


def test_pagerank_flat_and_both_ways(spark):
    from gossamer.operators import ranking as R

    one = spark.createDataFrame([(1,)], "id int")
    none = spark.createDataFrame([], "src int, dst int, weight double")
    assert [tuple(r)[2] for r in R.pagerank(one, none).collect()] == [50.0]
    nodes = spark.range(6).select(F.col("id").cast("int").alias("id"))
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (1, 3, 1.0), (4, 4, 1.0)], "src int, dst int, weight double")
    a = {r["id"]: r["rank"] for r in R.pagerank(nodes, edges, rounds=8, tol=0).collect()}
    b = {r["id"]: r["rank"] for r in R.pagerank(nodes, edges, rounds=8, tol=0, local_edges=0).collect()}
    assert abs(sum(a.values()) - 1) < 1e-9 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    x = {r["id"]: (r["auth"], r["hub"]) for r in R.hits(nodes, edges, 4).collect()}
    y = {r["id"]: (r["auth"], r["hub"]) for r in R.hits(nodes, edges, 4, local_edges=0).collect()}
    assert abs(sum(v[0] ** 2 for v in x.values()) - 1) < 1e-9 and all(abs(x[k][i] - y[k][i]) < 1e-9 for k in x for i in (0, 1))


def test_components_are_an_equivalence(spark):
    from gossamer.operators.components import connected_components

    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 95, 100)} == {90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_health_and_thin_scores(spark):
    from gossamer.operators import scoring as C

    row = spark.range(1).select(C.health(F.lit(10), {"orphans": F.lit(2), "broken_links": F.lit(1)}).alias("h"), C.thin_content(F.lit(600), F.lit(0.5), F.lit(0)).alias("a"), C.thin_content(F.lit(0), F.lit(0.0), F.lit(100)).alias("b")).first()
    assert (row["h"]["score"], row["h"]["label"]) == (80.0, "Needs Attention") and (row["a"], row["b"]) == (0.0, 100.0)


def test_rate_limit_counts_only_accepted(spark):
    from gossamer.streaming.limiter import rate_limit, token_bucket

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "k", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 10, 11])]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    got = {r["id"]: r["allowed"] for r in rate_limit(df, limit=2, window_s=10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}
    waits = {r["id"]: r["wait_s"] for r in token_bucket(df, rate=1.0).collect()}
    assert waits[0] == 0 and all(w >= 0 for w in waits.values())


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    from gossamer.streaming.limiter import rate_limit_stream

    t0 = dt.datetime(2024, 1, 1)
    pd.DataFrame({"key": ["k"] * 4, "ts": [t0 + dt.timedelta(seconds=s) for s in (0, 1, 2, 12)]}).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "a.parquet")
    src = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path))
    q = rate_limit_stream(src, limit=2, window_s=10).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["allowed"] for r in spark.sql("select * from limited order by ts").collect()] == [True, True, False, True]


def test_robots_longest_match_and_sitemaps(spark):
    from gossamer.sources.connectors import Robots, expand_sitemaps

    r = Robots("User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\nSitemap: http://e/s.xml")
    df = spark.createDataFrame([("/a/x",), ("/a/b/c",), ("/z",)], "p string")
    assert [x[0] for x in df.select(r.allowed(F.col("p"))).collect()] == [False, True, True] and r.delay == 2.0 and r.sitemaps == ["http://e/s.xml"]
    files = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>s</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc>http://e/1</loc></url></urlset>"), ("x", "no xml")], "url string, xml string")
    assert [x[0] for x in expand_sitemaps(files, ["i", "x"]).collect()] == ["http://e/1"]


def test_parse_page_context_weights_and_jsonld():
    from gossamer.functions.html_udf import parse_page

    html = '<html><head><meta name=robots content="noindex"><link rel=canonical href="/c"><script type="application/ld+json">{"@type":"Article","x":[{"@type":["A","B"]}]}</script><script type="application/ld+json">{bad</script></head><body><nav><a href="/n">n</a></nav><div class="menu"><a href="/m">m</a></div><footer><a href="/f">f</a></footer><p><a href="/p">p <b>x</a> <a rel="nofollow" href="/q">q</a></body>'
    p = parse_page(html, "https://e.com/")
    w = {x["url"]: x["weight"] for x in p["links"]}
    assert w == {"https://e.com/n": 0.7, "https://e.com/m": 0.7, "https://e.com/f": 0.4, "https://e.com/p": 1.0}
    assert p["noindex"] and p["canonical"] == "https://e.com/c" and p["schema_types"] == ["Article", "A", "B"] and (p["jsonld"], p["jsonld_valid"]) == (2, 1)


def test_redirects_loop_and_limit(spark):
    from gossamer.operators.graph import follow_redirects

    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("l", "m"), ("m", "l#x")], "src string, dst string")
    got = {r["url"]: (r["final"], r["n_hops"], r["outcome"]) for r in follow_redirects(hops, spark.createDataFrame([("a",), ("l",), ("z",)], "url string")).collect()}
    assert got == {"a": ("c", 2, "ok"), "l": ("m", 1, "loop"), "z": ("z", 0, "ok")}


def test_plugins(spark):
    import pytest

    from gossamer.plugins import Plugin, Registry

    r = Registry([Plugin("a", {"x": "TEXT"}, hooks={"on_page": lambda: 1, "should_enqueue": lambda u, d: F.when(u == "no", F.lit(False))}), Plugin("b", hooks={"on_page": lambda: 1 / 0})])
    assert r.run("on_page", "page") == {"a": 1} and r.run("on_page", "crawl") == {}
    with pytest.raises(ValueError):
        r.add(Plugin("a"))
    with pytest.raises(ValueError):
        Plugin("c", {"score": "REAL"}).schema()
    assert [x[0] for x in spark.createDataFrame([("no",), ("yes",)], "u string").select(r.should_enqueue(F.col("u"), F.lit(1))).collect()] == [False, True]


def test_a_registered_query_fetches_every_order(spark):
    from gossamer.plans import registry
    from gossamer.session import table

    sf = "/root/testdata/sf0.001"
    got = registry.queries()["a11_p18_p20_fetched_orders"](spark, sf).select("o_orderkey")
    want = table(spark, sf, "orders").select("o_orderkey")
    assert want.where("o_orderkey >= 500").count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def heading_health_by_hand(pages):
    """The formulas in plain Python: {id: (metrics and groups, score)}."""
    import re
    from collections import Counter

    from gossamer.functions.text import STOPWORDS

    plain = lambda x: re.sub(r"\s+", " ", re.sub(r"<[^<>]*>", " ", x).replace("&nbsp;", " ").replace("&amp;", "&")).strip()
    tokens = lambda x: [w for w in re.sub(r"[^a-z0-9\s]", " ", plain(x).lower()).split() if len(w) > 2 and w not in STOPWORDS]
    half_up = lambda x: math.floor(x + 0.5)
    fixed = lambda x: half_up(x * 1000) / 1000
    seen = {}
    for i, html in pages.items():
        found = list(re.finditer(r"<h([1-6])\b[^<>]*>([\s\S]*?)</h\1>", html, re.I))
        ends = [m.start() for m in found[1:]] + [len(html)]
        secs = [(int(m[1]), plain(m[2]), len(tokens(html[m.end() : e]))) for m, e in zip(found, ends)]
        lv = [s[0] for s in secs]
        steps = [b - a for a, b in zip(lv, lv[1:])]
        h = -sum(c / len(lv) * math.log2(c / len(lv)) for c in Counter(lv).values())
        first = next((s[1].lower() for s in secs if s[0] == 1), "")
        m = [fixed(h), fixed(sum(x <= 2 for x in lv) / len(lv)) if lv else 0, fixed(sum(map(abs, steps)) / len(steps)) if steps else 0, sum(x > 1 for x in steps), sum(x < -1 for x in steps), sum(0 < s[2] < 80 for s in secs)]
        seen[i] = (lv, m, first, tuple(sorted(s[1].lower() for s in secs if s[0] == 2 and s[1])), [(s[1].lower(), s[2]) for s in secs])
    sizes = [Counter(v[2] for v in seen.values()), Counter(v[3] for v in seen.values()), Counter(tuple(v[0]) for v in seen.values()), Counter(k for v in seen.values() for k in v[4])]
    out = {}
    for i, (lv, m, first, h2, keys) in seen.items():
        like = 0
        for o in {v[2] for v in seen.values()} - {""} if first else ():
            a, b = set(tokens(first)), set(tokens(o))
            like += o == first or bool(a and b and len(a & b) / len(a | b) >= 0.7)
        g = [sizes[0][first] if first else 0, like, sizes[1][h2], sizes[2][tuple(lv)]]
        risk = fixed(max(0, min(1, (g[1] - 1) * 0.15 + (g[2] - 1) * 0.2 + (g[3] - 1) * 0.2)))
        s = 100 - 20 * (1 not in lv) - 6 * (lv.count(1) > 1) - 8 * m[3] - 6 * m[4] - half_up(m[0] * 7) - half_up(m[1] * 20) - half_up(m[2] * 6) - 4 * m[5] - half_up(risk * 12)
        s -= sum(min(most, (n - 1) * each) for n, most, each in zip(g, (16, 8, 10, 12), (3, 2, 2, 2)) if n > 1)
        out[i] = (m, g, [fixed(min(1, (sizes[3][k] - 1) / 5)) for k in keys], max(0, min(100, s)))
    return out


def test_heading_health_matches_the_formulas(spark):
    from gossamer.operators import headings as N
    from gossamer.plans import registry
    from gossamer.session import table

    sf = "/root/testdata/sf0.001"
    made = {
        -1: "<H1 class=a>Green apple pie recipes</H1>words here<h3>Deep</h3>" + "word " * 90 + "<h2>Two &amp; more</h2><h6>x</h6>", -2: "<h1>Green apple pie recipes today</h1><h2>B</h2>t<h2>A</h2>", -3: "<h2>A</h2>one<h2>B</h2>",
        -4: "no headings", -5: "none at all", -6: "<h1> </h1><h1>Green <b>apple</b> pie recipes</h1><h2>open<h3>in</h3></h2>", -7: "<h1>Green apple pie recipes</h1>words here", -8: "<h4>a</h4><h1></h1>",
    }
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()} | made
    df = spark.createDataFrame([(k, f"u{k}", v) for k, v in pages.items()] + [(-90, "u", None), (-91, None, "<h1>a</h1>")], "id long, url string, html string")
    health = N.heading_health(df)
    got = {r["id"]: ([r[x] for x in ("entropy", "fragmentation", "volatility", "hierarchy_skips", "reverse_jumps", "thin_sections")], [r[x] for x in ("duplicate_h1_group", "similar_h1_group", "identical_h2_set_group", "duplicate_pattern_group")], r["section_risk"], r["score"]) for r in health.collect()}
    want = heading_health_by_hand(pages)
    assert got.keys() == want.keys() and [(k, got[k], want[k]) for k in want if got[k] != want[k]] == []
    s = N.heading_summary(health).first()
    assert s["evaluated_pages"] == len(want) and s["avg_score"] == math.floor(sum(w[3] for w in want.values()) / len(want) + 0.5) and s["total_thin_sections"] == sum(w[0][5] for w in want.values())
    rows = {r["page_id"]: r["score"] for r in registry.queries()["e20_e21_l7_heading_health"](spark, sf).collect()}
    assert rows == {k: w[3] for k, w in heading_health_by_hand({k: v for k, v in pages.items() if k >= 0}).items()}
