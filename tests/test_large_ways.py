"""The ways that large tables take give what the small ones give."""

import random

from pyspark.sql import functions as F

from gossamer.operators import graph as G
from gossamer.operators import ranking as R


def links(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.0, 1.0, 3.0])) for _ in range(400)]
    return spark.range(70).select("id"), spark.createDataFrame(edges, "src long, dst long, weight double").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def test_hits_local_broadcast_and_shuffled(spark):
    nodes, edges = links(spark)
    want = {r.id: r for r in R.hits(nodes, edges, rounds=6).collect()}
    for rows in (0, 1000):
        got = {r.id: r for r in R.hits(nodes, edges, rounds=6, local_edges=0, broadcast_rows=rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[i].auth - want[i].auth) < 1e-12 and abs(got[i].hub - want[i].hub) < 1e-12 and got[i].role == want[i].role for i in want)


def test_hits_of_no_edges(spark):
    nodes, edges = links(spark)
    assert all(r.auth == r.hub == 0.0 for r in R.hits(nodes, edges.where("src < 0"), local_edges=-1).collect())


def test_edges_stay_in_place_between_rounds(spark, monkeypatch):
    """Edges are dealt by either end, once, however many rounds there are."""
    dealt = []
    keep = R.spread
    monkeypatch.setattr(R, "spread", lambda df, *keys, **k: dealt.append(keys) or keep(df, *keys, **k))
    nodes, edges = links(spark)
    R.hits(nodes, edges, rounds=3, local_edges=0)
    assert sorted(dealt) == [("dst",), ("src",)]


def test_upper_median_between_quantiles(spark):
    for values in ([5.0] * 90 + [1.0, 2.0], [float(i % 37) for i in range(1000)], [0.0], [float(i) for i in range(5001)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert R.upper_median(df, "v", whole=0) == R.upper_median(df, "v") == sorted(values)[len(values) // 2]


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    import gossamer.session as S

    monkeypatch.setattr(S.side, "__defaults__", (0,))
    monkeypatch.setattr(S.spread, "__kwdefaults__", {"rows": 10})
    nodes, edges = links(spark)
    members = nodes.where("id % 2 = 0").select("id", (F.col("id") - F.col("id") % 10).alias("representative"))
    got = G.collapse(G.SiteGraph(nodes, edges), members).edges
    assert got.rdd.getNumPartitions() > 4 or edges.count() < 50
    rep = {r.id: r.representative for r in members.collect()}
    want = {}
    for s, d, w in edges.collect():
        if rep.get(d, d) != s or s == d:
            want[s, rep.get(d, d)] = max(w, want.get((s, rep.get(d, d)), w))
    assert {(r.src, r.dst): r.weight for r in got.collect()} == want

    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x#f"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",), ("n0",), ("q",)], "url string")
    followed = G.follow_redirects(hops, starts)
    assert sorted(followed.collect()) == [("a", "c", 2, "ok"), ("n0", "n5", 5, "too_many"), ("q", "q", 0, "ok"), ("x", "y", 1, "loop")]
    assert "BroadcastHashJoin" not in followed._jdf.queryExecution().toString()


def test_similar_titles_of_copies_and_common_words(spark):
    from gossamer.operators import duplicates as D

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    sets = [rng.sample(words, rng.randrange(1, 7)) for _ in range(120)]
    rows = [(i, sets[i % 120] if i % 3 else sets[0]) for i in range(300)] + [(300, []), (301, ["w1", "w1"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.7)
    for hot in (3, 1000):
        got = D.similar_titles(df, hot=hot)
        assert sorted((r.a, r.b) for r in got.collect()) == want
        # pairs are never brought together to be told apart: their number is the square of the copies'
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Distinct" not in plan


def test_links_have_the_components_of_all_pairs_and_are_few(spark):
    from gossamer.operators import duplicates as D
    from gossamer.operators.components import connected_components

    rng = random.Random(7)
    base = [rng.getrandbits(64) - 2**63 for _ in range(6)]
    flip = lambda h, n: (h ^ sum(1 << b for b in rng.sample(range(63), n)))
    rows = [(i, flip(base[i % 6], rng.randrange(0, 8))) for i in range(400)] + [(1000 + i, rng.getrandbits(63)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, h long")
    for distance in (3, 10):
        pairs = D.similar_pairs(df, distance)
        want = sorted(connected_components(pairs).collect())
        for block in (16, 2048):
            links = D.similar_links(df, distance, block=block)
            assert sorted(connected_components(links).collect()) == want
        assert links.count() <= 4 * len(rows) < (pairs.count() if distance == 10 else 1e9)
