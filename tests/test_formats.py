"""Formats for spark.read, and the expansion of sitemaps."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gossamer.sources import formats
from gossamer.sources.connectors import expand_sitemaps


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def test_robots_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("User-agent: X\nUser-agent: *\nDisallow: /a # no\nAllow:\nCrawl-delay: 2\n\nUser-agent: y\nAllow: /b\nSitemap: http://e/s.xml\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "_hidden").write_text("User-agent: *\nDisallow: /")
    df = spark.read.format("robots").load(str(tmp_path)).drop("file")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(0, "x", "disallow", "/a"), (0, "*", "disallow", "/a"), (1, "x", "crawl-delay", "2"), (1, "*", "crawl-delay", "2"), (2, "y", "allow", "/b"), (3, None, "sitemap", "http://e/s.xml")], key=str)
    assert [r.value for r in df.where("agent = 'y'").collect()] == ["/b"]
    assert [r.value for r in df.where("kind = 'sitemap'").collect()] == ["http://e/s.xml"]


def test_sitemap_files(spark, tmp_path):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    (tmp_path / "i.xml").write_text(f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc> http://e/1 </loc></sitemap><sitemap><loc/></sitemap></sitemapindex>")
    (tmp_path / "u.xml").write_text(f"<urlset {ns}><url><loc>http://e/?a=1&amp;b=2</loc></url><url><loc><![CDATA[http://e/x]]></loc></url></urlset>")
    (tmp_path / "no.xml").write_text("not found")
    df = spark.read.format("sitemap").load(str(tmp_path))
    assert sorted((r.kind, r.number, r.loc) for r in df.collect()) == [("sitemap", 0, "http://e/1"), ("url", 0, "http://e/?a=1&b=2"), ("url", 1, "http://e/x")]
    assert df.where("kind = 'url'").count() == 2
    one = df.select("file").where("kind = 'sitemap'").first()[0]
    assert df.where(F.col("file") == one).count() == 1


def test_filters_leave_files_unopened(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"nodes": [{"url": "a", "depth": 0, "status": 200}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a", "weight": 0.4}]}))
    (tmp_path / "torn.json").write_text('{"nodes": [')
    df = spark.read.format("graph-json").load(str(tmp_path))
    good = f"{tmp_path}/good.json"
    names = {f.rsplit("/", 1)[-1]: f for f in formats.list_files(str(tmp_path))}
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        df.collect()
    # the torn file is not opened
    some = df.where(F.col("file") == names["good.json"])
    assert some.count() == 3 and some.rdd.getNumPartitions() == 1
    assert [(r.source, r.weight) for r in some.where("kind = 'edge' and weight >= 0.5").collect()] == [("a", 1.0)]
    assert [(r.url, r.status) for r in some.where("kind = 'node'").collect()] == [("a", 200)]
    assert good.endswith(names["good.json"].split("://")[-1])


def test_pushed_filters_are_kept_by_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual

    r = formats.GraphReader({"path": "x"})
    left = list(r.pushFilters([EqualTo(("kind",), "edge"), GreaterThanOrEqual(("weight",), 0.5), GreaterThan(("depth",), 1), EqualTo(("kind",), "node")]))
    assert (r.equal, r.low) == ({"kind": "edge"}, {"weight": 0.5}) and left == [GreaterThan(("depth",), 1), EqualTo(("kind",), "node")]
    assert [x[1] for x in r.rows("f", '{"nodes": [{"url": "a"}], "edges": [{"source": "a", "target": "b", "weight": 0.1}, {"source": "a", "target": "c"}]}')] == ["edge"]


# -- expansion ------------------------------------------------------------------------------------


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"


def urls(*names):
    return "<urlset>" + "".join(f"<url><loc>{n}</loc><lastmod>2024</lastmod></url>" for n in names) + "</urlset>"


def plain(files, roots, limit):
    import re

    queue, seen, out = list(dict.fromkeys(roots)), [], []
    while queue and len(seen) < limit:
        level = []
        for u in queue:
            if u in seen or len(seen) >= limit:
                continue
            seen.append(u)
            locs = re.findall("<loc>(.*?)</loc>", files.get(u, ""))
            if "<sitemapindex" in files.get(u, ""):
                level += locs
            else:
                out += [x for x in locs if x not in out]
        queue = level
    return out


@pytest.mark.parametrize("limit", [1, 3, 20, 50, 100])
def test_expansion_equals_a_plain_queue(spark, limit):
    files = {"root": index("a", "b", "root", "missing", *[f"child{k}" for k in range(40)]), "a": index("b", "deep", "a"), "deep": index("root", "deeper"), "deeper": urls("http://e/deepest"), "b": urls("http://e/b", "http://e/shared")}
    files |= {f"child{k}": urls(f"http://e/{k}", "http://e/shared") for k in range(40)}
    df = spark.createDataFrame([*files.items(), ("none", None), ("text", "no xml <url><loc>http://e/no</loc></url>")], "url string, xml string")
    got = [r.url for r in expand_sitemaps(df, ["root", "b", "text", "none"], limit).orderBy("place").collect()]
    assert got == plain({**files, "text": ""}, ["root", "b", "text", "none"], limit)


def test_expansion_of_nothing(spark):
    empty = spark.createDataFrame([], "url string, xml string")
    assert expand_sitemaps(empty, []).collect() == [] and expand_sitemaps(empty, ["x"]).collect() == []
