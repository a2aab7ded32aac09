"""Whole texts go to Python in small batches."""

import pytest
from pyspark.sql import functions as F

KEYS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@pytest.fixture
def large_batches(spark):
    was = {k: spark.conf.get(k) for k in KEYS}
    for k in KEYS:
        spark.conf.set(k, str(1 << 30))
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_pages_are_parsed_in_small_batches(spark, large_batches):
    from gossamer.functions.html_udf import parse_html

    html = F.concat(F.lit("<title>t"), F.col("id").cast("string"), F.lit("</title><body><a href='/a'>x</a>"))
    got = spark.range(2500).coalesce(1).select("id", parse_html(html, F.lit("https://e.com/")).alias("p")).select("id", "p.title", "p.internal_links").collect()
    assert all(int(spark.conf.get(k)) <= v for k, v in KEYS.items())
    assert sorted(got) == [(i, f"t{i}", 1) for i in range(2500)]


def test_texts_are_hashed_in_small_batches(spark, large_batches):
    from gossamer.functions.simhash import simhash, simhashes

    got = spark.range(2500).coalesce(1).select("id", simhash(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("h")).collect()
    assert all(int(spark.conf.get(k)) <= v for k, v in KEYS.items())
    assert [r.h for r in sorted(got)] == simhashes([f"word {i}" for i in range(2500)]).tolist()
