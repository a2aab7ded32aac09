"""Queries against their SQL on tables with odd values: open references in titles, large keys."""

import os
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables; some titles end in references without a semicolon, customers have large keys."""
    import parity

    d = str(tmp_path_factory.mktemp("odd"))
    for t in parity.TABLES:
        os.symlink(f"{SF}/{t}.parquet", f"{d}/{t}.parquet") if t not in ("pages", "customer") else None
    title = "CASE page_id % 5 WHEN 0 THEN 'A' || page_id || ' &amp;&amp' WHEN 1 THEN repeat('x', 44) || lpad(CAST(page_id AS VARCHAR), 3, '0') || '&amp' WHEN 2 THEN repeat('y', 55) || lpad(CAST(page_id AS VARCHAR), 3, '0') || '&amp' WHEN 3 THEN 'two  spaces &eacute; &copy;' || page_id ELSE 'B &amp' || CASE WHEN page_id % 2 = 0 THEN '' ELSE ';' END END"
    duckdb.execute(f"COPY (SELECT page_id, url, regexp_replace(html, '(?is)<title[^>]*>.*?</title>', '<title>' || {title} || '</title>') AS html FROM '{SF}/pages.parquet') TO '{d}/pages.parquet' (FORMAT parquet)")
    duckdb.execute(f"COPY (SELECT * REPLACE (c_custkey + k AS c_custkey) FROM '{SF}/customer.parquet', (VALUES (0), (65500), (5000000)) v(k)) TO '{d}/customer.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", ["b7_analysis_table", "l2_page_seo", "b12_analysis_report", "h3_h5_titles_and_headings", "h7_h8_parsed_counts", "p3_internal_ipv6"])
def test_matches_sql_on_odd_tables(spark, odd, name):
    import parity

    assert parity.compare(spark, parity.connect(odd), odd, name).startswith("OK")
