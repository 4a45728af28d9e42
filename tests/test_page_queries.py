"""Queries over web pages on small pages with references of every sort."""

from __future__ import annotations

import duckdb
import pytest

from conftest import same_rows
from quireflow import catalog

PAGES = [
    "<h1>Said &quot;so&quot; &amp; left</h1><ul><li>a &quot;b&quot;</li><li><a href='/x?a=1&amp;b'>R&amp;D</a></li></ul>",
    "<h1>cut &amp</h1><ul><li>cut &am</li><li>cut &quo</li></ul><p>end &copy;</p>",
    "<h1>twice &amp;amp; and &amp;quot;, &#38; &nbsp;x & y &</h1><ul><li>&amp;amp &lt;b&gt;</li></ul>",
]


@pytest.mark.parametrize("name", ["html_headings", "html_links"])
def test_references_are_those_of_the_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same_rows(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])
