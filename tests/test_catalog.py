"""Every query with SQL gives the rows of that SQL; the others have their columns and rows."""

from __future__ import annotations

import pytest

from conftest import SMALL, same_rows
from quireflow import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), duck, catalog.ORACLES[name])


def test_html_blocks_have_headings_items_and_paragraphs(spark):
    found = {r["type"]: r["count"] for r in catalog.QUERIES["html_blocks"](spark, SMALL).groupBy("type").count().collect()}
    assert set(found) >= {"heading", "listItem", "paragraph"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "markdown"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
