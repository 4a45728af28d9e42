"""How often patterns are tried, and how rows are spread, by the plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from quireflow import catalog
from quireflow.functions import text as T
from quireflow.operators import blocks as B
from quireflow.operators import render, rich


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rich_blocks_try_each_pattern_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    plan = optimized(catalog.QUERIES["rich_blocks"](spark, SMALL))
    # the marker, and the text after it where there is one
    assert plan.count(rich.LIST) == 2
    assert plan.count("{IsUppercase}]") == 1


@pytest.mark.parametrize("name", ["json_normalised", "value_items", "value_items_nested", "value_markdown", "value_json", "xml_values", "plist_values", "delimited_roundtrip"])
def test_rows_of_small_files_are_spread_before_they_are_parsed(spark, name):
    plan = optimized(catalog.QUERIES[name](spark, SMALL)).splitlines()
    parsed = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert parsed and "RepartitionByExpression" in "".join(plan[parsed[-1] :])


def test_texts_that_fit_are_not_wrapped_by_pattern(spark):
    texts = [("x" * n + tail, indent) for n in (0, 1, 9, 10, 11, 84, 88, 89, 90, 91, 200) for tail in ("", " y", " yy zz") for indent in (0, 2, 85)]
    df = spark.createDataFrame([(t.strip(), i) for t, i in texts], "text string, indent int").withColumn("wrapped", T.wrap("text", F.col("indent")))
    assert "length(text" in optimized(df)
    for r in df.collect():
        width = max(90 - r.indent, 10)
        lines = r.wrapped.split("\n")
        assert " ".join(lines) == r.text and all(len(line) <= width or " " not in line for line in lines)
        assert all(len(a) + 1 + len(b.split(" ")[0]) > width for a, b in zip(lines, lines[1:]))


def test_blocks_carry_one_text_and_try_each_pattern_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    made = B.blocks(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    plan = optimized(made)
    assert plan.count("-\x01(?=") == 1 and plan.count(f"[{T.SPACE}]+$") == 0
    # the marker, the space before it, the text after it
    assert plan.count(B.LIST) == 3 and plan.count("{IsUppercase}]") == 1
    steps = made._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = steps[next(i for i, step in enumerate(steps) if "Exchange hashpartitioning" in step) + 1]
    assert "piece#" in sent and "raw#" not in sent and " t#" not in sent


def test_blocks_are_rendered_without_a_window(spark):
    found = B.blocks(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Window [")
    assert count(render.markdown(spark.createDataFrame([(1, "t")], "doc_id long, title string"), found)) == count(found)


def test_texts_are_as_the_plain_patterns_make_them(spark):
    odd = ["a", "Ab", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u3000", "\u200b", "é", "漢", "-", "\x01", "x" * 45, "x" * 91]
    texts = ["".join(odd[(i * k + k // 3) % len(odd)] + " " * (i % 3 == 0) for k in range(i % 31)) for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("flat", F.replace(T.collapse("text"), F.lit("\x01"), F.lit(" "))).withColumn("fed", T.line_feeds("text"))
    c, s = F.col, T.SPACE
    width = F.greatest(F.lit(90) - c("i") % 40, F.lit(10)).cast("string")
    broken = F.regexp_replace("flat", F.concat(F.lit("([^ ]{"), (width.cast("int") + 1).cast("string"), F.lit(",}|.{1,"), width, F.lit("})( |$)")), F.lit("$1\n"))
    same = {
        "trim": (T.trim("text"), F.regexp_replace("text", f"^[{s}]+|[{s}]+$", "")),
        "collapse": (T.collapse("text"), F.trim(F.regexp_replace("text", f"[{s}]+", " "))),
        "collapsed": (T.collapsed("text"), F.trim(F.regexp_replace("text", f"[{s}]+", " "))),
        "line_feeds": (T.line_feeds("text"), F.regexp_replace("text", "\r\n?", "\n")),
        "split_lines": (T.split_lines("fed"), F.split("fed", T.BREAK, -1)),
        "wrap": (T.wrap("flat", c("i") % 40), F.regexp_replace(broken, "\n$", "")),
    }
    for name, (new, plain) in same.items():
        assert df.where(~new.eqNullSafe(plain)).count() == 0, name
