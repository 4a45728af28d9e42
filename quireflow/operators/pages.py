"""Documents in pages: running headers and footers go, wrapped lines become paragraphs again.

Only the search for running lines looks at a whole document; the rest is by page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as T


def running_lines(pages: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, header and footer from pages (keys, page, text): the most frequent first and last line, in the form for
    comparison, where it is on at least two pages and half of them; of equally frequent ones the least."""
    found = F.filter(F.transform(F.split(T.line_feeds(text), T.BREAK, -1), T.trim), lambda line: line != "")
    ends = pages.select(*keys, T.running_form(F.get(found, F.lit(0))).alias("top"), T.running_form(F.get(found, F.size(found) - 1)).alias("bottom"))
    counted = ends.withColumns({
        "pages": F.count("*").over(Window.partitionBy(*keys)),
        "tops": F.count("top").over(Window.partitionBy(*keys, "top")),
        "bottoms": F.count("bottom").over(Window.partitionBy(*keys, "bottom")),
    })
    best = lambda n, line: F.min(F.when(F.col(line).isNotNull(), F.struct((-F.col(n)).alias("n"), F.col(line).alias("line"))))
    most = counted.groupBy(*keys).agg(best("tops", "top").alias("h"), best("bottoms", "bottom").alias("f"), F.greatest(F.lit(2), F.floor(F.max("pages") / 2)).alias("least"))
    pick = lambda c: F.when((-F.col(f"{c}.n") >= F.col("least")) & (F.col(f"{c}.line") != ""), F.col(f"{c}.line"))
    return most.select(*keys, pick("h").alias("header"), pick("f").alias("footer"))


def strip_running(blocks: DataFrame, lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks (keys, page and a block's columns) without a page's first block that is the header, nor then its last that is
    the footer. Headings stay."""
    page = Window.partitionBy(*keys, "page")
    # blocks of a page are together after the join on the document's keys, so neither window shuffles
    both = blocks.join(lines, list(keys), "left")
    same = lambda c: F.coalesce((F.col("type") != "heading") & (T.running_form("text") == F.col(c)), F.lit(False))
    headless = both.withColumn("__n", F.row_number().over(page.orderBy("order"))).where(~((F.col("__n") == 1) & same("header")))
    footless = headless.withColumn("__n", F.row_number().over(page.orderBy(F.desc("order")))).where(~((F.col("__n") == 1) & same("footer")))
    return footless.select(*blocks.columns)


def merge_wrapped(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A paragraph joins the one before it, unless that ends a sentence and it begins one; it joins a list item that
    doesn't end a sentence. Blocks are numbered anew on each page."""
    by = [*keys, "page"]
    order = Window.partitionBy(*by).orderBy("order")
    c = F.col
    para = c("type") == "paragraph"
    df = blocks.withColumns({"__ends": T.ends_sentence("text"), "__group": F.sum(F.when(para, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    group = Window.partitionBy(*by, "__group").orderBy("order")
    # a chain: paragraphs behind a list item of which nothing yet has ended a sentence
    df = df.withColumn("__chain", para & (F.first("type").over(group) == "listItem") & ~F.coalesce(F.bool_or("__ends").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    before = lambda x: F.lag(x).over(order)
    joins = para & (c("__chain") | F.coalesce((before("type") == "paragraph") & ~before("__chain") & ~(before("__ends") & T.starts_sentence("text")), F.lit(False)))
    df = df.withColumn("__island", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = lambda x: F.min_by(x, "order").alias(x)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("order", T.trim("text").alias("t")))), lambda x: x["t"])
    out = df.groupBy(*by, c("__island").cast("int").alias("order")).agg(first("type"), T.join_lines(pieces).alias("text"), *(first(x) for x in ("heading_level", "list_style", "list_depth", "list_index")))
    return out.select(*by, "order", "type", "text", "heading_level", "list_style", "list_depth", "list_index")


def page_blocks(pages: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The blocks of pages (keys, page, text), as parsed, without running lines and with wrapped lines merged."""
    return merge_wrapped(strip_running(blocks, running_lines(pages, keys, text), keys), keys)
