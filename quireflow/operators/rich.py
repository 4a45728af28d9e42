"""Paragraphs with font sizes and lists to blocks: headings by size relative to the body text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators.blocks import ATX, COLUMNS, list_index, list_style

_S = T.SPACE
LIST = rf"^[{_S}]*([-*•◦▪‣]|\p{{Nd}}+[.)]|[A-Za-z][.)])[{_S}]+(.+)$"
SIZE = 12.0


def body_size(paragraphs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keys and body_size: the upper median of the paragraphs' sizes, blank ones included."""
    size = F.when(F.coalesce("max_size", F.lit(0.0)) > 0, F.col("max_size")).otherwise(F.lit(SIZE)).cast("double")
    return paragraphs.groupBy(*keys).agg(F.array_sort(F.collect_list(size)).alias("s")).select(*keys, F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("body_size"))


def rich_blocks(paragraphs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Blocks from paragraphs (keys, para, text, max_size, bold, list_path): a Markdown heading, else a list item (by
    list_path, the formats of its lists from the outside in, or by its marker), else a heading by size or, bold, by look,
    else a paragraph. Blank paragraphs have no block."""
    c = F.col
    # each pattern is tried once for a row: what several columns need is a column of its own first
    sized = paragraphs.where(c("text").rlike(f"[^{_S}]")).join(body_size(paragraphs, keys), list(keys)).withColumn("t", T.trim("text"))
    ratio = F.when(F.coalesce("max_size", F.lit(0.0)) > 0, c("max_size")).otherwise(F.lit(SIZE)) / F.greatest(c("body_size"), F.lit(1.0))
    read = sized.withColumns({"ratio": ratio, "flat": T.collapse("t"), "hashes": F.when(c("t").startswith("#"), F.regexp_extract("t", ATX, 1)).otherwise(""), "marker": F.regexp_extract("t", LIST, 1)})
    by_size = F.when(c("ratio") >= 1.8, 1).when(c("ratio") >= 1.5, 2).when(c("ratio") >= 1.3, 3).when(F.coalesce("bold", F.lit(False)) & T.looks_like_heading("t", c("flat")), 4)
    in_list = F.coalesce(F.size("list_path"), F.lit(0)) > 0
    level = F.when(c("hashes") != "", F.length("hashes")).when(~in_list & (c("marker") == ""), by_size)
    kind = F.when(c("hashes") != "", "atx").when(in_list, "styled").when(c("marker") != "", "marked").when(c("level").isNotNull(), "heading").otherwise("paragraph")
    text = F.when(c("kind") == "atx", T.collapse(F.regexp_extract("t", ATX, 2))).when(c("kind").isin("styled", "marked") & (c("marker") != ""), T.collapse(F.regexp_extract("t", LIST, 2))).otherwise(c("flat"))
    format_ = F.lower(F.get("list_path", F.size("list_path") - 1))
    out = read.withColumn("level", level.cast("int")).withColumn("kind", kind).select(
        *keys, "para", "kind",
        F.when(c("kind").isin("styled", "marked"), "listItem").when(c("kind") == "paragraph", "paragraph").otherwise("heading").alias("type"),
        text.alias("text"),
        c("level").alias("heading_level"),
        F.when(c("kind") == "styled", F.when(format_.rlike("decimal|upper|lower"), "ordered").otherwise("unordered")).when(c("kind") == "marked", list_style(c("marker"))).alias("list_style"),
        F.when(c("kind") == "styled", F.size("list_path") - 1).when(c("kind") == "marked", 0).cast("int").alias("list_depth"),
        F.when(c("kind") == "marked", list_index(c("marker"))).alias("list_index"),
    )
    return out.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("para"))).select(*keys, *COLUMNS)
