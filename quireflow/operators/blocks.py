"""Plain text to blocks: headings, paragraphs and list items.

Rows are documents; the result has a row for each block. The rules look at lines in order, but each is a window over
one ordering of a document's lines, so the whole takes one shuffle, by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as T

_S = T.SPACE
ATX = rf"^(#{{1,6}})[{_S}]+(.+)$"
LIST = rf"^([{_S}]*)([-*]|\p{{Nd}}+[.)]|[A-Za-z][.)])[{_S}]+(.+)$"
UNDERLINE = r"^(={3,}|-{3,})$"
#: Columns of a block, after the document's keys.
COLUMNS = ["order", "type", "text", "heading_level", "list_style", "list_depth", "list_index"]


def list_style(marker: Column) -> Column:
    ordered = marker.rlike("[A-Za-z]") | list_index(marker).isNotNull()
    return F.when(ordered, "ordered").otherwise("unordered")


def list_index(marker: Column) -> Column:
    """The number of a marker, null where it has none (or one of more digits than fit)."""
    return F.regexp_extract(marker, "^([0-9]+)", 1).try_cast("bigint")


def lines(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, pos, raw and t (without white space at the ends), a row for each line; bullets become hyphens."""
    c = F.col
    clean = docs.select(*keys, T.line_feeds(text).alias("__clean"))
    split = clean.select(*keys, F.posexplode(T.split_lines("__clean")).alias("pos", "__line"))
    raw = F.when(c("__line").contains("•"), F.replace("__line", F.lit("•"), F.lit("- "))).otherwise(c("__line"))
    return split.select(*keys, "pos", raw.alias("raw")).withColumn("t", T.trim("raw"))


def _told(numbered: DataFrame) -> DataFrame:
    """Adds to lines what each tells by itself: rule (the first character of an underline, else empty), blank, hashes and
    marker (of a heading and a list item, else empty), indent, piece (what it has for the text of its block) and look
    (whether it looks like a heading)."""
    c = F.col
    df = numbered.withColumns({
        "rule": F.when((c("t").startswith("=") | c("t").startswith("-")) & c("t").rlike(UNDERLINE), F.substring("t", 1, 1)).otherwise(""),
        "blank": c("t") == "",
        "hashes": F.when(c("t").startswith("#"), F.regexp_extract("t", ATX, 1)).otherwise(""),
        "marker": F.regexp_extract("raw", LIST, 2),
    })
    listed = c("marker") != ""
    space = F.when(listed, F.regexp_extract("raw", LIST, 1)).when(c("raw").startswith(" ") | c("raw").startswith("\t"), F.regexp_extract("raw", "^([ \t]*)", 1)).otherwise("")
    part = F.when(c("hashes") != "", F.regexp_extract("t", ATX, 2)).when(listed, F.regexp_extract("raw", LIST, 3)).otherwise(c("t"))
    df = df.withColumns({"space": space, "part": part}).withColumn("piece", T.collapsed("part"))
    return df.withColumns({"indent": T.indent_width("space"), "look": (c("hashes") == "") & ~listed & T.looks_like_heading("t", c("piece"))})


def labelled(numbered: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds to lines: label (underline, blank, atx, setext, list, next, heading, paragraph), where next continues a list
    item, and island, the number of the block that a line belongs to or follows."""
    order = Window.partitionBy(*keys).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col
    # patterns are tried before the shuffle: the windows carry what they found, and no text but that of the block
    df, u = _told(numbered), c("rule") != ""
    df = df.withColumns({
        "next_rule": F.lead("rule", 1, "").over(order),
        "next_blank": F.lead("blank", 1, True).over(order),
        # lines of a row of underlines are used up in turns, from the first if a heading's text comes before them
        "nth": c("pos") - F.coalesce(F.max(F.when(~u, c("pos"))).over(upto), F.lit(-1)),
        "before": F.coalesce(F.last(F.when(~u, ~c("blank") & (c("hashes") == "")), True).over(upto), F.lit(False)),
    })
    used = u & (F.when(c("before"), c("nth") % 2 == 1).otherwise(c("nth") % 2 == 0))
    label = F.when(used, "underline").when(c("blank"), "blank").when(c("hashes") != "", "atx").when(c("next_rule") != "", "setext").when(c("marker") != "", "list").otherwise("other")
    df = df.withColumn("label", label)
    listed = c("label") == "list"
    df = df.withColumns({"item": F.max(F.when(listed, c("pos"))).over(upto), "item_indent": F.last(F.when(listed, c("indent")), True).over(upto)})
    deeper = (c("label") == "other") & (c("indent") > c("item_indent"))
    df = df.withColumn("broken", F.max(F.when(~listed & ~F.coalesce(deeper, F.lit(False)), c("pos"))).over(upto))
    goes_on = F.coalesce(deeper & (F.coalesce(c("broken"), F.lit(-1)) < c("item")), F.lit(False))
    df = df.withColumn("label", F.when(c("label") != "other", c("label")).when(goes_on, "next").when(c("next_blank") & c("look"), "heading").otherwise("paragraph"))
    again = (c("label") == "paragraph") & F.coalesce(F.lag("label").over(order) == "paragraph", F.lit(False))
    starts = c("label").isin("atx", "setext", "list", "heading") | ((c("label") == "paragraph") & ~again)
    return df.withColumn("starts", starts).withColumn("island", F.sum(c("starts").cast("int")).over(upto))


def blocks(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and the columns of a block. A null text has no blocks."""
    c = F.col
    marked = labelled(lines(docs, keys, text), keys).where(~c("label").isin("blank", "underline"))
    level = F.when(c("label") == "atx", F.length("hashes")).when(c("label") == "setext", F.when(c("next_rule") == "=", 1).otherwise(2)).when(c("label") == "heading", 1)
    # a line with a marker that an underline makes a heading keeps the marker
    piece = F.when((c("label") == "setext") & (c("marker") != ""), F.rtrim(F.concat("marker", F.lit(" "), "piece"))).otherwise(c("piece"))
    head = lambda x: F.max(F.when(c("starts"), x))
    found = marked.withColumn("piece", piece).groupBy(*keys, "island").agg(
        head(F.when(c("label") == "list", "listItem").when(c("label") == "paragraph", "paragraph").otherwise("heading")).alias("type"),
        F.transform(F.array_sort(F.collect_list(F.when(c("piece") != "", F.struct("pos", "piece")))), lambda x: x["piece"]).alias("pieces"),
        head(level).cast("int").alias("heading_level"),
        head(F.when(c("label") == "list", list_style(c("marker")))).alias("list_style"),
        head(F.when(c("label") == "list", F.floor(c("indent") / 2))).cast("int").alias("list_depth"),
        head(F.when(c("label") == "list", list_index(c("marker")))).alias("list_index"),
    )
    joined = found.where("size(pieces) > 0").withColumn("text", T.join_lines("pieces"))
    return joined.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("island"))).select(*keys, *COLUMNS)
