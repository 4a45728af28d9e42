"""Blocks, tables, pages and values to Markdown and to versioned JSON."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import text as T

VERSION = "1.1"
NO_TEXT = "_No extractable text on this page._"


def heading_line(text: Column, level: Column, base: Column | int) -> Column:
    base = F.lit(base) if isinstance(base, int) else base
    hashes = F.least(F.lit(6), F.greatest(F.lit(1), base + F.coalesce(level, F.lit(1)) - 1))
    return F.concat(F.repeat(F.lit("#"), hashes), F.lit(" "), text)


def list_lines(text: Column, depth: Column, style: Column, index: Column) -> Column:
    """A list item with its marker, further lines under its text."""
    marker = F.when(style == "ordered", F.concat(F.coalesce(index.cast("string"), F.lit("1")), F.lit(". "))).otherwise("- ")
    prefix = F.concat(F.repeat(F.lit("  "), F.greatest(F.coalesce(depth, F.lit(0)), F.lit(0))), marker)
    return F.concat(prefix, F.replace(T.wrap(text, F.length(prefix)), F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(prefix)))))


def code_lines(text: Column) -> Column:
    fence = T.fence(text)
    return F.concat(fence, F.lit("\n"), F.regexp_replace(text, "\n\\z", ""), F.lit("\n"), fence)


def block_lines(base: Column | int) -> Column:
    """The lines of a block, from its columns."""
    c = F.col
    return (
        F.when(c("type") == "heading", heading_line(c("text"), c("heading_level"), base))
        .when(c("type") == "listItem", list_lines(c("text"), c("list_depth"), c("list_style"), c("list_index")))
        .when(c("type") == "code", code_lines(c("text")))
        .otherwise(T.wrap("text"))
    )


def _body(blocks: DataFrame, keys: Sequence[str], base: int | None) -> DataFrame:
    """keys, body and headed (whether the first block is a heading). Blocks are a blank line apart, list items not. base:
    the level of a heading of level 1; without one, 1 where the first block is a heading and else 2."""
    c = F.col
    shown = blocks.where((c("text") != "") | (c("type") == "code"))
    # only the marks of a heading depend on the first block
    lines = F.when(c("type") == "heading", c("text")).otherwise(block_lines(1))
    listed = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order", "type", "heading_level", lines.alias("lines")))).alias("__blocks"))
    first = listed.withColumn("headed", F.get("__blocks", F.lit(0))["type"] == "heading")
    level = F.when(c("headed"), 1).otherwise(2) if base is None else F.lit(base)

    def piece(x: Column, i: Column) -> Column:
        before = F.get("__blocks", i - 1)["type"]
        between = F.when(i == 0, "").when((before == "listItem") & (x["type"] == "listItem"), "\n").otherwise("\n\n")
        return F.concat(between, F.when(x["type"] == "heading", heading_line(x["lines"], x["heading_level"], level)).otherwise(x["lines"]))

    return first.select(*keys, F.array_join(F.transform("__blocks", piece), "").alias("body"), "headed")


def _finished(c: Column) -> Column:
    return F.concat(T.trim(c), F.lit("\n"))


def markdown(docs: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("doc_id",), title: str = "title") -> DataFrame:
    """keys and markdown for each row of docs (keys and a title), from its blocks. The title heads a document that
    doesn't begin with a heading."""
    both = docs.select(*keys, F.coalesce(F.col(title), F.lit("")).alias("__title")).join(_body(blocks, keys, None), list(keys), "left")
    text = F.when(F.col("headed"), F.col("body")).otherwise(F.concat(F.lit("# "), F.col("__title"), F.coalesce(F.concat(F.lit("\n\n"), F.col("body")), F.lit(""))))
    return both.select(*keys, _finished(text).alias("markdown"))


def paged_markdown(pages: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("doc_id",), title: str = "title") -> DataFrame:
    """keys and markdown, from pages (keys, page, title) and blocks with a page. Pages are numbered in their order."""
    by = [*keys, "page"]
    numbered = pages.select(*by, F.coalesce(F.col(title), F.lit("")).alias("__title")).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("page")))
    shown = numbered.join(_body(blocks, by, 3), by, "left")
    piece = F.concat(F.lit("## Page "), F.col("n").cast("string"), F.lit("\n\n"), F.coalesce(F.col("body"), F.lit(NO_TEXT)))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))), lambda x: x["piece"])
    return shown.groupBy(*keys).agg(_finished(F.concat(F.lit("# "), F.first("__title"), F.lit("\n\n"), F.array_join(pieces, "\n\n"))).alias("markdown"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is found once, however often it is used, even in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def table_markdown(columns: Column, rows: Column) -> Column:
    """A table of an array of column names and an array of rows (arrays, which may be short or long): cells are padded
    to the widest of their column. No columns give an empty text."""

    def table(head: Column, cells: Column) -> Column:
        widths = F.aggregate(cells, F.transform(head, F.length), lambda w, r: F.zip_with(w, r, lambda a, b: F.greatest(a, F.length(b))))

        def lines(w: Column) -> Column:
            line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, w, T.pad), " | "), F.lit(" |"))
            rule = F.concat(F.lit("| "), F.array_join(F.transform(w, lambda x: F.repeat(F.lit("-"), F.greatest(x, F.lit(3)))), " | "), F.lit(" |"))
            return F.array_join(F.concat(F.array(line(head), rule), F.transform(cells, line)), "\n")

        return F.when(F.size(head) == 0, "").otherwise(_let(widths, lines))

    # a row as long as the head: what is too much goes, what lacks is empty
    fitted = lambda r, head: F.transform(F.arrays_zip(head.alias("h"), F.slice(F.transform(F.coalesce(r, F.array().cast("array<string>")), T.escape_cell), F.lit(1), F.size(head)).alias("c")), lambda x: F.coalesce(x["c"], F.lit("")))
    return _let(F.transform(columns, T.escape_cell), lambda head: _let(F.transform(rows, lambda r: fitted(r, head)), lambda cells: table(head, cells)))


def table_document(title: Column, columns: Column, rows: Column, table_title: Column | None = None) -> Column:
    """A document of one table. table_title: a heading over it."""
    over = F.lit("") if table_title is None else F.when(F.coalesce(table_title, F.lit("")) != "", F.concat(F.lit("## "), table_title, F.lit("\n\n"))).otherwise("")
    body = lambda table: _finished(F.concat(F.lit("# "), title, F.when(table == "", "").otherwise(F.concat(F.lit("\n\n"), table))))
    return _let(F.concat(over, table_markdown(columns, rows)), body)


def _block_json() -> Column:
    c = F.col
    return F.struct(c("heading_level").alias("headingLevel"), c("list_depth").alias("listDepth"), c("list_index").alias("listIndex"), c("list_style").alias("listStyle"), "order", "text", "type")


def json_document(name: Column, extension: Column, converted_at: Column, *, blocks: Column | None = None, pages: Column | None = None, tables: Column | None = None, data: Column | None = None) -> Column:
    """A versioned JSON document with sorted keys; empty parts are left out. blocks and pages: arrays of structs, tables:
    an array of structs, data: a JSON text, which is taken as it is (a null is no data; the text null is data)."""
    none = F.lit(None).cast("string")
    full = lambda a: none if a is None else F.when(F.size(a) > 0, F.to_json(a))
    member = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))
    data = none if data is None else data
    content = F.concat_ws(",", member("blocks", full(blocks)), member("data", data), member("pages", full(pages)), member("tables", full(tables)))
    count = F.lit(0) if blocks is None else F.size(blocks)
    if pages is not None:
        count = F.aggregate(pages, F.lit(0), lambda n, p: n + p["blockCount"])
    summary = F.to_json(F.struct(count.alias("blockCount"), F.when(data.isNotNull(), True).alias("dataPresent"), (F.lit(None).cast("int") if pages is None else F.size(pages)).alias("pageCount"), (F.lit(None).cast("int") if tables is None else F.when(F.size(tables) > 0, F.size(tables))).alias("tableCount")))
    source = F.to_json(F.struct(converted_at.alias("convertedAt"), F.lower(extension).alias("fileExtension"), name.alias("fileName")))
    return F.concat(F.lit('{"content":{'), content, F.lit('},"source":'), source, F.lit(',"summary":'), summary, F.lit(f',"version":"{VERSION}"}}'))


def blocks_json(docs: DataFrame, blocks: DataFrame, converted_at: str, keys: Sequence[str] = ("doc_id",), name: str = "name", extension: str = "extension") -> DataFrame:
    """keys and json for each row of docs (keys, a name and an extension)."""
    listed = blocks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", _block_json().alias("b")))), lambda x: x["b"]).alias("__blocks"))
    both = docs.select(*keys, F.col(name).alias("__name"), F.col(extension).alias("__ext")).join(listed, list(keys), "left")
    return both.select(*keys, json_document(F.col("__name"), F.col("__ext"), F.lit(converted_at), blocks=F.coalesce(F.col("__blocks"), F.array().cast(listed.schema["__blocks"].dataType))).alias("json"))


def paged_json(pages: DataFrame, blocks: DataFrame, converted_at: str, keys: Sequence[str] = ("doc_id",), name: str = "name", extension: str = "extension") -> DataFrame:
    """keys and json, from pages (keys, page, name, extension) and blocks with a page."""
    by = [*keys, "page"]
    listed = blocks.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", _block_json().alias("b")))), lambda x: x["b"]).alias("bs"))
    numbered = pages.select(*by, F.col(name).alias("__name"), F.col(extension).alias("__ext")).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("page"))).join(listed, by, "left")
    bs = F.coalesce("bs", F.array().cast(listed.schema["bs"].dataType))
    page = F.struct(F.size(bs).alias("blockCount"), bs.alias("blocks"), F.col("n").alias("page"))
    arrays = numbered.groupBy(*keys).agg(F.first("__name").alias("__name"), F.first("__ext").alias("__ext"), F.transform(F.array_sort(F.collect_list(F.struct("n", page.alias("p")))), lambda x: x["p"]).alias("ps"))
    return arrays.select(*keys, json_document(F.col("__name"), F.col("__ext"), F.lit(converted_at), pages=F.col("ps")).alias("json"))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def indented(text: str) -> str:
    """JSON with two spaces for each level; the text of numbers and strings stays as it is."""
    out: list[str] = []
    depth, opened = 0, False
    for token in _TOKEN.findall(text):
        if token in "}]":
            depth -= 1
            out.append(token if opened else "\n" + "  " * depth + token)
            opened = False
            continue
        if opened:
            out.append("\n" + "  " * depth)
        opened = token in "{["
        if token == ",":
            out.append(",\n" + "  " * depth)
        elif token == ":":
            out.append(" : ")
        else:
            out.append(token)
            depth += opened
    return "".join(out)


def prettied(df: DataFrame, column: str) -> DataFrame:
    """The rows with the JSON texts of a column indented; nulls stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(column)
            texts = [None if t is None else indented(t) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)
