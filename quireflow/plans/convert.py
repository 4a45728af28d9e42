"""A folder of mixed documents to Markdown or JSON files and a report.

Each family of formats is a DataFrame from files to (path, output, error); they are united, named in scan order, written
one file for each document, and reported. An error is a row of the report, not a failed job. PDF files and images need a
provider: a function from the bytes to a list of page texts, or to a text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import text as T
from quireflow.operators import blocks as B
from quireflow.operators import delimited as D
from quireflow.operators import pages as P
from quireflow.operators import render as R
from quireflow.operators import rich
from quireflow.operators import values as V
from quireflow.sources import folder, importers, outputs

#: A converter: described files, "markdown" or "json", and the time, to path, output and error.
Converter = Callable[[DataFrame, str, str], DataFrame]
_KEYS = ["path"]
_JSON_NAME = {"name": "name", "extension": "extension"}


def _documents(files: DataFrame, blocks: DataFrame, form: str, at: str) -> DataFrame:
    """path and output of documents that are blocks."""
    if form == "json":
        made = R.blocks_json(files, blocks, at, _KEYS, **_JSON_NAME)
        return made.select("path", F.col("json").alias("output"))
    return R.markdown(files.withColumn("title", T.title("name")), blocks, _KEYS).select("path", F.col("markdown").alias("output"))


def _checked(made: DataFrame, bad: DataFrame) -> DataFrame:
    return made.select("path", "output", F.lit(None).cast("string").alias("error")).unionByName(bad.select("path", F.lit(None).cast("string").alias("output"), "error"))


def _invalid(files: DataFrame, wrong: Column) -> DataFrame:
    return files.where(wrong).select("path", F.lit(V.INVALID).alias("error"))


def text_converter(files: DataFrame, form: str, at: str) -> DataFrame:
    read = files.withColumn("text", folder.strict_text(F.col("content")))
    good = read.where("text IS NOT NULL")
    return _checked(_documents(good, B.blocks(good, _KEYS), form, at), _invalid(read, F.col("text").isNull()))


def source_converter(files: DataFrame, form: str, at: str) -> DataFrame:
    code = files.select("path", F.lit(1).alias("order"), F.lit("code").alias("type"), folder.lenient_text(F.col("content")).alias("text"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("string").alias("list_style"), F.lit(None).cast("int").alias("list_depth"), F.lit(None).cast("bigint").alias("list_index"))
    return _documents(files, code, form, at).withColumn("error", F.lit(None).cast("string"))


def delimited_converter(files: DataFrame, form: str, at: str) -> DataFrame:
    read = files.withColumn("text", folder.strict_text(F.col("content")))
    cells = read.where("text IS NOT NULL").withColumn("cells", D.rows("text", F.when(F.col("extension") == "tsv", "\t").otherwise(",")))
    some, c = F.size("cells") > 0, F.col("cells")
    columns, rows = D.column_names(c), D.data_rows(c)
    title = T.title("name")
    if form == "json":
        tables = F.when(some, F.array(F.struct(columns.alias("columns"), rows.alias("rows")))).otherwise(F.array().cast("array<struct<columns:array<string>,rows:array<array<string>>>>"))
        output = R.json_document(F.col("name"), F.col("extension"), F.lit(at), tables=tables, data=F.when(some, D.objects(c)))
    else:
        output = F.when(some, R.table_document(title, columns, rows)).otherwise(F.concat(F.lit("# "), title, F.lit("\n")))
    return _checked(cells.select("path", output.alias("output")), _invalid(read, F.col("text").isNull()))


def _value_converter(value: Callable[[Column], Column], lenient: bool, binary: bool = False) -> Converter:
    def convert(files: DataFrame, form: str, at: str) -> DataFrame:
        content = F.col("content") if binary else folder.lenient_text(F.col("content")) if lenient else folder.strict_text(F.col("content"))
        read = files.withColumn("v", value(content)).withColumns({"value": F.col("v.value"), "error": F.col("v.error")})
        wrong = F.col("value").isNull()
        good = read.where(~wrong)
        if form == "json":
            made = good.select("path", R.json_document(F.col("name"), F.col("extension"), F.lit(at), data=F.col("value")).alias("output"))
        else:
            made = _documents(good, V.value_blocks(good, _KEYS), form, at)
        return _checked(made, _invalid(read, wrong))

    return convert


def rich_converter(files: DataFrame, form: str, at: str) -> DataFrame:
    found = importers.paragraphs(files, "path", "content", "extension")
    wrong = found.where("error IS NOT NULL").select("path").distinct().withColumn("error", F.lit(V.INVALID))
    good = files.join(wrong.select("path"), "path", "left_anti")
    return _checked(_documents(good, rich.rich_blocks(found.where("error IS NULL"), _KEYS), form, at), wrong)


def image_converter(ocr: Callable[[bytes], str] | None) -> Converter:
    """Images by a function from bytes to text; without one each is an error."""

    def convert(files: DataFrame, form: str, at: str) -> DataFrame:
        if ocr is None:
            return _checked(files.limit(0).select("path", F.lit("").alias("output")), _invalid(files, F.lit(True)))
        read = _provided(files, lambda content: [ocr(content)])
        good = files.join(read.where("error IS NULL").select("path", F.get("texts", F.lit(0)).alias("text")), "path")
        return _checked(_documents(good, B.blocks(good, _KEYS), form, at), read.where("error IS NOT NULL"))

    return convert


def pdf_converter(text: Callable[[bytes], list[str]] | None) -> Converter:
    """PDF files by a function from bytes to the texts of the pages; without one each is an error."""

    def convert(files: DataFrame, form: str, at: str) -> DataFrame:
        if text is None:
            return _checked(files.limit(0).select("path", F.lit("").alias("output")), _invalid(files, F.lit(True)))
        read = _provided(files, text)
        pages = read.where("error IS NULL").select("path", F.posexplode("texts").alias("page", "text")).withColumn("page", F.col("page") + 1)
        parsed = P.page_blocks(pages, B.blocks(pages, ["path", "page"]), _KEYS)
        named = pages.join(files.select("path", "name", "extension", T.title("name").alias("title")), "path")
        if form == "json":
            made = R.paged_json(named, parsed, at, _KEYS, **_JSON_NAME).select("path", F.col("json").alias("output"))
        else:
            made = R.paged_markdown(named, parsed, _KEYS).select("path", F.col("markdown").alias("output"))
        return _checked(made, read.where("error IS NOT NULL"))

    return convert


def _provided(files: DataFrame, text: Callable[[bytes], list[str]]) -> DataFrame:
    """path, texts and error of what a provider gives."""

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for content in batch.column("content").to_pylist():
                try:
                    texts.append(list(text(content or b"")))
                    errors.append(None)
                except Exception:  # noqa: BLE001 - whatever a provider raises is that document's error
                    texts.append(None)
                    errors.append(V.INVALID)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.list_(pa.string())), pa.array(errors, pa.string())], names=["path", "texts", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, texts array<string>, error string")


def converters(ocr: Callable[[bytes], str] | None = None, pdf: Callable[[bytes], list[str]] | None = None) -> dict[str, tuple[tuple[str, ...], Converter]]:
    """Extensions and converter by name; add to it or replace in it to extend the engine."""
    made: dict[str, Converter] = {
        "pdf": pdf_converter(pdf),
        "rich": rich_converter,
        "delimited": delimited_converter,
        "json": _value_converter(V.json_value, lenient=False),
        "xml": _value_converter(V.xml_value, lenient=False, binary=True),
        "plist": _value_converter(V.plist_value, lenient=False, binary=True),
        "ini": _value_converter(V.ini_value, lenient=True),
        "image": image_converter(ocr),
        "text": text_converter,
        "source": source_converter,
    }
    return {name: (folder.CONVERTERS[name], c) for name, c in made.items()}


def convert(files: DataFrame, form: str, at: str, using: dict[str, tuple[tuple[str, ...], Converter]] | None = None) -> DataFrame:
    """path, output and error of classified files that have a converter."""
    out = None
    for name, (_, run) in (using or converters()).items():
        own = files.where((F.col("converter") == name) & F.col("read_error").isNull())
        made = run(own, form, at).select("path", "output", "error")
        out = made if out is None else out.unionByName(made)
    unread = files.where(F.col("status").isNull() & F.col("read_error").isNotNull()).select("path", F.lit(None).cast("string").alias("output"), F.col("read_error").alias("error"))
    out = unread if out is None else out.unionByName(unread)
    return R.prettied(out, "output") if form == "json" else out


def convert_folder(spark: SparkSession, source: str, target: str, form: str = "markdown", at: str | None = None, using: dict[str, tuple[tuple[str, ...], Converter]] | None = None) -> DataFrame:
    """Converts the files of a folder into another and gives the report: name, label, extension, status, message,
    output_path, started_at and finished_at for each entry, ordered by name. at: the time that documents are stamped with,
    now by default."""
    if form not in ("markdown", "json"):
        raise ValueError("form is markdown or json")
    started = datetime.now(timezone.utc)
    at = at or started.strftime("%Y-%m-%dT%H:%M:%SZ")
    using = using or converters()
    known = {name: extensions for name, (extensions, _) in using.items()}
    listed = folder.files(spark, source, extensions=[e for extensions in known.values() for e in extensions])
    # each converter and the report take their rows from this: a file is opened once
    described = folder.classify(folder.descriptor(listed), known).persist(StorageLevel.DISK_ONLY)
    done = convert(described, form, at, using).persist(StorageLevel.DISK_ONLY_2)
    try:
        extension = {"markdown": "md", "json": "json"}[form]
        names = done.where("error IS NULL").select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
        named = outputs.planned(names, target, extension)
        written = outputs.write(done.where("error IS NULL").join(named, "path"))
        result = spark.createDataFrame(written.collect(), "output_path string, error string")  # names and errors only
    finally:
        ended = done.select("path", "error").where("error IS NOT NULL").collect()
        done.unpersist()
        described.unpersist()
    failed = spark.createDataFrame(ended, "path string, failure string")
    wrote = named.join(result.withColumnRenamed("error", "write_error"), "output_path")
    entries = folder.classify(folder.descriptor(folder.files(spark, source, content=False)), known).join(failed, "path", "left").join(wrote, "path", "left")
    failure = F.coalesce("failure", "write_error")
    return entries.select(
        "name", outputs.label().alias("label"), "extension",
        F.when(F.col("status").isNotNull(), F.col("status")).when(failure.isNotNull(), "failed").otherwise("converted").alias("status"),
        F.when(F.col("status").isNotNull(), F.col("message")).when(failure.isNotNull(), failure).when(F.col("was_renamed"), outputs.renamed_message()).alias("message"),
        F.when(failure.isNull(), F.col("output_path")).alias("output_path"), F.lit(started).alias("started_at"), F.lit(datetime.now(timezone.utc)).alias("finished_at"),
    ).orderBy(*folder.scan_order())
