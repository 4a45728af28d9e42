"""Files of a folder as rows, their description, and which converter takes each.

``spark.read.format("folder")`` lists one folder, not the folders in it, with names that begin with a dot or an
underscore, which Spark's file sources pass over. Options: ``path``; ``content`` (true by default), without which no file
is opened; ``extensions``, a list parted by commas: only such files are opened; ``files``, how many a task reads.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Extensions by converter, in the order in which converters are asked.
CONVERTERS: dict[str, tuple[str, ...]] = {
    "pdf": ("pdf",),
    "rich": ("docx", "doc", "rtf", "rtfd", "odt", "html", "htm", "webarchive"),
    "delimited": ("csv", "tsv"),
    "json": ("json",),
    "xml": ("xml",),
    "plist": ("plist",),
    "ini": ("ini", "cfg", "properties", "env"),
    "image": ("png", "jpg", "jpeg", "heic", "tiff", "tif"),
    "text": ("txt", "md", "markdown", "mdown"),
    "source": tuple("yaml yml toml conf log swift py js mjs cjs ts tsx jsx java kt kts c h cpp cc cxx hpp cs rb go rs sh bash zsh sql css scss less php pl r lua dart scala groovy gradle tex rst adoc org vue svelte".split()),
}


def descriptor_of(name: str) -> tuple[str, str, str]:
    """Base name, extension in lower case, and base name for reports."""
    stem, dot, ext = name.rpartition(".")
    if not dot or not ext:
        return name, "", name
    return stem or ext, ext.lower(), stem


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.content = str(options.get("content", "true")).lower() == "true"
        given = options.get("extensions")
        self.extensions = None if given is None else {e.strip().lower() for e in given.split(",")}
        self.files, self.bytes = int(options.get("files", "1000")), 64 << 20

    def partitions(self) -> list[InputPartition]:
        parts: list[list[str]] = [[]]
        size = 0
        with os.scandir(self.path) as found:
            for entry in found:
                own = entry.stat().st_size if self.content and entry.is_file() else 0
                if parts[-1] and (len(parts[-1]) >= self.files or size + own > self.bytes):
                    parts.append([])
                    size = 0
                parts[-1].append(entry.name)
                size += own
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(self.path, name)
            is_dir, content, error = os.path.isdir(path), None, None
            wanted = self.content and not is_dir and (self.extensions is None or descriptor_of(name)[1] in self.extensions)
            if wanted:
                try:
                    with open(path, "rb") as file:
                        content = file.read()
                except OSError as e:
                    error = e.strerror
            yield path, name, is_dir, content, error


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, name string, is_dir boolean, content binary, read_error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def files(spark: SparkSession, path: str, content: bool = True, extensions: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folder").option("path", path).option("content", str(content).lower())
    return (reader.option("extensions", ",".join(extensions)) if extensions is not None else reader).load()


def descriptor(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds base_name, extension (lower case), report_base and is_hidden. A name that is a dot and a word has the word as
    its base name and its extension, and nothing for reports."""
    n = F.col(name)
    ext = F.regexp_extract(n, r"\.([^.]+)$", 1)
    stem = F.regexp_replace(n, r"\.[^.]+$", "")
    return files.withColumns({
        "base_name": F.when(ext == "", n).when(stem == "", ext).otherwise(stem),
        "extension": F.lower(ext),
        "report_base": F.when(ext == "", n).otherwise(stem),
        "is_hidden": n.startswith("."),
    })


def converter(extension: Column, converters: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The converter for an extension, null where there is none."""
    chosen = F.lit(None).cast("string")
    for name, extensions in reversed((converters or CONVERTERS).items()):
        chosen = F.when(extension.isin(*extensions), name).otherwise(chosen)
    return chosen


def classify(files: DataFrame, converters: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds to described files: converter, and status and message of those that are skipped."""
    chosen = files.withColumn("converter", converter(F.col("extension"), converters))
    no = F.col("converter").isNull()
    message = (
        F.when(F.coalesce("is_dir", F.lit(False)), "Directory.")
        .when(F.col("is_hidden") & no, "Hidden file.")
        .when(no & (F.col("extension") == ""), "Unsupported file type (no file extension).")
        .when(no, F.concat(F.lit("Unsupported file type (."), F.col("extension"), F.lit(").")))
    )
    return chosen.withColumn("message", message).withColumn("status", F.when(F.col("message").isNotNull(), "skipped"))


def scan_order() -> list[Column]:
    """By name, upper and lower case alike, then by name."""
    return [F.collate("name", "UNICODE_CI"), F.col("name")]


def strict_text(content: Column) -> Column:
    """UTF-8 without a byte order mark's loss; null where the bytes aren't UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def lenient_text(content: Column) -> Column:
    """UTF-8, else UTF-16 by its byte order mark, else Latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    wide = F.when(head.isin("FFFE", "FEFF") & (F.octet_length(content) % 2 == 0), F.decode(content, "UTF-16"))
    return F.coalesce(strict_text(content), wide, F.decode(content, "ISO-8859-1"))
