"""Names for converted files, a writer that never replaces a file, and the report."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.sources.folder import descriptor_of


def _normal(path: str) -> str:
    return os.path.normpath(path).lower()


def plan(sources: Iterable[str], target: str, extension: str, exists: Callable[[str], bool] = os.path.exists, reserved: Iterable[str] = ()) -> list[tuple[str, str, bool]]:
    """(source, output, renamed) in the order of the sources. A name that the source itself, an earlier output or an
    existing file has is followed by the same with the source's extension, and then with numbers from 2."""
    taken, out = {_normal(p) for p in reserved}, []
    for source in sources:
        base, ext, _ = descriptor_of(os.path.basename(source))
        qualified = f"{base}-{ext}" if ext else base
        n, name = 0, base
        while True:
            path = os.path.join(target, f"{name}.{extension}")
            if _normal(path) != _normal(source) and _normal(path) not in taken and not exists(path):
                break
            n += 1
            name = qualified if n == 1 else f"{qualified}-{n}"
        taken.add(_normal(path))
        out.append((source, path, n > 0))
    return out


def planned(converted: DataFrame, target: str, extension: str) -> DataFrame:
    """path, output_path and was_renamed for converted files (path, name). Only names come to the driver, in scan order,
    as each name depends on those before it."""
    from quireflow.sources.folder import scan_order

    paths = [r.path for r in converted.select("path", "name").orderBy(*scan_order()).select("path").collect()]
    return converted.sparkSession.createDataFrame(plan(paths, target, extension), "path string, output_path string, was_renamed boolean")


def write(documents: DataFrame) -> DataFrame:
    """output_path and error, from rows of output_path and output, each written as one UTF-8 file: to a file beside it,
    then linked to its name, which fails if there is one. Run again after a lost executor, a task finds its own file, of
    the same bytes, and that counts as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, errors = batch.column("output_path").to_pylist(), []
            for path, text in zip(paths, batch.column("output").to_pylist()):
                error = None
                data = (text or "").encode()
                try:
                    folder = os.path.dirname(path)
                    os.makedirs(folder, exist_ok=True)
                    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
                    try:
                        with os.fdopen(handle, "wb") as file:
                            file.write(data)
                        try:
                            os.link(temporary, path)
                        except FileExistsError:
                            with open(path, "rb") as file:
                                error = None if file.read() == data else "A file of that name exists."
                    finally:
                        os.unlink(temporary)
                except OSError as e:
                    error = e.strerror
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("output_path"), pa.array(errors, pa.string())], names=["output_path", "error"])

    return documents.select("output_path", "output").mapInArrow(run, "output_path string, error string")


def renamed_message(path: str = "output_path"):
    return F.concat(F.lit("Saved as "), F.regexp_extract(path, "([^/]+)$", 1), F.lit(" to avoid overwriting another file."))


def summary(report: DataFrame) -> DataFrame:
    """total, converted, skipped, failed and summary of a report (status), and, where it has the times, started_at,
    finished_at and duration in seconds."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    timed = {"started_at", "finished_at"} <= set(report.columns)
    times = [F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at")] if timed else []
    counted = report.agg(F.count("*").alias("total"), n("converted"), n("skipped"), n("failed"), *times)
    if timed:
        counted = counted.withColumn("duration", F.col("finished_at").cast("double") - F.col("started_at").cast("double"))
    return counted.withColumn("summary", F.format_string("Converted %d of %d files (Skipped %d, Failed %d).", "converted", "total", "skipped", "failed"))


def label():
    """A file in a report: name and extension, or the name alone."""
    return F.when(F.col("extension") == "", F.col("report_base")).otherwise(F.concat("report_base", F.lit("."), "extension"))
