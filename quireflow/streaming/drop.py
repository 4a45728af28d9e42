"""A folder that files are dropped into, as a stream: each new file is converted once.

Spark's file stream finds the files and remembers in the checkpoint which are done; a batch is converted as a folder is,
so the converters hold no state between batches. Names that begin with a dot or an underscore and files of no bytes are
passed over by that stream; ``convert_folder`` takes those.

A batch may run again after a failure. The names of its outputs are written before the files are, so that it gives the same
files again, and its rows of the report take the place of those of the first time.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quireflow.plans import convert
from quireflow.sources import folder, outputs

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, form: str = "markdown", at: str | None = None, using: dict | None = None, every: str | None = None) -> StreamingQuery:
    """Starts the stream. In the folder ``checkpoint`` are its state and, in report/batch=..., path, status, message and
    output_path of each file. at: the time that documents are stamped with, by default that of the batch. every: the time between batches, such as "1 minute"; without it, what is there is done and the
    query ends."""
    using = using or convert.converters()
    known = {name: extensions for name, (extensions, _) in using.items()}

    def batch(files: DataFrame, number: int) -> None:
        names_at, report_at = f"{checkpoint}/names/batch={number}", f"{checkpoint}/report/batch={number}"
        path = F.regexp_replace("path", "^file:/*", "/")
        named = files.select(path.alias("path"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.lit(False).alias("is_dir"), "content", F.lit(None).cast("string").alias("read_error"))
        described = folder.classify(folder.descriptor(named), known).persist(StorageLevel.DISK_ONLY)
        done = convert.convert(described, form, at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), using).persist(StorageLevel.DISK_ONLY)
        try:
            names = spark.read.parquet(names_at)
        except AnalysisException:  # not there: the batch runs for the first time
            good = done.where("error IS NULL").select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
            outputs.planned(good, target, {"markdown": "md", "json": "json"}[form]).write.parquet(names_at)
            names = spark.read.parquet(names_at)
        written = outputs.write(done.where("error IS NULL").join(names, "path")).withColumnRenamed("error", "write_error")
        ended = described.select("path", "status", "message").join(done.select("path", "error"), "path", "left").join(names, "path", "left").join(written, "output_path", "left")
        failure = F.coalesce("error", "write_error")
        ended.select(
            "path", F.when(F.col("status").isNotNull(), F.col("status")).when(failure.isNotNull(), "failed").otherwise("converted").alias("status"),
            F.coalesce("message", failure, F.when(F.col("was_renamed"), outputs.renamed_message())).alias("message"), F.when(failure.isNull(), F.col("output_path")).alias("output_path"),
        ).write.mode("overwrite").parquet(report_at)
        done.unpersist()
        described.unpersist()

    stream = spark.readStream.format("binaryFile").schema(SCHEMA).load(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
