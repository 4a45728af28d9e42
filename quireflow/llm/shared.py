"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Documents in an Arrow batch.
ROWS = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and Spark runs in one process, as in tests, a temporary one,
    which is then set; on a cluster that is an error, as executors share no temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not given:
        set_ = context._jsc.sc().getCheckpointDir()
        if not set_.isDefined() and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = set_.get() if set_.isDefined() else tempfile.mkdtemp(prefix="quireflow-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(given)
    return given.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without what they were made from."""
    folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a folder in the place of another; nothing happens where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path(source)):
        system.delete(path(target), True)
        if not system.rename(path(source), path(target)):
            raise OSError(f"{source} can't be moved to {target}")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python at most ``ROWS`` at a time, unless the session says otherwise: a batch of documents is held by the
    JVM and by Python."""
    if spark.conf.get(_ROWS) == "10000":  # Spark's default
        spark.conf.set(_ROWS, str(ROWS))
