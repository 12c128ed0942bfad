"""Where the operators of this subpackage cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Frees the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may leave it unset (tests, a single machine); it gets a temporary folder then.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def folder(spark: SparkSession) -> str:
    """The application's own tables in the shared folder."""
    return f"{shared_dir(spark)}/tapestream/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it outlives the executors that made it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write shuffled goes from disk once the table is there; without it, it stays until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def removed(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(table: DataFrame) -> None:
    """Deletes a table that ``written`` gave, once nothing reads it any more."""
    files = table.inputFiles()
    if files:
        removed(table.sparkSession, files[0].rsplit("/", 1)[0])


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application wrote; call it when its results are written elsewhere."""
    removed(spark, folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of loops; Spark's cleaner removes its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
