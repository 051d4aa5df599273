"""Session helpers: shared tables, checkpoints, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a folder of our own in local mode (tests); on a cluster an error, as
    a folder of one machine would lose rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Most rows and bytes of text that an Arrow batch hands to Python.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold a bounded number of rows and bytes.

    Plans read these settings when they run, after the frame was returned, so they stay set.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


#: With this setting Spark deletes the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def ending_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, keep: list | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs only the tasks it ran; the shuffles of the plan end with the
    write. ``keep`` collects the paths, for drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    with ending_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list) -> None:
    """Delete tables that stored() has written and that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def with_columns(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` followed by the columns of ``ddl``."""
    return StructType(list(df.schema) + list(StructType.fromDDL(ddl)))


#: Most tasks that dealt() makes; beyond it a task takes several groups, one after the other.
MOST_TASKS = 20_000


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """``df`` dealt by ``key`` to about as many tasks as it has groups, so tasks do not grow with the input."""
    return df.repartition(max(1, min(int(groups), MOST_TASKS)), key)
