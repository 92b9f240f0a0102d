"""What several corpus operators share: tables in the shared folder and small column helpers."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs in one process (tests).
LOCAL_SHARED = "file:///tmp/quadrat-shared"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. On a cluster the session must name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors on other machines need a folder that all of them see")
    return named or LOCAL_SHARED


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    A lost executor takes nothing with it: the files are in shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrat/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the actions inside; what was set before holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sliced(batches, rows: int = 512):
    """Arrow batches in parts, so that few texts are Python strings at a time. At the end of the task, what it freed goes back to the system: workers live on."""
    import ctypes

    import pyarrow as pa

    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: batches of fewer rows than Spark's default of 10,000, unless the session has its own number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1024")
