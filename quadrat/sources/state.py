"""Intermediate tables in the folder that the driver and all executors see: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and runs in one process (tests).
LOCAL = "file:///tmp/quadrat-state"


def folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors on other machines need a folder that all of them see")
    return f"{named or LOCAL}/quadrat-state"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the files of what kept() returned, once nothing reads them any more; only below folder()."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getParent().getName() == "quadrat-state":
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
