"""A stream over draws that are being written: running counts and means per parameter, an extra of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources.draws import SCHEMA


def progress(spark: SparkSession, path: str) -> DataFrame:
    """chain, param, n, last draw, mean so far; for outputMode complete or update. State is one row per chain and parameter."""
    draws = spark.readStream.schema(SCHEMA).parquet(path)
    return draws.groupBy("chain", "param").agg(F.count("*").alias("n"), F.max("draw").alias("last"), F.avg("v").alias("mean"))
