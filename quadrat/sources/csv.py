"""CSV inputs: a wide table of numbers, one row per site, as long cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_wide(spark: SparkSession, path: str, key: str, name: str = "name", value: str = "v") -> DataFrame:
    """key, name, value of every other column; NA is null. The header names the columns, no type is inferred."""
    return long(spark.read.csv(path, header=True, nullValue="NA"), key, name, value)


def from_lines(lines: DataFrame, columns: list[str], key: str, name: str = "name", value: str = "v") -> DataFrame:
    """As read_wide(), of lines(value) that are in a table already, without a header among them."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return long(lines.select(F.from_csv("value", schema, {"nullValue": "NA"}).alias("r")).select("r.*"), key, name, value)


def long(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    cols = [c for c in wide.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"`{c}`").try_cast("double").alias("v")) for c in cols])
    return wide.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.n").alias(name), F.col("p.v").alias(value))
