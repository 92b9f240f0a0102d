"""Draws of all chains: long Parquet by chain, and the nested JSON that other tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources import rds

#: k is the third axis of loadings that depend on covariates, and null elsewhere.
SCHEMA = "chain int, draw int, param string, level int, i int, j int, k int, v double"
#: Parameters whose values are grid indices, from 0 here and from 1 in files for others.
INDICES = ("rho", "Alpha")


def write(draws: DataFrame, path: str) -> None:
    draws.write.mode("overwrite").partitionBy("chain").parquet(path)


def read(spark: SparkSession, *paths: str, chains: list[int] | None = None) -> DataFrame:
    """One or more results as one table; a chain filter prunes directories. Chains that are not there are just absent."""
    out = None
    for path in paths:
        one = spark.read.parquet(path)
        one = one.selectExpr("cast(chain as int) chain", "draw", "param", "level", "i", "j", "k" if "k" in one.columns else "cast(null as int) k", "v")
        out = one if out is None else out.unionByName(one)
    out = out.filter("draw >= 0")
    return out if chains is None else out.filter(F.col("chain").isin(chains))


def profile(draws: DataFrame) -> DataFrame:
    """chain, name, calls, seconds of each update, of a fit with profile=True as it is or as its Parquet; segments are added up."""
    of = draws.filter("draw = -1").groupBy("chain", F.substring_index("param", ":", -1).alias("name"))
    return of.agg(F.sum(F.when(F.col("i") == 0, F.col("v"))).cast("long").alias("calls"), F.sum(F.when(F.col("i") == 1, F.col("v"))).alias("seconds"))


def to_json(draws: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row per chain: chain, json with a key per draw holding {parameter: matrix, or matrices by level}.

    Values with a third axis k, where draws have one, are lists of lists of lists; k is null where there is none.
    """
    k = F.col("k") if "k" in draws.columns else F.lit(None).cast("int")
    cells = draws.select("chain", "draw", "param", "level", "i", "j", k.alias("k"), (F.col("v") + F.when(F.col("param").isin(*INDICES), 1.0).otherwise(0.0)).alias("v"))
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    rows = cells.groupBy("chain", "draw", "param", "level", "i").agg(in_order("j", "k", "v").alias("c"), (F.max("k") + 1).alias("n"))
    of = lambda c: F.transform(c, lambda x: x["v"])
    nested = F.transform(F.sequence(F.lit(0), (F.size("c") / F.col("n")).cast("int") - 1), lambda q: of(F.slice("c", q * F.col("n") + 1, F.col("n"))))
    rows = rows.select("chain", "draw", "param", "level", "i", F.when(F.col("n").isNull(), F.to_json(of("c"))).otherwise(F.to_json(nested)).alias("t"))
    joined = lambda key, value: F.concat(F.lit("["), F.array_join(F.transform(in_order(key, value), lambda x: x[value]), ","), F.lit("]"))
    levels = rows.groupBy("chain", "draw", "param", "level").agg(joined("i", "t").alias("t"))
    by_param = levels.groupBy("chain", "draw", "param").agg(joined("level", "t").alias("ts"), F.first("t").alias("t"))
    pair = F.concat(F.lit('"'), "param", F.lit('":'), F.when(F.col("param").isin("Eta", "Lambda", "Psi", "Delta", "Alpha", "BetaSel"), F.col("ts")).otherwise(F.col("t")))
    one = by_param.groupBy("chain", "draw").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("d"))
    sorted_draws = F.transform(F.array_sort(F.collect_list(F.struct("draw", "d"))), lambda x: F.concat(F.lit('"'), x["draw"].cast("string"), F.lit('":'), x["d"]))
    time: Column = F.lit("" if seconds is None else f',"time":{seconds}')
    return one.groupBy("chain").agg(F.concat(F.lit("{"), F.array_join(sorted_draws, ","), time, F.lit("}")).alias("json"))


def write_json(draws: DataFrame, path: str, seconds: float | None = None) -> None:
    """A text file per chain, in directories chain=K."""
    to_json(draws, seconds).write.mode("overwrite").partitionBy("chain").text(path)


def from_json(text: DataFrame, of_level: bool = False, by_covariate: bool = False) -> DataFrame:
    """chain, draw, param, level, i, j, v of texts(chain, json) as to_json() makes them: parameters without levels, or
    (of_level) with them. by_covariate: instead, those of levels that have a third axis, with k before v. Indices count from 0
    again."""
    kind = "map<string,string>"
    draws = text.select("chain", F.explode(F.from_json("json", kind)).alias("draw", "d")).filter("draw <> 'time'")
    params = draws.select("chain", F.col("draw").cast("int").alias("draw"), F.explode(F.from_json("d", kind)).alias("param", "m"))
    if of_level or by_covariate:
        levels = params.filter(F.col("m").startswith("[[[")).select("chain", "draw", "param", F.posexplode(F.from_json("m", "array<string>")).alias("level", "m"))
        levels = levels.filter(F.col("m").startswith("[[[") == F.lit(by_covariate))
    else:
        levels = params.filter(~F.col("m").startswith("[[[")).withColumn("level", F.lit(-1))
    m = F.from_json("m", "array<array<array<double>>>" if by_covariate else "array<array<double>>")
    rows = levels.select("chain", "draw", "param", "level", F.posexplode(m).alias("i", "r"))
    cells = rows.select("chain", "draw", "param", "level", "i", F.posexplode("r").alias("j", "v"))
    if by_covariate:
        cells = cells.select("chain", "draw", "param", "level", "i", "j", F.posexplode("v").alias("k", "v"))
    return cells.withColumn("v", F.col("v") - F.when(F.col("param").isin(*INDICES), 1.0).otherwise(0.0))


def write_rds(draws: DataFrame, path: str, seconds: float | None = None) -> None:
    """A file chain=K.rds per chain, the JSON text as R's serialised string. One chain's text at a time is on the driver."""
    spark = draws.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for row in to_json(draws, seconds).toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, f"chain={row['chain']}.rds"), True)
        try:
            out.write(rds.of_text(row["json"]))
        finally:
            out.close()
