"""A model as a folder of JSON lines, for responses and designs too large for one text: a line is one row of one matrix.

A folder for each matrix under the names of the one text (YScaled, XScaled, TrScaled, C, Pi, distr, ...), each with any number
of files of lines {"row": r, "v": [numbers]}; levels, with a line {"level": r, ...constants} for each random level; and state, with
lines {"chain", "param", "level", "row", "v"} of the chains' first states ("vs", lists in a list, in place of v where loadings depend
on covariates; level null where a parameter has none). Lines may be in any order and any file, so they are written and read by as many
tasks as there are files. Rows count from 1, and so do the indices in Pi, rho and Alpha, as in the one text.

Defined cases: a number that is null, "NA" or "NaN" is missing, and a cell beyond a shorter line too; a matrix without a folder is an
empty table; two lines of one row of a matrix are an error where the model's size is asked for; rows without any number count;
an empty folder has no rows; keys beyond these are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.sources.draws import INDICES
from quadrat.sources.model_json import number

#: Constants of a random level: name in the file, name and type in the table.
CONSTANTS = (("nu", "nu", "double"), ("a1", "a1", "double"), ("b1", "b1", "double"), ("a2", "a2", "double"), ("b2", "b2", "double"), ("nfMin", "nf_min", "int"), ("nfMax", "nf_max", "int"), ("sDim", "s_dim", "int"), ("xDim", "x_dim", "int"), ("spatialMethod", "method", "string"))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if _there(spark, path) else spark.createDataFrame([], schema)


def write_matrix(cells: DataFrame, path: str, key: str, row: str, col: str, value: str, index: bool = False) -> None:
    """cells(row, col, value), numbered from 0, as lines: cells that are not there, or null, become null. index: values are indices."""
    v = F.col(value) + 1 if index else F.col(value)
    rows = cells.groupBy((F.col(row) + 1).alias("row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col), v))).alias("m"), F.max(col).alias("last"))
    rows.select("row", F.transform(F.sequence(F.lit(0), F.col("last").cast("int")), lambda k: F.col("m")[k]).alias("v")).write.mode("overwrite").json(f"{path}/{key}")


def matrix(spark: SparkSession, path: str, key: str, row: str, col: str, value: str, index: bool = False) -> DataFrame:
    """A matrix as a long table of its cells, numbered from 0."""
    rows = _lines(spark, f"{path}/{key}", "row bigint, v array<string>")
    cells = rows.select((F.col("row") - 1).alias(row), F.posexplode("v").alias(col, "_v"))
    v: Column = number(F.col("_v"))
    return cells.select(row, col, ((v - 1).cast("int") if index else v).alias(value))


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """y, x, traits, similarity, units and species as long tables."""
    distr = matrix(spark, path, "distr", "species", "c", "v").groupBy("species").agg(F.max(F.when(F.col("c") == 0, F.col("v"))).cast("int").alias("family"), F.max(F.when(F.col("c") == 1, F.col("v"))).cast("int").alias("var_free"))
    return {
        "y": matrix(spark, path, "YScaled", "site", "species", "y"),
        "x": matrix(spark, path, "XScaled", "site", "cov", "x"),
        "traits": matrix(spark, path, "TrScaled", "species", "trait", "t"),
        "similarity": matrix(spark, path, "C", "sp1", "sp2", "c"),
        "pi": matrix(spark, path, "Pi", "site", "level", "unit", index=True),
        "species": distr,
    }


def dims(spark: SparkSession, path: str) -> DataFrame:
    """ny ns nc nt nr of the model, one row: lines of the responses, and the widest line of each matrix."""
    out = None
    for key, name in (("YScaled", "ns"), ("XScaled", "nc"), ("TrScaled", "nt"), ("Pi", "nr")):
        rows = _lines(spark, f"{path}/{key}", "row bigint, v array<string>")
        size = F.coalesce(F.max(F.size("v")), F.lit(0)).alias(name)
        if key == "YScaled":
            twice = rows.groupBy("row").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("k"))
            one = twice.agg(F.count("*").alias("ny"), F.coalesce(F.max("k"), F.lit(0)).alias(name), F.max(F.when(F.col("n") > 1, F.col("row"))).alias("r"))
            told = F.raise_error(F.concat(F.lit("row "), F.col("r").cast("string"), F.lit(" of YScaled is there twice")))
            one = one.select(F.when(F.col("r").isNotNull(), told.cast("bigint")).otherwise(F.col("ny")).alias("ny"), name)
        else:
            one = rows.agg(size)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select("ny", "ns", "nc", "nt", "nr")


def write_levels(levels: DataFrame, path: str) -> None:
    """levels(level, and the table's names of CONSTANTS)."""
    levels.select((F.col("level") + 1).alias("level"), *[F.col(name).cast(kind).alias(key) for key, name, kind in CONSTANTS]).write.mode("overwrite").json(f"{path}/levels")


def levels(spark: SparkSession, path: str) -> DataFrame:
    """level and its constants; without a number of dimensions a level has none."""
    rows = _lines(spark, f"{path}/levels", "level int, " + ", ".join(f"{key} {kind}" for key, _, kind in CONSTANTS))
    named = [F.coalesce(key, F.lit(0)).alias(name) if name in ("s_dim", "x_dim") else F.col(key).alias(name) for key, name, _ in CONSTANTS]
    return rows.select((F.col("level") - 1).alias("level"), *named)


def write_state(state: DataFrame, path: str) -> None:
    """state(chain, param, level, i, j, k, v) of first states as draws have them; a line is one i, with (where k is not null) a
    list of covariates for each j."""
    v = F.col("v") + F.when(F.col("param").isin(*INDICES), 1.0).otherwise(0.0)
    cells = state.groupBy("chain", "param", "level", "i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", v.alias("v")))), lambda x: x["v"]).alias("c"), F.max("k").isNull().alias("plain"))
    rows = cells.groupBy("chain", "param", "level", "i", "plain").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda x: x["c"]).alias("c"))
    line = rows.select((F.col("chain") + 1).alias("chain"), "param", F.when(F.col("level") >= 0, F.col("level") + 1).alias("level"), (F.col("i") + 1).alias("row"), F.when(F.col("plain"), F.flatten("c")).alias("v"), F.when(~F.col("plain"), F.col("c")).alias("vs"))
    line.write.mode("overwrite").json(f"{path}/state")


def state(spark: SparkSession, path: str) -> DataFrame:
    """chain, param, level, i, j, k, v of the chains' first states, numbered from 0; level is -1 and k null where there is none."""
    rows = _lines(spark, f"{path}/state", "chain int, param string, level int, row int, v array<double>, vs array<array<double>>")
    rows = rows.select((F.col("chain") - 1).alias("chain"), "param", (F.coalesce("level", F.lit(0)) - 1).alias("level"), (F.col("row") - 1).alias("i"), "v", "vs")
    nested = F.coalesce("vs", F.transform("v", lambda x: F.array(x)))
    cells = rows.select("chain", "param", "level", "i", F.col("vs").isNull().alias("plain"), F.posexplode(nested).alias("j", "c"))
    cells = cells.select("chain", "param", "level", "i", "j", "plain", F.posexplode("c").alias("k", "v"))
    v = F.col("v") - F.when(F.col("param").isin(*INDICES), 1.0).otherwise(0.0)
    return cells.select("chain", "param", "level", "i", "j", F.when(~F.col("plain"), F.col("k")).alias("k"), v.alias("v"))
