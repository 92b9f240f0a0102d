"""How coefficients vary among species: the systems of the traits' effects, and draws of the covariates' precision.

All that depends on species are sums of products, partial before a shuffle. What is left has the size of covariates times
traits (at most LARGEST, checked), whatever the number of species.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.draws import with_normal, with_uniform
from quadrat.functions.tensor import contract
from quadrat.operators.statistics import self_product

#: Covariates times traits: their matrix is 128 MB at most, in one task.
LARGEST = 4096


def phylogenetic_scales(eigen: DataFrame, rho: DataFrame) -> DataFrame:
    """cov, species, q: what divides each eigenvector's share. eigen(j, e); rho(cov, rho). A variance of 0 is an error."""
    var = F.col("rho") * F.col("e") + 1 - F.col("rho")
    said = F.when(var > 0, 1 / F.sqrt(var)).otherwise(F.raise_error(F.lit("a direction of the species has no variance")).cast("double"))
    return eigen.crossJoin(F.broadcast(rho)).select("cov", F.col("j").alias("species"), said.alias("q"))


def effect_cells(beta: DataFrame, traits: DataFrame, iv: DataFrame, covs: int, scales: DataFrame | None = None) -> DataFrame:
    """a, b, v: the matrix of the traits' effects, unknown number trait * covs + cov, and the right side as b = -1.

    beta(cov, species, v), traits(species, trait, t), iv(c1, c2, v). Without scales the matrix is the Kronecker product of the
    traits' products and iv. With scales(cov, species, q), `species` are eigenvectors of the similarity, and beta and traits are
    in their base.
    """
    number = lambda t, c: (F.col(t) * covs + F.col(c)).cast("int")
    if scales is None:
        squares = self_product(traits, "trait", ["species"], "t").crossJoin(iv.withColumnRenamed("v", "w"))
        pulled = contract(beta, traits, ["species"], ["cov", "trait"], vb="t").withColumnRenamed("cov", "c2")
        right = contract(iv, pulled, ["c2"], ["c1", "trait"]).select(number("trait", "c1").alias("a"), F.lit(-1).alias("b"), "v")
    else:
        own = traits.join(scales, "species").select("species", "trait", "cov", (F.col("t") * F.col("q")).alias("s"))
        one, two = (own.select("species", F.col("trait").alias(f"trait{k}"), F.col("cov").alias(f"c{k}"), F.col("s").alias(f"s{k}")) for k in (1, 2))
        squares = one.join(two, "species").groupBy("trait1", "c1", "trait2", "c2").agg(F.sum(F.col("s1") * F.col("s2")).alias("v")).join(iv.withColumnRenamed("v", "w"), ["c1", "c2"])
        scaled = beta.join(scales, ["cov", "species"]).select("species", F.col("cov").alias("c2"), (F.col("v") * F.col("q")).alias("x"))
        pulled = one.join(scaled, "species").groupBy("trait1", "c1", "c2").agg(F.sum(F.col("s1") * F.col("x")).alias("v")).join(iv.withColumnRenamed("v", "w"), ["c1", "c2"])
        right = pulled.groupBy("trait1", "c1").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select(number("trait1", "c1").alias("a"), F.lit(-1).alias("b"), "v")
    return squares.select(number("trait1", "c1").alias("a"), number("trait2", "c2").alias("b"), (F.col("v") * F.col("w")).alias("v")).unionByName(right)


def one_system(cells: DataFrame, unknowns: int) -> DataFrame:
    """model (0), p, r, as `solve.posterior` takes them, of cells(a, b, v) with the right side as b = -1; missing cells are 0."""
    if unknowns > LARGEST:
        raise ValueError(f"{unknowns} effects are more than {LARGEST}")
    spark = cells.sparkSession
    every = spark.range(unknowns * (unknowns + 1)).select(F.floor(F.col("id") / (unknowns + 1)).cast("int").alias("a"), (F.col("id") % (unknowns + 1) - 1).cast("int").alias("b"), F.lit(0.0).alias("v"))
    full = cells.unionByName(every).groupBy("a", "b").agg(F.sum("v").alias("v"))
    values = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("a", "b", "v")))), lambda x: x["v"])
    return full.agg(values(F.col("b") >= 0).alias("p"), values(F.col("b") < 0).alias("r")).select(F.lit(0).alias("model"), "p", "r")


def chi_squares(spark: SparkSession, df: int, n: int, seed: int, chain: int, iteration: int) -> DataFrame:
    """i, v: for i from 0 to n - 1 a chi-square draw with df - i degrees: exponentials by two degrees, a squared normal for an odd one.

    A row for each two degrees, so as many species as there may be are drawn by all tasks; streams 2 and 3.
    """
    if df < n:
        raise ValueError(f"{df} degrees of freedom are fewer than {n} covariates")
    half = df // 2 + 1
    i, k = F.floor(F.col("id") / half).cast("int"), (F.col("id") % half).cast("int")
    rows = spark.range(n * half).select(i.alias("i"), k.alias("k"), (df - i - 2 * k).alias("left")).filter("left > 0")
    rows = with_uniform(rows, "u", seed, chain, iteration, F.col("i") * F.lit(1 << 32) + F.col("k"), 2)
    rows = with_normal(with_uniform(rows, "w", seed, chain, iteration, F.col("i").cast("long"), 3), "z", "w")
    return rows.groupBy("i").agg(F.sum(F.when(F.col("left") == 1, F.col("z") * F.col("z")).otherwise(-2 * F.ln("u"))).alias("v"))


def wishart(inverse_scale: DataFrame, df: int, n: int, seed: int, chain: int, iteration: int) -> DataFrame:
    """c1, c2, v: a Wishart draw of mean df * inverse_scale^-1, by Bartlett's triangle. inverse_scale(c1, c2, v), c1 and c2 from 0.

    Missing cells are 0; a matrix that is not positive definite is an error. n covariates are one row.
    """
    if n > LARGEST:
        raise ValueError(f"{n} covariates are more than {LARGEST}")
    spark = inverse_scale.sparkSession
    below = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"), "id").filter("a > b")
    below = with_normal(with_uniform(below, "u", seed, chain, iteration, F.col("id"), 4), "v", "u").select(F.lit(1).alias("of"), "a", "b", "v")
    chi = chi_squares(spark, df, n, seed, chain, iteration).select(F.lit(1).alias("of"), F.col("i").alias("a"), F.col("i").alias("b"), F.sqrt("v").alias("v"))
    scale = inverse_scale.select(F.lit(0).alias("of"), F.col("c1").cast("int").alias("a"), F.col("c2").cast("int").alias("b"), F.col("v").cast("double").alias("v"))
    entries = scale.unionByName(below).unionByName(chi).agg(F.collect_list(F.struct("of", "a", "b", "v")).alias("x"))

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                of, a, b, v = (c.to_numpy(zero_copy_only=False) for c in batch.column("x").slice(row, 1).flatten().flatten())
                m = np.zeros((2, n, n))
                np.add.at(m, (of, a, b), v)
                f = np.linalg.solve(np.linalg.cholesky(m[0]).T, m[1])
                w = f @ f.T
                at = np.indices((n, n), np.int32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(w.ravel())], ["c1", "c2", "v"])

    return entries.mapInArrow(draw, "c1 int, c2 int, v double")


def log_determinant(matrix: DataFrame, by: Column, n: int) -> DataFrame:
    """m, v: the log of the determinant of each positive definite matrix(c1, c2, v), a row of n covariates."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                a, b, v = (c.to_numpy(zero_copy_only=False) for c in batch.column("x").slice(row, 1).flatten().flatten())
                m = np.zeros((n, n))
                np.add.at(m, (a, b), v)
                out.append(2 * np.log(np.diag(np.linalg.cholesky(m))).sum())
            yield pa.RecordBatch.from_arrays([batch.column("m"), pa.array(out, pa.float64())], ["m", "v"])

    cells = matrix.groupBy(by.cast("int").alias("m")).agg(F.collect_list(F.struct(F.col("c1").cast("int"), F.col("c2").cast("int"), F.col("v").cast("double"))).alias("x"))
    return cells.mapInArrow(run, "m int, v double")
