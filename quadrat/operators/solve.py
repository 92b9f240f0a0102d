"""Many small linear systems, one for each key: means and draws of N(P^-1 r, P^-1), a batch of systems at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.draws import normals, uniforms

#: Numbers of the matrices that a task works on together.
AT_ONCE = 1 << 21


def equations(rows: DataFrame, cols: list[str], weight: Column, by: str, right: Column) -> DataFrame:
    """by, p (a matrix by rows), r: weighted sums of products of wide columns, and with `right`.

    One aggregate with partial sums; a key's system stays one row.
    """
    n = range(len(cols))
    sums = [F.sum(weight * F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i in n for j in n if j >= i]
    sums += [F.sum(weight * F.col(cols[i]) * right).alias(f"r{i}") for i in n]
    wide = rows.groupBy(by).agg(*sums)
    return wide.select(by, F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") for i in n for j in n)).alias("p"), F.array(*(F.col(f"r{i}") for i in n)).alias("r"))


def posterior(systems: DataFrame, by: str, priors: DataFrame, seed: int, chain: int, iteration: int) -> DataFrame:
    """by, mean, draw: solutions, as arrays, of systems(by, p, r) with priors(by, a, b, v) added, whose b = -1 are to r.

    A key's noise follows from its number and (seed, chain, iteration). A matrix that is not positive definite is an
    error. Keys without a system have no row; those without a prior are solved as they are.
    """
    entries = priors.groupBy(by).agg(F.collect_list(F.struct(F.col("a").cast("int"), F.col("b").cast("int"), F.col("v").cast("double"))).alias("prior"))
    kind = systems.schema[by].dataType.simpleString()

    def solve(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(batch.column("r")[0])
            many = max(1, AT_ONCE // (n * n))
            for at in range(0, batch.num_rows, many):
                x = batch.slice(at, many)
                m = x.num_rows
                p = x.column("p").flatten().to_numpy(zero_copy_only=False).reshape(m, n, n).copy()
                r = x.column("r").flatten().to_numpy(zero_copy_only=False).reshape(m, n).copy()
                prior = x.column("prior")
                of = np.repeat(np.arange(m), [0 if c is None else c for c in pa.compute.list_value_length(prior).to_pylist()])
                a, b, v = (c.to_numpy(zero_copy_only=False) for c in prior.flatten().flatten())
                to = b < 0
                np.add.at(r, (of[to], a[to]), v[to])
                np.add.at(p, (of[~to], a[~to], b[~to]), v[~to])
                low = np.linalg.cholesky(p)
                up = np.swapaxes(low, 1, 2)
                keys = x.column(by).to_numpy(zero_copy_only=False).astype(np.int64)
                noise = normals(uniforms(seed, chain, iteration, keys[:, None] * n + np.arange(n)))
                mean = np.linalg.solve(up, np.linalg.solve(low, r[..., None]))[..., 0]
                draw = mean + np.linalg.solve(up, noise[..., None])[..., 0]
                lists = lambda y: pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n, pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([x.column(by), lists(mean), lists(draw)], [by, "mean", "draw"])

    met = systems.join(entries, by, "left").select(by, "p", "r", "prior")
    return met.mapInArrow(solve, f"{by} {kind}, mean array<double>, draw array<double>")
