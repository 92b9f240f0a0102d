"""Eigenvalues and eigenvectors of a symmetric matrix without negative eigenvalues, by blocks of columns.

One-sided Jacobi: in each step blocks meet in pairs, one pair a task, as in a tournament. A task turns the columns of its two
blocks so that they are orthogonal to one another, and turns the same columns of the vectors along. When all pairs have met
without anything left to turn, the columns are the vectors times their eigenvalues. A task holds two blocks, never the
matrix; each step's table is stored, so a lost executor repeats a step at most. A matrix of one block takes no step.

Defined cases: cells that are missing count as 0, and repeated ones add up; without cells there are no rows; equal
eigenvalues have any orthonormal base of their space. A matrix that is not symmetric, or that has a negative eigenvalue, is an
error, as is one that has not converged after SWEEPS tournaments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.sources.state import kept

#: Numbers of a block of columns, and the most columns that it has.
NUMBERS, COLUMNS = 1 << 22, 512
#: What may be left of the product of two columns, by the matrix's norm and the longer of the two.
LEFT = 1e-12
SWEEPS = 40
BLOCKS = "b int, cols array<int>, x array<double>, v array<double>, off double"


def _blocks(rows):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True))
    lists = lambda xs, kind: pa.array([x.ravel() for x in xs], pa.list_(kind))
    return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), lists(cols[1], pa.int32()), lists(cols[2], pa.float64()), lists(cols[3], pa.float64()), pa.array(cols[4], pa.float64())], ["b", "cols", "x", "v", "off"])


def _columns(table, name: str, row: int, n: int):
    import numpy as np

    return np.asarray(table.column(name)[row].values.to_numpy(zero_copy_only=False)).reshape(-1, n)


def turned(x, v, norm: float):
    """Rows of x turned to be orthogonal, those of v along, and what was left of their products before. norm: the matrix's."""
    import numpy as np

    length = np.sqrt((x * x).sum(1))
    products = np.abs(x @ x.T)
    np.fill_diagonal(products, 0.0)
    off = float((products / np.maximum(np.maximum(length[:, None], length[None]) * norm, 1e-300)).max(initial=0.0))
    turn = np.linalg.svd(np.linalg.qr(x.T, mode="r"), full_matrices=True)[2]
    return turn @ x, turn @ v, off


def rounds(n: int) -> list[list[tuple[int, int]]]:
    """A tournament of n: every two meet once, each in one pair a round; with an odd n one rests, paired with -1."""
    who = [*range(n), *([-1] if n % 2 else [])]
    out = []
    for _ in range(len(who) - 1):
        out.append([(who[k], who[-1 - k]) for k in range(len(who) // 2)])
        who = [who[0], who[-1], *who[1:-1]]
    return out


def decompose(matrix: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(j, e) and (i, j, v): eigenvalues, and unit vectors as cells, in no order. matrix(i, j, v), both of (i, j) and (j, i)."""
    cells = matrix.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    names = cells.select("i").union(cells.select("j")).distinct()
    order = kept(names.select("i", (F.row_number().over(Window.orderBy("i")) - 1).cast("int").alias("at")), "order")
    n = order.count()
    spark = matrix.sparkSession
    if not n:
        return spark.createDataFrame([], "j int, e double"), spark.createDataFrame([], "i long, j int, v double")
    size = block or max(1, min(COLUMNS, NUMBERS // n))
    many = -(-n // size)
    placed = cells.join(order, "i").select(F.col("at").alias("row"), "j", "v").join(order.select(F.col("i").alias("j"), F.col("at").alias("col")), "j").groupBy("row", "col").agg(F.sum("v").alias("v"))
    placed = kept(placed, "cells")
    other = placed.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("v").alias("w"))
    worst = placed.join(other, ["row", "col"], "left").agg(F.max(F.abs(F.col("v") - F.coalesce("w", F.lit(0.0)))).alias("d"), F.max(F.abs("v")).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).first()
    if worst["d"] > 1e-9 * worst["m"]:
        raise ValueError("the matrix is not symmetric")
    norm = worst["norm"]

    def fill(key, table):
        import numpy as np

        lo = key[0].as_py() * size
        m = min(n, lo + size) - lo
        x, v = np.zeros((m, n)), np.zeros((m, n))
        x[table.column("col").to_numpy() - lo, table.column("row").to_numpy()] = np.nan_to_num(table.column("v").to_numpy())
        v[np.arange(m), lo + np.arange(m)] = 1.0
        if many == 1:
            x, v, _ = turned(x, v, norm)
        return _blocks([(key[0].as_py(), np.arange(lo, lo + m, dtype=np.int32), x, v, 0.0)])

    diagonal = order.select(F.col("at").alias("row"), F.col("at").alias("col"), F.lit(0.0).alias("v"))  # so that no block is missing
    filled = placed.unionByName(diagonal).groupBy("row", "col").agg(F.sum("v").alias("v")).withColumn("b", F.floor(F.col("col") / size).cast("int"))
    state = kept(filled.groupBy("b").applyInArrow(fill, BLOCKS), "columns")

    def meet(table):
        import numpy as np

        if table.num_rows == 1:
            x, v, off = turned(_columns(table, "x", 0, n), _columns(table, "v", 0, n), norm)
            return _blocks([(table.column("b")[0].as_py(), _columns(table, "cols", 0, 1), x, v, off)])
        a, b = np.argsort(table.column("b").to_numpy())
        both = [np.concatenate([_columns(table, c, int(k), n) for k in (a, b)]) for c in ("x", "v")]
        x, v, off = turned(*both, norm)
        cols = [_columns(table, "cols", int(k), 1) for k in (a, b)]
        cut = len(cols[0])
        return _blocks([(table.column("b")[int(a)].as_py(), cols[0], x[:cut], v[:cut], off), (table.column("b")[int(b)].as_py(), cols[1], x[cut:], v[cut:], off)])

    for _ in range(SWEEPS if many > 1 else 0):
        left = 0.0
        for pairs in rounds(many):
            of = F.create_map(*(F.lit(y) for k, p in enumerate(pairs) for b in p if b >= 0 for y in (b, k)))
            state = kept(state.withColumn("pair", of[F.col("b")]).groupBy("pair").applyInArrow(meet, BLOCKS), "columns")
            left = max(left, state.agg(F.max("off")).first()[0])
        if left <= LEFT:
            break
    else:
        if many > 1:
            raise ArithmeticError(f"eigenvectors of {n} columns did not converge")

    def told(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                x, v, cols = (_columns(b, c, k, m) for c, m in (("x", n), ("v", n), ("cols", 1)))
                e = (x * v).sum(1)
                # values of opposite sign share a length: their columns are turned into one another, and are no vectors
                if (e < -1e-10 * norm).any() or (np.abs(x - e[:, None] * v) > 1e-9 * norm).any():
                    raise ValueError("the matrix has a negative eigenvalue")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * n, pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cols.ravel(), pa.int32()), pa.array(e), lists], ["j", "e", "v"])

    found = kept(state.mapInArrow(told, "j int, e double, v array<double>"), "eigen")
    vectors = found.select("j", F.posexplode("v").alias("at", "v")).join(order, "at").select("i", "j", "v")
    return found.select("j", "e"), vectors
