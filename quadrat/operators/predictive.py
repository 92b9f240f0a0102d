"""Predictive-knot processes over tables of units: n units, m knots, and a matrix that is never n by n.

The covariance at a range is W12 W22^-1 W21 + D, with D the diagonal that is left. By Woodbury, all that a factor's likelihood
needs is additive over units: log D, squares of scores by D^-1, W21 D^-1 scores, and F = W22 + W21 D^-1 W12. So a task
goes over its units once, adds up one row of sums for each range, and the rows are summed; what remains is of the knots' size.

Defined cases: a unit at a knot has no variance left, FLOOR stands for it; knots at one place, or more than KNOTS, are an
error; at range 0 only a unit at a knot's place is correlated with it; without units there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Knots that every task holds, with one matrix of their number squared (32 MB).
KNOTS = 2048
FLOOR = 1e-9
#: Numbers of a block of W12 in a task.
AT_ONCE = 1 << 20


def _places(knots: DataFrame):
    """The knots' numbers and places, by number."""
    import numpy as np

    rows = knots.select("j", "p").orderBy("j").limit(KNOTS + 1).collect()
    places = [tuple(r["p"]) for r in rows]
    if len(rows) > KNOTS or len(set(places)) < len(rows):
        raise ValueError(f"knots must be at different places, and at most {KNOTS}")
    return [r["j"] for r in rows], np.array(places, float).reshape(len(rows), -1)


def _ranges(grid: DataFrame) -> list[tuple[int, float]]:
    return [(r["g"], r["alpha"]) for r in grid.select("g", "alpha").orderBy("g").collect()]


def _correlation(a, b, alpha: float):
    import numpy as np

    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    return np.exp(-d / alpha) if alpha > 0 else (d == 0).astype(float)


def _of_units(batches, at, ranges, scored: bool):
    """Of a task's units, for each range and block: g, their ids, W12, what is left of their variance, scores."""
    import numpy as np

    ids, places, eta = [], [], []
    for b in batches:
        if b.num_rows:
            ids.append(b.column("i").to_numpy())
            places.append(b.column("p").flatten().to_numpy().reshape(b.num_rows, -1))
            if scored:
                eta.append(b.column("eta").flatten().to_numpy().reshape(b.num_rows, -1))
    if not ids:
        return
    ids, places, eta = (np.concatenate(x) if x else None for x in (ids, places, eta))
    step = max(1, AT_ONCE // max(1, len(at)))
    for g, alpha in ranges:
        low = np.linalg.cholesky(_correlation(at, at, alpha))
        for k in range(0, len(ids), step):
            w = _correlation(places[k : k + step], at, alpha)
            left = np.maximum(1 - (np.linalg.solve(low, w.T) ** 2).sum(0), FLOOR)
            yield g, ids[k : k + step], w, left, None if eta is None else eta[k : k + step]


def left_variances(units: DataFrame, knots: DataFrame, grid: DataFrame) -> DataFrame:
    """g, i, dd: the variance of each unit(i, p) that the knots(j, p) leave, at each range of grid(g, alpha)."""
    (_, at), ranges = _places(knots), _ranges(grid)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for g, ids, _, left, _ in _of_units(batches, at, ranges, False):
            yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(ids), g, np.int32)), "i": pa.array(ids), "dd": pa.array(left)})

    return units.select(F.col("i").cast("long").alias("i"), "p").mapInArrow(run, "g int, i long, dd double")


def sums(units: DataFrame, knots: DataFrame, grid: DataFrame, eta: DataFrame | None = None) -> DataFrame:
    """g, k, v: additive parts. k -1: log D of all units, then squares of each factor's scores by D^-1; k from 0: a knot's
    row of F without W22, then its W21 D^-1 scores. eta(unit, h, v), factors h from 0; a unit without scores counts as 0.
    """
    (_, at), ranges = _places(knots), _ranges(grid)
    factors = (eta.agg(F.max("h")).first()[0] if eta is not None else None)
    nf = 0 if factors is None else factors + 1
    rows = units.select(F.col("i").cast("long").alias("i"), "p")
    if nf:
        wide = eta.groupBy(F.col("unit").alias("i")).agg(*(F.coalesce(F.sum(F.when(F.col("h") == h, F.col("v"))), F.lit(0.0)).alias(f"e{h}") for h in range(nf)))
        rows = rows.join(wide, "i", "left").select("i", "p", F.array(*(F.coalesce(f"e{h}", F.lit(0.0)) for h in range(nf))).alias("eta"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for g, _, w, left, e in _of_units(batches, at, ranges, nf > 0):
            e = np.zeros((len(left), 0)) if e is None else e
            own, by = total.setdefault(g, [np.zeros(1 + nf), np.zeros((len(at), len(at) + nf))])
            scaled = w / left[:, None]
            own += [np.log(left).sum(), *(e * e / left[:, None]).sum(0)]
            by[:, : len(at)] += scaled.T @ w
            by[:, len(at) :] += scaled.T @ e
        for g, (own, by) in total.items():
            lists = [own.tolist(), *by.tolist()]
            yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(lists), pa.int32()), "k": pa.array(range(-1, len(at)), pa.int32()), "v": pa.array(lists, pa.list_(pa.float64()))})

    def add(x):
        import pyarrow as pa

        v = x.column("v").combine_chunks()
        both = v.flatten().to_numpy().reshape(x.num_rows, -1).sum(0)
        return pa.table({"g": x.column("g")[:1], "k": x.column("k")[:1], "v": pa.array([both.tolist()], pa.list_(pa.float64()))})

    schema = "g int, k int, v array<double>"
    return rows.mapInArrow(run, schema).groupBy("g", "k").applyInArrow(add, schema)


def information(units: DataFrame, knots: DataFrame, grid: DataFrame) -> DataFrame:
    """g, k, l, v: F, knots by their numbers."""
    numbers, at = _places(knots)
    ranges = dict(_ranges(grid))
    found = sums(units, knots, grid).filter("k >= 0")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            g, k = b.column("g").to_pylist(), b.column("k").to_numpy()
            v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1).copy()
            for row, (a, i) in enumerate(zip(g, k, strict=True)):
                v[row] += _correlation(at[i : i + 1], at, ranges[a])[0]
            n = len(at)
            yield pa.RecordBatch.from_pydict({"g": pa.array(np.repeat(np.array(g, np.int32), n)), "k": pa.array(np.repeat(np.array(numbers)[k], n).astype(np.int64)), "l": pa.array(np.tile(numbers, len(g)).astype(np.int64)), "v": pa.array(v.ravel())})

    return found.mapInArrow(run, "g int, k long, l long, v double")


def log_likelihood(units: DataFrame, knots: DataFrame, grid: DataFrame, eta: DataFrame) -> DataFrame:
    """g, h, log_det, quad, ll of each factor over all units, at each range of grid(g, alpha, pw): a group of the knots' size each."""
    (_, at), ranges = _places(knots), {r["g"]: (r["alpha"], r["pw"]) for r in grid.select("g", "alpha", "pw").collect()}

    def solve(x):
        import numpy as np
        import pyarrow as pa

        x = x.sort_by("k")
        g, lists = x.column("g")[0].as_py(), x.column("v").to_pylist()
        alpha, pw = ranges[g]
        own, by, m = np.array(lists[0]), np.array(lists[1:]), len(at)
        w22 = _correlation(at, at, alpha)
        small, large = np.linalg.cholesky(w22), np.linalg.cholesky(w22 + by[:, :m])
        log_det = own[0] + 2 * (np.log(np.diag(large)).sum() - np.log(np.diag(small)).sum())
        quad = own[1:] - (np.linalg.solve(large, by[:, m:]) ** 2).sum(0)
        n = len(quad)
        prior = np.log(pw) if pw > 0 else -np.inf
        return pa.table({"g": pa.array([g] * n, pa.int32()), "h": pa.array(range(n), pa.int32()), "log_det": pa.array([log_det] * n), "quad": pa.array(quad), "ll": pa.array(prior - log_det / 2 - quad / 2)})

    return sums(units, knots, grid, eta).groupBy("g").applyInArrow(solve, "g int, h int, log_det double, quad double, ll double")
