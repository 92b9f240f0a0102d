"""Distances, covariance grids, neighbours; inverses and determinants by grid point.

Grids are a few dozen values and fixed by the model, so they are broadcast; pairs of units are what a full
Gaussian process is made of. Knots and neighbours keep the rest linear in the number of units.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from math import isqrt, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.scalar import decay
from quadrat.functions.tensor import as_map
from quadrat.kernels.spatial import regressed
from quadrat.sources.state import kept


def distance(a: Column, b: Column) -> Column:
    """Euclidean, of coordinate arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def correlations(a: DataFrame, b: DataFrame, grid: DataFrame) -> DataFrame:
    """g, i, j, w of a(i, p), b(j, p) and grid(g, alpha)."""
    pairs = a.withColumnRenamed("p", "_p").crossJoin(b.withColumnRenamed("p", "_q")).withColumn("d", distance(F.col("_p"), F.col("_q")))
    return pairs.crossJoin(F.broadcast(grid)).select("g", "i", "j", decay(F.col("d"), F.col("alpha")).alias("w"))


#: Cells of the coarse levels that are broadcast when units look for their level; finer levels are joined.
COARSE_CELLS = 8192
#: The most coordinates of a place: with three, 125 cells are searched.
MOST_DIMS = 3
#: Levels go on until no cell of the finest holds more than this many times the neighbours asked for, or to the last level.
CROWD, LAST_LEVEL = 64, 48


def _depth(units: DataFrame, cell: Callable[[int], Column], least: int, most: int) -> int:
    """The first level, of every fourth from least, none of whose cells holds more than most units."""
    finest = least
    while finest < LAST_LEVEL and (units.groupBy(cell(finest).alias("c")).count().agg(F.max("count")).first()[0] or 0) > most:
        finest = min(LAST_LEVEL, finest + 4)
    return finest


def preceding_neighbours(units: DataFrame, k: int) -> DataFrame:
    """i, j, rank, d: the k nearest units of smaller index, ties to the smaller. units(i, p).

    Space is cut into cells, halved from level to level. A unit's level is the finest where its own cell holds k units
    before it: they lie within the cell's diagonal, so its neighbours are in the cells around, and only those are
    searched. A unit with fewer than k before it searches the coarsest level, which is all of space. Of units at one
    place only the first k can be anyone's neighbours. The driver sees the extent and the number of units, no more.
    Levels go as deep as the densest places need, whatever lies far from them. Cells around a cell grow as a power of the coordinates: more than MOST_DIMS of them are refused with an error.
    """
    size = units.select(F.size("p").alias("n")).first()
    dims = range(size["n"] if size else 0)
    if len(dims) > MOST_DIMS:
        raise ValueError(f"neighbours are searched among places of at most {MOST_DIMS} coordinates, not {len(dims)}")
    seen = units.agg(F.count("*").alias("n"), *[f(F.col("p")[c]).alias(f"{f.__name__}{c}") for c in dims for f in (F.min, F.max)]).first()
    low = [seen[f"min{c}"] for c in dims]
    extent = max((seen[f"max{c}"] - low[c] for c in dims), default=0.0) or 1.0
    finest = int(log2(max(1.0, seen["n"] / k)) / max(1, len(dims))) + 2
    first = units.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("i"))).filter(F.col("n") <= k).drop("n")
    ring = isqrt(len(dims)) + 1
    cell = lambda t, off: F.array(*[F.floor((F.col("p")[c] - low[c]) / (F.lit(extent) / F.pow(F.lit(2.0), t))) + off[c] for c in dims])
    finest = _depth(first, lambda t: cell(F.lit(t), [0] * len(dims)), finest, CROWD * k)
    level = F.explode(F.sequence(F.lit(0), F.lit(finest)))

    placed = units.withColumn("t", level).filter("t > 0").select("i", "t", cell(F.col("t"), [0] * len(dims)).alias("cell"))
    kth = placed.withColumn("n", F.row_number().over(Window.partitionBy("t", "cell").orderBy("i"))).filter(F.col("n") == k).select("t", "cell", F.col("i").alias("_k"))
    coarse = max((t for t in range(finest + 1) if (2**t + 1) ** len(dims) <= COARSE_CELLS), default=0)
    found = placed.filter(F.col("t") <= coarse).join(F.broadcast(kth.filter(F.col("t") <= coarse)), ["t", "cell"])
    found = found.unionByName(placed.filter(F.col("t") > coarse).join(kth.filter(F.col("t") > coarse), ["t", "cell"]))
    best = found.filter(F.col("_k") < F.col("i")).groupBy("i").agg(F.max("t").alias("t"))
    mine = units.join(best, "i", "left").select("i", "p", F.coalesce("t", F.lit(0)).alias("t"))

    around = F.array(*[cell(F.col("t"), off) for off in product(range(-ring, ring + 1), repeat=len(dims))])
    searching = mine.select("i", "p", "t", F.explode(around).alias("cell"))
    last = mine.groupBy("t").agg(F.max("i").alias("last"))  # one row per level
    others = first.withColumn("t", level).join(F.broadcast(last), "t").filter(F.col("i") < F.col("last"))
    others = others.select(F.col("i").alias("j"), F.col("p").alias("_q"), "t", cell(F.col("t"), [0] * len(dims)).alias("cell"))
    pairs = searching.join(others, ["t", "cell"]).filter(F.col("j") < F.col("i")).select("i", "j", distance(F.col("p"), F.col("_q")).alias("d"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")))
    return ranked.filter(F.col("rank") <= k).select("i", "j", "rank", "d")


def parts(units: DataFrame, most: int) -> DataFrame:
    """i, part, t, cell: cells of space of at most so many units each; part numbers them. units(i, p).

    Space is halved from level to level, and a unit's cell is the coarsest that is small enough. Levels go as deep as the
    densest places need; what is left too large at the last one is dealt by a hash. No row of a unit reaches the driver.
    """
    seen = units.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("dims")).first()
    dims = range(seen["dims"] or 0)
    ends = units.agg(F.lit(0), *[f(F.col("p")[c]).alias(f"{f.__name__}{c}") for c in dims for f in (F.min, F.max)]).first()
    low, extent = [ends[f"min{c}"] for c in dims], max((ends[f"max{c}"] - ends[f"min{c}"] for c in dims), default=0.0) or 1.0
    cell = lambda t: F.array(*[F.floor((F.col("p")[c] - low[c]) / (F.lit(extent) / F.pow(F.lit(2.0), t))) for c in dims])
    finest = _depth(units, lambda t: cell(F.lit(t)), int(log2(max(1.0, seen["n"] / most)) / max(1, len(dims))) + 1, most)
    placed = units.select("i", "p", F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("t")).select("i", "t", cell(F.col("t")).alias("cell"))
    fits = placed.groupBy("t", "cell").agg(F.count("*").alias("n")).filter((F.col("n") <= most) | (F.col("t") == finest))
    mine = placed.join(fits, ["t", "cell"]).groupBy("i").agg(F.min(F.struct("t", "cell", "n")).alias("c")).select("i", "c.*")
    dealt = F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / most))
    return mine.select("i", F.xxhash64("t", "cell", dealt).alias("part"), "t", "cell")


def close_predecessors(units: DataFrame, k: int, block: int = 1024, first: int = 2048) -> DataFrame:
    """i, j: k units of smaller index for each, or all if fewer, about the nearest: out of the blocks of space around its own and the first units of all.

    A task searches a block; the driver sees the blocks' boxes. With three coordinates, or without units, by preceding_neighbours().
    """
    dims = range(units.agg(F.max(F.size("p"))).first()[0] or 0)
    if len(dims) not in (1, 2):
        return preceding_neighbours(units, k).select("i", "j")
    own = kept(units.select("i", "p").join(parts(units, block).select("i", "part").hint("merge"), "i"), "parts")
    boxes = own.groupBy("part").agg(*(f(F.col("p")[c]) for f in (F.min, F.max) for c in dims)).collect()
    low, high = ([b[1 + side * len(dims) : 1 + (side + 1) * len(dims)] for b in boxes] for side in (0, 1))
    side = [max(y - x for x, y in zip(*b, strict=True)) for b in zip(low, high, strict=True)]
    apart = lambda a, b: max(max(low[a][c] - high[b][c], low[b][c] - high[a][c]) for c in dims)
    pairs = [(boxes[a]["part"], boxes[b]["part"]) for a in range(len(boxes)) for b in range(len(boxes)) if a == b or apart(a, b) < max(side[a], side[b]) / 2]
    around = F.broadcast(units.sparkSession.createDataFrame(pairs, "at long, part long"))
    others = own.join(around, "part").select("at", F.col("i").alias("j"), F.col("p").alias("q"))
    few = own.orderBy("i").limit(first).select(F.col("i").alias("j"), F.col("p").alias("q"))
    others = others.unionByName(around.select("at").distinct().crossJoin(few))

    def nearest(key, mine, others):
        import numpy as np
        import pandas as pd

        others = others.drop_duplicates("j")
        i, j = mine["i"].to_numpy(), others["j"].to_numpy()
        x, y = (np.array([list(p) for p in places]) for places in (mine["p"], others["q"]))
        out = []
        for at in range(0, len(i), 256):
            s = slice(at, at + 256)
            d = sum(np.square(np.subtract.outer(x[s, c], y[:, c])) for c in range(x.shape[1]))
            d[j[None] >= i[s, None]] = np.inf
            some = np.argpartition(d, min(k, len(j)) - 1, axis=1)[:, :k]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(d, some, 1)))
            out.append(pd.DataFrame({"i": i[s][row], "j": j[some[row, col]]}))
        return pd.concat(out)

    return own.groupBy("part").cogroup(others.groupBy("at")).applyInPandas(nearest, "i long, j long")


def one_neighbour_log_likelihood(nearest: DataFrame, eta: DataFrame, grid: DataFrame) -> DataFrame:
    """g, h, ll with one neighbour: weight a = exp(-d / alpha), variance 1 - a^2. nearest(i, j, d), j null for the first.

    Units at one place leave no variance: 1e-9 stands for it, as its logarithm is needed.
    """
    own = eta.select(F.col("unit").alias("i"), "h", "v")
    before = eta.select(F.col("unit").alias("j"), "h", F.col("v").alias("w"))
    rows = nearest.join(own, "i").join(before, ["j", "h"], "left").crossJoin(F.broadcast(grid))
    a = F.when(F.col("j").isNull(), 0.0).otherwise(decay(F.col("d"), F.col("alpha")))
    var = F.greatest(1 - a * a, F.lit(1e-9))
    e = F.col("v") - a * F.coalesce("w", F.lit(0.0))
    return rows.groupBy("g", "h", "pw").agg(F.sum(F.ln(var) + e * e / var).alias("s")).select("g", "h", (F.ln("pw") - F.col("s") / 2).alias("ll"))


def neighbour_weights(units: DataFrame, neighbours: DataFrame, grid: DataFrame) -> DataFrame:
    """g, i, j, v: cells of D^-1/2 (I - A), units of a batch with equally many neighbours solved together.

    Of neighbours at one place, the weights of least squares are taken; a unit at a neighbour's place keeps a variance of 1e-9.
    """
    near = neighbours.join(units.select(F.col("i").alias("j"), F.col("p").alias("q")), "j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "q"))).alias("near"))
    rows = units.join(near, "i", "left").crossJoin(F.broadcast(grid)).select("g", "alpha", "i", "p", F.col("near.j").alias("j"), F.col("near.q").alias("q"))

    def solve(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            count = np.array([0 if j is None or not alpha > 0 else len(j) for j, alpha in zip(b["j"], b["alpha"], strict=True)], int)
            for m in np.unique(count):
                some = b[count == m]
                g, i, alpha = (some[c].to_numpy() for c in ("g", "i", "alpha"))
                if m == 0:
                    yield pd.DataFrame({"g": g, "i": i, "j": i, "v": 1.0})
                    continue
                xy = np.array([[*(list(x) for x in q), list(p)] for q, p in zip(some["q"], some["p"], strict=True)])
                apart = np.sqrt(((xy[:, :, None] - xy[:, None]) ** 2).sum(-1))
                k = np.exp(-apart / alpha[:, None, None])
                w, left = regressed(k)
                own = left**-0.5
                near = np.array([list(j) for j in some["j"]])
                yield pd.DataFrame({"g": np.repeat(g, m + 1), "i": np.repeat(i, m + 1), "j": np.c_[near, i].ravel(), "v": np.c_[-w * own[:, None], own].ravel()})

    return rows.mapInPandas(solve, "g int, i long, j long, v double")


def sparse_log_likelihood(weights: DataFrame, eta: DataFrame, grid: DataFrame) -> DataFrame:
    """g, h, log_det, quad, ll of each factor over all units, from cells(g, i, j, v) of D^-1/2 (I - A) and grid(g, pw).

    The log determinant is the diagonal's; the quadratic form is the sum of squares of the rows by the scores.
    """
    rows = weights.join(eta.select(F.col("unit").alias("j"), "h", F.col("v").alias("e")), "j").groupBy("g", "i", "h").agg(F.sum(F.col("v") * F.col("e")).alias("e"))
    quad = rows.groupBy("g", "h").agg(F.sum(F.col("e") * F.col("e")).alias("quad"))
    det = weights.filter("i = j").groupBy("g").agg((-2 * F.sum(F.ln("v"))).alias("log_det"))
    return quad.join(det, "g").join(grid, "g").select("g", "h", "log_det", "quad", (F.ln("pw") - F.col("log_det") / 2 - F.col("quad") / 2).alias("ll"))


def inverse_and_log_det(cells: DataFrame) -> DataFrame:
    """g, i, j, w (inverse), log_det: one task per grid point; a dense matrix must fit a task, as for any full process."""

    def solve(key, pdf):
        import numpy as np
        import pandas as pd

        ids = np.unique(pdf["i"])
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])] = pdf["w"]
        inv, det = np.linalg.inv(m), np.linalg.slogdet(m)[1]
        i, j = np.indices(m.shape)
        return pd.DataFrame({"g": key[0], "i": ids[i.ravel()], "j": ids[j.ravel()], "w": inv.ravel(), "log_det": det})

    return cells.groupBy("g").applyInPandas(solve, "g int, i long, j long, w double, log_det double")


def similarity(taxonomy: DataFrame) -> DataFrame:
    """sp1, sp2, c: share of ranks on which two species agree. taxonomy(species, rank, taxon), a row for each rank.

    A species is one row that holds its taxa; ranks are few, so nothing is joined by them. All pairs are what is asked.
    """
    taxa = taxonomy.groupBy("species").agg(F.collect_list(F.struct("rank", "taxon")).alias("l"), as_map("rank", "taxon").alias("m"))
    pairs = taxa.select(F.col("species").alias("sp1"), "l").crossJoin(taxa.select(F.col("species").alias("sp2"), "m"))
    shared = F.filter("l", lambda x: F.map_contains_key("m", x["rank"]))
    same = F.filter(F.transform(shared, lambda x: (x["taxon"] == F.col("m")[x["rank"]]).cast("double")), lambda x: x.isNotNull())
    mean = F.when(F.size(same) > 0, F.aggregate(same, F.lit(0.0), lambda s, x: s + x) / F.size(same))
    return pairs.filter(F.size(shared) > 0).select("sp1", "sp2", mean.alias("c"))
