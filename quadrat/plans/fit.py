"""Fitting: one task per chain, draws as a long table; summaries of draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.kernels.chain import cells, run
from quadrat.kernels.state import Model
from quadrat.sources.draws import SCHEMA

#: The most bytes of a model that goes to all executors.
MOST_BYTES = 4 << 30


def batch_of(chain: int, draw: int, p: dict, keep_eta: bool):
    """A draw as an Arrow batch of its cells."""
    import pyarrow as pa

    out = {c: [] for c in ("param", "level", "i", "j", "k", "v")}
    for name, level, m in cells(p, keep_eta):
        i, j, k = (*(x.ravel() for x in np.indices(m.shape)), np.full(m.size, -1))[:3]  # -1: there is no third axis
        for c, x in zip(out, (np.full(m.size, name, object), np.full(m.size, level), i, j, k, m.ravel()), strict=True):
            out[c].append(x)
    cat = {c: np.concatenate(v) for c, v in out.items()}
    n = len(cat["v"])
    ints = [pa.array(x.astype(np.int32)) for x in (np.full(n, chain), np.full(n, draw))]
    axes = [pa.array(cat[c].astype(np.int32), mask=cat[c] < (0 if c == "k" else -1)) for c in ("level", "i", "j", "k")]
    return pa.RecordBatch.from_arrays([*ints, pa.array(cat["param"], pa.string()), *axes, pa.array(cat["v"].astype(float))], ["chain", "draw", "param", "level", "i", "j", "k", "v"])


def times_of(chain: int, seconds: dict):
    """Calls (i = 0) and seconds (i = 1) of each update, as rows of a draw -1."""
    import pyarrow as pa

    names = [f"time:{k}" for k in seconds for _ in range(2)]
    n = len(names)
    same = lambda x: pa.array(np.full(n, x, np.int32))
    return pa.RecordBatch.from_arrays([same(chain), same(-1), pa.array(names, pa.string()), same(-1), pa.array(np.arange(n, dtype=np.int32) % 2), same(0), pa.nulls(n, pa.int32()), pa.array([float(x) for v in seconds.values() for x in v], pa.float64())], ["chain", "draw", "param", "level", "i", "j", "k", "v"])


def shared(spark: SparkSession, model: Model, states: list[dict] | None):
    """The model and the first states as a broadcast, if their arrays take no more than MOST_BYTES."""

    def size(x) -> int:
        if isinstance(x, np.ndarray):
            return x.nbytes
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, (list, tuple)) else vars(x).values() if hasattr(x, "__dict__") else x.data.nbytes if hasattr(x, "data") else ()
        return inner if isinstance(inner, int) else sum(size(y) for y in inner)

    taken = size(model) + size(states or [])
    if taken > MOST_BYTES:
        raise ValueError(f"the model's arrays take {taken:,} bytes, and every task of a chain holds them all: {MOST_BYTES:,} at most; updates over tables (quadrat.operators) have no such bound")
    return spark.sparkContext.broadcast((model, states or []))


def fit(spark: SparkSession, model: Model, chains: int = 2, samples: int = 10, transient: int = 0, thin: int = 1, seed: int = 0, *, states: list[dict] | None = None, only: list[int] | None = None, keep_eta: bool = True, verbose: int = 0, profile: bool = False, **how) -> DataFrame:
    """Draws of all chains. Chains are independent tasks; a lost one is drawn again, with the same values.

    The model's arrays go out once per executor as a broadcast of a checked size, as any chain needs them in memory. Draws
    leave a task one at a time. With verbose, a task tells of every verbose-th draw on its standard error. With profile, calls
    and seconds of each update follow a chain's draws, as draw -1: sources.draws.profile() reads them.
    """
    chosen = [c for c in range(chains) if only is None or c in only]
    given = shared(spark, model, states)

    def draw(batches):
        import sys

        model, states = given.value
        for b in batches:
            for c in b.column("chain").to_pylist():
                first = states[c] if c < len(states) else None
                seconds = {} if profile else None
                for d, p in run(model, c, samples, transient, thin, seed, first=first, seconds=seconds, **how):
                    if verbose and (d + 1) % verbose == 0:
                        print(f"chain {c}: draw {d + 1} of {samples}", file=sys.stderr, flush=True)
                    yield batch_of(c, d, p, keep_eta)
                if profile:
                    yield times_of(c, seconds)

    tasks = spark.createDataFrame([(c,) for c in chosen], "chain int").repartition(max(1, len(chosen)), "chain")
    return tasks.mapInArrow(draw, SCHEMA)


def summary(draws: DataFrame, *by: str) -> DataFrame:
    """n, mean, sd and quantiles of each value over draws and chains."""
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = draws.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), q.alias("q"))
    return out.select(*by, "n", "mean", "sd", F.col("q")[0].alias("q025"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q975"))


def r_hat(draws: DataFrame, *by: str) -> DataFrame:
    """Potential scale reduction: between against within variance of the chains."""
    per = draws.groupBy(*by, "chain").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s2"), F.count("*").alias("n"))
    of = per.groupBy(*by).agg(F.avg("s2").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"))
    return of.select(*by, F.when(F.col("within") > 0, F.sqrt((F.col("n") - 1) / F.col("n") + F.col("between") / F.col("within"))).alias("r_hat"))


def effective_size(draws: DataFrame, *by: str, lag: int = 1) -> DataFrame:
    """Draws divided by their autocorrelation time, taken as that of a first-order process."""
    w = Window.partitionBy(*by, "chain").orderBy("draw")
    mean = F.avg("v").over(Window.partitionBy(*by, "chain"))
    d = draws.withColumn("_d", F.col("v") - mean).withColumn("_l", F.lag("_d", lag).over(w))
    rho = F.sum(F.col("_d") * F.col("_l")) / F.sum(F.col("_d") * F.col("_d"))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.sum(F.col("_d") * F.col("_d")) > 0, rho).alias("rho"))
    r = F.greatest(F.least(F.coalesce("rho", F.lit(0.0)), F.lit(0.999)), F.lit(-0.999))
    return out.select(*by, "n", (F.col("n") * (1 - r) / (1 + r)).alias("ess"))


def sequence_effective_size(draws: DataFrame, *by: str) -> DataFrame:
    """Draws divided by their autocorrelation time: all lags, pooled over chains, in pairs up to the first pair that is not positive.

    A chain's draws of one value are one array, in order; lags are sums over it. The time is at least
    1 / log10 of the draws; values that never move have as many effective draws as draws.
    """
    chain = draws.groupBy(*by, "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "v"))), lambda x: x["v"]).alias("x"), F.avg("v").alias("m"))
    chain = chain.select(*by, F.transform("x", lambda v: v - F.col("m")).alias("x"))
    last = F.size("x") - 1
    lags = F.transform(F.sequence(F.lit(0), last), lambda t: F.aggregate(F.sequence(F.lit(0), last - t), F.lit(0.0), lambda s, i: s + F.get("x", i) * F.get("x", i + t)))
    of = chain.select(*by, F.size("x").alias("n"), lags.alias("c")).groupBy(*by).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.collect_list("c").alias("c"))
    at = lambda t: F.aggregate("c", F.lit(0.0), lambda s, c: s + F.coalesce(F.get(c, t), F.lit(0.0)))
    of = of.withColumn("c0", at(F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.col("most") - 1) / 2).cast("int")), lambda k: (at(2 * k) + at(2 * k + 1)) / F.col("c0"))
    state = lambda total, on: F.struct(total.alias("total"), on.alias("on"))
    grown = F.aggregate(pairs, state(F.lit(0.0), F.lit(True)), lambda s, p: state(s["total"] + F.when(s["on"] & (p > 0), p).otherwise(0.0), s["on"] & (p > 0)), lambda s: s["total"])
    time = F.when(F.col("c0") > 0, F.greatest(2 * grown - 1, 1 / F.greatest(F.log10("n"), F.lit(1.0)))).otherwise(1.0)
    return of.select(*by, "n", (F.col("n") / time).alias("ess"))
