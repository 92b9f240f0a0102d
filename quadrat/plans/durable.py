"""Long fits in segments: a chain's state is committed every so many iterations, and a fit that ended goes on from there.

A segment is one Spark job, a task for each chain; its draws and the chains' states are one Parquet table, which counts
once it is committed as a whole. A lost task repeats its segment; a lost driver, all that was not committed. As every
update's noise follows from (seed, chain, iteration), the draws are those of a fit in one go.

Defined cases: a fit that is complete runs nothing again; a segment without its commit mark is written anew; a folder of
another fit (other settings, or other shapes of the model) is an error; draws are in the folder once, whatever ended.
"""

from __future__ import annotations

import json
import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.kernels.chain import run
from quadrat.kernels.state import Model
from quadrat.plans.fit import batch_of, shared, times_of
from quadrat.sources.draws import SCHEMA


def _committed(spark: SparkSession, path: str, segment: int) -> bool:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_table(path, segment)}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def _table(path: str, segment: int) -> str:
    return f"{path.rstrip('/')}/segment-{segment:06d}"


def _segment(spark: SparkSession, path: str, segment: int) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, state binary, settings string").parquet(_table(path, segment))


def fit_durably(spark: SparkSession, model: Model, path: str, chains: int = 2, samples: int = 10, transient: int = 0, thin: int = 1, seed: int = 0, *, every: int = 100, states: list[dict] | None = None, only: list[int] | None = None, keep_eta: bool = True, profile: bool = False, **how) -> DataFrame:
    """Draws of all chains, as fit(), by way of a folder that all executors see; every: iterations of a segment."""
    chosen = [c for c in range(chains) if only is None or c in only]
    settings = json.dumps({"chains": chosen, "samples": samples, "transient": transient, "thin": thin, "seed": seed, "every": every, "shapes": [*model.Y.shape, *model.X.shape], **how}, sort_keys=True)
    given = shared(spark, model, states)
    ends = list(range(every, transient + samples * thin, every)) + [transient + samples * thin]

    def draw(batches, until: int):
        import pyarrow as pa

        def with_none(x):
            return pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.binary()), pa.nulls(x.num_rows, pa.string())], [*x.schema.names, "state", "settings"])

        model, states = given.value
        for b in batches:
            for c, state in zip(b.column("chain").to_pylist(), b.column("state").to_pylist(), strict=True):
                held = pickle.loads(state) if state else {}
                seconds = {} if profile else None
                for d, p in run(model, c, samples, transient, thin, seed, first=states[c] if c < len(states) else None, held=held, until=until, seconds=seconds, **how):
                    yield with_none(batch_of(c, d, p, keep_eta))
                if profile:
                    yield with_none(times_of(c, seconds))
                none = [pa.nulls(1, t) for t in (pa.int32(), pa.string(), *[pa.int32()] * 4, pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *none, pa.array([pickle.dumps(held)], pa.binary()), pa.array([settings])], ["chain", "draw", "param", "level", "i", "j", "k", "v", "state", "settings"])

    done = 0
    while done < len(ends) and _committed(spark, path, done):
        done += 1
    if done:
        found = _segment(spark, path, done - 1).filter("settings is not null").select("settings").first()
        if not found or found["settings"] != settings:
            raise ValueError(f"{path} holds another fit: {found and found['settings']}")
    for k in range(done, len(ends)):
        if k:
            starts = _segment(spark, path, k - 1).filter("state is not null").select("chain", "state")
        else:
            starts = spark.createDataFrame([(c, None) for c in chosen], "chain int, state binary")
        out = starts.repartition(max(1, len(chosen)), "chain").mapInArrow(lambda x, until=ends[k]: draw(x, until), f"{SCHEMA}, state binary, settings string")
        out.write.mode("overwrite").parquet(_table(path, k))
    return draws_of(spark, path, len(ends))


def draws_of(spark: SparkSession, path: str, segments: int) -> DataFrame:
    """The draws of a folder's first segments."""
    tables = [_table(path, k) for k in range(segments)]
    return spark.read.schema(f"{SCHEMA}, state binary, settings string").parquet(*tables).filter("draw is not null").drop("state", "settings")
