"""A model in one JSON text: its long tables, and its arrays for the kernels.

Top level: hM (data, design, priors), initParList (a state per chain), dataParList (spatial inputs of the
levels), nChains. Indices in the file count from 1. Missing numbers are null, "NA" or "NaN".
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.kernels import spatial
from quadrat.kernels.state import Level, Model
from quadrat.sources import rds

MATRIX = "array<array<string>>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row, the whole text; of an .rds file, the text in it."""
    if path.endswith(".rds"):
        raw = spark.read.format("binaryFile").load(path).select("content").first()
        return spark.createDataFrame([(rds.text_of(bytes(raw["content"])),)], "json string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def number(c: Column) -> Column:
    """null for null, NA and NaN, as strings inside an array do not spoil the array."""
    return F.when(~F.upper(c).isin("NA", "NAN"), c.try_cast("double"))


def matrix(text: DataFrame, key: str, row: str, col: str, value: str) -> DataFrame:
    """A matrix under hM as a long table of its cells."""
    m = F.from_json(F.get_json_object("json", f"$.hM.{key}"), MATRIX)
    rows = text.select(F.posexplode(m).alias(row, "_r"))
    return rows.select(row, F.posexplode("_r").alias(col, "_v")).select(row, col, number(F.col("_v")).alias(value))


def dims(text: DataFrame) -> DataFrame:
    """ny ns nc nt nr ncsel ncRRR ncNRRR ncORRR nuRRR of the model, scalars or arrays of one."""
    names = ("ny", "ns", "nc", "nt", "nr", "ncsel", "ncRRR", "ncNRRR", "ncORRR", "nuRRR")
    return text.select(*[F.regexp_replace(F.get_json_object("json", f"$.hM.{n}"), r"[\[\]]", "").try_cast("int").alias(n) for n in names])


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """y, x, traits, similarity, units and species as long tables."""
    text = read_text(spark, path)
    distr = matrix(text, "distr", "species", "c", "v").groupBy("species").agg(F.max(F.when(F.col("c") == 0, F.col("v"))).cast("int").alias("family"), F.max(F.when(F.col("c") == 1, F.col("v"))).cast("int").alias("var_free"))
    return {
        "y": matrix(text, "YScaled", "site", "species", "y"),
        "x": matrix(text, "XScaled", "site", "cov", "x"),
        "traits": matrix(text, "TrScaled", "species", "trait", "t"),
        "similarity": matrix(text, "C", "sp1", "sp2", "c"),
        "pi": matrix(text, "Pi", "site", "level", "unit").withColumn("unit", F.col("unit").cast("int") - 1),
        "species": distr,
    }


def _array(v) -> np.ndarray:
    def one(x):
        return [one(y) for y in x] if isinstance(x, list) else np.nan if x in (None, "NA", "NaN") else x

    return np.array(one(v), float)


def _scalar(v):
    return v[0] if isinstance(v, list) else v


def load(text: str) -> tuple[Model, list[dict]]:
    """The arrays of the model, and the first state of each chain that the file gives one for."""
    obj = json.loads(text)
    h = obj["hM"]
    for key in ("YScaled", "XScaled", "Pi", "distr"):
        if h.get(key) is None:
            raise ValueError(f"the model has no {key}")
    y, distr = _array(h["YScaled"]), _array(h["distr"]).astype(int)
    pi = _array(h["Pi"]).astype(int).reshape(len(y), -1) - 1
    xs = h["XScaled"]
    x = np.stack([_array(v) for v in xs.values()]) if isinstance(xs, dict) else _array(xs)
    given = (obj.get("dataParList") or {}).get("rLPar") or [None] * pi.shape[1]
    levels = [_level(v, g) for v, g in zip((h.get("rL") or {}).values(), given, strict=True)] if h.get("rL") else []
    selections = [{"covs": np.atleast_1d(_array(s["covGroup"])).astype(int) - 1, "group": np.atleast_1d(_array(s["spGroup"])).astype(int) - 1, "q": np.atleast_1d(_array(s["q"]))} for s in h.get("XSelect") or []]
    opt = lambda key: _array(h[key]) if h.get(key) else None
    model = Model(
        Y=y, X=x, Pi=pi, family=distr[:, 0], var_free=distr[:, 1] == 1, T=opt("TrScaled"), C=opt("C"), levels=levels,
        a_sigma=opt("aSigma"), b_sigma=opt("bSigma"), m_gamma=opt("mGamma"), u_gamma=opt("UGamma"), f0=_scalar(h["f0"]) if h.get("f0") else None, V0=opt("V0"),
        rho_grid=opt("rhopw"), selections=selections, XR=opt("XRRRScaled"), n_rrr=int(_scalar(h.get("ncRRR") or 0)),
    )
    return model, [_state(model, s) for s in obj.get("initParList") or []]


def _level(v: dict, given: dict | None) -> Level:
    level = Level(*(float(_scalar(v[k])) for k in ("nu", "a1", "b1", "a2", "b2")), int(_scalar(v["nfMin"])), int(min(_scalar(v["nfMax"]), 10**6)))
    if _scalar(v.get("xDim") or 0):
        level.x = _array(v["xMat"])
        if level.x.ndim != 2 or level.x.shape[1] != int(_scalar(v["xDim"])):
            raise ValueError("xMat needs a column for each of the level's xDim covariates")
    if _scalar(v.get("sDim") or 0):
        level.alpha = _array(v["alphapw"])
        a = level.alpha[:, 0]
        kind = _scalar(v.get("spatialMethod") or "Full")
        if kind == "Full":
            level.method, level.grid = "full", spatial.full(_array(given["distMat"]), a)
        elif kind == "GPP":
            level.method, level.grid = "gpp", spatial.gpp(_array(given["distMat12"]), _array(given["distMat22"]), a)
        else:
            near = [np.atleast_1d(_array(i)).astype(int).ravel() - 1 for i in given["indices"]]
            level.method, level.grid = "nngp", spatial.nngp(near, [np.atleast_2d(_array(d)) for d in given["distList"]], a)
    return level


def _by_covariate(model: Model, r: int, v: np.ndarray) -> np.ndarray:
    """[factors, species, covariates]. The file's numbers, nested or not, go by factors first, then species, then covariates."""
    return np.ascontiguousarray(v.reshape(*model.levels[r].axes, model.Y.shape[1], -1).transpose(2, 1, 0))


def _state(model: Model, s: dict) -> dict:
    from quadrat.kernels.random import Noise
    from quadrat.kernels.state import effective, start

    p = start(model, Noise(0, 0, 0, 99, quiet=True))
    p |= {"Beta": _array(s["Beta"]), "Gamma": _array(s["Gamma"]), "iV": np.linalg.inv(_array(s["V"])), "sigma": _array(s["sigma"]), "rho": np.atleast_1d(_array(s["rho"])).astype(int) - 1}
    for key in ("Eta", "Lambda", "Psi"):
        p[key] = [np.atleast_2d(_array(v)) if key == "Eta" or model.levels[r].x is None else _by_covariate(model, r, _array(v)) for r, v in enumerate(s.get(key) or [])]
    p["Delta"] = [np.ravel(_array(v)).reshape(-1, *model.levels[r].axes) for r, v in enumerate(s.get("Delta") or [])]
    p["Alpha"] = [np.ravel(_array(v)).astype(int) - 1 for v in s.get("Alpha") or []]
    p["BetaSel"] = [np.ravel(_array(v)).astype(bool) for v in s.get("BetaSel") or []]
    if model.n_rrr:
        p |= {"wRRR": np.atleast_2d(_array(s["wRRR"])), "PsiRRR": np.atleast_2d(_array(s["PsiRRR"])), "DeltaRRR": np.ravel(_array(s["DeltaRRR"]))}
    p["rho"] = np.maximum(p["rho"], 0)
    return p | {"Xeff": effective(model, p)}
