import numpy as np
from pyspark.sql import functions as F

from quadrat.functions import scalar, tensor
from quadrat.kernels.random import polya_gamma_moments


def long(spark, m, *axes):
    return spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(m) for at in [at]], ", ".join(f"{a} int" for a in axes) + ", v double")


def dense(df, shape, *axes):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r["v"]
    return out


def test_contract_is_a_matrix_product(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((3, 4)), rng.random((4, 2))
    got = tensor.contract(long(spark, a, "i", "k"), long(spark, b, "k", "j"), ["k"], ["i", "j"])
    np.testing.assert_allclose(dense(got, (3, 2), "i", "j"), a @ b)


def test_gram_has_products_and_right_side(spark):
    rng = np.random.default_rng(1)
    x, w, z = rng.random((6, 3)), rng.random(6), rng.random(6)
    rows = spark.createDataFrame([(0, *map(float, r), float(a), float(b)) for r, a, b in zip(x, w, z, strict=True)], "s int, x0 double, x1 double, x2 double, w double, z double")
    got = {(r.a, r.b): r.v for r in tensor.gram(rows, ["x0", "x1", "x2"], F.col("w"), ["s"], F.col("z")).collect()}
    g = (x * w[:, None]).T @ x
    for i in range(3):
        assert np.isclose(got[i, -1], (x[:, i] * w * z).sum())
        for j in range(3):
            assert np.isclose(got[i, j], g[i, j])


def test_windows(spark):
    d = spark.createDataFrame([(0, h, v) for h, v in enumerate([2.0, 3.0, 0.5])], "level int, h int, v double")
    got = d.select("h", tensor.cumulative_product(F.col("v"), ["level"], "h").alias("p"), tensor.suffix_sum(F.col("v"), ["level"], "h").alias("s"), tensor.softmax(F.col("v"), ["level"]).alias("m")).orderBy("h").collect()
    assert [r.p for r in got] == [2.0, 6.0, 3.0]
    assert [r.s for r in got] == [5.5, 3.5, 0.5]
    assert np.isclose(sum(r.m for r in got), 1)


def test_stack_split_densify(spark):
    a, b = (spark.createDataFrame([(0, h, float(h)) for h in hs], "level int, h int, v double") for hs in ([0, 2], [0]))
    both = tensor.stack([(a.withColumn("h", tensor.densify(["level"], "h")), 0), (b, 2)], "h")
    assert sorted((r.h, r.v) for r in both.collect()) == [(0, 0.0), (1, 2.0), (2, 0.0)]
    assert [(r.h, r.v) for r in tensor.split(both, "h", 1, 2).collect()] == [(0, 2.0)]


def test_scatter_min(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 0.0), (1, 1.0)], "g int, v double")
    assert sorted((r.g, r.v) for r in tensor.scatter(rows, ["g"], how="min").collect()) == [(0, 0.0), (1, 1.0)]


def test_guards(spark):
    d = spark.createDataFrame([(0.0, float("nan"), 1.0), (2.0, 3.0, 0.0)], "w double, x double, b double")
    got = d.select(scalar.weighted(F.col("w"), F.col("x")).alias("p"), scalar.ratio(F.col("w"), F.col("b")).alias("q"), scalar.decay(F.col("w"), F.lit(0.0)).alias("e")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 1.0), (6.0, 0.0, 0.0)]


def test_polya_gamma_in_columns_equals_kernel_and_is_stable(spark):
    z = [0.0, 1e-3, 0.5, -3.0, 50.0, 800.0]
    d = spark.createDataFrame([(i, 1001.0, v) for i, v in enumerate(z)], "i int, h double, z double")
    m, s = scalar.polya_gamma(F.col("h"), F.col("z"))
    got = d.select("i", m.alias("m"), s.alias("s")).orderBy("i").collect()
    km, ks = polya_gamma_moments(np.full(len(z), 1001.0), np.array(z))
    np.testing.assert_allclose([r.m for r in got], km)
    np.testing.assert_allclose([r.s for r in got], ks)
    assert np.isfinite(ks).all() and np.isclose(ks[4] ** 2, 1001 * 2 / (4 * 50**3), rtol=0.05)


def test_recorded_draws(spark):
    d = spark.range(20).filter(scalar.recorded(F.col("id"), 5, 3)).select(scalar.draw_of(F.col("id"), 5, 3).alias("d"), "id").orderBy("id")
    assert [tuple(r) for r in d.collect()] == [(0, 7), (1, 10), (2, 13), (3, 16), (4, 19)]


def test_cells_meet_their_parts_without_a_shuffle_of_levels(spark):
    from quadrat.operators import design, statistics
    from quadrat.functions.tensor import contract

    frame = lambda rows, names: spark.createDataFrame(rows, names)
    x = frame([(s, c, 0.5 * s + c) for s in range(4) for c in range(2)], "site long, cov int, x double")
    beta = frame([(c, p, 1.0 + c - p) for c in range(2) for p in range(3)], "cov int, species int, v double")
    pi = frame([(s, r, s % (2 + r)) for s in range(4) for r in range(2)], "site long, level int, unit int")
    eta = frame([(r, u, h, u + 0.1 * h - r) for r in range(2) for u in range(2 + r) for h in range(2)], "level int, unit int, h int, v double")
    lam = frame([(r, h, p, 0.3 * h + p - r) for r in range(2) for h in range(2) for p in range(3)], "level int, h int, species int, v double")
    cells = frame([(s, p, None if (s + p) % 3 == 0 else 1.5 * s - p, float((s + p) % 3 > 0)) for s in range(4) for p in range(3)], "site long, species int, z double, id double")
    by_unit = contract(eta, lam, ["level", "h"], ["level", "unit", "species"])
    got = design.at_cells(cells, x, beta, pi, by_unit)
    tidy = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    want = statistics.level_residuals(design.fixed_part(x, beta), pi.join(by_unit, ["level", "unit"]), cells)
    assert tidy(statistics.residuals_at_cells(got)) == tidy(want.select("level", "unit", "site", "species", "s", "id"))
    assert tidy(got.select("site", "species", (F.col("f") + design.total("owns")).alias("l"))) == tidy(design.predictor(x, beta, pi, eta, lam))
