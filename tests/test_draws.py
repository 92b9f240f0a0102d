"""Draws in columns, many small systems, knot processes: against known answers, exact moments and dense algebra."""

import os
import statistics as exact

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import draws
from quadrat.operators import predictive, solve, spatial
from quadrat.operators.statistics import latent_responses

KEY = (7, 2, 11)


def test_threefry_gives_the_published_answers():
    assert draws.words(0, 0, 0, 0) == (0x6B200159, 0x99BA4EFE)
    assert draws.words(draws.WORD, draws.WORD, draws.WORD, draws.WORD) == (0x1CB996FC, 0xBB002BE7)
    assert draws.words(0x13198A2E, 0x03707344, 0x243F6A88, 0x85A308D3) == (0xC4923A9C, 0x483DF7A0)


def test_columns_and_arrays_draw_the_same(spark):
    cells = [0, 1, 5, -3, 1 << 40, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(c,) for c in cells], "cell long")
    for stream in (0, 3):
        got = {r.cell: r.u for r in draws.with_uniform(df, "u", *KEY, F.col("cell"), stream).collect()}
        keyed = spark.createDataFrame([(c, *KEY[1:]) for c in cells], "cell long, chain int, iteration int").repartition(3)
        again = {r.cell: r.u for r in draws.with_uniform(keyed, "u", KEY[0], F.col("chain"), F.col("iteration"), F.col("cell"), stream).collect()}
        literal = draws.with_uniform(df, "u", KEY[0], F.lit(KEY[1]), F.lit(KEY[2]), F.col("cell"), stream)
        assert {r.cell: r.u for r in literal.collect()} == got
        assert list(got.values()) == draws.uniforms(*KEY, cells, stream).tolist() and got == again
        assert all(0 < u < 1 for u in got.values()) and len(set(got.values())) == len(cells)
    assert "PythonUDF" not in draws.with_uniform(df, "u", *KEY, F.col("cell"))._jdf.queryExecution().toString()


def test_uniforms_are_even_and_unrelated():
    u = draws.uniforms(1, 0, 0, np.arange(200_000))
    v = draws.uniforms(1, 0, 1, np.arange(200_000))
    counts = np.histogram(u, 100, (0, 1))[0]
    assert ((counts - 2000) ** 2 / 2000).sum() < 160 and abs(np.corrcoef(u, v)[0, 1]) < 0.01 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01


def test_normal_quantile_and_distribution(spark):
    norm = exact.NormalDist()
    ps = [1e-300, 1e-30, 1e-9, 0.01, 0.07, 0.075, 0.3, 0.5, 0.925, 0.99, 1 - 1e-12]
    got = draws.with_normal(spark.createDataFrame([(p,) for p in ps], "p double"), "z", "p").collect()
    assert np.allclose([r.z for r in got], [norm.inv_cdf(p) for p in ps], rtol=1e-14, atol=1e-15)
    xs = [-37.0, -20.0, -8.0, -7.0, -1.0, 0.0, 0.3, 3.0, 9.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", draws.lower_tail(F.col("x")).alias("p")).collect()
    from math import erfc

    assert np.allclose([r.p for r in rows], [0.5 * erfc(-x / 2**0.5) for x in xs], rtol=2e-8, atol=0)


@pytest.mark.parametrize("mean, sd, low, high", [(0.5, 1.0, 0.0, None), (-6.0, 1.0, 0.0, None), (9.0, 2.0, None, 0.0), (0.0, 1.0, -1.0, 2.0), (3.0, 0.5, -1.0, 0.0), (-90.0, 1.0, 0.0, None), (80.0, 1.0, None, 0.0), (0.0, 1.0, None, None)])
def test_truncated_normal(spark, mean, sd, low, high):
    n = 20_000
    df = draws.with_uniform(spark.range(n), "u", *KEY, F.col("id"))
    x = np.array([r.x for r in draws.with_truncated_normal(df, "x", F.lit(mean), F.lit(sd), F.lit(low).cast("double"), F.lit(high).cast("double"), "u").select("x").collect()])
    assert np.isfinite(x).all() and (low is None or (x >= low).all()) and (high is None or (x <= high).all())
    # moments by a sum over a fine grid of the density
    a, b = max(mean - 12 * sd, low if low is not None else -np.inf), min(mean + 12 * sd, high if high is not None else np.inf)
    if a > b:  # far in a tail: an exponential in effect
        edge, rate = (low, (low - mean) / sd**2) if low is not None else (high, (mean - high) / sd**2)
        assert abs(np.abs(x - edge).mean() * rate - 1) < 0.05
        return
    t = np.linspace(a, b, 200_001)
    w = np.exp(-(((t - mean) / sd) ** 2) / 2 + (((t - mean) / sd) ** 2).min() / 2)
    m = (t * w).sum() / w.sum()
    s = np.sqrt(((t - m) ** 2 * w).sum() / w.sum())
    assert abs(x.mean() - m) < 5 * s / np.sqrt(n) and abs(x.std() / s - 1) < 0.05


def test_categorical_follows_its_logits(spark):
    p = np.array([0.5, 0.3, 0.2])
    rows = spark.range(30_000).select(F.col("id").alias("k"), F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(float(np.log(x)) + 700).alias("ll")) for g, x in enumerate(p)), F.struct(F.lit(3).alias("g"), F.lit(None).cast("double").alias("ll")))).alias("c")).select("k", "c.g", "c.ll")
    drawn = draws.categorical(draws.with_uniform(rows, "u", *KEY, F.col("k") * 4 + F.col("g")), ["k"], "g", "ll", "u")
    got = {r.g: r["count"] / 30_000 for r in drawn.groupBy("g").count().collect()}
    assert set(got) == {0, 1, 2} and np.allclose([got[g] for g in range(3)], p, atol=0.015)


def test_latent_responses_of_all_families(spark):
    n = 4000
    cells = spark.range(n * 5).select((F.col("id") / 5).cast("int").alias("site"), (F.col("id") % 5).cast("int").alias("species"))
    family, y = F.element_at(F.array(*map(F.lit, (1, 2, 2, 3, 1))), F.col("species") + 1), F.element_at(F.array(*map(F.lit, (1.5, 1.0, 0.0, 7.0, None))), F.col("species") + 1)
    cells = cells.select("site", "species", family.alias("family"), y.cast("double").alias("y"), F.when(F.col("species") == 3, 2.0).otherwise(0.4).alias("l"), F.lit(1.2).alias("sigma"))
    got = latent_responses(cells, F.col("site") * 8 + F.col("species"), *KEY).groupBy("species").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.avg("z").alias("m"), F.stddev("z").alias("s"), F.count("z").alias("n")).orderBy("species").collect()
    assert got[0].lo == got[0].hi == 1.5 and got[1].lo > 0 and got[2].hi < 0
    norm = exact.NormalDist()
    a = 0.4 / 1.2
    assert abs(got[1].m - (0.4 + 1.2 * norm.pdf(a) / norm.cdf(a))) < 0.07 and abs(got[2].m - (0.4 - 1.2 * norm.pdf(a) / norm.cdf(-a))) < 0.07
    assert abs(got[4].m - 0.4) < 0.08 and abs(got[4].s - 1.2) < 0.06 and all(r.n == n for r in got)
    assert 1.6 < got[3].m < 2.4  # a count of 7 draws near log 7 and its predictor


# many small systems


def test_posterior_equals_dense_solutions(spark):
    rng = np.random.default_rng(0)
    n, keys = 4, [3, 10, 11]
    rows, priors, want = [], [], {}
    for k in keys:
        x, z, w = rng.normal(size=(9, n)), rng.normal(size=9), rng.random(9)
        rows += [(k, *map(float, a), float(b), float(c)) for a, b, c in zip(x, z, w, strict=True)]
        q = np.eye(n) * (k != 11) * 2.0
        r = np.arange(n) * 0.5 * (k != 11)
        if k != 11:  # the last has no prior
            priors += [(k, a, a, 1.0) for a in range(n)] * 2 + [(k, a, -1, float(r[a])) for a in range(n)]
        p = (x * w[:, None]).T @ x + q
        want[k] = p, np.linalg.solve(p, (x * w[:, None]).T @ z + r)
    df = spark.createDataFrame(rows, "s int, x0 double, x1 double, x2 double, x3 double, z double, w double")
    systems = solve.equations(df, ["x0", "x1", "x2", "x3"], F.col("w"), "s", F.col("z"))
    got = {r.s: r for r in solve.posterior(systems, "s", spark.createDataFrame([*priors, (99, 0, 0, 1.0)], "s int, a int, b int, v double"), *KEY).collect()}
    assert sorted(got) == keys
    for k, (p, m) in want.items():
        np.testing.assert_allclose(got[k].mean, m, rtol=1e-9)
        noise = draws.normals(draws.uniforms(*KEY, k * n + np.arange(n)))
        np.testing.assert_allclose(np.linalg.cholesky(p).T @ (np.array(got[k].draw) - m), noise, rtol=1e-8)
    again = {r.s: r.draw for r in solve.posterior(systems.repartition(3), "s", spark.createDataFrame(priors, "s int, a int, b int, v double"), *KEY).collect()}
    assert all(np.allclose(again[k], got[k].draw, rtol=1e-12) for k in keys)
    assert solve.posterior(systems.limit(0), "s", spark.createDataFrame(priors, "s int, a int, b int, v double"), *KEY).isEmpty()


# knots and neighbours


def place(spark, xy, names):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(xy)], names)


def test_knot_process_equals_dense_algebra(spark):
    rng = np.random.default_rng(1)
    xy, knots, eta = rng.random((40, 2)), rng.random((6, 2)), rng.normal(size=(40, 2))
    xy[7] = knots[2]  # a unit at a knot
    grid = spark.createDataFrame([(0, 0.0, 0.4), (1, 0.3, 0.3), (2, 1.5, 0.3)], "g int, alpha double, pw double")
    units, k = place(spark, xy, "i long, p array<double>").repartition(3), place(spark, knots, "j long, p array<double>")
    scores = spark.createDataFrame([(i, h, float(eta[i, h])) for i in range(40) for h in range(2)], "unit long, h int, v double")
    got = {(r.g, r.h): r for r in predictive.log_likelihood(units, k, grid, scores).collect()}
    left = {(r.g, r.i): r.dd for r in predictive.left_variances(units, k, grid).collect()}
    far = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    for g, alpha, pw in ((0, 0.0, 0.4), (1, 0.3, 0.3), (2, 1.5, 0.3)):
        w = lambda a, b: np.exp(-far(a, b) / alpha) if alpha else (far(a, b) == 0) * 1.0  # noqa: E731, B023
        low = w(xy, knots) @ np.linalg.solve(w(knots, knots), w(knots, xy))
        d = np.maximum(1 - np.diag(low), predictive.FLOOR)
        np.testing.assert_allclose([left[g, i] for i in range(40)], d, rtol=1e-5, atol=1e-12)
        cov = low + np.diag(d)
        for h in range(2):
            quad = eta[:, h] @ np.linalg.solve(cov, eta[:, h])
            det = np.linalg.slogdet(cov)[1]
            np.testing.assert_allclose([got[g, h].log_det, got[g, h].quad, got[g, h].ll], [det, quad, np.log(pw) - det / 2 - quad / 2], rtol=1e-4)
    with pytest.raises(ValueError, match="different places"):
        predictive.left_variances(units, k.union(k), grid)
    assert predictive.log_likelihood(units.limit(0), k, grid, scores.limit(0)).isEmpty()


def test_neighbour_likelihood_with_all_predecessors_is_the_full_one(spark):
    rng = np.random.default_rng(3)
    xy, eta = rng.random((9, 2)), rng.normal(size=(9, 2))
    units, grid = place(spark, xy, "i long, p array<double>"), spark.createDataFrame([(0, 0.5, 0.5), (1, 0.0, 0.5)], "g int, alpha double, pw double")
    scores = spark.createDataFrame([(i, h, float(eta[i, h])) for i in range(9) for h in range(2)], "unit long, h int, v double")
    weights = spatial.neighbour_weights(units, spatial.preceding_neighbours(units, 9), grid.select("g", "alpha"))
    got = {(r.g, r.h): (r.log_det, r.quad) for r in spatial.sparse_log_likelihood(weights, scores, grid).collect()}
    cov = np.exp(-np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) / 0.5)
    for h in range(2):
        np.testing.assert_allclose(got[0, h], [np.linalg.slogdet(cov)[1], eta[:, h] @ np.linalg.solve(cov, eta[:, h])], rtol=1e-8)
        np.testing.assert_allclose(got[1, h], [0.0, eta[:, h] @ eta[:, h]], rtol=1e-9, atol=1e-12)


def test_neighbours_at_one_place(spark):
    from quadrat.kernels.spatial import nearest, nngp

    xy = np.array([[0.1, 0.1], [0.5, 0.5], [0.5, 0.5], [0.5, 0.5], [0.9, 0.2], [0.5, 0.5]])
    units, grid = place(spark, xy, "i long, p array<double>"), spark.createDataFrame([(0, 0.5)], "g int, alpha double")
    got = spatial.neighbour_weights(units, spatial.preceding_neighbours(units, 3), grid).collect()
    own = {r.i: r.v for r in got if r.i == r.j}
    assert len(own) == 6 and all(np.isfinite(r.v) for r in got) and np.isclose(own[5], 1e-9**-0.5) and np.isclose(own[2], 1e-9**-0.5)
    rows = nngp(*nearest(xy, 3), np.array([0.5]))
    assert np.isfinite(rows["log_det"]).all() and np.isclose(rows["R"][0].own[5], 1e-9**-0.5)


# tiles


@pytest.mark.parametrize("n, tile", [(23, 5), (10, 10), (3, 8)])
def test_tiles_equal_dense_algebra(spark, n, tile):
    from quadrat.operators import dense

    rng = np.random.default_rng(n)
    xy, eta = rng.random((n, 2)), rng.normal(size=(n, 2))
    ids = rng.permutation(n) * 3
    units = spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in zip(ids, xy, strict=True)], "i long, p array<double>").repartition(3)
    scores = spark.createDataFrame([(int(ids[k]), h, float(eta[k, h])) for k in range(n) for h in range(2)], "unit long, h int, v double")
    grid = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.4, 0.5)], "g int, alpha double, pw double")
    got = {(r.g, r.h): r for r in dense.log_likelihood(dense.cholesky(dense.tiles(units, grid, scores, tile)), grid).collect()}
    solved = {(r.g, r.unit, r.h): r.v for r in dense.solutions(units, grid, scores, tile).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for g, w in ((0, np.eye(n)), (1, np.exp(-d / 0.4))):
        x = np.linalg.solve(w, eta)
        np.testing.assert_allclose([[solved[g, int(i), h] for h in range(2)] for i in ids], x, rtol=1e-7, atol=1e-9)
        for h in range(2):
            np.testing.assert_allclose([got[g, h].log_det, got[g, h].quad], [np.linalg.slogdet(w)[1], eta[:, h] @ x[:, h]], rtol=1e-7, atol=1e-9)


def test_tiles_that_are_used_up_are_deleted(spark, monkeypatch):
    from quadrat.operators import dense

    units, grid = place(spark, np.random.default_rng(0).random((9, 2)), "i long, p array<double>"), spark.createDataFrame([(0, 0.5, 1.0)], "g int, alpha double, pw double")
    stored, kept = [], dense.kept
    monkeypatch.setattr(dense, "kept", lambda df, name: stored.append((name, kept(df, name))) or stored[-1][1])
    assert dense.cholesky(dense.tiles(units, grid, tile=3)).count() == 6
    paths = {name: [f.rsplit("/", 1)[0].removeprefix("file:").replace("//", "/") for f in df.inputFiles()[:1]] for name, df in stored if name != "tiles"}
    assert all(os.path.isdir(p[0]) for p in paths.values() if p)
    left = [d for p in paths["diagonal"] for d in os.listdir(os.path.dirname(p)) if d.startswith("tiles-")]
    assert len([df for name, df in stored if name == "tiles"]) == 3 and not left


def test_tiles_of_no_units_and_of_units_at_one_place(spark):
    from quadrat.operators import dense

    units, grid = place(spark, np.array([[0.1, 0.2], [0.1, 0.2], [0.3, 0.3]]), "i long, p array<double>"), spark.createDataFrame([(0, 0.5, 1.0)], "g int, alpha double, pw double")
    scores = spark.createDataFrame([(0, 0, 1.0)], "unit long, h int, v double")
    with pytest.raises(Exception, match="one place"):
        dense.cholesky(dense.tiles(units, grid, scores, 2)).collect()
    assert dense.cholesky(dense.tiles(units.limit(0), grid, scores, 2)).isEmpty()
    assert [r.unit for r in dense.solutions(units.filter("i > 0"), grid, scores, 1).orderBy("unit").collect()] == [1, 2]


@pytest.mark.parametrize("block", [4, 100])
def test_products_equal_dense_algebra_and_make_no_pairs(spark, block):
    from quadrat.operators import dense

    rng = np.random.default_rng(block)
    xy, v = rng.random((21, 2)), rng.normal(size=(2, 21, 2))
    xy[20] = xy[3]
    units, grid = place(spark, xy, "i long, p array<double>"), spark.createDataFrame([(7, 0.0), (3, 0.4)], "g int, alpha double")
    values = spark.createDataFrame([((7, 3)[g], i, h, float(v[g, i, h])) for g in range(2) for i in range(20) for h in range(2)], "g int, i long, h int, v double")
    v[:, 20] = 0
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    w = np.stack([(d == 0).astype(float), np.exp(-d / 0.4)])
    got = {(r.g, r.i, r.h): r.v for r in dense.products(units, grid, values, block).collect()}
    np.testing.assert_allclose([[[got[g, i, h] for h in range(2)] for i in range(21)] for g in (7, 3)], w @ v, rtol=1e-12, atol=1e-12)
    sums = dense.products(units, grid, block=block)
    assert {(r.g, r.i): round(r.v, 9) for r in sums.collect()} == {((7, 3)[g], i): round(float(w[g, i].sum()), 9) for g in range(2) for i in range(21)}
    assert dense.products(units.limit(0), grid).isEmpty()


def test_decays_take_one_power_for_ranges_that_go_into_each_other(monkeypatch):
    from quadrat.operators import dense

    d, calls, exp = np.random.default_rng(2).random((7, 9)) * 3, [], np.exp
    d[0, 0] = 0
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
    alphas = [(0, 0.0), (1, 0.05), (2, 0.2), (3, 1.0), (4, 0.03)]
    got = {n: w.copy() for n, w in dense._decays(d, alphas, np.empty_like(d), np.empty_like(d))}
    assert len(calls) == 2  # 1 and 0.03; 0.2 is a fifth and 0.05 a fourth of the one before
    for n, alpha in alphas:
        np.testing.assert_allclose(got[n], exp(-d / alpha) if alpha else d == 0, rtol=3e-13)


def test_close_predecessors_are_about_the_nearest(spark):
    rng = np.random.default_rng(3)
    xy = np.r_[rng.random((250, 2)), rng.random((50, 2)) * 0.01]
    units = place(spark, xy, "i long, p array<double>")
    got = {}
    for r in spatial.close_predecessors(units, 4, 20, 30).collect():
        got.setdefault(r.i, set()).add(r.j)
    assert all(len(got.get(i, ())) == min(i, 4) and max(got.get(i, [-1])) < i for i in range(300))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    same = sum(len(got[i] & set(np.argsort(d[i, :i])[:4].tolist())) for i in range(1, 300))
    assert same > 0.95 * (300 * 4 - 10)
    assert spatial.close_predecessors(units.limit(0), 4).isEmpty()


def test_solutions_without_tiles_equal_dense_algebra(spark):
    from quadrat.operators import dense

    n = 40
    rng = np.random.default_rng(n)
    xy, eta = rng.random((n, 2)), rng.normal(size=(n, 2))
    units, grid = place(spark, xy, "i long, p array<double>"), spark.createDataFrame([(0, 0.0), (1, 0.4)], "g int, alpha double")
    scores = spark.createDataFrame([(k, h, float(eta[k, h])) for k in range(n) for h in range(2)], "unit long, h int, v double")
    got = {(r.g, r.unit, r.h): r.v for r in dense.iterated(units, grid, scores, 4, block=16).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    for g, w in ((0, np.eye(n)), (1, np.exp(-d / 0.4))):
        np.testing.assert_allclose([[got[g, i, h] for h in range(2)] for i in range(n)], np.linalg.solve(w, eta), rtol=1e-6, atol=1e-8)
    with pytest.raises(ValueError, match="one place"):
        dense.iterated(units.union(units.select(F.col("i") + n, "p")), grid, scores)
    with pytest.raises(ArithmeticError):
        dense.iterated(units, grid, scores, 4, rounds=1)


def test_global_precisions_are_drawn_one_after_the_other(spark):
    from quadrat.operators.statistics import sequential_delta

    tau_m = [(0, 0, 1.5, 4.0), (0, 1, 3.0, 2.0), (0, 2, 3.3, 0.5), (1, 0, 0.7, 1.0)]
    over = spark.createDataFrame([(*x, 1.0) for x in tau_m], "level int, h int, tau double, m double, ad double").repartition(3)
    constants = spark.createDataFrame([(0, 2.0, 3.0), (1, 1.0, 9.0)], "level int, b1 double, b2 double")
    got = {(r.level, r.h): r.v for r in sequential_delta(over, constants, F.col("h") + 2).collect()}
    for level, b in ((0, (2.0, 3.0)), (1, (1.0, 9.0))):
        rows = [x for x in tau_m if x[0] == level]
        delta = [rows[h][2] / (rows[h - 1][2] if h else 1) for h in range(len(rows))]
        for h in range(len(rows)):
            rest = sum(np.prod([delta[k] for k in range(j + 1) if k != h]) * rows[j][3] for j in range(h, len(rows)))
            delta[h] = (h + 2) / (b[h > 0] + rest / 2)
            assert np.isclose(got[level, h], delta[h])
