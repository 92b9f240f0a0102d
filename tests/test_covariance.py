import numpy as np
import pytest

from quadrat.operators import covariance, eigen, solve


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")


def whole(values, vectors):
    e = {r.j: r.e for r in values.collect()}
    v = vectors.toPandas().pivot(index="i", columns="j", values="v").sort_index().to_numpy()
    return v, np.array([e[j] for j in sorted(e)])


@pytest.mark.parametrize(("n", "block"), [(7, None), (11, 3), (9, 4)])
def test_eigenvectors_by_blocks(spark, n, block):
    rng = np.random.default_rng(n)
    # two equal eigenvalues, one that is tiny and two that are 0
    values = np.r_[3.0, 3.0, 1e-7, 0.0, 0.0, rng.random(n)][:n]
    base = np.linalg.qr(rng.normal(size=(n, n)))[0]
    m = (base * values) @ base.T
    v, e = whole(*eigen.decompose(cells(spark, m), block))
    np.testing.assert_allclose(np.sort(e), np.sort(values), atol=1e-12)
    np.testing.assert_allclose(v.T @ v, np.eye(n), atol=1e-12)
    np.testing.assert_allclose((v * e) @ v.T, m, atol=1e-12)


def test_matrices_without_such_a_base_are_refused(spark):
    with pytest.raises(ValueError, match="symmetric"):
        eigen.decompose(cells(spark, np.array([[1.0, 0.2], [0.0, 1.0]])))
    with pytest.raises(Exception, match="negative"):
        eigen.decompose(cells(spark, np.array([[0.0, 1.0], [1.0, 0.0]])))[0].collect()
    assert not eigen.decompose(cells(spark, np.zeros((0, 0))))[1].count()
    v, e = whole(*eigen.decompose(cells(spark, np.zeros((3, 3))), 2))
    np.testing.assert_allclose(v.T @ v, np.eye(3), atol=1e-12)
    np.testing.assert_array_equal(e, 0.0)


@pytest.mark.parametrize("phylogeny", [False, True])
def test_effects_equal_those_of_the_kronecker_product(spark, phylogeny):
    rng = np.random.default_rng(5)
    ns, nc, nt = 9, 3, 2
    t, beta, iv = rng.normal(size=(ns, nt)), rng.normal(size=(nc, ns)), np.eye(nc) + 0.3
    similar = np.exp(-np.abs(np.subtract.outer(range(ns), range(ns))) / 2)
    named = lambda x, names, kind: spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(x)], f"{names[0]} int, {names[1]} int, {kind} double")
    scales, q_inverse, t2, b2 = None, np.broadcast_to(np.eye(ns), (nc, nc, ns, ns)), t, beta
    if phylogeny:
        values, vectors = eigen.decompose(cells(spark, similar), 4)
        rho = np.array([0.0, 0.4, 0.9])
        v, e = whole(values, vectors)
        q = (rho[:, None] * e + 1 - rho[:, None]) ** -0.5
        q_inverse = np.einsum("ij,cj,kj,lj->ckil", v, q, q, v)
        scales = covariance.phylogenetic_scales(values, spark.createDataFrame([(c, float(x)) for c, x in enumerate(rho)], "cov int, rho double"))
        t2, b2 = v.T @ t, beta @ v
    got = covariance.effect_cells(named(b2, ("cov", "species"), "v"), named(t2, ("species", "trait"), "t"), named(iv, ("c1", "c2"), "v"), nc, scales)
    prior = spark.createDataFrame([(0, a, a, 0.3) for a in range(nc * nt)], "model int, a int, b int, v double")
    row = solve.posterior(covariance.one_system(got, nc * nt), "model", prior, 1, 1, 1).first()
    p = np.einsum("it,ckij,js,ck->tcsk", t, q_inverse, t, iv).reshape(nc * nt, -1) + 0.3 * np.eye(nc * nt)
    right = np.einsum("it,ckij,kj,ck->tc", t, q_inverse, beta, iv).reshape(-1)
    np.testing.assert_allclose(row.mean, np.linalg.solve(p, right), rtol=1e-9)


def test_wishart_has_its_mean_and_any_partitions_draw_the_same(spark):
    scale = np.array([[2.0, 0.5, 0.0], [0.5, 1.0, 0.2], [0.0, 0.2, 3.0]])
    table = cells(spark, scale).withColumnsRenamed({"i": "c1", "j": "c2"})
    draw = lambda t, df, k: t if t is None else covariance.wishart(t, df, 3, 4, 0, k).toPandas().pivot(index="c1", columns="c2", values="v").to_numpy()
    many = np.mean([draw(table, 4000, k) for k in range(4)], axis=0) / 4000
    np.testing.assert_allclose(many, np.linalg.inv(scale), atol=0.06)
    np.testing.assert_allclose(draw(table, 10, 1), draw(table.repartition(5), 10, 1), rtol=1e-12)
    chi = np.array([[r.v for r in covariance.chi_squares(spark, 200001, 3, 9, c, 0).orderBy("i").collect()] for c in range(3)])
    np.testing.assert_allclose(chi, [[200001, 200000, 199999]] * 3, rtol=0.015)
    with pytest.raises(ValueError, match="degrees"):
        covariance.chi_squares(spark, 2, 3, 1, 1, 1)
    with pytest.raises(ValueError, match="more than"):
        covariance.one_system(table, covariance.LARGEST + 1)
