import pytest

import __spark_entry__ as entry
from against_sql import same
from quadrat.plans.oracles import ORACLES
from quadrat.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, tables, name):
    assert same(spark, tables, QUERIES[name], ORACLES[name])


def test_entry_has_rows_and_a_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["species", "shape", "rate"]
    assert df.count() == 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_have_rows(spark, tables):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, tables).count()


def test_knot_inverse_is_an_inverse(spark, tables):
    import numpy as np

    w = QUERIES["gpp_knot_covariance"](spark, tables).toPandas().pivot(index=["g", "i"], columns="j", values="w").sort_index()
    inv = QUERIES["gpp_knot_inverse"](spark, tables).toPandas().pivot(index=["g", "i"], columns="j", values="w").sort_index()
    for g in (0, 1, 2):
        np.testing.assert_allclose(w.loc[g].to_numpy() @ inv.loc[g].to_numpy(), np.eye(10), atol=1e-2)


def test_neighbour_weights_with_all_predecessors_give_the_full_inverse(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from quadrat.operators import spatial

    rng = np.random.default_rng(3)
    xy = rng.random((8, 2))
    units = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)], "i long, p array<double>")
    grid = spark.createDataFrame([(0, 0.5)], "g int, alpha double")
    r = spatial.neighbour_weights(units, spatial.preceding_neighbours(units, 8), grid).toPandas().pivot(index="i", columns="j", values="v").fillna(0).to_numpy()
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.testing.assert_allclose(r.T @ r, np.linalg.inv(np.exp(-d / 0.5)), rtol=1e-8)
    assert spatial.correlations(units, units.withColumnRenamed("i", "j"), grid).filter(F.col("i") == F.col("j")).agg(F.min("w")).first()[0] == 1.0


def test_neighbours_equal_those_of_all_pairs(spark):
    import numpy as np

    from quadrat.operators import spatial

    rng = np.random.default_rng(8)
    clusters = np.r_[rng.normal(size=(150, 2)) * 0.01, rng.normal(size=(60, 2)), np.tile([[0.5, 0.5]], (40, 1)), [[50.0, -3.0]]]
    for xy in (clusters[rng.permutation(len(clusters))], rng.random((90, 1)), np.zeros((7, 2)), rng.random((1, 2)), rng.random((60, 3))):
        units = spark.createDataFrame([(3 * i, [float(x) for x in p]) for i, p in enumerate(xy)], "i long, p array<double>")
        got = sorted((r.i, r.rank, r.j) for r in spatial.preceding_neighbours(units, 4).collect())
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        want = [(3 * i, r + 1, 3 * int(j)) for i in range(len(xy)) for r, j in enumerate(np.lexsort((np.arange(i), d[i, :i]))[:4])]
        assert got == sorted(want)
    assert spatial.preceding_neighbours(units.limit(0), 4).isEmpty()
    with pytest.raises(ValueError, match="at most 3"):
        spatial.preceding_neighbours(spark.createDataFrame([(0, [0.0] * 4)], "i long, p array<double>"), 4)
    assert "NestedLoop" not in spatial.preceding_neighbours(units, 4)._jdf.queryExecution().toString()


def test_levels_go_deeper_where_one_unit_lies_far_away(spark, monkeypatch):
    import numpy as np

    from quadrat.operators import spatial

    monkeypatch.setattr(spatial, "CROWD", 3)
    depths, depth = [], spatial._depth
    monkeypatch.setattr(spatial, "_depth", lambda *a: depths.append(depth(*a)) or depths[-1])
    rng = np.random.default_rng(6)
    xy = np.r_[rng.random((120, 2)), [[1e5, 1e5]]]
    for places in (xy[:120], xy):
        units = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(places)], "i long, p array<double>")
        got = sorted((r.i, r.rank, r.j) for r in spatial.preceding_neighbours(units, 3).collect())
        d = np.sqrt(((places[:, None] - places[None]) ** 2).sum(-1))
        assert got == sorted((i, r + 1, int(j)) for i in range(len(places)) for r, j in enumerate(np.lexsort((np.arange(i), d[i, :i]))[:3]))
    assert depths[0] < 10 <= 17 <= depths[1] < spatial.LAST_LEVEL


def test_effective_size_by_all_lags(spark):
    import numpy as np

    from quadrat.plans.fit import sequence_effective_size

    rng = np.random.default_rng(4)
    noise = rng.normal(size=(2, 300))
    slow = np.zeros_like(noise)
    for t in range(1, 300):
        slow[:, t] = 0.8 * slow[:, t - 1] + noise[:, t]
    values = {"noise": noise, "slow": slow, "still": np.ones((2, 5)), "one": np.ones((1, 1))}
    rows = [(p, c, t, float(v)) for p, x in values.items() for c, chain in enumerate(x) for t, v in enumerate(chain)]
    got = {r.param: (r.n, r.ess) for r in sequence_effective_size(spark.createDataFrame(rows, "param string, chain int, draw int, v double").repartition(3), "param").collect()}
    for p in ("noise", "slow"):
        e = values[p] - values[p].mean(1, keepdims=True)
        rho = np.array([(e[:, : 300 - t] * e[:, t:]).sum() for t in range(300)]) / (e * e).sum()
        pairs = rho.reshape(-1, 2).sum(1)
        stop = np.flatnonzero(pairs <= 0)[0]
        np.testing.assert_allclose(got[p], (600, 600 / (2 * pairs[:stop].sum() - 1)))
    assert got["slow"][1] < 200 < got["noise"][1]
    assert got["still"] == (10, 10.0) and got["one"] == (1, 1.0)
