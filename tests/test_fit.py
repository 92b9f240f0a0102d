import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.kernels.state import Level, Model
from quadrat.plans import fit as plans
from quadrat.sources import csv, draws, model_json
from quadrat.streaming import monitor


def small(seed=0):
    rng = np.random.default_rng(seed)
    X = np.c_[np.ones(20), rng.normal(size=20)]
    return Model(Y=X @ rng.normal(size=(2, 3)) + rng.normal(size=(20, 3)), X=X, Pi=np.arange(20)[:, None] % 5, family=np.array([1, 1, 2]) * 0 + 1, var_free=np.ones(3, bool), levels=[Level(nf_max=2)])


@pytest.fixture(scope="module")
def drawn(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("draws") / "d")
    draws.write(plans.fit(spark, small(), chains=3, samples=4, transient=3, thin=2, seed=9), path)
    return path


def test_every_chain_has_every_draw(spark, drawn):
    d = draws.read(spark, drawn)
    got = d.groupBy("chain").agg(F.countDistinct("draw").alias("n"), F.max("draw").alias("last")).collect()
    assert sorted(tuple(r) for r in got) == [(c, 4, 3) for c in range(3)]
    assert d.filter("param = 'Beta'").count() == 3 * 4 * 6


def test_same_seed_same_draws_whatever_runs(spark, drawn):
    again = plans.fit(spark, small(), chains=3, samples=4, transient=3, thin=2, seed=9, only=[1]).coalesce(1)
    assert draws.read(spark, drawn, chains=[1]).exceptAll(again).isEmpty()
    assert draws.read(spark, drawn, chains=[7]).isEmpty()


def test_json_has_chains_draws_and_indices_from_one(spark, drawn):
    for r in draws.to_json(draws.read(spark, drawn), 1.5).collect():
        d = json.loads(r.json)
        assert sorted(d) == ["0", "1", "2", "3", "time"]
        assert np.array(d["0"]["Beta"]).shape == (2, 3) and d["0"]["rho"] == [[1.0]] and np.array(d["0"]["Lambda"][0]).shape[1] == 3


def test_summaries(spark, drawn):
    d = draws.read(spark, drawn).filter("param = 'sigma'")
    s = {r.i: r for r in plans.summary(d, "i").collect()}
    assert s[0].n == 12 and s[0].q025 <= s[0].median <= s[0].q975
    assert plans.r_hat(d, "i").count() == 3 and plans.effective_size(d, "i").count() == 3


def test_stream_over_draws(spark, drawn):
    q = monitor.progress(spark, drawn).writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("progress").filter("param = 'Beta'").collect()} == {24}


def test_posterior_of_presences_follows_the_data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    X = np.c_[np.ones(200), x]
    Y = (X @ np.array([[0.0, 0.5], [1.5, -1.5]]) + rng.normal(size=(200, 2)) > 0).astype(float)
    m = Model(Y=Y, X=X, Pi=np.arange(200)[:, None] % 4, family=np.array([2, 2]), var_free=np.zeros(2, bool), levels=[Level(nf_max=2)])
    d = plans.fit(spark, m, chains=2, samples=60, transient=40, seed=3)
    s = {(r.i, r.j): r["mean"] for r in plans.summary(d.filter("param = 'Beta'"), "i", "j").collect()}
    assert s[1, 0] > 0.9 and s[1, 1] < -0.9


def file_of(tmp_path, **more):
    rng = np.random.default_rng(0)
    ny, ns = 12, 3
    hm = {
        "YScaled": [[1.0, "NA", None], *rng.normal(size=(ny - 1, ns)).tolist()], "XScaled": np.c_[np.ones(ny), rng.normal(size=ny)].tolist(), "TrScaled": [[1.0]] * ns, "C": [],
        "Pi": [[i % 4 + 1] for i in range(ny)], "distr": [[1, 1], [1, 1], [2, 0]], "ny": [ny], "ns": [ns], "nc": [2], "nt": [1], "nr": [1], "ncsel": [1], "ncRRR": [0], "ncNRRR": [2], "ncORRR": [0],
        "f0": [3], "V0": [[1, 0], [0, 1]], "mGamma": [0, 0], "UGamma": [[1, 0], [0, 1]], "aSigma": [1] * ns, "bSigma": [5] * ns, "XSelect": [{"covGroup": [2], "spGroup": [1, 1, 2], "q": [0.5, 0.5]}],
        "rL": {"site": {"nu": [3], "a1": [50], "b1": [1], "a2": [50], "b2": [1], "nfMin": [2], "nfMax": [3], "sDim": [2], "xDim": [0], "spatialMethod": ["NNGP"], "alphapw": [[0.0, 0.5], [0.5, 0.5]]}},
    }
    state = {"Beta": np.zeros((2, ns)).tolist(), "Gamma": [[0.0], [0.0]], "V": [[2.0, 0.0], [0.0, 2.0]], "sigma": [1.0] * ns, "rho": [1], "Eta": [np.zeros((4, 2)).tolist()], "Lambda": [np.zeros((2, ns)).tolist()], "Psi": [np.ones((2, ns)).tolist()], "Delta": [[[1.0], [1.0]]], "Alpha": [[1, 2]], "BetaSel": [[1, 0]]}
    near = {"indices": [[], [1], [1, 2], [2, 3]], "distList": [[[0]], [[0, 1.0], [1.0, 0]], [[0, 1, 2], [1, 0, 1], [2, 1, 0]], [[0, 1, 2], [1, 0, 1], [2, 1, 0]]]}
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"hM": hm | more, "initParList": [state, state], "dataParList": {"rLPar": [near]}, "nChains": [2]}))
    return str(path)


def test_model_file_as_tables(spark, tmp_path):
    path = file_of(tmp_path)
    t = model_json.tables(spark, path)
    assert t["y"].count() == 36 and t["y"].filter("y is null").count() == 2
    assert {r.unit for r in t["pi"].collect()} == {0, 1, 2, 3}
    assert sorted((r.species, r.family, r.var_free) for r in t["species"].collect()) == [(0, 1, 1), (1, 1, 1), (2, 2, 0)]
    assert model_json.dims(model_json.read_text(spark, path)).first().asDict() == {"ny": 12, "ns": 3, "nc": 2, "nt": 1, "nr": 1, "ncsel": 1, "ncRRR": 0, "ncNRRR": 2, "ncORRR": 0, "nuRRR": None}


def test_command_line_fits_a_file(spark, tmp_path):
    from quadrat.cli import main

    path = file_of(tmp_path)
    m, states = model_json.load(open(path).read())
    assert np.isnan(m.Y[0]).tolist() == [False, True, True] and len(states) == 2 and states[0]["Alpha"][0].tolist() == [0, 1]
    np.testing.assert_allclose(states[0]["iV"], np.eye(2) / 2)
    main([path, str(tmp_path / "out"), "--samples", "2", "--transient", "1", "--seed", "4"])
    assert {(r.chain, r.draw) for r in draws.read(spark, str(tmp_path / "out")).select("chain", "draw").distinct().collect()} == {(c, d) for c in (0, 1) for d in (0, 1)}
    main([path, str(tmp_path / "json"), "--samples", "1", "--format", "json", "--no-eta", "--chains", "1"])
    one = json.loads(spark.read.text(str(tmp_path / "json")).first()["value"])
    assert "Eta" not in one["0"] and "time" in one


def test_the_time_in_a_result_is_that_of_the_fit(spark, tmp_path, monkeypatch):
    from quadrat import cli
    from quadrat.plans import fit as plans

    real = plans.fit

    def slow(*a, **k):
        def wait(batches):
            import time

            time.sleep(2)
            yield from batches

        return real(*a, **k).mapInArrow(wait, draws.SCHEMA)

    monkeypatch.setattr(plans, "fit", slow)
    cli.main([file_of(tmp_path), str(tmp_path / "json"), "--samples", "1", "--format", "json", "--chains", "0", "--verbose", "1"])
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()["value"])["time"] >= 2


def test_serialised_texts(spark, tmp_path):
    from quadrat.cli import main
    from quadrat.sources import rds

    path = file_of(tmp_path)
    text = open(path).read()
    for x in ("", "a", "\u00e4\u4e16 \U0001f600", text):
        assert rds.text_of(rds.of_text(x)) == x
    # list("x"), with a names attribute, of version 3, not compressed
    name = b"\x00\x04\x00\x09\x00\x00\x00\x01n"
    raw = b"X\n" + bytes.fromhex("00000003 00040300 00030500 00000005") + b"UTF-8" + bytes.fromhex("00000213 00000001 00000010 00000001 00040009 00000001") + b"x"
    raw += bytes.fromhex("00000402 00000001 00040009 00000005") + b"names" + bytes.fromhex("00000010 00000001") + name + bytes.fromhex("000000fe")
    assert rds.text_of(raw) == "x"
    for bad in (b"", b"RDX3\n", b"X\n\x00\x00\x00\x09" + bytes(8)):
        with pytest.raises(ValueError):
            rds.text_of(bad)
    (tmp_path / "model.rds").write_bytes(rds.of_text(text))
    main([str(tmp_path / "model.rds"), str(tmp_path / "out"), "--samples", "1", "--format", "rds", "--chains", "1", "--fp", "32"])
    one = json.loads(rds.text_of((tmp_path / "out" / "chain=1.rds").read_bytes()))
    assert np.array(one["0"]["Beta"]).shape == (2, 3) and one["time"] > 0


def test_bad_files_are_refused(tmp_path):
    for key in ("YScaled", "distr"):
        with pytest.raises(ValueError):
            model_json.load(open(file_of(tmp_path, **{key: None})).read())


def test_csv(spark, tmp_path):
    (tmp_path / "y.csv").write_text("site,a,b\ns1,1,NA\ns2,0.5,2\n")
    got = csv.read_wide(spark, str(tmp_path / "y.csv"), "site", "species", "y").collect()
    assert sorted((r.site, r.species, r.y) for r in got if r.y is not None) == [("s1", "a", 1.0), ("s2", "a", 0.5), ("s2", "b", 2.0)] and len(got) == 4


def test_a_chain_leaves_its_first_state_as_it_is(tmp_path):
    from copy import deepcopy

    from quadrat.kernels.chain import run

    m, states = model_json.load(open(file_of(tmp_path)).read())
    before = deepcopy(states[0])
    one, two = ([p["Beta"].copy() for _, p in run(m, 0, 2, seed=1, first=states[0])] for _ in range(2))
    np.testing.assert_array_equal(one, two)
    for key in ("Eta", "Lambda", "Alpha", "BetaSel"):
        np.testing.assert_array_equal(states[0][key][0], before[key][0])


def test_profile_counts_every_update(spark, tmp_path):
    from quadrat.cli import main
    from quadrat.plans.durable import fit_durably

    size = dict(chains=2, samples=2, transient=1, seed=9)
    drawn = plans.fit(spark, small(), profile=True, hmc_every=3, leaps=2, **size)
    told = {(r.chain, r.name): (r.calls, r.seconds) for r in draws.profile(drawn).collect()}
    assert told[0, "update_z"][0] == 3 and told[1, "update_nf"][0] == 1 and told[0, "move"][0] == 1 and told[0, "update_lambda_priors"][0] == 4 and min(t for _, t in told.values()) > 0
    kept = fit_durably(spark, small(), str(tmp_path / "chains"), every=2, profile=True, **size)
    assert {r.calls for r in draws.profile(kept).filter("name = 'update_z'").collect()} == {3}
    assert drawn.filter("draw >= 0").exceptAll(plans.fit(spark, small(), hmc_every=3, leaps=2, **size)).isEmpty()
    main([file_of(tmp_path), str(tmp_path / "out"), "--samples", "1", "--profile"])
    assert spark.read.parquet(str(tmp_path / "out.profile")).filter("name = 'update_sigma'").count() == 2
    assert draws.read(spark, str(tmp_path / "out")).filter("draw < 0 or param like 'time%'").isEmpty()


def test_what_goes_to_all_tasks_has_a_bound(spark, monkeypatch):
    from quadrat.functions import tensor
    from quadrat.operators import design

    x = spark.createDataFrame([(s, c, float(s + c)) for s in range(6) for c in range(2)], "site long, cov int, x double")
    beta = spark.createDataFrame([(c, j, float(c - j)) for c in range(2) for j in range(3)], "cov int, species int, v double")
    one, other = (sorted(map(tuple, design.fixed_part(x, beta, wide).collect())) for wide in (True, False))
    assert one == other and len(one) == 18
    lists = [sorted((r.site, r.cov, r["_e"].species) for r in tensor.with_lists(x, beta, "cov", ["species", "v"], salts).collect()) for salts in (0, 4)]
    assert lists[0] == lists[1] and len(lists[0]) == 36
    monkeypatch.setattr(tensor, "MOST", 5)
    for df, other in ((design.fixed_part(x, beta), "wide=False"), (tensor.with_lists(x, beta, "cov", ["species"]), "salts")):
        with pytest.raises(Exception, match=f"too many parameters.*{other}"):
            df.collect()
    monkeypatch.setattr(plans, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="arrays take"):
        plans.fit(spark, small())
