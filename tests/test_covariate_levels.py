"""Levels whose loadings depend on covariates of the unit: draws, files, Hamiltonian moves."""

import json

import numpy as np
import pytest

from quadrat.kernels import chain, hmc
from quadrat.kernels import updates as u
from quadrat.kernels.random import Noise
from quadrat.kernels.state import Level, Model, as_rows, features, from_rows, predictor, random_part, start
from quadrat.plans import fit as plans
from quadrat.plans.durable import fit_durably
from quadrat.sources import draws, model_json
from test_fit import file_of


def quiet():
    return Noise(0, 0, 0, 0, quiet=True)


def loud(seed=0):
    return Noise(seed, 0, 0, 1)


def model(ny=40, ns=5, units=8, covs=2, seed=0, families=(1, 2), missing=True, **more):
    rng = np.random.default_rng(seed)
    X = np.c_[np.ones(ny), rng.normal(size=ny)]
    family = np.resize(families, ns)
    Y = rng.normal(size=(ny, ns))
    Y = np.where(family == 2, Y > 0, Y).astype(float)
    if missing:
        Y[rng.random(Y.shape) < 0.1] = np.nan
    x = np.c_[np.ones(units), rng.normal(size=(units, covs - 1))]
    m = Model(Y=Y, X=X, Pi=np.c_[np.arange(ny) % units, np.arange(ny) % 4], family=family, var_free=family == 1, levels=[Level(nf_min=2, nf_max=4, x=x), Level(nf_max=3)], **more)
    p = start(m, loud(seed))
    p["Psi"][0] = 0.5 + rng.random(p["Psi"][0].shape)
    p["Delta"][0] = 1 + rng.random(p["Delta"][0].shape)
    u.update_z(m, p, loud(seed))
    return m, p


def test_predictor_is_the_sum_over_factors_and_covariates():
    m, p = model()
    assert p["Lambda"][0].shape == (2, 5, 2) and p["Delta"][0].shape == (2, 2)
    want = np.einsum("uh,uk,hjk->uj", p["Eta"][0], m.levels[0].x, p["Lambda"][0])[m.Pi[:, 0]]
    np.testing.assert_allclose(random_part(m, p, 0), want)
    np.testing.assert_array_equal(from_rows(m.levels[0], as_rows(p["Lambda"][0])), p["Lambda"][0])


def test_a_covariate_of_ones_is_no_covariate():
    m, p = model(covs=1)
    plain = Model(Y=m.Y, X=m.X, Pi=m.Pi, family=m.family, var_free=m.var_free, levels=[Level(nf_min=2, nf_max=4), Level(nf_max=3)])
    q = p | {k: [v[..., 0] if r == 0 else v for r, v in enumerate(p[k])] for k in ("Lambda", "Psi", "Delta")} | {"Eta": list(p["Eta"]), "Alpha": list(p["Alpha"])}
    for update in (u.update_beta_lambda, u.update_eta, u.update_beta_eta, u.update_lambda_priors, u.update_sigma):
        update(m, p, loud(3))
        update(plain, q, loud(3))
    for k in ("Beta", "sigma"):
        np.testing.assert_allclose(p[k], q[k], atol=1e-9)
    np.testing.assert_allclose(p["Lambda"][0][..., 0], q["Lambda"][0], atol=1e-9)
    np.testing.assert_allclose(p["Delta"][0][..., 0], q["Delta"][0], atol=1e-9)
    np.testing.assert_allclose(p["Eta"][0], q["Eta"][0], atol=1e-9)


def test_loadings_and_scores_mean_are_the_dense_solutions():
    m, p = model()
    f = np.concatenate([features(level, e)[m.Pi[:, r]] for r, (level, e) in enumerate(zip(m.levels, p["Eta"], strict=True))], 1)
    own = p["Psi"][0] * np.cumprod(p["Delta"][0], 0)[:, None]
    q = p | {k: list(p[k]) for k in ("Eta", "Lambda")}
    u.update_beta_lambda(m, q, quiet())
    for j in range(5):
        xe = np.c_[m.X, f]
        load = np.r_[[own[h, j, k] for h in range(2) for k in range(2)], (p["Psi"][1] * np.cumprod(p["Delta"][1])[:, None])[:, j]]
        prior = np.zeros((len(load) + 2,) * 2)
        prior[:2, :2], prior[range(2, len(prior)), range(2, len(prior))] = p["iV"], load
        right = xe.T @ (p["iD"][:, j] * p["Z"][:, j])
        right[:2] += p["iV"] @ (p["Gamma"] @ m.T[j])
        want = np.linalg.solve(xe.T @ (p["iD"][:, j, None] * xe) + prior, right)
        np.testing.assert_allclose(q["Beta"][:, j], want[:2], atol=1e-9)
        np.testing.assert_allclose(q["Lambda"][0][:, j].reshape(-1), want[2:6], atol=1e-9)
    rest = p["Z"] - predictor(m, p, without=0)
    u.update_eta(m, p, quiet())
    for unit in range(8):
        at = m.Pi[:, 0] == unit
        lam = np.einsum("k,hjk->hj", m.levels[0].x[unit], p["Lambda"][0])
        want = np.linalg.solve(np.eye(2) + (lam * p["iD"][at].sum(0)) @ lam.T, lam @ (p["iD"] * rest)[at].sum(0))
        np.testing.assert_allclose(p["Eta"][0][unit], want, atol=1e-9)


def test_coefficients_and_scores_together_solve_their_system():
    m, p = model()
    u.update_beta_eta(m, p, quiet())
    r = 1  # the level drawn last: the coefficients are those drawn with it
    rest = p["iD"] * (p["Z"] - predictor(m, p))
    np.testing.assert_allclose(m.X.T @ rest - p["iV"] @ (p["Beta"] - p["Gamma"] @ m.T.T), 0, atol=1e-7)
    m.levels, m.Pi = m.levels[:1], m.Pi[:, :1]
    p |= {k: p[k][:1] for k in ("Eta", "Lambda", "Psi", "Delta", "Alpha")}
    u.update_beta_eta(m, p, quiet())
    g = p["iD"] * (p["Z"] - predictor(m, p))
    x, lam = m.levels[0].x, p["Lambda"][0]
    of_scores = np.stack([np.einsum("k,hjk,j->h", x[n], lam, g[m.Pi[:, 0] == n].sum(0)) for n in range(8)])
    np.testing.assert_allclose(of_scores, p["Eta"][0], atol=1e-7)
    assert r == 1


def test_factor_number_changes_all_axes_at_once():
    m, p = model()
    p["Lambda"][0][1] = 0
    for level in m.levels:
        level.nf_min = 1
    for it in range(30, 90):
        p["Lambda"][0][-1] *= it % 2
        u.update_nf(m, p, loud(it), it)
        n = p["Eta"][0].shape[1]
        assert p["Lambda"][0].shape == p["Psi"][0].shape == (n, 5, 2) and p["Delta"][0].shape == (n, 2) and len(p["Alpha"][0]) == n
        assert random_part(m, p, 0).shape == (40, 5)


def test_gradient_is_that_of_finite_differences():
    m, p = model(families=(1, 2))
    _, grad = hmc.log_density(m, p)
    for key in ("Eta", "Lambda"):
        for at in [(0, 0), (1, 1)]:
            for k in range(2) if key == "Lambda" else [None]:
                where = at if k is None else (*at, k)
                values = []
                for e in (1e-5, -1e-5):
                    moved = p[key][0].copy()
                    moved[where] += e
                    values.append(hmc.log_density(m, p | {key: [moved, p[key][1]]})[0])
                assert abs((values[0] - values[1]) / 2e-5 - grad[key][0][where]) < 1e-4


def test_a_chain_finds_loadings_that_depend_on_a_covariate():
    rng = np.random.default_rng(5)
    units, each, ns = 60, 6, 8
    x = np.c_[np.ones(units), rng.choice([-1.0, 1.0], units)]
    eta, lam = rng.normal(size=units), rng.normal(size=(ns, 2))
    pi = np.repeat(np.arange(units), each)[:, None]
    signal = (eta[:, None] * (x @ lam.T))[pi[:, 0]]
    m = Model(Y=signal + 0.3 * rng.normal(size=signal.shape), X=np.ones((len(pi), 1)), Pi=pi, family=np.ones(ns, int), var_free=np.ones(ns, bool), levels=[Level(nf_min=1, nf_max=2, x=x)])
    found = np.mean([random_part(m, p, 0) for _, p in chain.run(m, 0, 30, 60, seed=2)], 0)
    assert np.corrcoef(found.ravel(), signal.ravel())[0, 1] > 0.97
    with pytest.raises(ValueError, match="row for each"):
        Model(Y=m.Y, X=m.X, Pi=pi, family=m.family, var_free=m.var_free, levels=[Level(x=x[:-1])])


def covariate_file(tmp_path):
    path = file_of(tmp_path)
    obj = json.loads(open(path).read())
    level = obj["hM"]["rL"]["site"]
    level |= {"sDim": [0], "xDim": [2], "xMat": [[1.0, 0.5], [1.0, -1.0], [1.0, 2.0], [1.0, 0.0]]}
    numbers = np.arange(12.0)
    for s in obj["initParList"]:
        s |= {"Lambda": [numbers.tolist()], "Psi": [(1 + numbers).reshape(2, 3, 2).tolist()], "Delta": [[[1.0, 2.0], [3.0, 4.0]]]}
    open(path, "w").write(json.dumps(obj))
    return path


def test_file_to_draws_to_files(spark, tmp_path):
    from quadrat.cli import main

    path = covariate_file(tmp_path)
    m, states = model_json.load(open(path).read())
    assert m.levels[0].x.tolist() == [[1, 0.5], [1, -1], [1, 2], [1, 0]]
    lam = states[0]["Lambda"][0]  # factors first, then species, then covariates
    assert lam.shape == (2, 3, 2) and [lam[h, j, k] for h, j, k in ((1, 0, 0), (0, 1, 0), (0, 0, 1))] == [1, 2, 6]
    assert states[0]["Psi"][0][0, 0, 1] == 7 and states[0]["Delta"][0].tolist() == [[1, 2], [3, 4]]
    size = dict(chains=2, samples=3, transient=2, seed=1)
    whole = plans.fit(spark, m, states=states, **size)
    durable = fit_durably(spark, m, str(tmp_path / "chains"), every=2, states=states, **size)
    assert whole.count() == durable.count() and whole.exceptAll(durable).isEmpty()
    main([path, str(tmp_path / "out"), "--samples", "3", "--transient", "2", "--seed", "1"])
    kept = draws.read(spark, str(tmp_path / "out"))
    assert kept.exceptAll(whole).isEmpty()
    assert {r.param for r in kept.filter("k is not null").select("param").distinct().collect()} == {"Lambda", "Psi"}
    text = draws.to_json(kept)
    one = json.loads(text.first()["json"])["0"]
    assert np.array(one["Lambda"][0]).shape[1:] == (3, 2) and np.array(one["Delta"][0]).shape[1:] == (2,)
    back = draws.from_json(text, by_covariate=True)
    assert back.count() == kept.filter("k is not null").count() and back.exceptAll(kept.filter("k is not null")).isEmpty()
    plain = kept.filter("k is null and level >= 0 and param = 'Delta'").drop("k")
    assert draws.from_json(text, True).filter("param = 'Delta'").exceptAll(plain).isEmpty()


def test_wrong_covariates_are_refused(tmp_path):
    path = covariate_file(tmp_path)
    text = open(path).read()
    with pytest.raises(ValueError, match="column for each"):
        model_json.load(text.replace('"xDim": [2]', '"xDim": [3]'))
