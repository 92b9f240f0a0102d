import numpy as np
import pytest

from quadrat.kernels import chain, hmc, spatial
from quadrat.kernels import updates as u
from quadrat.kernels.random import Noise, log_cdf
from quadrat.kernels.state import Level, Model, effective, predictor, start


def quiet():
    return Noise(0, 0, 0, 0, quiet=True)


def loud(seed=0):
    return Noise(seed, 0, 0, 1)


def model(ny=40, ns=6, nc=3, seed=0, families=(1, 2, 3), phylo=False, method="none", missing=True, three=False, **more):
    rng = np.random.default_rng(seed)
    X = np.c_[np.ones(ny), rng.normal(size=(ny, nc - 1))]
    family = np.resize(families, ns)
    Y = rng.normal(size=(ny, ns))
    Y = np.where(family == 2, Y > 0, np.where(family == 3, rng.poisson(3, (ny, ns)), Y)).astype(float)
    if missing:
        Y[rng.random(Y.shape) < 0.1] = np.nan
    units = 9
    Pi = np.c_[np.arange(ny) % units, rng.integers(0, 4, ny)]
    Pi[:4, 1] = range(4)
    C = None
    if phylo:
        a = rng.normal(size=(ns, ns + 3))
        c = a @ a.T
        C = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    level = Level(nf_max=4)
    if method != "none":
        xy = rng.random((units, 2))
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
        level.method, level.alpha = method, np.array([[0.0, 0.4], [0.2, 0.3], [0.6, 0.3]])
        a = level.alpha[:, 0]
        if method == "full":
            level.grid = spatial.full(d, a)
        elif method == "gpp":
            k = rng.random((4, 2))
            level.grid = spatial.gpp(np.sqrt(((xy[:, None] - k[None]) ** 2).sum(-1)), np.sqrt(((k[:, None] - k[None]) ** 2).sum(-1)), a)
        else:
            level.grid = spatial.nngp(*spatial.nearest(xy, 3), a)
    if three:
        X = np.stack([X * (1 + 0.1 * j) for j in range(ns)])
    m = Model(Y=Y, X=X, Pi=Pi, family=family, var_free=family == 1, T=np.c_[np.ones(ns), rng.normal(size=ns)], C=C, levels=[level, Level(nf_max=3)], **more)
    p = start(m, loud(seed))
    if method != "none":
        p["Alpha"][0] = np.array([1, 2])
    p["sigma"] = 0.5 + rng.random(ns)
    u.update_z(m, p, loud(seed))
    return m, p


def joint_precision(m, p):
    """Prior of Beta and its mean, by Kronecker products."""
    mean = (p["Gamma"] @ m.T.T).T.reshape(-1)  # species-major
    if m.C is None:
        return np.kron(np.eye(m.Y.shape[1]), p["iV"]), mean
    rho = m.rho_grid[p["rho"][0], 0]
    q = rho * m.C + (1 - rho) * np.eye(len(m.C))
    return np.kron(np.linalg.inv(q), p["iV"]), mean


@pytest.mark.parametrize("phylo", [False, True])
@pytest.mark.parametrize("three", [False, True])
def test_beta_lambda_mean_is_the_dense_solution(phylo, three):
    m, p = model(phylo=phylo, three=three)
    p["Gamma"] += 0.3
    if phylo:
        p["rho"][:] = 60
    nc, ns = m.nc, m.Y.shape[1]
    etas = np.concatenate([e[m.Pi[:, r]] for r, e in enumerate(p["Eta"])], 1)
    na = nc + etas.shape[1]
    prior, mean = joint_precision(m, p)
    big, right = np.zeros((ns, na, ns, na)), np.zeros((ns, na))
    big[:, :nc, :, :nc] = prior.reshape(ns, nc, ns, nc)
    right[:, :nc] = (prior @ mean).reshape(ns, nc)
    load = np.concatenate([psi * np.cumprod(d)[:, None] for psi, d in zip(p["Psi"], p["Delta"], strict=True)])
    for j in range(ns):
        xe = np.c_[m.X if m.X.ndim == 2 else m.X[j], etas]
        big[j, :, j, :] += xe.T @ (p["iD"][:, j, None] * xe)
        big[j, np.arange(nc, na), j, np.arange(nc, na)] += load[:, j]
        right[j] += xe.T @ (p["iD"][:, j] * p["Z"][:, j])
    want = np.linalg.solve(big.reshape(ns * na, -1), right.reshape(-1)).reshape(ns, na)
    u.update_beta_lambda(m, p, quiet())
    np.testing.assert_allclose(p["Beta"], want[:, :nc].T, atol=1e-8)
    np.testing.assert_allclose(np.concatenate(p["Lambda"]), want[:, nc:].T, atol=1e-8)


@pytest.mark.parametrize("method", ["none", "full", "gpp", "nngp"])
def test_eta_mean_is_the_dense_solution(method):
    m, p = model(method=method)
    mu, data = u.eta_statistics(m, p, 0)
    n, nf = mu.shape
    big = np.zeros((n, nf, n, nf))
    for h in range(nf):
        big[:, h, :, h] = np.eye(n) if method == "none" else spatial.precision(m.levels[0], p["Alpha"][0][h])
    big[np.arange(n), :, np.arange(n), :] += data
    want = np.linalg.solve(big.reshape(n * nf, -1), mu.reshape(-1)).reshape(n, nf)
    u.update_eta(m, p, quiet())
    np.testing.assert_allclose(p["Eta"][0], want, atol=1e-7)


def test_eta_draws_have_the_posterior_covariance_with_knots():
    m, p = model(method="gpp")
    level, alpha = m.levels[0], p["Alpha"][0]
    mu, data = u.eta_statistics(m, p, 0)
    n, nf = mu.shape
    big = np.zeros((n, nf, n, nf))
    for h in range(nf):
        big[:, h, :, h] = spatial.precision(level, alpha[h])
    big[np.arange(n), :, np.arange(n), :] += data
    cov = np.linalg.inv(big.reshape(n * nf, -1))
    draws = np.array([u._eta_gpp(level, alpha, mu, data, loud(s)).reshape(-1) for s in range(6000)])
    np.testing.assert_allclose(np.cov(draws.T), cov, atol=0.12 * np.abs(cov).max() + 0.03)


@pytest.mark.parametrize("method", ["full", "nngp"])
def test_spatial_scores_have_the_posterior_covariance(method):
    m, p = model(method=method)
    level, alpha = m.levels[0], p["Alpha"][0]
    mu, data = u.eta_statistics(m, p, 0)
    n, nf = mu.shape
    big = np.zeros((n, nf, n, nf))
    for h in range(nf):
        big[:, h, :, h] = spatial.precision(level, alpha[h])
    big[np.arange(n), :, np.arange(n), :] += data
    cov = np.linalg.inv(big.reshape(n * nf, -1))
    draws = np.array([u._eta_spatial(level, alpha, mu, data, loud(s)).reshape(-1) for s in range(3000)])
    np.testing.assert_allclose(np.cov(draws.T), cov, atol=0.15 * np.abs(cov).max() + 0.03)


@pytest.mark.parametrize("method", ["full", "gpp", "nngp"])
def test_precision_noise_has_the_precision_as_covariance(method):
    m, _ = model(method=method)
    want = spatial.precision(m.levels[0], 1)
    np.testing.assert_allclose(spatial.diagonal(m.levels[0], 1), np.diag(want))
    draws = np.array([spatial.precision_noise(m.levels[0], 1, loud(s)) for s in range(6000)])
    np.testing.assert_allclose(np.cov(draws.T), want, atol=0.12 * np.abs(want).max())


def test_coefficients_with_phylogeny_have_the_posterior_covariance():
    m, p = model(phylo=True, ns=3, ny=12)
    p["rho"][:] = 60
    nc, ns = m.nc, 3
    prior, _ = joint_precision(m, p)
    etas = np.concatenate([e[m.Pi[:, r]] for r, e in enumerate(p["Eta"])], 1)
    na = nc + etas.shape[1]
    big = np.zeros((ns, na, ns, na))
    big[:, :nc, :, :nc] = prior.reshape(ns, nc, ns, nc)
    load = np.concatenate([psi * np.cumprod(d)[:, None] for psi, d in zip(p["Psi"], p["Delta"], strict=True)])
    xe = np.c_[m.X, etas]
    for j in range(ns):
        big[j, :, j, :] += xe.T @ (p["iD"][:, j, None] * xe)
        big[j, np.arange(nc, na), j, np.arange(nc, na)] += load[:, j]
    cov = np.linalg.inv(big.reshape(ns * na, -1)).reshape(ns, na, ns, na)[:, :nc, :, :nc].reshape(ns * nc, -1)
    draws = []
    for s in range(3000):
        q = p | {"Lambda": list(p["Lambda"])}
        u.update_beta_lambda(m, q, loud(s))
        draws.append(q["Beta"].T.reshape(-1))
    np.testing.assert_allclose(np.cov(np.array(draws).T), cov, atol=0.15 * np.abs(cov).max() + 0.02)


def test_many_units_with_neighbours_and_many_species_with_phylogeny():
    rng = np.random.default_rng(3)
    n, ns = 6000, 300
    near = [np.arange(max(0, i - 4), i) for i in range(n)]
    place = np.arange(n) * 0.01
    dist = [np.abs(np.subtract.outer(place[np.r_[a, i]], place[np.r_[a, i]])) for i, a in enumerate(near)]
    level = Level(method="nngp", alpha=np.array([[0.0, 0.5], [0.3, 0.5]]), nf_max=2)
    level.grid = spatial.nngp(near, dist, level.alpha[:, 0])
    m = Model(Y=rng.normal(size=(n, 4)), X=np.ones((n, 1)), Pi=np.arange(n)[:, None], family=np.ones(4, int), var_free=np.ones(4, bool), levels=[level])
    p = start(m, loud())
    p["Alpha"][0][:] = 1
    u.update_z(m, p, loud())
    u.update_eta(m, p, quiet())
    mu, data = u.eta_statistics(m, p, 0)
    left = np.einsum("uhk,uk->uh", data, p["Eta"][0]) + spatial.times(level, 1, p["Eta"][0]) - mu
    assert np.abs(left).max() < 1e-6 * np.abs(mu).max()
    a = rng.normal(size=(ns, 40))
    c = a @ a.T + np.eye(ns)
    c /= np.sqrt(np.outer(np.diag(c), np.diag(c)))
    m = Model(Y=rng.normal(size=(50, ns)), X=np.c_[np.ones(50), rng.normal(size=(50, 2))], Pi=np.arange(50)[:, None] % 10, family=np.ones(ns, int), var_free=np.ones(ns, bool), C=c, levels=[Level(nf_min=12, nf_max=12)])
    p = start(m, loud())
    p["rho"][:] = 80
    u.update_z(m, p, loud())
    u.update_beta_lambda(m, p, quiet())
    rest = m.X.T @ (p["iD"] * (p["Z"] - predictor(m, p))) - u.beta_prior_times(m, p, p["Beta"] - p["Gamma"] @ m.T.T)
    assert p["Lambda"][0].size + p["Beta"].size > 4000
    assert np.abs(rest).max() < 1e-6 * np.abs(m.X.T @ p["Z"]).max()


def test_common_precision_path_equals_the_general_one():
    m, p = model(missing=False, families=(1, 2), ny=36)
    m.Pi[:, 0] = np.arange(36) % 9
    _, fast = u.eta_statistics(m, p, 0)
    lam, total = p["Lambda"][0], np.zeros((9, m.Y.shape[1]))
    np.add.at(total, m.Pi[:, 0], p["iD"])
    np.testing.assert_allclose(fast, np.einsum("hj,uj,kj->uhk", lam, total, lam))


@pytest.mark.parametrize("phylo", [False, True])
def test_beta_eta_mean_is_a_fixed_point(phylo):
    m, p = model(phylo=phylo, method="full")
    u.update_beta_eta(m, p, quiet())
    before = p["Beta"].copy(), p["Eta"][1].copy()
    # at the joint mode, the mean of Beta given the same scores is Beta itself
    prior, mean = joint_precision(m, p)
    nc, ns = m.nc, m.Y.shape[1]
    rest = p["Z"] - (predictor(m, p) - m.X @ p["Beta"])
    big, right = prior.reshape(ns, nc, ns, nc).copy(), (prior @ mean).reshape(ns, nc).copy()
    for j in range(ns):
        big[j, :, j, :] += m.X.T @ (p["iD"][:, j, None] * m.X)
        right[j] += m.X.T @ (p["iD"][:, j] * rest[:, j])
    np.testing.assert_allclose(before[0], np.linalg.solve(big.reshape(ns * nc, -1), right.reshape(-1)).reshape(ns, nc).T, atol=1e-7)


@pytest.mark.parametrize("phylo", [False, True])
def test_gamma_mean_is_the_dense_solution(phylo):
    m, p = model(phylo=phylo)
    p["Beta"] += 1.0
    if phylo:
        p["rho"][:] = 40
    u.update_gamma_v(m, p, quiet())
    prior, _ = joint_precision(m, p)
    ns, nc, nt = m.Y.shape[1], m.nc, m.T.shape[1]
    design = np.zeros((ns, nc, nt, nc))
    for j in range(ns):
        for c in range(nc):
            design[j, c, :, c] = m.T[j]
    design = design.reshape(ns * nc, nt * nc)
    want = np.linalg.solve(m.iu_gamma + design.T @ prior @ design, m.iu_gamma @ m.m_gamma + design.T @ prior @ p["Beta"].T.reshape(-1))
    np.testing.assert_allclose(p["Gamma"], want.reshape(nt, nc).T, atol=1e-8)


def test_wishart_mean():
    s = np.array([[2.0, 0.5], [0.5, 1.0]])
    mean = np.mean([loud(k).wishart(7, s) for k in range(4000)], 0)
    np.testing.assert_allclose(mean, 7 * np.linalg.inv(s), rtol=0.06, atol=0.1)


def test_rho_table_equals_the_dense_likelihood():
    m, p = model(phylo=True)
    p["Beta"] += np.random.default_rng(4).normal(size=p["Beta"].shape)
    got = u.rho_log_likelihood(m, p, 0)
    e = (p["Beta"] - p["Gamma"] @ m.T.T).T.reshape(-1)
    for g in (0, 30, 90):
        rho = m.rho_grid[g, 0]
        k = np.kron(rho * m.C + (1 - rho) * np.eye(len(m.C)), np.linalg.inv(p["iV"]))
        want = np.log(m.rho_grid[g, 1]) - 0.5 * np.linalg.slogdet(k)[1] - 0.5 * e @ np.linalg.solve(k, e)
        k0 = np.kron(np.eye(len(m.C)), np.linalg.inv(p["iV"]))
        base = np.log(m.rho_grid[0, 1]) - 0.5 * np.linalg.slogdet(k0)[1] - 0.5 * e @ np.linalg.solve(k0, e)
        assert np.isclose(got[g] - got[0], want - base)


@pytest.mark.parametrize("method", ["full", "gpp", "nngp"])
def test_alpha_table_equals_the_dense_likelihood(method):
    m, p = model(method=method)
    level, eta = m.levels[0], p["Eta"][0]
    got = spatial.log_likelihood(level, eta)
    for g in range(3):
        w = spatial.precision(level, g)
        want = np.log(level.alpha[g, 1]) + 0.5 * np.linalg.slogdet(w)[1] - 0.5 * np.einsum("uh,uv,vh->h", eta, w, eta)
        np.testing.assert_allclose(got[:, g], want, rtol=1e-6, atol=1e-6)


def test_knots_woodbury_and_neighbours_of_all_predecessors():
    rng = np.random.default_rng(5)
    xy, k = rng.random((7, 2)), rng.random((3, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    g = spatial.nngp(*spatial.nearest(xy, 7), np.array([0.4]))
    np.testing.assert_allclose(spatial.precision(Level(method="nngp", grid=g), 0), np.linalg.inv(np.exp(-d / 0.4)), rtol=1e-8)
    assert np.isclose(g["log_det"][0], np.linalg.slogdet(np.exp(-d / 0.4))[1])
    d12, d22 = np.sqrt(((xy[:, None] - k[None]) ** 2).sum(-1)), np.sqrt(((k[:, None] - k[None]) ** 2).sum(-1))
    w12, w22 = np.exp(-d12 / 0.4), np.exp(-d22 / 0.4)
    low = w12 @ np.linalg.solve(w22, w12.T)
    dense = low + np.diag(1 - np.diag(low))
    grid = spatial.gpp(d12, d22, np.array([0.4]))
    np.testing.assert_allclose(spatial.precision(Level(method="gpp", grid=grid), 0), np.linalg.inv(dense), rtol=1e-7)
    assert np.isclose(grid["log_det"][0], np.linalg.slogdet(dense)[1])


def test_z_of_each_family():
    m, p = model(seed=7)
    seen = ~np.isnan(m.Y)
    np.testing.assert_allclose(p["iD"], seen / p["sigma"] ** 2)
    normal, probit = m.family == 1, m.family == 2
    assert (p["Z"][:, normal][seen[:, normal]] == m.Y[:, normal][seen[:, normal]]).all()
    z, y, s = p["Z"][:, probit], m.Y[:, probit], seen[:, probit]
    assert ((z > 0) == (y > 0))[s].all()
    assert np.isnan(p["omega"][~seen[:, m.family == 3]]).all() and (p["Z"][:, m.family == 3][~seen[:, m.family == 3]] == 0).all()
    u.update_z(m, p, loud(1), marginal=True)
    assert (p["iD"][:, m.family == 3] <= 1 / p["sigma"][m.family == 3] ** 2 + 1e-12).all()


def test_truncated_normal_moments():
    for a in (-2.0, 0.0, 1.0, 6.0):
        x = loud(3).above(np.full(40000, a))
        assert (x > a).all()
        _, slope = log_cdf(np.array([-a]))
        assert np.isclose(x.mean(), slope[0], rtol=0.02, atol=0.01)


def test_sigma_and_shrinkage_rates():
    m, p = model()
    shape, rate = u.sigma_rates(m, p)
    seen = ~np.isnan(m.Y)
    np.testing.assert_allclose(shape, 1 + seen.sum(0) / 2)
    np.testing.assert_allclose(rate, 5 + np.where(seen, (p["Z"] - predictor(m, p)) ** 2, 0).sum(0) / 2)
    before = p["sigma"].copy()
    u.update_sigma(m, p, loud())
    assert (p["sigma"][~m.var_free] == before[~m.var_free]).all() and (p["sigma"][m.var_free] != before[m.var_free]).all()
    lam = p["Lambda"][0]
    psi, delta = u.shrinkage(m.levels[0], lam, np.ones(2), quiet())
    np.testing.assert_allclose(psi, 2 / (1.5 + 0.5 * lam**2))
    w = (psi * lam**2).sum(1)
    d0 = (50 + 0.5 * 6 * 2) / (1 + 0.5 * w.sum())
    assert np.isclose(delta[0], d0) and np.isclose(delta[1], (50 + 0.5 * 6) / (1 + 0.5 * d0 * w[1]))


def test_factors_are_added_and_dropped_within_bounds():
    m, p = model()
    m.levels[0].nf_min = m.levels[1].nf_min = 2
    p["Lambda"][0][:] = 0
    for k in range(200):
        u.update_nf(m, p, loud(k), 30)
    assert all(x.shape[0] in (2, 3) for x in p["Lambda"])
    assert p["Eta"][1].shape[1] == p["Lambda"][1].shape[0] == len(p["Delta"][1]) == len(p["Alpha"][1])


def test_selection_odds_are_a_difference_of_likelihoods():
    m, p = model(selections=[{"covs": np.array([1]), "group": np.arange(6) % 2, "q": np.array([0.3, 0.6])}])
    rest = p["Z"] - (predictor(m, p) - (predictor(m, p | {"Eta": [e * 0 for e in p["Eta"]]})))
    ll = u.selection_log_odds(m, p, 0, rest, m.X)
    for g in (0, 1):
        for on in (0, 1):
            x = effective(m, p | {"BetaSel": [np.array([bool(on)] * 2)]})
            e = rest - np.einsum("jik,kj->ij", x, p["Beta"])
            js = np.arange(6) % 2 == g
            want = (-0.5 * p["iD"] * e**2)[:, js].sum() + np.log([0.7, 0.3] if g == 0 else [0.4, 0.6])[on]
            assert np.isclose(ll[on, g], want)
    u.update_selection(m, p, loud())
    assert p["Xeff"].ndim == 3


def test_reduced_rank_mean_is_the_dense_solution():
    rng = np.random.default_rng(9)
    m, p = model(XR=rng.normal(size=(40, 4)), n_rrr=2)
    u.update_rrr(m, p, quiet())
    n = m.X.shape[1]
    b = p["Beta"][n:]
    rest = p["Z"] - m.X @ p["Beta"][:n] - sum((p["Eta"][r] @ p["Lambda"][r])[m.Pi[:, r]] for r in range(2))
    design = np.einsum("ik,hj->ijhk", m.XR, b).reshape(40 * 6, -1)
    d = p["iD"].reshape(-1)
    want = np.linalg.solve(design.T @ (d[:, None] * design) + np.diag((p["PsiRRR"] * np.cumprod(p["DeltaRRR"])[:, None]).reshape(-1)), design.T @ (d * rest.reshape(-1)))
    np.testing.assert_allclose(p["wRRR"].reshape(-1), want, atol=1e-8)
    u.update_rrr_priors(m, p, loud())
    assert p["PsiRRR"].shape == (2, 4)


@pytest.mark.parametrize("phylo", [False, True])
def test_hamiltonian_gradient(phylo):
    m, p = model(families=(1, 2), method="full", phylo=phylo)
    value, grad = hmc.log_density(m, p)
    for name, at in (("Beta", (1, 2)), ("Eta", (3, 1)), ("Lambda", (1, 4))):
        q = {k: ([x.copy() for x in v] if isinstance(v, list) else v) for k, v in p.items()} | {"Beta": p["Beta"].copy()}
        target = q[name] if name == "Beta" else q[name][0]
        target[at] += 1e-5
        g = grad[name] if name == "Beta" else grad[name][0]
        assert np.isclose((hmc.log_density(m, q)[0] - value) / 1e-5, g[at], rtol=1e-3, atol=1e-3)


@pytest.mark.parametrize("method", ["none", "full", "gpp", "nngp"])
def test_integrated_densities_equal_sums_over_what_is_left_out(method):
    m, p = model(families=(1, 2), **({} if method == "none" else {"method": method}))
    level, eta, lam = m.levels[0], p["Eta"][0], p["Lambda"][0]
    value, slope = hmc.score_density(level, eta)
    if method == "none":
        assert np.isclose(value, -0.5 * (eta**2).sum())
    else:
        assert np.isclose(value, np.log(np.exp(spatial.log_likelihood(level, eta)).sum(1)).sum())
    for at in ((0, 0), (3, 1)):
        near = [eta.copy(), eta.copy()]
        near[0][at] -= 1e-5
        near[1][at] += 1e-5
        assert np.isclose((hmc.score_density(level, near[1])[0] - hmc.score_density(level, near[0])[0]) / 2e-5, slope[at], rtol=1e-5, atol=1e-6)
    # loadings: over precisions on a fine grid, up to the same constant for all loadings
    psi = np.linspace(1e-4, 60, 600001)
    prior = psi ** (level.nu / 2 - 1) * np.exp(-level.nu * psi / 2)
    product = np.ones(len(lam)) * 1.7
    summed = [np.log((prior * np.sqrt(psi * 1.7) * np.exp(-psi * 1.7 * x**2 / 2)).sum()) for x in (0.0, 0.4, -2.0)]
    closed = [hmc.loading_density(level, np.array([[x]]), product[:1])[0] for x in (0.0, 0.4, -2.0)]
    np.testing.assert_allclose(np.diff(closed), np.diff(summed), rtol=1e-3)


def test_hamiltonian_moves_are_accepted_and_refuse_counts():
    m, p = model(families=(1, 2))
    step = hmc.Step()
    rates = []
    for k in range(60):
        rates.append(hmc.move(m, p, loud(k), step))
        step.tune(rates[-1])
    assert np.mean(rates[30:]) > 0.4
    m, p = model()
    with pytest.raises(ValueError):
        hmc.log_density(m, p)


def test_bad_models_are_refused():
    with pytest.raises(ValueError):
        Model(Y=np.zeros((3, 2)), X=np.ones((3, 1)), Pi=np.zeros((3, 0), int), family=np.array([1, 7]), var_free=np.ones(2, bool))
    with pytest.raises(ValueError):
        Model(Y=np.zeros((3, 2)), X=np.ones((3, 1)), Pi=np.zeros((2, 1), int), family=np.ones(2, int), var_free=np.ones(2, bool), levels=[Level()])


@pytest.mark.parametrize("kind", [{}, {"phylo": True}, {"method": "full"}, {"method": "gpp"}, {"method": "nngp"}, {"n_rrr": 1, "XR": np.random.default_rng(0).normal(size=(40, 3))}])
def test_chains_run_for_every_kind_of_model(kind):
    m, _ = model(**kind)
    draws = [(d, p["Beta"].copy()) for d, p in chain.run(m, 0, 3, transient=4, thin=2, seed=5, joint="phylo" not in kind and "n_rrr" not in kind)]
    assert [d for d, _ in draws] == [0, 1, 2] and all(np.isfinite(b).all() for _, b in draws)


def test_normal_coefficients_are_recovered():
    rng = np.random.default_rng(1)
    ny, ns = 300, 4
    X = np.c_[np.ones(ny), rng.normal(size=ny)]
    B = rng.normal(size=(2, ns))
    Y = X @ B + 0.5 * rng.normal(size=(ny, ns))
    m = Model(Y=Y, X=X, Pi=np.arange(ny)[:, None] % 10, family=np.ones(ns, int), var_free=np.ones(ns, bool), levels=[Level(nf_max=2)])
    draws = np.array([p["Beta"].copy() for _, p in chain.run(m, 0, 150, transient=50, seed=2)])
    assert (np.abs(draws.mean(0) - B) < 3 * draws.std(0) + 0.08).all()
