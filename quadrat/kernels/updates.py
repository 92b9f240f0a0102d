"""Conditional draws of every block of parameters, given the others. Each takes (model, p, noise) and changes p."""

from __future__ import annotations

import numpy as np

from quadrat.kernels import spatial
from quadrat.kernels.linear import blocks_times, root_times, solve
from quadrat.kernels.random import polya_gamma_moments
from quadrat.kernels.state import POISSON, PROBIT, Model, as_rows, base_design, by_unit, effective, features, fixed, from_rows, masked, onto_scores, predictor, random_part, selection_mask, tau, unit_part

#: Size of the negative binomial that stands for a Poisson.
NB_R = 1000.0


def update_z(model: Model, p: dict, noise, marginal: bool = False) -> None:
    """Latent responses Z and their precisions iD (0 where nothing was observed)."""
    lin, seen = predictor(model, p), ~np.isnan(model.Y)
    sigma = np.broadcast_to(p["sigma"], lin.shape)
    before = lin if p["Z"] is None else p["Z"]
    y = np.where(seen, model.Y, 0.0)
    free = lin + sigma * noise.normal(lin.shape)
    z, inv = np.where(seen, y, free), seen / sigma**2

    probit = np.broadcast_to(model.family == PROBIT, lin.shape)
    if probit.any():
        # by symmetry: s (z - L) / sigma is above -s L / sigma, with s = 1 for a presence and -1 for an absence
        sign = np.where(y > 0, 1.0, -1.0)
        cut = np.where(probit & seen, -sign * lin / sigma, 0.0)
        z = np.where(probit, np.where(seen, lin + sign * sigma * noise.above(cut), free), z)
    count = np.broadcast_to(model.family == POISSON, lin.shape)
    if count.any():
        m, s = polya_gamma_moments(y + NB_R, before - np.log(NB_R))
        w = np.abs(m + s * noise.normal(lin.shape))
        if marginal:
            zc, ic = (y - NB_R) / (2 * w) + np.log(NB_R), seen / (sigma**2 + 1 / w)
        else:
            var = 1 / (sigma**-2 + w)
            zc = var * ((y - NB_R) / 2 + w * np.log(NB_R) + lin / sigma**2) + np.sqrt(var) * noise.normal(lin.shape)
            ic = inv
        z, inv = np.where(count, np.where(seen, zc, 0.0), z), np.where(count, ic, inv)
        p["omega"] = np.where(seen, w, np.nan)[:, model.family == POISSON]
    p["Z"], p["iD"] = z, inv


def _rho_scales(model: Model, p: dict) -> np.ndarray:
    """[covariates, eigenvalues]: (rho e + 1 - rho)^-1/2 of each covariate's rho."""
    rho = model.rho_grid[p["rho"], 0][model.rho_group]
    return (rho[:, None] * model.eC[None] + 1 - rho[:, None]) ** -0.5


def beta_prior_times(model: Model, p: dict, x: np.ndarray) -> np.ndarray:
    """The prior precision of Beta by x [covariates, species]: with phylogeny by way of its eigenvectors."""
    if model.C is None:
        return p["iV"] @ x
    q = _rho_scales(model, p)
    return (q * (p["iV"] @ (q * (x @ model.VC)))) @ model.VC.T


def _beta_prior_noise(model: Model, p: dict, noise) -> np.ndarray:
    """[covariates, species], with the prior precision of Beta as covariance."""
    z = np.linalg.cholesky(p["iV"]) @ noise.normal((len(p["iV"]), model.Y.shape[1]))
    return z if model.C is None else (_rho_scales(model, p) * z) @ model.VC.T


def _beta_prior_blocks(model: Model, p: dict) -> np.ndarray:
    """[species, covariates, covariates]: what the prior precision has for each species by itself."""
    if model.C is None:
        return np.broadcast_to(p["iV"], (model.Y.shape[1], *p["iV"].shape))
    q = _rho_scales(model, p)
    return np.einsum("jm,cm,km->jck", model.VC**2, q, q, optimize=True) * p["iV"]


def update_beta_lambda(model: Model, p: dict, noise) -> None:
    """Regression coefficients and loadings together: by species, or with phylogeny all at once by conjugate gradients."""
    x, ns, nc = p["Xeff"], model.Y.shape[1], model.nc
    etas = [features(level, e)[model.Pi[:, r]] for r, (level, e) in enumerate(zip(model.levels, p["Eta"], strict=True))]
    widths = [e.shape[1] for e in etas]
    f = np.concatenate([np.zeros((len(model.Y), 0)), *etas], 1)
    na = nc + f.shape[1]
    load = np.concatenate([np.zeros((0, ns)), *[as_rows(psi * tau(d)[:, None]) for psi, d in zip(p["Psi"], p["Delta"], strict=True)]])
    mean = p["Gamma"] @ model.T.T
    gram, rhs = np.empty((ns, na, na)), np.empty((ns, na))
    for j in range(ns):
        xe = np.concatenate([x if x.ndim == 2 else x[j], f], 1)
        w = xe * p["iD"][:, j, None]
        gram[j], rhs[j] = w.T @ xe, w.T @ p["Z"][:, j]
        if model.C is not None:
            rhs[j] += xe.T @ (np.sqrt(p["iD"][:, j]) * noise.normal(len(xe)))
    at = np.arange(nc, na)
    gram[:, at, at] += load.T
    rhs[:, :nc] += beta_prior_times(model, p, mean).T
    own = gram.copy()
    own[:, :nc, :nc] += _beta_prior_blocks(model, p)
    if model.C is None:
        out = noise.from_precision(own, rhs)
    else:
        rhs[:, nc:] += np.sqrt(load.T) * noise.normal(load.T.shape)
        rhs[:, :nc] += _beta_prior_noise(model, p, noise).T

        def times(v):
            v = v.reshape(ns, na)
            out = blocks_times(gram, v)
            out[:, :nc] += beta_prior_times(model, p, v[:, :nc].T).T
            return out.reshape(-1)

        near = np.linalg.inv(own)
        out = solve(times, rhs.reshape(-1), lambda v: blocks_times(near, v.reshape(ns, na)).reshape(-1)).reshape(ns, na)
    p["Beta"], at = out[:, :nc].T, nc
    for r, n in enumerate(widths):
        p["Lambda"][r], at = from_rows(model.levels[r], out[:, at : at + n].T), at + n


def update_gamma_v(model: Model, p: dict, noise) -> None:
    """Covariance of coefficients among covariates, then the traits' effects on them."""
    rest = p["Beta"] - p["Gamma"] @ model.T.T
    if model.C is None:
        q, t, beta = np.ones(rest.shape), model.T, p["Beta"]
    else:
        q, t, beta = _rho_scales(model, p), model.VC.T @ model.T, p["Beta"] @ model.VC
        rest = q * (rest @ model.VC)
    p["iV"] = noise.wishart(model.f0 + rest.shape[1], rest @ rest.T + model.V0)
    nc, nt = p["Gamma"].shape
    weight = np.einsum("ck,cj,kj->jck", p["iV"], q, q)
    precision = model.iu_gamma + np.einsum("jt,js,jck->tcsk", t, t, weight, optimize=True).reshape(nt * nc, nt * nc)
    right = model.iu_gamma @ model.m_gamma + np.einsum("jt,jck,kj->tc", t, weight, beta, optimize=True).reshape(-1)
    p["Gamma"] = noise.from_precision(precision, right).reshape(nt, nc).T


def rho_log_likelihood(model: Model, p: dict, group: int) -> np.ndarray:
    """Over the grid, with the other groups' rho as they are."""
    rest = (p["Beta"] - p["Gamma"] @ model.T.T) @ model.VC
    mine, now, out = model.rho_group == group, _rho_scales(model, p), []
    with np.errstate(divide="ignore"):
        prior = np.log(model.rho_grid[:, 1])
    for rho, lp in zip(model.rho_grid[:, 0], prior, strict=True):
        e = rho * model.eC + 1 - rho
        q = np.where(mine[:, None], e**-0.5, now)
        s = q * rest
        out.append(lp - 0.5 * mine.sum() * np.log(e).sum() - 0.5 * np.einsum("cj,ck,kj->", s, p["iV"], s))
    return np.array(out)


def update_rho(model: Model, p: dict, noise) -> None:
    if model.C is not None:
        for k in range(len(p["rho"])):
            p["rho"][k] = noise.categorical(rho_log_likelihood(model, p, k))


def update_lambda_priors(model: Model, p: dict, noise) -> None:
    """Local and then, one after the other, global precisions of the loadings; those of each covariate by themselves."""
    for r, level in enumerate(model.levels):
        lam, delta = p["Lambda"][r], p["Delta"][r]
        if level.x is None:
            p["Psi"][r], p["Delta"][r] = shrinkage(level, lam, delta, noise)
        else:
            of = [shrinkage(level, lam[:, :, k], delta[:, k], noise) for k in range(lam.shape[2])]
            p["Psi"][r], p["Delta"][r] = (np.stack(x, -1) for x in zip(*of, strict=True))


def shrinkage(level, lam: np.ndarray, delta: np.ndarray, noise) -> tuple[np.ndarray, np.ndarray]:
    """Local precisions given the global ones, then each global one given the rest: a new one rescales the products after it."""
    nf, n = lam.shape
    product, delta = tau(delta), delta.copy()
    psi = noise.gamma((level.nu + 1) / 2, (level.nu + lam**2 * product[:, None]) / 2)
    size = (psi * lam**2).sum(1)
    shape = np.full(nf, level.a2) + n * np.arange(nf, 0, -1) / 2
    rate = np.full(nf, level.b2)
    shape[:1] += level.a1 - level.a2
    rate[:1] = level.b1
    for h in range(nf):
        new = noise.gamma(shape[h], rate[h] + product[h:] @ size[h:] / (2 * delta[h]))
        product[h:] *= new / delta[h]
        delta[h] = new
    return psi, delta


def eta_statistics(model: Model, p: dict, r: int) -> tuple[np.ndarray, np.ndarray]:
    """mu [units, factors] and precision [units, factors, factors] of level r's data part."""
    level, lam, rows = model.levels[r], p["Lambda"][r], as_rows(p["Lambda"][r])
    rest = p["Z"] - predictor(model, p, without=r)
    mu = onto_scores(level, by_unit(model, r, (p["iD"] * rest) @ rows.T))
    total = by_unit(model, r, p["iD"])
    if level.x is not None:
        return mu, _data_precision(level.x, lam, total)
    if np.allclose(total, total[:1]):  # one matrix does for all units
        one = (lam * total[0]) @ lam.T
        return mu, np.broadcast_to(one, (len(total), *one.shape))
    return mu, np.einsum("hj,uj,kj->uhk", lam, total, lam, optimize=True)


def _data_precision(x: np.ndarray, lam: np.ndarray, total: np.ndarray) -> np.ndarray:
    """[units, factors, factors] by loadings that differ by unit, made for some 4 million numbers at a time."""
    nf, ns, _ = lam.shape
    step, out = max(1, 2**22 // max(1, nf * ns)), np.empty((len(x), nf, nf))
    for a in range(0, len(x), step):
        own = np.einsum("uk,hjk->uhj", x[a : a + step], lam, optimize=True)
        out[a : a + step] = (own * total[a : a + step, None, :]) @ np.swapaxes(own, 1, 2)
    return out


def update_eta(model: Model, p: dict, noise) -> None:
    """Factor scores of each level given the levels before it as already drawn."""
    for r, level in enumerate(model.levels):
        nf = p["Lambda"][r].shape[0]
        if not nf:
            continue
        mu, data = eta_statistics(model, p, r)
        if level.method == "none":
            p["Eta"][r] = noise.from_precision(data + np.eye(nf), mu)
        elif level.method == "gpp":
            p["Eta"][r] = _eta_gpp(level, p["Alpha"][r], mu, data, noise)
        else:
            p["Eta"][r] = _eta_spatial(level, p["Alpha"][r], mu, data, noise)


def _eta_gpp(level, alpha: np.ndarray, mu: np.ndarray, data: np.ndarray, noise) -> np.ndarray:
    """Precision B - M F^-1 M' with B block-diagonal by unit: B^-1 plus a term of low rank, drawn as a sum of two."""
    n, nf = mu.shape
    b = data + np.stack([np.diag(x) for x in np.array([level.grid["idD"][g] for g in alpha]).T])
    m = np.stack([level.grid["M"][g] for g in alpha], 1)  # [units, factors, knots]
    nk = m.shape[2]
    wide = np.zeros((n, nf, nf * nk))
    for h in range(nf):
        wide[:, h, h * nk : (h + 1) * nk] = m[:, h]
    ib_m = np.linalg.solve(b, wide)
    inner = -np.einsum("uha,uhb->ab", wide, ib_m)
    for h, g in enumerate(alpha):
        inner[h * nk : (h + 1) * nk, h * nk : (h + 1) * nk] += level.grid["F"][g]
    own = noise.from_precision(b, mu)
    knots = noise.from_precision(inner, np.einsum("uha,uh->a", ib_m, mu))
    return own + ib_m @ knots


def _columns(level, alpha: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """Each factor's prior precision by its scores [units, factors]."""
    return eta if level.method == "none" else np.concatenate([spatial.times(level, g, eta[:, h : h + 1]) for h, g in enumerate(alpha)], 1)


def _own_precision(level, alpha: np.ndarray, data: np.ndarray) -> np.ndarray:
    """[units, factors, factors]: what the precision of the scores has for each unit by itself."""
    nf = data.shape[1]
    prior = np.ones((len(data), nf)) if level.method == "none" else np.stack([spatial.diagonal(level, g) for g in alpha], 1)
    return data + prior[:, :, None] * np.eye(nf)


def _score_noise(level, alpha: np.ndarray, shape: tuple, noise) -> np.ndarray:
    """[units, factors], with the prior precision of the scores as covariance."""
    return noise.normal(shape) if level.method == "none" else np.stack([spatial.precision_noise(level, g, noise) for g in alpha], 1)


def _eta_spatial(level, alpha: np.ndarray, mu: np.ndarray, data: np.ndarray, noise) -> np.ndarray:
    """All scores of a level at once by conjugate gradients: a product costs what the level's own form costs."""
    near = np.linalg.inv(_own_precision(level, alpha, data))

    def times(v):
        v = v.reshape(mu.shape)
        return (blocks_times(data, v) + _columns(level, alpha, v)).reshape(-1)

    rhs = mu + root_times(data, noise.normal(mu.shape)) + _score_noise(level, alpha, mu.shape, noise)
    return solve(times, rhs.reshape(-1), lambda v: blocks_times(near, v.reshape(mu.shape)).reshape(-1)).reshape(mu.shape)


def update_alpha(model: Model, p: dict, noise) -> None:
    """Range of each spatial factor, on its grid."""
    for r, level in enumerate(model.levels):
        nf = p["Eta"][r].shape[1]
        p["Alpha"][r] = noise.categorical(spatial.log_likelihood(level, p["Eta"][r])) if level.method != "none" and nf else np.zeros(nf, int)


def sigma_rates(model: Model, p: dict) -> tuple[np.ndarray, np.ndarray]:
    seen = ~np.isnan(model.Y)
    rest = np.where(seen, p["Z"] - predictor(model, p), 0.0)
    return model.a_sigma + seen.sum(0) / 2, model.b_sigma + (rest**2).sum(0) / 2


def update_sigma(model: Model, p: dict, noise) -> None:
    shape, rate = sigma_rates(model, p)
    p["sigma"] = np.where(model.var_free, noise.gamma(shape, rate) ** -0.5, p["sigma"])


def factor_choice(level, lam: np.ndarray, iteration: int) -> tuple[np.ndarray, bool]:
    """Which factors stay, and whether one is added. A factor counts as vanished when all its loadings are below 1e-3."""
    nf = len(lam)
    small = (np.abs(lam) < 1e-3).reshape(nf, -1).mean(1) if nf else np.zeros(0)
    every = np.arange(nf)
    all_in_use = (small < 0.995).all()
    if nf < level.nf_min or (iteration > 20 and nf < level.nf_max and all_in_use):
        return every, True
    spare = max(0, nf - level.nf_min)  # never below the least number
    return np.delete(every, np.flatnonzero(small >= 1.0)[:spare]), False


def update_nf(model: Model, p: dict, noise, iteration: int) -> None:
    """Ever more rarely, adds a factor or drops those that have vanished: one selection of factors for all arrays."""
    for r, level in enumerate(model.levels):
        if noise.uniform() >= np.exp(-1 - 0.0005 * iteration):
            continue
        stay, more = factor_choice(level, p["Lambda"][r], iteration)
        one = (1, *p["Lambda"][r].shape[1:])
        half = level.nu / 2
        new = {"Lambda": np.zeros(one), "Psi": noise.gamma(np.full(one, half), half), "Delta": noise.gamma(np.full((1, *level.axes), level.a2), level.b2), "Alpha": np.zeros(1, int), "Eta": noise.normal((1, len(p["Eta"][r])))}
        for k, extra in new.items():
            rows = p[k][r].T if k == "Eta" else p[k][r]
            rows = np.concatenate([rows[stay], extra[: int(more)]])
            p[k][r] = rows.T if k == "Eta" else rows


def selection_log_odds(model: Model, p: dict, i: int, rest: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[2, groups]: log posterior weight of selection i off and on, per group of species."""
    s, out = model.selections[i], []
    for on in (False, True):
        active = [a if k != i else np.full(len(a), on) for k, a in enumerate(p["BetaSel"])]
        error = rest - fixed(masked(x, selection_mask(model, active)), p["Beta"])
        by_species = (-0.5 * p["iD"] * error**2).sum(0)
        with np.errstate(divide="ignore"):
            prior = np.log(s["q"] if on else 1 - s["q"])
        out.append(prior + np.bincount(s["group"], by_species, len(s["q"])))
    return np.array(out)


def update_selection(model: Model, p: dict, noise) -> None:
    """Spike and slab: each selection in turn, on or off per group of species."""
    if not model.selections:
        return
    rest = p["Z"] - sum((random_part(model, p, r) for r in range(len(model.levels))), np.zeros(model.Y.shape))
    x = base_design(model, p)
    for i in range(len(model.selections)):
        p["BetaSel"][i] = noise.categorical(selection_log_odds(model, p, i, rest, x).T) == 1
    p["Xeff"] = effective(model, p)


def update_rrr(model: Model, p: dict, noise) -> None:
    """Weights that make the reduced-rank covariates out of the original ones."""
    if not model.n_rrr:
        return
    n = model.X.shape[-1]
    mask = selection_mask(model, p["BetaSel"])
    x = masked(model.X, mask[:n]) if model.selections else model.X
    rest = p["Z"] - fixed(x, p["Beta"][:n]) - sum((random_part(model, p, r) for r in range(len(model.levels))), np.zeros(model.Y.shape))
    b = p["Beta"][n:] * mask[n:]
    k = model.XR.shape[1]
    inner = np.einsum("hj,ij,gj->ihg", b, p["iD"], b, optimize=True)
    precision = np.einsum("ic,ihg,ik->hcgk", model.XR, inner, model.XR, optimize=True).reshape(model.n_rrr * k, -1)
    precision[np.diag_indices_from(precision)] += (p["PsiRRR"] * tau(p["DeltaRRR"])[:, None]).reshape(-1)
    right = np.einsum("hj,ij,ik->hk", b, p["iD"] * rest, model.XR, optimize=True).reshape(-1)
    p["wRRR"] = noise.from_precision(precision, right).reshape(model.n_rrr, k)
    p["Xeff"] = effective(model, p)


def update_rrr_priors(model: Model, p: dict, noise) -> None:
    if model.n_rrr:
        p["PsiRRR"], p["DeltaRRR"] = shrinkage(model.rrr, p["wRRR"], p["DeltaRRR"], noise)


def update_beta_eta(model: Model, p: dict, noise) -> None:
    """Coefficients and one level's scores together, given the loadings, by conjugate gradients.

    The data's part of the precision is applied by way of sites and species, so no system over both is ever made.
    """
    x, (ny, ns), nc = p["Xeff"], model.Y.shape, model.nc
    by_covariate = lambda w: x.T @ w if x.ndim == 2 else np.einsum("jic,ij->cj", x, w, optimize=True)
    for r, level in enumerate(model.levels):
        lam, alpha = p["Lambda"][r], p["Alpha"][r]
        nf, n = lam.shape[0], model.units[r]
        if not nf:
            continue
        cut = nc * ns

        def back(w, level=level, lam=lam, r=r):
            return by_covariate(w), onto_scores(level, by_unit(model, r, w @ as_rows(lam).T))

        def flat(beta, eta):
            return np.r_[beta.T.reshape(-1), eta.reshape(-1)]

        def parts(v, cut=cut, n=n, nf=nf):
            return v[:cut].reshape(ns, nc).T, v[cut:].reshape(n, nf)

        def times(v, level=level, alpha=alpha, lam=lam, r=r, parts=parts, back=back):
            beta, eta = parts(v)
            b, e = back(p["iD"] * (fixed(x, beta) + unit_part(level, eta, lam)[model.Pi[:, r]]))
            return flat(b + beta_prior_times(model, p, beta), e + _columns(level, alpha, eta))

        rest = p["Z"] - predictor(model, p, without=r) + fixed(x, p["Beta"])
        b, e = back(p["iD"] * rest + np.sqrt(p["iD"]) * noise.normal((ny, ns)))
        b = b + beta_prior_times(model, p, p["Gamma"] @ model.T.T) + _beta_prior_noise(model, p, noise)
        e = e + _score_noise(level, alpha, (n, nf), noise)
        xs = x[None] if x.ndim == 2 else x
        own = np.stack([(xs[j % len(xs)] * p["iD"][:, j, None]).T @ xs[j % len(xs)] for j in range(ns)]) + _beta_prior_blocks(model, p)
        near_b, near_e = np.linalg.inv(own), np.linalg.inv(_own_precision(level, alpha, eta_statistics(model, p, r)[1]))

        def near(v, parts=parts, near_b=near_b, near_e=near_e):
            beta, eta = parts(v)
            return flat(blocks_times(near_b, beta.T).T, blocks_times(near_e, eta))

        p["Beta"], p["Eta"][r] = parts(solve(times, flat(b, e), near))
