"""Hamiltonian moves of coefficients, scores and loadings together, with dual-averaging of the step size.

Their target does not hold the local precisions and the ranges: those are integrated out, so a move may cross from one to
another. Both must be drawn anew after a move, before anything is drawn given them.
"""

from __future__ import annotations

import numpy as np

from quadrat.kernels import spatial
from quadrat.kernels.random import log_cdf
from quadrat.kernels.state import NORMAL, POISSON, PROBIT, Model, as_rows, by_unit, features, from_rows, onto_scores, predictor, tau
from quadrat.kernels.updates import beta_prior_times


def loading_density(level, lam: np.ndarray, product: np.ndarray) -> tuple[float, np.ndarray]:
    """Loadings with their local precisions integrated out: Student's t with nu degrees, and its gradient."""
    weight, nu = product[:, None], level.nu
    value = 0.5 * lam.shape[1] * np.log(product).sum() - (nu + 1) / 2 * np.log1p(weight * lam**2 / nu).sum()
    return float(value), -(nu + 1) * weight * lam / (nu + weight * lam**2)


def score_density(level, eta: np.ndarray) -> tuple[float, np.ndarray]:
    """Scores with each factor's range integrated out over its grid, and the gradient: that of each range by its share.

    Ranges whose share is less than rounding add nothing, and are not multiplied.
    """
    if level.method == "none" or not eta.shape[1]:
        return -0.5 * float((eta * eta).sum()), -eta
    ll = spatial.log_likelihood(level, eta)
    top = ll.max(1, keepdims=True)
    share = np.exp(ll - top)
    total = share.sum(1, keepdims=True)
    share = share / total
    slope = np.zeros_like(eta)
    for g in np.flatnonzero((share > 1e-17).any(0)):
        own = np.flatnonzero(share[:, g] > 1e-17)
        slope[:, own] -= share[own, g] * spatial.times(level, g, eta[:, own])
    return float((top + np.log(total)).sum()), slope


def log_density(model: Model, p: dict) -> tuple[float, dict]:
    """Up to a constant, and its gradient by Beta, Eta and Lambda. Latent responses, local precisions and ranges are integrated out."""
    if (model.family == POISSON).any():
        raise ValueError("Hamiltonian moves need normal or presence responses: counts have no closed likelihood")
    lin, seen = predictor(model, p), ~np.isnan(model.Y)
    y, sigma = np.where(seen, model.Y, 0.0), p["sigma"]
    sign = np.where(y > 0, 1.0, -1.0)
    lp, slope = log_cdf(sign * lin / sigma)
    probit = (model.family == PROBIT)[None] & seen
    normal = (model.family == NORMAL)[None] & seen
    value = lp[probit].sum() - 0.5 * ((((y - lin) / sigma) ** 2)[normal]).sum()
    g = np.where(probit, sign * slope / sigma, 0.0) + np.where(normal, (y - lin) / sigma**2, 0.0)
    x = p["Xeff"]
    grad = {"Beta": x.T @ g if x.ndim == 2 else np.einsum("jic,ij->cj", x, g), "Eta": [], "Lambda": []}
    rest = p["Beta"] - p["Gamma"] @ model.T.T
    pull = beta_prior_times(model, p, rest)
    value -= 0.5 * (rest * pull).sum()
    grad["Beta"] = grad["Beta"] - pull
    for r, level in enumerate(model.levels):
        eta, lam = p["Eta"][r], p["Lambda"][r]
        of_scores, pull = score_density(level, eta)
        of_loadings, shrink = loading_density(level, lam, tau(p["Delta"][r]))
        value += of_scores + of_loadings
        grad["Eta"].append(onto_scores(level, by_unit(model, r, g @ as_rows(lam).T)) + pull)
        grad["Lambda"].append(from_rows(level, features(level, eta)[model.Pi[:, r]].T @ g) + shrink)
    return float(value), grad


def _flat(v: dict) -> list[np.ndarray]:
    return [v["Beta"], *v["Eta"], *v["Lambda"]]


def _with(p: dict, parts: list[np.ndarray]) -> dict:
    n = len(p["Eta"])
    return p | {"Beta": parts[0], "Eta": parts[1 : 1 + n], "Lambda": parts[1 + n :]}


class Step:
    """Step size that tends to an acceptance of target while tuning (Hoffman and Gelman 2014)."""

    def __init__(self, first: float = 0.01, target: float = 0.75):
        self.size, self.target, self.mu = first, target, np.log(10 * first)
        self.error, self.mean, self.n = 0.0, np.log(first), 0

    def tune(self, accepted: float) -> None:
        self.n += 1
        self.error += (self.target - accepted - self.error) / (self.n + 10)
        log_size = self.mu - np.sqrt(self.n) / 0.05 * self.error
        w = self.n**-0.75
        self.mean = w * log_size + (1 - w) * self.mean
        self.size = float(np.exp(log_size))

    def freeze(self) -> None:
        self.size = float(np.exp(self.mean))


def move(model: Model, p: dict, noise, step: Step, leaps: int = 10) -> float:
    """One trajectory; returns the probability with which it was accepted."""
    start = [x.copy() for x in _flat(p)]
    speed = [noise.normal(x.shape) for x in start]
    value, grad = log_density(model, p)
    energy = value - 0.5 * sum((v**2).sum() for v in speed)
    at = [x.copy() for x in start]
    with np.errstate(over="ignore", invalid="ignore"):  # a trajectory may diverge; it is refused then
        for _ in range(leaps):
            speed = [v + step.size / 2 * g for v, g in zip(speed, _flat(grad), strict=True)]
            at = [x + step.size * v for x, v in zip(at, speed, strict=True)]
            new, grad = log_density(model, _with(p, at))
            speed = [v + step.size / 2 * g for v, g in zip(speed, _flat(grad), strict=True)]
        gain = new - 0.5 * sum((v**2).sum() for v in speed) - energy
    chance = float(np.exp(min(0.0, gain))) if np.isfinite(gain) else 0.0
    if noise.uniform() < chance:
        p.update(_with(p, at))
    return chance
