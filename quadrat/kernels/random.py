"""Seeded draws that do not depend on partitioning: a generator per (seed, chain, iteration, update)."""

from __future__ import annotations

import numpy as np


class Noise:
    """Source of randomness of one update. With quiet=True normal draws are 0, so a draw is its mean."""

    def __init__(self, seed: int, chain: int, iteration: int, update: int, quiet: bool = False):
        self.g = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, chain, iteration, update])))
        self.quiet = quiet

    def normal(self, shape) -> np.ndarray:
        return np.zeros(shape) if self.quiet else self.g.standard_normal(shape)

    def uniform(self, shape=None):
        return self.g.random(shape)

    def gamma(self, shape, rate) -> np.ndarray:
        shape, rate = np.broadcast_arrays(shape, rate)
        return np.asarray(shape / rate) if self.quiet else self.g.standard_gamma(shape) / rate

    def categorical(self, logits: np.ndarray) -> np.ndarray:
        """Index by the last axis: the first whose cumulated probability exceeds a uniform."""
        p = np.exp(logits - logits.max(-1, keepdims=True))
        c = np.cumsum(p / p.sum(-1, keepdims=True), -1)
        return np.minimum((c <= self.uniform(logits.shape[:-1] + (1,))).sum(-1), logits.shape[-1] - 1)

    def from_precision(self, precision: np.ndarray, rhs: np.ndarray) -> np.ndarray:
        """N(P^-1 rhs, P^-1), over leading batch axes."""
        low = np.linalg.cholesky(precision)
        up = np.swapaxes(low, -1, -2)
        half = np.linalg.solve(low, rhs[..., None])
        return np.linalg.solve(up, half + self.normal(rhs.shape)[..., None])[..., 0]

    def wishart(self, df: float, inverse_scale: np.ndarray) -> np.ndarray:
        """Wishart with mean df * inverse_scale^-1, by Bartlett's triangle."""
        n = len(inverse_scale)
        scale = np.linalg.inv(inverse_scale)
        if self.quiet:
            return df * scale
        a = np.tril(self.g.standard_normal((n, n)), -1)
        a[np.diag_indices(n)] = np.sqrt(self.g.chisquare(df - np.arange(n)))
        f = np.linalg.cholesky((scale + scale.T) / 2) @ a
        return f @ f.T

    def above(self, low: np.ndarray) -> np.ndarray:
        """Standard normals larger than low: plain rejection where that is likely, else from an exponential (Robert 1995)."""
        low = np.asarray(low, float)
        out = np.empty(low.shape)
        todo = np.ones(low.shape, bool)
        while todo.any():
            a = low[todo]
            rate = (a + np.sqrt(a * a + 4)) / 2
            tail = a > 0.5
            x = np.where(tail, a + self.g.standard_exponential(a.shape) / rate, self.g.standard_normal(a.shape))
            ok = np.where(tail, self.uniform(a.shape) <= np.exp(-((x - rate) ** 2) / 2), x > a)
            where = np.argwhere(todo)[ok]
            out[tuple(where.T)] = x[ok]
            todo[tuple(where.T)] = False
        return out


def polya_gamma_moments(h: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of PG(h, z), in a form that stays exact for large |z|."""
    a = np.abs(z)
    small = a < 1e-2
    s = np.where(small, 1.0, a)
    e = np.exp(-s)
    half_tanh, sech2 = (1 - e) / (1 + e), 4 * e / (1 + e) ** 2
    mean = np.where(small, h / 4 * (1 - a * a / 12), h * half_tanh / (2 * s))
    var = np.where(small, h / 24 * (1 - a * a / 5), h * (2 * half_tanh - s * sech2) / (4 * s**3))
    return mean, np.sqrt(var)


def log_cdf(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the normal distribution function, and its derivative."""
    from math import erfc

    x = np.asarray(x, float)
    tail = x < -30
    safe = np.where(tail, 0.0, x)
    p = 0.5 * np.vectorize(erfc, otypes=[float])(-safe / np.sqrt(2))
    far = np.where(tail, x, -40.0)
    log_far = -far * far / 2 - np.log(-far) - 0.5 * np.log(2 * np.pi) + np.log1p(-1 / far**2)
    log_p = np.where(tail, log_far, np.log(np.maximum(p, 1e-300)))
    return log_p, np.exp(-x * x / 2 - 0.5 * np.log(2 * np.pi) - log_p)
