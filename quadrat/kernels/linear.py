"""Draws from a normal distribution whose precision is only known as a product with a vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def solve(times: Callable, rhs: np.ndarray, near: Callable, tol: float = 1e-11) -> np.ndarray:
    """Conjugate gradients for a positive definite times(x) = rhs, with near(r) an approximate inverse.

    Stops when the residual, as near() weighs it, has shrunk by tol, and raises if it never does.
    """
    x, r = np.zeros_like(rhs), rhs.copy()
    z = near(r)
    d, rz = z, float(r @ z)
    end = tol**2 * rz
    for _ in range(20 * len(rhs) + 100):
        if rz <= end:
            return x
        ad = times(d)
        step = rz / float(d @ ad)
        x, r = x + step * d, r - step * ad
        z = near(r)
        rz, before = float(r @ z), rz
        d = z + rz / before * d
    raise ArithmeticError(f"conjugate gradients did not converge on {len(rhs)} unknowns")


def blocks_times(blocks: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[n, a, a] by [n, a]."""
    return np.matmul(blocks, x[..., None])[..., 0]


def root_times(blocks: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A root of each (possibly singular) block, by z [n, a]. Blocks that are one and the same are rooted once."""
    one = blocks[:1] if blocks.strides[0] == 0 else blocks
    value, vector = np.linalg.eigh(one)
    return np.matmul(vector * np.sqrt(np.maximum(value, 0))[:, None, :], z[..., None])[..., 0]
