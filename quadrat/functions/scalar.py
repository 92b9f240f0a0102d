"""Scalar functions on columns that both engines and the kernels agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted(w: Column, x: Column) -> Column:
    """w x, and 0 wherever w is 0, whatever x is."""
    return F.when(w != 0, w * x).otherwise(0.0)


def decay(d: Column, alpha: Column) -> Column:
    """exp(-d / alpha); at alpha 0, 1 at distance 0 and else 0."""
    return F.when(alpha == 0, F.when(d == 0, 1.0).otherwise(0.0)).otherwise(F.exp(-d / F.when(alpha != 0, alpha)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(0.0)


def polya_gamma(h: Column, z: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of the Polya-Gamma distribution, stable for any z."""
    a = F.abs(z)
    s = F.when(a < 1e-2, 1.0).otherwise(a)
    e = F.exp(-s)
    half, sech2 = (1 - e) / (1 + e), 4 * e / ((1 + e) * (1 + e))
    mean = F.when(a < 1e-2, h / 4 * (1 - a * a / 12)).otherwise(h * half / (2 * s))
    var = F.when(a < 1e-2, h / 24 * (1 - a * a / 5)).otherwise(h * (2 * half - s * sech2) / (4 * s * s * s))
    return mean, F.sqrt(var)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + 0.0


def recorded(iteration: Column, transient: int, thin: int) -> Column:
    return (iteration >= transient) & ((iteration - transient + 1) % thin == 0)


def draw_of(iteration: Column, transient: int, thin: int) -> Column:
    return F.floor((iteration - transient + 1) / thin).cast("int") - 1
