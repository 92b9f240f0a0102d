"""One Markov chain from start to last draw."""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from time import perf_counter

import numpy as np

from quadrat.kernels import hmc
from quadrat.kernels import updates as u
from quadrat.kernels.random import Noise
from quadrat.kernels.state import Model, start

#: What a draw holds, by the axes of its values after the level.
RECORDED = ("Beta", "Gamma", "iV", "rho", "sigma", "Eta", "Lambda", "Psi", "Delta", "Alpha", "BetaSel", "wRRR", "PsiRRR", "DeltaRRR")


def run(model: Model, chain: int, samples: int, transient: int = 0, thin: int = 1, seed: int = 0, *, first: dict | None = None, marginal_counts: bool = False, joint: bool = False, hmc_every: int = 0, leaps: int = 10, held: dict | None = None, until: int | None = None, seconds: dict | None = None) -> Iterator[tuple[int, dict]]:
    """(draw, parameters) for each recorded iteration: those after the transient phase, every thin-th.

    The generator of each update depends on seed, chain, iteration and update only. held: where the chain stands, kept up
    to date after each iteration, first is left as it is; with it, a chain that was ended before iteration `until` goes on as if
    it had not been. seconds: filled with [calls, seconds] by name of update.
    """
    held = {} if held is None else held
    if "p" not in held:
        held.update(p=deepcopy(first) if first else start(model, Noise(seed, chain, 0, 99)), step=hmc.Step(), next=0)

    def do(update, k: int, *more):
        began = perf_counter()
        out = update(model, p, Noise(seed, chain, it + 1, k), *more)
        if seconds is not None:
            told = seconds.setdefault(update.__name__, [0, 0.0])
            told[0], told[1] = told[0] + 1, told[1] + perf_counter() - began
        return out

    p, step, last = held["p"], held["step"], transient + samples * thin
    for it in range(held["next"], last if until is None else min(until, last)):
        if hmc_every and it % hmc_every == 0:
            chance = do(hmc.move, 0, step, leaps)
            if it < 0.8 * transient:
                step.tune(chance)
            elif it - hmc_every < 0.8 * transient:
                step.freeze()
            do(u.update_lambda_priors, 1)
            do(u.update_alpha, 2)
        do(u.update_z, 3, marginal_counts)
        do(u.update_beta_lambda, 4)
        if joint:
            do(u.update_beta_eta, 5)
        do(u.update_rrr, 6)
        do(u.update_rrr_priors, 7)
        do(u.update_selection, 8)
        do(u.update_gamma_v, 9)
        do(u.update_rho, 10)
        do(u.update_lambda_priors, 11)
        do(u.update_eta, 12)
        do(u.update_alpha, 13)
        do(u.update_sigma, 14)
        if it < transient:
            do(u.update_nf, 15, it)
        if it >= transient and (it - transient + 1) % thin == 0:
            yield (it - transient + 1) // thin - 1, p
        held["next"] = it + 1


def cells(p: dict, keep_eta: bool = True) -> Iterator[tuple[str, int, np.ndarray]]:
    """(parameter, level, values as a matrix) of a draw; -1 as level where there is none. Loadings that depend on covariates
    have these as a third axis."""
    for name in RECORDED:
        if name not in p or (name == "Eta" and not keep_eta):
            continue
        of_level = isinstance(p[name], list)
        for level, v in enumerate(p[name]) if of_level else [(-1, p[name])]:
            v = np.asarray(v, float)
            yield name, level, v if v.ndim == 3 else v.reshape(len(v), -1)
