"""Ridge logistic regressions of many bootstrap replicates at once.

The table itself is fitted first, and the replicates start from its coefficients.
One scan sums the gradient (and, in the first step, the Hessian) blocks of all replicates' current
coefficients; the Newton steps are solved on the driver, whose share is
replicates x (2 x features + 1)^2 numbers, whatever the rows.

Every replicate has its own medians, robust scales and balanced class weights,
as if its rows had been drawn out and prepared.  Rows aren't scaled B times for
that: with z = (x - median) / IQR a ridge penalty on the coefficients of z is a
penalty IQR^2 on those of x, and a missing x adds median x coefficient, which is
linear in the indicator of missing values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortlens.operators.replicates import EXTRA, KEY, Draws, filled_quartiles, replicate_sums

#: Replicates whose sums travel in one row.
GROUP = 32


@dataclass(frozen=True)
class Fits:
    """Row b of each array is replicate b (0: the table itself)."""

    coef: np.ndarray  # of the scaled features
    intercept: np.ndarray
    medians: np.ndarray
    scales: np.ndarray
    class_weights: np.ndarray  # of labels 0 and 1
    fitted: np.ndarray  # False where a replicate has one class only


def _sums(rows, plan, n_features: int, theta: np.ndarray, class_weights: np.ndarray, curved: bool = True):
    """(loss, gradient, Hessian or None unless ``curved``) of every replicate over the columns 1, x (missing: 0), x is missing."""
    k = 2 * n_features + 1
    up = np.triu_indices(k)
    names = [f"x{i}" for i in range(n_features)]
    width = 1 + k + (len(up[0]) if curved else 0)

    def run(batches):
        total = np.zeros((len(theta), width))
        for part, w in plan.blocks(batches):
            x = part[names].to_numpy(dtype=np.float64)
            lost = np.isnan(x)
            d = np.hstack([np.ones((len(x), 1)), np.where(lost, 0.0, x), lost])
            positive = part["y"].to_numpy(dtype=np.float64) == 1
            side = np.where(positive, 1.0, -1.0)[:, None]
            w[positive] *= class_weights[:, 1]
            w[~positive] *= class_weights[:, 0]
            # the probability of the row's own label: its loss is -log of it
            own = (d * -side) @ theta.T
            np.clip(own, -700, 700, out=own)
            np.exp(own, out=own)
            own += 1.0
            np.reciprocal(own, out=own)
            total[:, 0] -= np.einsum("ij,ij->j", w, np.log(own))
            w *= 1.0 - own
            total[:, 1:k + 1] -= w.T @ (d * side)
            if curved:
                w *= own
                total[:, k + 1:] += w.T @ (d[:, up[0]] * d[:, up[1]])
        for g in range(0, len(total), GROUP):
            yield pd.DataFrame({"g": [g], "v": [total[g:g + GROUP].ravel()]})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": b["g"].iloc[:1], "v": [np.sum(np.stack(b["v"].to_list()), axis=0)]})

    got = rows.mapInPandas(run, "g int, v array<double>").groupBy("g").applyInPandas(add, "g int, v array<double>").collect()
    total = np.zeros((len(theta), width))
    for r in got:
        total[r["g"]:r["g"] + GROUP] = np.asarray(r["v"]).reshape(-1, total.shape[1])
    if not curved:
        return total[:, 0], total[:, 1:k + 1], None
    hessian = np.zeros((len(theta), k, k))
    hessian[:, up[0], up[1]] = total[:, k + 1:]
    hessian[:, up[1], up[0]] = total[:, k + 1:]
    return total[:, 0], total[:, 1:k + 1], hessian


def fit_replicates(draws: Draws, features: Sequence[str], label: str = "label", C: float = 1.0, tol: float = 1e-9,
                   max_iter: int = 50) -> Fits:
    """Minimise 0.5 |coef|^2 + C sum(weight x log loss) for the table itself and every replicate.

    Rows need labels 0 or 1.  A Newton step that doesn't lower a replicate's objective is
    halved; a replicate is done when its gradient is below ``tol`` x its total weight.  A replicate
    with one class only isn't fitted.
    """
    draws, d = draws.with_original(), len(features)
    known = {f"known{i}": F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double")) for i, c in enumerate(features)}
    counts = replicate_sums(draws, {"n": F.lit(1), "n1": F.col(label), **known}).orderBy("replicate").toPandas()
    n, n1 = counts["n"].to_numpy(), counts["n1"].to_numpy()
    fitted = (n1 > 0) & (n1 < n)
    with np.errstate(divide="ignore"):
        class_weights = np.where(fitted[:, None], n[:, None] / (2.0 * np.stack([n - n1, n1], axis=1)), 0.0)
    med, iqr = (a.T for a in filled_quartiles(draws, features, n, {c: counts[f"known{i}"].to_numpy() for i, c in enumerate(features)}))
    rows = draws.rows.select(KEY, EXTRA, F.col(label).cast("double").alias("y"),
                             *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    # (1, x, missing) = A (1, z): the scaled features' coefficients beta give theta = (b - beta m / s, beta / s, beta m / s)
    a = np.zeros((len(n), 2 * d + 1, d + 1))
    own = np.arange(d)
    a[:, 0, 0] = 1.0
    a[:, 0, 1:] = -med / iqr
    a[:, 1 + own, 1 + own] = 1.0 / iqr
    a[:, 1 + d + own, 1 + own] = med / iqr
    whole = replace(draws.plan, n_replicates=0)
    one = _newton(rows, whole, a[:1], class_weights[:1], C * n[:1], np.zeros((1, d + 1)), fitted[:1], C, tol, max_iter, fresh=True)
    # replicates lie about 1 / sqrt(rows) around the table's own fit: from there the first Hessian serves several steps
    at = _newton(rows, draws.plan, a, class_weights, C * n, np.repeat(one, len(n), axis=0), fitted, C, tol, max_iter)
    at[~fitted] = 0.0
    return Fits(at[:, 1:], at[:, 0], med, iqr, class_weights, fitted)


def _newton(rows, plan, a: np.ndarray, class_weights: np.ndarray, size: np.ndarray, start: np.ndarray, fitted: np.ndarray, C: float,
            tol: float, max_iter: int, fresh: bool = False) -> np.ndarray:
    """Intercepts and scaled coefficients of the replicates of ``plan``, from ``start``.

    The Hessian is summed anew when a replicate's gradient fell to no less than a tenth, or, with ``fresh``, at every step.
    """
    d = a.shape[2] - 1
    penalty = np.r_[0.0, np.ones(d)]
    at, best = start.copy(), np.full(len(start), np.inf)
    step, h = np.zeros_like(at), np.zeros((len(start), d + 1, d + 1))
    share, moving, steep, curved = np.ones(len(start)), fitted.copy(), np.full(len(start), np.inf), True
    for _ in range(max_iter):
        if not moving.any():
            break
        trial = at + share[:, None] * step
        loss, gradient, hessian = _sums(rows, plan, d, np.einsum("bij,bj->bi", a, trial), class_weights, curved)
        value = C * loss + 0.5 * (penalty * trial**2).sum(axis=1)
        # sums of equal losses differ in their last digits
        better = moving & (value <= best + 1e-12 * np.abs(best)) if np.isfinite(best).any() else moving
        share = np.where(moving & ~better, 0.5 * share, 1.0)
        at[better], best[better] = trial[better], value[better]
        g = C * np.einsum("bij,bi->bj", a, gradient) + penalty * trial
        if curved:
            now = C * np.einsum("bij,bik,bkl->bjl", a, hessian, a) + np.diag(penalty)
            now[:, 0, 0] += 1e-12
            h[better] = now[better]
        slope = np.abs(g).max(axis=1)
        solved = better & (slope > tol * np.maximum(1.0, size))
        curved = fresh or bool((solved & (slope > 0.1 * steep)).any() or (moving & ~better).any())
        steep[better] = slope[better]
        if solved.any():
            step[solved] = -np.linalg.solve(h[solved], g[solved][:, :, None])[:, :, 0]
        moving = solved | (moving & ~better & (share > 1e-6))
    return at
