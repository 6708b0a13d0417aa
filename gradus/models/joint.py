"""Several smooth fits that share their passes over the rows.

Folds of a cross-validation, classes of a one-vs-rest machine: each is a problem with a
weight vector of its own.  ``minimise`` runs L-BFGS on all of them at once; a pass
evaluates loss and gradient of every problem at its own trial point, so the number of
scans does not grow with the number of problems.  ``newton`` does the same with second
derivatives, for problems of few weights: a pass costs more, but some ten are enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .boosting import softmax
from .passes import matrix, packed, summed

MEMORY = 10


def _direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, back = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        back.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(back)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def minimise(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, max_iter: int,
             tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, int]:
    """Minima of the problems (rows of ``start``), their losses, and the passes used.

    ``evaluate`` gives all losses and gradients at a row of weights for each problem.  A
    step that does not lower a problem's loss enough is halved in the next pass, while
    the others go on.
    """
    W = start.copy()
    f, G = evaluate(W)
    pairs: list[list] = [[] for _ in W]
    size = np.minimum(1.0, 1.0 / np.maximum(np.abs(G).sum(axis=1), 1e-12))
    passes = 1
    for _ in range(max_iter):
        busy = (np.abs(G).max(axis=1) > tolerance) & (size > 1e-8)
        if not busy.any():
            break
        D = np.stack([_direction(G[p], pairs[p]) if busy[p] else np.zeros_like(W[p]) for p in range(len(W))])
        trial = W + size[:, None] * D
        f2, G2 = evaluate(trial)
        passes += 1
        for p in np.flatnonzero(busy):
            if not f2[p] <= f[p] + 1e-4 * size[p] * (G[p] @ D[p]):
                size[p] *= 0.5
                continue
            s, y = trial[p] - W[p], G2[p] - G[p]
            if s @ y > 1e-12:
                pairs[p] = [*pairs[p][1 - MEMORY:], (s, y)]
            W[p], f[p], G[p], size[p] = trial[p], f2[p], G2[p], 1.0
    return W, f, passes


def _newton_step(g: np.ndarray, H: np.ndarray) -> np.ndarray:
    """Least step to the minimum of the quadratic; directions without curvature are left alone."""
    values, vectors = np.linalg.eigh(H)
    keep = values > 1e-12 * max(values.max(), 1e-300)
    return -vectors[:, keep] @ ((vectors[:, keep].T @ g) / values[keep])


def newton(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], start: np.ndarray, max_iter: int,
           tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, int]:
    """``minimise`` for convex problems whose ``evaluate`` gives second derivatives, too."""
    W = start.copy()
    f, G, H = evaluate(W)
    D = np.stack([_newton_step(G[p], H[p]) for p in range(len(W))])
    size, passes = np.ones(len(W)), 1
    for _ in range(max_iter):
        busy = (np.abs(G).max(axis=1) > tolerance) & (size > 1e-8)
        if not busy.any():
            break
        trial = np.where(busy[:, None], W + size[:, None] * D, W)
        f2, G2, H2 = evaluate(trial)
        passes += 1
        for p in np.flatnonzero(busy):
            if not f2[p] <= f[p] + 1e-4 * size[p] * (G[p] @ D[p]):
                size[p] *= 0.5
                continue
            W[p], f[p], G[p], size[p] = trial[p], f2[p], G2[p], 1.0
            D[p] = _newton_step(G2[p], H2[p])
    return W, f, passes


# ---------------------------------------------------- logistic model by folds
def _logistic(batches: Iterator[pa.RecordBatch], W: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Losses, gradients, then second derivatives of every fold's model over the rows outside its fold.

    The latter by pairs of classes a <= b, each a matrix of columns.
    """
    folds = len(W)
    k, d = weight.shape[1], len(mean)
    loss, G, H = np.zeros(folds), np.zeros((folds, d + 1, k)), np.zeros((folds, k * (k + 1) // 2, d + 1, d + 1))
    for b in batches:
        if not b.num_rows:
            continue
        X = np.concatenate([(matrix(b.column("x")) - mean) / scale, np.ones((b.num_rows, 1))], axis=1)
        y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
        for f in range(folds):
            own = fold != f
            Z, at = X[own], (np.arange(own.sum()), y[own])
            P = softmax(Z @ W[f].reshape(d + 1, k))
            w = weight[f][y[own]]
            loss[f] -= (w * np.log(np.maximum(P[at], 1e-300))).sum()
            for i, (a, c) in enumerate(zip(*np.triu_indices(k))):
                H[f, i] += Z.T @ (Z * (w * P[:, a] * ((a == c) - P[:, c]))[:, None])
            P[at] -= 1
            G[f] += Z.T @ (P * w[:, None])
    return np.concatenate([loss, G.ravel(), H.ravel()])


def logistic_by_folds(df: DataFrame, folds: int, k: int = 4, fold_col: str = "fold", max_iter: int = C.LR_MAX_ITER, c: float = 1.0,
                      weighted: bool = True) -> dict:
    """Multinomial logistic models, one for each fold left out, fitted together.

    Each minimises the (balanced) weighted log-loss plus ``|coefficients|^2 / 2c`` as a fit
    of its own would.  Gives coefficients (fold, class, feature), intercepts, the accuracy
    on each fold and the number of passes.
    """
    x = df.select(F.col("label").cast("int").alias("y"), F.col(fold_col).cast("int").alias("fold"), vector_to_array("features").alias("x"))
    d = len(x.first()["x"])
    rows = packed(x)
    counts = np.zeros((folds, k))
    for r in x.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["fold"], r["y"]] = r["n"]
    left = counts.sum(axis=0) - counts
    present = np.maximum((left > 0).sum(axis=1, keepdims=True), 1)
    weight = np.where(left > 0, left.sum(axis=1, keepdims=True) / (present * np.maximum(left, 1)), 0.0) if weighted else np.ones((folds, k))
    total = (weight * left).sum(axis=1)

    def moments(batches):
        out = np.zeros(2 * d + 1)
        for b in batches:
            X = matrix(b.column("x")).reshape(-1, d)
            out += np.concatenate([X.sum(axis=0), (X * X).sum(axis=0), [len(X)]])
        return out

    # columns are scaled for the steps only: the penalty is that of the raw coefficients
    sums = summed(rows, 2 * d + 1, moments)
    mean = sums[:d] / sums[-1]
    scale = np.sqrt(np.maximum(sums[d:2 * d] / sums[-1] - mean ** 2, 0))
    scale[scale < 1e-9] = 1.0
    pull = np.concatenate([np.repeat(1 / (c * scale ** 2), k), np.zeros(k)])

    pairs, m = list(zip(*np.triu_indices(k))), (d + 1) * k

    def evaluate(W):
        parts = summed(rows, folds + folds * m + folds * len(pairs) * (d + 1) ** 2,
                       lambda batches: _logistic(batches, W, mean, scale, weight))
        loss, G, second = np.split(parts, [folds, folds + folds * m])
        second = second.reshape(folds, len(pairs), d + 1, d + 1)
        H = np.zeros((folds, d + 1, k, d + 1, k))
        for i, (a, c) in enumerate(pairs):
            H[:, :, a, :, c] = H[:, :, c, :, a] = second[:, i]
        H = H.reshape(folds, m, m) + np.diag(pull)
        return ((loss + 0.5 * (pull * W * W).sum(axis=1)) / total, (G.reshape(folds, m) + pull * W) / total[:, None],
                H / total[:, None, None])

    W, loss, passes = newton(evaluate, np.zeros((folds, m)), max_iter)
    W = W.reshape(folds, d + 1, k)

    def hits(batches):
        out = np.zeros(2 * folds)
        for b in batches:
            if not b.num_rows:
                continue
            X = np.concatenate([(matrix(b.column("x")) - mean) / scale, np.ones((b.num_rows, 1))], axis=1)
            fold = b.column("fold").to_numpy()
            hit = np.einsum("ij,ijk->ik", X, W[fold]).argmax(axis=1) == b.column("y").to_numpy()
            out += np.concatenate([np.bincount(fold, hit, folds), np.bincount(fold, minlength=folds)])
        return out

    got = summed(rows, 2 * folds, hits)
    coef = np.swapaxes(W[:, :d] / scale[None, :, None], 1, 2)
    return {"coefficients": coef, "intercepts": W[:, d] - np.einsum("fkj,j->fk", coef, mean), "losses": loss, "passes": passes,
            "accuracy": got[:folds] / np.maximum(got[folds:], 1)}
