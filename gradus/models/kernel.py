"""RBF-kernel machine on landmark (Nystroem) features, calibrated out of fold.

The kernel is approximated by ``k(x, L) M`` with ``M M' = K(L, L)^-1`` for landmarks L, the
rows of smallest hash (``components`` of them, the one bounded sample here; all rows
train).  The error of that approximation on other rows is part of the model.  One machine
for each class (squared hinge, balanced class weights) and one more for each class and
fold are fitted together, a pass for all of them.  A row's margins for the calibration are
those of the machines that have not seen its fold, so no row calibrates a machine that it
trained; probabilities are the sigmoids of the margins, normalised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .joint import minimise
from .passes import list_column, matrix, opened, packed, summed

FOLDS, PROBES, SMALLEST = 3, 200, 1e-8


def rbf(X: np.ndarray, L: np.ndarray, gamma: float) -> np.ndarray:
    # in place: the matrix is a pass's largest, and a new one for each step takes longer than the steps
    out = (X * X).sum(axis=1)[:, None] + (L * L).sum(axis=1)[None, :]
    out -= 2 * X @ L.T
    np.maximum(out, 0, out=out)
    out *= -gamma
    return np.exp(out, out=out)


def landmark_map(L: np.ndarray, gamma: float) -> np.ndarray:
    """M with k(x, L) M M' k(L, y) close to k(x, y); nearly dependent directions are left out."""
    values, vectors = np.linalg.eigh(rbf(L, L, gamma))
    keep = values > SMALLEST * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def kernel_error(X: np.ndarray, L: np.ndarray, M: np.ndarray, gamma: float) -> float:
    """Mean absolute difference of approximate and exact kernel over pairs of rows."""
    if not len(X):
        return 0.0
    Z = rbf(X, L, gamma) @ M
    return float(np.abs(Z @ Z.T - rbf(X, X, gamma)).mean())


def _hinge(batches: Iterator[pa.RecordBatch], V: np.ndarray, bias: np.ndarray, L: np.ndarray, gamma: float, weight: np.ndarray,
           k: int) -> np.ndarray:
    """Losses, then gradients by landmark, then by bias, of the machines (fold, class); fold FOLDS leaves none out."""
    loss, G, g0 = np.zeros(len(V)), np.zeros(V.shape), np.zeros(len(V))
    kind, left_out = np.arange(len(V)) % k, np.arange(len(V)) // k
    for b in batches:
        if not b.num_rows:
            continue
        K = rbf(matrix(b.column("x")), L, gamma)
        y, fold = b.column("y").to_numpy(), b.column("fold").to_numpy()
        sign = np.where(y[:, None] == kind[None, :], 1.0, -1.0)
        used = (fold[:, None] != left_out[None, :]) * weight[y][:, None]
        short = K @ V.T
        short += bias
        short *= -sign
        short += 1.0
        np.maximum(short, 0.0, out=short)
        delta = used * short
        loss += (delta * short).sum(axis=0)
        delta *= sign
        delta *= -2.0
        G += delta.T @ K
        g0 += delta.sum(axis=0)
    return np.concatenate([loss, G.ravel(), g0])


def fit(train: DataFrame, k: int = 4, components: int = 300, max_iter: int = 100, c: float = 1.0, seed: int = C.SEED) -> dict:
    """The fitted machine as arrays: gamma, landmarks, weights, bias, slope, offset, kernel_error."""
    x = train.select(F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"))
    h = F.xxhash64("x", F.lit(seed))
    hashed = x.withColumn("h", h)
    # the smallest hashes first, so that only their rows are moved
    last = hashed.select("h").distinct().orderBy("h").limit(components + PROBES).agg(F.max("h")).first()[0]
    if last is None:
        raise ValueError("no rows to fit")
    near = hashed.where(F.col("h") <= F.lit(last)).select("h", "x").distinct().orderBy("h").limit(components + PROBES)
    picked = np.array([r["x"] for r in near.collect()])
    rows = packed(x.withColumn("fold", F.pmod(F.xxhash64(h, F.lit("fold")), F.lit(FOLDS)).cast("int")))
    L, probes, d = picked[:components], picked[components:], picked.shape[1]
    counts = np.zeros(k)
    for r in x.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["y"]] = r["n"]
    n = counts.sum()
    weight = np.where(counts > 0, n / (np.maximum((counts > 0).sum(), 1) * np.maximum(counts, 1)), 0.0)

    def moments(batches):
        out = np.zeros(2)
        for b in batches:
            X = matrix(b.column("x"))
            out += X.sum(), (X * X).sum()
        return out

    total, square = summed(rows, 2, moments)
    var = square / (n * d) - (total / (n * d)) ** 2
    gamma = 1.0 / (d * var) if var > 0 else 1.0
    M = landmark_map(L, gamma)
    m, r = M.shape
    problems = (FOLDS + 1) * k

    def evaluate(W):
        V, bias = W[:, :r] @ M.T, W[:, r]
        got = summed(rows, problems * (m + 2), lambda batches: _hinge(batches, V, bias, L, gamma, weight, k))
        loss = c * got[:problems] + 0.5 * (W[:, :r] ** 2).sum(axis=1)
        G = c * got[problems:problems * (m + 1)].reshape(problems, m) @ M + W[:, :r]
        return loss / n, np.concatenate([G, c * got[problems * (m + 1):, None]], axis=1) / n

    W, _, passes = minimise(evaluate, np.zeros((problems, r + 1)), max_iter)
    V, bias = W[:, :r] @ M.T, W[:, r]

    def unseen(batches):
        for b in opened(batches):
            K, fold = rbf(matrix(b.column("x")), L, gamma), b.column("fold").to_numpy()
            own = fold[:, None] * k + np.arange(k)
            margins = np.take_along_axis(K @ V.T + bias, own, axis=1)
            yield pa.RecordBatch.from_arrays([b.column("y"), list_column(margins)], names=["y", "margins"])

    margins = packed(rows.mapInArrow(unseen, "y int, margins array<double>"))

    def calibrate(AB):
        def sums(batches):
            out = np.zeros(3 * k)
            for b in batches:
                if not b.num_rows:
                    continue
                m_, y = matrix(b.column("margins")), b.column("y").to_numpy()[:, None] == np.arange(k)
                t = m_ * AB[:, 0] + AB[:, 1]
                delta = 1 / (1 + np.exp(-t)) - y
                out += np.concatenate([(np.logaddexp(0, t) - t * y).sum(axis=0), (delta * m_).sum(axis=0), delta.sum(axis=0)])
            return out
        got = summed(margins, 3 * k, sums)
        return got[:k] / n, got[k:].reshape(2, k).T / n

    AB, _, _ = minimise(calibrate, np.tile([1.0, 0.0], (k, 1)), 50)
    whole = slice(FOLDS * k, problems)
    return {"gamma": np.array([gamma]), "landmarks": L, "weights": V[whole], "bias": bias[whole], "slope": AB[:, 0], "offset": AB[:, 1],
            "present": (counts > 0).astype(float), "kernel_error": np.array([kernel_error(probes, L, M, gamma)]), "passes": np.array([passes])}


def proba(model: dict, X: np.ndarray) -> np.ndarray:
    margins = rbf(X, model["landmarks"], float(model["gamma"][0])) @ model["weights"].T + model["bias"]
    p = model["present"] / (1 + np.exp(-(model["slope"] * margins + model["offset"])))
    whole = p.sum(axis=1, keepdims=True)
    return np.where(whole > 0, p / np.where(whole > 0, whole, 1), 1 / p.shape[1])


def probabilities(model: dict):
    """A column function from array<double> to class probabilities."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(list(proba(model, np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    return of
