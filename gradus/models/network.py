"""Feed-forward classifier: ReLU layers, softmax, L2, early stopping on a held-out share.

Rows are standardised by the column means and deviations of the training rows.  A hashed
share of the rows (``held``) is never trained on.  An epoch is ``SHARES`` steps; a step is
one pass in which every task adds up the loss gradient over its rows of the step's hashed
share and Spark sums the parts, so a step does not depend on how rows are dealt out.  The
driver holds the weights and moves them by Adam.  Rows are stored by their share, so a step
reads its own and an epoch all rows once.  The pass that opens an epoch also counts
hits on the held-out rows; training ends when ``PATIENCE`` epochs bring no gain of
``TOLERANCE`` or after ``max_iter`` epochs, and the weights of the best epoch are kept.
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
from .boosting import softmax
from .passes import matrix, packed, summed

SHARES, RATE, PATIENCE, TOLERANCE = 8, 0.005, 10, 1e-4


def unpack(w: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def forward(w: np.ndarray, sizes: list[int], X: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer, then the class probabilities."""
    out = [X]
    layers = unpack(w, sizes)
    for i, (W, b) in enumerate(layers):
        z = out[-1] @ W + b
        out.append(softmax(z) if i == len(layers) - 1 else np.maximum(z, 0.0))
    return out


def gradient(w: np.ndarray, sizes: list[int], X: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Summed (not averaged) gradient and loss of the rows, without the penalty."""
    act = forward(w, sizes, X)
    loss = -np.log(np.maximum(act[-1][np.arange(len(y)), y], 1e-300)).sum()
    delta = act[-1].copy()
    delta[np.arange(len(y)), y] -= 1
    parts = []
    layers = unpack(w, sizes)
    for i in reversed(range(len(layers))):
        parts += [delta.sum(axis=0), (act[i].T @ delta).ravel()]
        if i:
            delta = (delta @ layers[i][0].T) * (act[i] > 0)
    return np.concatenate(parts[::-1]), float(loss)


def penalty(w: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The weights with the intercepts set to zero, as the penalty sees them."""
    out = np.concatenate([np.concatenate([W.ravel(), np.zeros_like(b)]) for W, b in unpack(w, sizes)])
    return out


def first_weights(sizes: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _step(batches: Iterator[pa.RecordBatch], w: np.ndarray, sizes: list[int], mean: np.ndarray, scale: np.ndarray, share: int) -> np.ndarray:
    """Gradient, loss and rows of the share; hits and rows of the held-out (share 0 opens an epoch)."""
    out = np.zeros(len(w) + 4)
    for b in batches:
        if not b.num_rows:
            continue
        part, y = b.column("part").to_numpy(), b.column("y").to_numpy()
        X = (matrix(b.column("x")) - mean) / scale
        own = part == share
        if own.any():
            g, loss = gradient(w, sizes, X[own], y[own])
            out += np.concatenate([g, [loss, own.sum(), 0, 0]])
        held = part < 0
        if share == 0 and held.any():
            hit = forward(w, sizes, X[held])[-1].argmax(axis=1) == y[held]
            out[-2:] += hit.sum(), len(hit)
    return out


def fit(train: DataFrame, k: int = 4, hidden=C.MLP_HIDDEN, max_iter: int = C.MLP_MAX_ITER, alpha: float = C.MLP_ALPHA,
        held: float = C.MLP_VALIDATION, seed: int = C.SEED, rate: float = RATE) -> dict:
    """The fitted model as arrays: sizes, weights, mean, scale, and by epoch losses and held-out accuracy."""
    x = train.select(F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"))
    draw = F.pmod(F.xxhash64("x", "y", F.lit(seed), F.lit("part")), F.lit(1_000_000))
    cut = round(held * 1_000_000)
    first = x.first()
    if first is None:
        raise ValueError("no rows to fit")
    rows = packed(x.withColumn("part", F.when(draw < cut, -1).otherwise(draw % SHARES).cast("int")), by="part")
    d = len(first["x"])

    def moments(batches):
        out = np.zeros(2 * d + 1)
        for b in batches:
            X = matrix(b.column("x")).reshape(-1, d)
            out += np.concatenate([X.sum(axis=0), (X * X).sum(axis=0), [len(X)]])
        return out

    sums = summed(rows.where("part >= 0"), 2 * d + 1, moments)
    mean = sums[:d] / max(sums[-1], 1)
    scale = np.sqrt(np.maximum(sums[d:2 * d] / max(sums[-1], 1) - mean ** 2, 0))
    scale[scale < 1e-9] = 1.0
    sizes = [d, *hidden, k]
    w = best_w = first_weights(sizes, seed)
    m1, m2, step, best, waited, losses, scores = np.zeros_like(w), np.zeros_like(w), 0, -np.inf, 0, [], []
    shares = [rows.where(F.col("part").isin(-1, 0) if share == 0 else F.col("part") == share) for share in range(SHARES)]
    for _ in range(max_iter):
        epoch_loss = epoch_rows = 0.0
        before = w
        for share, own in enumerate(shares):
            got = summed(own, len(w) + 4, lambda batches, a=(w, sizes, mean, scale, share): _step(batches, *a))
            g, (loss, n, hits, tested) = got[:-4], got[-4:]
            if share == 0 and tested:
                scores.append(hits / tested)
                waited = waited + 1 if scores[-1] < best + TOLERANCE else 0
                if scores[-1] > best:
                    best, best_w = scores[-1], before
                if waited >= PATIENCE:
                    return _model(best_w, sizes, mean, scale, losses, scores)
            if not n:
                continue
            small = penalty(w, sizes)
            g = (g + alpha * small) / n
            epoch_loss, epoch_rows = epoch_loss + loss + 0.5 * alpha * float(small @ small), epoch_rows + n
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            w = w - rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * m1 / (np.sqrt(m2) + 1e-8)
        losses.append(epoch_loss / max(epoch_rows, 1))
    # the last epoch's weights have not been tested: one more pass
    got = summed(rows.where("part < 0"), len(w) + 4, lambda batches: _step(batches, w, sizes, mean, scale, 0))
    if not got[-1] or got[-2] / got[-1] >= best:
        best_w = w
    return _model(best_w, sizes, mean, scale, losses, scores)


def _model(w, sizes, mean, scale, losses, scores) -> dict:
    return {"sizes": np.array(sizes), "weights": w, "mean": mean, "scale": scale, "losses": np.array(losses), "held_out": np.array(scores)}


def probabilities(model: dict):
    """A column function from array<double> to class probabilities."""
    sizes = [int(s) for s in model["sizes"]]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def proba(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(forward(model["weights"], sizes, (np.stack(x.to_numpy()) - model["mean"]) / model["scale"])[-1]))

    return proba
