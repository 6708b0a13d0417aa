"""Multinomial gradient boosting on binned features, all classes' trees grown together.

A round adds one regression tree for each class, fitted to the residuals ``y - p`` of the
class probabilities (softmax of the summed trees), with a hashed share of the rows.  The
trees grow level by level.  Each level is one pass: tasks add up rows, residuals and
``|r| (1 - |r|)`` by (class, node, feature, bin), Spark sums them, and the driver, which
sees these sums only, takes the cut of largest improvement
``n_l n_r / (n_l + n_r) (mean_l - mean_r)^2``.  A leaf's value is the Newton step
``(K - 1) / K  sum r / sum |r| (1 - |r|)``.

Bins: a column of at most ``BINS`` values is cut between all of them, so cuts are those
of a search over all values; others at percentiles.  A row's bins are one byte a column;
scores of earlier rounds are stored every ``KEEP`` rounds, and a task replays later trees.
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
from ..session import stored
from .passes import byte_matrix, matrix, spread, summed

BINS, KEEP = 64, 10
LEAST = 1e-12  # improvement


def bin_edges(rows: DataFrame, d: int) -> list[np.ndarray]:
    """Upper edges of the bins of every column of ``x``: value <= edge falls below."""
    x = [F.get("x", F.lit(j)) for j in range(d)]
    distinct = rows.agg(*[F.approx_count_distinct(c).alias(str(j)) for j, c in enumerate(x)]).first()
    few = [j for j in range(d) if distinct[j] <= BINS * 3 // 4]
    # lists of about BINS values at most, the rest by percentiles
    cuts = rows.agg(*[(F.array_sort(F.collect_set(c)) if j in few else
                       F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10_000)).alias(str(j)) for j, c in enumerate(x)]).first()
    out = []
    for j in range(d):
        v = np.unique(np.array(cuts[j] or [], float))
        out.append(((v[1:] + v[:-1]) / 2)[:255] if j in few else v)
    return out


def to_bins(X: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, X[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def softmax(S: np.ndarray) -> np.ndarray:
    e = np.exp(S - S.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaves(tree: dict, B: np.ndarray) -> np.ndarray:
    """Heap position of every row: ``dim`` < 0 is a leaf, ``cut`` a bin."""
    node = np.ones(len(B), np.int64)
    for _ in range(tree["depth"]):
        dim = tree["dim"][node]
        inner = dim >= 0
        right = B[np.arange(len(B)), np.maximum(dim, 0)] > tree["cut"][node]
        node = np.where(inner, 2 * node + right, node)
    return node


def new_tree(depth: int) -> dict:
    return {"depth": depth, "dim": np.full(2 << depth, -1, np.int16), "cut": np.zeros(2 << depth, np.int16),
            "value": np.zeros(2 << depth), "gain": np.zeros(2 << depth)}


def best_cut(n: np.ndarray, g: np.ndarray) -> tuple[float, int, int]:
    """(improvement, feature, bin) from rows and residuals by (feature, bin).

    Of equals the first is taken, and a billionth apart is equal: sums that Spark adds in
    another order must not choose another cut.
    """
    nl, gl = np.cumsum(n, axis=1)[:, :-1], np.cumsum(g, axis=1)[:, :-1]
    nr, gr = n.sum(axis=1, keepdims=True) - nl, g.sum(axis=1, keepdims=True) - gl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2
    gain = np.where((nl > 0) & (nr > 0), gain, -1.0)
    at = int((gain >= gain.max() - 1e-9 * abs(gain.max())).argmax()) if gain.size else 0
    return (float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]) if gain.size else (-1.0, 0, 0)


def _level(batches: Iterator[pa.RecordBatch], trees: list, growing: list, level: int, k: int, d: int, bins: int, step: float,
           share: int, salt: int) -> np.ndarray:
    """Sums (class, node, feature, bin, [rows, residuals, weights]) of one level, then deviance and rows."""
    width = 1 << level
    out = np.zeros((k, width, d, bins, 3))
    deviance = count = 0.0
    for b in batches:
        if not b.num_rows:
            continue
        y, B = b.column("y").to_numpy(), byte_matrix(b.column("bins"))
        S = matrix(b.column("score")).copy()
        for own in trees:
            for c, tree in enumerate(own):
                S[:, c] += step * tree["value"][leaves(tree, B)]
        P = softmax(S)
        deviance -= np.log(np.maximum(P[np.arange(len(y)), y], 1e-300)).sum()
        count += len(y)
        # the round's share of the rows, from the row's hash
        u = (b.column("u").to_numpy().view(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        own = (u >> np.uint64(44)).astype(np.int64) < share
        B, y, P = B[own], y[own], P[own]
        for c in range(k):
            r = (y == c) - P[:, c]
            w = np.abs(r) * (1 - np.abs(r))
            node = leaves(growing[c], B) - width
            live = node >= 0
            node, r, w, X = node[live], r[live], w[live], B[live]
            for j in range(d):
                at = node * bins + X[:, j]
                for m, v in enumerate((None, r, w)):
                    out[c, :, j, :, m] += np.bincount(at, v, width * bins).reshape(width, bins)
    return np.concatenate([out.ravel(), [deviance, count]])


def fit(train: DataFrame, k: int = 4, rounds: int = C.GBT_ROUNDS, depth: int = C.GBT_DEPTH, step: float = C.GBT_STEP,
        subsample: float = C.GBT_SUBSAMPLE, seed: int = C.SEED) -> dict:
    """The fitted model as arrays: edges, dim, cut, value, gain (round, class, node), start, losses."""
    x = train.select(F.col("label").cast("int").alias("y"), vector_to_array("features").alias("x"))
    rows = spread(x.withColumn("u", F.xxhash64("x", "y", F.lit(seed))))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit")
    d = len(first["x"])
    edges = bin_edges(rows, d)
    bins = max(len(e) for e in edges) + 1
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    start = np.log([max(counts.get(c, 0) / total, 1e-15) for c in range(k)])

    def binned(batches):
        for b in batches:
            B = to_bins(matrix(b.column("x")).reshape(-1, d), edges)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("u"), pa.array([r.tobytes() for r in B], pa.binary()),
                                              pa.array([start.tolist()] * len(B), pa.list_(pa.float64()))], names=["y", "u", "bins", "score"])

    def scored(trees):
        def add(batches):
            for b in batches:
                B, S = byte_matrix(b.column("bins")), matrix(b.column("score")).reshape(-1, k).copy()
                for own in trees:
                    for c, tree in enumerate(own):
                        S[:, c] += step * tree["value"][leaves(tree, B.reshape(-1, d))]
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("u"), b.column("bins"), pa.array(list(S), pa.list_(pa.float64()))],
                                                 names=["y", "u", "bins", "score"])
        return add

    schema = "y int, u long, bins binary, score array<double>"
    state = stored(rows.mapInArrow(binned, schema), "boosting")
    share, done, pending, losses = round(subsample * (1 << 20)), [], [], []
    for m in range(rounds):
        growing = [new_tree(depth) for _ in range(k)]
        for level in range(depth):
            width = 1 << level
            for tree in growing:
                tree["depth"] = level
            salt = (seed * 1_000_003 + m * 7919 + 12345) * 0x9E3779B1 & (1 << 64) - 1
            args = (list(pending), growing, level, k, d, bins, step, share, salt)
            sums = summed(state, k * width * d * bins * 3 + 2, lambda batches, a=args: _level(batches, *a))
            hist = sums[:-2].reshape(k, width, d, bins, 3)
            if level == 0:
                losses.append(sums[-2] / sums[-1])
            for c, tree in enumerate(growing):
                for node in range(width):
                    n, g, w = (hist[c, node, :, :, i] for i in range(3))
                    if level and tree["dim"][(width + node) // 2] < 0:
                        continue
                    whole = n[0].sum(), g[0].sum(), w[0].sum()
                    gain, j, cut = best_cut(n, g) if whole[0] > 1 else (-1.0, 0, 0)
                    at = width + node
                    tree["value"][at] = _newton(whole[1], whole[2], k)
                    if gain <= LEAST:
                        continue
                    tree["dim"][at], tree["cut"][at], tree["gain"][at] = j, cut, gain
                    for side, own in ((2 * at, slice(0, cut + 1)), (2 * at + 1, slice(cut + 1, None))):
                        tree["value"][side] = _newton(g[j, own].sum(), w[j, own].sum(), k)
        for tree in growing:
            tree["depth"] = depth
        done.append(growing)
        pending.append(growing)
        if len(pending) == KEEP:
            state, pending = stored(state.mapInArrow(scored(pending), schema), "boosting"), []
    pack = lambda name: np.array([[t[name] for t in own] for own in done])
    return {"start": start, "step": np.array([step]), "edge_ends": np.cumsum([len(e) for e in edges]), "edges": np.concatenate(edges),
            "losses": np.array(losses), **({n: pack(n) for n in ("dim", "cut", "value", "gain")} if done else {})}


def _newton(g: float, w: float, k: int) -> float:
    return (k - 1) / k * g / w if w > 1e-150 else 0.0


def scores(model: dict, X: np.ndarray) -> np.ndarray:
    """Summed trees of every class for rows of features."""
    edges = np.split(model["edges"], model["edge_ends"][:-1].astype(int))
    B = to_bins(X, edges)
    S = np.repeat(model["start"][None, :], len(X), axis=0)
    if "dim" in model:
        depth = model["dim"].shape[2].bit_length() - 2
        for m in range(len(model["dim"])):
            for c in range(S.shape[1]):
                tree = {"depth": depth, "dim": model["dim"][m, c].astype(int), "cut": model["cut"][m, c]}
                S[:, c] += model["step"][0] * model["value"][m, c][leaves(tree, B)]
    return S


def probabilities(model: dict):
    """A column function from array<double> to class probabilities."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def proba(x: pd.Series) -> pd.Series:
        return pd.Series(list(softmax(scores(model, np.stack(x.to_numpy()))))) if len(x) else pd.Series([], dtype=object)

    return proba


def importances(model: dict, d: int) -> np.ndarray:
    """Improvements by feature, each tree's share of one, averaged over all trees."""
    out = np.zeros(d)
    for m in range(len(model.get("dim", []))):
        for dim, gain in zip(model["dim"][m].astype(int), model["gain"][m]):
            if gain.sum() > 0:
                np.add.at(out, dim[dim >= 0], gain[dim >= 0] / gain.sum())
    return out / out.sum() if out.sum() > 0 else out
