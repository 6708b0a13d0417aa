"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

Confirmed toxic texts (P) and unlabelled texts (U) train linear classifiers on
hashed word features in numpy.  With class prior p and logistic loss l the risk is

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

and where the second part of a batch is negative, its gradient is taken upwards.
A word stands for itself and for its first four, five and six letters, so inflected
forms share evidence; a text is the set of its words.

Training rows are a documented, bounded sample: by a hash of the id, about
``max_positive`` of the toxic texts and ``max_unlabelled`` of all.  Each of
``members`` classifiers has the positives and a part of the unlabelled and is
trained in a task of its own; only weights reach the driver.  Scoring
is one pass over all whole texts without a shuffle.  A text's score is the mean of
the members' sigmoids.

Defined cases: null and empty texts get the score of no words; a null id is in no
training sample; labels with null toxic or no document are ignored; without any
toxic or unlabelled training text every score is the class prior; repeated rows
score alike; repeated labels of an id count as toxic if any says so.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns, read, worker_state, WordCache

Z = 4.5
PREFIXES = (4, 5, 6)
MEMBERS = 4
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 16_000
EPOCHS, BATCHES, RATE, DECAY = 25, 16, 0.1, 1e-5
DOCS_PER_STEP = 512
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    """64-bit names of a word's features."""
    names = [word, *(f"{word[:n]}*{n}" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x.encode()) for x in names]


def features_of(text: str) -> np.ndarray:
    return np.unique(np.array([x for w in words_of(text) for x in features(w)], np.uint64))


def _margins(w: np.ndarray, b: float, idx: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[idx], dtype=np.float64)])
    return total[ptr[1:]] - total[ptr[:-1]] + b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nnpu_gradient(g: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Risk of a batch and its derivative by each margin ``g``."""
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    s = _sigmoid(g)
    soft = np.logaddexp(0, g)  # l(-g); l(g) is soft - g
    plus = prior * (soft - g)[positive].sum() / n_p
    minus = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
    up = np.where(positive, -prior * s / n_p, s / n_u)
    if minus < 0:
        return plus + minus, -up
    return plus + minus, up + np.where(positive, prior * (s - 1) / n_p, 0)


def select(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Features more frequent among P than among U beyond chance (``Z`` deviations)."""
    both = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(r for r, p in zip(rows, positive, strict=True)
                                                                if p == side)]), return_counts=True)
            for side in (True, False)]
    names = np.union1d(both[0][0], both[1][0])
    n = np.zeros((2, len(names)))
    for k, (f, c) in enumerate(both):
        n[k, np.searchsorted(names, f)] = c
    share = positive.mean()
    total = n.sum(axis=0)
    return names[n[0] - share * total > Z * np.sqrt(share * (1 - share) * total + 1)]


def one_of_copies(rows: list[np.ndarray]) -> np.ndarray:
    """Marks rows that are no near copy of an earlier one, by banded minimum hashes of
    their features: a text that was copied often would make all its words telling."""
    seen: set[tuple] = set()
    keep = np.zeros(len(rows), bool)
    odd = np.random.default_rng(5).integers(1, 1 << 62, 24, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k, r in enumerate(rows):
        low = [int((r * o).min()) if len(r) else 0 for o in odd]
        bands = [(i, *low[i:i + 6]) for i in range(0, 24, 6)]
        keep[k] = not any(b in seen for b in bands)
        seen.update(bands)
    return keep


def train(texts: list[str], positive: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature names, weights and offset of one classifier, by Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    rows = [features_of(t) for t in texts]
    first = np.zeros(len(rows), bool)
    for side in (True, False):
        at = np.flatnonzero(positive == side)
        first[at] = one_of_copies([rows[i] for i in at])
    rows, positive = [r for r, k in zip(rows, first, strict=True) if k], positive[first]
    names = select(rows, positive)
    rows = [np.flatnonzero(np.isin(names, r, assume_unique=True)) for r in rows]
    dim = len(names)
    w, m, v = np.zeros(dim), np.zeros(dim), np.zeros(dim)
    b, mb, vb, step = float(np.log(prior / (1 - prior))), 0.0, 0.0, 0
    for _ in range(EPOCHS):
        p, u = rng.permutation(np.flatnonzero(positive)), rng.permutation(np.flatnonzero(~positive))
        for part_p, part_u in zip(np.array_split(p, BATCHES), np.array_split(u, BATCHES), strict=True):
            order = np.concatenate([part_p, part_u])
            ptr = np.cumsum([0, *(len(rows[i]) for i in order)])
            idx = np.concatenate([np.zeros(0, np.int64), *(rows[i] for i in order)])
            _, dg = nnpu_gradient(_margins(w, b, idx, ptr), positive[order], prior)
            grad = np.bincount(idx, np.repeat(dg, np.diff(ptr)), dim) + DECAY * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            mb, vb = 0.9 * mb + 0.1 * dg.sum(), 0.999 * vb + 0.001 * dg.sum() ** 2
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            np.maximum(w, 0, out=w)  # features were chosen as evidence for toxicity
            b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return names, w, float(b)


def _train_member(pdf: pd.DataFrame, prior: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "text", "positive"])
    positive = pdf["positive"].to_numpy(bool)
    if positive.all() or not positive.any():
        return pd.DataFrame({"names": [], "weights": [], "offset": []}, dtype=object)
    names, w, b = train(list(pdf["text"]), positive, prior, int(pdf["member"].iloc[0]))
    return pd.DataFrame({"names": [names.view(np.int64)], "weights": [w], "offset": [b]})


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, members: int = MEMBERS, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> tuple[float, list[tuple]]:
    """Class prior, and (names, weights, offset) of each classifier; ``labels`` has
    doc_id and toxic.  Held-out ids take no part."""
    d = doc_columns(docs).where(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("text").isNotNull())
    y = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
         .dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = y.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    prior = min(0.9, max(1e-3, n["p"] / n["n"] if n["n"] else 0.5))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    toxic = y.where((F.col("toxic") == 1) & (draw < max_positive / max(1, n["p"]))).select("id")
    rows = d.count()
    p = d.join(F.broadcast(toxic), "id").withColumn("positive", F.lit(True))  # at most max_positive ids or so
    u = d.where(draw < max_unlabelled / max(1, rows)).withColumn("positive", F.lit(False))
    # every classifier has all positives and its own part of the unlabelled texts
    sample = p.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).unionByName(
        u.withColumn("member", F.pmod(F.xxhash64("id"), F.lit(members)).cast("int")))
    got = sample.groupBy("member").applyInPandas(
        functools.partial(_train_member, prior=prior), "names array<long>, weights array<double>, offset double").collect()
    return prior, sorted((r["names"], r["weights"], r["offset"]) for r in got)


class Scorer:
    def __init__(self, prior: float, model: list[tuple]):
        names = sorted({f for m in model for f in m[0]})
        at = {f: i for i, f in enumerate(names)}
        self.slot = {f & (2**64 - 1): i for f, i in at.items()}
        self.weights = np.zeros((len(names), len(model)))
        for k, (f, w, _) in enumerate(model):
            self.weights[[at[x] for x in f], k] = w
        self.offset = np.array([m[2] for m in model])
        self.prior = prior
        self.words = WordCache(unit=36)

    def score(self, text: str) -> float:
        if not len(self.offset):
            return self.prior
        words = words_of(text)
        self.words.trim()
        hit: set[int] = set()
        for w in words:
            if (own := self.words.get(w)) is None:
                own = tuple(i for f in features(w) if (i := self.slot.get(f)) is not None)
                self.words.put([(w, own)])
            hit.update(own)
        g = self.offset + (self.weights[sorted(hit)].sum(axis=0) if hit else 0)
        return float(_sigmoid(g).mean())


def _score(batches: Iterator[pa.RecordBatch], name: str, shared) -> Iterator[pa.RecordBatch]:
    scorer = worker_state("toxicity", name, lambda: Scorer(*shared.value))
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_PER_STEP):
            b = batch.slice(at, DOCS_PER_STEP)
            scores = [scorer.score(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "score"])


def score(docs: DataFrame, prior: float, model: list[tuple]) -> DataFrame:
    """doc_id, held_out, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((prior, model))
    return (doc_columns(docs).withColumn("held_out", held_out(F.col("id")))
            .mapInArrow(functools.partial(_score, name=uuid.uuid4().hex, shared=shared),
                        "doc_id long, held_out boolean, score double"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prior, model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, prior, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
