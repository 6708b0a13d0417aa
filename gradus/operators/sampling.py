"""Splitting, folds, class weights and class counts.

Every random choice is a hash of the row key and a seed
(``xxhash64(key, seed)`` by default), never ``rand()``: the result is then
independent of partitioning and of task retries.  Split and folds are cut points
of that hash, found by counting; the assignment itself is a projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .ranking import first_conditions, first_rows


def seeded_hash(key: str, seed: int, purpose: str = "") -> Column:
    return F.xxhash64(F.col(key), F.lit(purpose), F.lit(seed))


def _tie_key(df: DataFrame, key: str) -> Column:
    """The key as a long; keys that are no integers stand by their hash."""
    whole = isinstance(df.schema[key].dataType, T.IntegralType)
    return F.col(key).cast("long") if whole else F.xxhash64(F.col(key), F.lit("tie"))


def class_counts_dict(df: DataFrame, label: str) -> dict:
    """Rows per class (one aggregation; k result rows)."""
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Per-class allocation of ``n_draws`` proportional to ``counts``.

    Floors first, then one more for the largest remainders (ties by class
    order), so the allocation sums to ``n_draws`` exactly.
    """
    keys = sorted(counts)
    total = sum(counts.values())
    cont = {c: counts[c] * n_draws / total for c in keys}
    floored = {c: math.floor(cont[c]) for c in keys}
    need = n_draws - sum(floored.values())
    order = sorted(keys, key=lambda c: (-(cont[c] - floored[c]), c))
    for c in order[:need]:
        floored[c] += 1
    return floored


def split_stratified(df: DataFrame, label: str = "label", test_fraction: float = C.SPLIT_TEST_FRACTION,
                     seed: int = C.SEED, key: str = C.ID_COL, order: Column | None = None,
                     out: str = "is_test") -> DataFrame:
    """Stratified hold-out split with exact per-class test counts.

    Test size is ceil(fraction · n); the training allocation per class is the
    proportional allocation of the rest, the test part of each class is what
    remains.  Within a class, rows are ordered by a seeded hash of the key
    (or ``order``) with the key as tie-break, and the first t_c are test rows.
    """
    counts = class_counts_dict(df, label)
    n = sum(counts.values())
    n_test = math.ceil(test_fraction * n)
    train = approximate_mode(counts, n - n_test)
    quota = {c: counts[c] - train[c] for c in counts}
    h = order if order is not None else seeded_hash(key, seed, "split")
    h = h.cast("long")
    return df.withColumn(out, first_rows(df, F.col(label), h, _tie_key(df, key), quota))


def kfold(df: DataFrame, k: int = C.CV_FOLDS, seed: int = C.SEED, key: str = C.ID_COL,
          order: Column | None = None, out: str = "fold", exact_sizes: bool = True) -> DataFrame:
    """Shuffled k-fold assignment: contiguous chunks of a seeded permutation.

    The first n mod k folds get one extra row, as in the usual k-fold split.
    The k - 1 cut points are found by counting, all in the same passes; ``exact_sizes=False``
    assigns ``pmod(hash, k)`` instead — a pure projection, fold sizes equal
    only in expectation.
    """
    h = order if order is not None else seeded_hash(key, seed, "fold")
    if not exact_sizes:
        return df.withColumn(out, F.pmod(h, F.lit(k)).cast("int"))
    n = df.count()
    size, extra = divmod(n, k)
    h, key_col = h.cast("long"), _tie_key(df, key)
    fold = F.lit(k - 1)
    ends = [(i + 1) * size + min(i + 1, extra) for i in range(k - 1)]
    first = first_conditions(df, F.lit(0), h, key_col, {0: ends})
    for i in reversed(range(k - 1)):
        if ends[i]:
            fold = F.when(first[0, ends[i]], F.lit(i)).otherwise(fold)
    return df.withColumn(out, fold.cast("int"))


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weights n / (k · n_c) as a literal lookup (k numbers)."""
    counts = class_counts_dict(df, label)
    n, k = sum(counts.values()), len(counts)
    w = None
    for c, nc in counts.items():
        cond = F.col(label) == F.lit(c)
        val = F.lit(n / (k * nc))
        w = F.when(cond, val) if w is None else w.when(cond, val)
    return df.withColumn(out, w.cast("double"))


def class_counts(before: DataFrame, after: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Counts per class before and after resampling; absent class -> 0."""
    spark = before.sparkSession
    lab = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "_code int, label_name string")
    b = before.groupBy(F.col(label).cast("int").alias("_code")).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(F.col(label).cast("int").alias("_code")).agg(F.count(F.lit(1)).alias("after"))
    # label list: fixed k rows
    return (F.broadcast(lab).join(b, "_code", "left").join(a, "_code", "left")
            .select(F.col("label_name").alias("label"),
                    F.coalesce("before", F.lit(0)).cast("long").alias("before"),
                    F.coalesce("after", F.lit(0)).cast("long").alias("after")))
