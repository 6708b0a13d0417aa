"""Running sums, ranks, cut points and exact percentiles without single-task windows.

A window ordered over a whole group runs in one task; with one class holding
most rows (or with no group at all) that is one task for most of the data.
Every size of input takes the same plans here:

* Running sums: range-partition on (group, order) and sort within partitions; a
  ``mapInPandas`` pass adds partition-local running sums and the partition id, and
  the result is stored (range bounds come from sampling, so a recomputation
  must not re-derive them).  Per (partition, group) totals give the offset of every
  group that continues from an earlier partition; at most one group per partition
  can, so there are at most ``#partitions`` offsets.
* Cut points and percentiles: any number of ranks in any number of (few) groups is found
  by counting on the leading digit, then on the next inside the buckets that hold a
  rank, and so on, all in the same passes; no sort, no shuffle of rows.

Order keys must be unique within a group so that the result does not depend on
partitioning; callers add a tie-break.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored


def _sort_exprs(order_cols: list) -> list[Column]:
    out = []
    for c in order_cols:
        if isinstance(c, str):
            out.append(F.col(c).asc())
        else:
            out.append(c)
    return out


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe key equality; ``right`` may derive from ``left``."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_r_{c}") if c in keys else F.col(f"`{c}`")
                             for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, "left")
    return joined.drop(*[f"_r_{k}" for k in keys])


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` to be sent to all tasks in a join if it has no more than ``most`` rows.

    For tables of one row a group: the rows are counted first, since Spark estimates an
    aggregate by its input and would deal the other side out by its few keys.
    """
    df = stored(df, "few")
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list,
                 value_cols: list[str], prefix: str = "cum_",
                 num_partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums ``prefix + v`` of ``value_cols``.

    Sums run within each ``group_cols`` group in the order of ``order_cols``
    (names sort ascending; pass ``F.col(x).desc()`` for descending).
    """
    order = _sort_exprs(order_cols)
    spark = df.sparkSession
    if num_partitions is None:
        num_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc() for g in group_cols] + order
    parted = df.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)

    cum_fields = []
    for v in value_cols:
        dtype = df.schema[v].dataType
        out_type = T.LongType() if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType,
                                                       T.ByteType)) else T.DoubleType()
        cum_fields.append(T.StructField(prefix + v, out_type, True))
    schema = T.StructType(df.schema.fields + cum_fields
                          + [T.StructField("_pid", T.IntegerType(), False)])
    gcols, vcols = list(group_cols), list(value_cols)

    def local_cumsum(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last, carry = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            # where the group changes, column by column (a missing value equals a missing value)
            new = np.zeros(len(pdf), bool)
            new[0] = True
            for g in gcols:
                v, gone = pdf[g].to_numpy(), pdf[g].isna().to_numpy()
                new[1:] |= ((v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])) | (gone[1:] != gone[:-1])
            codes = np.cumsum(new)
            out = pdf.copy()
            goes_on = carry is not None and all(
                pd.isna(x) and pd.isna(y) or x == y for x, y in zip(pdf[gcols].iloc[0], last))
            for v in vcols:
                out[prefix + v] = pdf[v].groupby(codes).cumsum().to_numpy()
                if goes_on:
                    out.loc[codes == codes[0], prefix + v] += carry[v]
            out["_pid"] = pid
            last = list(pdf[gcols].iloc[-1])
            carry = {v: out[prefix + v].iloc[-1] for v in vcols}
            yield out

    local = stored(parted.mapInPandas(local_cumsum, schema), "sums")
    totals = local.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(v) for v in value_cols])
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("_pid")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals
               .select("_pid", *group_cols,
                       F.count(F.lit(1)).over(before).alias("_prior"),
                       *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias("_off_" + v)
                         for v in value_cols])
               .where(F.col("_prior") > 0).drop("_prior"))
    # At most one group per partition continues from an earlier partition,
    # so ``offsets`` has at most ``num_partitions`` rows.
    joined = _null_safe_join(local, F.broadcast(offsets), ["_pid", *group_cols])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(prefix + v) + F.coalesce(F.col("_off_" + v), F.lit(0))).cast(f.dataType)
          .alias(prefix + v) for v, f in zip(value_cols, cum_fields)])


def rank_rows(df: DataFrame, group_cols: list[str], order_cols: list,
              rank_col: str = "rank") -> DataFrame:
    """1-based row number within each group; order keys must be unique."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_sums(ones, group_cols, order_cols, ["_one"], prefix="_cum")
    return out.withColumnRenamed("_cum_one", rank_col).drop("_one")


def _buckets(rows: DataFrame, conditions: list[Column], digit: list[Column], ranks: list[list[int]]) -> list:
    """Of every bucket (a condition), the digits at which its ranks lie.

    One aggregation on (bucket, digit) for all buckets and ranks; of a bucket's at most
    65,536 counts only those that hold a rank reach the driver.
    """
    def of(values):
        out = F.when(conditions[0], values[0])
        for c, v in zip(conditions[1:], values[1:]):
            out = out.when(c, v)
        return out

    counts = (rows.select(of([F.lit(i) for i in range(len(ranks))]).alias("_b"), of(digit).cast("int").alias("_d"), "_k")
              .where(F.col("_b").isNotNull()).groupBy("_b", "_d")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi")))
    counts = counts.withColumn("_c", F.sum("_n").over(Window.partitionBy("_b").orderBy("_d")))
    wanted = F.when(F.col("_b") == 0, F.array(*map(F.lit, ranks[0])))
    for i, r in enumerate(ranks[1:], 1):
        wanted = wanted.when(F.col("_b") == i, F.array(*map(F.lit, r)))
    return counts.where(F.exists(wanted, lambda r: (r <= F.col("_c")) & (r > F.col("_c") - F.col("_n")))).collect()


def cuts(df: DataFrame, group: Column, key: Column, targets: dict) -> dict:
    """{(group value, t): (value, before, equal)} for ``targets`` {group value: [t >= 1]}: the
    t-th smallest of the long ``key`` in the group, the rows below it, the rows at it.

    All ranks of all groups share each pass, so their number does not add passes: the
    leading 16 bits first, then the next 16 inside the buckets that hold a rank.  A bucket
    of one value ends its search early, so unique hashes take two or three passes.
    """
    rows = df.select(group.alias("_g"), key.cast("long").alias("_k")).where(F.col("_k").isNotNull())
    # flipping the sign bit makes unsigned digits sort like the signed key
    rows = rows.withColumn("_u", F.col("_k").bitwiseXOR(F.lit(-(1 << 63))))
    # (group, prefix) -> its ranks: (t, rank inside, rows below the bucket)
    state = {(g, 0): [(t, t, 0) for t in sorted(set(ts)) if t > 0] for g, ts in targets.items()}
    state = {b: r for b, r in state.items() if r}
    done: dict = {}
    for shift in (48, 32, 16, 0):
        if not state:
            break
        known = list(state)
        inside = [(F.col("_g") == F.lit(g)) & (F.lit(True) if shift == 48 else F.shiftrightunsigned("_u", shift + 16) == F.lit(p))
                  for g, p in known]
        digit = F.shiftright("_u", shift).bitwiseAND(F.lit(0xFFFF))
        state, before = {}, state
        for r in _buckets(rows, inside, [digit] * len(known), [[x[1] for x in before[b]] for b in known]):
            g, p = known[r["_b"]]
            own = [(t, k - (r["_c"] - r["_n"]), below + r["_c"] - r["_n"]) for t, k, below in before[g, p] if r["_c"] - r["_n"] < k <= r["_c"]]
            if r["_lo"] == r["_hi"]:
                done.update({(g, t): (r["_lo"], below, r["_n"]) for t, _, below in own})
            else:
                state[g, (p << 16) | r["_d"]] = own
    return done


def cut_points(df: DataFrame, group: Column, key: Column, targets: dict) -> dict:
    """``cuts`` with one rank a group: {group value: (value, before, equal)}."""
    return {g: v for (g, _), v in cuts(df, group, key, {g: [t] for g, t in targets.items()}).items()}


def first_conditions(df: DataFrame, group: Column, hash_key: Column, key: Column, targets: dict) -> dict:
    """{(group value, t): condition for the first t rows of the group in the order (hash, key)}."""
    found = cuts(df, group, hash_key, targets)
    # rows that share a cut's hash are told apart by the key: one more search for all of them
    ties = {b: b[1] - below for b, (_, below, equal) in found.items() if b[1] - below < equal}
    at, tied = [], {}
    if ties:
        at = sorted({(g, found[g, t][0]) for g, t in ties}, key=str)
        number = F.lit(None).cast("int")
        for i, (g, cut) in enumerate(at):
            number = F.when((group == F.lit(g)) & (hash_key == F.lit(cut)), F.lit(i)).otherwise(number)
        ranks: dict = {}
        for (g, t), left in ties.items():
            ranks.setdefault(at.index((g, found[g, t][0])), []).append(left)
        tied = cuts(df, number, key, ranks)
    out = {}
    for (g, t), (cut, _, _) in found.items():
        last = hash_key == F.lit(cut)
        if (g, t) in ties:
            last = last & (key <= F.lit(tied[at.index((g, cut)), ties[g, t]][0]))
        out[g, t] = (group == F.lit(g)) & ((hash_key < F.lit(cut)) | last)
    return out


def first_rows(df: DataFrame, group: Column, hash_key: Column, key: Column, targets: dict) -> Column:
    """Condition for the first t rows of each group in the order (hash, key)."""
    out = F.lit(False)
    for c in first_conditions(df, group, hash_key, key, {g: [t] for g, t in targets.items()}).values():
        out = out | c
    return F.coalesce(out, F.lit(False))


def _order_statistics(rows: DataFrame, ranges: dict, targets: dict) -> dict:
    """{(group, t): value}: the t-th smallest double ``_k`` of group number ``_g``.

    ``ranges`` has each group's least and largest value, ``targets`` its ranks.  A bucket
    is an interval between two values that occur; it is cut into 65,536 equal widths, and
    the parts that hold a rank are the next buckets, shrunk to the values in them.  So the
    ends of a bucket always part and the search ends; numbers take two or three passes.
    """
    state = {(g, *ranges[g]): [(t, t) for t in sorted(set(ts))] for g, ts in targets.items() if ts}
    done: dict = {}
    edge = 1.7976931348623157e308
    while state:
        for (g, lo, hi), own in list(state.items()):
            if lo == hi:
                done.update({(g, t): lo for t, _ in own})
                del state[g, lo, hi]
        if not state:
            break
        known = list(state)
        v = F.col("_k")
        inside = [(F.col("_g") == F.lit(g)) & (v >= F.lit(lo)) & (v <= F.lit(hi)) for g, lo, hi in known]
        parts = []
        for _, lo, hi in known:
            base, top = max(lo, -edge) / 4, min(hi, edge) / 4
            part = F.floor((v / 4 - F.lit(base)) / F.lit(max(top - base, 5e-324)) * 65536)
            parts.append(F.when(v == F.lit(lo), 0).when(v == F.lit(hi), 65535).otherwise(F.greatest(F.lit(0), F.least(F.lit(65535), part))))
        state, before = {}, state
        for r in _buckets(rows, inside, parts, [[x[1] for x in before[b]] for b in known]):
            bucket = known[r["_b"]]
            own = [(t, k - (r["_c"] - r["_n"])) for t, k in before[bucket] if r["_c"] - r["_n"] < k <= r["_c"]]
            state[bucket[0], r["_lo"], r["_hi"]] = own
    return done


def exact_percentiles(df: DataFrame, value_col: str, probs: list[float],
                      group_cols: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles (numpy 'linear') of a column.

    Nulls and NaNs are ignored.  Groups are few (labels, columns): their sizes and ranges
    reach the driver, and every pass looks for all ranks of all groups by counting, so no
    row is sorted or moved.
    """
    group_cols = list(group_cols or [])
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    v = F.col(f"`{value_col}`").try_cast("double")
    clean = df.select(*[F.col(f"`{g}`") for g in group_cols], v.alias("_k")).where(F.col("_k").isNotNull() & ~F.isnan("_k"))
    sizes = clean.groupBy(*[f"`{g}`" for g in group_cols]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi")).where("_n > 0").collect()
    number = F.lit(0)
    for i, r in enumerate(sizes):
        for j, same in enumerate([F.col(f"`{g}`").eqNullSafe(F.lit(r[g])) for g in group_cols]):
            here = same if not j else here & same
        number = F.when(here, F.lit(i)).otherwise(number) if group_cols else number
    places = [[(r["_n"] - 1) * float(p) for p in probs] for r in sizes]
    want = {i: [int(x) + 1 for x in pos] + [int(np.ceil(x)) + 1 for x in pos] for i, pos in enumerate(places)}
    found = _order_statistics(clean.select(number.alias("_g"), "_k"), {i: (r["_lo"], r["_hi"]) for i, r in enumerate(sizes)}, want)
    rows = []
    for i, r in enumerate(sizes):
        low = [found[i, int(x) + 1] for x in places[i]]
        high = [found[i, int(np.ceil(x)) + 1] for x in places[i]]
        rows.append((*[r[g] for g in group_cols], *[a if a == b else a + (b - a) * (x - int(x)) for a, b, x in zip(low, high, places[i])]))
    schema = T.StructType([df.schema[g] for g in group_cols] + [T.StructField(n, T.DoubleType()) for n in names])
    return df.sparkSession.createDataFrame(rows, schema)


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """Exact medians of several columns, all found in the same passes; None for a column
    without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"`{c}`").try_cast("double").alias("_v"))
                                         for c in cols])).alias("_s")).select("_s.*")
    got = {r["_c"]: r["m"] for r in exact_percentiles(long, "_v", [0.5], ["_c"], ["m"]).collect()}
    return {c: got.get(c) for c in cols}
