"""Categorical statistics and distribution summaries.

All statistics are aggregations with map-side partial aggregation, so the
shuffle carries at most one row per (partition, group) — independent of how
skewed the label is.  Several statistics of the analysed application rescan
the table per label or per condition; here each is one pass:
``bayes_table`` is a single multi-aggregate, ``chi_square`` one unpivot +
group-by over all tested columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..functions.distributions import chi2_sf
from ..session import stored
from .ranking import exact_percentiles


def _labels_df(spark, labels: list[str], name: str = "label") -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"_pos int, {name} string")


def value_counts(df: DataFrame, col: str, labels: list[str] | None = None,
                 out: str = "n") -> DataFrame:
    """Count per value, most frequent first; with ``labels``: every label in
    label order, absent ones 0 (nulls are not counted)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    if labels is None:
        return counts.orderBy(F.col(out).desc(), F.col(col))
    lab = _labels_df(df.sparkSession, labels, col)
    # the label list is a fixed small literal; the counts side is one row per value
    return (F.broadcast(lab).join(counts, col, "left")
            .select(col, F.coalesce(F.col(out), F.lit(0)).cast("long").alias(out), "_pos")
            .orderBy("_pos").drop("_pos"))


def marginal_prob(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Share of each label over all rows (one aggregation)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(label) == F.lit(x)).alias(f"_c{i}") for i, x in enumerate(labels)])
    long = row.select(X.rows_of([(F.lit(x).alias(label), F.col(f"_c{i}").alias("n")) for i, x in enumerate(labels)]), "_n")
    return long.select(label, (F.col("n") / F.col("_n")).alias("p"))


def crosstab_counts(df: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """Contingency counts: one row per value of ``a``, one column per label."""
    clean = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return (clean.groupBy(a).pivot(b, labels).agg(F.count(F.lit(1)))
            .fillna(0, subset=labels)
            .select(a, *[F.col(x).cast("long").alias(x) for x in labels]))


def crosstab_share(df: DataFrame, a: str, b: str, labels: list[str], digits: int | None = 4) -> DataFrame:
    """Row-normalised contingency table with a column for every label."""
    clean = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def share(x):
        e = F.avg((F.col(b) == F.lit(x)).cast("double"))
        return (X.round_to(e, digits) if digits is not None else e).alias(x)

    return clean.groupBy(a).agg(*[share(x) for x in labels])


def wilson_interval(df: DataFrame, label: str, labels: list[str], z: float = C.WILSON_Z) -> DataFrame:
    """95 % Wilson score interval for each label's share, clipped to [0, 1]."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(label) == F.lit(x)).alias(f"_c{i}") for i, x in enumerate(labels)])
    long = counts.select(X.rows_of([(F.lit(x).alias(label), F.lit(i).alias("_pos"), F.col(f"_c{i}").alias("k"))
                                    for i, x in enumerate(labels)]), "_n")
    n = F.col("_n").cast("double")
    p = F.col("k") / n
    z2 = F.lit(z * z)
    denom = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / denom
    return long.select(label, F.col("k").cast("long").alias("n"), p.alias("p"),
                       F.greatest(F.lit(0.0), centre - half).alias("lower"),
                       F.least(F.lit(1.0), centre + half).alias("upper"))


def chi_square(df: DataFrame, cols: list[str], label: str, with_p: bool = True) -> DataFrame:
    """Chi-square test of independence of every column in ``cols`` vs ``label``.

    One unpivot + group-by gives all observed cells; the marginals are two
    more group-bys over that (tiny) cell table.  Rows with a null in either
    column are dropped; the table spans the values and labels present.
    Yates' correction applies when dof = 1.
    """
    long = (df.select(label, *[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([label], cols, "variable", "value")
            .where(F.col("value").isNotNull() & F.col(label).isNotNull()))
    # the observed cells are tiny (values x labels per column); materialise
    # them once so the marginals below do not re-scan and re-unpivot the input
    cells = stored(long.groupBy("variable", "value", label).agg(F.count(F.lit(1)).alias("o")), "cells")
    rows = cells.groupBy("variable", "value").agg(F.sum("o").alias("r"))
    colm = cells.groupBy("variable", label).agg(F.sum("o").alias("c"))
    tot = rows.groupBy("variable").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("nr"))
    ncols = colm.groupBy("variable").agg(F.count(F.lit(1)).alias("nc"))
    # Only observed cells: an empty cell adds its expected count, and all expected counts add up to n
    seen = (cells.join(rows, ["variable", "value"]).join(colm, ["variable", label]).join(tot, "variable"))
    e = F.col("r") * F.col("c") / F.col("n")
    o = F.col("o").cast("double")
    plain = seen.groupBy("variable").agg((F.sum((o - e) * (o - e) / e) + F.first("n") - F.sum(e)).alias("chi2"))
    # Yates' correction looks at each of the four cells of a 2 x 2 table
    two = tot.where("nr = 2").join(ncols.where("nc = 2"), "variable").select("variable", "n")
    four = (rows.join(two, "variable").join(colm, "variable").join(cells, ["variable", "value", label], "left"))
    diff = F.abs(F.coalesce("o", F.lit(0)).cast("double") - e)
    diff = diff - F.least(F.lit(0.5), diff)
    yates = four.groupBy("variable").agg(F.sum(diff * diff / e).alias("yates"))
    stat = (plain.join(yates, "variable", "left").join(tot, "variable").join(ncols, "variable")
            .select("variable", F.coalesce("yates", "chi2").alias("chi2"),
                    ((F.col("nr") - 1) * (F.col("nc") - 1)).cast("int").alias("dof")))
    out = stat.select(F.col("variable").alias("Variable"), F.col("chi2").alias("Chi2"),
                      F.col("dof").alias("df"))
    if with_p:
        out = out.withColumn("p_value", chi2_sf(F.col("Chi2"), F.col("df")))
        out = out.withColumn("Significance", X.significance("p_value", C.SIGNIFICANCE_LEVELS))
    return out


def significance(df: DataFrame, p_col: str = "p_value",
                 levels: list = C.SIGNIFICANCE_LEVELS) -> DataFrame:
    return df.withColumn("Significance", X.significance(p_col, levels))


def count_significant(df: DataFrame, p_col: str = "p_value", alpha: float = 0.05) -> DataFrame:
    return df.agg(F.count_if(F.col(p_col) < alpha).alias("n_significant"),
                  F.count(F.lit(1)).alias("n_tests"))


def bayes_table(df: DataFrame, conditions: list[tuple[str, str, str]], label: str,
                labels: list[str]) -> DataFrame:
    """P(S|C) = P(C|S) P(S) / P(C) for every condition and label, in one pass.

    Conditions with P(C) = 0 give no rows; a label absent from the data has
    P(C|S) = 0.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, x in enumerate(labels):
        aggs.append(F.count_if(F.col(label) == F.lit(x)).alias(f"s{i}"))
    for j, (c, v, _) in enumerate(conditions):
        hit = F.coalesce(F.col(c) == F.lit(v), F.lit(False))
        aggs.append(F.count_if(hit).alias(f"c{j}"))
        for i, x in enumerate(labels):
            aggs.append(F.count_if(hit & (F.col(label) == F.lit(x))).alias(f"c{j}s{i}"))
    wide = df.agg(*aggs)
    parts = []
    for j, (_, _, name) in enumerate(conditions):
        for i, x in enumerate(labels):
            parts.append((F.lit(name).alias("condition"), F.lit(j).alias("_cpos"), F.lit(x).alias(label), F.lit(i).alias("_lpos"),
                          F.col(f"c{j}").alias("nc"), F.col(f"s{i}").alias("ns"), F.col(f"c{j}s{i}").alias("ncs")))
    long = wide.select(X.rows_of(parts), "_n")
    n = F.col("_n").cast("double")
    p_c = F.col("nc") / n
    p_s = F.col("ns") / n
    p_c_s = F.when(F.col("ns") == 0, F.lit(0.0)).otherwise(F.col("ncs") / F.col("ns"))
    return (long.where(F.col("nc") > 0)
            .select("condition", label, p_c_s.alias("p_cond_given_sev"), p_s.alias("p_sev"),
                    p_c.alias("p_cond"), (p_c_s * p_s / p_c).alias("p_sev_given_cond")))


def by_label(label: str, values: dict) -> F.Column:
    """A number for each of a few labels, as literals."""
    out = F.lit(None).cast("double")
    for x, v in values.items():
        out = F.when(F.col(label) == F.lit(x), F.lit(v).cast("double")).otherwise(out)
    return out


def histogram_by(df: DataFrame, col: str, label: str, bins: int = C.HIST_BINS) -> DataFrame:
    """Equal-width histogram per label over that label's own [min, max].

    The last bin is closed; a label with min = max uses [min-0.5, max+0.5].
    Only non-empty bins are returned.  Labels are few: their ranges are literals, so rows
    are not joined, and only counts move.
    """
    clean = df.where(F.col(col).isNotNull() & F.col(label).isNotNull())
    rng = {r[label]: (r["_lo"], r["_hi"]) for r in
           clean.groupBy(label).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).collect()}
    rng = {x: (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi) for x, (lo, hi) in rng.items()}
    j = clean.withColumns({"_lo": by_label(label, {x: v[0] for x, v in rng.items()}),
                           "_hi": by_label(label, {x: v[1] for x, v in rng.items()})})
    width = (F.col("_hi") - F.col("_lo"))
    b = F.least(F.floor((F.col(col) - F.col("_lo")) * F.lit(bins) / width).cast("int"), F.lit(bins - 1))
    counted = j.groupBy(label, b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        label, "bin",
        (F.col("_lo") + F.col("bin") * width / F.lit(bins)).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width / F.lit(bins)).alias("bin_hi"),
        "n")


def box_stats(df: DataFrame, col: str, label: str, whis: float = 1.5) -> DataFrame:
    """Quartiles (linear), 1.5·IQR whiskers at data points, outlier count per label.

    The quartiles of the few labels are literals, so no row is joined or moved.
    """
    clean = df.where(F.col(col).isNotNull() & F.col(label).isNotNull())
    q = exact_percentiles(clean, col, [0.25, 0.5, 0.75], group_cols=[label],
                          names=["q1", "median", "q3"])
    q = {r[label]: r for r in q.collect()}
    j = clean.withColumns({n: by_label(label, {x: r[n] for x, r in q.items()}) for n in ("q1", "median", "q3")})
    iqr = F.col("q3") - F.col("q1")
    lo_lim = F.col("q1") - F.lit(whis) * iqr
    hi_lim = F.col("q3") + F.lit(whis) * iqr
    x = F.col(col).cast("double")
    return j.groupBy(label, "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_lim, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_lim, x)).alias("whisker_hi"),
        F.count_if((x < lo_lim) | (x > hi_lim)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def dataset_kpis(df: DataFrame, label: str, labels: list[str], one_hot_cols: list[str],
                 n_base_features: int) -> DataFrame:
    """Row count, feature count, class count, majority share, class percentages."""
    aggs = [F.count(F.lit(1)).alias("total_samples")]
    aggs += [F.count_distinct(F.col(c)).alias(f"_d_{c}") for c in one_hot_cols]
    aggs += [F.count_if(F.col(label) == F.lit(x)).alias(f"_n{i}") for i, x in enumerate(labels)]
    row = df.agg(*aggs)
    feat = F.lit(n_base_features)
    for c in one_hot_cols:
        feat = feat + F.greatest(F.col(f"_d_{c}") - 1, F.lit(0))
    counts = [F.col(f"_n{i}") for i in range(len(labels))]
    n_classes = sum((F.when(cn > 0, 1).otherwise(0) for cn in counts), F.lit(0))
    return row.select(
        "total_samples",
        feat.cast("long").alias("features_count"),
        n_classes.cast("long").alias("n_classes"),
        (F.greatest(*counts) / F.col("total_samples")).alias("majority_share"),
        *[(F.lit(100.0) * cn / F.col("total_samples")).alias(f"pct_{x}") for cn, x in zip(counts, labels)])
