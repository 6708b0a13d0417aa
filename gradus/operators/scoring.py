"""Scenario scoring: rule-based probability corrections, risk index, class.

The corrections are sequential stages; each stage is one ``withColumns``
projection that reads the previous stage's p0..p3, so the whole chain is a
single codegen'd projection over the scored rows — no per-row Python.
Inputs: p0..p3, ``precrashSpeed``, ``speedLimit`` and the 0/1 flags
``isNight isWet isDark isBadWeather airbag``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..session import compiled

P = ["p0", "p1", "p2", "p3"]


def _limit() -> Column:
    lim = F.col("speedLimit")
    return F.when(lim > 0, lim).otherwise(F.lit(C.ZERO_LIMIT_FALLBACK))


def _ratio() -> Column:
    return F.col("precrashSpeed") / _limit()


def _move(df: DataFrame, cond: Column, shares: dict, give: dict) -> DataFrame:
    """Where ``cond`` holds, take ``shares[p]`` from p and add ``give[q]`` of all that was taken to q.

    What moves is a column of its own (0 where ``cond`` does not hold): written out in each
    of the four updates, the chain is one generated method too large to be compiled.
    """
    hit = F.coalesce(cond, F.lit(False))
    taken = {p: f"_from_{p}" for p in shares}
    out = df.withColumns({taken[p]: F.when(hit, e).otherwise(F.lit(0.0)) for p, e in shares.items()})
    total = reduce(lambda x, y: x + y, [F.col(c) for c in taken.values()])
    updates = {p: F.col(p) - F.col(c) for p, c in taken.items()}
    updates |= {p: F.col(p) + total * share for p, share in give.items()}
    return out.withColumns(updates).drop(*taken.values())


def correct_overspeed(df: DataFrame) -> DataFrame:
    """Speed ratio r > 1: move 0.7·min((r-1)/3, 1)·p0 to p1/p2/p3 as .35/.40/.25."""
    r = _ratio()
    factor = F.least((r - 1.0) / C.OVERSPEED_RAMP, F.lit(1.0))
    return _move(df, r > 1.0, {"p0": F.col("p0") * factor * C.OVERSPEED_TAKE}, dict(zip(P[1:], C.OVERSPEED_SPLIT)))


def correct_extreme_speed(df: DataFrame) -> DataFrame:
    """Speed > 80: e = min(1, (speed-80)/120)^0.7; move .85·e·p0 and .5·e·p1
    to p2/p3 as .35/.65."""
    s = F.col("precrashSpeed")
    e = F.pow(F.least(F.lit(1.0), (s - C.EXTREME_SPEED) / C.EXTREME_RAMP), F.lit(C.EXTREME_POWER))
    return _move(df, s > C.EXTREME_SPEED, {"p0": F.col("p0") * e * C.EXTREME_TAKE_P0, "p1": F.col("p1") * e * C.EXTREME_TAKE_P1},
                 dict(zip(P[2:], C.EXTREME_SPLIT)))


def hazard_count(df: DataFrame | None = None) -> Column:
    """night + wet + dark + bad weather + (ratio > 1.5) + airbag (highway not counted)."""
    return (F.col("isNight") + F.col("isWet") + F.col("isDark") + F.col("isBadWeather")
            + (_ratio() > C.COMPOUND_RATIO).cast("int") + F.col("airbag"))


def correct_compound(df: DataFrame) -> DataFrame:
    """c >= 3 hazards: move min((c-2)/4, .6)·p0 to p1/p2/p3 as .3/.4/.3."""
    c = hazard_count()
    share = F.least((c - 2) / C.COMPOUND_DIVISOR, F.lit(C.COMPOUND_CAP))
    return _move(df, c >= C.COMPOUND_MIN, {"p0": F.col("p0") * share}, dict(zip(P[1:], C.COMPOUND_SPLIT)))


def correct_airbag(df: DataFrame) -> DataFrame:
    """Airbag and p0 > .5 (after the earlier stages): move (p0-.3)/2 to .5/.35/.15."""
    cond = (F.col("airbag") != 0) & (F.col("p0") > C.AIRBAG_P0_ABOVE)
    return _move(df, cond, {"p0": (F.col("p0") - C.AIRBAG_P0_FLOOR) * C.AIRBAG_SHARE}, dict(zip(P[1:], C.AIRBAG_SPLIT)))


def normalize_proba(df: DataFrame) -> DataFrame:
    """Clip to [0, 1]; divide by the sum when it is positive."""
    clipped = df.withColumns({p: F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) for p in P})
    total = F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3")
    return clipped.withColumns({p: F.when(total > 0, F.col(p) / total).otherwise(F.col(p)) for p in P})


def apply_corrections(df: DataFrame) -> DataFrame:
    out = correct_overspeed(compiled(df))
    out = correct_extreme_speed(out)
    out = correct_compound(out)
    out = correct_airbag(out)
    return normalize_proba(out)


def with_risk(df: DataFrame, labels: list[str] = C.SEVERITY_LABELS) -> DataFrame:
    arr = X.proba_array(P)
    return df.withColumns({"risk_index": X.risk_index(P),
                           "predicted_class": X.predicted_label(arr, labels)})


def risk_band(df: DataFrame, col: str = "risk_index", cuts=C.RISK_INDEX_BANDS,
              top: str = C.RISK_INDEX_TOP, out: str = "risk_band", strict_above: bool = False) -> DataFrame:
    return df.withColumn(out, X.band(col, cuts, top, strict_above))


def probability_map(labels: list[str] = C.SEVERITY_LABELS, digits: int = 4) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]),
                             F.array(*[X.round_to(F.col(p), digits) for p in P]))


def finalize_scores(df: DataFrame, model_tag: str, digits: int = 4,
                    labels: list[str] = C.SEVERITY_LABELS) -> DataFrame:
    """Risk index and class from the unrounded p; then round to ``digits``."""
    out = with_risk(df, labels)
    return out.withColumns({
        **{p: X.round_to(F.col(p), digits) for p in P},
        "risk_index": X.round_to(F.col("risk_index"), digits),
        "model": F.lit(model_tag),
    })
