"""Column-expression building blocks (all JVM-side, codegen friendly).

Spark runs in ANSI mode, so every cast or division that can fail uses the
``try_`` form, and every comparison that can meet a null is wrapped in
``coalesce(..., false)`` to give the 0/1 flag semantics of the analysed
application (a comparison with a missing value is false).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c) -> Column:
    """Text or number to double; unparseable and NaN become null."""
    x = col(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def flag(cond: Column) -> Column:
    """Boolean condition to an int 0/1 flag, null counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def equals_flag(c, value) -> Column:
    return flag(col(c) == F.lit(value))


def contains_flag(c, sub: str) -> Column:
    return flag(F.contains(col(c), F.lit(sub)))


def not_in_flag(c, values: list) -> Column:
    """0 when the value is in ``values``, else 1 — a null counts as 'not in'."""
    return (F.lit(1) - flag(col(c).isin(*values))).cast("int")


def safe_ratio(a, b) -> Column:
    """a / b with a zero or missing divisor giving 0."""
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(0.0)).cast("double")


def positive_ratio(a, b) -> Column:
    """a / b when b > 0 else 0 (scenario-scoring rule)."""
    return F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0))


def parse_timestamp(c, formats: list[str] | None = None) -> Column:
    """First successful parse among ``formats`` (default: ISO forms)."""
    formats = formats or ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy"]
    text = col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def proba_array(prob_cols: list[str]) -> Column:
    return F.array(*[col(p).cast("double") for p in prob_cols])


def first_argmax(arr: Column) -> Column:
    """0-based position of the first maximum of an array of doubles."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def predicted_label(arr: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), first_argmax(arr) + 1)


def risk_index(prob_cols: list[str]) -> Column:
    """Expected ordinal class: sum of k * p_k."""
    expr = F.lit(0.0)
    for k, p in enumerate(prob_cols):
        if k:
            expr = expr + F.lit(float(k)) * col(p)
    return expr


def band(c, cuts: list[tuple[float, str]], top: str, strict_above: bool = False) -> Column:
    """Label by the first cut that ``c`` falls below (or not above)."""
    x = col(c)
    expr = None
    for bound, label in cuts:
        cond = (x <= F.lit(bound)) if strict_above else (x < F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(top))


def significance(p, levels: list[tuple[float, str]]) -> Column:
    return band(p, levels, "ns")


def round_to(c, digits: int) -> Column:
    """Round half away from zero on x·10^d (the rounding SQL engines such as
    DuckDB apply to doubles), so reports round identically across engines."""
    x = col(c)
    p = F.lit(float(10 ** digits))
    v = x * p
    rounded = (F.when(v >= 0, F.floor(v + F.lit(0.5))).otherwise(F.ceil(v - F.lit(0.5))) / p).cast("double")
    # beyond 2^52 a double has no fraction left at this scale (and floor
    # would leave the long range): the value is already rounded
    return F.when(F.abs(v) < F.lit(4.0e15), rounded).otherwise(x.cast("double"))


def rows_of(rows: list[tuple[Column, ...]]) -> Column:
    """Literal table as a generator: one output row per tuple of aliased columns.
    Names are values here, so any character may occur in them."""
    return F.inline(F.array(*[F.struct(*r) for r in rows]))
