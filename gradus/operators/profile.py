"""Table profile: shape, column types, ordered sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_shape(df: DataFrame) -> DataFrame:
    """One row: row count and column count (one distributed count)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def profile_dtypes(df: DataFrame) -> DataFrame:
    """Column -> Spark type name, in column order (schema only, no scan)."""
    rows = [(name, dtype) for name, dtype in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")


def profile_sample(df: DataFrame, n: int = 20, order_by: str | list | None = None) -> DataFrame:
    """First ``n`` rows by ``order_by``, every value as text, missing -> 'N/A'.

    Spark rows have no inherent order, so an order key is required;
    ``orderBy().limit()`` plans as a top-k (TakeOrderedAndProject), not a sort.
    """
    if order_by is None:
        raise ValueError("profile_sample needs an order key")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    top = df.orderBy(*keys).limit(n)
    return top.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")).alias(c)
                        for c in df.columns])
