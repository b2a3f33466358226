"""All-or-nothing checks: a document with one bad row leaves as a reject, not as output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_error(df: DataFrame, keys: list[str], error: Column, detail: Column, order: Column) -> DataFrame:
    """The earliest error per key, pre-aggregated before the shuffle."""
    bad = df.filter(error.isNotNull())
    return bad.groupBy(*keys).agg(F.min_by(F.struct(error.alias("error"), detail.alias("detail")), order).alias("e")).select(
        *keys, "e.error", "e.detail"
    )


def keep_good(df: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Rows of the keys that have no bad row at all."""
    return df.join(df.filter(bad).select(*keys).distinct(), keys, "left_anti")
