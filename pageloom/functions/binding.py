"""Computing a value once and using it many times, inside expressions and between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def let(value: str, name: str, body: str) -> str:
    """SQL text for ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def bind(df: DataFrame, record: Column) -> DataFrame:
    """Add the fields of a struct as columns.

    They come out of a generator, so later filters and projections use the computed
    values; otherwise the optimizer would copy the expression into each of them.
    """
    return df.select("*", F.inline(F.array(record)))
