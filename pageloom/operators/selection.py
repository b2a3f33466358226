"""Page ranges as data: resolve, refuse, make unique, print back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions import ranges
from pageloom.plans.scan import with_document


def resolve(specs: DataFrame, *, width: int | None = None) -> DataFrame:
    """One row per named page in the order written, repeats kept: doc_id, pos, page_no."""
    return ranges.expand_spans(specs.filter(F.col("error").isNull()), "spans", ["doc_id"], width=width)


def resolve_unique(specs: DataFrame, *, width: int | None = None) -> DataFrame:
    """As :func:`resolve`, each page once, at its first place."""
    return ranges.expand_spans(specs.filter(F.col("error").isNull()), "unique_spans", ["doc_id"], width=width)


def refused(specs: DataFrame) -> DataFrame:
    return specs.filter(F.col("error").isNotNull()).select("doc_id", "error", "detail")


def rejects(specs: DataFrame) -> DataFrame:
    """Documents an operator on selected pages refuses: a bad specification, or one that names no page."""
    nothing = specs.filter(F.col("error").isNull() & (F.size("unique_spans") == 0))
    return refused(specs).unionByName(nothing.select("doc_id", F.lit("EmptySelection").alias("error"), F.lit(None).cast("string").alias("detail")))


def canonical(specs: DataFrame) -> DataFrame:
    return specs.filter(F.col("canonical").isNotNull()).select("doc_id", "canonical")


def selected(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """All pages of the documents whose specification holds, with a ``selected`` flag.

    The intervals travel as one array per document, so nothing is expanded.
    """
    good = specs.filter(F.col("error").isNull() & (F.size("unique_spans") > 0)).select("doc_id", F.col("page_count").alias("__count"), "unique_spans")
    return (
        with_document(pages, good, count="__count")
        .withColumn("selected", ranges.holds(F.col("unique_spans"), F.col("page_no")))
        .drop("unique_spans", "__count")
    )
