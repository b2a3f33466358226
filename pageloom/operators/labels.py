"""Page labels: governing range per page, and checking a new set of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.labels import STYLES, label_number
from pageloom.operators.rejects import first_error
from pageloom.plans.scan import WIDTH, Running, groups_past, running


def page_labels(pages: DataFrame, docs: DataFrame, label_ranges: DataFrame, *, width: int | None = None) -> DataFrame:
    """Label of every page: the last range that starts at or before it, else the plain number.

    An as-of join: starts are marked on their pages and the last mark is carried forward.
    """
    marks = label_ranges.select(
        "doc_id",
        F.col("start_page").alias("page_no"),
        F.struct("start_page", "style", "prefix", F.greatest(F.col("first"), F.lit(1)).alias("first")).alias("__mark"),
    )
    marked = pages.select("doc_id", "page_no").join(marks, ["doc_id", "page_no"], "left")
    large = docs.filter(F.col("page_count") >= F.lit(width or WIDTH)).select("doc_id")
    governed = running(marked, ["doc_id"], "page_no", {"__r": Running("last", F.col("__mark"))}, large=large, width=width)
    value = F.col("__r.first") + F.col("page_no") - F.col("__r.start_page")
    return governed.select(
        "doc_id",
        "page_no",
        F.when(F.col("__r").isNull(), F.col("page_no").cast("string"))
        .otherwise(F.concat(F.col("__r.prefix"), label_number(F.col("__r.style"), value)))
        .alias("label"),
    )


def check_ranges(specs: DataFrame, *, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Read ``START:STYLE[:PREFIX[:FIRST]]`` rows (doc_id, pos, spec): (ranges, rejects); ``pos`` counts them within a document.

    Starts must be at least 1 and grow in the order given, first numbers at least 1.
    """
    part = F.split(F.col("spec"), ":", 4)
    whole = lambda i: F.when(F.get(part, F.lit(i)).rlike("^[+]?[0-9]+$"), F.get(part, F.lit(i)).try_cast("int"))
    read = specs.select(
        "doc_id",
        "pos",
        whole(0).alias("start_page"),
        F.get(part, F.lit(1)).alias("style"),
        F.coalesce(F.get(part, F.lit(2)), F.lit("")).alias("prefix"),
        F.when(F.size(part) == 4, whole(3)).otherwise(F.lit(1)).alias("first"),
        F.size(part).alias("__parts"),
    )
    before = running(read, ["doc_id"], "pos", {"__prev": Running("last", F.col("start_page"), inclusive=False)}, large=groups_past(specs, ["doc_id"], "pos", width), width=width)
    detail = (
        F.when(F.col("__parts") < 2, F.lit("needs START:STYLE"))
        .when(F.col("start_page").isNull(), F.lit("START is not a number"))
        .when(~F.col("style").isin(*STYLES), F.lit("unknown style"))
        .when(F.col("first").isNull(), F.lit("FIRST is not a number"))
        .when(F.col("start_page") == 0, F.lit("pages are numbered from 1"))
        .when(F.col("start_page") <= F.coalesce(F.col("__prev"), F.lit(0)), F.lit("starts must grow"))
        .when(F.col("first") == 0, F.lit("first number is at least 1"))
    )
    checked = before.withColumn("__detail", detail)
    error = F.when(F.col("__detail").isNotNull(), F.lit("InvalidPageLabel"))
    rejects = first_error(checked, ["doc_id"], error, F.col("__detail"), F.col("pos"))
    ok = checked.join(rejects.select("doc_id"), "doc_id", "left_anti").select("doc_id", "start_page", "style", "prefix", "first")
    return ok, rejects


def replace_ranges(current: DataFrame, new: DataFrame, replaced: DataFrame) -> DataFrame:
    """Documents in ``replaced`` take their ``new`` ranges (none clears them); others keep theirs."""
    return current.join(replaced.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
