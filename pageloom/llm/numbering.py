"""Places of rows in ordered groups of any size: sorted ranges are counted, and the counts carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.plans.shared import materialize


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], place: str, size: str) -> DataFrame:
    """``rows`` with each row's place (from 0, no gaps) in its group by ``order``, and the size of the group.

    Rows are dealt out by ranges of (group, order) and of their number in the input, so
    that a group of any size, and any number of rows alike in all of it, are spread over
    tasks. Only one count for each range and group is summed up. ``rows`` should be a
    written table, as ranges are sampled from it first; nulls come first, and group
    columns must not be null.
    """
    first = [*(F.col(g) for g in group), *(F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order), F.col("__tie")]
    ranges = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*first).sortWithinPartitions(*first)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ranges.select(*rows.columns, F.spark_partition_id().alias("__range"), at.alias("__at")), "ranges")
    counts = placed.groupBy(*group, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*group, "__range", (before - F.col("__from")).alias("__shift"), F.sum("__n").over(whole).alias(size))
    return placed.join(counts, [*group, "__range"]).select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(place), size)
