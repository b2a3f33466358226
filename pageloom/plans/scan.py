"""Running values over ordered groups that may be too large for one task.

A plain window sends a whole group to one task. Here a group is cut into buckets
of consecutive order values, each bucket is scanned on its own, and the totals of
earlier buckets are carried in by a join with a table holding one row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WIDTH = 1 << 20

#: Cells of hashed keys that are counted to find large groups.
CELLS = 1 << 13

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``last`` (non-null), ``max`` or ``min`` of a column."""

    fn: str
    value: Column
    inclusive: bool = True


def _window_fn(fn: str, value: Column) -> Column:
    if fn == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[fn](value)


def _bucket_fn(fn: str, value: Column, order: str, descending: bool) -> Column:
    if fn == "last":
        pick = F.min_by if descending else F.max_by
        return pick(value, F.when(value.isNotNull(), F.col(order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[fn](value)


def _combine(fn: str, local: Column, carry: Column) -> Column:
    if fn == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if fn == "last":
        return F.coalesce(local, carry)
    return (F.greatest if fn == "max" else F.least)(local, carry)


def groups_past(df: DataFrame, keys: list[str], order: str, width: int | None = None) -> DataFrame:
    """Keys holding an order value beyond one bucket.

    For orders counted 1..n within a group there are at most rows/width of them,
    and the filter reaches the scan.
    """
    return df.filter(F.col(order) >= F.lit(width or WIDTH)).select(*keys).distinct()


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, Running],
    *,
    large: DataFrame | None = None,
    width: int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add running columns over ``keys`` by the integer column ``order``.

    ``large`` lists the keys that span several buckets. Give it only where such a
    key must hold about ``width`` rows or more, so that it has at most rows/width
    entries and can be broadcast; without it the carry table is shuffled.
    """
    width = width or WIDTH
    tagged = df.withColumn(_BUCKET, F.floor(F.col(order) / F.lit(width)).cast("long"))
    for i, (_, r) in enumerate(columns.items()):
        tagged = tagged.withColumn(f"__v{i}", r.value)

    by = F.col(order).desc() if descending else F.col(order).asc()
    base = W.partitionBy(*keys, _BUCKET).orderBy(by)
    local = tagged.select(
        *[F.col(c) for c in df.columns],
        _BUCKET,
        *[
            _window_fn(r.fn, F.col(f"__v{i}"))
            .over(base.rowsBetween(W.unboundedPreceding, 0 if r.inclusive else -1))
            .alias(f"__l{i}")
            for i, r in enumerate(columns.values())
        ],
    )

    source = tagged if large is None else tagged.join(F.broadcast(large), keys, "left_semi")
    totals = source.groupBy(*keys, _BUCKET).agg(
        *[_bucket_fn(r.fn, F.col(f"__v{i}"), order, descending).alias(f"__t{i}") for i, r in enumerate(columns.values())]
    )
    bucket_by = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    earlier = W.partitionBy(*keys).orderBy(bucket_by).rowsBetween(W.unboundedPreceding, -1)
    first = W.partitionBy(*keys).orderBy(bucket_by)
    carry = (
        totals.select(
            *keys,
            _BUCKET,
            *[_window_fn(r.fn, F.col(f"__t{i}")).over(earlier).alias(f"__c{i}") for i, r in enumerate(columns.values())],
            F.row_number().over(first).alias("__n"),
        )
        .filter(F.col("__n") > 1)
        .drop("__n")
    )
    if large is not None:
        carry = F.broadcast(carry)
    joined = local.join(carry, [*keys, _BUCKET], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(r.fn, F.col(f"__l{i}"), F.col(f"__c{i}")).alias(n) for i, (n, r) in enumerate(columns.items())],
    )


def with_document(
    pages: DataFrame, docs: DataFrame, *, count: str = "page_count", dealt: bool = False, width: int | None = None
) -> DataFrame:
    """Pages (doc_id, page_no, ...) with the columns of their document's one row in ``docs``.

    The join is on the document and a bucket of its pages; the row of a document past
    one bucket is repeated for each, so that no key holds more than ``width`` pages.
    Pages ``dealt`` by document, none of them past one bucket, are joined where they lie.
    """
    if dealt:
        return pages.join(docs, "doc_id")
    width = width or WIDTH
    buckets = F.greatest(F.ceil(F.col(count) / F.lit(width)), F.lit(1)).cast("long")
    many = docs.withColumn(_BUCKET, F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)))
    placed = pages.withColumn(_BUCKET, F.floor((F.col("page_no") - 1) / F.lit(width)).cast("long"))
    return placed.join(many, ["doc_id", _BUCKET]).drop(_BUCKET)


def large_groups(df: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """The keys of groups of more than ``width`` rows, of which there are at most rows/width.

    Rows are first counted by cells of hashed keys: a large group makes its cell large, so
    only rows of large cells, mostly none, are shuffled to be counted by key.
    """
    width = width or WIDTH
    many = F.count(F.lit(1)) > F.lit(width)
    tagged = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias("__cell"))
    full = tagged.groupBy("__cell").agg(many.alias("__many")).filter("__many").select("__cell")
    counted = tagged.join(F.broadcast(full), "__cell", "left_semi").groupBy(*keys).agg(many.alias("__many"))
    return counted.filter("__many").select(*keys)


def row_index(
    df: DataFrame, keys: list[str], order: list[str], name: str, split: Column, *, width: int | None = None
) -> DataFrame:
    """Number rows 1.. within ``keys`` by ``order``.

    ``split`` is a coarse integer that never decreases along ``order``. Groups of
    more than ``width`` rows (at most rows/width of them) are cut by it; all other
    groups are numbered by one window.
    """
    width = width or WIDTH
    large = large_groups(df, keys, width).withColumn("__large", F.lit(True))
    tagged = df.join(F.broadcast(large), keys, "left").withColumn(
        _BUCKET, F.when(F.col("__large"), split.cast("long")).otherwise(F.lit(0).cast("long"))
    )
    local = tagged.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, _BUCKET).orderBy(*order)))
    sizes = (
        df.join(F.broadcast(large), keys, "inner")
        .withColumn(_BUCKET, split.cast("long"))
        .groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    earlier = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(*keys, _BUCKET, F.sum("__n").over(earlier).alias("__before"))
    joined = local.join(carry, [*keys, _BUCKET], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        (F.col("__rn") + F.coalesce(F.col("__before"), F.lit(0))).cast("int").alias(name),
    )


def expand(
    df: DataFrame, length: Column, index: str, *, bound: Column, spread: list[str], width: int | None = None
) -> DataFrame:
    """One output row per 0 <= index < length.

    Rows that may expand to more than ``width`` are first cut into blocks and spread over
    the cluster by hash, so no task writes out a long range alone. ``bound`` is a cheap
    column no length exceeds; the two paths are told apart by it before ``length`` is
    worked out, so that is done once per row.
    """
    width = width or WIDTH
    sized = df.withColumn("__len", length.cast("long"))
    names = [F.col(c) for c in df.columns]
    short = sized.filter(bound <= F.lit(width)).filter(F.col("__len") > 0).select(
        *names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__len") - 1)).alias(index)
    )
    blocks = sized.filter(bound > F.lit(width)).filter(F.col("__len") > 0).select(
        *names,
        "__len",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__len") - 1) / F.lit(width)))).alias("__block"),
    )
    long = (
        blocks.repartition(*[F.col(c) for c in spread], F.col("__block"))
        .select(
            *names,
            F.explode(
                F.sequence(
                    F.col("__block") * F.lit(width),
                    F.least((F.col("__block") + 1) * F.lit(width), F.col("__len")) - 1,
                )
            ).alias(index),
        )
    )
    return short.unionByName(long)
