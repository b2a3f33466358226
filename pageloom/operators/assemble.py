"""Page algebra: merge, arrange, delete, move, split, and the names of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pageloom.functions import ranges
from pageloom.functions.labels import fill_tokens
from pageloom.functions.text import zero_pad
from pageloom.operators.selection import resolve
from pageloom.plans.graph import walk_chain
from pageloom.plans.scan import WIDTH, Running, expand, running, with_document


def offsets(inputs: DataFrame, keys: list[str], order: str, size: str, name: str, *, width: int | None = None) -> DataFrame:
    """How far each input is shifted so that pages or ids never collide: sizes of earlier inputs."""
    return running(inputs, keys, order, {name: Running("sum", F.col(size).cast("long"), inclusive=False)}, width=width)


def merge(inputs: DataFrame, pages: DataFrame, *, width: int | None = None) -> DataFrame:
    """Concatenate inputs in order. ``inputs``: merge_id, input_ord, doc_id, page_count.

    New page numbers are an offset per input plus the old number; pages are not ranked.
    """
    shifted = offsets(inputs, ["merge_id"], "input_ord", "page_count", "shift", width=width)
    return with_document(pages, shifted.select("merge_id", "input_ord", "doc_id", "page_count", "shift"), width=width).select(
        "merge_id", (F.col("shift") + F.col("page_no")).alias("page_no"), "doc_id", F.col("page_no").alias("source_page")
    )


def merge_facts(inputs: DataFrame, fields: list[str], version: str) -> DataFrame:
    """Facts of the merged document: exact page sum, first input's metadata, highest version."""
    return inputs.groupBy("merge_id").agg(
        F.sum("page_count").alias("page_count"),
        *[F.min_by(F.col(f), F.col("input_ord")).alias(f) for f in fields],
        F.max(version).alias("version"),
    )


def arrange(pages: DataFrame, picks: DataFrame, columns: list[str]) -> DataFrame:
    """Pages in the order picked; a page named twice becomes two independent pages."""
    copies = picks.withColumn(
        "copy_no",
        # as many rows as one specification has parts
        F.row_number().over(W.partitionBy("doc_id", "page_no").orderBy("pos")),
    )
    return copies.join(pages.select("doc_id", "page_no", *columns), ["doc_id", "page_no"]).select(
        "doc_id", F.col("pos").alias("page_no"), F.col("page_no").alias("source_page"), "copy_no", *columns
    )


#: Parts of a specification that are looked through for each page; longer ones are resolved into rows.
FEW_PARTS = 64


def arrange_named(pages: DataFrame, specs: DataFrame, columns: list[str], *, dealt: bool = False) -> DataFrame:
    """As :func:`arrange` by resolved specifications, with places worked out from the intervals.

    One join on the document, and no row per page picked before it. ``dealt`` as in ``with_document``.
    """
    pages = pages.select("doc_id", "page_no", *columns)
    good = specs.filter(F.col("error").isNull() & (F.size("spans") > 0))
    few = good.filter(F.size("spans") <= FEW_PARTS).select("doc_id", F.col("page_count").alias("__count"), "spans")
    placed = with_document(pages, few, count="__count", dealt=dealt).withColumn(
        "__places", ranges.places_of(F.col("spans"), F.col("page_no").cast("bigint"))
    )
    out = placed.select("doc_id", F.col("page_no").alias("source_page"), *columns, F.posexplode("__places").alias("__copy", "__pos")).select(
        "doc_id", F.col("__pos").cast("int").alias("page_no"), "source_page", (F.col("__copy") + 1).alias("copy_no"), *columns
    )
    # a part takes one character and a comma
    if specs.filter(F.length("spec") > 2 * FEW_PARTS).isEmpty():
        return out
    return out.unionByName(arrange(pages, resolve(good.filter(F.size("spans") > FEW_PARTS)), columns))


def _with_spans(pages: DataFrame, specs: DataFrame, dealt: bool) -> DataFrame:
    good = specs.filter(F.col("error").isNull()).select("doc_id", "page_count", "unique_spans")
    return with_document(pages.select("doc_id", "page_no"), good, dealt=dealt)


def delete(pages: DataFrame, specs: DataFrame, *, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Drop the selected pages and close the gaps; deleting all of them is refused. ``dealt`` as in ``with_document``."""
    gone = ranges.span_length(F.col("unique_spans"))
    page = F.col("page_no")
    kept = _with_spans(pages, specs.filter(gone < F.col("page_count")), dealt).filter(~ranges.holds(F.col("unique_spans"), page))
    ok = kept.select(
        "doc_id", (page - ranges.held_before(F.col("unique_spans"), page)).cast("int").alias("page_no"), page.alias("source_page")
    )
    rejects = specs.filter(F.col("error").isNull() & (gone >= F.col("page_count"))).select(
        "doc_id", F.lit("EmptySelection").alias("error"), F.lit("every page would be deleted").alias("detail")
    )
    return ok, rejects


def move(pages: DataFrame, specs: DataFrame, before: Column, *, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Put the selected pages, in the order named, just before the old position ``before`` (from 1).

    ``before`` may be one past the end. New positions are arithmetic on the intervals.
    ``dealt`` as in ``with_document``.
    """
    target = before.cast("long")
    count = ranges.span_length(F.col("unique_spans"))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(count == 0, F.lit("EmptySelection"))
        .when((target < 1) | (target > F.col("page_count") + 1), F.lit("PageOutOfRange"))
    )
    checked = specs.withColumn("__target", target).withColumn("__error", error)
    spans, page = F.col("unique_spans"), F.col("page_no").cast("long")
    stay_before_target = F.col("__target") - 1 - ranges.held_before(spans, F.col("__target"))
    moved = stay_before_target + ranges.place_of(spans, page)
    stayed = page - ranges.held_before(spans, page) + F.when(page >= F.col("__target"), ranges.span_length(spans)).otherwise(0)
    good = checked.filter(F.col("__error").isNull()).select("doc_id", "page_count", "unique_spans", "__target")
    ok = (
        with_document(pages.select("doc_id", "page_no"), good, dealt=dealt)
        .select(
            "doc_id",
            F.when(ranges.holds(spans, page), moved).otherwise(stayed).cast("int").alias("page_no"),
            F.col("page_no").alias("source_page"),
        )
    )
    return ok, checked.filter(F.col("__error").isNotNull()).select("doc_id", F.col("__error").alias("error"))


def split_every(docs: DataFrame, size: int, *, width: int | None = None) -> DataFrame:
    """Pieces of ``size`` pages, the last maybe shorter: doc_id, chunk_no, chunks, first_page, last_page."""
    if size < 1:
        raise ValueError("InvalidPageRange: chunk size must be at least 1")
    counted = docs.select("doc_id", "page_count", F.ceil(F.col("page_count") / size).cast("int").alias("chunks"))
    rows = expand(counted, F.col("chunks"), "__i", bound=F.col("page_count"), spread=["doc_id"], width=width)
    return rows.select(
        "doc_id",
        (F.col("__i") + 1).cast("int").alias("chunk_no"),
        "chunks",
        (F.col("__i") * size + 1).cast("int").alias("first_page"),
        F.least((F.col("__i") + 1) * size, F.col("page_count")).cast("int").alias("last_page"),
    )


def split_by_outline(pages: DataFrame, docs: DataFrame, starts: DataFrame, *, width: int | None = None) -> DataFrame:
    """A piece from each start page to the next; earlier pages lead in a piece of their own."""
    marks = starts.select("doc_id", F.col("page").alias("page_no")).distinct()
    first = marks.groupBy("doc_id").agg(F.min("page_no").alias("__first"))
    flagged = pages.select("doc_id", "page_no").join(marks.withColumn("__start", F.lit(1)), ["doc_id", "page_no"], "left")
    large = docs.filter(F.col("page_count") >= F.lit(width or WIDTH)).select("doc_id")
    summed = running(
        flagged, ["doc_id"], "page_no", {"__n": Running("sum", F.coalesce(F.col("__start"), F.lit(0)))}, large=large, width=width
    )
    lead = F.when(F.coalesce(F.col("__first"), F.lit(2)) > 1, 1).otherwise(0)
    return summed.join(first, "doc_id", "left").select("doc_id", "page_no", (F.col("__n") + lead).cast("int").alias("chunk_no"))


FOLD_PAGES = 512


def split_by_size(pages: DataFrame, docs: DataFrame, limit_mb: int, *, fold_pages: int = FOLD_PAGES) -> DataFrame:
    """Greedy packing: doc_id, chunk_no, first_page, last_page, size_bytes. ``pages`` has ``bytes``.

    Packing is sequential. Documents of at most ``fold_pages`` pages are folded as one
    short array each. Larger ones find every page's next cut from running totals, then
    follow the cuts by pointer doubling, so none is handled by a single task.
    """
    if limit_mb < 1:
        raise ValueError("InvalidPageRange: maximum size must be at least 1 MB")
    limit = limit_mb * 1_000_000
    small = docs.filter((F.col("page_count") > 0) & (F.col("page_count") <= fold_pages)).select("doc_id")
    folded = _pack_small(pages.join(small, "doc_id", "left_semi"), limit)
    big = docs.filter(F.col("page_count") > fold_pages).select("doc_id", "page_count")
    if big.isEmpty():
        return folded
    return folded.unionByName(_pack_large(pages.join(big, "doc_id"), limit))


def _pack_small(pages: DataFrame, limit: int) -> DataFrame:
    shape = "struct<done:array<struct<first_page:int,last_page:int,size_bytes:bigint>>,first_page:int,last_page:int,size_bytes:bigint>"
    ordered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "bytes"))).alias("p"))

    def current(acc: Column) -> Column:
        return F.struct(acc["first_page"].alias("first_page"), acc["last_page"].alias("last_page"), acc["size_bytes"].alias("size_bytes"))

    def step(acc: Column, page: Column) -> Column:
        fresh = acc["first_page"].isNull() | (acc["size_bytes"] + page["bytes"] > limit)
        return F.struct(
            F.when(fresh & acc["first_page"].isNotNull(), F.array_append(acc["done"], current(acc))).otherwise(acc["done"]).alias("done"),
            F.when(fresh, page["page_no"]).otherwise(acc["first_page"]).alias("first_page"),
            page["page_no"].alias("last_page"),
            F.when(fresh, page["bytes"]).otherwise(acc["size_bytes"] + page["bytes"]).alias("size_bytes"),
        ).cast(shape)

    empty = F.struct(
        F.array().cast("array<struct<first_page:int,last_page:int,size_bytes:bigint>>").alias("done"),
        F.lit(None).cast("int").alias("first_page"),
        F.lit(None).cast("int").alias("last_page"),
        F.lit(0).cast("bigint").alias("size_bytes"),
    ).cast(shape)
    packed = F.aggregate("p", empty, step, lambda acc: F.array_append(acc["done"], current(acc)))
    return ordered.select("doc_id", F.posexplode(packed).alias("i", "c")).select(
        "doc_id", (F.col("i") + 1).cast("int").alias("chunk_no"), "c.first_page", "c.last_page", "c.size_bytes"
    )


def _pack_large(pages: DataFrame, limit: int) -> DataFrame:
    sums = running(
        pages.select("doc_id", "page_no", "page_count", "bytes"),
        ["doc_id"],
        "page_no",
        {"upto": Running("sum", F.col("bytes"))},
    )
    # a page starting at total t ends before the first page whose total passes t + limit
    ends = sums.select("doc_id", (F.col("upto") * 2).alias("at"), F.lit(1).cast("long").alias("is_end"), F.lit(None).cast("int").alias("page_no"))
    asks = sums.select(
        "doc_id", ((F.col("upto") - F.col("bytes") + limit) * 2 + 1).alias("at"), F.lit(0).cast("long").alias("is_end"), "page_no"
    )
    counted = running(ends.unionByName(asks), ["doc_id"], "at", {"fit": Running("sum", F.col("is_end"))}, width=2 * limit)
    cuts = (
        counted.filter(F.col("page_no").isNotNull())
        .join(pages.select("doc_id", "page_no", "page_count"), ["doc_id", "page_no"])
        .select(
            "doc_id",
            F.col("page_no").alias("node"),
            F.when(F.greatest(F.col("fit"), F.col("page_no")) < F.col("page_count"), F.greatest(F.col("fit"), F.col("page_no")) + 1)
            .cast("int")
            .alias("next"),
            F.greatest(F.col("fit"), F.col("page_no")).cast("int").alias("last_page"),
        )
    )
    heads = cuts.filter(F.col("node") == 1).select("doc_id", "node")
    chain = walk_chain(cuts, heads, ["doc_id"], [])
    bounds = sums.select("doc_id", F.col("page_no").alias("node"), (F.col("upto") - F.col("bytes")).alias("before"))
    finish = sums.select("doc_id", F.col("page_no").alias("last_page"), "upto")
    return (
        chain.join(cuts.select("doc_id", "node", "last_page"), ["doc_id", "node"])
        .join(bounds, ["doc_id", "node"])
        .join(finish, ["doc_id", "last_page"])
        .select(
            "doc_id",
            F.col("pos").cast("int").alias("chunk_no"),
            F.col("node").alias("first_page"),
            "last_page",
            (F.col("upto") - F.col("before")).alias("size_bytes"),
        )
    )


def _tokens(index: Column, total: Column, stem: Column, pages: Column) -> list[tuple[str, Column]]:
    return [
        ("{index:0{width}d}", zero_pad(index, total)),
        ("{stem}", stem),
        ("{index}", index),
        ("{width}", F.length(total.cast("string"))),
        ("{pages}", pages),
    ]


def manifest(chunks: DataFrame, pattern: str, stem: Column) -> DataFrame:
    """Names of all pieces, known before any of them is written."""
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    shown = F.when(F.col("first_page") == F.col("last_page"), first).otherwise(F.concat(first, F.lit("-"), last))
    return chunks.select(
        "doc_id",
        "chunk_no",
        fill_tokens(pattern, _tokens(F.col("chunk_no"), F.col("chunks"), stem, shown)).alias("name"),
    )


def extract_names(specs: DataFrame, pattern: str, stem: Column) -> DataFrame:
    """The one name of an extracted piece: ``{pages}`` is a span when unbroken, else the sorted list, however long."""
    good = specs.filter(F.col("error").isNull() & (F.size("unique_spans") > 0))
    spans = F.array_sort("unique_spans")
    low, high = F.array_min(F.transform(spans, lambda s: s["lo"])), F.array_max(F.transform(spans, lambda s: s["hi"]))
    count = ranges.span_length(spans)
    unbroken = count == high - low + 1
    listed = F.array_join(F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"]))).cast("array<string>"), ",")
    shown = (
        F.when(unbroken & (low == high), low.cast("string"))
        .when(unbroken, F.concat(low.cast("string"), F.lit("-"), high.cast("string")))
        .otherwise(listed)
    )
    one = F.lit(1)
    return good.select("doc_id", one.alias("chunk_no"), fill_tokens(pattern, _tokens(one, one, stem, shown)).alias("name"))


def page_names(picks: DataFrame, docs: DataFrame, stem: Column, extension: str) -> DataFrame:
    """One file name per picked page, padded to the digits of the document's page count."""
    return with_document(picks, docs).select(
        "doc_id",
        "pos",
        F.concat(stem, F.lit("-"), zero_pad(F.col("page_no"), F.col("page_count")), F.lit(f".{extension}")).alias("name"),
    )


def rescue_choice(versions: DataFrame) -> DataFrame:
    """The version with most pages; the one loaded first (lower ``prio``) wins ties."""
    return versions.groupBy("doc_id").agg(
        F.max_by(F.struct("version", "page_count"), F.struct(F.col("page_count"), -F.col("prio"))).alias("v")
    ).select("doc_id", "v.version", "v.page_count")

