"""Headings, lists and paragraphs inferred from font sizes and left edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pageloom.functions.text import bullet_body, collapse
from pageloom.plans.shared import materialize
from pageloom.plans.scan import WIDTH, Running, running

HEADING_MARGIN = 1.1
DEFAULT_BODY = 12.0


def size_bucket(size: Column) -> Column:
    """Half-point bucket."""
    return F.round(size * 2) / 2


def size_weights(lines: DataFrame) -> DataFrame:
    """Characters set in each size bucket, at least one per line."""
    return lines.groupBy("doc_id", size_bucket(F.col("size")).alias("bucket")).agg(
        F.sum(F.greatest(F.length("text"), F.lit(1))).alias("weight")
    )


def body_sizes(lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The most used size per document; the larger wins a tie. Documents of ``docs`` without lines get the default."""
    found = _most_used(lines)
    if docs is None:
        return found
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(DEFAULT_BODY)).alias("body"))


def _most_used(lines: DataFrame) -> DataFrame:
    return size_weights(lines).groupBy("doc_id").agg(F.max_by("bucket", F.struct("weight", "bucket")).alias("body"))


def heading_levels(lines: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """Sizes above 1.1 body as levels, the largest first, at most 6.

    Ranks run over distinct half-point sizes, a few hundred per document at most.
    """
    body = body if body is not None else body_sizes(lines)
    sizes = lines.select("doc_id", size_bucket(F.col("size")).alias("bucket")).distinct()
    rank = F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("bucket").desc()))
    return (
        sizes.join(body, "doc_id")
        .filter(F.col("bucket") > F.col("body") * HEADING_MARGIN)
        .select("doc_id", "bucket", F.least(rank, F.lit(6)).alias("level"))
    )


def page_left(lines: DataFrame) -> DataFrame:
    """The left edge most lines of a page start at; the smaller wins a tie."""
    edges = lines.groupBy("doc_id", "page_no", F.round("x0").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    return edges.groupBy("doc_id", "page_no").agg(F.max_by("edge", F.struct(F.col("n"), -F.col("edge"))).alias("page_left"))


_STATE = "struct<keep:double,then:double>"


def _effect(line: Column) -> Column:
    """What a line does to the item anchor above it: kept when at most ``keep``, else ``then``."""
    never = F.lit(float("-inf"))
    hang = line["x0"] - line["size"] * 0.5
    return F.struct(
        F.when(line["heading"] | line["bullet"], never).otherwise(hang).alias("keep"),
        F.when(line["heading"], F.lit(None).cast("double"))
        .when(line["bullet"] | line["indented"], line["x0"])
        .alias("then"),
    ).cast(_STATE)


def _after(anchor: Column, effect: Column) -> Column:
    return F.when(anchor.isNotNull() & (anchor <= effect["keep"]), anchor).otherwise(effect["then"])


def _chain(first: Column, second: Column) -> Column:
    """Two effects in a row are again one effect."""
    return F.when(second["keep"] < first["keep"], second).otherwise(
        F.struct(first["keep"].alias("keep"), _after(first["then"], second).alias("then")).cast(_STATE)
    )


FOLD_LINES = 1024


def _with_anchor(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Add the item anchor each stretch is entered with.

    Stretches are counted within their block (numbers may be missing where lines were
    blank). The effects of all stretches above are composed by a doubling prefix scan
    over joins, in as many rounds as the longest block needs.
    """
    none = F.lit(None).cast("double")
    counted = running(stretches.select(*keys, "__s"), keys, "__s", {"__k": Running("sum", F.lit(1))})
    counted = materialize(stretches.join(counted, [*keys, "__s"]), "stretches")
    top = counted.agg(F.max("__k")).first()[0] or 1
    if top == 1:
        return counted.withColumn("__entry", none)
    neutral = F.struct(F.lit(float("inf")).alias("keep"), none.alias("then")).cast(_STATE)
    effects = materialize(
        counted.select(*keys, "__k", F.aggregate("rows", neutral, lambda acc, r: _chain(acc, _effect(r))).alias("e")), "effects"
    )
    step = 1
    while step < top:
        above = effects.select(*keys, (F.col("__k") + step).alias("__k"), F.col("e").alias("__above"))
        joined = effects.join(above, [*keys, "__k"], "left")
        both = F.when(F.col("__above").isNull(), F.col("e")).otherwise(_chain(F.col("__above"), F.col("e")))
        effects = materialize(joined.select(*keys, "__k", both.alias("e")), "effects")
        step *= 2
    entries = effects.select(*keys, (F.col("__k") + 1).alias("__k"), F.col("e.then").alias("__entry"))
    return counted.join(entries, [*keys, "__k"], "left")


def classify(lines: DataFrame, *, fold_lines: int = FOLD_LINES, headings: bool = True, lists: bool = True) -> DataFrame:
    """Kind of every line: heading, item, tail or paragraph.

    ``lines`` has doc_id, page_no, block_no, line_no, text, size, x0. Whether a line is
    the tail of a list item depends on the item still open above it. A block is cut
    into stretches of ``fold_lines`` lines; each stretch is summed up as one effect, the
    effects are chained over the block, and every stretch is then read from its anchor.
    Without ``headings`` or ``lists`` such lines are taken for what else they can be.
    """
    body = body_sizes(lines)
    levels = heading_levels(lines, body)
    edges = page_left(lines)
    bullet = bullet_body(F.col("text"))
    tagged = (
        lines.withColumn("bucket", size_bucket(F.col("size")))
        .join(levels, ["doc_id", "bucket"], "left")
        .join(edges, ["doc_id", "page_no"])
        .withColumn("level", F.when(F.lit(headings), F.col("level")))
        .withColumn("__heading", F.col("level").isNotNull())
        .withColumn("__bullet", F.lit(lists) & bullet.isNotNull())
        .withColumn("__indented", F.lit(lists) & (F.col("x0") >= F.col("page_left") + F.col("size")))
        .withColumn("__text", F.when(F.col("level").isNull() & F.col("__bullet"), bullet).otherwise(collapse(F.col("text"))))
    )
    keys = ["doc_id", "page_no", "block_no"]
    stretches = (
        tagged.withColumn("__s", F.floor(F.col("line_no") / fold_lines))
        .groupBy(*keys, "__s")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "line_no",
                        F.col("x0").alias("x0"),
                        F.col("size").alias("size"),
                        F.col("__heading").alias("heading"),
                        F.col("__bullet").alias("bullet"),
                        F.col("__indented").alias("indented"),
                        "level",
                        F.col("__text").alias("text"),
                    )
                )
            ).alias("rows")
        )
    )
    entered = _with_anchor(stretches, keys)
    entry = F.col("__entry")

    seen = "struct<anchor:double,out:array<struct<line_no:int,kind:string,level:int,text:string>>>"

    def read(acc: Column, r: Column) -> Column:
        open_item = acc["anchor"].isNotNull() & (acc["anchor"] <= r["x0"] - r["size"] * 0.5)
        kind = (
            F.when(r["heading"], F.lit("heading"))
            .when(r["bullet"], F.lit("item"))
            .when(open_item, F.lit("tail"))
            .when(r["indented"], F.lit("item"))
            .otherwise(F.lit("paragraph"))
        )
        row = F.struct(r["line_no"].alias("line_no"), kind.alias("kind"), r["level"].alias("level"), r["text"].alias("text"))
        return F.struct(
            _after(acc["anchor"], _effect(r)).alias("anchor"), F.array_append(acc["out"], row).alias("out")
        ).cast(seen)

    start = F.struct(entry.alias("anchor"), F.array().cast("array<struct<line_no:int,kind:string,level:int,text:string>>").alias("out")).cast(seen)
    return entered.select(*keys, F.inline(F.aggregate("rows", start, read, lambda acc: acc["out"])))


def to_markdown(
    lines: DataFrame,
    *,
    picks: DataFrame | None = None,
    fold_lines: int = FOLD_LINES,
    width: int | None = None,
    headings: bool = True,
    lists: bool = True,
) -> DataFrame:
    """Markdown fragments per line, with the separator that precedes each.

    With ``picks`` (doc_id, page_no) only those pages count, for the sizes too: what is a
    heading among all pages need not be one among the chosen.

    doc_id, line_no, fragment; concatenated in ``line_no`` order and closed by a newline
    they give the document. Lines continue their element with a space; items follow each
    other on the next line; anything else is set off by a blank line.
    """
    if picks is not None:
        lines = lines.join(picks.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi").select(*lines.columns)
    kinds = classify(lines, fold_lines=fold_lines, headings=headings, lists=lists)
    state = F.struct(F.col("kind").alias("kind"), F.col("block_no").alias("block"), F.col("page_no").alias("page"))
    above = running(
        kinds,
        ["doc_id"],
        "line_no",
        {
            "__prev": Running("last", state, inclusive=False),
            "__opened": Running(
                "last", F.when(F.col("kind") != "tail", F.col("kind")), inclusive=False
            ),
        },
        large=lines.filter(F.col("line_no") >= F.lit(width or WIDTH)).select("doc_id").distinct(),
        width=width,
    )
    same_block = (F.col("__prev.block") == F.col("block_no")) & (F.col("__prev.page") == F.col("page_no"))
    previous_item = F.col("__opened") == "item"
    joins = (F.col("kind") == "tail") | (same_block & (F.col("kind") == "paragraph") & (F.col("__prev.kind") == "paragraph"))
    separator = (
        F.when(F.col("__prev").isNull(), F.lit(""))
        .when(joins, F.lit(" "))
        .when((F.col("kind") == "item") & previous_item, F.lit("\n"))
        .otherwise(F.lit("\n\n"))
    )
    mark = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" ")))
        .when(F.col("kind") == "item", F.lit("- "))
        .otherwise(F.lit(""))
    )
    return above.select("doc_id", "line_no", F.concat(separator, mark, F.col("text")).alias("fragment"))
