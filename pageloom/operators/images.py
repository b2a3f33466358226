"""Embedded images: effective resolution, what to recompress, reports, targets, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pageloom.plans.scan import Running, groups_past, running

# Target resolution by level, and when recompression is worth it.
TARGETS = {"screen": 72.0, "ebook": 150.0, "print": 300.0}
RESAMPLE_MARGIN = 1.15
TINY_EDGE = 64


def effective_dpi(images: DataFrame, placements: DataFrame) -> DataFrame:
    """Resolution at the largest drawn width and the largest drawn height, taken apart."""
    drawn = placements.groupBy("image_id").agg(F.max("draw_w").alias("draw_w"), F.max("draw_h").alias("draw_h"))
    dpi = F.greatest(F.col("px_w") / (F.col("draw_w") / 72.0), F.col("px_h") / (F.col("draw_h") / 72.0))
    return (
        images.join(drawn.filter((F.col("draw_w") > 0) & (F.col("draw_h") > 0)), "image_id")
        .select("image_id", "px_w", "px_h", dpi.alias("dpi"))
    )


def _raw(filter_: Column) -> Column:
    return filter_.isNull() | (filter_ == "FLATE")


def decodable() -> Column:
    """Whether the samples can be read: JPEG always; deflated or unfiltered ones if RGB or gray at eight bits."""
    plain = F.coalesce(F.col("bits") == 8, F.lit(False)) & F.coalesce(F.col("colorspace").isin("DeviceRGB", "RGB", "DeviceGray", "G"), F.lit(False))
    return F.coalesce(F.col("filter") == "DCT", F.lit(False)) | (_raw(F.col("filter")) & plain)


def triage(images: DataFrame, placements: DataFrame, level: str) -> DataFrame:
    """First matching reason to leave an image alone, or its new pixel size."""
    target = TARGETS[level]
    dpi = effective_dpi(images, placements).select("image_id", "dpi")
    reason = (
        F.when(F.col("masked"), "mask")
        .when(~(_raw(F.col("filter")) | (F.col("filter") == "DCT")), "unsupported filter")
        .when(~decodable(), "unsupported samples")
        .when(F.greatest("px_w", "px_h") <= TINY_EDGE, "tiny")
        .when(F.col("dpi").isNull(), "never drawn")
        .when(F.col("dpi") <= target * RESAMPLE_MARGIN, "already small")
        .otherwise("recompress")
    )

    def resized(px: str):
        new = F.greatest(F.round(F.col(px) * (F.lit(target) / F.col("dpi"))).cast("int"), F.lit(1))
        return F.when(reason == "recompress", new)

    return images.join(dpi, "image_id", "left").select(
        "image_id", reason.alias("outcome"), resized("px_w").alias("new_w"), resized("px_h").alias("new_h")
    )


def compress_report(uses: DataFrame, images: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per document and outcome: images, samples before and after, in bytes; with the document's totals beside them.

    ``uses``: doc_id, image_id; ``images`` has px_w and px_h. An image counts once per
    document. Sizes are those of the decoded samples, three bytes a pixel.
    """
    before = F.col("px_w").cast("long") * F.col("px_h") * 3
    after = F.coalesce(F.col("new_w").cast("long") * F.col("new_h") * 3, before)
    sized = images.join(outcomes, "image_id").select("image_id", "outcome", before.alias("before"), after.alias("after"))
    by_outcome = (
        uses.select("doc_id", "image_id").distinct().join(sized, "image_id").groupBy("doc_id", "outcome")
        .agg(F.count(F.lit(1)).alias("images"), F.sum("before").alias("bytes_before"), F.sum("after").alias("bytes_after"))
    )
    total = W.partitionBy("doc_id")  # a row for each outcome at most
    return by_outcome.select(
        "*",
        F.sum("images").over(total).alias("examined"),
        F.sum(F.when(F.col("outcome") == "recompress", F.col("images")).otherwise(0)).over(total).alias("recompressed"),
    )


def filter_report(picks: DataFrame, uses: DataFrame, images: DataFrame) -> DataFrame:
    """Per document: images on the picked pages, how many can be filtered, and how many are skipped by reason."""
    used = picks.join(uses, ["doc_id", "page_no"]).select("doc_id", "image_id").distinct().join(images, "image_id")
    mask = F.coalesce("masked", F.lit(False))
    count = lambda test, name: F.sum(F.when(test, 1).otherwise(0)).cast("long").alias(name)
    return used.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("images_examined"),
        count(~mask & decodable(), "usable"),
        count(mask, "skipped_mask"),
        count(~mask & ~decodable(), "skipped_samples"),
    )


def filter_targets(picks: DataFrame, uses: DataFrame, *, width: int | None = None) -> DataFrame:
    """Distinct images of the picked pages in first-use order. ``uses``: doc_id, page_no, image_id.

    ``pos`` of the picks counts from 1 within a document, so few documents reach past a bucket.
    """
    first = (
        picks.join(uses, ["doc_id", "page_no"])
        .groupBy("doc_id", "image_id")
        .agg(F.min("pos").alias("first_pos"))
    )
    large = groups_past(picks, ["doc_id"], "pos", width)
    return running(first, ["doc_id"], "first_pos", {"ord": Running("sum", F.lit(1))}, large=large, width=width).select(
        "doc_id", "image_id", F.col("ord").cast("int").alias("ord")
    )


def asset_manifest(uses: DataFrame, images: DataFrame, *, width: int | None = None) -> DataFrame:
    """Names of the extractable images per document in object order; skipped ones use no number."""
    good = images.filter(decodable()).select("image_id", "filter")
    written = uses.select("doc_id", "image_id").distinct().join(good, "image_id")
    numbered = running(written, ["doc_id"], "image_id", {"n": Running("sum", F.lit(1))}, width=width)
    ext = F.when(F.col("filter") == "DCT", "jpg").otherwise("png")
    return numbered.select(
        "doc_id",
        "image_id",
        F.col("n").cast("int").alias("n"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("-image-"), F.col("n").cast("string"), F.lit("."), ext).alias("name"),
    )


def compare(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Share of positions where any of three samples differs by more than the tolerance.

    Arrays of unequal length have no answer. A page is one row, so nothing is shuffled.
    """
    left, right = F.col("left_s"), F.col("right_s")
    same = F.size(left) == F.size(right)
    spots = F.floor(F.size(left) / 3).cast("int")

    def differs(at, c: int):
        i = at * 3 + c
        return F.abs(F.get(left, i).cast("double") - F.get(right, i).cast("double")) > tolerance

    changed = F.size(
        F.filter(F.sequence(F.lit(0), spots - 1), lambda at: differs(at, 0) | differs(at, 1) | differs(at, 2))
    )
    counted = F.when(spots > 0, changed).otherwise(0)
    return pairs.select(
        "pair_id",
        F.when(same, counted).alias("changed"),
        F.when(same, spots).alias("total"),
        F.when(same, F.round(F.when(spots > 0, counted * 100.0 / spots).otherwise(0.0), 4)).alias("percent"),
    )
