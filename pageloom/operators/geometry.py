"""Page geometry: rotate, crop, resize, halve, place images, overlay, impose, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions import geometry as g
from pageloom.functions.binding import bind
from pageloom.functions.labels import fill_tokens
from pageloom.operators.rejects import first_error, keep_good
from pageloom.operators.selection import selected
from pageloom.plans.scan import WIDTH, with_document


def media(df_prefix: str = "page_") -> g.Box:
    zero = F.lit(0.0)
    return g.Box(zero, zero, F.col(f"{df_prefix}w"), F.col(f"{df_prefix}h"))


def crop_box() -> g.Box:
    """The stored crop box: the media box shrunk by ``crop_inset``; NULL edges when absent."""
    inset = F.col("crop_inset")
    return g.Box(inset, inset, F.col("page_w") - inset, F.col("page_h") - inset)


def shown_box() -> g.Box:
    """The crop box inside the media box where they overlap, else the media box.

    The stored crop is the same inset on all edges, so one trimmed value gives the box.
    """
    inset = F.col("crop_inset")
    trim = F.when(inset * 2 < F.least("page_w", "page_h"), F.greatest(inset, F.lit(0.0))).otherwise(0.0)
    return g.Box(trim, trim, F.col("page_w") - trim, F.col("page_h") - trim)


def rotate(pages: DataFrame, specs: DataFrame, degrees: int) -> DataFrame:
    """Add ``degrees`` to the selected pages; a full turn removes the value."""
    if degrees % 90:
        raise ValueError(f"InvalidRotation: {degrees} is not a multiple of 90")
    turned = F.nullif(F.pmod(F.col("rotate") + degrees, F.lit(360)), F.lit(0))
    return selected(pages, specs).select(
        "doc_id",
        "page_no",
        F.when(F.col("selected"), turned).otherwise(F.nullif(F.col("rotate"), F.lit(0))).cast("int").alias("rotate"),
    )


def _gated(df: DataFrame, result: g.Box, error: str) -> tuple[DataFrame, DataFrame]:
    """(boxes of the selected pages, rejects); bad pages are found by plain expressions, which reach below the joins of ``df``."""
    bad = df.filter(F.col("selected") & ~result.has_area)
    good = df.filter("selected").join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
    ok = bind(good, F.struct(*[v.alias(f"n_{n}") for n, v in zip(("x0", "y0", "x1", "y1"), result)])).select("doc_id", "page_no", *g.named_box("n_").columns())
    detail = F.concat(F.lit("page "), F.col("page_no").cast("string"))
    return ok, first_error(bad, ["doc_id"], F.lit(error), detail, F.col("page_no"))


def crop(pages: DataFrame, specs: DataFrame, rect: g.Box) -> tuple[DataFrame, DataFrame]:
    """Crop to ``rect`` inside the media box: (new boxes, rejects)."""
    df = selected(pages, specs)
    return _gated(df, g.intersect(rect, media()), "InvalidCropBox")


def crop_margins(pages: DataFrame, specs: DataFrame, *, top: float, bottom: float, left: float, right: float) -> tuple[DataFrame, DataFrame]:
    """Trim margins off what each page shows now, named for the displayed page."""
    df = bind(selected(pages, specs), g.stored_margins(F.col("rotate"), top, bottom, left, right))
    return _gated(df, g.inset(shown_box(), g.named_box("e_")), "InvalidCropBox")


def set_mediabox(pages: DataFrame, specs: DataFrame, rect: g.Box) -> DataFrame:
    """Replace the media box; a crop box is pulled back inside or dropped."""
    clipped = g.intersect(crop_box(), rect)
    keep = F.col("crop_inset").isNotNull() & clipped.has_area
    crop_cols = [F.when(keep, c).alias(f"crop_{n}") for n, c in zip(("x0", "y0", "x1", "y1"), clipped)]
    return selected(pages, specs).filter("selected").select("doc_id", "page_no", *rect.columns("media_"), *crop_cols)


def mediabox_rejects(specs: DataFrame, rect: g.Box) -> DataFrame:
    """Documents that ask for a media box without area; nothing of them is changed."""
    return specs.filter(F.col("error").isNull() & ~rect.has_area).select("doc_id", F.lit("InvalidMediaBox").alias("error"))


def reset_crop(pages: DataFrame, specs: DataFrame) -> DataFrame:
    return selected(pages, specs).select(
        "doc_id", "page_no", F.when(~F.col("selected"), F.col("crop_inset")).alias("crop_inset")
    )


def scale(pages: DataFrame, specs: DataFrame, paper: str, fit: str) -> DataFrame:
    """Resize to a paper size; a page shown on its side stores the transpose."""
    w, h = (F.lit(v) for v in g.PAPER[paper])
    side = g.turned(F.col("rotate"))
    target_w, target_h = F.when(side, h).otherwise(w), F.when(side, w).otherwise(h)
    sx, sy = g.fit_scale(fit, target_w, target_h, F.col("page_w"), F.col("page_h"))
    return selected(pages, specs).filter("selected").select(
        "doc_id",
        "page_no",
        target_w.alias("media_w"),
        target_h.alias("media_h"),
        F.round(sx, 4).alias("scale_x"),
        F.round(sy, 4).alias("scale_y"),
        (F.round((target_w - F.col("page_w") * sx) / 2, 4) + F.lit(0.0)).alias("offset_x"),
        (F.round((target_h - F.col("page_h") * sy) / 2, 4) + F.lit(0.0)).alias("offset_y"),
    )


def halve(pages: DataFrame, direction: str, gap: float, swap: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cut every page in two, at positions 2i-1 and 2i; the gap is dropped on both sides."""
    s = shown_box()
    if direction == "vertical":
        mid = (s.x0 + s.x1) / 2
        first, second = s._replace(x1=mid - gap), s._replace(x0=mid + gap)
    else:
        mid = (s.y0 + s.y1) / 2
        first, second = s._replace(y0=mid + gap), s._replace(y1=mid - gap)
    if swap:
        first, second = second, first
    bad = ~(first.has_area & second.has_area)
    parts = [
        F.struct(F.lit(i).alias("half"), *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)])
        for i, b in enumerate((first, second))
    ]
    good = keep_good(pages, ["doc_id"], bad)
    ok = good.select("doc_id", "page_no", F.inline(F.array(*parts))).select(
        "doc_id", (F.col("page_no") * 2 - 1 + F.col("half")).cast("int").alias("page_no"), *g.named_box("").columns()
    )
    rejects = first_error(
        pages,
        ["doc_id"],
        F.when(bad, F.lit("InvalidCropBox")),
        F.concat(F.lit("page "), F.col("page_no").cast("string")),
        F.col("page_no"),
    )
    return ok, rejects


def fit_images(images: DataFrame, paper: str | None, fit: str, margin: float, dpi: float) -> DataFrame:
    """Place each image on a page of its own; without a paper the page is the image."""
    px_w, px_h = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("px_w", "px_h"))
    if paper is None:
        page_w = w = px_w / dpi * 72.0
        page_h = h = px_h / dpi * 72.0
        x = y = F.lit(0.0)
    else:
        pw, ph = g.PAPER[paper]
        m = max(margin, 0.0)
        box_w, box_h = F.lit(max(pw - 2 * m, 1.0)), F.lit(max(ph - 2 * m, 1.0))
        page_w, page_h = F.lit(pw), F.lit(ph)
        sx, sy = g.fit_scale(fit, box_w, box_h, px_w, px_h)
        w, h = px_w * sx, px_h * sy
        x, y = (page_w - w) / 2, (page_h - h) / 2
    return images.select(
        "image_id",
        *[(F.round(v, 4) + F.lit(0.0)).alias(n) for n, v in (("page_w", page_w), ("page_h", page_h), ("x", x), ("y", y), ("w", w), ("h", h))],
    )


def overlay_pairs(pages: DataFrame, pairs: DataFrame, *, width: int | None = None) -> DataFrame:
    """Base page i with overlay page min(i, last). ``pairs``: doc_id, page_count, overlay_id, overlay_count.

    All pages past a short overlay meet its last page. They are told apart by buckets of
    base pages, and the last page is repeated for as many as the longest base has.
    """
    width = width or WIDTH
    usable = pairs.filter(F.col("overlay_count") > 0)
    late = F.when(F.col("page_no") > F.col("overlay_count"), F.floor((F.col("page_no") - 1) / F.lit(width))).otherwise(0).cast("long")
    base = with_document(pages, usable, width=width).withColumn("__late", late).withColumn(
        "overlay_page", F.least(F.col("page_no"), F.col("overlay_count"))
    )
    last = usable.groupBy("overlay_id", F.col("overlay_count").alias("overlay_page")).agg(F.max("page_count").alias("__longest"))
    over = pages.select(
        F.col("doc_id").alias("overlay_id"), F.col("page_no").alias("overlay_page"), F.col("page_w").alias("ow"), F.col("page_h").alias("oh")
    ).join(last, ["overlay_id", "overlay_page"], "left")
    top = F.floor((F.greatest(F.coalesce("__longest", F.lit(1)), F.lit(1)) - 1) / F.lit(width)).cast("long")
    over = over.withColumn("__late", F.explode(F.sequence(F.lit(0).cast("long"), top))).drop("__longest")
    return base.join(over, ["overlay_id", "overlay_page", "__late"]).select(
        "doc_id",
        "page_no",
        "overlay_id",
        "overlay_page",
        F.round(F.least(F.col("page_w") / F.col("ow"), F.col("page_h") / F.col("oh")), 4).alias("scale"),
    )


def _stamp(template: str) -> Column:
    return fill_tokens(template, [("{total}", F.col("page_count")), ("{n}", F.col("page_no"))])


def stamp_text(pages: DataFrame, template: str, anchor: str, *, margin: float, font_size: float) -> DataFrame:
    """A line of text per page: ``{total}`` first, then ``{n}``; width is half an em per character.

    ``pages`` carries page_count, the document-wide total.
    """
    text = _stamp(template)
    width = F.length(text) * F.lit(font_size * 0.5)
    x, y = g.anchor_point(anchor, F.col("page_w"), F.col("page_h"), width, F.lit(font_size), margin)
    return pages.select(
        "doc_id",
        "page_no",
        F.lit(anchor).alias("anchor"),
        text.alias("text"),
        F.round(x, 4).alias("x"),
        F.round(y, 4).alias("y"),
    )


def header_footer(pages: DataFrame, header: str | None, footer: str | None, *, margin: float, font_size: float) -> DataFrame:
    """Both lines of every page, made in its one row, so that what ``pages`` is joined from runs once."""
    if header is None and footer is None:
        raise ValueError("a header or a footer is needed")
    stamps = [(text, anchor) for text, anchor in ((header, "top-center"), (footer, "bottom-center")) if text is not None]
    size = F.lit(font_size)
    lines = []
    for template, anchor in stamps:
        text = _stamp(template)
        x, y = g.anchor_point(anchor, F.col("page_w"), F.col("page_h"), F.length(text) * F.lit(font_size * 0.5), size, margin)
        lines.append(F.struct(F.lit(anchor).alias("anchor"), text.alias("text"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y")))
    return pages.select("doc_id", "page_no", F.inline(F.array(*lines)))


def nup(
    pages: DataFrame, rows: int, cols: int, paper: str, fit: str, *, margin: float = 0.0, gap: float = 0.0, column_major: bool = False
) -> DataFrame:
    """Several pages per sheet: sheet, row, column and placement of every page."""
    if not (1 <= rows <= 10 and 1 <= cols <= 10):
        raise ValueError("rows and columns must be 1 to 10")
    index = F.col("page_no") - 1
    cell = index % (rows * cols)
    if column_major:
        row, col = cell % rows, F.floor(cell / rows)
    else:
        row, col = F.floor(cell / cols), cell % cols
    pw, ph = g.PAPER[paper]
    cell_w = (pw - 2 * margin - gap * (cols - 1)) / cols
    cell_h = (ph - 2 * margin - gap * (rows - 1)) / rows
    x = F.lit(margin) + col * F.lit(cell_w + gap)
    y = F.lit(ph - margin) - (row + 1) * F.lit(cell_h) - row * F.lit(gap)
    sx, sy = g.fit_scale(fit, F.lit(cell_w), F.lit(cell_h), F.col("page_w"), F.col("page_h"))
    if fit != "stretch":
        x = x + (F.lit(cell_w) - F.col("page_w") * sx) / 2
        y = y + (F.lit(cell_h) - F.col("page_h") * sy) / 2
    return pages.select(
        "doc_id",
        "page_no",
        (F.floor(index / (rows * cols)) + 1).cast("int").alias("sheet"),
        row.cast("int").alias("row_no"),
        col.cast("int").alias("col_no"),
        (F.round(x, 4) + F.lit(0.0)).alias("x"),
        (F.round(y, 4) + F.lit(0.0)).alias("y"),
        F.round(sx, 4).alias("scale_x"),
        F.round(sy, 4).alias("scale_y"),
    )


def _slot(place: Column, size: int) -> Column:
    """Where the page at a place (from 0) of its signature is printed (from 0)."""
    front = place < size // 2
    leaf = F.when(front, place).otherwise(size - 1 - place)
    second = F.when(leaf % 2 == 0, front).otherwise(~front)
    return leaf * 2 + second.cast("int")


def booklet(pages: DataFrame, docs: DataFrame, size: int, *, long_edge: bool = False) -> DataFrame:
    """Print order of every page, two to a sheet side; padding slots have a NULL page.

    Each page finds its own slot, so the order needs no sort and no join.
    """
    if size % 4 or not 4 <= size <= 32:
        raise ValueError("the signature must be 4 to 32 and a multiple of 4")
    padded = F.floor((F.col("page_count") + size - 1) / size) * size
    blanks = (
        docs.filter((F.col("page_count") > 0) & (F.col("page_count") < padded))
        .select("doc_id", F.explode(F.sequence(F.col("page_count").cast("long") + 1, padded)).alias("place"))
        .select("doc_id", "place", F.lit(None).cast("int").alias("page_no"))
    )
    placed = pages.select("doc_id", F.col("page_no").cast("long").alias("place"), "page_no").unionByName(blanks)
    index = F.col("place") - 1
    slot = F.floor(index / size) * size + _slot(index % size, size)
    half = (slot % 2).cast("int")
    zero = F.lit(0)
    return placed.select(
        "doc_id",
        (slot + 1).cast("int").alias("slot"),
        (F.floor(slot / 2) + 1).cast("int").alias("side"),
        (half if long_edge else zero).alias("row_no"),
        (zero if long_edge else half).alias("col_no"),
        "page_no",
    )
