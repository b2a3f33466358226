"""Boxes, paper sizes and placements as column arithmetic; a box is four DOUBLE columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

# Paper sizes in points.
PAPER = {"a4": (595.276, 841.89), "letter": (612.0, 792.0), "legal": (612.0, 1008.0)}

ANCHORS = [f"{v}-{h}" for v in ("top", "middle", "bottom") for h in ("left", "center", "right")]


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def has_area(self) -> Column:
        return (self.x1 > self.x0) & (self.y1 > self.y0)

    def columns(self, prefix: str = "") -> list[Column]:
        """The four edges rounded to 4 decimals, with -0.0 made 0.0."""
        names = ("x0", "y0", "x1", "y1")
        return [(F.round(v, 4) + F.lit(0.0)).alias(prefix + n) for v, n in zip(self, names)]


def box(x0: float, y0: float, x1: float, y1: float) -> Box:
    return Box(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])


def named_box(prefix: str) -> Box:
    return Box(*[F.col(prefix + n) for n in ("x0", "y0", "x1", "y1")])


def intersect(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def overlaps(a: Box, b: Box) -> Column:
    """Shared area; touching edges do not count."""
    return (a.x0 < b.x1) & (a.x1 > b.x0) & (a.y0 < b.y1) & (a.y1 > b.y0)


def contains(outer: Box, inner: Box) -> Column:
    return (inner.x0 >= outer.x0) & (inner.y0 >= outer.y0) & (inner.x1 <= outer.x1) & (inner.y1 <= outer.y1)


def choose(condition: Column, yes: Box, no: Box) -> Box:
    return Box(*[F.when(condition, a).otherwise(b) for a, b in zip(yes, no)])


def transformed_bounds(matrix: list[Column], b: Box) -> Box:
    """Bounding box of a rectangle after the affine matrix ``[a b c d e f]``."""
    a, bb, c, d, e, f = matrix
    xs = [x * a + y * c + e for x, y in ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1))]
    ys = [x * bb + y * d + f for x, y in ((b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1))]
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def turned(rotation: Column) -> Column:
    """Whether the page shows on its side."""
    return F.pmod(rotation, F.lit(360)).isin(90, 270)


def stored_margins(rotation: Column, top: float, bottom: float, left: float, right: float) -> Column:
    """Margins named for the displayed page as a struct of the stored edges e_x0 to e_y1."""
    edges = {90: (top, left, bottom, right), 180: (right, top, left, bottom), 270: (bottom, right, top, left)}

    def record(values: tuple[float, ...]) -> Column:
        return F.struct(*[F.lit(float(v)).alias(f"e_{n}") for v, n in zip(values, ("x0", "y0", "x1", "y1"))])

    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, record(edges[90]))
        .when(turn == 180, record(edges[180]))
        .when(turn == 270, record(edges[270]))
        .otherwise(record((left, bottom, right, top)))
    )


def inset(shown: Box, margins: Box) -> Box:
    return Box(shown.x0 + margins.x0, shown.y0 + margins.y0, shown.x1 - margins.x1, shown.y1 - margins.y1)


def fit_scale(fit: str, target_w: Column, target_h: Column, source_w: Column, source_h: Column) -> tuple[Column, Column]:
    """Scale factors for contain, cover or stretch."""
    sx, sy = target_w / source_w, target_h / source_h
    if fit == "stretch":
        return sx, sy
    both = F.least(sx, sy) if fit == "contain" else F.greatest(sx, sy)
    return both, both


def anchor_point(anchor: str, page_w: Column, page_h: Column, w: Column, h: Column, margin: float) -> tuple[Column, Column]:
    """Lower-left corner of a box placed at one of nine anchors."""
    vertical, horizontal = anchor.split("-")
    m = F.lit(float(margin))
    x = {"left": m, "center": (page_w - w) / 2, "right": page_w - m - w}[horizontal]
    y = {"bottom": m, "middle": (page_h - h) / 2, "top": page_h - m - h}[vertical]
    return x, y


def render_pixels(points: Column, dpi: Column) -> Column:
    """Pixels along an edge at a resolution, at least one."""
    return F.greatest(F.round(points * dpi / 72.0).cast("int"), F.lit(1))
