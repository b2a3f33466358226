"""Redaction as joins: glyphs under a rectangle, runs holding a string, paths inside an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions import geometry as g
from pageloom.plans.shared import materialize

GLYPH = 5.5
BROADCAST_RECTS = 20_000
BAND = 64.0
#: Tasks that share the boxes of a cell, by document.
TURNS = 16
#: Needles of a document, and their characters, up to which each of its runs is searched for all of them.
FEW_NEEDLES = 256
FEW_CHARS = 20_000


def _with_rects(boxes: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Pair boxes with the rectangles of their page that may meet them.

    Few rectangles are broadcast after their number is checked. More than that are cut
    into cells, so the join stays a hash join.
    """
    named = rects.select(*keys, "rect_id", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    if len(rects.select("rect_id").take(BROADCAST_RECTS + 1)) <= BROADCAST_RECTS:
        return boxes.join(F.broadcast(named), keys)
    return banded_join(boxes, named, keys)


def banded_join(boxes: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of boxes and rectangles of one page that share a cell of BAND points square.

    The key is page, cell and a turn by document: first pages of all documents, the hottest
    key otherwise, go to TURNS tasks for each cell. A pair is kept in the cell alone in
    which both are present first.
    """

    def band(edge: str) -> Column:
        return F.floor(F.col(edge) / F.lit(BAND))

    def cells(x0: str, y0: str, x1: str, y1: str) -> Column:
        over = lambda a, b: F.sequence(band(a), F.greatest(band(a), band(b)))
        return F.explode(F.flatten(F.transform(over(y0, y1), lambda y: F.transform(over(x0, x1), lambda x: F.struct(y.alias("y"), x.alias("x"))))))

    left = boxes.withColumn("__turn", _turn()).withColumn("__cell", cells("x0", "y0", "x1", "y1"))
    right = _every_turn(named).withColumn("__cell", cells("r_x0", "r_y0", "r_x1", "r_y1"))
    first = (F.col("__cell.y") == F.greatest(band("y0"), band("r_y0"))) & (F.col("__cell.x") == F.greatest(band("x0"), band("r_x0")))
    return left.join(right, [*keys, "__turn", "__cell"]).filter(first).drop("__cell", "__turn")


def _turn() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)).cast("int")


def _every_turn(rects: DataFrame) -> DataFrame:
    return rects.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))))


def glyph_hits(runs: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with at least one glyph sharing area with a rectangle, and how many.

    Glyph edges follow from the fixed advance, so the count is a closed form.
    """
    paired = _with_rects(runs, rects, keys).filter(g.overlaps(g.named_box(""), g.named_box("r_")))
    length = F.length("text")
    first = F.greatest(F.floor((F.col("r_x0") - F.col("x0")) / GLYPH), F.lit(0))
    last = F.least(F.ceil((F.col("r_x1") - F.col("x0")) / GLYPH) - 1, length - 1)
    return paired.withColumn("glyphs", length.cast("long")).withColumn("removed", (last - first + 1).cast("long")).filter("removed > 0")


def redact_area(runs: DataFrame, pages: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Report per document and rectangle; every selected page gets its box, hit or not."""
    hits = (
        glyph_hits(runs, rects, keys)
        .groupBy("doc_id", "rect_id")
        .agg(
            F.sum(F.when(F.col("removed") == F.col("glyphs"), 1).otherwise(0)).alias("runs_removed"),
            F.sum(F.when(F.col("removed") < F.col("glyphs"), 1).otherwise(0)).alias("runs_trimmed"),
            F.sum("removed").alias("glyphs_removed"),
        )
    )
    marked = rects.select(*keys, "rect_id")
    few = len(marked.take(BROADCAST_RECTS + 1)) <= BROADCAST_RECTS
    asked = pages.select("doc_id", "page_no")
    boxes = (
        (asked.join(F.broadcast(marked), keys) if few else asked.withColumn("__turn", _turn()).join(_every_turn(marked), [*keys, "__turn"]))
        .groupBy("doc_id", "rect_id")
        .agg(F.count(F.lit(1)).alias("boxes_drawn"))
    )
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("runs_removed", "runs_trimmed", "glyphs_removed")]
    return boxes.join(hits, ["doc_id", "rect_id"], "left").select(
        "doc_id", "rect_id", F.col("boxes_drawn").alias("pages_redacted"), "boxes_drawn", *counts
    )


def untouched(runs: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Runs no rectangle reaches; what was reached is simply not in the output."""
    named = rects.select(*keys, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    if len(rects.select("rect_id").take(BROADCAST_RECTS + 1)) <= BROADCAST_RECTS:
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        edge = lambda side, names: g.Box(*[F.col(f"{side}.{n}") for n in names])
        meets = g.overlaps(edge("a", ("x0", "y0", "x1", "y1")), edge("b", ("r_x0", "r_y0", "r_x1", "r_y1")))
        on = meets
        for condition in same:
            on = on & condition
        return runs.alias("a").join(F.broadcast(named).alias("b"), on, "left_anti")
    hit = glyph_hits(runs, rects, keys).select("doc_id", "line_no").distinct()
    return runs.join(hit, ["doc_id", "line_no"], "left_anti")


def redact_find(runs: DataFrame, needles: list[str]) -> DataFrame:
    """Runs containing each needle, one row per run and needle. Case counts."""
    if not needles or any(n == "" for n in needles):
        raise ValueError("EmptySearchText")
    listed = F.array(*[F.lit(n) for n in needles])
    text = F.col("text")
    return runs.select("*", F.explode(F.filter(listed, lambda n: F.contains(text, n))).alias("needle"))


def find_report(runs: DataFrame, needles: list[str]) -> DataFrame:
    """Per document and needle: runs and glyphs removed, pages that lost something."""
    per_page = (
        redact_find(runs, needles)
        .groupBy("doc_id", "needle", "page_no")
        .agg(F.count(F.lit(1)).alias("r"), F.sum(F.length("text")).alias("g"))
    )
    return per_page.groupBy("doc_id", "needle").agg(
        F.sum("r").alias("runs_removed"), F.sum("g").alias("glyphs_removed"), F.count(F.lit(1)).alias("pages_redacted")
    )


def find_rejects(runs: DataFrame, docs: DataFrame, needles: list[str]) -> DataFrame:
    """Needles a document does not hold anywhere."""
    asked = docs.select("doc_id", F.explode(F.array(*[F.lit(n) for n in needles])).alias("needle"))
    hit = redact_find(runs, needles).select("doc_id", "needle").distinct()
    return asked.join(hit, ["doc_id", "needle"], "left_anti").withColumn("error", F.lit("TextNotFound"))


def _grams(text: str, size: str) -> str:
    """Expression: all pieces of ``size`` characters, each once."""
    return f"array_distinct(transform(sequence(1, greatest(length({text}) - {size} + 1, 1)), i -> substr({text}, i, {size})))"


def find_requests(runs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, rejects) of any number of (doc_id, needle) requests; hits are runs with a ``needle`` they hold.

    Needles of a document with at most FEW_NEEDLES of them (FEW_CHARS together) travel as
    one array, and each run is searched for them where it lies, so that only runs are
    shuffled. Documents with more go through an index of pieces (``_by_pieces``). Case
    counts. Both are lazy: neither hits nor rejects are written.
    Rejects: EmptySearchText for null or empty needles, TextNotFound where no run holds one.
    """
    asked = materialize(requests.select("doc_id", F.col("needle").cast("string").alias("needle")).distinct(), "requests")
    sized = asked.filter("needle <> ''")
    load = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.length("needle")).alias("__chars"))
    few = (F.col("__n") <= FEW_NEEDLES) & (F.col("__chars") <= FEW_CHARS)
    lists = sized.join(load.filter(few).select("doc_id"), "doc_id").groupBy("doc_id").agg(F.collect_list("needle").alias("__needles"))
    # joined on a hash beside the id, so that a later grouping by document has a shuffle of its own and the join of a long document may be split
    at = F.xxhash64("doc_id")
    hits = runs.withColumn("__at", at).join(lists.withColumn("__at", at), ["__at", "doc_id"]).select(
        *runs.columns, F.explode(F.filter("__needles", lambda n: F.contains(F.col("text"), n))).alias("needle")
    )
    many = load.filter(~few).select("doc_id")
    if many.take(1):
        hits = hits.unionByName(_by_pieces(runs.join(many, "doc_id", "left_semi"), sized.join(many, "doc_id", "left_semi")))
    missing = sized.join(hits.select("doc_id", "needle").distinct(), ["doc_id", "needle"], "left_anti").withColumn("error", F.lit("TextNotFound"))
    return hits, missing.unionByName(asked.filter("coalesce(needle, '') = ''").withColumn("error", F.lit("EmptySearchText")))


def _by_pieces(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits of documents with many needles, without comparing every run with every needle.

    Each needle meets only the runs of its document that hold its rarest piece of three
    characters (the whole needle if it is shorter): pieces of runs are joined with the
    pieces that some needle of the document has, counted, and the rarest one of each
    needle is looked up. Candidates are then compared with the whole needle. The keys are
    (document, piece), so one large document is spread over its pieces.
    """
    sized = asked.selectExpr("doc_id", "needle", "least(length(needle), 3) AS __size")
    pieces = materialize(sized.selectExpr("doc_id", "needle", f"explode({_grams('needle', '__size')}) AS __gram"), "pieces")
    sizes = sized.groupBy("doc_id").agg(F.collect_set("__size").alias("__sizes"))
    known = pieces.select("doc_id", "__gram").distinct()
    held = runs.select("doc_id", "line_no", "text").join(sizes, "doc_id").selectExpr(
        "doc_id", "line_no", f"explode(array_distinct(flatten(transform(filter(__sizes, z -> z <= length(text)), z -> {_grams('text', 'z')})))) AS __gram"
    )
    posted = materialize(held.join(known, ["doc_id", "__gram"], "left_semi"), "postings")
    counts = posted.groupBy("doc_id", "__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = pieces.join(counts, ["doc_id", "__gram"], "left").groupBy("doc_id", "needle").agg(F.expr("min(struct(coalesce(__n, 0) AS n, __gram AS gram)) AS r"))
    looked = rarest.filter("r.n > 0").selectExpr("doc_id", "needle", "r.gram AS __gram")
    candidates = materialize(posted.join(looked, ["doc_id", "__gram"]).select("doc_id", "line_no", "needle").distinct(), "candidates")
    return runs.join(candidates, ["doc_id", "line_no"]).filter("contains(text, needle)").select(*runs.columns, "needle")


def requests_report(hits: DataFrame) -> DataFrame:
    """Per document and needle: runs and glyphs removed, pages that lost something."""
    per_page = hits.groupBy("doc_id", "needle", "page_no").agg(F.count(F.lit(1)).alias("r"), F.sum(F.length("text")).alias("g"))
    return per_page.groupBy("doc_id", "needle").agg(F.sum("r").alias("runs_removed"), F.sum("g").alias("glyphs_removed"), F.count(F.lit(1)).alias("pages_redacted"))


def redact_paths(paths: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Painted paths wholly inside a rectangle, stroked ones grown by their line width.

    ``paths`` has stroked, line_width and clip; clipping paths always stay.
    """
    grow = F.when(F.col("stroked"), F.abs("line_width")).otherwise(0.0)
    b = g.named_box("")
    grown = g.Box(b.x0 - grow, b.y0 - grow, b.x1 + grow, b.y1 + grow)
    return (
        _with_rects(paths.filter(~F.col("clip")), rects, keys)
        .filter(g.contains(g.named_box("r_"), grown))
        .groupBy("doc_id", "rect_id")
        .agg(F.count(F.lit(1)).alias("paths_removed"))
    )
