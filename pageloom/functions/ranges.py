"""Page-range specifications as interval arrays.

A specification such as ``3-1,5-`` stays one row: it is read into an array of
intervals, checked, made unique and searched with array functions. Only operators
that must output one row per page expand it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.binding import bind, let
from pageloom.plans.scan import expand

_SPANS = "array<struct<lo:bigint,hi:bigint,back:boolean>>"


def _number(text: str) -> str:
    """A page number; only long digit strings need the slower checked cast."""
    return f"""CASE WHEN {text} RLIKE r'^[+]?[0-9]{{1,18}}$' THEN cast({text} AS BIGINT)
      WHEN {text} RLIKE r'^[+]?[0-9]+$' THEN try_cast({text} AS BIGINT) END"""


def _number_error(number: str) -> str:
    return f"CASE WHEN {number} IS NULL THEN 'no number' WHEN {number} = 0 THEN 'zero' END"


_PART = let(
    "split(piece, '-', 2)",
    "ends",
    let(
        f"transform(ends, e -> {_number('e')})",
        "numbers",
        f"""named_struct(
      'error', CASE WHEN piece = '' THEN 'empty part'
        WHEN size(ends) = 1 THEN {_number_error('numbers[0]')}
        WHEN contains(ends[1], '-') THEN 'dashes'
        WHEN piece = '-' THEN 'only a dash'
        WHEN ends[0] = '' THEN {_number_error('numbers[1]')}
        WHEN ends[1] = '' THEN {_number_error('numbers[0]')}
        ELSE coalesce({_number_error('numbers[0]')}, {_number_error('numbers[1]')}) END,
      'start', CASE WHEN ends[0] = '' THEN 1L ELSE numbers[0] END,
      'stop', CASE WHEN size(ends) = 1 THEN numbers[0] WHEN ends[1] <> '' THEN numbers[1] END,
      'single', size(ends) = 1)""",
    ),
)

# the parts of an interval that an earlier one has not taken, in reading direction
_REST = """transform(array(named_struct(
      'below', named_struct('lo', piece.lo, 'hi', least(piece.hi, taken.lo - 1), 'back', piece.back),
      'above', named_struct('lo', greatest(piece.lo, taken.hi + 1), 'hi', piece.hi, 'back', piece.back))),
    cut -> filter(CASE WHEN piece.back THEN array(cut.above, cut.below) ELSE array(cut.below, cut.above) END, s -> s.lo <= s.hi))[0]"""

_FIRST_SEEN = f"""CASE WHEN size(spans) < 2 THEN spans ELSE aggregate(spans, cast(array() AS {_SPANS}), (done, span) -> concat(done,
    aggregate(done, array(span), (left, taken) -> flatten(transform(left, piece -> {_REST}))))) END"""


def _record(spec: str, count: str) -> str:
    text = rf"regexp_replace(regexp_replace({spec}, r'^\p{{IsWhite_Space}}+|\p{{IsWhite_Space}}+$', ''), r'\p{{IsWhite_Space}}*([,-])\p{{IsWhite_Space}}*', '$1')"
    n = f"cast({count} AS BIGINT)"
    outside = f"""get(filter(transform(parts, p -> CASE WHEN {n} = 0 OR p.start > {n} THEN p.start WHEN p.stop > {n} THEN p.stop END), v -> v IS NOT NULL), 0)"""
    span = f"""named_struct('lo', least(p.start, coalesce(p.stop, {n})), 'hi', greatest(p.start, coalesce(p.stop, {n})), 'back', p.start > coalesce(p.stop, {n}))"""
    spans = f"""cast(CASE WHEN every THEN CASE WHEN {n} > 0 THEN array(named_struct('lo', 1L, 'hi', {n}, 'back', false)) ELSE array() END
      WHEN malformed IS NULL AND beyond IS NULL THEN transform(parts, p -> {span}) END AS {_SPANS})"""
    printed = """CASE WHEN every THEN 'all' WHEN malformed IS NULL THEN array_join(transform(parts, p -> CASE WHEN p.single THEN cast(p.start AS STRING)
      ELSE concat(cast(p.start AS STRING), '-', coalesce(cast(p.stop AS STRING), '')) END), ',') END"""
    record = f"""named_struct(
      'error', CASE WHEN malformed IS NOT NULL THEN 'InvalidPageRange' WHEN beyond IS NOT NULL THEN 'PageOutOfRange' END,
      'detail', coalesce(malformed, concat(cast(beyond AS STRING), ' > ', cast({n} AS STRING))),
      'canonical', {printed}, 'spans', spans, 'unique_spans', {_FIRST_SEEN})"""
    malformed = "CASE WHEN every THEN cast(NULL AS STRING) WHEN text = '' THEN 'nothing written' ELSE get(filter(parts, p -> p.error IS NOT NULL), 0).error END"
    beyond = f"CASE WHEN NOT every AND malformed IS NULL THEN {outside} END"
    return let(
        text,
        "text",
        let(
            "lower(text) = 'all'",
            "every",
            let(
                f"transform(split(text, ','), piece -> {_PART})",
                "parts",
                let(malformed, "malformed", let(beyond, "beyond", let(spans, "spans", record))),
            ),
        ),
    )


def read_spec(df: DataFrame, spec: str = "spec", count: str = "page_count") -> DataFrame:
    """Add ``error``, ``detail``, ``canonical``, ``spans`` (as written) and ``unique_spans``.

    A malformed part anywhere is reported before any part that is out of range.
    """
    return bind(df, F.expr(_record(spec, count)))


def span_length(spans: Column) -> Column:
    """How many pages the intervals name, repeats counted."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["hi"] - s["lo"] + 1)


def holds(spans: Column, page: Column) -> Column:
    """Whether a page lies in one of the intervals."""
    return F.exists(spans, lambda s: (page >= s["lo"]) & (page <= s["hi"]))


def held_before(spans: Column, page: Column) -> Column:
    """How many pages below ``page`` the disjoint intervals hold."""
    return F.aggregate(
        spans,
        F.lit(0).cast("bigint"),
        lambda acc, s: acc + F.greatest(F.lit(0).cast("bigint"), F.least(s["hi"], page - 1) - s["lo"] + 1),
    )


def place_of(spans: Column, page: Column) -> Column:
    """Position of ``page`` in the order the disjoint intervals are read."""
    start = F.struct(F.lit(0).cast("bigint").alias("done"), F.lit(None).cast("bigint").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        here = acc["done"] + F.when(s["back"], s["hi"] - page).otherwise(page - s["lo"]) + 1
        return F.struct(
            (acc["done"] + s["hi"] - s["lo"] + 1).alias("done"),
            F.coalesce(acc["found"], F.when((page >= s["lo"]) & (page <= s["hi"]), here)).alias("found"),
        )

    return F.aggregate(spans, start, step)["found"]


def places_of(spans: Column, page: Column) -> Column:
    """Every place, from 1 and ascending, where spans as written name the page."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.array().cast("array<bigint>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        inside = F.when(s["back"], s["hi"] - page).otherwise(page - s["lo"])
        found = F.when((page >= s["lo"]) & (page <= s["hi"]), F.concat(acc["found"], F.array(acc["before"] + inside + 1))).otherwise(acc["found"])
        return F.struct((acc["before"] + s["hi"] - s["lo"] + 1).alias("before"), found.alias("found"))

    return F.aggregate(spans, start, step)["found"]


def expand_spans(df: DataFrame, spans: str, keep: list[str], *, width: int | None = None) -> DataFrame:
    """One row per named page: ``keep`` + (pos, page_no), pos from 1 in reading order.

    ``df`` has page_count, which no interval is longer than.
    """
    offsets = F.expr(
        f"transform({spans}, (s, i) -> aggregate(slice({spans}, 1, i), 0L, (acc, t) -> acc + t.hi - t.lo + 1))"
    )
    rows = df.select(
        *keep, "page_count", F.explode(F.arrays_zip(F.col(spans).alias("span"), offsets.alias("offset"))).alias("z")
    ).select(*keep, "page_count", F.col("z.span").alias("span"), F.col("z.offset").alias("offset"))
    length = F.col("span.hi") - F.col("span.lo") + 1
    out = expand(rows, length, "__i", bound=F.col("page_count"), spread=[*keep, "offset"], width=width)
    page = F.when(F.col("span.back"), F.col("span.hi") - F.col("__i")).otherwise(F.col("span.lo") + F.col("__i"))
    return out.select(
        *keep, (F.col("offset") + F.col("__i") + 1).cast("int").alias("pos"), page.cast("int").alias("page_no")
    )
