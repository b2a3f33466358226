"""Page-label numbers, output-name templates, PDF dates and colour specifications."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Roman numerals, the label styles, the colour names.
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
STYLES = ["decimal", "upper-roman", "lower-roman", "upper-alpha", "lower-alpha", "none"]
COLORS = {"black": (0, 0, 0), "white": (1, 1, 1), "gray": (0.5, 0.5, 0.5), "grey": (0.5, 0.5, 0.5), "red": (1, 0, 0), "green": (0, 0.5, 0), "blue": (0, 0, 1)}


def roman(value: Column) -> Column:
    """Lower-case roman numeral; zero is empty. Every digit is a closed form of the value."""
    parts = []
    for i, (unit, digits) in enumerate(ROMAN):
        rest = value if i == 0 else F.pmod(value, F.lit(_above(i)))
        parts.append(F.repeat(F.lit(digits), _times(rest, i, unit)))
    return F.concat(*parts)


def _above(i: int) -> int:
    """The power of ten whose remainder the i-th numeral is taken from."""
    unit = ROMAN[i][0]
    for ten in (1000, 100, 10):
        if unit >= ten // 10 and unit < ten:
            return ten
    return 10


def _times(rest: Column, i: int, unit: int) -> Column:
    count = F.floor(rest / F.lit(unit)).cast("int")
    if i == 0:
        return count
    first = str(unit)[0]
    digit = F.floor(rest / F.lit(_above(i) // 10)).cast("int")
    if first == "9":
        return F.when(digit == 9, 1).otherwise(0)
    if first == "5":
        return F.when((digit >= 5) & (digit < 9), 1).otherwise(0)
    if first == "4":
        return F.when(digit == 4, 1).otherwise(0)
    return F.when(digit.isin(4, 9), 0).otherwise(F.pmod(digit, F.lit(5))).cast("int")


def alpha(value: Column) -> Column:
    """1 is a, 26 is z, 27 is aa; zero is empty."""
    letter = F.char((F.lit(97) + F.pmod(value - 1, F.lit(26))).cast("long"))
    return F.when(value > 0, F.repeat(letter, (F.floor((value - 1) / 26) + 1).cast("int"))).otherwise(F.lit(""))


def label_number(style: Column, value: Column) -> Column:
    return (
        F.when(style == "decimal", value.cast("string"))
        .when(style == "lower-roman", roman(value))
        .when(style == "upper-roman", F.upper(roman(value)))
        .when(style == "lower-alpha", alpha(value))
        .when(style == "upper-alpha", F.upper(alpha(value)))
        .otherwise(F.lit(""))
    )


def fill_tokens(template: str | Column, tokens: list[tuple[str, Column]]) -> Column:
    """Replace tokens in the given order; the order is visible in the result."""
    out = F.lit(template) if isinstance(template, str) else template
    for token, value in tokens:
        out = F.replace(out, F.lit(token), value.cast("string"))
    return out


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` plus an offset as ``YYYY-MM-DD HH:MM:SS +HH:MM``; NULL when unreadable."""
    body = F.regexp_replace(raw, "^D?:?", "")
    digits = F.regexp_extract(body, "^([0-9]*)", 1)
    zone = F.substr(body, F.length(digits) + 1)

    def field(at: int, default: int) -> Column:
        two = F.substring(digits, at + 1, 2)
        return F.when(F.length(two) == 2, two.cast("int")).otherwise(F.lit(default))

    stamp = F.try_make_timestamp_ntz(
        F.substring(digits, 1, 4).try_cast("int"), field(4, 1), field(6, 1), field(8, 0), field(10, 0), field(12, 0)
    )
    valid = (F.length(digits) >= 4) & (field(8, 0) < 24) & (field(10, 0) < 60) & (field(12, 0) < 60)
    sign = F.substring(zone, 1, 1)
    hour = F.coalesce(F.regexp_extract(zone, "^[+-]([0-9]{2})", 1).try_cast("int"), F.lit(0))
    minute = F.coalesce(F.regexp_extract(zone, "^[+-].{3}([0-9]{2})", 1).try_cast("int"), F.lit(0))
    total = hour * 60 + minute  # minutes stand after a mark; without one they are not read
    offset = F.when(
        sign.isin("+", "-"),
        F.concat(
            F.when((sign == "-") & (total > 0), F.lit("-")).otherwise(F.lit("+")),
            F.lpad(F.floor(total / 60).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad((total % 60).cast("string"), 2, "0"),
        ),
    ).otherwise(F.lit("+00:00"))
    return F.when(valid & (total < 24 * 60), F.concat(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), offset))


def color(spec: Column) -> Column:
    """``#rrggbb``, a name or ``r,g,b`` as three channels in 0..1; NULL when unreadable."""
    lower = F.lower(spec)
    named = F.lit(None).cast("array<double>")
    for name, channels in COLORS.items():
        named = F.when(lower == name, F.array(*[F.lit(float(c)) for c in channels])).otherwise(named)
    hexed = F.array(*[F.conv(F.substring(spec, 2 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)])
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p).try_cast("double"))
    listed = F.when((F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull()), parts)
    return F.coalesce(named, F.when(spec.rlike("^#[0-9a-fA-F]{6}$"), hexed), F.when(~spec.startswith("#"), listed))
