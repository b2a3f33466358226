"""Text expressions: wrapping, cleaning, escaping, Markdown stripping, sizes and decoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Glyphs a list item may start with.
BULLETS = "•●◦▪▫■□‣⁃·\\-–"

_SPACE = r"\p{IsWhite_Space}"


def strip_spaces(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{_SPACE}]")


def collapse(text: Column) -> Column:
    """White-space runs become single spaces."""
    return F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))


def bullet_body(text: Column) -> Column:
    """What follows a bullet glyph and a space, or NULL when the line is no item."""
    body = collapse(F.regexp_extract(text, rf"(?s)^[{BULLETS}][  ](.*)$", 1))
    return F.when(body != "", body)


def escape_html(text: Column) -> Column:
    """The five special characters; the ampersand goes first."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def wrap_lines(text: Column, width: int) -> Column:
    """Array of wrapped lines; blank lines stay, overlong words are cut."""
    source = F.regexp_replace(newlines(text), "\t", " " * 8)

    def one(paragraph: Column) -> Column:
        packed = F.trim(F.regexp_replace(paragraph, " +", " "))
        pieces = F.regexp_extract_all(packed, F.lit("(?s).{1,%d}(?: |$)|.{%d}" % (width, width)), F.lit(0))
        return F.when(is_blank(paragraph), F.array(F.lit(""))).otherwise(F.transform(pieces, lambda p: F.rtrim(p)))

    return F.flatten(F.transform(F.split(source, "\n"), one))


def wrap_width(page_width: float, margin: float = 72.0, font_size: float = 11.0) -> int:
    """Characters per line at half an em each."""
    content = max(page_width - 2 * max(margin, 0.0), 1.0)
    return max(int(content // max(font_size * 0.5, 1.0)), 10)


def lines_per_page(page_height: float, margin: float = 72.0, font_size: float = 11.0) -> int:
    line = font_size * 1.2
    return int(max(page_height - 2 * max(margin, 0.0), line) // line)


def human_bytes(size: Column) -> Column:
    """1024-based size with one decimal, plain bytes below 1 KB."""
    value = size.cast("double")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = value / F.lit(float(1024**power))
        shown = F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(f" {unit}"))
        out = F.when(value >= F.lit(float(1024**power)), shown).otherwise(out)
    return out


def counted(number: Column, noun: str) -> Column:
    """``1 page`` or ``3 pages``."""
    return F.concat(number.cast("string"), F.when(number == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def decode_text(raw: Column) -> Column:
    """UTF-16BE with a byte-order mark, else UTF-8, else Latin-1."""
    body = F.substring(raw, 3, 2147483647)
    return (
        F.when(F.hex(F.substring(raw, 1, 2)) == "FEFF", F.decode(body, "UTF-16BE"))
        .when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def encode_text(text: Column) -> Column:
    """ASCII bytes as they are, anything else UTF-16BE behind a byte-order mark."""
    return F.when(~text.rlike(r"[^\x00-\x7F]"), F.encode(text, "UTF-8")).otherwise(
        F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    )


def zero_pad(number: Column, total: Column) -> Column:
    """``number`` padded with zeros to the digit count of ``total``."""
    digits = F.length(F.greatest(total, F.lit(1)).cast("string"))
    return F.lpad(number.cast("string"), digits, F.lit("0"))
