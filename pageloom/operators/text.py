"""Text out of and into pages: extraction, HTML, pagination, Markdown to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions import text as t
from pageloom.functions.binding import let


def extract_text(page_texts: DataFrame, picks: DataFrame) -> DataFrame:
    """Text of the picked pages in the order asked, each closed by a form feed.

    One row per page; a document is its rows in ``pos`` order, so a long one is never
    gathered in one place.
    """
    return picks.join(page_texts.select("doc_id", "page_no", "text"), ["doc_id", "page_no"]).select(
        "doc_id", "pos", "page_no", F.concat(F.col("text"), F.lit("\f")).alias("text")
    )


def pages_with_text(pages: DataFrame, text: str) -> DataFrame:
    return pages.filter(~t.is_blank(F.col(text)))


def pages_to_html(page_texts: DataFrame, titles: DataFrame) -> DataFrame:
    """HTML fragments per document: opening (seq 0), a section per page, closing.

    Reading the fragments in ``seq`` order gives the document. Empty pages keep their
    section, so numbers hold. ``titles`` has doc_id, page_count, title.
    """
    # fixed output format: readers look for these elements and ids
    title = t.escape_html(F.col("title"))
    head = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>'),
        title,
        F.lit("</title>\n</head>\n<body>\n<h1>"),
        title,
        F.lit("</h1>\n"),
    )
    ends = titles.select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("seq"), head.alias("html")),
                F.struct((F.col("page_count") + 1).alias("seq"), F.lit("</body>\n</html>\n").alias("html")),
            )
        ),
    )
    number = F.col("page_no").cast("string")
    section = F.concat(
        F.lit('<section class="page" id="page-'),
        number,
        F.lit('">\n<h2>Page '),
        number,
        F.lit("</h2>\n<pre>"),
        t.escape_html(t.strip_spaces(F.col("text"))),
        F.lit("</pre>\n</section>\n"),
    )
    return ends.unionByName(page_texts.select("doc_id", F.col("page_no").alias("seq"), section.alias("html")))


def paginate(texts: DataFrame, width: int, per_page: int) -> DataFrame:
    """Wrapped lines with page numbers. Every text is one row, so there is nothing to shuffle."""
    lines = t.wrap_lines(F.col("text"), width)
    return texts.select("doc_id", F.posexplode(lines).alias("i", "line")).select(
        "doc_id",
        (F.floor(F.col("i") / per_page) + 1).cast("int").alias("page_no"),
        (F.col("i") + 1).alias("line_no"),
        F.col("line").alias("text"),
    )


# SQL text of the Markdown rules; ``let`` computes each step once
_SPACE = r"\p{IsWhite_Space}"


def _inline_sql(text: str) -> str:
    """Links keep their labels; emphasis, strike and code marks go."""
    links = rf"regexp_replace(regexp_replace({text}, r'!\[([^\]]*)\](?:\([^)]*\))?', '$1'), r'\[([^\]]*)\](?:\([^)]*\))?', '$1')"
    doubles = f"replace(replace(replace({links}, '**', ''), '__', ''), '~~', '')"
    word, solid = r"[\p{L}\p{N}]", r"[^\p{IsWhite_Space}]"
    return rf"regexp_replace({doubles}, r'`|(?<!{word})_|_(?!{word})|(?<={solid})\*|\*(?={solid})', '')"


def _heading_sql(left: str) -> str:
    body = rf"regexp_replace(regexp_replace({left}, r'^#+{_SPACE}*|{_SPACE}+$', ''), r'#+$', '')"
    return _inline_sql(rf"regexp_replace({body}, r'{_SPACE}+$', '')")


_LINE = let(
    rf"regexp_replace(line, r'^{_SPACE}+', '')",
    "left",
    let(
        rf"regexp_replace(left, r'^(?:>{_SPACE}*)+', '')",
        "quoted",
        let(
            rf"left RLIKE r'^#+ '",
            "atx",
            let(
                rf"""CASE WHEN atx THEN {_heading_sql('left')}
                  WHEN regexp_replace(quoted, r'{_SPACE}', '') RLIKE r'^(?:\*{{3,}}|-{{3,}}|_{{3,}})$' THEN '- - -'
                  WHEN quoted RLIKE r'^(?:[-*+] |[0-9]+\. )' THEN concat('- ', {_inline_sql(rf"regexp_replace(quoted, r'^(?:[-*+] |[0-9]+\. {_SPACE}*)', '')")})
                  ELSE {_inline_sql(rf"regexp_replace(quoted, r'{_SPACE}+$', '')")} END""",
                "text",
                rf"named_struct('heading', atx AND text <> '', 'text', text, 'underline', left RLIKE r'^(?:=+|-+){_SPACE}*$')",
            ),
        ),
    ),
)

# A fence line closes or opens code. Splitting at fences leaves prose at even places.
_FENCED = r"split(regexp_replace(md, r'(?m)^[^\S\n]*(?:```|~~~)[^\n]*$', '\u0001'), '\u0001')"


def _hollow(at: str) -> str:
    """A fence pair without lines; prose goes on across it."""
    return f"({at} % 2 = 1 AND coalesce(get(fenced, {at}) = '\\n' AND get(fenced, {at} + 1) <> '', false))"


_PIECES = let(
    _FENCED,
    "fenced",
    f"""split(array_join(transform(fenced, (p, i) -> concat(
        CASE WHEN i = 0 OR {_hollow('i')} OR {_hollow('(i - 1)')} THEN '' ELSE '\\u0001' END,
        CASE WHEN {_hollow('i')} THEN '' WHEN {_hollow('(i - 1)')} THEN substr(p, 2) ELSE p END)), ''), '\\u0001')""",
)

# line breaks next to a fence belong to the fence
_LINES_OF = """CASE WHEN count > 1 AND (((at = 0 OR at = count - 1) AND piece = '') OR (at > 0 AND at < count - 1 AND piece = '\\n')) THEN cast(array() AS array<string>)
  ELSE split(substr(piece, if(at > 0, 2, 1), length(piece) - if(at > 0, 1, 0) - if(at < count - 1, 1, 0)), '\\n') END"""

# prose with the text standing directly above it when only fences lie between
_PROSE = let(
    f"transform(lines, line -> {_LINE})",
    "plain",
    let(
        # an underline counts below text; in a run of underlines every other one does
        """regexp_replace(array_join(transform(plain, (p, i) -> CASE WHEN p.underline AND
             (CASE WHEN i = 0 THEN above ELSE NOT get(plain, i - 1).heading AND get(plain, i - 1).text <> '' AND NOT startswith(get(plain, i - 1).text, '- ') END)
           THEN '1' ELSE '0' END), ''), '11', '10')""",
        "marks",
        """flatten(transform(plain, (p, i) -> CASE WHEN substr(marks, i + 1, 1) = '1' THEN cast(array() AS array<string>)
             WHEN p.heading OR substr(marks, i + 2, 1) = '1' THEN array('', p.text, '') ELSE array(p.text) END))""",
    ),
)

_MARKDOWN = let(
    "regexp_replace(md_text, '\\\\r\\\\n?', '\\n')",
    "md",
    let(
        _PIECES,
        "pieces",
        let(
            "size(pieces)",
            "count",
            let(
                f"""flatten(transform(pieces, (piece, at) -> {let(_LINES_OF, 'lines', f"""CASE WHEN at % 2 = 1 THEN transform(lines, line -> named_struct('line', line, 'code', true))
                  ELSE transform({let('false', 'above', _PROSE)}, line -> named_struct('line', line, 'code', false)) END""")}))""",
                "rendered",
                """transform(filter(rendered, (r, i) -> r.code OR r.line <> '' OR i = 0 OR get(rendered, i - 1).line <> ''), r -> r.line)""",
            ),
        ),
    ),
)


def markdown_to_lines(docs: DataFrame) -> DataFrame:
    """Plain lines of Markdown documents: doc_id, line_no, text. ``docs``: doc_id, md.

    A text is one row, so fences, underlines and blank runs are settled inside it.
    """
    lines = F.expr(_MARKDOWN.replace("md_text", "source.md"))
    return docs.alias("source").select("doc_id", F.posexplode(lines).alias("i", "text")).select(
        "doc_id", (F.col("i") + 1).alias("line_no"), "text"
    )


def markdown_title(md: str) -> Column:
    """Text of the first ``#`` heading, fences not minded; NULL without one."""
    left = rf"regexp_replace(line, r'^{_SPACE}+', '')"
    return F.expr(
        rf"get(filter(transform(filter(split(regexp_replace({md}, '\\r\\n?', '\n'), '\n'), line -> {left} RLIKE r'^#+ '), line -> {_heading_sql(left)}), t -> t <> ''), 0)"
    )
