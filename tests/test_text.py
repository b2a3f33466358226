from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from pageloom.functions import geometry as g, labels as lab, text as t
from pageloom.operators import forms, structure, text


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v"))).first()[0]


def test_wrapping_by_brute_force(spark):
    rng = random.Random(4)

    def loop(body, width):
        lines = []
        for para in body.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " " * 8).split("\n"):
            if not para.strip():
                lines.append("")
                continue
            now = ""
            for word in filter(None, para.split(" ")):
                for piece in [word[i:i + width] for i in range(0, len(word), width)]:
                    if not now:
                        now = piece
                    elif len(now) + 1 + len(piece) <= width:
                        now += " " + piece
                    else:
                        lines.append(now)
                        now = piece
            lines.append(now)
        return lines

    bodies = ["".join(rng.choice("ab é\n  ") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["x" * 25, "a\r\nb\rc\td", ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, v string")
    for r in df.select("i", t.wrap_lines(F.col("v"), 10).alias("w")).collect():
        assert r.w == loop(bodies[r.i], 10)


def lines_of(spark, md):
    df = spark.createDataFrame([(1, md)], "doc_id int, md string")
    return [r.text for r in sorted(text.markdown_to_lines(df).collect(), key=lambda r: r.line_no)]


def test_markdown_rules(spark):
    cases = {
        "# A *b* ##\ntext": ["", "A b", "", "text"],
        "Title\n===\nnext": ["", "Title", "", "next"],
        "Title\n---\n---\nx": ["", "Title", "", "- - -", "x"],
        "a\n===\n===\n===": ["", "a", "", "===", ""],
        "* one\n2. two\n+ [l](u) `c`": ["- one", "- two", "- l c"],
        "> > quoted\n\n\n\nend": ["quoted", "", "end"],
        "* * *\n#tag\n#": ["- - -", "#tag", "#"],
        "x\n```\n# code\n\n\n```\ny": ["x", "# code", "", "", "y"],
        "x\n~~~\n~~~\n---": ["", "x", ""],
        "snake_case _em_ 2 * 3 ![alt](p) ![x]": ["snake_case em 2 * 3 alt x"],
        "": [""],
        "```\nopen": ["open"],
        "- item\n---": ["- item", "- - -"],
    }
    for md, want in cases.items():
        assert lines_of(spark, md) == want, md


def test_small_expressions(spark):
    assert one(spark, "<a & \"b\" 'c'>", t.escape_html) == "&lt;a &amp; &quot;b&quot; &#39;c&#39;&gt;"
    assert one(spark, "• one  two", t.bullet_body) == "one two" and one(spark, "-x", t.bullet_body) is None and one(spark, "- ", t.bullet_body) is None
    assert one(spark, "  a \t b ", t.collapse) == "a b"
    assert [one(spark, str(v), lambda c: lab.alpha(c.cast("int"))) for v in (1, 26, 27, 28, 0)] == ["a", "z", "aa", "bb", ""]
    assert [one(spark, str(v), lambda c: lab.roman(c.cast("int"))) for v in (1994, 4, 9, 40, 3888, 0)] == ["mcmxciv", "iv", "ix", "xl", "mmmdccclxxxviii", ""]
    assert one(spark, "D:20240229123456-05'30", lab.pdf_date) == "2024-02-29 12:34:56 -05:30"
    assert one(spark, "D:20240229123456+0530", lab.pdf_date) == "2024-02-29 12:34:56 +05:00" and one(spark, "D:20240229123456+24'00", lab.pdf_date) is None
    assert one(spark, "D:2024", lab.pdf_date) == "2024-01-01 00:00:00 +00:00" and one(spark, "D:20231332", lab.pdf_date) is None
    for value in ("plain", "Žluťoučký", "é"):
        assert one(spark, value, lambda c: t.decode_text(t.encode_text(c))) == value
    assert one(spark, "2304", lambda c: t.human_bytes(c.cast("long"))) == "2.2 KB" and one(spark, "1023", lambda c: t.human_bytes(c.cast("long"))) == "1023 B"
    b = spark.range(1).select(*g.transformed_bounds([F.lit(float(v)) for v in (0, 1, -1, 0, 10, 0)], g.box(0, 0, 2, 4)).columns()).first()
    assert tuple(b) == (6.0, 0.0, 10.0, 2.0)


LINE = "doc_id int, page_no int, block_no int, line_no int, text string, size double, x0 double"


def test_sizes_and_margins(spark):
    rows = [(1, 1, 1, 1, "x" * 5, 36.0, 72.0), (1, 1, 1, 2, "x" * 9, 24.0, 96.0), (1, 1, 1, 3, "x" * 90, 12.0, 72.0), (1, 1, 1, 4, "y", 13.0, 96.0)]
    rows += [(2, 1, 1, i, "z" * (50 if i == 9 else 1), 50.0 - 2 * i, 72.0) for i in range(1, 10)]
    df = spark.createDataFrame(rows, LINE)
    assert {r.doc_id: r.body for r in structure.body_sizes(df).collect()} == {1: 12.0, 2: 32.0}
    levels = sorted((r.doc_id, -r.bucket, r.level) for r in structure.heading_levels(df).collect())
    assert levels[:2] == [(1, -36.0, 1), (1, -24.0, 2)] and [x[2] for x in levels[2:]] == [1, 2, 3, 4, 5, 6, 6][: len(levels) - 2]
    assert structure.page_left(df.filter("doc_id = 1")).first().page_left == 72.0


def test_line_kinds_follow_the_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for doc in range(30):
        n = 0
        for block in (1, 2):
            anchor = None
            for _ in range(rng.randint(1, 14)):
                n += 1
                size, x0, txt = rng.choice([12.0] * 6 + [24.0]), rng.choice([72.0, 72.0, 72.0, 78.0, 84.0, 90.0]), rng.choice(["word " * 8, "- item", "• b"])
                rows.append((doc, 1, block, n, txt, size, x0))
                heading, bullet = size > 13, re.match("^[-•] ", txt)
                if heading:
                    kind, anchor = "heading", None
                elif bullet:
                    kind, anchor = "item", x0
                elif anchor is not None and x0 >= anchor + size / 2:
                    kind = "tail"
                elif x0 >= 72 + size:
                    kind, anchor = "item", x0
                else:
                    kind, anchor = "paragraph", None
                want[doc, n] = kind
        rows += [(doc, 1, 9, 100 + i, "body text " * 9, 12.0, 72.0) for i in range(30)]
    df = spark.createDataFrame(rows, LINE)
    for fold in (1024, 3):
        got = {(r.doc_id, r.line_no): r.kind for r in structure.classify(df, fold_lines=fold).collect() if r.line_no < 100}
        assert got == want


def test_form_reasons(spark):
    fields = spark.createDataFrame(
        [(1, "t", "Tx", None, 0, None), (1, "p", "Btn", None, 1 << 16, None), (1, "r", "Btn", None, 1 << 15, "A,B"), (1, "c", "Ch", ",".join(map(str, range(10))), 0, None), (1, "n", None, None, 0, None), (1, "z", "Zz", None, 0, None)],
        "doc_id int, name string, ftype string, options string, flags int, states string",
    )
    values = [("t", "bool", "true"), ("p", "bool", "true"), ("r", "bool", "true"), ("r2", "text", "A"), ("c", "text", "x"), ("n", "text", "x"), ("z", "text", "x")]
    df = spark.createDataFrame([(1, *v) for v in values], "doc_id int, name string, kind string, value string")
    got = {r.name: (r.outcome, r.reason) for r in forms.form_fill(df, fields).collect()}
    assert got["t"][1] == "text wanted" and got["p"][1] == "pushbutton"
    assert got["r"][1] == "choice name wanted" and got["r2"] == ("not_found", None)
    assert got["c"][1] == "no option x among: 0, 1, 2, 3, 4, 5, 6, 7, …" and got["n"][1] == "untyped"
    assert got["z"][1] == "type Zz"
