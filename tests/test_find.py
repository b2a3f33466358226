"""Many needles: each meets only the runs that hold its rarest piece."""

from __future__ import annotations

import random

from pageloom.operators import redact


def test_ten_thousand_requests_equal_plain_search(spark):
    rng = random.Random(4)
    letters = "abcdeé "
    runs = [(0 if k % 3 == 0 else rng.randrange(1, 5), k // 50 + 1, k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))) for k in range(600)]
    asked = []
    for _ in range(10_000):
        doc = rng.randrange(6)
        text = rng.choice(runs)[3]
        at = rng.randrange(len(text))
        asked.append((doc, text[at : at + rng.randrange(0, 7)]))
    asked += [(1, None), (2, "A"), (99, "a"), (None, "a")]
    got, rejects = redact.find_requests(spark.createDataFrame(runs, "doc_id int, page_no int, line_no int, text string"), spark.createDataFrame(asked, "doc_id int, needle string"))
    want = {(d, line, n) for d, n in set(asked) if n for rd, _, line, text in runs if rd == d and n in text}
    assert {(r.doc_id, r.line_no, r.needle) for r in got.collect()} == want
    held = {(d, n) for d, _, n in want}
    assert {(r.doc_id, r.needle, r.error) for r in rejects.collect()} == {
        (d, n, "EmptySearchText" if not n else "TextNotFound") for d, n in set(asked) if (d, n) not in held
    }


def test_few_needles_meet_runs_where_they_lie(spark, monkeypatch):
    runs = [(1, 1, 1, "abcab"), (1, 2, 2, "bca"), (1, 1, 1, "abcab"), (2, 1, 1, "zzz"), (3, 1, 1, None)]
    runs = spark.createDataFrame(runs, "doc_id int, page_no int, line_no int, text string")
    asked = spark.createDataFrame([(1, "ab"), (1, "ca"), (1, "x"), (2, "zz"), (3, "a"), (4, "a"), (2, "")], "doc_id int, needle string")
    want = [(1, 1, 1, "ab"), (1, 1, 1, "ab"), (1, 1, 1, "ca"), (1, 1, 1, "ca"), (1, 2, 2, "ca"), (2, 1, 1, "zz")]
    gone = [(1, "x", "TextNotFound"), (2, "", "EmptySearchText"), (3, "a", "TextNotFound"), (4, "a", "TextNotFound")]

    def found():
        hits, rejects = redact.find_requests(runs, asked)
        assert sorted((r.doc_id, r.page_no, r.line_no, r.needle) for r in hits.collect()) == want and sorted(map(tuple, rejects.collect())) == gone

    for limit in (2, 0):  # some, then all documents by pieces
        with monkeypatch.context() as m:
            m.setattr(redact, "FEW_NEEDLES", limit)
            found()
    monkeypatch.setattr(redact, "_grams", None)  # few needles make no pieces, which are many times the text
    found()


def test_no_requests(spark):
    runs = spark.createDataFrame([(1, 1, 1, "abc")], "doc_id int, page_no int, line_no int, text string")
    got, rejects = redact.find_requests(runs, spark.createDataFrame([], "doc_id int, needle string"))
    assert got.count() == 0 and rejects.count() == 0


def test_many_rectangles_by_cells_equal_the_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    runs = [(k % 7, k % 3 + 1, k, "x" * rng.randrange(1, 60), 0.0, 0.0, 0.0, 0.0) for k in range(300)]
    runs = [(d, p, n, t, x := rng.uniform(-50, 500), y := rng.uniform(-20, 800), x + 5.5 * len(t), y + 11) for d, p, n, t, *_ in runs]
    boxes = spark.createDataFrame(runs, "doc_id int, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    rects = [(r, rng.randrange(1, 4), x := rng.uniform(-60, 500), y := rng.uniform(-60, 800), x + rng.choice([0.5, 30, 300]), y + rng.choice([0.5, 30, 300])) for r in range(80)]
    area = spark.createDataFrame(rects, "rect_id int, page_no int, x0 double, y0 double, x1 double, y1 double")
    pages = boxes.select("doc_id", "page_no").distinct()
    few = sorted(map(tuple, redact.redact_area(boxes, pages, area, ["page_no"]).collect()))
    left = sorted(r.line_no for r in redact.untouched(boxes, area, ["page_no"]).collect())
    monkeypatch.setattr(redact, "BROADCAST_RECTS", 10)
    assert sorted(map(tuple, redact.redact_area(boxes, pages, area, ["page_no"]).collect())) == few and few
    assert sorted(r.line_no for r in redact.untouched(boxes, area, ["page_no"]).collect()) == left
