from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import ranges
from pageloom.operators import assemble, selection


def read(spark, rows):
    return ranges.read_spec(spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, spec string, page_count int"))


def pages_of(df):
    out: dict[int, list[int]] = {}
    for row in sorted(df.collect(), key=lambda r: (r.doc_id, r.pos)):
        out.setdefault(row.doc_id, []).append(row.page_no)
    return out


GOOD = [
    ("all", 3, [1, 2, 3]), (" ALL ", 2, [1, 2]), ("3,1,1", 3, [3, 1, 1]), ("3-1", 3, [3, 2, 1]), ("1-3,7,9-", 10, [1, 2, 3, 7, 9, 10]),
    ("-2", 4, [1, 2]), (" 1 - 2 , 4", 4, [1, 2, 4]), ("+2", 3, [2]), ("2-2", 3, [2]),
]
BAD = [
    ("", 3, "InvalidPageRange"), ("1,,2", 3, "InvalidPageRange"), ("1-2-3", 3, "InvalidPageRange"), ("-", 3, "InvalidPageRange"),
    ("x", 3, "InvalidPageRange"), ("0", 3, "InvalidPageRange"), ("1 2", 3, "InvalidPageRange"), ("all,1", 3, "InvalidPageRange"),
    ("4", 3, "PageOutOfRange"), ("1-", 0, "PageOutOfRange"), ("9,x", 3, "InvalidPageRange"), ("99999999999999999999999", 3, "InvalidPageRange"),
]


def test_literal_specifications(spark):
    df = read(spark, [(s, n) for s, n, _ in GOOD])
    assert pages_of(selection.resolve(df)) == {i: want for i, (_, _, want) in enumerate(GOOD)}
    errors = {r.doc_id: r.error for r in selection.refused(read(spark, [(s, n) for s, n, _ in BAD])).collect()}
    assert errors == {i: want for i, (_, _, want) in enumerate(BAD)}


def test_all_on_an_empty_document_is_empty(spark):
    df = read(spark, [("all", 0)])
    assert df.first().error is None and selection.resolve(df).count() == 0


def test_printing_is_stable(spark):
    specs = [" ALL", "06", "8 - 2", "4-,1", "-10,5-5", "2,2"]
    shown = {r.doc_id: r.canonical for r in selection.canonical(read(spark, [(s, 10) for s in specs])).collect()}
    assert [shown[i] for i in range(6)] == ["all", "6", "8-2", "4-,1", "1-10,5-5", "2,2"]


def test_unique_order_and_positions_by_brute_force(spark):
    rng = random.Random(5)
    rows, want, want_unique = [], {}, {}
    for i in range(200):
        n, parts, pages = 12, [], []
        for _ in range(rng.randint(1, 5)):
            a, b = rng.randint(1, n), rng.randint(1, n)
            parts.append(rng.choice([f"{a}", f"{a}-{b}", f"{a}-"]))
            pages += [a] if "-" not in parts[-1] else list(range(a, n + 1)) if parts[-1].endswith("-") else list(range(a, b + 1)) if a <= b else list(range(a, b - 1, -1))
        rows.append((",".join(parts), n))
        want[i], want_unique[i] = pages, list(dict.fromkeys(pages))
    df = read(spark, rows)
    assert pages_of(selection.resolve(df, width=3)) == want
    assert pages_of(selection.resolve_unique(df)) == want_unique
    all_pages = df.select("doc_id", "unique_spans", F.explode(F.sequence(F.lit(1), "page_count")).alias("p"))
    got = all_pages.select("doc_id", "p", ranges.holds(F.col("unique_spans"), F.col("p")).alias("h"), ranges.place_of(F.col("unique_spans"), F.col("p").cast("long")).alias("at"), ranges.held_before(F.col("unique_spans"), F.col("p").cast("long")).alias("b")).collect()
    for r in got:
        u = want_unique[r.doc_id]
        assert r.h == (r.p in u) and r.at == (u.index(r.p) + 1 if r.p in u else None) and r.b == sum(q < r.p for q in u)


def five(spark):
    return spark.createDataFrame([(0, p) for p in range(1, 6)], "doc_id long, page_no int")


@pytest.mark.parametrize("spec,before,want", [("1", 4, [2, 3, 1, 4, 5]), ("5,4", 1, [5, 4, 1, 2, 3]), ("2-3", 6, [1, 4, 5, 2, 3]), ("3", 3, [1, 2, 3, 4, 5])])
def test_moving(spark, spec, before, want):
    ok, rejects = assemble.move(five(spark), read(spark, [(spec, 5)]), F.lit(before))
    assert [r.source_page for r in sorted(ok.collect(), key=lambda r: r.page_no)] == want and rejects.count() == 0


def test_move_and_delete_refuse(spark):
    assert assemble.move(five(spark), read(spark, [("1", 5)]), F.lit(7))[1].first().error == "PageOutOfRange"
    ok, rejects = assemble.delete(five(spark), read(spark, [("all", 5)]))
    assert ok.count() == 0 and rejects.first().error == "EmptySelection"


def test_arranging_everything_in_order_changes_nothing(spark):
    picks = selection.resolve(read(spark, [("all", 5)]))
    assert [(r.page_no, r.source_page, r.copy_no) for r in assemble.arrange(five(spark), picks, []).collect()].sort() == [(p, p, 1) for p in range(1, 6)].sort()


def test_arranging_by_intervals_equals_arranging_by_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(",".join(rng.choice(["1", "3-1", "2-", "-4", "2,2", "5-2"]) for _ in range(rng.randint(1, 9))), 5) for _ in range(60)]
    specs = read(spark, [*rows, ("all", 5), ("all", 0), ("1,,2", 5), ("9", 5)])
    pages = spark.createDataFrame([(i, p, 10 * i + p) for i in range(64) for p in range(1, 6)], "doc_id long, page_no int, image_id long")
    want = sorted(map(tuple, assemble.arrange(pages, selection.resolve(specs), ["image_id"]).collect()))
    assert len(want) > 500
    for few in (64, 3):  # with 3, most specifications are resolved into rows
        monkeypatch.setattr(assemble, "FEW_PARTS", few)
        for dealt in (False, True):
            got = assemble.arrange_named(pages, specs, ["image_id"], dealt=dealt)
            assert got.columns == ["doc_id", "page_no", "source_page", "copy_no", "image_id"]
            assert sorted(map(tuple, got.collect())) == want
