from __future__ import annotations

import random

from pyspark.sql import functions as F

from pageloom.operators import assemble, geometry, images, objects, outline, redact
from pageloom.sources import io


def test_packing_paths_agree_with_the_loop(spark):
    rng = random.Random(3)
    pages, want = [], []
    for doc in range(6):
        sizes = [rng.choice([0, 200_000, 400_000, 900_000, 1_500_000]) for _ in range(1 + doc * 9)]
        chunks, now, total = [], [], 0
        for i, size in enumerate(sizes, 1):
            pages.append((doc, i, size))
            if now and total + size > 1_000_000:
                chunks.append(now)
                now, total = [], 0
            now.append(i)
            total += size
        chunks.append(now)
        want += [(doc, n, c[0], c[-1], sum(sizes[i - 1] for i in c)) for n, c in enumerate(chunks, 1)]
    df = spark.createDataFrame(pages, "doc_id long, page_no int, bytes long")
    docs = df.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    for fold in (512, 8, 0):
        got = assemble.split_by_size(df, docs, 1, fold_pages=fold)
        assert sorted((r.doc_id, r.chunk_no, r.first_page, r.last_page, r.size_bytes) for r in got.collect()) == want


def test_chunks_of_seven_pages(spark):
    docs = spark.createDataFrame([(1, 7), (2, 0)], "doc_id long, page_count int")
    got = assemble.split_every(docs, 3, width=1)
    assert sorted((r.chunk_no, r.first_page, r.last_page) for r in got.collect()) == [(1, 1, 3), (2, 4, 6), (3, 7, 7)]
    names = assemble.manifest(got, "{stem}_{index:0{width}d}_{index}_{width}_{pages}", F.lit("s")).collect()
    assert sorted(r.name for r in names) == ["s_1_1_1_1-3", "s_2_2_1_4-6", "s_3_3_1_7"]


def test_booklet_of_eight(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 7)], "doc_id long, page_no int")
    docs = spark.createDataFrame([(1, 6)], "doc_id long, page_count int")
    got = sorted((r.slot, r.page_no) for r in geometry.booklet(pages, docs, 8).collect())
    assert [p for _, p in got] == [None, 1, 2, None, 6, 3, 4, 5]


def test_trust_stops_after_ten_links(spark):
    rows = [(f"c{i}", f"c{i + 1}", False) for i in range(14)] + [("c14", "c14", True), ("solo", "solo", False), ("lost", "gone", False)]
    got = {r.id: (r.trusted, r.outcome, r.stopped_at) for r in objects.trust_chain(spark.createDataFrame(rows, "id string, issuer string, root boolean")).collect()}
    assert got["c4"] == (True, "trusted", "c14") and got["c3"][:2] == (False, "chain too long") and got["c14"][0]
    assert got["solo"] == (False, "no trusted issuer", "solo") and got["lost"] == (False, "no trusted issuer", "lost")


def test_first_definition_of_a_name_wins(spark):
    rows = [(1, None, "contact", 1), (2, 1, "email", 2), (3, 1, "email", 3), (4, 2, None, 4), (5, 4, "deep", 5)]
    got = objects.qualified_names(spark.createDataFrame(rows, "id int, parent int, name string, ord int"), [])
    assert sorted((r.qualified, r.id) for r in got.collect()) == [("contact", 1), ("contact.email", 2)]


def test_bands_pair_the_same_boxes(spark):
    rng = random.Random(2)
    box = lambda: (rng.uniform(0, 500), rng.uniform(-100, 800), rng.uniform(1, 80), rng.uniform(1, 200))
    runs = [(1, rng.randint(1, 2), i, "x" * 10, x, y, x + 55.0, y + h) for i, (x, y, w, h) in enumerate(box() for _ in range(60))]
    rects = [(i, rng.randint(1, 2), x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(box() for _ in range(30))]
    r = spark.createDataFrame(runs, "doc_id int, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    q = spark.createDataFrame(rects, "rect_id int, page_no int, x0 double, y0 double, x1 double, y1 double")
    few = redact.glyph_hits(r, q, ["page_no"]).select("line_no", "rect_id", "removed").collect()
    kept = redact.untouched(r, q, ["page_no"]).count()
    old, redact.BROADCAST_RECTS = redact.BROADCAST_RECTS, 3
    try:
        many = redact.glyph_hits(r, q, ["page_no"]).select("line_no", "rect_id", "removed").collect()
        assert redact.untouched(r, q, ["page_no"]).count() == kept
    finally:
        redact.BROADCAST_RECTS = old
    assert few and sorted(few) == sorted(many)


def test_touching_is_not_overlap(spark):
    runs = spark.createDataFrame([(1, 1, 1, "abcd", 0.0, 0.0, 22.0, 10.0)], "doc_id int, page_no int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    rect = lambda *b: spark.createDataFrame([(1, 1, *map(float, b))], "rect_id int, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert redact.glyph_hits(runs, rect(22, 0, 30, 10), ["page_no"]).count() == 0
    assert redact.glyph_hits(runs, rect(11, 0, 16.5, 10), ["page_no"]).first().removed == 1
    assert redact.glyph_hits(runs, rect(10, 0, 17, 10), ["page_no"]).first().removed == 3


def test_compare_needs_equal_shapes(spark):
    df = spark.createDataFrame([(1, [0.0] * 6, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (2, [0.0] * 3, [0.0] * 6), (3, [], [])], "pair_id int, left_s array<double>, right_s array<double>")
    got = {r.pair_id: (r.changed, r.total, r.percent) for r in images.compare(df, 0.5).collect()}
    assert got == {1: (1, 2, 50.0), 2: (None, None, None), 3: (0, 0, 0.0)}


def _tree(spark, levels):
    rows = [(1, i, lv, f'T"{i}', i) for i, lv in enumerate(levels, 1)]
    return outline.outline_tree(spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, page int"), width=2)


def test_outline_round_trips(spark):
    import json

    tree = _tree(spark, [1, 2, 3, 2, 1, 3, 2, 1])
    text = "[" + "".join(r.fragment for r in sorted(outline.outline_export(tree, width=2).collect(), key=lambda r: r.idx)) + "]"
    nested = json.loads(text)
    assert [len(n["children"]) for n in nested] == [2, 2, 0] and nested[0]["children"][0]["children"][0]["title"] == 'T"3'
    lists = spark.createDataFrame([(1, 8, text), (2, 3, text), (3, 3, "[]")], "doc_id int, page_count int, json string")
    rows, rejects = outline.outline_import(lists)
    flat = sorted(((r.path, r.title, r.page, r.depth) for r in rows.collect()))
    assert [f[1] for f in flat] == [f'T"{i}' for i in range(1, 9)] and [f[3] for f in flat] == [1, 2, 3, 2, 1, 2, 2, 1]
    assert [(r.doc_id, r.page) for r in rejects.collect()] == [(2, 4)]


def test_moving_up_then_down_restores(spark):
    tree = _tree(spark, [1, 2, 2, 1, 2, 1])
    pick = lambda i: spark.createDataFrame([(1, i)], "doc_id int, idx int")
    up = outline.outline_move(tree, pick(3), up=True)
    assert [r.title for r in sorted(up.collect(), key=lambda r: r.idx)] == ['T"4', 'T"5', 'T"1', 'T"2', 'T"3', 'T"6']
    again = outline.outline_tree(up.select("doc_id", (F.col("idx") + 1).alias("seq"), "level", "title", "page"))
    down = outline.outline_move(again, pick(0), up=False)
    assert [r.title for r in sorted(down.collect(), key=lambda r: r.idx)] == [f'T"{i}' for i in range(1, 7)]
    assert not outline.outline_move(tree, pick(0), up=True).first().moved


def test_destination_chains_of_any_length(spark):
    tree = _tree(spark, [1, 1, 2])
    names = [(1, f"n{i}", "direct", "name", None, f"n{i + 1}") for i in range(1, 15)] + [(1, "n15", "direct", "page", 2, None), (1, "n0", "direct", "name", None, "n1"), (1, "n3", "tree", "page", 1, None)]
    dests = spark.createDataFrame(names, "doc_id int, name string, source string, kind string, page int, target string")
    targets = spark.createDataFrame([(1, 0, "name", None, "n1"), (1, 1, "name", None, "n0"), (1, 2, "page", 1, None)], "doc_id int, idx int, kind string, page int, name string")
    docs = spark.createDataFrame([(1, 3)], "doc_id int, page_count int")
    got = outline.outline_destinations(tree, targets, dests, docs)
    assert [(r.idx, r.page) for r in got.collect()] == [(0, 2), (1, 2), (2, 1)]


def test_pieces_are_not_overwritten(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "doc_id int, page_no int, chunk int")
    path = str(tmp_path / "out")
    io.write_pieces(df, path, by=["chunk"], cluster=["doc_id"])
    with pytest.raises(Exception):
        io.write_pieces(df, path, by=["chunk"], cluster=["doc_id"])
    io.write_pieces(df, path, by=["chunk"], cluster=["doc_id"], force=True)
    assert spark.read.parquet(path).count() == 2
    assert io.scan_files(spark, path, "*.parquet").count() >= 1
    names = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "name string")
    assert sorted(r.name for r in io.taken_names(names, spark.createDataFrame([("a",)], "name string")).collect()) == ["a", "b"]
