"""Nothing is cut off: depth, length, lateness, gaps and size."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pageloom.functions import ranges
from pageloom.operators import assemble, images, objects, outline, selection, structure
from pageloom.plans.graph import climb
from pageloom.plans.scan import with_document
from pageloom.streaming import logs


def nested(depth):
    return [{"title": f"t{depth}", "page": depth, "children": nested(depth - 1) if depth > 1 else []}]


def test_outline_import_of_any_depth_and_of_bad_lists(spark):
    lists = [(1, 20, json.dumps(nested(6))), (2, 20, json.dumps(nested(12))), (3, 9, "{not json"), (4, 9, '{"title": "x"}'), (5, 9, '[{"title": 3, "page": 1}]')]
    lists += [(6, 9, None), (7, 9, "[]"), (8, 9, '[{"title": "a", "page": 1, "children": {}}]'), (9, 9, '[{"title": "a", "page": 1}, {"title": "b", "page": 10, "children": null}]')]
    rows, rejects = outline.outline_import(spark.createDataFrame(lists, "doc_id int, page_count int, json string"))
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.path)):
        got.setdefault(r.doc_id, []).append((r.depth, r.title))
    assert got == {d: [(i, f"t{n + 1 - i}") for i in range(1, n + 1)] for d, n in ((1, 6), (2, 12))}
    assert {(r.doc_id, r.error, r.page) for r in rejects.collect()} == {(d, "InvalidOutline", None) for d in (3, 4, 5, 6, 8)} | {(9, "PageOutOfRange", 10)}


def test_outline_tree_of_any_level(spark):
    rows = [(1, i, level, "t", 1) for i, level in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 4, 1], 1)]
    tree = outline.outline_tree(spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, page int"))
    got = {r.idx: (r.parent, r.depth, r.descendants) for r in tree.collect()}
    assert got == {0: (None, 1, 8), 1: (0, 2, 7), 2: (1, 3, 6), 3: (2, 4, 4), 4: (3, 5, 3), 5: (4, 6, 2), 6: (5, 7, 0), 7: (5, 7, 0), 8: (2, 4, 0), 9: (None, 1, 0)}


def test_long_page_lists_are_named_in_full(spark):
    spec = ",".join(str(2 * i + 1) for i in range(5000))
    specs = ranges.read_spec(spark.createDataFrame([(1, spec, 10_000)], "doc_id int, spec string, page_count int"))
    assert assemble.extract_names(specs, "{pages}", F.lit("x")).first().name == spec


def test_line_kinds_do_not_depend_on_the_stretch_length(spark):
    shape = "doc_id int, page_no int, block_no int, line_no int, text string, size double, x0 double"
    rows = [(1, 1, 1, n, text, 12.0, x) for n, text, x in ((1, "• first", 72.0), (8, "hangs", 80.0), (9, "hangs", 80.0), (10, "stays", 72.0), (11, "• second", 72.0), (30, "hangs", 90.0))]
    rows += [(1, 1, 2, 40 + i, "plain text " * 5, 12.0, 72.0) for i in range(20)]
    df = spark.createDataFrame(rows, shape)
    answers = [sorted((r.line_no, r.kind) for r in structure.classify(df, fold_lines=n).collect()) for n in (1, 2, 3, 7, 1024)]
    assert all(a == answers[0] for a in answers) and dict(answers[0])[30] == "tail"


def test_default_body_size(spark):
    lines = spark.createDataFrame([(1, "abc", 9.0)], "doc_id int, text string, size double")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert {r.doc_id: r.body for r in structure.body_sizes(lines, docs).collect()} == {1: 9.0, 2: 12.0}


def test_climbing_any_depth_and_out_of_loops(spark):
    rows = [(i, i - 1 if i else None, "top" if i == 0 else None) for i in range(300)] + [(1000, 1001, None), (1001, 1000, None)]
    nodes = spark.createDataFrame(rows, "id int, parent int, tag string")
    got = {r.id: r.tag for r in objects.inherit(nodes, [], ["tag"]).collect()}
    assert all(got[i] == "top" for i in range(300)) and got[1000] is None and len(got) == 302


def test_image_rule(spark):
    rows = [
        (1, "DCT", "Indexed", 8, True), (2, "DCT", None, None, True), (3, "FLATE", "DeviceCMYK", 8, False), (4, "FLATE", "DeviceGray", 8, True), (5, None, "RGB", 8, True),
        (6, None, "G", 4, False), (7, "JPX", "DeviceRGB", 8, False), (8, "FLATE", "DeviceRGB", None, False), (9, "FLATE", None, 8, False),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "image_id int, filter string, colorspace string, bits int")
    assert {r.image_id: r.ok for r in df.select("image_id", images.decodable().alias("ok")).collect()} == {r[0]: r[4] for r in rows}
    uses = spark.createDataFrame([(1, i) for i in range(1, 10)], "doc_id int, image_id int")
    assert [r.image_id for r in sorted(images.asset_manifest(uses, df).collect(), key=lambda r: r.n)] == [1, 2, 4, 5]


def test_a_large_document_is_split_in_joins(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 101)] + [(d, 1) for d in range(2, 30)], "doc_id int, page_no int")
    docs = pages.groupBy("doc_id").agg(F.max("page_no").alias("page_count"))
    joined = with_document(pages, docs, width=8)
    assert joined.count() == 128 and joined.filter("page_count = 100").count() == 100
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan and "Join Inner" in plan
    specs = ranges.read_spec(docs.withColumn("spec", F.lit("all")))
    assert selection.selected(pages, specs).filter("selected").count() == 128


def test_optimize_levels(spark):
    rows = [(1, 10, "a"), (1, 11, "a"), (1, 12, ""), (1, 13, "bb"), (1, 14, "a")]
    df = spark.createDataFrame(rows, "doc int, id int, text string")
    seen = spark.createDataFrame([(10,), (11,), (12,)], "id int")
    report = lambda **k: objects.optimize_report(df, "doc", F.col("text"), **k).first()
    full, safe = report(reachable_ids=seen), report(level="safe", reachable_ids=seen)
    assert (full.bytes_before, full.bytes_after, full.objects_removed, full.duplicates, full.unreachable) == (5, 1, 4, 1, 2)
    assert (safe.bytes_before, safe.bytes_after, safe.objects_removed, safe.duplicates) == (5, 2, 3, 0)
    with pytest.raises(ValueError):
        report(level="most")


def test_streams_take_in_late_and_new_events_once(spark, tmp_path):
    shape = "event_id long, ts timestamp, doc_id long, page_no int, degrees int"
    folder, place = tmp_path / "in", str(tmp_path / "state")
    add = lambda rows: spark.createDataFrame(rows, shape.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/edits.parquet")

    def run():
        events = logs.event_stream(spark, str(folder), "edits", spark.read.parquet(f"{folder}/edits.parquet").schema)
        return {(r.doc_id, r.page_no): r.rotation for r in logs.edit_log(events, place=place).collect()}

    add([(1, "2024-03-01 00:00:00", 1, 1, 90), (2, "2024-03-02 00:00:00", 1, 2, 180)])
    assert run() == {(1, 1): 90, (1, 2): 180}
    add([(3, "2024-01-01 00:00:00", 1, 1, 90), (2, "2024-03-02 00:00:00", 1, 2, 180)])  # two months late, and a repeat
    assert run() == {(1, 1): 180, (1, 2): 180}
    add([(4, "2024-03-03 00:00:00", 2, 1, 270)])
    assert run() == {(1, 1): 180, (1, 2): 180, (2, 1): 270}
    assert run() == {(1, 1): 180, (1, 2): 180, (2, 1): 270}


def test_climb_keeps_the_old_limit_where_asked(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(9)], "id int, up int, v int")
    assert climb(nodes, [], lambda near, far: {"v": far("v")}, max_depth=2).filter("up is not null").count() > 0


def _reach(links, roots):
    level = {r: 0 for r in roots}
    queue = list(roots)
    for node in queue:
        for a, b in links:
            if a == node and b not in level:
                level[b] = level[node] + 1
                queue.append(b)
    return level


@pytest.mark.parametrize("core", [0, 20_000])
def test_reachability_and_labels_by_brute_force(spark, core):
    import random

    from pageloom.plans import graph

    rng = random.Random(3)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(100, 101), (101, 102), (102, 100), (200, 200), (7, 300), (300, 301), (301, 300)]
    df = spark.createDataFrame(links, "src long, dst long")
    roots = [3, 7, 200, 101, 999]
    got = {r.id: r.level for r in graph.reachable(df, spark.createDataFrame([(r,) for r in roots], "id long"), [], core=core).collect()}
    assert got == _reach(links, roots)
    seeds = {3: 5, 7: 2, 101: 9, 102: 4, 12: 1, 200: 8}
    want = {}
    for seed, label in sorted(seeds.items(), key=lambda x: x[1]):
        for node in _reach(links, [seed]):
            want.setdefault(node, label)
    found = graph.smallest_label(df, spark.createDataFrame(list(seeds.items()), "id long, label long"), [], core=core)
    assert {r.id: r.label for r in found.collect()} == want


@pytest.mark.parametrize("core", [2_000, 20_000])
def test_a_deep_ladder_takes_few_rounds(spark, monkeypatch, core):
    """Two rails with rungs: every node but the first has two ways in, so no chain can be contracted."""
    from pageloom.plans import graph

    tables = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: tables.append(label) or write(df, label))
    steps = spark.range(2000)
    rails = [steps.select((2 * F.col("id") + a).alias("src"), (2 * F.col("id") + 2 + b).alias("dst")) for a in (0, 1) for b in (0, 1)]
    links = rails[0].union(rails[1]).union(rails[2]).union(rails[3])
    got = graph.reachable(links, spark.createDataFrame([(0,)], "id long"), [], core=core)
    levels = {r.id: r.level for r in got.collect()}
    assert levels == {0: 0, **{i: i // 2 for i in range(2, 4002)}}
    assert sum(t == "links" for t in tables) <= 16


def test_keys_and_names_keep_their_types(spark):
    from pageloom.plans import graph

    links = spark.createDataFrame([(k, a, b) for k in (1, 2) for a, b in [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d")]], "doc int, src string, dst string")
    got = graph.reachable(links, spark.createDataFrame([(1, "r"), (2, "b")], "doc int, id string"), ["doc"])
    assert dict(got.dtypes) == {"doc": "int", "id": "string", "level": "int"}
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (1, "b", 1), (1, "c", 2), (1, "d", 2), (1, "r", 0), (2, "a", 2), (2, "b", 0), (2, "c", 1), (2, "d", 1)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from pageloom.plans import graph

    tables = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: tables.append(label) or write(df, label))
    chain = spark.range(9999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.reachable(chain, spark.createDataFrame([(0,)], "id long"), [])
    assert got.agg(F.count("*"), F.max("level")).first()[:] == (10_000, 9_999) and len(tables) <= 20


def test_names_are_checked_before_writing(spark, tmp_path):
    from pageloom.sources import io

    pieces = spark.createDataFrame([(1, 1)], "doc_id int, chunk int")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    path = str(tmp_path / "out")
    with pytest.raises(FileExistsError):
        io.write_pieces(pieces, path, by=["chunk"], cluster=["doc_id"], manifest=names.union(names), force=True)
    with pytest.raises(FileExistsError):
        io.write_pieces(pieces, path, by=["chunk"], cluster=["doc_id"], manifest=names, existing=names)
    assert not (tmp_path / "out").exists()
    io.write_pieces(pieces, path, by=["chunk"], cluster=["doc_id"], manifest=names)


def test_overlays_on_a_long_base(spark):
    from pageloom.operators import geometry

    rows = [(1, p, 10.0, 20.0) for p in range(1, 30)] + [(2, p, 5.0, 20.0) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "doc_id int, page_no int, page_w double, page_h double")
    pairs = spark.createDataFrame([(1, 29, 2, 2), (2, 2, 1, 29)], "doc_id int, page_count int, overlay_id int, overlay_count int")
    got = {(r.doc_id, r.page_no): r.overlay_page for r in geometry.overlay_pairs(pages, pairs, width=4).collect()}
    assert got == {(1, p): min(p, 2) for p in range(1, 30)} | {(2, 1): 1, (2, 2): 2}
