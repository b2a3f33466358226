"""Outlines of many levels and blocks, and edit sequences, against plain lists."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.operators import outline

SCHEMA = "doc_id int, seq int, level int, title string, page int"


def plain_tree(levels):
    """(parent, depth, sibling, descendants) by a stack."""
    stack, out, kids = [], [], {}
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        kids[parent] = kids.get(parent, 0) + 1
        out.append([parent, len(stack) + 1, kids[parent], 0])
        for a in stack:
            out[a][3] += 1
        stack.append(i)
    return [tuple(x) for x in out]


def tree_of(spark, docs, **kw):
    rows = [(d, i + 1, level, f"t{d}-{i}", i + 1) for d, levels in docs.items() for i, level in enumerate(levels)]
    return outline.outline_tree(spark.createDataFrame(rows, SCHEMA), **kw)


def rows_of(tree):
    out = {}
    for r in tree.orderBy("doc_id", "idx").collect():
        out.setdefault(r.doc_id, []).append((r.parent, r.depth, r.sibling, r.descendants))
    return out


@pytest.mark.parametrize(("block", "group"), [(2, 2), (3, 4), (256, 1024)])
def test_tree_by_blocks_equals_a_stack(spark, block, group):
    rng = random.Random(block)
    docs = {d: [rng.randint(1, 6) for _ in range(n)] for d, n in enumerate([1, 2, 3, 17, 60, 200])}
    docs[9] = [1] * 90
    docs[10] = list(range(1, 41)) + list(range(40, 0, -1))
    got = rows_of(tree_of(spark, docs, block=block, group=group, width=7))
    assert got == {d: plain_tree(levels) for d, levels in docs.items()}


def test_five_hundred_levels(spark):
    levels = [*range(1, 501), *range(500, 0, -1), 3, 250]
    deep = tree_of(spark, {1: levels})
    flat = tree_of(spark, {1: [1, 2]})
    assert rows_of(deep) == {1: plain_tree(levels)}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(deep) < 1.2 * size(flat)


def plain_replay(items, edits, pages=None):
    """``items`` as nested [title, page, children]; edits (op, target, title, page) one after the other."""
    outcomes = []

    def order(level, out):
        for node in level:
            out.append((level, node))
            order(node[2], out)
        return out

    for op, target, title, page in edits:
        everything = order(items, [])
        error, changed = None, False
        index = target - 1 if op == "add" and target is not None else target
        if op not in ("add", "remove", "up", "down"):
            error = "InvalidEdit"
        elif op == "add" and pages is not None and not (page is not None and 1 <= page <= pages):
            error = "PageOutOfRange"
        elif op == "add" and target == 0:
            items.append([title, page, []])
            changed = True
        elif index is None or not 0 <= index < len(everything):
            error = "NoSuchBookmark"
        else:
            siblings, node = everything[index]
            at = next(i for i, x in enumerate(siblings) if x is node)
            if op == "add":
                node[2].append([title, page, []])
                changed = True
            elif op == "remove":
                del siblings[at]
                changed = True
            else:
                other = at - 1 if op == "up" else at + 1
                if 0 <= other < len(siblings):
                    siblings[at], siblings[other] = siblings[other], siblings[at]
                    changed = True
        outcomes.append((changed, error))

    def flat(level, depth, out):
        for title, page, kids in level:
            out.append((depth, title, page))
            flat(kids, depth + 1, out)
        return out

    return flat(items, 1, []), outcomes


def nested(levels, doc):
    tree, nodes, top = plain_tree(levels), [], []
    for i, (parent, *_) in enumerate(tree):
        nodes.append([f"t{doc}-{i}", i + 1, []])
        (top if parent is None else nodes[parent][2]).append(nodes[-1])
    return top


def test_many_edits_equal_a_list_replay(spark, monkeypatch):
    rng = random.Random(5)
    docs = {d: [rng.randint(1, 5) for _ in range(n)] for d, n in enumerate([1, 4, 30, 300, 700])}
    edits = {d: [(rng.choice(["add", "add", "remove", "up", "down", "up", "down", "turn"]), rng.choice([rng.randint(-1, len(levels) + 3), rng.randint(0, 6), None]), f"new {k}", rng.randint(0, 40)) for k in range(120)] for d, levels in docs.items()}
    edits[77] = [("add", 0, "only", 1), ("add", 1, "under", 2), ("remove", 5, None, None)]
    rows = [(d, k, *e) for d, es in edits.items() for k, e in enumerate(es)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id int, step int, op string, target int, title string, page int")
    untouched = {50: [1, 2, 3, 2]}
    tree = tree_of(spark, {**docs, **untouched})
    counts = spark.createDataFrame([(d, 20) for d in [*docs, 77]], "doc_id int, page_count int")
    for pages, extra in ((None, {}), (20, {"docs": counts})):
        items, outcomes = outline.outline_edit(tree, table, width=64, **extra)
        got, done = {}, {}
        for r in items.orderBy("doc_id", "idx").collect():
            held = got.setdefault(r.doc_id, [])
            assert r.idx == len(held)
            held.append((r.depth, r.title, r.page))
        for r in outcomes.orderBy("doc_id", "step").collect():
            done.setdefault(r.doc_id, []).append((r.changed, r.error))
        for d, es in edits.items():
            want, how = plain_replay(nested(docs.get(d, []), d), es, pages)
            assert got.get(d, []) == want and done[d] == how
        assert [x[1] for x in got[50]] == ["t50-0", "t50-1", "t50-2", "t50-3"]


def test_the_replay_cuts_and_settles_parts():
    rng = random.Random(3)
    levels = [1] + [rng.randint(1, 4) for _ in range(4999)]
    depths = np.array([x[1] for x in plain_tree(levels)])
    replay = outline._Replay([np.array([depths, depths, np.arange(5000)])])
    top = nested(levels, 0)
    edits = [(rng.choice(["add", "remove", "up", "down"]), rng.randint(0, 900), f"n{k}", 1) for k in range(400)]
    how = [replay.apply(k, op, target) for k, (op, target, *_) in enumerate(edits)]
    want, outcomes = plain_replay(top, edits)
    assert how == outcomes
    titles = [f"t0-{s + i}" if s >= 0 else edits[-1 - s][2] for _, s, n, _, _ in replay.runs() for i in range(n)]
    assert titles == [x[1] for x in want]


def test_two_edits_of_one_document(spark):
    tree = tree_of(spark, {1: [1, 1, 1, 1], 2: [1]})
    left, _ = outline.outline_remove(tree, spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "doc_id int, idx int, step int"))
    assert [(r.doc_id, r.idx, r.title) for r in left.orderBy("idx").collect()] == [(1, 0, "t1-1"), (1, 1, "t1-3")]
    more = spark.createDataFrame([(1, 0, "a", 1), (1, 1, "b", 1)], "doc_id int, parent int, title string, page int")
    items, rejects = outline.outline_add(tree, more)
    assert [r.title for r in items.orderBy("idx").collect()] == ["t1-0", "b", "t1-1", "t1-2", "t1-3", "a"] and rejects.count() == 0
    assert outline.outline_edit(tree.limit(0), more.limit(0).select("doc_id", F.lit(1).alias("step"), F.lit("up").alias("op"), F.lit(0).alias("target"), "title", "page"))[0].count() == 0
