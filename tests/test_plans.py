"""Two-level windows, expansion and recursion against plain forms, with tiny buckets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W, functions as F

from pageloom.catalog import QUERIES
from pageloom.plans.graph import climb, reachable, smallest_label, walk_chain
from pageloom.plans.scan import Running, expand, groups_past, row_index, running


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("hinted", [False, True])
def test_running_equals_window(spark, descending, hinted):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in range(4) for i in range(1, 5 + 20 * k)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    order = F.col("i").desc() if descending else F.col("i")
    w = W.partitionBy("k").orderBy(order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = df.select("k", "i", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.last("v", True).over(before).alias("l"), F.max("v").over(upto).alias("m"), F.min("v").over(before).alias("n"))
    got = running(
        df, ["k"], "i",
        {"s": Running("sum", F.col("v")), "l": Running("last", F.col("v"), False), "m": Running("max", F.col("v")), "n": Running("min", F.col("v"), False)},
        width=4, descending=descending, large=groups_past(df, ["k"], "i", 4) if hinted else None,
    ).select("k", "i", "s", "l", "m", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) or sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_row_index_splits_large_groups(spark):
    rows = [(k, (i * 7) % 31, i) for k in range(3) for i in range(1 + 15 * k)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    want = df.select("*", F.row_number().over(W.partitionBy("k").orderBy("a", "b")).alias("n"))
    got = row_index(df, ["k"], ["a", "b"], "n", F.floor(F.col("a") / 5), width=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_expand_spreads_long_rows(spark):
    df = spark.createDataFrame([(1, 3), (2, 25), (3, 0)], "k int, n int")
    got = expand(df, F.col("n"), "i", bound=F.col("n"), spread=["k"], width=4)
    assert sorted((r.k, r.i) for r in got.collect()) == [(1, i) for i in range(3)] + [(2, i) for i in range(25)]


def test_reachable_with_a_loop(spark):
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = reachable(refs, spark.createDataFrame([("a",)], "id string"), [])
    assert sorted((r.id, r.level) for r in got.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    seeds = spark.createDataFrame([("a", 5), ("x", 1), ("c", 3)], "id string, label int")
    assert sorted((r.id, r.label) for r in smallest_label(refs, seeds, []).collect()) == [("a", 3), ("b", 3), ("c", 3), ("x", 1), ("y", 1)]


def test_climb_takes_the_nearest(spark):
    rows = [(i, i - 1 if i else None, i if i % 10 == 0 else None) for i in range(40)]
    nodes = spark.createDataFrame(rows, "id int, up int, v int")
    got = climb(nodes, [], lambda near, far: {"v": F.coalesce(near("v"), far("v"))}, max_depth=64)
    assert all(r.v == r.id // 10 * 10 for r in got.collect())


def test_walk_chain_stops_on_a_loop(spark):
    links = spark.createDataFrame([(1, i, i + 1 if i < 9 else 4) for i in range(1, 10)] + [(2, 1, None)], "doc_id int, node int, next int")
    heads = spark.createDataFrame([(1, 1), (2, 1)], "doc_id int, node int")
    got = walk_chain(links, heads, ["doc_id"], [])
    assert sorted((r.doc_id, r.node, r.pos) for r in got.collect()) == [(1, i, i) for i in range(1, 10)] + [(2, 1, 1)]


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s2_merge_inputs", "w5_delete_pages", "w6_move_pages", "j2_page_labels", "j4_redact_area", "j5_redact_find", "j6_redact_paths", "w10_booklet_order", "a9_compress_report"])
def test_no_cross_join_and_no_single_task_window(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "SinglePartition", "BatchEvalPython"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["a8_image_effective_dpi"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(l_partkey)" in plan and "l_extendedprice" not in plan
