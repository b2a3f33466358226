"""Recursion over links by repeated joins, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.plans.shared import materialize, with_package

#: Links that one task settles at the end; above it nodes are taken out round by round.
CORE = 20_000


def _chains(refs: DataFrame, heads: DataFrame | None, seeds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Contract what has a single way in: (nodes, links between the rest, or None if there are none).

    A node with one incoming link, unless it is a head, is fully described by the node
    it comes from, so all such chains and trees shrink by pointer doubling to their
    ``anchor``: a head, or a node with several ways in or none. ``nodes`` has keys +
    (id, up, anchor, hops, low), low being the smallest label of the ``seeds`` (id,
    label) passed, the node's own included; ``up`` is only left on loops without a way
    in. ``links`` lead from anchors to nodes with several ways in. What is known of a
    node comes together in one aggregation; its ways in are several if the smallest and
    the largest differ.
    """
    every = materialize(refs.select(*keys, "src", "dst"), "links")
    label = seeds.schema["label"].dataType
    none = {"__from": F.lit(None).cast(refs.schema["src"].dataType), "__head": F.lit(None).cast("boolean"), "low": F.lit(None).cast(label)}
    row = lambda df, id_, **known: df.select(*keys, F.col(id_).alias("id"), *[known.get(c, v).alias(c) for c, v in none.items()])
    marks = row(every, "dst", __from=F.col("src")).unionByName(row(every, "src")).unionByName(row(seeds, "id", low=F.col("label")))
    if heads is not None:
        marks = marks.unionByName(row(heads, "id", __head=F.lit(True)))
    known = marks.groupBy(*keys, "id").agg(F.min("__from").alias("__from"), F.max("__from").alias("__to"), F.max("__head").alias("__head"), F.min("low").alias("low"))
    one = (F.col("__from") == F.col("__to")) & F.col("__head").isNull() & (F.col("__from") != F.col("id"))
    up = F.when(one, F.col("__from"))
    several = F.coalesce(F.col("__from") != F.col("__to"), F.lit(False)).alias("__several")
    nodes = known.select(*keys, "id", up.alias("up"), F.col("id").alias("anchor"), F.when(up.isNotNull(), 1).otherwise(0).alias("hops"), "low", several)
    walked = climb(
        nodes,
        keys,
        lambda near, far: {"anchor": far("anchor"), "hops": near("hops") + far("hops"), "low": F.least(near("low"), far("low"))},
    )
    joints = walked.filter("__several").select(*keys, F.col("id").alias("dst"))
    if joints.isEmpty():
        return walked.drop("__several"), None
    start = walked.select(*keys, F.col("id").alias("src"), "anchor", "hops", F.col("low").alias("passed"))
    links = every.join(joints, [*keys, "dst"], "left_semi").join(start, [*keys, "src"])
    links = links.groupBy(*keys, "anchor", "dst").agg(F.min("hops").alias("hops"), F.min("passed").alias("passed"))
    return walked.drop("__several"), materialize(links, "links")


def _improve(links: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` (keys, id, value) lowered along ``links`` until none improves, round by round."""
    best = changed = values
    while True:
        offers = changed.withColumnRenamed("id", "src").join(links, [*keys, "src"]).select(*keys, F.col("dst").alias("id"), (F.col("value") + F.col("w")).alias("offer"))
        better = offers.groupBy(*keys, "id").agg(F.min("offer").alias("offer")).join(best, [*keys, "id"], "left").filter(F.col("value").isNull() | (F.col("offer") < F.col("value")))
        new = materialize(better.select(*keys, "id", F.col("offer").alias("value")), "better")
        if new.isEmpty():
            return best
        best, changed = materialize(_lowest(best.unionByName(new), keys), "best"), new


def _lowest(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys, "id").agg(F.min("value").alias("value"))


def _settle(links: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`least` of at most CORE links, by shortest paths in one task. Values at other nodes pass it by."""
    ends = links.select(*keys, F.col("src").alias("id")).unionByName(links.select(*keys, F.col("dst").alias("id"))).distinct()
    inner, outer = values.join(ends, [*keys, "id"], "left_semi"), values.join(ends, [*keys, "id"], "left_anti")
    value_rows = inner.select(*keys, F.col("id").alias("src"), F.lit(None).cast(links.schema["dst"].dataType).alias("dst"), F.col("value").alias("w"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        is_link = frame["dst"].notna().to_numpy()
        both = pd.concat([frame[[*keys, "src"]].rename(columns={"src": "id"}), frame.loc[is_link, [*keys, "dst"]].rename(columns={"dst": "id"})])
        number = both.groupby([*keys, "id"], sort=False, dropna=False).ngroup().to_numpy()
        source, target = number[: len(frame)], number[len(frame) :]
        weight = frame["w"].to_numpy(dtype=np.int64)
        onward: list[list[tuple[int, int]]] = [[] for _ in range(number.max() + 1)]
        for u, v, w in zip(source[is_link].tolist(), target.tolist(), weight[is_link].tolist(), strict=True):
            onward[u].append((v, w))
        waiting = list(zip(weight[~is_link].tolist(), source[~is_link].tolist(), strict=True))
        heapify(waiting)
        found: dict[int, int] = {}
        while waiting:
            value, node = heappop(waiting)
            if node not in found:
                found[node] = value
                for v, w in onward[node]:
                    heappush(waiting, (value + w, v))
        first = pd.Series(np.arange(len(number))).groupby(number).first()
        out = both.iloc[first.loc[list(found)].to_numpy()].copy()
        out["value"] = list(found.values())
        return out

    with_package(links.sparkSession)
    rows = links.select(*keys, "src", "dst", "w").unionByName(value_rows)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keys, "id", "value").schema)
    return materialize(outer.unionByName(rows.groupBy().applyInPandas(run, shape)), "settled")


def least(links: DataFrame, values: DataFrame, keys: list[str], *, core: int = CORE) -> DataFrame:
    """keys + (id, value): the lowest value that reaches each node, its own or another's plus the weights on the way.

    ``links`` has keys + (src, dst, w), w being a long of at least 0; ``values`` keys + (id, value).
    Nodes are taken out many at a time, each leaving a link from every node before it to
    every node behind it, so that a path of any length halves again and again; only nodes
    whose links do not grow by that go, no two of them neighbours. What is left is either
    small and settled in one task, or dense, where paths are short and plain rounds end
    soon. Values then flow back to what was taken out. Loops do no harm.
    """
    links = materialize(links.filter("src != dst").groupBy(*keys, "src", "dst").agg(F.min("w").alias("w")), "links")
    values = materialize(_lowest(values.select(*keys, "id", F.col("value").cast("long").alias("value")), keys), "values")
    left, taken = links.count(), []
    while left > core:
        ends = links.select(*keys, F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(*keys, F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        degree = ends.groupBy(*keys, "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        light = materialize(degree.filter("o * i <= o + i + 2").select(*keys, "id", F.xxhash64("id", F.lit(len(taken))).alias("rank")), "light")
        side = lambda c: light.select(*keys, F.col("id").alias(c), F.col("rank").alias(f"rank_{c}"))
        beside = links.join(side("src"), [*keys, "src"]).join(side("dst"), [*keys, "dst"])
        loser = F.when(F.struct("rank_src", "src") > F.struct("rank_dst", "dst"), F.col("src")).otherwise(F.col("dst"))
        out = materialize(light.select(*keys, "id").join(beside.select(*keys, loser.alias("id")), [*keys, "id"], "left_anti"), "out")
        into = materialize(links.join(out.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi").select(*keys, "src", "dst", "w"), "into")
        onto = links.join(out.withColumnRenamed("id", "src"), [*keys, "src"], "left_semi").select(*keys, "src", "dst", "w")
        rest = links.join(out.withColumnRenamed("id", "src"), [*keys, "src"], "left_anti").join(out.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_anti")
        past = into.select(*keys, "src", F.col("dst").alias("__by"), F.col("w").alias("__w")).join(onto.select(*keys, F.col("src").alias("__by"), "dst", "w"), [*keys, "__by"])
        past = past.filter("src != dst").select(*keys, "src", "dst", (F.col("__w") + F.col("w")).alias("w"))
        passed = onto.withColumnRenamed("src", "id").join(values, [*keys, "id"]).select(*keys, F.col("dst").alias("id"), (F.col("value") + F.col("w")).alias("value"))
        values = materialize(_lowest(values.unionByName(passed), keys), "values")
        links = materialize(rest.select(*keys, "src", "dst", "w").unionByName(past).groupBy(*keys, "src", "dst").agg(F.min("w").alias("w")), "links")
        taken.append(into)
        before, left = left, links.count()
        if left > 0.95 * before:
            break
    if left:
        values = _settle(links, values, keys) if left <= core else _improve(links, values, keys)
    for into in reversed(taken):
        back = into.withColumnRenamed("src", "id").join(values, [*keys, "id"]).select(*keys, F.col("dst").alias("id"), (F.col("value") + F.col("w")).alias("value"))
        values = materialize(_lowest(values.unionByName(back), keys), "values")
    return values


def reachable(refs: DataFrame, roots: DataFrame, keys: list[str], *, core: int = CORE) -> DataFrame:
    """Every node reachable from ``roots`` with its smallest number of hops.

    ``refs`` has keys + (src, dst); ``roots`` has keys + (id). Chains and trees are
    contracted first; the links between nodes with several ways in are then worked off
    by :func:`least`, so rounds follow the logarithm of the depth.
    """
    heads = roots.select(*keys, "id").distinct()
    nodes, links = _chains(refs, heads, heads.withColumn("label", F.lit(0)), keys)
    known = heads.withColumn("value", F.lit(0).cast("long"))
    if links is not None:
        known = least(links.select(*keys, F.col("anchor").alias("src"), "dst", (F.col("hops") + 1).cast("long").alias("w")), known, keys, core=core)
    found = nodes.filter(F.col("up").isNull()).join(known.withColumnRenamed("id", "anchor"), [*keys, "anchor"])
    return found.select(*keys, "id", (F.col("value") + F.col("hops")).cast("int").alias("level"))


def smallest_label(refs: DataFrame, seeds: DataFrame, keys: list[str], *, core: int = CORE) -> DataFrame:
    """For every node reachable from a seed, the smallest label among those seeds.

    ``seeds`` has keys + (id, label). As in :func:`reachable`; a seed does not end a chain,
    its label is passed on.
    """
    own = seeds.groupBy(*keys, "id").agg(F.min("label").alias("label"))
    nodes, links = _chains(refs, None, own, keys)
    kind = seeds.schema["label"].dataType
    if links is None:
        above = nodes.filter(F.col("up").isNull() & (F.col("id") == F.col("anchor"))).select(*keys, "anchor", F.col("low").alias("__above"))
    else:
        heads = nodes.filter(F.col("up").isNull() & (F.col("id") == F.col("anchor")))
        start = heads.filter(F.col("low").isNotNull()).select(*keys, "id", F.col("low").alias("value"))
        fixed = links.filter(F.col("passed").isNotNull()).select(*keys, F.col("dst").alias("id"), F.col("passed").alias("value"))
        best = least(links.select(*keys, F.col("anchor").alias("src"), "dst", F.lit(0).cast("long").alias("w")), start.unionByName(fixed), keys, core=core)
        above = best.select(*keys, F.col("id").alias("anchor"), F.col("value").cast(kind).alias("__above"))
    found = nodes.join(above, [*keys, "anchor"], "left").withColumn("label", F.least("low", "__above"))
    return found.filter(F.col("label").isNotNull()).select(*keys, "id", "label")


def climb(
    nodes: DataFrame,
    keys: list[str],
    merge: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]],
    *,
    max_depth: int | None = None,
) -> DataFrame:
    """Fold values along every node's chain of ``up`` links by pointer doubling.

    ``nodes`` has keys + (id, up) + value columns; ``merge(near, far)`` combines the
    values of a stretch with those of the stretch above it. log2(depth) rounds of
    joins on a unique key; finished nodes leave the join, so a shared root never
    becomes a hot key of missing links. Without ``max_depth`` chains of any length are
    followed; a node whose chain runs into a loop keeps an ``up`` link.
    """
    values = [c for c in nodes.columns if c not in (*keys, "id", "up")]
    state = materialize(nodes, "climb")
    span = 1
    while max_depth is None or span < max_depth:
        active = state.filter(F.col("up").isNotNull())
        if active.isEmpty():
            break
        if max_depth is None and span > 1 << 10 and span > state.count():
            break  # longer than all nodes in a row: what is left runs in loops
        far = state.select(
            *keys,
            F.col("id").alias("up"),
            F.lit(True).alias("__found"),
            F.col("up").alias("__up"),
            *[F.col(v).alias(f"__{v}") for v in values],
        )
        joined = active.join(far, [*keys, "up"], "left")
        merged = merge(lambda v: F.col(v), lambda v: F.col(f"__{v}"))
        moved = joined.select(
            *keys,
            "id",
            F.col("__up").alias("up"),
            *[F.when(F.col("__found"), merged.get(v, F.col(v))).otherwise(F.col(v)).alias(v) for v in values],
        )
        state = materialize(state.filter(F.col("up").isNull()).unionByName(moved), "climb")
        span *= 2
    return state


def walk_chain(links: DataFrame, heads: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Positions along singly linked chains, safe on loops.

    ``links`` has keys + (node, next); ``heads`` has labels + keys + (node). Each round
    doubles the covered length. Returns labels + keys + (node, pos), pos from 1.
    """
    ident = [*labels, *keys, "node"]
    reach = materialize(heads.select(*ident).distinct().withColumn("pos", F.lit(1).cast("long")), "chain")
    jump = materialize(links.select(*keys, "node", "next").filter(F.col("next").isNotNull()), "chain")
    seen = reach.count()
    step = 1
    while True:
        ahead = reach.join(jump, [*keys, "node"]).select(
            *labels, *keys, F.col("next").alias("node"), (F.col("pos") + F.lit(step)).alias("pos")
        )
        reach = materialize(reach.unionByName(ahead).groupBy(*ident).agg(F.min("pos").alias("pos")), "chain")
        now = reach.count()
        if now == seen:
            return reach
        seen = now
        far = jump.select(*keys, F.col("node").alias("next"), F.col("next").alias("__next"))
        jump = materialize(jump.join(far, [*keys, "next"]).select(*keys, "node", F.col("__next").alias("next")), "chain")
        step *= 2
