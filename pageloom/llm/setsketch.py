"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_batches, bitmap, groups_of_links, in_arrow, in_bitmap, mix, set_key, shingle_hashes, words
from pageloom.plans.shared import materialize

REGISTERS = 128
BAND = 4
#: Ratio of the register scale. A register holds 1 + OFFSET - ceil(log_BASE(minimum)) in two bytes.
BASE = 1.01
OFFSET = 400
#: Pairs stay candidates unless 0.75 is worse than the best fit by this much log-likelihood (five sigma).
SLACK = 12.5
PERCENT = 75
#: Bits of the map of wanted ids: one MB, whatever the input.
PLACES = 1 << 23

_LOG = float(np.log(BASE))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def registers(hashes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """m registers of a set of 64-bit hashes, two bytes each.

    Every element is a Poisson process of rate m whose arrivals fall on registers at
    random, so each register sees independent exponential minima; only arrivals up to
    the time by which all registers are hit are generated. The register keeps the
    minimum on a scale of powers of BASE, truncated to 0..65535. Registers of a union
    are the maxima of the parts' registers.
    """
    n = len(hashes)
    limit = (np.log(m) + 4.0) / n
    while True:
        best = np.full(m, np.inf)
        active, at, j = hashes, np.zeros(n), 0
        width = int(m * limit) + 2
        while len(active):
            steps = np.arange(j + 1, j + 1 + width, dtype=np.uint64) * _STEP
            r = mix(active[:, None] + steps[None, :])
            times = at[:, None] + np.cumsum(-np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53), axis=1) / m
            hit = times <= limit
            np.minimum.at(best, (mix(r ^ _STEP)[hit] % np.uint64(m)).astype(np.int64), times[hit])
            more = hit[:, -1]
            active, at, j = active[more], times[more, -1], j + width
        if np.isfinite(best).all():
            return np.clip(1 + OFFSET - np.ceil(np.log(best) / _LOG), 0, 65535).astype(np.uint16)
        limit *= 2


def _chance(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other when it alone has a share x of the union."""
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG


_GRID = np.linspace(0.0, 1.0, 201)


def plausible(more: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Whether a similarity of 0.75 or more fits the register comparison, by joint likelihood.

    ``more`` and ``less`` count registers of a above and below those of b. With known
    set sizes the three outcomes have known chances at every similarity, so the
    likelihood over a grid of similarities tells how far 0.75 is from the best fit.
    """
    total = size_a + size_b
    u, v = (size_a / total)[:, None], (size_b / total)[:, None]
    top = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    grid = _GRID[None, :] * top[:, None]
    up, down = _chance(np.clip(u - v * grid, 0, 1)), _chance(np.clip(v - u * grid, 0, 1))
    same = np.clip(1 - up - down, 1e-12, 1)
    fit = more[:, None] * np.log(np.maximum(up, 1e-12)) + less[:, None] * np.log(np.maximum(down, 1e-12)) + (m - more - less)[:, None] * np.log(same)
    high = np.where(grid >= PERCENT / 100 - 1e-9, fit, -np.inf).max(axis=1)
    return high >= fit.max(axis=1) - SLACK


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_batches(batches):
        sizes, keys, regs = [], [], []
        for text in batch.column(1).to_pylist():
            found = np.unique(shingle_hashes(words(text)))
            sizes.append(len(found))
            keys.append(set_key(found) if len(found) else None)
            regs.append(registers(found).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(regs, pa.binary())],
            ["doc_id", "text_key", "n_shingles", "node", "regs"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, node (a name of the distinct shingle set, null if empty) and its registers."""
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return in_arrow(texts, _sketched, "doc_id long, text_key long, n_shingles long, node long, regs binary")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (node, doc_id): only their texts are shingled again and shuffled."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PLACES)).alias("place")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place), "place", PLACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            rows = np.flatnonzero(in_bitmap(shared.value, batch.column(2).to_numpy(zero_copy_only=False)))
            if not len(rows):
                continue
            nodes, sets = [], []
            for text in batch.column(1).take(pa.array(rows)).to_pylist():
                found = np.unique(shingle_hashes(words(text)))
                if len(found):
                    nodes.append(set_key(found))
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    placed = docs.where("doc_id is not null").select("doc_id", "text", place)
    return in_arrow(placed, run, "node long, hashes binary").join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _stack(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose registers allow the similarity."""
    for batch in arrow_batches(batches, 8000):
        if batch.num_rows:
            a, b = _stack(batch, "regs_a"), _stack(batch, "regs_b")
            keep = pa.array(plausible((a > b).sum(axis=1), (a < b).sum(axis=1), _column(batch, "n_a"), _column(batch, "n_b")))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)).filter(keep) for x in ("a", "b")], ["head", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_batches(batches, 500):
        gone, extra = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            head, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            gone.append(np.setdiff1d(head, own, assume_unique=True).view(np.int64))
            extra.append(np.setdiff1d(own, head, assume_unique=True).view(np.int64))
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (gone, extra)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["head", "node", "gone", "extra"])


def differences(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(head, node, n_head, n, gone, extra) of pairs of nodes: what the node's full set lacks of the head's, and adds."""
    ends = pairs.select(F.col("head").alias("node")).union(pairs.select("node")).distinct()
    wanted = materialize(nodes.select("node", "doc_id").join(ends, "node"), "wanted")
    sets = materialize(_sets_of(docs, wanted), "sets")
    side = lambda x, name: sets.select(F.col("node").alias(x), F.col("hashes").alias(name))
    full = pairs.select("head", "node").join(side("head", "x"), "head").join(side("node", "y"), "node").select("head", "node", "x", "y")
    found = in_arrow(full, _shared, "head long, node long, gone array<long>, extra array<long>")
    return found.join(nodes.select(F.col("node").alias("head"), F.col("n").alias("n_head")), "head").join(nodes.select("node", "n"), "node")


_LINKED = f"100 * (n_head - size(gone)) >= {PERCENT} * (n + size(gone))"
_NEAR = f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)"


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, the nodes (distinct sets) among them, and labels of the nodes that have links."""
    rows = materialize(sketches(docs), "sketches")
    nodes = materialize(
        rows.where("node is not null and doc_id is not null")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("x"))
        .select("node", "x.doc_id", F.col("x.n_shingles").alias("n"), "x.regs"),
        "nodes",
    )
    return rows, nodes, materialize(node_groups(docs, nodes), "labels")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked sets, that with the smallest doc_id (then hash of the text).

    What counts is a row's own text: rows that share a doc_id but not their wording are
    judged each. Of rows alike in id and text one stays, the first by its other columns.
    Rows without id, and null or blank texts, stay.
    """
    rows, _, labels = _grouped(docs)
    rows = rows.where("node is not null and doc_id is not null").select("node", "doc_id", "text_key")
    own = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n"))
    own = own.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = materialize(own, "own")
    groups = materialize(own.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1"), "groups")
    stays = materialize(own.select("node", "label").join(groups, "label").select("node", "first"), "stays")
    mine = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    fate = rows.join(stays, "node").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    fate = materialize(fate.agg(F.max(mine).alias("__stays"), F.count("*").alias("__n")).where("__n > 1 or not __stays"), "copies")
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    once = docs.join(fate, same, "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(c) for c in others]) if others else F.lit(None)
    again = docs.join(fate.where("__stays"), same, "left_semi").groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest) if others else F.lit(0)).alias("__rest"))
    return once.unionByName(again.select("doc_id", "text", *[F.col("__rest").getField(c).alias(c) for c in others]))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    Documents link when their sets of five-word shingles reach a similarity of 0.75;
    component_id is the smallest doc_id reachable. Rows whose sets are equal are one
    node from the start, however many they are. Nodes that share a band of registers
    are compared with the band's first node; what that leaves in different groups is
    then compared pairwise, so a group is never expanded into all its pairs and no
    link between groups is lost.

    Null or blank texts have an empty set and stand alone. A row without doc_id links
    nothing: component_id null, kept true. Repeated rows get the same answer each.
    """
    rows, nodes, labels = _grouped(docs)
    named = materialize(
        labels.join(nodes.select(F.col("node").alias("id"), "doc_id"), "id").groupBy("label").agg(F.min("doc_id").alias("component_id")), "named"
    )
    placed = materialize(
        nodes.select("node", "doc_id").join(labels.select(F.col("id").alias("node"), "label"), "node", "left").join(named, "label", "left")
        .select("node", F.coalesce("component_id", "doc_id").alias("component_id")),
        "placed",
    )
    out = rows.select("doc_id", "n_shingles", "node").join(placed, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def node_groups(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label) of the nodes that have links.

    The head of a band of equal registers is its member that meets most others, over
    all bands. A member is compared with the head on full sets if their registers allow
    the similarity. Where members are in different groups after that, each is written
    as its differences from the head; two members' exact similarity follows from their
    differences, so all such pairs are decided inside the join and only links come out.
    """
    bands = nodes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
                lambda i: F.xxhash64(i, F.substring("regs", i * (2 * BAND) + 1, F.lit(2 * BAND))),
            )
        ).alias("key"),
    )
    sizes = materialize(bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "sizes")
    members = materialize(bands.join(sizes, "key"), "members")
    met = materialize(members.groupBy("node").agg(F.sum("members").alias("met")), "met")
    heads = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("x")).select("key", F.col("x.node").alias("head"))
    headed = materialize(members.join(materialize(heads, "heads"), "key").select("key", "head", "node"), "headed")
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    star = headed.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    star = materialize(in_arrow(star.join(side("b"), "b").join(side("a"), "a").where(_NEAR), _fits, "head long, node long"), "star")
    links = materialize(differences(docs, nodes, star).where(_LINKED).select(F.col("head").alias("a"), F.col("node").alias("b")), "links")
    labels = groups_of_links(links)

    found = headed.join(labels.select(F.col("id").alias("node"), "label"), "node", "left")
    found = materialize(found.withColumn("label", F.coalesce("label", "node")), "found")
    live = found.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
    open_ = materialize(found.join(materialize(live, "live"), "key"), "open")
    apart = materialize(differences(docs, nodes, open_.select("head", "node").distinct()), "apart")
    full = open_.join(apart, ["head", "node"]).select("key", "node", "label", "n_head", "n", "gone", "extra")
    left, right = (full.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "gone", "extra")], *(["n_head"] if x == "a" else [])) for x in ("a", "b"))
    bound = "(n_head - greatest(size(gone_a), size(gone_b)) + least(size(extra_a), size(extra_b)))"
    exact = "(n_head - size(array_union(gone_a, gone_b)) + size(array_intersect(extra_a, extra_b)))"
    reach = lambda both: f"100 * {both} >= {PERCENT} * (n_a + n_b - {both})"
    more = left.join(right, "key").where(f"label_a < label_b and {_NEAR} and {reach(bound)} and {reach(exact)}")
    more = materialize(more.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "more")
    return labels if more.isEmpty() else groups_of_links(links.unionByName(more))
