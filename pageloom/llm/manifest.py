"""Merkle manifest of a dataset as a postorder append log, with proofs read from it by closed-form positions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import in_arrow, ship
from pageloom.llm.numbering import numbered
from pageloom.plans.shared import materialize

#: Levels that one builder completes: it takes an aligned run of 2**LEVELS nodes. A manifest may have another span.
LEVELS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_LOG = "grp string, level int, index long, leaves long, position long, digest string"


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def before(leaves: int) -> int:
    """Nodes written when that many leaves are in: one complete subtree of 2**(b + 1) - 1 nodes for each set bit b."""
    return 2 * leaves - leaves.bit_count()


def height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of the node that covers leaves index * 2**level and on, in a tree of ``leaves`` leaves.

    A complete subtree is written when its last leaf comes in, so it never moves as the
    log grows. The nodes of the right edge that more leaves would still fill are written
    last, from the lowest: those of the levels above the trailing zero bits of ``leaves``.
    """
    start = index << level
    if start + (1 << level) <= leaves:
        return before(start) + (2 << level) - 2
    trailing = (leaves & -leaves).bit_length() - 1
    return before(leaves) + level - trailing - 1


def leaf_digest(columns: tuple[str, ...] = COLUMNS, **instead: Column) -> Column:
    """Digest of a row: its columns, each as UTF-8 byte count and value, or ``-`` for null; ``instead`` has other values for some."""
    values = [instead.get(c, F.col(c)).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _complete(level: int, span: int, nodes: Iterator[tuple[str, int, int, str]]) -> Iterator[tuple[str, int, int, int, int, str]]:
    """Nodes (grp, index, leaves, digest) of one level, run by run in order, to log rows in completion order.

    Runs are aligned blocks of 2**span nodes. A digest waits in ``waiting`` until its
    partner, or the end of its group, completes the node above.
    """
    waiting: list[tuple[int, str]] = []
    run: tuple[str, int] | None = None
    group, index, leaves = "", 0, 0

    def above(at: int) -> tuple[str, int, int, int, int, str]:
        mine = (index << level) >> at
        return group, at, mine, leaves, position(at, mine, leaves), digest

    for node in nodes:
        if run != (node[0], node[1] >> span):
            run = (node[0], node[1] >> span)
            waiting.clear()
        group, index, leaves, digest = node
        at, top = level, min(level + span, height(leaves))
        if level == 0:
            yield above(0)
        end = (index + 1) << level
        closes = end >= leaves
        # the subtree above is full at every level that divides the number of leaves so far; the group's last node closes the rest
        while at < top and (closes or end & ((2 << at) - 1) == 0):
            left = waiting.pop()[1] if waiting and waiting[-1][0] == at else ""
            digest = digest_of(left, digest)
            at += 1
            yield above(at)
        waiting.append((at, digest))


def _arrow(rows: Iterator[tuple], kinds: tuple[pa.DataType, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _build(level: int, span: int, nodes: DataFrame) -> DataFrame:
    """Log rows above ``level`` (and of it, for leaves) up to the next tier, from (grp, index, leaves, digest) of that level."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [field.split()[0] for field in _LOG.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _arrow(_complete(level, span, rows), kinds, names)

    dealt = nodes.repartition("grp", F.shiftright("index", span)).sortWithinPartitions("grp", "index")
    return in_arrow(dealt.select("grp", "index", "leaves", "digest"), run, _LOG)


def append_log(leaves: DataFrame, span: int = LEVELS) -> DataFrame:
    """The log of the trees of every group: grp, level, index, leaves (of the group), position, digest.

    ``leaves`` has grp, index (from 0), leaves and digest. Builders take aligned runs of
    2**span nodes each and write what they complete; the roots of the runs are the
    nodes of the next tier, so a group of any size is spread over tasks.
    """
    nodes = leaves.select("grp", "index", "leaves", "digest")
    tallest = height(nodes.agg(F.max("leaves")).first()[0] or 0)
    log = None
    for level in range(0, max(tallest, 1), span):
        made = materialize(_build(level, span, nodes), "log")
        log = made if log is None else log.unionByName(made)
        next_ = level + span
        nodes = made.where((F.col("level") == next_) & (F.col("leaves") > (1 << next_))).select("grp", "index", "leaves", "digest")
    return log


def roots(log: DataFrame) -> DataFrame:
    """grp, leaves, digest of the last node of every group."""
    covered = lambda level: F.expr(f"leaves <= shiftleft(1L, {level})")
    return log.where((F.col("index") == 0) & covered("level") & ((F.col("level") == 0) | ~covered("level - 1"))).select("grp", "leaves", "digest")


def siblings(low: int, index: int, leaves: int, read: Callable[[int], str], span: int = LEVELS) -> list[str]:
    """From a node of level ``low`` up to its run's root: at each level '<' or '>' (the sibling is at the left or right) and its digest, or '' alone.

    ``read`` gives the digest at a position of the log.
    """
    out = []
    for level in range(low, min(low + span, height(leaves))):
        own = index >> (level - low)
        other = own ^ 1
        out.append("" if other << level >= leaves else "><"[own & 1] + read(position(level, other, leaves)))
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a digest and its siblings lead to."""
    for step in path:
        digest = digest_of(step[1:], digest) if step[:1] == "<" else digest_of(digest, step[1:])
    return digest


def _paths(level: int, span: int, nodes: DataFrame, log: DataFrame, upper: DataFrame, finish: Callable[[pd.DataFrame, list[list[str]], str], pd.DataFrame], schema: str) -> DataFrame:
    """``finish`` of the sibling paths of ``nodes`` (grp, index, leaves, ...) of a level, each run read with its part of the log.

    That part are the nodes of ``span`` levels below the run's root. ``upper`` has for each
    such root (grp, index) its own path and the root of its group's tree, as ``digest``.
    """
    levels = (F.col("level") >= level) & (F.col("level") < level + span)
    no_path = F.lit(None).cast("array<string>").alias("path")
    taller = (F.col("leaves") > (1 << level)) | F.lit(level == 0)
    part = log.where(levels & taller).select("grp", F.expr(f"shiftright(index, {level + span} - level)").alias("run"), "position", "digest", no_path)
    part = part.unionByName(upper.select("grp", F.col("index").alias("run"), F.lit(-1).cast("long").alias("position"), "digest", "path"))

    def walk(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(known["position"].tolist(), known["digest"].tolist(), strict=True))
        above = list(known.loc[known["position"] == -1, "path"].iloc[0])
        both = zip(asked["index"].tolist(), asked["leaves"].tolist(), strict=True)
        return finish(asked, [siblings(level, i, n, at.__getitem__, span) + above for i, n in both], at[-1])

    runs = nodes.withColumn("run", F.shiftright("index", span)).groupBy("grp", "run")
    return runs.cogroup(part.groupBy("grp", "run")).applyInPandas(walk, schema)


def _with_path(asked: pd.DataFrame, paths: list[list[str]], root: str) -> pd.DataFrame:
    return pd.DataFrame({"grp": asked["grp"], "index": asked["index"], "digest": root, "path": paths})


def tree_paths(leaves: DataFrame, log: DataFrame, above: DataFrame, finish: Callable[[pd.DataFrame, list[list[str]], str], pd.DataFrame] = _with_path, schema: str = "grp string, index long, digest string, path array<string>", span: int = LEVELS) -> DataFrame:
    """``finish`` of the paths of ``leaves`` (grp, index, leaves, ...) through their group's tree and on along ``above`` (grp, leaves, digest, path).

    Tiers are walked from the top, each giving the runs below it the path of their root.
    A tree that ends in a tier starts there. Every log row is read once, every leaf once.
    """
    tallest = height(above.agg(F.max("leaves")).first()[0] or 0)
    upper = None
    for level in reversed(range(0, max(tallest, 1), span)):
        ends = above.where((F.col("leaves") <= (1 << (level + span))) & ((F.col("leaves") > (1 << level)) | F.lit(level == 0))).select("grp", F.lit(0).cast("long").alias("index"), "digest", "path")
        upper = ends if upper is None else upper.unionByName(ends)
        if level == 0:
            return _paths(0, span, leaves, log, upper, finish, schema)
        inner = log.where((F.col("level") == level) & (F.col("leaves") > (1 << level))).select("grp", "index", "leaves")
        upper = materialize(_paths(level, span, inner, log, upper, _with_path, "grp string, index long, digest string, path array<string>"), "paths")
    raise AssertionError("level 0 is always walked")


@dataclass(frozen=True)
class Manifest:
    """Numbered leaves, the log of their trees, the roots of groups with their paths in the tree of roots, and its root.

    Keys of leaves are text; ``kind`` is the type they have in results.
    """

    kind: str
    span: int
    leaves: DataFrame
    log: DataFrame
    groups: DataFrame
    root: str | None


def build(docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id", claim: Column | None = None, span: int = LEVELS) -> Manifest:
    """The manifest of all rows: a tree for each group over its leaves by ascending key, and one over the groups' roots.

    Groups follow the UTF-8 bytes of their value, null first. Null keys come first; rows
    with one key, repeated ones too, are leaves each, by digest. ``claim`` is another
    digest that a holder of the row shows in place of the leaf (null: the leaf). An empty
    table has no root. Texts are hashed where they are read; only digests are shuffled.
    """
    ship(docs.sparkSession)
    group_key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")
    shown = F.lit(None).cast("string") if claim is None else claim
    rows = materialize(docs.select(group_key, F.col(key).alias("key"), leaf_digest(columns).alias("digest"), shown.alias("claim")), "leaves")
    leaves = materialize(numbered(rows, ["grp"], ["key", "digest"], "index", "leaves").withColumn("key", F.col("key").cast("string")), "leaves")
    log = append_log(leaves, span)
    tops = materialize(roots(log), "roots")
    forest = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("leaves").alias("size"), "digest"), ["grp"], ["key"], "index", "leaves")
    forest = materialize(forest, "forest")
    upper = append_log(forest, span)
    end = roots(upper).withColumn("path", F.array().cast("array<string>"))

    def finish(asked: pd.DataFrame, paths: list[list[str]], root: str) -> pd.DataFrame:
        return pd.DataFrame({"grp": asked["key"], "leaves": asked["size"], "digest": asked["digest"], "path": paths})

    groups = materialize(tree_paths(forest, upper, end, finish, "grp string, leaves long, digest string, path array<string>", span), "groups")
    root = end.first()
    return Manifest(docs.schema[key].dataType.simpleString(), span, leaves, log, groups, root["digest"] if root else None)


def proofs(manifest: Manifest) -> DataFrame:
    """key, leaf, claim, subroot and path (as in :func:`siblings`, from the leaf to the root) of every leaf."""

    def finish(asked: pd.DataFrame, paths: list[list[str]], root: str) -> pd.DataFrame:
        return pd.DataFrame({"key": asked["key"], "leaf": asked["digest"], "claim": asked["claim"], "subroot": root, "path": paths})

    out = tree_paths(manifest.leaves, manifest.log, manifest.groups, finish, "key string, leaf string, claim string, subroot string, path array<string>", manifest.span)
    return out.withColumn("key", F.col("key").cast(manifest.kind))


def verify(manifest: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf: what its claim leads to along the path.

    ``proof_sha256`` is the digest of the path's siblings from the leaf to the root. Paths
    are folded where they are read, so that only digests leave the task.
    """

    def finish(asked: pd.DataFrame, paths: list[list[str]], root: str) -> pd.DataFrame:
        shown = asked["claim"].fillna(asked["digest"])
        return pd.DataFrame({
            "key": asked["key"], "leaf": asked["digest"], "subroot": root,
            "proof_sha256": [digest_of(*(step[1:] for step in path)) for path in paths],
            "folded_root": [fold(digest, path) for digest, path in zip(shown, paths, strict=True)],
        })

    out = tree_paths(manifest.leaves, manifest.log, manifest.groups, finish, "key string, leaf string, subroot string, proof_sha256 string, folded_root string", manifest.span)
    root = F.lit(manifest.root).cast("string")
    return out.select(F.col("key").cast(manifest.kind).alias("key"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
