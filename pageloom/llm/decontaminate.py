"""Benchmark passages in documents: fingerprints of item-sized windows, found by Hamming blocks or rare shingles, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from pageloom.llm.common import _PLACE, SHINGLE, arrow_batches, bitmap, in_arrow, in_bitmap, mix, shingle_hashes, word_hashes, words
from pageloom.plans.shared import materialize

SIMILARITY = 0.75
#: Fingerprints up to RADIUS bits apart meet: of BLOCKS equal parts at least one differs by RADIUS // BLOCKS bits or fewer.
RADIUS = 15
BLOCKS = 4
_WIDTH = 64 // BLOCKS
#: Bits of the map of all items' shingles: four MB, whatever the benchmark.
PLACES = 1 << 25
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of word hashes, each counted as often as it occurs, as a signed 64-bit number."""
    votes = ((hashes[:, None] >> _BITS) & np.uint64(1)).sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.bitwise_or.reduce(np.where(votes, np.uint64(1) << _BITS, np.uint64(0))).astype(np.int64))


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words as a shingle, or of every shingle for windows of five words and more."""
    n = min(size, SHINGLE)
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    total = h[: len(h) - n + 1] * _PLACE[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _PLACE[k]
    return mix(total + np.uint64(n)) if n < SHINGLE else mix(total)


def _sized(shingles: np.ndarray, size: int) -> np.ndarray:
    """Places in the map for shingles of items of one size."""
    return mix(shingles + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(PLACES)


def _least(size: int, words_: int) -> int:
    """Shingles that a window of ``words_`` words shares with an item of ``size`` words if they are similar enough."""
    n = max(1, size - SHINGLE + 1) + max(1, words_ - SHINGLE + 1)
    return int(np.ceil(SIMILARITY / (1 + SIMILARITY) * n - 1e-9))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_batches(batches):
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = words(text)
            if tokens and item is not None:
                shingles = shingle_hashes(tokens)
                places = np.concatenate([_sized(shingles, len(tokens)), shingles % np.uint64(PLACES)])
                out.append((item, len(tokens), fingerprint(word_hashes(tokens)), shingles.view(np.int64), places.astype(np.int64)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["item_id", "size", "code", "shingles", "places"])


def _near_blocks() -> list[int]:
    """All differences of one block that a pair within the radius may show in its best block."""
    flips = [0]
    for k in range(1, RADIUS // BLOCKS + 1):
        flips += [sum(1 << b for b in bits) for bits in combinations(range(_WIDTH), k)]
    return flips


def _rare(items: DataFrame) -> DataFrame:
    """(size, shingle, item_id, item_code) of the shingles of each item that the fewest items of its size hold.

    A window that is similar enough lacks at most 1 - SIMILARITY of the item's shingles,
    so it holds one of any that are one more than those. Repeats count as often as they occur.
    """
    one = items.select("item_id", "size", F.col("code").alias("item_code"), F.xxhash64("shingles").alias("text"), F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = one.groupBy("size", "shingle").agg(F.count("*").alias("held"))
    first = Window.partitionBy("item_id", "size", "item_code", "text").orderBy("held", "shingle")
    placed = one.join(held, ["size", "shingle"]).withColumn("place", F.row_number().over(first))
    return placed.where(F.col("place") <= F.floor((1 - SIMILARITY) * F.col("n") + 1e-9) + 1).select("size", "shingle", "item_id", "item_code").distinct()


def _blocks(code: str) -> F.Column:
    part = lambda k: F.shiftrightunsigned(code, k * _WIDTH).bitwiseAND((1 << _WIDTH) - 1)
    return F.array(*[F.struct(F.lit(k).alias("block"), part(k).alias("value")) for k in range(BLOCKS)])


#: Shingles of windows that wait in a task before they are passed on.
HELD_SHINGLES = 1 << 19


def windows(docs: DataFrame, known: np.ndarray, sizes: list[int]) -> DataFrame:
    """Item-sized windows of all texts that hold as many item shingles as the similarity needs, with fingerprints.

    A window with fewer cannot be similar enough to any item of its size, so its
    fingerprint isn't made; the map may let others through, never hold one back. A text
    shorter than an item is one window, the whole text, for items of that size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        names = ["doc_id", "mark", "start_word", "size", "code", "shingles"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

        for batch in arrow_batches(batches, 1000):
            out, waiting = [], 0
            for doc, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h = word_hashes(words(text))
                if not len(h):
                    continue
                long = _runs(h, SHINGLE)
                near = in_bitmap(held, long % np.uint64(PLACES)) if len(long) else np.empty(0, dtype=bool)
                for size in sizes:
                    held_words = min(size, len(h))
                    span, least = max(1, held_words - SHINGLE + 1), _least(size, held_words)
                    if least > span or held_words < min(size, SHINGLE):  # too short for an item of this size
                        continue
                    shingles = long if size >= SHINGLE else _runs(h, size)
                    hit = near.copy() if size >= SHINGLE else in_bitmap(held, shingles % np.uint64(PLACES))
                    at = np.flatnonzero(hit)
                    if len(at) < least:
                        continue
                    hit[at] = in_bitmap(held, _sized(shingles[at], size))
                    total = np.concatenate([[0], np.cumsum(hit)])
                    for start in np.flatnonzero(total[span:] - total[:-span] >= least).tolist():
                        out.append((doc, mark, start, size, fingerprint(h[start : start + size]), shingles[start : start + span].view(np.int64)))
                        waiting += span
                        if waiting >= HELD_SHINGLES:  # one long text may have any number of such windows
                            yield made(out)
                            out, waiting = [], 0
            yield made(out)

    return in_arrow(_marked(docs).select(F.col("doc_id").cast("long"), "mark", "text"), run, "doc_id long, mark long, start_word long, size int, code long, shingles array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    """A row without doc_id is named by its text instead."""
    return docs.withColumn("mark", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle lists: a shingle weighs as often as it occurs."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(p, minlength=len(names)) for p in (place[: len(a)], place[len(a) :]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow_batches(batches):
        pairs = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
        found = np.array([similarity(np.array(a), np.array(b)) for a, b in pairs], dtype=float)
        keep = pa.array(found >= SIMILARITY, pa.bool_())
        kept = [batch.column(k).filter(keep) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(found).filter(keep)], ["size", "code", "item_id", "wording", "similarity"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_windows of every item whose wording a document holds.

    A document holds an item if a window of as many words reaches a weighted similarity
    of 0.75 on five-word shingles with it; the best window is named, the first of equal
    ones. A document with fewer words than the item is itself the window. Items and texts that are null or blank match nothing; items without id are
    left out. Pairs within the radius meet by their fingerprints, all others by the rare
    shingles of the item, so none is missed. Rows with the same doc_id are one document; ``mark`` names rows without.
    """
    items = materialize(
        in_arrow(benchmark.select(F.col("item_id").cast("long"), "text"), _items, "item_id long, size int, code long, shingles array<long>, places array<long>"), "items"
    )
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    known = bitmap(items.select(F.explode("places").alias("place")), "place", PLACES)
    seen = materialize(windows(docs, known, sizes), "windows")
    flips = F.array(*[F.lit(x).cast("long") for x in _near_blocks()])
    probes = (
        items.select("item_id", "size", F.col("code").alias("item_code"), F.explode(_blocks("code")).alias("x"))
        .select("item_id", "size", "item_code", "x.block", F.explode(F.transform(flips, lambda y: y.bitwiseXOR(F.col("x.value")))).alias("value"))
    )
    probes = materialize(probes, "probes")  # its size is then known, so that it is broadcast only if small
    # windows of one wording are one row until they are verified
    alike = materialize(seen.groupBy("size", "code", F.xxhash64("shingles").alias("wording")).agg(F.any_value("shingles").alias("shingles")), "alike")
    rare = materialize(_rare(items), "rare")
    blocks = alike.select("size", "code", "wording", F.explode(_blocks("code")).alias("x")).select("size", "code", "wording", "x.*")
    apart = F.bit_count(F.col("code").bitwiseXOR(F.col("item_code")))
    near = blocks.join(probes, ["size", "block", "value"]).where(apart <= RADIUS)
    held = alike.select("size", "code", "wording", F.explode(F.array_distinct("shingles")).alias("shingle"))
    far = held.join(rare, ["size", "shingle"]).where(apart > RADIUS)
    met = near.select("size", "code", "wording", "item_id").union(far.select("size", "code", "wording", "item_id")).distinct()
    pairs = met.join(alike, ["size", "code", "wording"]).join(items.select("item_id", "size", F.col("shingles").alias("item_shingles")), ["item_id", "size"])
    rows = pairs.select("size", "code", "item_id", "wording", "shingles", "item_shingles")
    sure = materialize(in_arrow(rows, _verified, "size int, code long, item_id long, wording long, similarity double"), "sure")
    named = seen.withColumn("wording", F.xxhash64("shingles")).join(sure, ["size", "code", "wording"])
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back")))
    return (
        named.groupBy("doc_id", "mark", "item_id").agg(best.alias("x"), F.countDistinct("start_word").alias("n_windows"))
        .select("doc_id", "mark", "item_id", "x.similarity", (-F.col("x.back")).alias("start_word"), "n_windows")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item; all columns stay."""
    bad = materialize(leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "leaks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("__m").eqNullSafe(F.col("__mark"))
    return docs.withColumn("__m", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).join(bad, same, "left_anti").drop("__m")
