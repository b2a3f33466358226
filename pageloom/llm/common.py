"""Helpers the training-data operators share: word and shingle hashes, written tables, links to groups."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.plans.shared import materialize

SHINGLE = 5
#: Word hashes kept per Python worker; the cache is emptied beyond this many.
WORD_CACHE = 100_000
#: Odd multipliers, one for each place in a shingle.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at runs of space and \\x09-\\x0D. Lone surrogates become '?'."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def shingle_hashes(tokens: list[bytes]) -> np.ndarray:
    """Hash of every run of five words, in order; fewer words make one shingle, no words none."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(tokens)
    n = len(h)
    if n < SHINGLE:
        return mix((h * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = h[: n - SHINGLE + 1] * _PLACE[0]
    for k in range(1, SHINGLE):
        total = total + h[k : n - SHINGLE + 1 + k] * _PLACE[k]
    return mix(total)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a sorted hash array."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def ids_crc_mod3(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in.

    A cluster without that folder gets the package through ``--py-files`` instead. A
    session with the default size of Arrow batches gets smaller ones, as texts are long.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def arrow_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds does not follow the batch size of the session."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(folder, name))


def bitmap(places: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A bit set at each value (0 to bits - 1) of a column, built by an aggregation.

    At most ``bits / 64`` words reach the driver however many rows there are, so the
    result may be broadcast. When values are hashes, readers may find foreign ones in
    it, never miss one.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(column, F.lit(64)).cast("int"))
    words_ = places.select(F.shiftright(column, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words_:
        out[row.w] = row.b
    return out.view(np.uint64)


def in_bitmap(known: np.ndarray, places: np.ndarray) -> np.ndarray:
    places = places.astype(np.uint64)
    return ((known[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool)


def groups_of_links(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id it is connected with.

    Alternates large-star and small-star steps: each id's links are moved to its
    smallest neighbour, so a group of any shape shrinks to a star in a few rounds. Each
    round is two aggregations with partial results and two joins on written tables,
    which adaptive execution may split; nothing gathers a group in one task.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if now == seen:
            break
        seen = now
    stars = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
