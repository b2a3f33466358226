"""Shards by fixed virtual slots: records are hashed to slots, and a versioned map from slots to shards is edited to balance them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.numbering import numbered
from pageloom.plans.shared import materialize, new_path

#: Slots never change in number; only their shards do.
SLOTS = 4096
SHARDS = 8
#: Copies of one record beyond which they are dealt over all slots, as multiple of a slot's share.
MANY = 4


def records(docs: DataFrame, *, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32, virtual_slot of every row, read once.

    Size is the UTF-8 bytes of the text and 1 more; a null text has no bytes. The slot is a
    hash of key and text, so that many texts of one key, and many keys of one text, are
    spread. Equal rows that number more than MANY slots' share are dealt over the slots by
    their place in the table; there are at most ``slots`` / MANY such records.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = (F.octet_length(body) + 1).cast("long")
    read = docs.select(F.col(key).alias("key"), size.alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(F.col(key), body).alias("hash"))
    rows = materialize(read.withColumn("place", F.monotonically_increasing_id()), "records")
    alike = rows.groupBy("hash").agg(F.count("*").alias("copies"))
    many = alike.where(F.col("copies") > F.lit(MANY * rows.count() / slots)).where("copies > 1").select("hash", F.lit(True).alias("many"))
    salt = F.when(F.col("many"), F.xxhash64("hash", "place")).otherwise(F.col("hash"))
    return rows.join(F.broadcast(many), "hash", "left").select("key", "size", "text_crc32", F.pmod(salt, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of each slot; one aggregated row for each slot reaches the driver."""
    load, count = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        load[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    return load, count


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> np.ndarray:
    return np.arange(slots) % shards


def edited(current: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """A new version of the map: slots leave the heaviest shard for the lightest while that brings them closer.

    New shards (numbers not in use before) start empty; slots of shards that are no more
    (numbers from ``shards`` on) are dealt out first. Each step moves the slot nearest to
    half the difference, or exchanges two slots if no single one helps, so few slots move
    when little has changed.
    """
    out = current.copy()
    total = np.bincount(out, weights=load, minlength=shards).astype(np.int64)
    for slot in sorted(np.flatnonzero(out >= shards).tolist(), key=lambda s: (-load[s], s)):
        to = int(np.argmin(total[:shards]))
        total[out[slot]] -= load[slot]
        out[slot] = to
        total[to] += load[slot]
    total = total[:shards]
    while True:
        high, low = int(np.argmax(total)), int(np.argmin(total))
        gap = int(total[high] - total[low])
        mine, theirs = np.flatnonzero((out == high) & (load > 0)), np.flatnonzero(out == low)
        if gap < 2 or not len(mine):
            return out
        move = mine[np.argmin(np.abs(load[mine] * 2 - gap))]
        change = int(load[move])
        other = None
        if abs(gap - 2 * change) > max(1, gap // 8) and len(theirs):
            order = theirs[np.argsort(load[theirs], kind="stable")]
            # for each slot of the heaviest, the partner that leaves the two closest
            want = load[mine] - gap / 2
            at = np.clip(np.searchsorted(load[order], want), 0, len(order) - 1)
            before = np.maximum(at - 1, 0)
            off = lambda k: np.abs(load[mine] - load[order[k]] - gap / 2)
            pick = np.where(off(at) <= off(before), at, before)
            best = int(np.argmin(off(pick)))
            swapped = int(load[mine[best]] - load[order[pick[best]]])
            if 0 < swapped < gap and abs(gap - 2 * swapped) < abs(gap - 2 * change):
                move, other, change = mine[best], order[pick[best]], swapped
        if not 0 < change < gap:
            return out
        out[move] = low
        if other is not None:
            out[other] = high
        total[high] -= change
        total[low] += change


def store(spark, place: str, version: int, shard_of: np.ndarray, load: np.ndarray) -> DataFrame:
    """Write a version of the map beside earlier ones (version, virtual_slot, shard, bytes); a version that is there is refused."""
    rows = [(version, k, int(s), int(b)) for k, (s, b) in enumerate(zip(shard_of, load, strict=True))]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long").coalesce(1).write.mode("error").parquet(f"{place}/version={version}")
    return stored(spark, place, version)


def stored(spark, place: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{place}/version={version}")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` (of :func:`records`) with their shard, and their place in it from 0 without gaps, by slot and key.

    The map has one row for each virtual slot, so it is broadcast. Places are counted over
    ranges of slots and keys, never over a whole shard.
    """
    dealt = rows.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    return numbered(materialize(dealt, "dealt"), ["shard"], ["virtual_slot", "key", "text_crc32", "size"], "slot", "shard_rows")


def shard(docs: DataFrame, *, shards: int = SHARDS, place: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot, map_version of every row; shards are near equal in bytes.

    Version 1 of the map deals slots by number; it is edited once by the bytes of each
    slot and stored as version 2 in ``place`` (a fresh folder if not given). Rows with
    null, equal or repeated ids are dealt like others; an empty table has no rows.
    """
    spark = docs.sparkSession
    rows = records(docs)
    load, _ = slot_loads(rows)
    place = place or new_path(spark, "slots")
    start = first_map(shards)
    store(spark, place, 1, start, load)
    now = store(spark, place, 2, edited(start, load, shards), load)
    out = placed(rows, now)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", "virtual_slot", "shard", "slot", F.lit(2).alias("map_version"))
