"""Hierarchical packing: documents go to tiers of context sizes, long windows are filled from shorter tiers."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_batches, in_arrow, ship
from pageloom.llm.vocabulary import VOCABULARY, encode
from pageloom.plans.shared import materialize

TIERS = (2048, 1024, 512, 256)
END = 1
#: Pieces packed together in one task; the number of tasks follows that of the pieces.
SHARD_ROWS = 16_384
#: Tokens of one step group.
GROUP_TOKENS = 1 << 16


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, *, name: str = VOCABULARY, end: int = END) -> DataFrame:
    """Each text's ids and a final id, cut at multiples of the longest tier.

    Only the last, shorter piece of a document carries its ids; it may be cut again.
    """
    longest = TIERS[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 500):
            out: list[tuple] = []
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.append(encode(text, name), np.uint32(end))
                whole = len(ids) // longest * longest
                out += [(row, doc, s, longest, len(ids), _crc(ids[s : s + longest]), None) for s in range(0, whole, longest)]
                if whole < len(ids):
                    rest = ids[whole:]
                    out.append((row, doc, whole, len(rest), len(ids), _crc(rest), rest.astype("<u4" if rest.max() > 0xFFFF else "<u2").tobytes()))
            kinds = (pa.int64(),) * 6 + (pa.binary(),)
            names = ["row", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return in_arrow(rows, run, "row long, doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def tier_of(length: int) -> int:
    return next(t for t in reversed(TIERS) if length <= t)


def pack_lengths(lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(item, from, size), ...]) that hold every token of items no longer than the longest tier.

    Each item of a tier, longest first, opens a window of its tier. The gap takes the
    longest unused items of shorter length that fit, then part of the shortest unused
    one, so a window is full unless no item is left. What remains of a cut item waits
    as a shorter one. At most one window is not full.
    """
    waiting = sorted((n, i, 0) for i, n in enumerate(lengths) if n)
    windows = []
    while waiting:
        size, item, at = waiting.pop()
        tier = tier_of(size)
        held, gap = [(item, at, size)], tier - size
        while gap and waiting:
            k = bisect_right(waiting, gap, key=lambda x: x[0]) - 1
            n, i, s = waiting.pop(max(k, 0))
            take = min(n, gap)
            held.append((i, s, take))
            gap -= take
            if take < n:
                insort(waiting, (n - take, i, s + take))
        windows.append((tier, held))
    return windows


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["length", "row", "start"], kind="stable", ignore_index=True)
    length, start, crc = frame["length"].to_numpy(), frame["start"].to_numpy(), frame["ids_crc32"].to_numpy()
    full = np.flatnonzero(length == TIERS[0])
    part = np.flatnonzero(length < TIERS[0])
    windows = [(TIERS[0], [(i, 0, TIERS[0])]) for i in full.tolist()]
    windows += [(t, [(part[i], s, n) for i, s, n in held]) for t, held in pack_lengths(length[part].tolist())]
    windows.sort(key=lambda w: -w[0])
    groups = max(1, -(-int(length.sum()) // GROUP_TOKENS))
    # dealt out forwards and backwards by turns, longest tiers first, so that groups have like tiers and like sums
    turn = [k % (2 * groups) for k in range(len(windows))]
    group = [t if t < groups else 2 * groups - 1 - t for t in turn]
    shard = int(frame["shard"].iloc[0])
    ids = {}
    out = []
    for seq, w in enumerate(sorted(range(len(windows)), key=lambda k: (group[k], k))):
        tier, held = windows[w]
        offset = 0
        for i, s, n in held:
            value = crc[i]
            if n < length[i]:
                if i not in ids:
                    raw = frame["ids"].iloc[i]
                    ids[i] = np.frombuffer(raw, "<u2" if len(raw) == 2 * length[i] else "<u4")
                value = _crc(ids[i][s : s + n])
            out.append((i, start[i] + s, n, value, (shard << 32) + seq, offset, tier, (shard << 32) + group[w]))
            offset += n
    made = pd.DataFrame(out, columns=["i", "start", "length", "ids_crc32", "sequence_id", "offset", "tier", "step_group"])
    made["doc_id"] = frame["doc_id"].to_numpy()[made["i"]]
    made["doc_tokens"] = frame["doc_tokens"].to_numpy()[made["i"]]
    return made.drop(columns="i").astype({"doc_id": "Int64"})[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]]


def pack(docs: DataFrame, *, name: str = VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group of every piece.

    Documents longer than the longest tier give full windows. The rest of each goes to
    the tier of its length (2048, 1024, 512, 256), opens a window there, and gaps are
    filled from shorter ones. A null or empty text is its final id alone. Pieces are
    dealt to packing tasks by number, not by key, so repeated ids, a long document or a
    large source do not meet in one task; each task leaves at most one window unfilled.
    """
    spark = docs.sparkSession
    ship(spark)
    cut = materialize(pieces(docs, name=name, end=end), "pieces")
    shards = max(1, -(-cut.count() // SHARD_ROWS))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return dealt.groupBy("shard").applyInPandas(_pack, schema)
