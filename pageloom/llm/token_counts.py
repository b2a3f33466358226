"""Token counts per document: pieces counted once per distinct pre-token, joined to frequencies, summed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_batches, in_arrow
from pageloom.llm.vocabulary import SPECIAL, VOCABULARY, pre_token_pattern, tokenizer
from pageloom.plans.shared import materialize

#: The frequent pre-tokens whose counts are broadcast: at most so many, of at most so many characters,
#: chosen from about SAMPLE rows. The choice moves work between broadcast and join, never a result.
FREQUENT = 200_000
FREQUENT_CHARS = 48
SAMPLE = 8_000


def _frequencies(text: str | None) -> tuple[Counter, int]:
    """How often each pre-token occurs, and how many special strings stand between them."""
    found: Counter = Counter()
    parts = text.split(SPECIAL) if text else []
    for part in parts:
        found.update(pre_token_pattern().findall(part))
    return found, max(0, len(parts) - 1)


def _pieces(tokens: list[str], name: str) -> list[int]:
    parts = (tokens[at : at + 4000] for at in range(0, len(tokens), 4000))  # an encoding is far larger than its text
    return [len(x.ids) for part in parts for x in tokenizer(name).encode_batch(part, add_special_tokens=False)]


def frequent(docs: DataFrame, name: str = VOCABULARY) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            total: Counter = Counter()
            for text in batch.column(0).to_pylist():
                total.update(_frequencies(text)[0])
            kept = {k: v for k, v in total.items() if len(k) <= FREQUENT_CHARS}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["piece", "n"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    found = in_arrow(docs.select("text").sample(share, seed=1), run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [row.piece for row in found.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").collect()]
    return dict(zip(top, _pieces(top, name), strict=True))


def token_counts(docs: DataFrame, *, limit: int = 1024, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text, ...).

    Each text becomes the frequencies of its pre-tokens. The frequent ones are summed
    at once with broadcast counts (a bounded table); the others are joined with counts
    made once per distinct pre-token. No id is kept. A null text counts as empty: zero
    bytes, zero tokens. Repeated rows are counted each; doc_id may be null.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, name))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in arrow_batches(batches, 500):
            sizes, sums, pieces, times = [], [], [], []
            for text in batch.column(2).to_pylist():
                found, total = _frequencies(text)
                rest, often = [], []
                for piece, n in found.items():
                    one = counts.get(piece)
                    if one is None:
                        rest.append(piece)
                        often.append(n)
                    else:
                        total += one * n
                sizes.append(len(text.encode()) if text else 0)
                sums.append(total)
                pieces.append(rest)
                times.append(often)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["row", "doc_id", "n_bytes", "known", "pieces", "times"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 10_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pieces(batch.column(0).to_pylist(), name), pa.int32())], ["piece", "n"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    table = materialize(
        in_arrow(rows, split, "row long, doc_id long, n_bytes long, known long, pieces array<string>, times array<int>"), "frequencies"
    )
    long = table.select("row", F.explode(F.arrays_zip("pieces", "times")).alias("x")).select("row", F.col("x.pieces").alias("piece"), F.col("x.times").alias("times"))
    once = materialize(in_arrow(long.select("piece").distinct(), count, "piece string, n int"), "pieces")
    summed = long.join(once, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0))
    return table.select("row", "doc_id", "n_bytes", "known").join(summed, "row", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )
