"""Nearest neighbours by an inverted multi-index: two vector halves quantised apart, cell pairs visited by a heap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.llm.common import arrow_batches, in_arrow, ship
from pageloom.plans.shared import materialize

#: Centroids of each half, and vectors they are fitted on at most (chosen by a hash of the id).
CENTROIDS = 128
SAMPLE_ROWS = 20_000
ROUNDS = 10
#: A query visits cells until they hold this share of all vectors (and at least LEAST of them).
SHARE = 0.45
LEAST = 2_000
#: How many times the usual error an inner product of halves may pass its centroid's.
REACH = 1.5
#: Vectors stored and scored together; a larger cell is split into several such buckets.
BUCKET_ROWS = 1_024
#: Queries scored against a bucket together.
QUERY_ROWS = 4_096


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows; dense regions start with more centroids."""
    rng = np.random.default_rng(seed)
    found = np.unique(x, axis=0)
    c = found[rng.choice(len(found), min(k, len(found)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def _spread(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Mean distance by coordinate of the rows around each centroid."""
    near = _nearest(x, c)
    apart = np.bincount(near, ((x - c[near]) ** 2).sum(axis=1), minlength=len(c))
    return np.sqrt(apart / np.maximum(np.bincount(near, minlength=len(c)), 1) / max(x.shape[1], 1))


@dataclass(frozen=True)
class Index:
    """Centroids of both halves, spread around them, vectors in each cell, and the buckets that hold a cell. Bounded by CENTROIDS squared."""

    first: np.ndarray
    second: np.ndarray
    spread: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    bucket: np.ndarray
    parts: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _cells(self.first, self.second, x)

    def visit(self, q: np.ndarray, wanted: int) -> list[int]:
        """Cells by rising sum of the two centroid distances until they hold ``wanted`` vectors.

        The distance is that to the best a centroid's vectors are likely to hold: minus
        the inner product of the halves, less REACH times its usual error there, so that
        long vectors, which lie farther around their centroid, are not passed over.
        """
        half = self.first.shape[1]
        d1 = -(self.first @ q[:half]) - REACH * np.linalg.norm(q[:half]) * self.spread[0]
        d2 = -(self.second @ q[half:]) - REACH * np.linalg.norm(q[half:]) * self.spread[1]
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        o1, o2, counts, width = o1.tolist(), o2.tolist(), self.counts, len(s2)
        heap, done, found, held = [(s1[0] + s2[0], 0, 0)], [0] * len(s1), [], 0
        # done[i]: pairs of row i that left the heap; (i, j) enters after (i - 1, j) and (i, j - 1) left
        while heap and held < wanted:
            _, i, j = heappop(heap)
            done[i] = j + 1
            cell = o1[i] * width + o2[j]
            if counts[cell]:
                found.append(cell)
                held += counts[cell]
            if i + 1 < len(s1) and done[i + 1] == j:
                heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
            if j + 1 < width and (i == 0 or done[i - 1] > j + 1):
                heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        return found


def _cells(first: np.ndarray, second: np.ndarray, x: np.ndarray) -> np.ndarray:
    half = first.shape[1]
    return _nearest(x[:, :half], first) * len(second) + _nearest(x[:, half:], second)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector) of rows with an id whose vector is not null or zero and has finite components only.

    Of rows with one id the smallest vector counts; of different lengths the most frequent.
    """
    finite = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0))
    one = good.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(column).alias("vector"))
    one = materialize(one, "vectors")
    common = one.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return one.where(F.size("vector") == (common["n"] if common else 0))


def build(vectors: DataFrame) -> tuple[Index, DataFrame]:
    """The index of (id, vector), and every vector with its cell and bucket."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    x = np.array(sample["vector"].tolist(), dtype=np.float64).reshape(len(sample), -1)
    half = x.shape[1] // 2
    first, second = _means(x[:, :half], CENTROIDS, 1), _means(x[:, half:], CENTROIDS, 2)
    spread = _spread(x[:, :half], first), _spread(x[:, half:], second)
    shared = vectors.sparkSession.sparkContext.broadcast((first, second))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            if batch.num_rows:
                cell = _cells(*shared.value, _matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "vector", "cell"])

    kind = vectors.schema["vector"].dataType.simpleString()
    placed = materialize(in_arrow(vectors.select("id", "vector"), assign, f"id long, vector {kind}, cell int"), "cells")
    counts = np.zeros(len(first) * len(second), dtype=np.int64)
    for row in placed.groupBy("cell").count().collect():  # a row for each cell at most
        counts[row["cell"]] = row["count"]
    parts = np.maximum(1, -(-counts // BUCKET_ROWS))
    bucket, at, room = np.zeros(len(counts), dtype=np.int64), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        if counts[cell] > room:  # a cell lies in one bucket, or has buckets of its own
            at, room = at + 1, BUCKET_ROWS
        bucket[cell] = at
        room -= int(counts[cell])
        if parts[cell] > 1:
            at, room = at + int(parts[cell]) - 1, 0
    table = Index(first, second, spread, counts, bucket, parts)
    own = vectors.sparkSession.sparkContext.broadcast((bucket, parts))

    def to_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, turn = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            start, many = own.value
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(start[cell] + turn % many[cell])], ["id", "vector", "cell", "bucket"])

    turned = placed.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return table, in_arrow(turned, to_bucket, f"id long, vector {kind}, cell int, bucket long")


def _visits(index: Index, queries: DataFrame, wanted: int) -> DataFrame:
    """(bucket, query_id, vector, cells, later): what each query scores in each bucket it visits, later than the first or not."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in arrow_batches(batches, 64):
            rows, buckets, cells, later = [], [], [], []
            for k, q in enumerate(_matrix(batch.column(1)) if batch.num_rows else []):
                by_bucket: dict[int, list[int]] = {}
                for cell in table.visit(q, wanted):
                    start = int(table.bucket[cell])
                    for b in range(start, start + int(table.parts[cell])):
                        by_bucket.setdefault(b, []).append(cell)
                rows += [k] * len(by_bucket)
                buckets += by_bucket.keys()
                cells += by_bucket.values()
                later += [i > 0 for i in range(len(by_bucket))]
            take = pa.array(rows, pa.int64())
            columns = [pa.array(buckets, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(cells, pa.list_(pa.int32())), pa.array(later, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "query_id", "vector", "cells", "later"])

    kind = queries.schema["vector"].dataType.simpleString()
    return in_arrow(queries.select("id", "vector"), run, f"bucket long, query_id long, vector {kind}, cells array<int>, later boolean")


def _best(k: int):
    def run(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(asked):
            ids, cell = entries["id"].to_numpy(), entries["cell"].to_numpy()
            x = np.array(entries["vector"].tolist(), dtype=np.float64)
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                q = np.array(part["vector"].tolist(), dtype=np.float64)
                own = part["query_id"].to_numpy()
                open_ = np.array([np.isin(cell, c) for c in part["cells"]]) & (ids[None, :] != own[:, None])
                near = np.where(open_, q @ x.T, -np.inf)
                # a margin for rounding; the sums that count follow in one fixed order
                floor = np.maximum(np.partition(near, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))], part["floor"].to_numpy())
                r, c = np.nonzero(open_ & (near >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]))
                score = (q[r] * x[c]).sum(axis=1)
                order = np.lexsort((ids[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                out.append(pd.DataFrame({"query_id": own[r[keep]], "vec_id": ids[c[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(vectors: DataFrame, asked: Column, *, k: int = 20, share: float = SHARE, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found for each row that ``asked`` selects.

    Every vector is indexed; a query scores exactly, in double precision, all vectors of
    the cells it visits, its own row left out. Ties go to the smaller id. A bucket that
    many queries visit is scored in several tasks, and a cell that many vectors share is
    kept in several buckets, so neither hot vectors nor hot regions meet in one task.
    Rows with a null, zero or non-finite vector, or without id, take no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = usable(vectors, key, column)
    n = good.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, stored = build(good)
    queries = good.where(asked)
    visits = materialize(_visits(index, queries, max(LEAST, int(np.ceil(share * n)))), "visits")
    copies = materialize(visits.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("copies")), "copies")
    left = stored.join(copies, "bucket").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    copy = F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int")

    def best(some: DataFrame) -> DataFrame:
        right = some.join(copies, "bucket").select("bucket", copy.alias("copy"), "query_id", "vector", "cells", "floor")
        entries = left.select("bucket", "copy", "id", "vector", "cell").groupBy("bucket", "copy")
        return entries.cogroup(right.groupBy("bucket", "copy")).applyInPandas(_best(k), "query_id long, vec_id long, score double")

    # the first bucket of a query holds its nearest cells; what it finds there bounds what later ones return
    nothing = F.lit(float("-inf"))
    near = materialize(best(visits.where("not later").withColumn("floor", nothing)), "near")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    far = best(visits.where("later").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", nothing)))
    pairs = near.unionByName(far)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
