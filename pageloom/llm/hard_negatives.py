"""Hard negatives from candidate blocks in Hilbert order: zone maps bound every inner product, and only blocks whose bounds meet an anchor's windows are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.llm.common import arrow_batches, in_arrow, ship
from pageloom.plans.shared import materialize

#: Candidates of a block at most; vectors of many components get smaller ones.
BLOCK_ROWS = 512
_BLOCK_VALUES = 1 << 18
#: The curve runs through so many main axes, each cut into 2**BITS ranges. Axes are fitted on at most SAMPLE_ROWS rows.
AXES = 9
BITS = 7
SAMPLE_ROWS = 20_000
#: Anchors scored against a block together, and blocks and anchors whose bounds are worked out together.
ANCHOR_ROWS = 512
ZONE_ROWS = 2_048
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between so many hundredths of the positive's and the positive's.
LEAST_PERCENT = 80
#: Components beyond this count as it.
_LARGEST = 1 << 62


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below 2**bits, one column for each axis), as one integer.

    Bit plane by bit plane from the highest, the axes below the current orientation are
    reflected or exchanged, and the Gray code of the planes is read off.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0)).astype(np.uint64)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _integers(column: pa.Array, scale: int) -> list[np.ndarray]:
    """Each vector's components times ``scale``, rounded down."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    flat = np.clip(flat, -float(_LARGEST), float(_LARGEST)).astype(np.int64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.split(flat, ends[:-1]) if len(ends) else []


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while no sum can pass 2**53, else in Python integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    out = a.astype(object) @ b.T.astype(object)
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each row of ``a`` with any vector between ``low`` and ``high``: interval arithmetic by dimension."""
    width = max(a.shape[1], low.shape[1])
    if a.shape[1] < width:
        a = np.pad(a, ((0, 0), (0, width - a.shape[1])))
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    # sums of doubles; a margin keeps the bounds true where they pass 2**53
    most = plus @ _wide(high, width).T + minus @ _wide(low, width).T
    least = plus @ _wide(low, width).T + minus @ _wide(high, width).T
    slack = 1e-9 * (np.abs(most) + np.abs(least))
    slack[np.maximum(np.abs(most), np.abs(least)) < 2.0**52] = 0
    return least - slack, most + slack


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector) of rows with an id, a label and a vector of finite components.

    Of rows with one id one counts, that with the smallest label and vector. Vectors may
    differ in length: missing components are 0.
    """
    finite = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(column).isNotNull() & finite)
    row = F.struct(F.col(label).alias("label"), F.col(column).alias("vector"))
    return good.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(row).alias("r")).select("id", F.col("r.label").cast("long").alias("label"), "r.vector")


def _axes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, main axes and spread along them of at most SAMPLE_ROWS rows, chosen by a hash of the id."""
    turn = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = rows.where(turn <= F.lit(int((1 << 30) * min(1.0, 1.1 * SAMPLE_ROWS / max(rows.count(), 1)))))
    sample = [np.array(r["vector"], dtype=np.float64) for r in some.select("id", "vector").orderBy(turn, "id").limit(SAMPLE_ROWS).collect()]
    width = max((len(v) for v in sample), default=1) or 1
    x = np.zeros((max(len(sample), 1), width))
    for k, v in enumerate(sample):
        x[k, : len(v)] = v
    largest = np.abs(x).max(initial=0)
    x = x / largest if largest > 0 else x
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:AXES]
    spread = np.maximum((((x - mean) @ axes.T) ** 2).mean(axis=0) ** 0.5, 1e-12)
    return mean * (largest or 1), axes, spread * (largest or 1)


def blocks(rows: DataFrame, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Candidates in Parquet blocks: block, label, ids, values, width, low and high.

    Rows (id, label, vector) are sorted by label and place on the Hilbert curve, over the
    main axes in steps of an eighth of their spread, and cut into runs of one label.
    ``values`` holds the run's integer vectors, ``low`` and ``high`` (the zone map) their
    smallest and largest component in each dimension. Blocks have a bounded number of
    rows, and ranges of the curve go to tasks, so a label that most rows share is no
    group anywhere.
    """
    fitted = rows.sparkSession.sparkContext.broadcast(_axes(rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes, spread = fitted.value
        half = 1 << (BITS - 1)
        for batch in arrow_batches(batches):
            vectors = batch.column(2).to_pylist()
            x = np.zeros((len(vectors), len(mean)))
            for k, v in enumerate(vectors):
                x[k, : len(v)] = v[: len(mean)]
            steps = np.clip(np.floor((x - mean) @ axes.T / spread * 8) + half, 0, 2 * half - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_key(steps, BITS))], ["id", "label", "vector", "curve"])

    kind = rows.schema["vector"].dataType.simpleString()
    keyed = materialize(in_arrow(rows.select("id", "label", "vector"), place, f"id long, label long, vector {kind}, curve long"), "curve")
    ranges = keyed.repartitionByRange("label", "curve", "id").sortWithinPartitions("label", "curve", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[np.ndarray] = []
        of = size = 0

        def block() -> pa.RecordBatch:
            width = max(len(v) for v in held)
            x = _padded(held, width)
            columns = [[of], [ids], [x.astype("<i8").tobytes()], [width], [x.min(axis=0).tolist()], [x.max(axis=0).tolist()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["label", "ids", "values", "width", "low", "high"])

        for batch in arrow_batches(batches):
            for id_, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _integers(batch.column(2), scale), strict=True):
                if ids and (label != of or len(ids) == block_rows or size + len(v) > _BLOCK_VALUES):
                    yield block()
                    ids, held, size = [], [], 0
                of = label
                ids.append(id_)
                held.append(v)
                size += len(v)
        if ids:
            yield block()

    shape = "label long, ids array<long>, values binary, width int, low array<long>, high array<long>"
    made = in_arrow(ranges.select("id", "label", "vector"), cut, shape)
    return materialize(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _anchors(rows: DataFrame, asked: Column, scale: int) -> DataFrame:
    """(anchor_id, label, part, vector) with integer vectors, dealt to parts of about ANCHOR_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            values = pa.array([v.tolist() for v in _integers(batch.column(2), scale)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], values], ["anchor_id", "label", "vector"])

    made = materialize(in_arrow(rows.where(asked).select("id", "label", "vector"), run, "anchor_id long, label long, vector array<long>"), "anchors")
    parts = max(1, -(-made.count() // ANCHOR_ROWS))
    return made.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int"))


def _met(anchors: DataFrame, stored: DataFrame, same: bool) -> DataFrame:
    """(anchor_id, part, block, most) of blocks whose score bounds meet the anchor's ``floor`` and ``ceiling``, of its own label (``same``) or all others.

    Zone maps and anchors meet part by part, each pair of parts in one matrix product.
    """
    zone_parts = max(1, -(-stored.count() // ZONE_ROWS))
    parts = anchors.select("part").distinct()
    zones = stored.select("block", "label", "low", "high", F.pmod("block", F.lit(zone_parts)).cast("int").alias("zone"))
    left = anchors.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(zone_parts - 1))))
    each = parts.agg(F.sort_array(F.collect_list("part"))).first()[0]  # a number for each ANCHOR_ROWS anchors
    right = zones.withColumn("part", F.explode(F.array(*map(F.lit, each)))) if each else zones.withColumn("part", F.lit(0)).limit(0)

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = {"anchor_id": [], "part": [], "block": [], "most": []}
        if len(asked) and len(known):
            low, high = (_matrix(known[c]).astype(np.float64) for c in ("low", "high"))
            least, most = score_bounds(_matrix(asked["vector"]).astype(np.float64), low, high)
            fits = (known["label"].to_numpy()[None, :] == asked["label"].to_numpy()[:, None]) == same
            fits &= (most >= asked["floor"].to_numpy()[:, None]) & (least <= asked["ceiling"].to_numpy()[:, None])
            i, j = np.nonzero(fits)
            out = {"anchor_id": asked["anchor_id"].to_numpy()[i], "part": asked["part"].to_numpy()[i], "block": known["block"].to_numpy()[j], "most": most[i, j]}
        return pd.DataFrame(out).astype({"anchor_id": "int64", "part": "int32", "block": "int64", "most": "float64"})

    met = left.groupBy("part", "zone").cogroup(right.groupBy("part", "zone")).applyInPandas(run, "anchor_id long, part int, block long, most double")
    return materialize(met, "met")


def _matrix(column: pd.Series) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.int64) for v in column]
    return _padded(rows, max(1, max(map(len, rows))))


def _first_of(met: DataFrame, stored: DataFrame, rows: int) -> DataFrame:
    """For each anchor the block with the highest bound, one of at least ``rows`` rows if there is such."""
    sizes = stored.select("block", (F.size("ids") >= rows).alias("enough"))
    best = F.max_by("block", F.struct("enough", "most", -F.col("block")))
    return met.join(sizes, "block").groupBy("anchor_id", "part").agg(best.alias("block"))


def _read(asks: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each block for each of the windows that anchors ask of it.

    ``asks``: anchor_id, part, block, vector, and ``windows``, an array of (name, least,
    most). Returns anchor_id, name, id, score, at most k for each window and block; the
    anchor itself is left out.
    """
    wanted = stored.select("block", "ids", "values", "width").join(asks.select(F.col("block"), F.col("part").alias("part")).distinct(), "block")

    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(known):
            block = known.iloc[0]
            ids = np.asarray(block["ids"], dtype=np.int64)
            x = np.frombuffer(block["values"], dtype="<i8").reshape(len(ids), int(block["width"]))
            own = asked["anchor_id"].to_numpy()
            scores = dots(_matrix(asked["vector"]), x)
            for at in range(len(asked)):
                for window in asked["windows"].iloc[at]:
                    fits = np.flatnonzero((scores[at] >= window["least"]) & (scores[at] <= window["most"]) & (ids != own[at]))
                    if len(fits) > k:
                        found = scores[at, fits]
                        fits = fits[found >= np.partition(found, -k)[-k]]
                    order = fits[np.lexsort((ids[fits], -scores[at, fits]))][:k]
                    out += [(own[at], window["name"], i, s) for i, s in zip(ids[order].tolist(), scores[at, order].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "name", "id", "score"]).astype("int64")

    return asks.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInPandas(run, "anchor_id long, name long, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "name").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def _best(anchors: DataFrame, stored: DataFrame, *, same: bool, k: int) -> DataFrame:
    """anchor_id, name, id, score, rank: the ``k`` best rows in each of an anchor's ``windows``, from the blocks that its bounds allow.

    What the block with the highest bound gives first raises the floor of the windows
    that it fills; of the others only those whose bound reaches a floor are read.
    """
    limits = F.aggregate("windows", F.lit(None).cast("long"), lambda a, w: F.least(a, w["least"])), F.aggregate("windows", F.lit(None).cast("long"), lambda a, w: F.greatest(a, w["most"]))
    open_ = anchors.where(F.size("windows") > 0)
    met = _met(open_.withColumn("floor", limits[0].cast("double")).withColumn("ceiling", limits[1].cast("double")), stored, same)
    first = materialize(_first_of(met, stored, k + 1), "first")
    asked = open_.select("anchor_id", "vector", "windows")
    near = materialize(_read(first.join(asked, "anchor_id"), stored, k), "near")
    full = near.groupBy("anchor_id", "name").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    raised = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "least"))).alias("full"))
    now = F.transform("windows", lambda w: F.struct(w["name"].alias("name"), F.coalesce(F.element_at(F.coalesce("full", F.create_map().cast("map<bigint,bigint>")), w["name"]), w["least"]).alias("least"), w["most"].alias("most")))
    higher = asked.join(raised, "anchor_id", "left").select("anchor_id", "vector", now.alias("windows"))
    rest = met.join(first.select("anchor_id", "block"), ["anchor_id", "block"], "left_anti").join(higher, "anchor_id")
    rest = rest.where(F.exists("windows", lambda w: w["least"].cast("double") <= F.col("most"))).drop("most")
    return _top(near.unionByName(_read(rest, stored, k)), k)


def mine(
    vectors: DataFrame,
    asked: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    key: str = "vec_id",
    column: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row that ``asked`` selects (by ``id``).

    Vectors count as integers, floor(scale * component). An anchor's positives are the
    other rows of its label with the highest inner products, at most ``positives``; for
    each of them the rows of other labels that score ``least_percent`` to 100 hundredths
    of it are its negatives, the ``negatives`` highest first. Ties go to the smaller id.
    Nothing is approximate: a block is left out only if interval arithmetic on its zone
    map shows that no vector in it can enter a window. Rows without id or label, or with
    a null vector or component that is null or not finite, take no part; zero vectors do.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(usable(vectors, key, column, label), "vectors")
    stored = blocks(rows, scale, block_rows)
    anchors = _anchors(rows, asked, scale)
    window = lambda name, least, most: F.struct(F.lit(name).cast("long").alias("name") if isinstance(name, int) else name.alias("name"), least.alias("least"), most.alias("most"))
    any_ = window(0, F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long"))
    best = _best(anchors.withColumn("windows", F.array(any_)), stored, same=True, k=positives)
    best = materialize(best.select("anchor_id", F.col("rank").cast("long").alias("name"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # least_percent * p <= 100 * n <= 100 * p has no n for p < 0
    lowest = F.expr(f"positive_score div 100 * {least_percent} + (positive_score % 100 * {least_percent} + 99) div 100")
    asks = best.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(window(F.col("name"), lowest, F.col("positive_score"))).alias("windows"))
    found = _best(anchors.join(asks, "anchor_id"), stored, same=False, k=negatives)
    return found.join(best, ["anchor_id", "name"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
