"""Manifest, hard negatives and shards: brute force, invariants and odd rows."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from llm_rows import SF
from pyspark.sql import functions as F

from pageloom.llm import hard_negatives, manifest, numbering, queries, sharding
from pageloom.plans.shared import materialize, new_path


def plain_tree(leaves):
    """All levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha256("".join(x[i : i + 2]).encode()).hexdigest() for i in range(0, len(x), 2)])
    return levels


def plain_siblings(levels, i):
    out = []
    for x in levels[:-1]:
        if (i ^ 1) < len(x):
            out.append(x[i ^ 1])
        i //= 2
    return out


def plain_leaf(row, more=0):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    n = row["n_chars"]
    return sha256("".join(map(part, [row["doc_id"], row["source"], row["lang"], None if n is None else n + more, row["text"]])).encode()).hexdigest()


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    forest = plain_tree([trees[g][-1][0] for g in order])
    root = forest[-1][0]
    out = []
    for place, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = plain_siblings(trees[g], i) + plain_siblings(forest, place)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            out.append((r["doc_id"], leaf, trees[g][-1][0], root, sha256("".join(proof).encode()).hexdigest(), not bad))
    return Counter(out)


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 6, 7, 8, 12, 21, 64, 65, 100])
def test_positions_are_those_of_a_postorder_walk(leaves):
    levels = plain_tree([str(i) for i in range(leaves)])
    order = []

    def walk(level, index):
        if level:
            walk(level - 1, 2 * index)
            if 2 * index + 1 < len(levels[level - 1]):
                walk(level - 1, 2 * index + 1)
        order.append((level, index))

    walk(len(levels) - 1, 0)
    assert manifest.height(leaves) == len(levels) - 1
    assert [manifest.position(lv, i, leaves) for lv, i in order] == list(range(len(order)))


def test_complete_nodes_keep_their_place_as_the_log_grows():
    for n in range(1, 40):
        for level in range(4):
            for i in range(n >> level):
                assert manifest.position(level, i, n) == manifest.position(level, i, n + 13)


def verified(docs, levels=manifest.LEVELS):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered, manifest.leaf_digest(n_chars=F.col("n_chars") + 1))
    return manifest.verify(manifest.build(docs, claim=claim, span=levels))


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_against_a_plain_tree(few, documents, levels):
    docs = documents.limit(60) if levels < 10 else documents
    docs = materialize(docs, "docs")
    got = Counter((r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in verified(docs, levels).collect())
    assert got == plain_manifest([r.asDict() for r in docs.collect()])


def test_log_is_dense_and_in_completion_order(few, documents):
    made = manifest.build(documents, span=3)
    for grp, rows in groupby(made.log.collect(), "grp").items():
        rows.sort(key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(len(rows)))
        seen = set()
        for r in rows:
            below = {(r["level"] - 1, i) for i in (2 * r["index"], 2 * r["index"] + 1) if r["level"] and i << (r["level"] - 1) < r["leaves"]}
            assert below <= seen
            seen.add((r["level"], r["index"]))


def groupby(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_proofs_lead_to_the_root(few, documents):
    made = manifest.build(documents)
    for r in manifest.proofs(made).collect():
        assert manifest.fold(r["leaf"], list(r["path"])) == made.root


def test_manifest_odd_rows(few, edge, empty):
    got = Counter((r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in verified(edge).collect())
    assert got == plain_manifest([r.asDict() for r in edge.collect()])
    assert verified(empty).count() == 0
    one = edge.where("doc_id = 4")
    (row,) = verified(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == sha256(b"").hexdigest()
    same = materialize(edge.where("doc_id = 8").limit(1).crossJoin(few.range(300).select(F.lit(1).alias("x"))).drop("x"), "same")
    got = Counter((r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in verified(same).collect())
    assert got == plain_manifest([r.asDict() for r in same.collect()])


def test_a_changed_row_or_order_changes_the_root(few, documents):
    some = documents.limit(20)
    assert manifest.build(some).root != manifest.build(some.withColumn("text", F.concat("text", F.lit(" ")))).root


def test_numbered_ranges(few):
    rows = materialize(few.range(0, 5000, numPartitions=7).select((F.col("id") % 3).alias("g"), (F.col("id") % 11).alias("o"), "id"), "rows")
    got = groupby(numbering.numbered(rows, ["g"], ["o"], "place", "size").collect(), "g")
    for rows_ in got.values():
        rows_.sort(key=lambda r: r["place"])
        assert [r["place"] for r in rows_] == list(range(rows_[0]["size"]))
        assert [r["o"] for r in rows_] == sorted(r["o"] for r in rows_)


def plain_negatives(rows, positives=5, negatives=5):
    """Rows (vec_id, label, vector), mined by comparing everything."""
    ints = {i: (lb, [int(np.floor(256 * float(x))) for x in v]) for i, lb, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in ints.items():
        if a % 100:
            continue
        scored = sorted(((-dot(v, w), i, lb) for i, (lb, w) in ints.items() if i != a))
        for p, pos, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, pos, k, i, -p, -n) for k, (n, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(table, **kw):
    got = hard_negatives.mine(table, F.col("id") % 100 == 0, **kw).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def test_hard_negatives_clustered_small_blocks(few, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ZONE_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 10))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 6] + 0.2 * rng.normal(size=10)).tolist()) for i in range(900)]
    rows[50:90] = [(i, i % 3, rows[50][2]) for i in range(50, 90)]  # ties
    table = few.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(table, block_rows=8) == plain_negatives(rows)


def test_hard_negatives_odd_rows(few):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (200, 2, [0.0, 0.0]), (3, 2, [0.9, 0.4]), (4, 2, [0.9, 0.4]), (5, 1, [-1.0, -1.0]), (6, 3, [0.95, 0.5, 7.0]), (7, 2, [2.0**40, 1.0]), (8, 1, [2.0**40, 0.0])]
    odd = [(9, None, [1.0, 1.0]), (10, 2, None), (11, 2, [1.0, nan]), (12, 2, [inf, 1.0]), (13, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (14, 3, [])]
    schema = "vec_id long, label int, embedding array<double>, id string, block string, part string, values string"
    table = few.createDataFrame([(*r, *"abcd") for r in [*rows, *odd, rows[3]]], schema)
    assert mined(table) == plain_negatives([*rows, (14, 3, [])])
    assert mined(table.limit(0)) == []
    assert mined(table.where("vec_id = 0")) == []


def test_bounds_hold_every_inner_product():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, a = rng.integers(-300, 300, (20, 7)), rng.integers(-300, 300, (4, 7))
        least, most = hard_negatives.score_bounds(a.astype(float), x.min(axis=0)[None, :].astype(float), x.max(axis=0)[None, :].astype(float))
        scores = hard_negatives.dots(a, x)
        assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()
    big = np.array([[2**40, 3]])
    assert hard_negatives.dots(big, np.array([[2**20, 1]])).tolist() == [[2**60 + 3]]


@pytest.mark.parametrize(("axes", "bits"), [(2, 1), (2, 4), (3, 3), (5, 2)])
def test_the_curve_meets_every_cell_once_and_moves_one_step(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    key = hard_negatives.hilbert_key(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_blocks_are_bounded_and_their_zones_true(few):
    rows = hard_negatives.usable(few.read.parquet(f"{SF}/embeddings.parquet"))
    made = hard_negatives.blocks(rows, block_rows=50).collect()
    assert sum(len(b["ids"]) for b in made) == rows.count()
    for b in made:
        x = np.frombuffer(b["values"], "<i8").reshape(len(b["ids"]), b["width"])
        assert len(b["ids"]) <= 50 and x.min(axis=0).tolist() == list(b["low"]) and x.max(axis=0).tolist() == list(b["high"])


def check_shards(docs, shards=8, slack=None):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sharding.shard(docs, shards=shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    total = Counter()
    for s, part in groupby(got, "shard").items():
        assert 0 <= s < shards and sorted(r["slot"] for r in part) == list(range(len(part)))
        total[s] = sum(r["size"] for r in part)
    slots = Counter()
    for r in got:
        slots[r["virtual_slot"]] += r["size"]
    if got and slack is not None:
        assert max(total.values()) - min(total.get(s, 0) for s in range(shards)) <= slack
    return got, slots


def test_shards_are_even_and_whole(few, documents):
    check_shards(documents, slack=1000)
    check_shards(documents, shards=3, slack=200)


def test_shards_of_many_equal_rows(few):
    same = few.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text many times").alias("text"))
    got, slots = check_shards(same, slack=100)
    assert max(slots.values()) < 20 * 20
    one_id = few.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    check_shards(one_id, slack=100)


def test_shards_odd_rows(few, edge, empty):
    got, _ = check_shards(edge)
    assert next(r for r in got if r["doc_id"] == 1)["size"] == 1
    assert sharding.shard(empty).count() == 0


def test_map_edits_move_little(few):
    rng = np.random.default_rng(9)
    load = rng.lognormal(8, 1.5, 4096).astype(np.int64)
    first = sharding.edited(sharding.first_map(8), load, 8)
    total = np.bincount(first, weights=load)
    assert total.max() - total.min() <= 4
    grown = sharding.edited(first, load, 9)
    assert load[(grown != first) & (grown == 8)].sum() > 0.5 * load[grown != first].sum()
    assert np.ptp(np.bincount(grown, weights=load)) <= 0.001 * load.sum() / 9
    moved = load[grown != first].sum()
    assert moved < 2 * load.sum() / 9
    assert (sharding.edited(first, load, 8) == first).all()
    less = sharding.edited(grown, load, 7)
    assert set(less) == set(range(7))
    more = load.copy()
    more[:40] *= 3
    assert (sharding.edited(first, more, 8) != first).mean() < 0.2


def test_stored_maps_are_kept_by_version(few):
    place = new_path(few, "slots")
    load = np.ones(16, dtype=np.int64)
    one = sharding.store(few, place, 1, sharding.first_map(4, 16), load)
    assert [r["shard"] for r in one.orderBy("virtual_slot").collect()] == list(sharding.first_map(4, 16))
    sharding.store(few, place, 2, sharding.edited(sharding.first_map(4, 16), load, 5), load)
    with pytest.raises(Exception, match="exist"):
        sharding.store(few, place, 1, sharding.first_map(4, 16), load)
    assert sharding.stored(few, place, 2).where("shard = 4").count() == 3


def test_queries_have_their_columns(few):
    got = queries.QUERIES["op13_virtual_slot_shards"](few, SF)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(got.dtypes)["slot"] == "bigint" and dict(got.dtypes)["grown_shard"] == "int"
