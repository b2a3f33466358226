"""Fixity audit of web archives: hash trees over ordered record ranges, compared from the root down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pageloom.plans.shared import materialize

#: Children of a node, records keys of a lowest range, and keys of one archive file.
FANOUT = 16
FILE_KEYS = 1_000


def record(url: Column, page_id: Column, html: Column) -> Column:
    """A page as an archive record: header lines, an empty line, the payload, and the end."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def _down(x: Column, by: int) -> Column:
    return ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def digests(pages: DataFrame) -> DataFrame:
    """page_id, key, file_no, offset, length, sha256, copies of the records of (page_id, url, html).

    Records lie in files by ranges of their key, in key order; the key is page_id, or a
    hash of the record where there is none. Equal records count as one with copies, so
    repeated rows never meet in one task; only digests are shuffled, never payloads.
    """
    text = record(F.col("url").cast("string"), F.col("page_id"), F.col("html"))
    hashed = pages.select(F.col("page_id").cast("long"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("sha256"))
    one = hashed.groupBy("page_id", "length", "sha256").agg(F.count("*").alias("copies"))
    key = F.coalesce("page_id", F.pmod(F.xxhash64("sha256"), F.lit(1 << 31)))
    placed = one.withColumn("key", key).withColumn("file_no", _down(F.col("key"), FILE_KEYS))
    before = Window.partitionBy("file_no").orderBy("key", "sha256").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("length") * F.col("copies")).over(before)
    return placed.withColumn("offset", (end - F.col("length") * F.col("copies")).cast("long"))


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """(node, parent, hash) of every level, lowest first; the last has one node.

    A lowest node hashes the records of FANOUT keys in order, a higher one its children.
    """
    listed = lambda *parts: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), ","), 256)
    out = []
    made = records.groupBy(_down(F.col("key"), FANOUT).alias("node")).agg(listed("key", "sha256", "copies").alias("hash"))
    for level in range(levels):
        parent = _down(F.col("node"), FANOUT) if level < levels - 1 else F.lit(0).cast("long")
        out.append(materialize(made.select("node", parent.alias("parent"), "hash"), "level"))
        made = out[-1].groupBy(F.col("parent").alias("node")).agg(listed("node", "hash").alias("hash"))
    return [*out, materialize(made.select("node", F.lit(None).cast("long").alias("parent"), "hash"), "level")]


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = (x.select("node", F.col("hash").alias(name)) for x, name in ((left, "a"), (right, "b")))
    return a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, status, file_no, offset, length, primary_sha256, replica_sha256 of every record that differs.

    Both sides are pages (page_id, url, html). Their trees are compared at the root;
    below, only children of nodes that differ are read, down to the ranges whose records
    are then compared. Status: ``corrupt`` (the page_id is there with another content),
    ``missing`` or ``extra`` in the replica, ``copies`` (repeated another number of
    times). Place and length are those of the side that has the record, first the
    primary. Null html is an empty payload; equal or empty replicas give no rows.
    """
    sides = [materialize(digests(x), "digests") for x in (primary, replica)]
    top = max(abs(v) for x in sides for v in (x.agg(F.min("key"), F.max("key")).first() or ()) if v is not None) if any(not x.isEmpty() for x in sides) else 0
    levels = 1
    while FANOUT ** (levels + 1) <= top:
        levels += 1
    left, right = (tree(x, levels) for x in sides)
    open_ = _apart(left[-1], right[-1])
    for level in range(levels - 1, -1, -1):
        at = open_.select(F.col("node").alias("parent"))
        open_ = materialize(_apart(*(x[level].join(at, "parent", "left_semi") for x in (left, right))), "apart")
    name = lambda x, side: x.withColumn("node", _down(F.col("key"), FANOUT)).join(open_, "node", "left_semi").select(
        "key", "sha256", *[F.col(c).alias(f"{side}_{c}") for c in ("page_id", "file_no", "offset", "length", "copies")]
    )
    both = name(sides[0], "p").join(name(sides[1], "r"), ["key", "sha256"], "full_outer")
    changed = both.where(~F.col("p_copies").eqNullSafe(F.col("r_copies")))
    pick = lambda c: F.coalesce(f"p_{c}", f"r_{c}")
    rows = changed.select(
        F.col("key"), pick("page_id").alias("page_id"), pick("file_no").alias("file_no"), pick("offset").alias("offset"), pick("length").alias("length"),
        F.when(F.col("p_copies").isNotNull(), F.col("sha256")).alias("primary_sha256"), F.when(F.col("r_copies").isNotNull(), F.col("sha256")).alias("replica_sha256"),
    )
    equal = rows.where("primary_sha256 = replica_sha256").withColumn("status", F.lit("copies"))
    lost, found = rows.where("replica_sha256 is null"), rows.where("primary_sha256 is null")
    # several contents under one id pair off in the order of their hashes
    turn = Window.partitionBy("key", "page_id").orderBy(F.coalesce("primary_sha256", "replica_sha256"))
    lost, found = (x.withColumn("turn", F.row_number().over(turn)) for x in (lost, found))
    other = found.select("key", F.col("page_id").alias("r_id"), "turn", F.col("file_no").alias("r_file"), F.col("offset").alias("r_offset"), F.col("length").alias("r_length"), F.col("replica_sha256").alias("r_sha"))
    met = lost.join(other, (lost["key"] == other["key"]) & lost["page_id"].eqNullSafe(other["r_id"]) & (lost["turn"] == other["turn"]), "full_outer")
    status = F.when(F.col("r_sha").isNull(), "missing").when(F.col("primary_sha256").isNull(), "extra").otherwise("corrupt")
    apart = met.select(
        F.coalesce(lost["page_id"], "r_id").alias("page_id"), status.alias("status"), F.coalesce(lost["file_no"], "r_file").alias("file_no"),
        F.coalesce(lost["offset"], "r_offset").alias("offset"), F.coalesce(lost["length"], "r_length").alias("length"), "primary_sha256", F.col("r_sha").alias("replica_sha256"),
    )
    return apart.unionByName(equal.select(apart.columns))
