"""Object graphs: inheritance, trust, names, reachability, duplicates, first-page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.plans.graph import climb, reachable, smallest_label, walk_chain
from pageloom.plans.scan import Running, running
from pageloom.plans.shared import materialize

#: Fixed value: links a chain of issuers may have.
ISSUERS = 10


def inherit(nodes: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Every node with each missing attribute taken from its nearest ancestor that has it."""
    return climb(
        nodes.select(*keys, "id", F.col("parent").alias("up"), *attributes),
        keys,
        lambda near, far: {a: F.coalesce(near(a), far(a)) for a in attributes},
    ).drop("up")


def trust_chain(certificates: DataFrame) -> DataFrame:
    """Follow issuers to a trusted root: id, trusted, stopped_at, links.

    ``certificates``: id, issuer, root. At most ten links count; a certificate is not its
    own issuer; an issuer that is not listed ends the walk.
    """
    known = certificates.select(F.col("id").alias("issuer"), F.lit(True).alias("__listed"))
    up = F.when(~F.col("root") & (F.col("issuer") != F.col("id")) & F.col("__listed"), F.col("issuer"))
    nodes = certificates.join(known, "issuer", "left").select(
        "id", up.alias("up"), F.col("root").alias("trusted"), F.col("id").alias("stopped_at"), F.lit(0).alias("links"), F.when(up.isNotNull(), 1).otherwise(0).alias("__hop")
    )
    walked = climb(
        nodes.select("id", "up", "trusted", "stopped_at", F.col("__hop").alias("links")),
        [],
        lambda near, far: {
            "trusted": far("trusted"),
            "stopped_at": far("stopped_at"),
            "links": near("links") + far("links"),
        },
        max_depth=16,
    )
    ended = F.col("up").isNull() & (F.col("links") <= ISSUERS)
    return walked.select(
        "id",
        (ended & F.col("trusted")).alias("trusted"),
        F.when(ended, F.col("stopped_at")).alias("stopped_at"),
        F.when(ended & F.col("trusted"), F.lit("trusted")).when(ended, F.lit("no trusted issuer")).otherwise(F.lit("chain too long")).alias("outcome"),
    )


def qualified_names(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Dotted full names; a nameless node and what hangs below it is no field; the first of a name wins.

    ``fields``: keys + (id, parent, name, ord).
    """
    nodes = fields.select(
        *keys, "id", F.col("parent").alias("up"), F.col("name"), F.col("name").isNotNull().alias("ok"), F.lit(1).alias("depth"), "ord"
    )
    named = climb(
        nodes,
        keys,
        lambda near, far: {
            "name": F.concat_ws(".", far("name"), near("name")),
            "ok": near("ok") & far("ok"),
            "depth": near("depth") + far("depth"),
        },
    )
    return (
        named.filter(F.col("ok") & F.col("up").isNull())
        .groupBy(*keys, F.col("name").alias("qualified"))
        .agg(F.min_by("id", "ord").alias("id"))
    )


def prune(objects: DataFrame, refs: DataFrame, roots: DataFrame, keys: list[str], *, width: int | None = None) -> DataFrame:
    """Objects reachable from the roots with new numbers in id order.

    ``objects``: keys + (id, num, size). Empty objects go first, with the links into them.
    """
    alive = objects.filter(F.col("size") > 0)
    usable = refs.join(alive.select(*keys, F.col("id").alias("dst")), [*keys, "dst"], "left_semi")
    kept = alive.join(reachable(usable, roots, keys).select(*keys, "id"), [*keys, "id"], "left_semi")
    return running(kept, keys, "num", {"new_id": Running("sum", F.lit(1))}, width=width).select(*keys, "id", "new_id")


def _digest(content: Column, attributes: list[str] | None) -> Column:
    if not attributes:
        return F.sha2(content.cast("binary"), 256)
    return F.sha2(F.concat(F.to_json(F.struct(*attributes)), F.lit("\n"), F.sha2(content.cast("binary"), 256)).cast("binary"), 256)


def exact_copies(objects: DataFrame, keys: list[str], content: Column, *, attributes: list[str] | None = None) -> DataFrame:
    """Canonical id (the lowest) of every object: keys + (id, canonical).

    Copies have the same content and, where ``attributes`` names columns, the same values in them.

    Contents are hashed once, and only groups of several are joined back: both sides of
    that join are written tables, so a hash that most objects share is split.
    """
    hashed = objects.select(*keys, "id", _digest(content, attributes).alias("__h"), F.octet_length(content).alias("__n"))
    marked = materialize(hashed, "hashes")
    groups = marked.groupBy(*keys, "__h", "__n").agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("__m"))
    first = materialize(groups.filter("__m > 1").drop("__m"), "copies")
    return marked.join(first, [*keys, "__h", "__n"], "left").select(*keys, "id", F.coalesce("canonical", "id").alias("canonical"))


def rewrite_refs(refs: DataFrame, copies: DataFrame, keys: list[str]) -> DataFrame:
    """Point every reference at the canonical copy of its target."""
    named = copies.select(*keys, F.col("id").alias("dst"), "canonical")
    return refs.join(named, [*keys, "dst"], "left").select(
        *keys, "src", F.coalesce("canonical", "dst").alias("dst"), (F.col("canonical") != F.col("dst")).alias("moved")
    )


def optimize_report(objects: DataFrame, key: str, content: Column, *, level: str = "full", reachable_ids: DataFrame | None = None) -> DataFrame:
    """Bytes before and after, and objects removed, per document.

    Level ``safe`` drops empty objects, and unreachable ones where ``reachable_ids``
    (id) is given; ``full`` merges exact copies as well.
    """
    if level not in ("safe", "full"):
        raise ValueError(f"InvalidLevel: {level}")
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    sized = objects.select(F.col(key), "id", size.alias("__size"), F.sha2(content.cast("binary"), 256).alias("__h"))
    if reachable_ids is None:
        sized = sized.withColumn("__kept", F.lit(True))
    else:
        known = reachable_ids.select("id", F.lit(True).alias("__kept")).distinct()
        sized = sized.join(known, "id", "left").withColumn("__kept", F.coalesce("__kept", F.lit(False)))
    one = F.col("__h") if level == "full" else F.concat_ws(":", "__h", F.when(F.col("__kept"), F.col("id").cast("string")))
    distinct = sized.groupBy(key, "__kept", one.alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.max("__size").alias("size"))
    kept = F.col("__kept") & (F.col("size") > 0)
    before, after = F.sum(F.col("copies") * F.col("size")), F.sum(F.when(kept, F.col("size")).otherwise(0))
    return distinct.groupBy(key).agg(
        before.alias("bytes_before"),
        after.alias("bytes_after"),
        F.greatest(before - after, F.lit(0)).alias("bytes_saved"),
        F.round(F.when(before == 0, 0.0).otherwise(F.greatest(before - after, F.lit(0)) / before), 4).alias("ratio"),
        F.sum(F.when(kept, F.col("copies") - 1).otherwise(F.col("copies"))).alias("objects_removed"),
        F.sum(F.when(kept, F.col("copies") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(~F.col("__kept"), F.col("copies")).otherwise(0)).alias("unreachable"),
    )


def articles(threads: DataFrame, beads: DataFrame) -> DataFrame:
    """Bead count around each chain and the page of its first bead.

    ``threads``: doc_id, thread_id, title, first_bead; ``beads``: doc_id, node, next, page.
    """
    heads = threads.select("doc_id", "thread_id", F.col("first_bead").alias("node"))
    counts = walk_chain(beads, heads, ["doc_id"], ["thread_id"]).groupBy("doc_id", "thread_id").agg(F.count(F.lit(1)).alias("beads"))
    first = beads.select("doc_id", F.col("node").alias("first_bead"), F.col("page").alias("first_page"))
    return (
        threads.join(counts, ["doc_id", "thread_id"])
        .join(first, ["doc_id", "first_bead"], "left")
        .select(
            "doc_id",
            "thread_id",
            F.coalesce("title", F.lit("Untitled")).alias("title"),
            "beads",
            "first_page",
        )
    )


def first_page_order(objects: DataFrame, refs: DataFrame, pages: DataFrame, keys: list[str], *, width: int | None = None) -> DataFrame:
    """Write order: what page one needs, then each later page's own objects, then the rest.

    ``objects``: keys + (id, num); ``pages``: keys + (id, page_no). The first page to reach
    an object claims it. Positions are a running count per claimer plus the sizes of
    earlier claimers, so the whole order is never sorted in one task.
    """
    claims = smallest_label(refs, pages.select(*keys, "id", F.col("page_no").alias("label")), keys)
    rest = F.lit(1 << 40).cast("long")
    placed = (
        objects.join(claims, [*keys, "id"], "left")
        .join(pages.select(*keys, "id", F.lit(True).alias("__page")), [*keys, "id"], "left")
        .select(
            *keys,
            "id",
            F.coalesce(F.col("label").cast("long"), rest).alias("claimer"),
            F.when(F.col("__page"), F.lit(0).cast("long")).otherwise(F.col("num") + 1).alias("__num"),
        )
    )
    inside = running(placed, [*keys, "claimer"], "__num", {"__i": Running("sum", F.lit(1))}, width=width)
    sizes = placed.groupBy(*keys, "claimer").agg(F.count(F.lit(1)).alias("__n"))
    ahead = running(sizes, keys, "claimer", {"__before": Running("sum", F.col("__n"), inclusive=False)}, width=width)
    return inside.join(ahead.select(*keys, "claimer", "__before"), [*keys, "claimer"]).select(
        *keys, "id", F.nullif(F.col("claimer"), rest).alias("claimed_by"), (F.col("__before") + F.col("__i")).alias("pos")
    )
