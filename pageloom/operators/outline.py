"""Outlines as flat rows: tree facts by windows, destinations by joins, edits by arithmetic."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.plans.graph import climb
from pageloom.plans.scan import Running, expand, running
from pageloom.plans.shared import materialize, with_package


#: Items scanned as one array; blocks of a document in one group; nothing in the plan depends on levels.
BLOCK = 256
GROUP = 1024


_ENTRIES = "array<struct<level:int,seq:int>>"


def _above(stack: str, level: str, *, ties: bool = False) -> str:
    """Expression: the item of the nearest entry of a stack with a lower level (or an equal one, with ``ties``), or null."""
    return f"try_element_at(filter({stack}, e -> e.level {'<=' if ties else '<'} {level}), -1).seq"


def _onto(far: str, near: str) -> str:
    """Expression: the stack of a stretch from those of its two parts. What no entry of the nearer part hides stays."""
    return f"if(size({near}) = 0, {far}, concat(filter({far}, f -> f.level < {near}[0].level), {near}))"


def _scan(items: str, *, ties: bool) -> str:
    """Expression: (out, stack) of an array of items; for each the nearest lower one, how many there are, and the lowest level so far."""
    under = "filter(s.stack, e -> e.level < x.level)"
    out = f"named_struct('near', {_above('s.stack', 'x.level', ties=ties)}, 'open', size({under}), 'low', int(least(get(s.stack, 0).level, x.level)))"
    start = f"named_struct('out', cast(array() AS array<struct<near:int,open:int,low:int>>), 'stack', cast(array() AS {_ENTRIES}))"
    step = f"named_struct('out', array_append(s.out, {out}), 'stack', array_append({under}, named_struct('level', int(x.level), 'seq', int(x.seq))))"
    return f"aggregate({items}, {start}, (s, x) -> {step})"


def _merged(held: str) -> str:
    """Expression: (out, stack) of an array of stacks; for each what those before it come to, and what all of them do."""
    start = f"named_struct('out', cast(array() AS array<{_ENTRIES}>), 'stack', cast(array() AS {_ENTRIES}))"
    return f"aggregate({held}, {start}, (s, x) -> named_struct('out', array_append(s.out, s.stack), 'stack', {_onto('s.stack', 'x')}))"


def _carried(stacks: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows of ``stacks`` (keys, order, fore, rear, last) as one array for each group, with both merged stacks.

    A group is one array, so callers keep groups bounded.
    """
    held = F.expr(f"sort_array(collect_list(struct({order}, fore, rear, last))) AS held")
    grouped = stacks.groupBy(*keys).agg(held, F.max("last").alias("last"))
    return grouped.selectExpr(*keys, "held", "last", f"{_merged('held.fore')} AS ahead", f"{_merged('reverse(held.rear)')} AS behind")


def outline_tree(items: DataFrame, *, block: int = BLOCK, group: int = GROUP, width: int | None = None) -> DataFrame:
    """Parent, depth, sibling rank and descendant count of level-tagged items.

    ``items``: doc_id, seq (from 1, no gaps), level from 1, title, page. ``idx`` is the
    pre-order number from 0. A parent is the nearest earlier item of a lower level, a
    subtree ends before the nearest later item of the same level or a lower one. Both are
    found by stacks of rising levels: blocks of consecutive items are scanned alone, the
    stacks they leave are merged over groups of blocks and over groups, and each block
    gets the merged stack of what lies before and after it. A stack holds each level
    once; the plan is the same for any number of levels, and nothing runs beforehand.
    """
    tagged = items.withColumn("__block", F.floor((F.col("seq") - 1) / F.lit(block)).cast("long"))
    blocks = tagged.groupBy("doc_id", "__block").agg(F.expr("sort_array(collect_list(struct(seq, level, title, page))) AS items"))
    blocks = blocks.selectExpr("doc_id", "__block", "items", f"{_scan('items', ties=False)} AS fore", f"{_scan('reverse(items)', ties=True)} AS back")

    # a first block that is not full is its whole document
    ends = blocks.filter(f"__block > 0 or size(items) = {block}").selectExpr(
        "doc_id", "__block", f"__block div {group} AS __group", "fore.stack AS fore", "back.stack AS rear", "element_at(items, -1).seq AS last"
    )
    groups = _carried(ends, "__block", ["doc_id", "__group"])
    whole = _carried(groups.selectExpr("doc_id", "__group", "ahead.stack AS fore", "behind.stack AS rear", "last"), "__group", ["doc_id"])
    far = whole.selectExpr("doc_id", "last AS __last", "inline(arrays_zip(held.__group, ahead.out, reverse(behind.out))) AS (__group, __a, __b)")
    near = groups.selectExpr("doc_id", "__group", "inline(arrays_zip(held.__block, ahead.out, reverse(behind.out))) AS (__block, __c, __d)")
    carry = near.join(far, ["doc_id", "__group"]).selectExpr("doc_id", "__block", "__last", f"{_onto('__a', '__c')} AS __before", f"{_onto('__b', '__d')} AS __after")
    none = f"cast(array() AS {_ENTRIES})"
    flat = blocks.join(carry, ["doc_id", "__block"], "left").selectExpr(
        "doc_id",
        f"coalesce(__before, {none}) AS __before",
        f"coalesce(__after, {none}) AS __after",
        "coalesce(__last, element_at(items, -1).seq) AS __last",
        "inline(arrays_zip(items, fore.out, reverse(back.out))) AS (x, f, b)",
    )
    tree = flat.selectExpr(
        "doc_id",
        "x.seq - 1 AS idx",
        "x.level AS level",
        "x.title AS title",
        "x.page AS page",
        f"int(coalesce(f.near, {_above('__before', 'x.level')}) - 1) AS parent",
        "int(size(filter(__before, e -> e.level < f.low)) + f.open + 1) AS depth",
        f"int(coalesce(b.near, {_above('__after', 'x.level', ties=True)}, __last + 1) - x.seq - 1) AS descendants",
    )
    ranked = running(
        tree.withColumn("__parent", F.coalesce("parent", F.lit(-1))),
        ["doc_id", "__parent"],
        "idx",
        {"sibling": Running("sum", F.lit(1))},
        width=width,
    )
    return ranked.drop("__parent").withColumn("sibling", F.col("sibling").cast("int"))


class _Replay:
    """A document's outline as parts of (depth, level, source) columns, edited in place.

    ``source`` is the item's number before all edits, or -1 - k for what the k-th edit
    added. Edits cut parts and look only at the lowest depth of those they pass, so an
    edit costs about the number of parts plus one part's items.
    """

    SIZE = 1024

    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts = parts
        self.settle()

    def settle(self) -> None:
        whole = np.concatenate(self.parts, axis=1) if self.parts else np.empty((3, 0), np.int64)
        self.parts = [whole[:, i : i + self.SIZE] for i in range(0, whole.shape[1], self.SIZE)]
        self.low = [int(p[0].min()) for p in self.parts]
        self.size, self.most = whole.shape[1], 4 * len(self.parts) + 64

    def at(self, index: int) -> np.ndarray:
        for part in self.parts:
            if index < part.shape[1]:
                return part[:, index]
            index -= part.shape[1]
        raise IndexError(index)

    def end(self, index: int, depth: int) -> int:
        """The next item no deeper than ``depth`` after ``index``, or the end."""
        start = 0
        for part, low in zip(self.parts, self.low, strict=True):
            stop = start + part.shape[1]
            if stop > index + 1 and low <= depth:
                skip = max(index + 1 - start, 0)
                hits = np.flatnonzero(part[0, skip:] <= depth)
                if len(hits):
                    return start + skip + int(hits[0])
            start = stop
        return self.size

    def before(self, index: int, depth: int) -> int | None:
        """The last item no deeper than ``depth`` before ``index``."""
        stop = self.size
        for part, low in zip(reversed(self.parts), reversed(self.low), strict=True):
            start = stop - part.shape[1]
            if start < index and low <= depth:
                hits = np.flatnonzero(part[0, : index - start] <= depth)
                if len(hits):
                    return start + int(hits[-1])
            stop = start
        return None

    def split(self, at: int) -> int:
        """The number of the part that begins at ``at``."""
        for k, part in enumerate(self.parts):
            if at < part.shape[1]:
                if at:
                    self.parts[k : k + 1] = [part[:, :at], part[:, at:]]
                    self.low[k : k + 1] = [int(part[0, :at].min()), int(part[0, at:].min())]
                    return k + 1
                return k
            at -= part.shape[1]
        return len(self.parts)

    def cut(self, start: int, stop: int) -> list[np.ndarray]:
        a, b = self.split(start), self.split(stop)
        out = self.parts[a:b]
        del self.parts[a:b], self.low[a:b]
        self.size -= stop - start
        return out

    def put(self, at: int, parts: list[np.ndarray]) -> None:
        k = self.split(at)
        self.parts[k:k] = parts
        self.low[k:k] = [int(p[0].min()) for p in parts]
        self.size += sum(p.shape[1] for p in parts)
        if len(self.parts) > self.most:
            self.settle()

    def apply(self, number: int, op: str | None, target: int | None) -> tuple[bool, str | None]:
        """(whether anything changed, the error)."""
        if op not in ("add", "remove", "up", "down"):
            return False, "InvalidEdit"
        index = -1 if target is None else target - 1 if op == "add" else target
        if op == "add" and target == 0:
            self.put(self.size, [np.array([[1], [1], [-1 - number]], dtype=np.int64)])
            return True, None
        if not 0 <= index < self.size:
            return False, "NoSuchBookmark"
        depth, level, _ = self.at(index).tolist()
        end = self.end(index, depth)
        if op == "add":
            self.put(end, [np.array([[depth + 1], [level + 1], [-1 - number]], dtype=np.int64)])
        elif op == "remove":
            self.cut(index, end)
        else:
            other = self.before(index, depth) if op == "up" else end if end < self.size else None
            if other is None or self.at(other)[0] != depth:
                return False, None
            if op == "up":
                self.put(other, self.cut(index, end))
            else:
                self.put(index, self.cut(other, self.end(other, depth)))
        return True, None

    def runs(self) -> list[tuple[int, int, int, int, int]]:
        """(start, source, length, depth, level): stretches of consecutive old items, and new items alone."""
        whole = np.concatenate(self.parts, axis=1) if self.parts else np.empty((3, 0), np.int64)
        source = whole[2]
        if not len(source):
            return []
        before = np.concatenate([[-1], source[:-1]])
        fresh = np.flatnonzero((source != before + 1) | (source < 0) | (before < 0))
        stops = np.append(fresh[1:], len(source))
        return [(int(a), int(source[a]), int(b - a), int(whole[0, a]), int(whole[1, a])) for a, b in zip(fresh, stops, strict=True)]


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents one after the other: their blocks, then their edits in order, to runs of items and outcomes of edits."""
    names = ["doc_id", "step", "start", "source", "length", "depth", "level", "title", "page", "changed", "error"]
    kinds: list[pa.DataType] = []
    doc, parts, outline, edits, out = None, [], None, [], []

    def close() -> None:
        if outline is None:
            return
        for start, source, length, depth, level in outline.runs():
            title, page = edits[-1 - source] if source < 0 else (None, None)
            out.append((doc, None, start, source, length, depth, level, title, page, None, None))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
        for row in batch.to_pylist():
            if row["doc_id"] != doc:
                close()
                doc, parts, outline, edits = row["doc_id"], [], None, []
            if row["depths"] is not None:
                source = np.arange(row["first"], row["first"] + len(row["depths"]))
                parts.append(np.array([row["depths"], row["levels"], source], dtype=np.int64))
                continue
            if outline is None:
                outline, parts = _Replay(parts), []
            edits.append((row["title"], row["page"]))
            changed, error = (False, row["error"]) if row["error"] else outline.apply(len(edits) - 1, row["op"], row["target"])
            out.append((doc, row["step"], None, None, None, None, None, None, None, changed, error))
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    close()
    if out:
        yield batch_of(out)


def outline_edit(tree: DataFrame, edits: DataFrame, *, docs: DataFrame | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Replay any number of edits of each outline in order: (items, outcomes).

    ``edits``: doc_id, step (their order), op, target, title, page. Targets are pre-order
    numbers in the outline as earlier edits left it: ``add`` appends an item at the end of
    the children of item target - 1 (0: at the top level), ``remove`` takes the item with
    all under it, ``up`` and ``down`` swap it with the sibling before or after. An edit
    that cannot be done (NoSuchBookmark, InvalidEdit, or PageOutOfRange if ``docs`` has
    page counts) is refused alone; the next one meets the outline unchanged.

    ``items``: doc_id, idx, level, depth, title, page of all documents, edited or not;
    ``outcomes``: doc_id, step, changed, error of every edit. Only depths and levels of
    edited documents, packed by blocks, pass through the replay, and what leaves it are
    runs of items that stay together; titles are joined to those afterwards.
    """
    page = F.col("page").cast("long")
    edits = edits.filter(F.col("doc_id").isNotNull())
    asked = edits.select("doc_id", F.col("step").cast("long").alias("step"), "op", F.col("target").cast("long").alias("target"), F.col("title").cast("string").alias("title"), page.alias("page"))
    if docs is None:
        asked = asked.withColumn("error", F.lit(None).cast("string"))
    else:
        asked = asked.join(docs.select("doc_id", F.col("page_count").alias("__n")), "doc_id", "left")
        outside = (F.col("op") == "add") & ~F.coalesce(F.col("page").between(1, F.col("__n")), F.lit(False))
        asked = asked.withColumn("error", F.when(outside, "PageOutOfRange")).drop("__n")
    edited = materialize(edits.select("doc_id").distinct(), "edited")
    held = tree.join(edited, "doc_id", "left_semi").withColumn("__block", F.floor(F.col("idx") / F.lit(BLOCK)).cast("long"))
    packed = held.groupBy("doc_id", "__block").agg(F.sort_array(F.collect_list(F.struct("idx", "depth", "level"))).alias("x"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    blocks = packed.select(
        "doc_id", F.lit(0).alias("__kind"), F.col("__block").alias("step"), F.get("x", F.lit(0))["idx"].cast("long").alias("first"),
        F.col("x.depth").cast("array<int>").alias("depths"), F.col("x.level").cast("array<int>").alias("levels"),
        none("string", "op"), none("long", "target"), none("string", "title"), none("long", "page"), none("string", "error"),
    )
    orders = asked.select(
        "doc_id", F.lit(1).alias("__kind"), "step", none("long", "first"), none("array<int>", "depths"), none("array<int>", "levels"), "op", "target", "title", "page", "error"
    )
    dealt = blocks.unionByName(orders).repartition("doc_id").sortWithinPartitions("doc_id", "__kind", "step", "op", "target", "title", "page")
    kind = tree.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, step long, start long, source long, length long, depth int, level int, title string, page long, changed boolean, error string"
    with_package(tree.sparkSession)
    found = materialize(dealt.mapInArrow(_replayed, shape), "replayed")
    runs = found.filter(F.col("start").isNotNull())
    kept = runs.filter("source >= 0").select("doc_id", "start", "source", "length")
    places = expand(kept, F.col("length"), "__i", bound=F.col("length"), spread=["doc_id", "start"], width=width)
    places = places.select("doc_id", (F.col("source") + F.col("__i")).alias("__from"), (F.col("start") + F.col("__i")).alias("__to"))
    old = tree.withColumn("__from", F.col("idx").cast("long")).join(places, ["doc_id", "__from"])
    types = {c: tree.schema[c].dataType for c in ("idx", "title", "page")}
    shown = ["doc_id", "idx", "level", "depth", "title", "page"]
    added = runs.filter("source < 0").select("doc_id", F.col("start").cast(types["idx"]).alias("idx"), "level", "depth", F.col("title").cast(types["title"]).alias("title"), F.col("page").cast(types["page"]).alias("page"))
    moved = old.select("doc_id", F.col("__to").cast(types["idx"]).alias("idx"), "level", "depth", "title", "page")
    still = tree.join(edited, "doc_id", "left_anti").select(*shown)
    outcomes = found.filter(F.col("start").isNull()).select("doc_id", "step", "changed", "error")
    return still.unionByName(moved).unionByName(added), outcomes


def _edits(rows: DataFrame, op: str, target: str) -> DataFrame:
    """One edit for each row; several of a document follow in the order of ``step`` if there is such a column, else of their targets."""
    step = F.col("step") if "step" in rows.columns else F.lit(0)
    text = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in ("title", "page")]
    return rows.select("doc_id", step.alias("step"), F.lit(op).alias("op"), F.col(target).alias("target"), *text)


def _edited_alone(tree: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items of documents with an edit that was done, outcomes by document, refused edits)."""
    items, outcomes = outline_edit(tree, edits)
    done = outcomes.filter("error is null").groupBy("doc_id").agg(F.max("changed").alias("moved"))
    rejects = outcomes.filter("error is not null").select("doc_id", "error")
    return items.join(done, "doc_id").select("doc_id", "idx", "level", "title", "page", "moved"), done, rejects


def outline_add(tree: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append items under pre-order node ``parent`` - 1 (0 is the top level): (items of the documents added to, rejects).

    ``additions``: doc_id, parent, title, page, and ``step`` where a document has several.
    """
    items, _, rejects = _edited_alone(tree, _edits(additions, "add", "parent"))
    return items.drop("moved"), rejects


def outline_remove(tree: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove items at pre-order ``idx`` and everything under them, one after the other. ``picks``: doc_id, idx, and ``step`` if several."""
    items, _, rejects = _edited_alone(tree, _edits(picks, "remove", "idx"))
    return items.drop("moved"), rejects


def outline_move(tree: DataFrame, picks: DataFrame, *, up: bool) -> DataFrame:
    """Swap items with the sibling before (or after) them, subtrees included. ``picks`` as in :func:`outline_remove`.

    At the end of its list nothing changes; ``moved`` tells whether anything of the document did.
    """
    return _edited_alone(tree, _edits(picks, "up" if up else "down", "idx"))[0]


def outline_export(tree: DataFrame, *, width: int | None = None) -> DataFrame:
    """JSON fragments per item in pre-order; joined between brackets they are the nested list.

    The number of closers after an item follows from the depth of the next one.
    """
    ahead = running(tree, ["doc_id"], "idx", {"__next": Running("last", F.col("depth"), inclusive=False)}, descending=True, width=width)
    comma = F.when(F.col("sibling") > 1, F.lit(",")).otherwise(F.lit(""))
    closers = F.greatest(F.col("depth") - F.coalesce(F.col("__next"), F.lit(1)) + 1, F.lit(0))
    head = F.concat(
        comma, F.lit('{"title":'), F.to_json(F.array("title")).substr(F.lit(2), F.length(F.to_json(F.array("title"))) - 2),
        F.lit(',"page":'), F.col("page").cast("string"), F.lit(',"children":['),
    )
    return ahead.select("doc_id", "idx", F.concat(head, F.repeat(F.lit("]}"), closers)).alias("fragment"))


def _strict_pairs(pairs: list[tuple[str, object]]) -> dict[str, object]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a name given twice")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _flat(text: str | None, page_count: int | None) -> tuple[str | None, int | None, list[tuple[str, int, str, int]]]:
    """(error, page, rows) of one JSON list; rows are (path, depth, title, page) in pre-order."""
    try:
        top = json.loads(text or "", object_pairs_hook=_strict_pairs, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return "InvalidOutline", None, []
    rows: list[tuple[str, int, str, int]] = []
    outside = None
    waiting = [(iter(enumerate(top, 1)), "", 1)] if isinstance(top, list) else []
    if not isinstance(top, list):
        return "InvalidOutline", None, []
    while waiting:
        items, above, depth = waiting[-1]
        number, item = next(items, (0, None))
        if not number:
            waiting.pop()
            continue
        kids = item.get("children") if isinstance(item, dict) else None
        title, page = (item.get("title"), item.get("page")) if isinstance(item, dict) else (None, None)
        whole = type(page) is int and -(1 << 63) <= page < 1 << 63
        if not isinstance(title, str) or not whole or not (kids is None or isinstance(kids, list)):
            return "InvalidOutline", None, []
        path = f"{above}{number:010d}"
        rows.append((path, depth, title.encode("utf-8", "replace").decode(), page))
        if outside is None and not (page_count is None or 1 <= page <= page_count):
            outside = page
        if kids:
            waiting.append((iter(enumerate(kids, 1)), path + "/", depth + 1))
    return ("PageOutOfRange", outside, []) if outside is not None else (None, None, rows)


def _imported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "path", "depth", "title", "error", "page"]
    for batch in batches:
        kinds = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        out: list[tuple] = []
        for k in range(batch.num_rows):  # one list at a time: a batch may hold many long ones
            doc, count, text = (column[k].as_py() for column in batch.columns)
            error, page, rows = _flat(text, count)
            out += [(doc, None, None, None, error, page)] if error else [(doc, path, depth, title, None, at) for path, depth, title, at in rows]
            if len(out) >= 4096 or k + 1 == batch.num_rows:
                for at in range(0, len(out), 4096):
                    part = out[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)
                out = []


def outline_import(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested JSON lists of any depth to flat rows: (items with a sortable ``path``, rejects).

    ``lists``: doc_id, page_count, json. Each list is read once, where it is, whatever
    its depth, with a stack in place of a round for each level; nothing is shuffled, and
    the one job writes items and rejects together. Text that is not a list of objects with
    a title and a whole page, or that gives a name twice, refuses the document
    (InvalidOutline), and so does a page outside it (PageOutOfRange, with the first such
    page in pre-order). An empty list leaves no rows.
    """
    with_package(lists.sparkSession)
    kind = lists.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, path string, depth int, title string, error string, page long"
    read = lists.select("doc_id", F.col("page_count").cast("long").alias("page_count"), "json").mapInArrow(_imported, shape)
    found = materialize(read, "outline")
    rejects = found.filter("error is not null").select("doc_id", "error", "page")
    return found.filter("error is null").select("doc_id", "path", "depth", "title", "page"), rejects


def outline_destinations(
    tree: DataFrame, targets: DataFrame, dests: DataFrame, docs: DataFrame, *, width: int | None = None
) -> DataFrame:
    """Page of every outline item; an item that does not resolve drops with its whole subtree.

    ``targets``: doc_id, idx, kind (page, number or name), page, name. ``dests``: doc_id,
    name, source (direct or tree), kind, page, target. Names may lead to names; chains of
    any length are followed by pointer doubling, the direct table before the name tree,
    and a chain that loops does not resolve.
    """
    table = dests.groupBy("doc_id", "name").agg(
        F.min_by(F.struct("kind", "page", "target"), F.when(F.col("source") == "direct", 0).otherwise(1)).alias("d")
    )
    nodes = table.select(
        "doc_id",
        F.col("name").alias("id"),
        F.when(F.col("d.kind") == "name", F.col("d.target")).alias("up"),
        F.when(F.col("d.kind") != "name", F.col("d.page")).cast("int").alias("page"),
    )
    ends = climb(
        nodes,
        ["doc_id"],
        lambda near, far: {"page": far("page")},
    )
    named = ends.filter(F.col("up").isNull()).select(
        "doc_id", F.col("id").alias("name"), F.col("page").alias("__named")
    )
    counts = docs.select("doc_id", F.col("page_count").alias("__n"))
    asked = targets.select("doc_id", "idx", "kind", F.col("page").alias("__asked"), "name")
    found = (
        tree.join(asked, ["doc_id", "idx"], "left")
        .join(named, ["doc_id", "name"], "left")
        .join(counts, "doc_id")
        .withColumn("__page", F.when(F.col("kind") == "name", F.col("__named")).otherwise(F.col("__asked")))
        .withColumn("__page", F.when(F.col("__page").between(1, F.col("__n")), F.col("__page")))
    )
    lost_until = F.when(F.col("__page").isNull() | F.col("title").isNull(), F.col("idx") + F.col("descendants"))
    flagged = running(
        found.select("doc_id", "idx", "title", "descendants", "__page"),
        ["doc_id"],
        "idx",
        {"__lost": Running("max", lost_until)},
        width=width,
    )
    return flagged.filter(F.col("__lost").isNull() | (F.col("__lost") < F.col("idx"))).select(
        "doc_id", "idx", "title", F.col("__page").cast("int").alias("page")
    )
