"""Secret scans: trigram postings of a block of texts, intersected by each rule's query; candidates are verified."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_batches, in_arrow
from pageloom.llm.trigrams import Query, trigram_query, trigrams_in


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    #: The group whose length counts; 0 is the whole match.
    group: int = 0
    #: What a match goes on with, if it is there; trigrams are only asked of the pattern.
    rest: str = ""


#: A key's body: header fields and base64 lines, and its END line if that is what follows them. Other words end it.
_GAP = r"(?:\s|\\[nr])"
_KEY_BODY = (
    rf"(?:{_GAP}+(?:Proc-Type|DEK-Info):[^\n\\]*)*"
    rf"(?:{_GAP}*[A-Za-z0-9+/]{{16,}}={{0,2}}(?:{_GAP}+[A-Za-z0-9+/]{{16,}}={{0,2}})*)?"
    rf"(?:(?:{_GAP}+[A-Za-z0-9+/]+={{0,2}})?{_GAP}*-----END [A-Z ]*PRIVATE KEY-----|(?:\r?\n|\\n)[A-Za-z0-9+/]+={{0,2}}(?=\s*$|\r?\n|\\n))?"
)

#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further kinds: key blocks and tokens with a fixed mark.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", rest=_KEY_BODY),
    Rule("marked_token", r"(?:ghp_|gho_|ghs_|glpat-|sk_live_|xoxb-|xoxp-)[A-Za-z0-9_-]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Texts whose postings are held at once, by bytes. A longer text is a block of its own.
BLOCK_BYTES = 8 << 20
_CHUNK = 1 << 20


@lru_cache(maxsize=8)
def _plan(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern, Query]], list[bytes], np.ndarray]:
    found = []
    for rule in rules:
        # a run cannot be longer than the pattern's own repeat, so the least length may be asked of the run itself
        pattern = f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and rule.least else rule.pattern
        found.append((rule, re.compile(pattern + rule.rest, re.ASCII), trigram_query(rule.pattern)))
    wanted = sorted(set().union(*(trigrams_in(q) for _, _, q in found)))
    place = np.zeros(1 << 24, dtype=np.uint16)
    for k, t in enumerate(wanted, 1):
        place[int.from_bytes(t, "big")] = k
    return found, wanted, place


def postings(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> dict[bytes, np.ndarray]:
    """The inverted index of a block: for each trigram the rules ask for, the numbers of the texts that hold it."""
    _, wanted, place = _plan(rules)
    raw = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", dtype=np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    pairs = []
    for at in range(0, len(raw) - 2, _CHUNK):
        part = raw[at : at + _CHUNK + 2].astype(np.uint32)
        which = place[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
        hits = np.flatnonzero(which)
        pairs.append(np.unique(np.searchsorted(ends, hits + at, side="right") * (len(wanted) + 1) + which[hits]))
    both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, dtype=np.int64)
    text, which = both // (len(wanted) + 1), both % (len(wanted) + 1)
    order = np.argsort(which, kind="stable")
    text, cuts = text[order], np.searchsorted(which[order], np.arange(1, len(wanted) + 2))
    return {t: text[cuts[k] : cuts[k + 1]] for k, t in enumerate(wanted)}


def matching(query: Query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts a query leaves: postings intersected and united."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return index[query]
    parts = sorted((matching(x, index, n) for x in query[1]), key=len)
    out = parts[0]
    for part in parts[1:]:
        out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
    return out


def spans_of(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule number) of every finding, by start, for each text of a block."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    index = postings([(t or "").encode("utf-8", "replace") for t in texts], rules)
    for number, (rule, pattern, query) in enumerate(_plan(rules)[0]):
        for k in matching(query, index, len(texts)).tolist():
            for m in pattern.finditer(texts[k] or ""):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[k].append((m.start(), m.end(), number))
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in found]


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts = batch.column(column).to_pylist()
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_BYTES or k == len(texts) - 1:
            yield batch.slice(start, k + 1 - start), texts[start : k + 1]
            start, size = k + 1, 0


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found: array of (kind, start, end) by start, in code points, for every row of ``docs``.

    Texts are indexed block by block where they are read, so nothing is shuffled and a
    task holds one block's postings. Spans of different kinds may overlap; those of one
    kind do not. Null and empty texts have none; repeated rows are scanned each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            for block, texts in _blocks(batch, 1):
                found = [[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in x] for x in spans_of(texts, rules)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return in_arrow(rows, run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each scanned row."""
    base = [r.kind for r in BASE]
    written = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(written(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def _masked(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span of its text replaced by a mark, and n_chars (if there) set anew.

    Overlapping spans become one mark. All rows and columns stay; a null text stays null.
    """
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            for block, texts in _blocks(batch, at):
                new = [_masked(t, s, mark) for t, s in zip(texts, spans_of(texts, rules), strict=True)]
                columns = [block.column(k) for k in range(block.num_columns)]
                columns[at] = pa.array(new, block.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    out = in_arrow(docs, run, docs.schema)
    if "n_chars" in names:
        changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", changed)
    return out
