"""Quality by pairwise ranking: a Bradley-Terry score learned from preferred pairs, thresholded at a quantile."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.common import arrow_batches, bitmap, in_arrow, in_bitmap
from pageloom.plans.shared import materialize

#: Labelled rows fitted in one place; more are dealt to groups of about as many.
GROUP_ROWS = 20_000
#: Bits that tell which texts may have a label, by a hash of their id.
PLACES = 1 << 23
#: Pairs compared at once.
CHUNK = 1 << 15
#: Preference pairs drawn for each labelled row of the rarer label.
PAIRS_EACH = 24
RIDGE = 1e-3
ROUNDS = 60

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "same_as_previous", "top_word", "short_words", "long_words",
    "bare_symbols", "letters", "digits", "upper", "spaces", "sentence_marks", "other_marks", "log_line_words", "distinct_lines",
    "sentence_lines", "distinct_pairs", "capital_words", "punctuated_words", "character_entropy",
)
_SENTENCE = ".!?"


def features(text: str | None) -> list[float]:
    """Shape of a whole text, in numbers that do not depend on its language. Empty texts give zeros."""
    tokens = text.split() if text else []
    if not tokens:
        return [0.0] * len(FEATURES)
    n, chars = len(tokens), len(text)
    seen = Counter(tokens)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    by_char = Counter(text)
    count = lambda test: sum(v for c, v in by_char.items() if test(c))
    letters, spaces = count(str.isalpha), count(str.isspace)
    marks = sum(by_char[c] for c in ".,;:!?'\"-()")
    shares = np.fromiter(by_char.values(), float) / chars
    lengths = Counter(map(len, tokens))
    return [
        math.log1p(chars),
        math.log1p(n),
        sum(k * v for k, v in lengths.items()) / n,
        len(seen) / n,
        sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        max(seen.values()) / n,
        sum(v for k, v in lengths.items() if k <= 3) / n,
        sum(v for k, v in lengths.items() if k > 12) / n,
        sum(v for w, v in seen.items() if not any(map(str.isalnum, w))) / n,
        letters / chars,
        count(str.isdigit) / chars,
        count(str.isupper) / max(1, letters),
        spaces / chars,
        sum(by_char[c] for c in _SENTENCE) / n,
        (chars - letters - spaces - marks - count(str.isdigit)) / chars,
        math.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        sum(x[-1] in _SENTENCE for x in lines) / max(1, len(lines)),
        len(set(zip(tokens, tokens[1:], strict=False))) / n,
        sum(v for w, v in seen.items() if w[0].isupper()) / n,
        sum(v for w, v in seen.items() if w[-1] in ".,;:!?") / n,
        float(-(shares * np.log(shares)).sum()),
    ]


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """A ranker from labelled rows.

    Every row of the rarer label is paired with rows of the other; the chance that the
    better one wins is the logistic function of the score difference. Newton steps on
    the pairs' log-likelihood with a small ridge. The threshold is the quantile of the
    scores at the share of the worse label. One label only: every score is that label.
    """
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(width), np.zeros(width), np.ones(width), math.inf if len(bad) else -math.inf)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    better, worse = _pairs(y, len(good) < len(bad), np.random.default_rng(7))

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        return len(better), *_sums(z, better, worse, w)

    w = _climb(width, sums)
    scores = np.sort(z @ w)
    cut = min(max(len(bad), 1), len(scores) - 1)
    return Ranker(w, mean, scale, float((scores[cut - 1] + scores[cut]) / 2))


def _pairs(y: np.ndarray, good_is_rarer: bool, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(better, worse) row numbers: each row of the rarer label with PAIRS_EACH of the other."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = (good, bad) if good_is_rarer else (bad, good)
    a = np.repeat(few, PAIRS_EACH) if len(many) else few[:0]
    b = rng.choice(many, len(a)) if len(a) else a
    return (a, b) if good_is_rarer else (b, a)


def _sums(z: np.ndarray, better: np.ndarray, worse: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the pairs' log-likelihood, not yet divided by their number."""
    gradient, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
    for at in range(0, len(better), CHUNK):
        diff = z[better[at : at + CHUNK]] - z[worse[at : at + CHUNK]]
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        gradient += diff.T @ (1 - p)
        curve += (diff * (p * (1 - p))[:, None]).T @ diff
    return gradient, curve


def _climb(width: int, sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Newton steps on what ``sums`` gives for some weights: number of pairs, gradient, curvature."""
    w = np.zeros(width)
    for _ in range(ROUNDS):
        n, gradient, curve = sums(w)
        step = np.linalg.solve(curve / n + RIDGE * np.eye(width), gradient / n - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = GROUP_ROWS, where: Column | None = None) -> Ranker:
    """Fits a ranker on all labelled rows whose label is 0 or 1, without a row that ``where`` excludes.

    Documents that share a labelled doc_id count as one, with the smallest of their
    features. Features are taken where the texts lie, of those that may have a label.
    Up to ``rows`` labels are fitted on the driver (:func:`fit`), more of them in groups
    of about ``rows`` (:func:`fit_groups`).
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    if where is not None:
        marked = marked.where(where)
    marked = marked.distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("at")
    known = bitmap(marked.select(place), "at", PLACES)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").select("doc_id", place, "text")
    found = _with_features(texts, known).join(marked, "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    n = marked.count()
    if n > rows:
        return fit_groups(found, -(-n // rows))
    found = found.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    if found.empty:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    return fit(np.array(found["features"].tolist()), found["quality"].to_numpy())


def fit_groups(found: DataFrame, groups: int) -> Ranker:
    """As :func:`fit`, from any number of rows (doc_id, quality, features) in ``groups`` groups by a hash of the id.

    Means, scales and the threshold are those of all rows. Rows are paired within their
    group, so that a round is one pass over the written groups and gives a gradient and
    a curvature (4 kB) for each; a group that lacks a label has no pairs.
    """
    width = len(FEATURES)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("quality", "ascending")]).combine_chunks()
        x = np.array(group["features"].to_pylist(), float)
        return pa.table({"g": group["g"][:1], "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([group["quality"].to_numpy().astype(np.int8).tobytes()], pa.binary())})

    dealt = found.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)))
    packed = materialize(dealt.groupBy("g").applyInArrow(pack, "g long, x binary, y binary"), "groups")

    def over(what: Callable[[int, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[list[np.ndarray]]:
        """What a function gives for each group, in the order of groups."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, x, y in zip(*(batch.column(k) for k in range(3)), strict=True):
                    out = what(g.as_py(), np.frombuffer(x.as_buffer(), float).reshape(-1, width), np.frombuffer(y.as_buffer(), np.int8))
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()]), pa.array([[v.ravel().tolist() for v in out]], pa.list_(pa.list_(pa.float64())))], ["g", "v"])

        return [[np.array(v) for v in r.v] for r in sorted(in_arrow(packed, run, "g long, v array<array<double>>").collect())]

    parts = over(lambda g, x, y: [np.array([(y == 1).sum(), (y == 0).sum()], float), x.sum(axis=0)])
    good, bad = (int(sum(p[0][k] for p in parts)) for k in (0, 1))
    if not good or not bad:
        return Ranker(np.zeros(width), np.zeros(width), np.ones(width), math.inf if bad else -math.inf)
    mean = sum(p[1] for p in parts) / (good + bad)
    scale = np.sqrt(sum(p[0] for p in over(lambda g, x, y: [np.square(x - mean).sum(axis=0)])) / (good + bad)) + 1e-9

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def one(g: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            better, worse = _pairs(y, good < bad, np.random.default_rng((7, g)))
            return [np.array([len(better)], float), *_sums(np.clip((x - mean) / scale, -8, 8), better, worse, w)]

        out = over(one)
        return max(1, int(sum(p[0][0] for p in out))), sum(p[1] for p in out), sum(p[2] for p in out).reshape(width, width)

    ranker = Ranker(_climb(width, sums), mean, scale, 0.0)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(ranker.raw(np.frombuffer(x.as_buffer(), float).reshape(-1, width)))], ["score"])

    cut = min(max(bad, 1), good + bad - 1)
    low, high = _ranked(materialize(in_arrow(packed, raw, "score double"), "scores"), good + bad, cut)
    return Ranker(ranker.weights, mean, scale, (low + high) / 2)


def _ranked(scores: DataFrame, n: int, cut: int) -> tuple[float, float]:
    """The values at places cut - 1 and cut (from 0) of all scores in order.

    Approximate quantiles on both sides enclose them; what lies between is counted.
    """
    margin = 4e-4
    while True:
        ends = [max(0.0, (cut - 1) / n - margin), min(1.0, (cut + 1) / n + margin)]
        lo, hi = scores.select(F.percentile_approx("score", ends, 10_000)).first()[0]
        below = scores.where(F.col("score") < lo).count()
        near = sorted(tuple(r) for r in scores.where(F.col("score").between(lo, hi)).groupBy("score").count().collect())
        values, last = [v for v, _ in near], below + np.cumsum([c for _, c in near])
        if below <= cut - 1 and last[-1] > cut:
            return tuple(values[int(np.searchsorted(last, at, side="right"))] for at in (cut - 1, cut))
        margin *= 4


def _with_features(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id and features of the rows (doc_id, at, text) whose place is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            batch = batch.filter(pa.array(in_bitmap(known, batch.column(1).to_numpy())))
            values = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "features"])

    return in_arrow(texts, run, "doc_id long, features array<double>")


def scored(docs: DataFrame, ranker: Ranker, *, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted of every row; with ``keep`` all columns of ``docs`` where predicted is 1 instead."""
    at, names = docs.columns.index("text"), docs.columns

    def scores(texts: list[str | None]) -> np.ndarray:
        return ranker.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            s = scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            good = pa.array(scores(batch.column(at).to_pylist()) >= 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(batch.num_columns)], names)

    if keep:
        return in_arrow(docs, kept, docs.schema)
    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")
