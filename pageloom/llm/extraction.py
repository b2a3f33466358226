"""Main text of web pages by a tree-structured graphical model over the page's blocks.

Every block element and text block is a binary variable, content or not. A log-linear
potential scores each alone, another each parent-child pair. Messages passed up and
then down the tree give exact marginals; text blocks more likely content than not are
kept. The weights maximise the likelihood of labelled pages, with the same messages
giving the expected counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.common import arrow_batches, in_arrow
from pageloom.llm.dom import Node, parse
from pageloom.llm.labelled_pages import labelled_pages

STEPS = 250
RIDGE = 0.001

_TAGS = {
    "article": "article main", "division": "div section td th tr table tbody body", "paragraph": "p pre blockquote figure figcaption dd dt dl",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li menu dir", "nav": "nav", "header": "header", "footer": "footer address",
    "aside": "aside", "form": "form button label fieldset legend option search", "dialog": "dialog",
}
_TAG_OF = {tag: kind for kind, tags in _TAGS.items() for tag in tags.split()}
#: Words in class, id and role that tell what a block is for.
_USES = {
    "is_main": "article content post entry main story body text page",
    "is_menu": "nav navigation menu navbar breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip",
    "is_side": "side sidebar aside complementary widget widgets rail right left column",
    "is_head": "header head banner masthead logo brand top",
    "is_foot": "footer foot bottom copyright legal contentinfo colophon",
    "is_ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted slot commercial",
    "is_notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog warning disclaimer announcement",
    "is_form": "form login signin signup register search subscribe subscription newsletter contact",
    "is_comment": "comment comments reply replies discussion disqus respond reviews review feedback thread commentlist user",
    "is_more": "related recommended recommend more share sharing social tags tag categories meta author teaser trending popular links",
}
_USE_OF = {word: use for use, words in _USES.items() for word in words.split()}
_ELEMENT = ["element", *_TAGS, *_USES, "hidden"]
_TEXT = ["text", "log_words", "few_words", "linked", "sentence", "no_letters", "copyright", "in_paragraph", "in_heading", "in_item", "in_form"]
FEATURES = _ELEMENT + _TEXT
_PLACE = {name: k for k, name in enumerate(FEATURES)}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=20_000)
def _uses(names: str) -> tuple[int, ...]:
    return tuple(sorted({_PLACE[_USE_OF[w]] for w in map(str.lower, _WORDS.findall(names)) if w in _USE_OF}))


def _signals(node: Node, parent: Node) -> list[tuple[int, float]]:
    if node.text is None:
        found = [(_PLACE["element"], 1.0)]
        kind = _TAG_OF.get(node.tag)
        if kind:
            found.append((_PLACE[kind], 1.0))
        a = node.attributes
        if a:
            found += [(k, 1.0) for k in _uses(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}")]
            if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
                found.append((_PLACE["hidden"], 1.0))
        return found
    text = node.text
    n = text.count(" ") + 1
    found = [(_PLACE["text"], 1.0), (_PLACE["log_words"], min(log1p(n), 6.0)), (_PLACE["linked"], node.links / len(text))]
    if n < 5:
        found.append((_PLACE["few_words"], 1.0))
    if text[-1] in ".!?\"'”»)" or ". " in text:
        found.append((_PLACE["sentence"], 1.0))
    if not any(map(str.isalpha, text[:200])) and not any(map(str.isalpha, text)):
        found.append((_PLACE["no_letters"], 1.0))
    if "©" in text:
        found.append((_PLACE["copyright"], 1.0))
    place = {"paragraph": "in_paragraph", "heading": "in_heading", "list": "in_item", "form": "in_form"}.get(_TAG_OF.get(parent.tag, ""))
    if place:
        found.append((_PLACE[place], 1.0))
    return found


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


@dataclass(frozen=True)
class Model:
    unary: np.ndarray
    #: Log-potentials [child is text][parent is content][child is content].
    pair: np.ndarray


def marginals(nodes: list[Node], alone: list[float], model: Model) -> tuple[list[float], list[float], list[float]]:
    """Log-odds of every node being content, and the messages' parts: below each node, and from its parent's other side."""
    n = len(nodes)
    pair = model.pair.tolist()
    below, up = list(alone), [0.0] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        w, s = pair[nodes[i].text is not None], below[i]
        up[i] = _add(w[1][0], w[1][1] + s) - _add(w[0][0], w[0][1] + s)
        below[nodes[i].parent] += up[i]
    belief, above = list(below), [0.0] * n
    for i in range(1, n):
        w = pair[nodes[i].text is not None]
        t = above[i] = belief[nodes[i].parent] - up[i]
        belief[i] = below[i] + _add(w[0][1], w[1][1] + t) - _add(w[0][0], w[1][0] + t)
    return belief, below, above


def _labels(nodes: list[Node]) -> np.ndarray:
    """Text blocks as marked; an element is content if most of its characters are."""
    mark, chars = [0] * len(nodes), np.zeros((len(nodes), 2))
    for i, node in enumerate(nodes):
        above = mark[node.parent] if i else 0
        mark[i] = int(node.attributes.get("data-main", above))
        if node.text is not None:
            chars[i, mark[i]] = len(node.text)
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
    return (chars[:, 1] > chars[:, 0]).astype(float)


def train(pages: list[str], steps: int = STEPS) -> Model:
    """Weights of largest likelihood on labelled pages, by gradient steps with adaptive sizes and a ridge."""
    trees = [parse(p) for p in pages]
    designs = []
    for nodes in trees:
        x = np.zeros((len(nodes), len(FEATURES)))
        for i, node in enumerate(nodes):
            for k, v in _signals(node, nodes[node.parent]):
                x[i, k] = v
        designs.append(x)
    labels = [_labels(nodes) for nodes in trees]
    width = len(FEATURES)
    theta = np.zeros(width + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model = Model(theta[:width], theta[width:].reshape(2, 2, 2))
        gradient = -RIDGE * theta
        for nodes, x, y in zip(trees, designs, labels, strict=True):
            belief, below, above = (np.array(v) for v in marginals(nodes, (x @ theta[:width]).tolist(), model))
            gradient[:width] += x.T @ (y - 1 / (1 + np.exp(-belief))) / len(trees)
            parent = np.array([node.parent for node in nodes])[1:]
            kind = np.array([node.text is not None for node in nodes])[1:].astype(int)
            state = np.exp(model.pair[kind] + above[1:, None, None] * np.array([0, 1])[None, :, None] + below[1:, None, None] * np.array([0, 1])[None, None, :] - np.maximum(above[1:], 0)[:, None, None] - np.maximum(below[1:], 0)[:, None, None])
            expected = state / state.sum(axis=(1, 2), keepdims=True)
            real = np.zeros_like(expected)
            real[np.arange(len(parent)), y[parent].astype(int), y[1:].astype(int)] = 1
            for k in (0, 1):
                gradient[width + 4 * k : width + 4 * k + 4] += (real - expected)[kind == k].sum(axis=0).ravel() / len(trees)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Model(theta[:width], theta[width:].reshape(2, 2, 2))


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages())


def main_text(html: str | None, model: Model) -> str:
    nodes = parse(html)
    weights = model.unary.tolist()
    alone = [sum(weights[k] * v for k, v in _signals(node, nodes[node.parent])) for node in nodes]
    belief, _, _ = marginals(nodes, alone, model)
    return "\n".join(node.text for node, b in zip(nodes, belief, strict=True) if node.text is not None and b > 0)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html, ...).

    Pages are parsed where they are read; the model (a few dozen numbers) is the only
    thing sent along. Null, empty and text-free pages give an empty text. Rows are
    independent: repeated rows give the same text each, ids may be null.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches, 200):
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long")
