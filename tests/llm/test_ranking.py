"""The pairwise ranking against plain gradient ascent, and its query against plain scoring."""

from __future__ import annotations

import math

import numpy as np
from llm_rows import SF

from pageloom.llm import preference, queries
from pageloom.llm.common import ids_crc_mod3


def plain_fit(x, y, steps=4000):
    """The same pairs, ascended step by step; returns (weights, threshold)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9), -8, 8)
    few, many = (good, bad) if len(good) < len(bad) else (bad, good)
    rng = np.random.default_rng(7)
    left, right = np.repeat(few, preference.PAIRS_EACH), rng.choice(many, len(few) * preference.PAIRS_EACH)
    better, worse = (left, right) if few is good else (right, left)
    w = np.zeros(x.shape[1])
    rate = 4 / (np.square(z[better] - z[worse]).sum(axis=1).max() / 4 + 1)
    for _ in range(steps):
        win = 1 / (1 + np.exp(-((z[better] - z[worse]) @ w)))
        w += rate * (((1 - win)[:, None] * (z[better] - z[worse])).mean(axis=0) - preference.RIDGE * w)
    order = np.sort(z @ w)
    cut = min(len(bad), len(order) - 1)
    return w, (order[cut - 1] + order[cut]) / 2


def loss(w, x, y):
    good, bad = x[y == 1] @ w, x[y == 0] @ w
    return np.log1p(np.exp(-(good[:, None] - bad[None, :]))).mean()


def test_newton_finds_what_gradient_ascent_finds():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7):
        x = rng.normal(size=(400, 4)) * [1, 5, 0.1, 2] + [3, -1, 0, 9]
        y = ((x - x.mean(axis=0)) / x.std(axis=0) @ [1.0, -0.5, 0.2, 0.0] + rng.logistic(size=400) > np.quantile(x[:, 0] * 0, 1 - share) + (0.5 - share)).astype(int)
        ranker = preference.fit(x, y)
        w, threshold = plain_fit(x, y)
        assert np.allclose(ranker.weights, w, atol=2e-3) and math.isclose(ranker.threshold, threshold, abs_tol=5e-3)
        z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
        assert loss(ranker.weights, z, y) < loss(np.zeros(4), z, y)


def test_query_equals_plain_scoring(few, documents):
    labels = few.read.parquet(f"{SF}/labels.parquet")
    ranker = preference.learn(documents, labels, where=ids_crc_mod3() != 1)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    got = queries.QUERIES["op7_pairwise_quality"](few, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        z = np.clip((np.array(preference.features(texts[r.doc_id])) - ranker.mean) / ranker.scale, -8, 8)
        score = 1 / (1 + math.exp(-(float(z @ ranker.weights) - ranker.threshold)))
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-12) and r.predicted == (score >= 0.5)


def test_groups_take_in_every_labelled_row(few, documents, monkeypatch):
    labels = few.read.parquet(f"{SF}/labels.parquet")
    rows, fit = [], preference.fit
    monkeypatch.setattr(preference, "fit", lambda x, y: rows.append((x, y)) or fit(x, y))
    whole = preference.learn(documents, labels)
    spread = preference.learn(documents, labels, rows=24)
    (x, y), = rows
    assert len(y) == labels.where("quality in (0, 1)").count() > 48
    assert np.allclose(spread.mean, x.mean(axis=0)) and np.allclose(spread.scale, x.std(axis=0) + 1e-9)
    scores = np.sort(spread.raw(x))
    cut = int((y == 0).sum())
    assert math.isclose(spread.threshold, (scores[cut - 1] + scores[cut]) / 2, rel_tol=1e-9)
    assert np.mean((spread.score(x) >= 0.5) == (whole.score(x) >= 0.5)) > 0.95
    assert loss(spread.weights, (x - spread.mean) / spread.scale, y) < 1.5 * loss(whole.weights, (x - whole.mean) / whole.scale, y) + 0.02


def test_places_in_order_among_ties(few):
    values = sorted([0.5] * 400 + [k / 7 for k in range(300)] + [-2.0, 9.0] * 3)
    scores = few.createDataFrame([(v,) for v in values], "score double")
    for cut in (1, 2, 3, 200, len(values) // 2, len(values) - 1):
        assert preference._ranked(scores, len(values), cut) == (values[cut - 1], values[cut])
