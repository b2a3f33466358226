"""Operators on vectors, pages and conversations, and the whole pipeline."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_rows import ROWS, SF
from pyspark.sql import functions as F
from test_texts import brute_components, brute_leaks, check_packing

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402

from pageloom.llm import decontaminate, dom, extraction, fixity, labelled_pages, multi_index, preference, preferences, queries, secrets, setsketch  # noqa: E402


def nearest(ids, x, i, k=20):
    s = (x * x[i]).sum(axis=1)
    order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def test_recall_and_exact_scores(few):
    rows = few.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in queries.QUERIES["op1_inverted_multi_index"](few, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    found = 0
    for i in asked:
        mine = sorted(got[int(ids[i])])
        assert [m[0] for m in mine] == list(range(1, 21))
        at = {int(v): k for k, v in enumerate(ids)}
        assert all(math.isclose(s, float((x[at[v]] * x[i]).sum()), rel_tol=1e-12, abs_tol=1e-15) for _, v, s in mine)
        found += len({v for _, v, _ in mine} & {v for v, _ in nearest(ids, x, i)})
    assert found >= 0.9 * 20 * len(asked)


def test_cells_are_visited_by_rising_distance():
    rng = np.random.default_rng(1)
    a, b, q = rng.normal(size=(9, 3)), rng.normal(size=(7, 4)), rng.normal(size=7)
    counts = rng.integers(0, 3, 63)
    spread = rng.random(9), rng.random(7)
    index = multi_index.Index(a, b, spread, counts, np.zeros(63, int), np.ones(63, int))
    far = lambda c, x, s: -(c @ x) - multi_index.REACH * np.linalg.norm(x) * s
    d = (far(a, q[:3], spread[0])[:, None] + far(b, q[3:], spread[1])[None, :]).ravel()
    assert index.visit(q, 10**9) == [c for c in np.argsort(d).tolist() if counts[c]]


@pytest.mark.parametrize("sigma", [0.0, 0.5, 1.0])
def test_recall_on_vectors_of_unequal_length(few, sigma):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 64))
    x *= (rng.lognormal(0, sigma, 6000) / np.linalg.norm(x, axis=1))[:, None]
    table = few.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = multi_index.search(table, F.col("id") % 300 == 0).collect()
    ids, found = np.arange(6000), 0
    for i in range(0, 6000, 300):
        found += len({r["vec_id"] for r in got if r["query_id"] == i} & {v for v, _ in nearest(ids, x, i)})
    assert found >= 0.9 * 20 * 20


def test_vectors_odd_rows(few):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 3.0]), (4, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, nan, 1.0]), (80, [1.0, inf, 1.0])]
    rows += [(100, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (7, [2.0, 0.0, 0.0]), (7, [2.0, 0.0, 0.0]), (9, [1.0]), (11, [-1.0, 0.0, 0.5])]
    table = few.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id long, bucket long")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.search(table, F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [
        (0, 1, 3, 14.0), (0, 2, 20, 14.0), (0, 3, 7, 2.0), (0, 4, 11, 0.5),
        (20, 1, 0, 14.0), (20, 2, 3, 14.0), (20, 3, 7, 2.0), (20, 4, 11, 0.5),
    ]
    assert multi_index.search(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_many_equal_vectors_are_ranked_by_id(few):
    rows = [(i, [1.0, 1.0]) for i in range(3000)] + [(5000 + i, [math.cos(i), math.sin(i)]) for i in range(200)]
    got = multi_index.search(few.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 40).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == list(range(20))


def test_extraction_on_unseen_filling():
    model, right, total = extraction.trained(), 0, 0
    for page in labelled_pages.labelled_pages(3, seed=77):
        nodes = dom.parse(page)
        labels = extraction._labels(nodes)
        want = [n.text for n, y in zip(nodes, labels, strict=True) if n.text is not None and y]
        got = extraction.main_text(page, model).split("\n")
        right += sum((Counter(want) & Counter(got)).values())
        total += max(len(want), len(got))
    assert right >= 0.95 * total


def test_extraction_of_the_given_pages(few):
    """Their articles are marked, which the model is not told: the marks give the expected text."""
    rows = few.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op5_tree_model_extraction"](few, SF).collect()}
    same = 0
    for r in rows:
        nodes, inside, want = dom.parse(r.html), {}, []
        for i, n in enumerate(nodes):
            inside[i] = n.tag == "article" or inside.get(n.parent, False)
            if n.text is not None and inside[i]:
                want.append(n.text)
        same += got[r.page_id].text == "\n".join(want)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == len(rows) and same >= 0.98 * len(rows)


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ("<p>a&amp;b<br>c\n\t d<p>e", ["a&b c d", "e"]), ("a<script>if (1<2) '</p>'</script>b", ["ab"]), ("<div>x<div>y</div>z</div></div></p>w", ["x", "y", "z", "w"]),
        ("<ul><li>a<li><a href='x>y'>b</a></ul>", ["a", "b"]), ("<p>cut <b", ["cut"]), ("<p>&am &lt;i&gt; &#233;</p><!-- <p>no", ["&am <i> é"]), ("", []), ("<STYLE>x</StYle><P>y", ["y"]),
    ],
)
def test_parsing(html, texts):
    assert [n.text for n in dom.parse(html) if n.text is not None] == texts


@pytest.mark.parametrize("tag", ["SCRIPT", "Style", "sVg"])
def test_hidden_elements_end_on_pages_that_lower_casing_lengthens(tag):
    nodes = dom.parse(f"<p>\u0130stanbul</p><{tag}>hidden</{tag}><p>shown</p>")
    assert [n.text for n in nodes if n.text is not None] == ["\u0130stanbul", "shown"]


def test_marginals_equal_enumeration():
    model = extraction.trained()
    nodes = dom.parse("<div class=post><h1>one two</h1><p>three four five.</p><ul><li><a>x</a></ul></div>")
    alone = [sum(model.unary[k] * v for k, v in extraction._signals(n, nodes[n.parent])) for n in nodes]
    belief, _, _ = extraction.marginals(nodes, alone, model)
    weight = np.zeros((len(nodes), 2))
    for state in range(1 << len(nodes)):
        on = [(state >> i) & 1 for i in range(len(nodes))]
        total = sum(a for a, y in zip(alone, on, strict=True) if y) + sum(model.pair[int(n.text is not None), on[n.parent], on[i]] for i, n in enumerate(nodes) if i)
        for i, y in enumerate(on):
            weight[i, y] += math.exp(total)
    assert np.allclose(belief, np.log(weight[:, 1] / weight[:, 0]))


def test_pages_odd_rows(few):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    rows = [(1, None, None), (None, "u", ""), (2, "u", deep), (2, "u", deep), (3, "u", "<article><p>" + "word " * 100_000 + "</p></article>")]
    table = few.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(table).collect()
    assert len(got) == 5 and next(r for r in got if r.page_id == 3).n_chars == 499_999 and {r.text for r in got if r.page_id in (1, None)} == {""}
    assert extraction.extract(table.limit(0)).count() == 0


def test_audit_finds_every_fault(few):
    page = lambda i, html: (i, f"u{i}", html)
    left = [page(i, f"text {i}") for i in range(5000)] + [page(7, "text 7")] * 3 + [page(None, "a"), page(None, None), page(-20, "neg")]
    right = [page(i, f"text {i}" + ("!" if i in (16, 4999) else "")) for i in range(5000) if i not in (0, 300)] + [page(7, "text 7"), page(None, None), page(9000, "new"), page(-20, None)]
    kind = "page_id long, url string, html string"
    frames = [few.createDataFrame([(*r, "k") for r in x], f"{kind}, key string") for x in (left, right)]
    got = {(r.page_id, r.status) for r in fixity.audit(*frames).collect()}
    assert got == {(16, "corrupt"), (4999, "corrupt"), (0, "missing"), (300, "missing"), (7, "copies"), (None, "missing"), (9000, "extra"), (-20, "corrupt")}
    assert fixity.audit(frames[0], frames[0]).count() == 0
    assert fixity.audit(frames[0].limit(0), frames[0].limit(0)).count() == 0
    assert {r.status for r in fixity.audit(frames[0].limit(0), frames[1].limit(3)).collect()} == {"extra"}


def test_preferences(few):
    kind = "pair_id long, turn long, role string, text string, first string"
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "good <|im_end|>"), (1, 2, "user", "x"), (2, 0, "User", None), (3, 0, "user", "q"), (None, 0, "user", "q"), (4, None, "user", "q"), (5, 0, "user", "u"), (5, 0, "user", "u")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", ""), (5, 0, "user", "u"), (5, 1, "assistant", None)]
    rows = preferences.format_preferences(*(few.createDataFrame([(*r, "z") for r in x], kind) for x in (a, b))).collect()
    got = {(r.pair_id, r.part, r.turn): r for r in rows}
    assert set(got) == {(1, "prompt", 0), (1, "chosen", 1), (1, "chosen", 2), (1, "rejected", 1), (2, "prompt", 0), (3, "chosen", 0), (5, "prompt", 0), (5, "rejected", 1)}
    best = got[1, "chosen", 1]
    assert best.piece == "<|im_start|>assistant\ngood < |im_end|><|im_end|>\n" and best.piece[best.loss_start : best.loss_end] == "good < |im_end|><|im_end|>"
    assert got[1, "chosen", 2].loss_start is None and got[1, "prompt", 0].loss_end is None
    empty = few.createDataFrame([], kind)
    assert preferences.format_preferences(empty, empty).count() == 0
    assert preferences.with_foreign_reply(empty.withColumnRenamed("pair_id", "conv_id")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(few, name):
    sys.path.insert(0, str(ROOT / "tools"))
    import compare

    compare.QUERIES[name] = queries.QUERIES[name]
    try:
        assert compare.difference(few, compare.connect(SF), SF, name, queries.SQL[name]) is None
    finally:
        del compare.QUERIES[name]


def brute_pipeline(few):
    """The rows that reach packing, stage by stage on plain lists."""
    docs = few.read.parquet(f"{SF}/documents.parquet")
    ranker = preference.learn(docs, few.read.parquet(f"{SF}/labels.parquet"), where=corpus_pipeline.ids_crc_mod3() != 1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r, s in zip(rows, ranker.score(np.array([preference.features(t) for _, t in rows])), strict=True) if s >= 0.5]
    kept = brute_components(rows)
    rows = [r for r in rows if kept[r[0]][1] == r[0]]
    bad = {i for i, _ in brute_leaks(rows, [(r.item_id, r.text) for r in few.read.parquet(f"{SF}/benchmark.parquet").limit(5).collect()])}
    verbatim = [" ".join(r.text.lower().split()) for r in few.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = decontaminate.leaks(few.createDataFrame(rows, "doc_id long, text string"), few.read.parquet(f"{SF}/benchmark.parquet"))
    named = {r.doc_id for r in leaks.collect()}
    assert bad <= named and {i for i, t in rows if any(v in " ".join(t.lower().split()) for v in verbatim)} <= named
    rows = [r for r in rows if r[0] not in named]
    return [(i, secrets._masked(t, secrets.spans_of([t])[0], "[SECRET]")) for i, t in rows]


def test_pipeline_equals_brute_force(few):
    got = corpus_pipeline.run(few, SF).collect()
    want = brute_pipeline(few)
    assert {r.doc_id for r in got} == {i for i, _ in want}
    check_packing(got, want, most_padding=2048)


def test_stages_on_odd_and_empty_rows(few, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(few, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
            n = out.count()
            assert n == 0 if docs is empty else n > 0, name
    kept = corpus_pipeline.near_duplicates(few, edge, SF)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter([None, None, 1, 2, 3, 4, 6, 8, 9])
    assert len(ROWS) == 12


def test_rows_of_one_id_are_judged_by_their_own_text(few):
    """A text of its own stays whatever else its id holds; of a group one row stays, repeated rows too."""
    own = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "red orange yellow green blue indigo violet grey"]
    rows = [(1, own[0], "a"), (1, own[1], "b"), (2, own[1], "c"), (2, own[2], "d"), (2, own[2], "e"), (3, own[2] + " ", "f"), (4, "", "g"), (4, "", "h"), (None, own[0], "i")]
    docs = few.createDataFrame(rows, "doc_id long, text string, source string")
    kept = setsketch.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.source for r in kept.collect()) == ["a", "b", "d", "g", "h", "i"]


def test_html_comments_and_nested_hidden_elements():
    text = lambda html: [n.text for n in dom.parse(html) if n.text]
    assert text("<p>a</p><!--><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert text("<p>a</p><!---><p>b</p>") == ["a", "b"]
    assert text("<p>a</p><!-- x --!><p>b</p><!-- y --><p>c</p><!-- z") == ["a", "b", "c"]
    assert text("<object>x<object>y</object>z</object><p>a</p>") == ["a"]
    assert text("<svg><g/><svg/>q</svg><p>a</p><script>if (a < b) '</scripty>'</SCRIPT ><p>b</p>") == ["a", "b"]
    assert text("<div><p>a</div></p></span></div><p>b</p>") == ["a", "b"]


def test_many_stray_tags_take_linear_time():
    import time

    spent = []
    for n in (4_000, 32_000):
        page = "<div>" * n + "</section>" * n + "<p>end</p>" + "</div>" * n
        start = time.perf_counter()
        assert [x.text for x in dom.parse(page) if x.text] == ["end"]
        spent.append(time.perf_counter() - start)
    assert spent[1] < 24 * spent[0]
