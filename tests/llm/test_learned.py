"""Learnt scores on rows that were held out, and their odd cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from tessera.llm import queries as llm
from tessera.llm.quality_classifier import STATISTICS, Ensemble, Condition, accepted, fit, lasso, quality_classifier
from tessera.llm.toxicity import EXAMPLES, MARKED, Index, examples_of, terms_found, terms_of, toxicity
from tests.llm.test_exact import ODD, docs_of


def auc(spark, name, label, sf="/root/testdata/sf0.1"):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = llm.queries()[name](spark, sf).where("held_out").join(labels, "doc_id").select("score", label).collect()
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    rank = np.array([(s < x).sum() + ((s == x).sum() + 1) / 2 for x in s])
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality(spark):
    assert auc(spark, "op1_quality_classifier", "quality") > 0.99


def plain_statistics(t):
    """STATISTICS of a text, by plain Python."""
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    share = lambda a, b: a / b if b else 0.0
    n, count = len(w), lambda p: len(regex.findall(p, t))
    distinct = share(len(set(w)), n)
    return [
        n, share(len(t), n), distinct, distinct * (max(n, 1) / 300) ** 0.25, share(count(r"[#*$%&|<>]"), n), share(t.count("|"), n), share(count(r"\p{Lu}"), len(t)), share(count("[0-9]"), len(t)), share(t.count("!"), n), share(count("[.,;:?]"), n),
        1 - len(set(lines)) / len(lines), share(n, len(lines)), share(sum(a == b for a, b in zip(w, w[1:])), n),
    ]


def test_the_whole_quality_query_against_plain_python(spark, sf):
    """Statistics, the choice of rows to learn from, and every score."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    learnt = sorted(i for i, q in labels.items() if q is not None and not out(i) and i in texts)
    e = fit(np.array([plain_statistics(texts[i]) for i in learnt], float), np.array([labels[i] for i in learnt], float))
    x = {i: np.array([plain_statistics(t)], float) for i, t in texts.items()}
    got = {r.doc_id: r for r in llm.queries()["op1_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(texts) and e.rules
    for i, row in got.items():
        z = e.intercept + sum(w * np.logical_and.reduce([t.on(x[i]) for t in r])[0] for w, r in e.rules)
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and row.predicted == int(row.score >= 0.3) and row.held_out == out(i), i


def test_toxicity(spark):
    assert auc(spark, "op4_toxicity", "toxic") > 0.93


LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.mark.parametrize("labels", [[], [(i, 1, 0, "x") for i in range(20)], [(None, 1, 1, ""), (1, None, None, ""), (4, 0, 1, ""), (4, 1, 0, ""), (7, 1, 0, "")]])
def test_odd_rows(spark, labels):
    docs, given = docs_of(spark, ODD), spark.createDataFrame(labels, LABELS)
    for found in (quality_classifier(docs, given), toxicity(docs, given)):
        rows = found.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    empty = docs_of(spark, [])
    assert quality_classifier(empty, given).count() == toxicity(empty, given).count() == 0
    assert accepted(docs, given).columns == docs.columns


def test_block_bounds_lose_no_neighbour():
    rnd = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), sorted(rnd.choice(40, rnd.integers(1, 6), replace=False).tolist()), None) for i in range(500)]
    rows = [(i, y, t, rnd.integers(1, 5, len(t)).tolist()) for i, y, t, _ in rows]
    index = Index(rows, rnd.random(40) + 0.5, block=8, long=20)
    assert 0 < len(index.most) < 40 and index.blocks == 63
    full = index.weights[:, : len(index.ids)]
    for _ in range(50):
        term = sorted(rnd.choice(40, 4, replace=False).tolist())
        tf = rnd.integers(1, 4, 4).tolist()
        cosine = (index.unit(term, tf) @ full[term]).round(12)
        want = np.lexsort((index.ids, -cosine))[:9]
        want = want[cosine[want] > 0]
        (at, got), (less, _) = index.nearest([(term, tf, 0.0)] * 2, 9, [None, index.ids[want[0]]])
        assert less.tolist()[:8] == want.tolist()[1:]
        assert at.tolist() == want.tolist() and np.allclose(got, cosine[want])


def test_the_whole_query_against_plain_cosines(spark, sf):
    """Every text's score and evidence from all cosines, computed one by one from the definition."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chosen = examples_of(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), "toxic", EXAMPLES)
    words, marked = terms_found(chosen)
    learnt = {r.doc_id: (r.text, r.y) for r in chosen.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    begins = {t for t in marked if t.endswith("*")}
    counts = {i: {t: n for t, n in terms_of(x).items() if not t.endswith("*") or t in begins} for i, x in texts.items()}
    known, held = set(words) | begins, Counter(t for c in counts.values() for t in c)
    idf = lambda t: (math.log((len(texts) + 1) / (held[t] + 1)) + 1e-6) * (MARKED if t in marked else 1.0) if t in known else math.log((len(texts) + 1) / 2)

    def vector(c):
        w = {t: (1 + math.log(n)) * idf(t) for t, n in c.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    vectors = {i: vector(c) for i, c in counts.items()}
    got = {r.doc_id: r for r in llm.queries()["op4_toxicity"](spark, sf).collect()}
    assert marked and set(got) == set(texts)
    for i, v in vectors.items():
        cosines = [(round(sum(x * vectors[j].get(t, 0.0) for t, x in v.items()), 12), j) for j in learnt if j != i]
        near = sorted((-c, j) for c, j in cosines if c > 0)[:9]
        weight = [c * c / (1.05 - min(-c, 1.0)) for c, _ in near]
        want = 0.005 + 0.995 * sum(w * learnt[j][1] for w, (_, j) in zip(weight, near, strict=True)) / (sum(weight) + 0.8)
        assert got[i].score == pytest.approx(want, abs=1e-6), i
        assert [round(c, 6) for c, _ in near] == pytest.approx([round(-dict((j, c) for c, j in cosines)[j], 6) for j in got[i].evidence], abs=2e-6), i


def test_all_words_and_clean_examples_count(spark):
    """No word here is marked: examples are found all the same, clean ones too."""
    rows = [(i, f"quiet{i} river stones moss bank") for i in range(40)] + [(i, f"vile{i} curse spit hate mob") for i in range(40, 44)]
    labels = [(i, 1, int(i >= 40), "") for i, _ in rows]
    rows += [(100, "quiet7 river bridge"), (101, "vile42 curse"), (102, "nothing shared")]
    got = {r.doc_id: r for r in toxicity(docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    learnt = {i for i, *_ in labels if not got[i].held_out}
    assert set(got[100].evidence) <= learnt & set(range(40)) and len(got[100].evidence) == 9 and got[100].score == pytest.approx(0.005)
    assert set(got[101].evidence) == learnt & set(range(40, 44)) and got[101].score > 0.1
    assert got[102].evidence == [] and got[102].score == 0.005


def test_lasso_keeps_what_matters():
    rnd = np.random.default_rng(2)
    z = (rnd.random((2000, 12)) < 0.5).astype(float)
    y = (rnd.random(2000) < 1 / (1 + np.exp(-(4 * z[:, 3] - 2)))).astype(float)
    _, w = lasso(z, y, 0.02)
    assert abs(w[3]) > 1 and (np.abs(np.delete(w, 3)) < 0.1).all()


def test_compiled_rules_are_the_rules(spark):
    rnd = np.random.default_rng(3)
    x = rnd.random((600, len(STATISTICS)))
    y = ((x[:, 4] > 0.6) & (x[:, 1] <= 0.5)).astype(float)
    e = fit(x, y)
    z = e.intercept + sum(w * np.logical_and.reduce([t.on(x) for t in r]) for w, r in e.rules)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *STATISTICS])
    got = [r[0] for r in df.orderBy("i").select(e.column()).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((np.array(got) > 0.5) == y).mean() > 0.98
    assert Ensemble(0.0, ((1.0, (Condition(0, True, 0.5),)),)).column() is not None
