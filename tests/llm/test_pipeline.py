"""The pipeline: every stage on what its predecessor kept, against brute force."""

import hashlib

import pyspark.sql.functions as F

import corpus_pipeline as p
from tessera.llm.common import stored
from tests.llm.test_exact import ALNUM, A, by_hand, hash_by_hand
from tests.llm.by_hand import components_by_hand


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in p.STAGES:
        new = stored(stage(spark, docs, sf))
        results.append((name, docs, new))
        docs = new
    for name, before, after in results[:-1]:
        assert after.columns == columns, name
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    _, before, after = results[1]
    fps = {i: hash_by_hand(t) for i, t in texts(before).items()}
    assert set(texts(after)) == set(components_by_hand(fps).values())

    _, before, after = results[2]
    want = by_hand(list(texts(before).items()), 50)
    got = texts(after)
    assert set(got) == set(want)
    same = [hashlib.sha256(got[i].encode()).hexdigest() == want[i][3] for i in got]
    assert sum(same) >= len(same) - 5  # a cut within a character leaves out its other bytes
    assert all(want[i][0] - want[i][1] - len(got[i].encode()) in range(0, 4 * want[i][2] + 1) for i in got)
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0

    _, before, after = results[3]
    items = [ALNUM.findall(r.text.translate(A)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items for k in range(max(1, len(w) - 12)) if w}
    for i, t in texts(before).items():
        v = ALNUM.findall(t.translate(A))
        hit = {q for n in {len(w) for w in windows} for k in range(len(v) - n + 1) if tuple(v[k : k + n]) in windows for q in range(k, k + n)}
        assert (i in texts_of(after)) == (not (hit and 20 * len(hit) >= len(v)))

    _, before, after = results[4]
    assert after.where("not round_trip").count() == 0 and after.count() == before.count()
    run = {r.doc_id: r.n_tokens for r in p.run(spark, sf).collect()}
    assert run == {r.doc_id: r.n_tokens for r in after.collect()}


_SEEN: dict = {}


def texts_of(df):
    if id(df) not in _SEEN:
        _SEEN[id(df)] = {r.doc_id for r in df.select("doc_id").collect()}
    return _SEEN[id(df)]


def test_classifier_decides(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality(spark, docs, sf).select("doc_id").join(labels, "doc_id")
    good, bad = (labels.where(f"quality = {y}").count() for y in (1, 0))
    assert kept.where("quality = 1").count() >= 0.95 * good and kept.where("quality = 0").count() <= 0.4 * bad


def test_tables_that_are_empty_or_odd(spark, sf, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], empty.schema)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0
        stage(spark, odd, sf).count()


def test_extra_columns_pass_through(spark, sf):
    """Columns beside doc_id and text, named as the operators name their own, come out as they went in."""
    extra = "row string, score double, held_out boolean, words array<string>, bucket int, block int, key string, sha string, kept string, fp long, h long, n long, part int, found string, token string, text_hash long, none boolean, others string"
    rows = [(1, "Some words that are not repeated at all, and quite a few of them, as it happens. " * 3), (2, None), (3, ""), (None, "no id"), (4, "x " * 300), (4, "x " * 300), (5, "tie " * 40), (6, "tie " * 40)]
    values = ("r", 0.5, True, ["w"], 1, 2, "k", "s", "kept", 3, 4, 5, 6, "f", "t", 7, False, "o")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), *values) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == values for r in out.collect()), name
    out = p.STAGES[-1][1](spark, docs, sf)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and out.count() == len(rows)
    assert sorted(str(r.doc_id) for r in p.near_duplicates(spark, docs, sf).collect()) == ["1", "2", "4", "4", "5", "None"]
