"""Language identification: held-out accuracy, plain scoring, hard rows."""

import zlib

import numpy as np
import pytest

from geoloom.llm import langid as li

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(docs):
    return li.train(docs)


def test_held_out_accuracy(spark, docs, model):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in li.report(spark, FOLDER).collect() if r.held_out]
    assert {r.doc_id for r in rows} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    sure = [r for r in rows if not r.rejected]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert len(sure) > 0.9 * len(rows) and sum(r.lang_pred == lang[r.doc_id] for r in sure) >= 0.98 * len(sure)


def test_scores_are_the_plain_means(docs, model):
    scorer = li.Scorer(model)
    for r in docs.limit(30).collect():
        words = li._WORD.findall((r.text or "").lower())
        if not words:
            assert scorer.logits(r.text) is None
            continue
        mean = np.mean([np.mean([model.table[b] for kind, _ in li.subwords([w]) for b in kind], axis=0) for w in words], axis=0)
        assert np.allclose(scorer.logits(r.text), mean @ model.weights + model.bias, atol=1e-3)


def test_subwords_do_not_depend_on_their_neighbours():
    words = ["a", "über", "maison", "字", "of", "x" * 50]
    together = li.subwords(words)
    for k, w in enumerate(words):
        for (all_of, n), (alone, m) in zip(together, li.subwords([w])):
            first = int(n[:k].sum())
            assert n[k] == m[0] and (all_of[first : first + n[k]] == alone).all()
    assert [int(n[0]) for _, n in together] == [1, 2, 1, 0] and [int(n[2]) for _, n in together] == [1, 7, 6, 5]


def test_long_texts_are_read_whole(model, monkeypatch):
    text = "le mot juste " * 300 + "the end of it " * 300
    whole = li.word_counts(text)
    monkeypatch.setattr(li, "SEGMENT", 50)
    assert li.word_counts(text) == whole


def test_gradient_learns_and_calibrates():
    rng = np.random.default_rng(1)
    texts, langs = [], []
    for k in range(400):
        lang = "ab"[k % 2]
        ws = rng.choice(["foo", "bar", "baz"] if lang == "a" else ["qux", "zap", "bar"], 6)
        texts.append({w: int(c) for w, c in zip(*np.unique(ws, return_counts=True))})
        langs.append("a" if k % 10 == 3 else lang)  # a fifth of the labels of b is wrong
    model = li.fit(texts, langs)
    shares = model.shares(li._logits(model, li.Bags([{"foo": 2, "baz": 1}, {"qux": 3}]), [0, 1]))
    assert shares[0, 0] > 0.9 and 0.6 < shares[1, 1] < 0.95


def test_hard_rows(spark, model):
    rows = [(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "12 34 !?", "x", 1.0), (4, "the house of the", "x", 1.0), (4, "the house of the", "x", 1.0), (None, "la maison", "x", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, found_0 double")
    got = li.identify(table, model).collect()
    assert [r.found_0 for r in got] == [1.0] * 6
    by = {}
    for r in got:
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, set()).add((r.lang_pred, r.score, r.rejected))
    assert by[1] == by[2] == by[3] == {("und", 0.0, True)} and len(by[4]) == 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = li.train(empty)
    assert li.identify(empty, none).collect() == [] and {r.lang_pred for r in li.identify(table, none).collect()} == {"und"}
    one = li.train(spark.createDataFrame([(k, "a word", "xx") for k in range(20)], "doc_id long, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in li.identify(table, one).collect()} == {("und", 0.0), ("xx", 1.0)}
