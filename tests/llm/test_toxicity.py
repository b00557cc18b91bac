"""The toxicity classifier: held-out accuracy, the fast scorer against the training code, edge rows."""

import numpy as np
import pytest

from geoloom.llm import toxicity as tx

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = tx.report(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert scored and docs.count() == tx.report(spark, FOLDER).count()
    hit = [r.predicted for r in scored if r.toxic == 1]
    flagged = [r.toxic for r in scored if r.predicted == 1]
    assert np.mean(flagged) > 0.8 and np.mean(hit) > 0.6
    assert all(0 <= r.score <= 1 for r in scored)


def test_scorer_equals_training_code(monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = [f"wort{k}" for k in range(200)] + ["badword", "badly"]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))) for _ in range(80)]
    labels = [int("bad" in t) for t in texts]
    model = tx.fit(texts, labels, ["en"] * 80)
    number = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in tx.words(t)]) for t in [*texts, ""]]
    want = tx._logits(model, coded, tx.hashed(list(number)))
    monkeypatch.setattr(tx, "CACHE", 90)
    scorer = tx.Scorer(model)
    assert [scorer.logit(t) for t in [*texts, ""]] == pytest.approx(want.tolist(), abs=1e-3)
    long = " ".join(["wort1"] * 70000 + ["badword"])
    assert scorer.logit(long) == pytest.approx(scorer.logit("wort1 wort1 wort1 badword"), abs=1e-3)


def test_plain_convolution():
    """One word after the other, one filter after the other, against the fast scorer."""
    rng = np.random.default_rng(3)
    model = tx._new_model(rng)
    model.offset[0] = 0.3
    model.bias = rng.normal(0, 0.1, len(model.bias))
    scorer = tx.Scorer(model)
    for text in ("", "one", "one two", "Some words, and more words: ÀÉ 12", "a b c d e f g h i j k " * 9):
        ws = tx.words(text)
        emb = [np.mean([model.table[b] for b in tx.hashed([w])[0]], axis=0) for w in ws] + [np.zeros(tx.DIMS)] * (max(tx.WIDTHS) - 1 + (not ws))
        pooled = []
        for f in model.filters:
            width = f.shape[1]
            for one in f:
                pooled.append(max(sum(float(one[j] @ emb[i + j]) for j in range(width)) for i in range(max(1, len(ws)))))
        want = sum(max(0.0, x + b) * w for x, b, w in zip(pooled, model.bias, model.weights)) + 0.3
        assert scorer.logit(text) == pytest.approx(want, abs=1e-4)


def test_pieces_hold_the_largest_answers():
    model = tx._new_model(np.random.default_rng(4))
    scorer = tx.Scorer(model)
    text = " ".join(f"w{k % 977}" for k in range(80_000)) + " rare end"
    best, _ = scorer.pooled(tx.words(text))
    pieces = scorer.pieces(text)
    again = np.max([scorer.pooled(tx.words(p.decode()))[0] for p in pieces], axis=0)
    assert np.allclose(best, again, atol=1e-5) and sum(len(p.split()) for p in pieces) < 18 * 12


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", 9.0), (2, "", None, 9.0), (None, "some words", "en", 9.0), (2, "", None, 9.0)],
        "doc_id long, text string, lang string, score double",
    )
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = tx.score_documents(docs, model).collect()
    assert len(got) == 4 and {r.score for r in got} <= {0.0, 1.0}
    none = labels.where("false")
    assert tx.score_documents(docs.where("false"), tx.train(docs, none)).collect() == []
    texts = [f"word{k} nice" for k in range(10)] + [f"word{k} awful" for k in range(10)]
    model = tx.fit(texts, [0] * 10 + [1] * 10, [None] * 20)
    got = tx.score_documents(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 4


def test_cut_weighs_missed_and_wrong_rows_alike():
    # cut at 3: all 4 hits of 4; cut at 1: 6 of 8 rows are hits (F1 0.857 against 0.8, F0.5 the other way)
    y = np.array([0] * 4 + [1, 0, 1, 0, 1, 1, 1, 1])
    z = np.array([-4.0, -3, -2, -1, 1, 1.5, 2, 2.5, 3, 4, 5, 6])
    assert 0 < 1 - tx.best_cut(z, y) < 2


def test_long_texts_train_and_calibrate(spark):
    rows = [(k, f"word{k} {'awful' if k % 2 else 'nice'} end", "en") for k in range(120)]
    # a toxic word that only long texts have
    long = [(1000 + k, " ".join(["plain"] * 5000) + (f" dreadful thing{k} " if k % 2 else " ") + "plain " * 50, None) for k in range(60)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in rows + long], "doc_id long, toxic int")
    assert all(len(t) > tx.WHOLE_CHARS for _, t, _ in long)
    model = tx.train(docs, labels)
    held = tx.long_rows(docs, labels, model)
    trained = tx.long_pieces(docs, labels, model)
    assert len(held) + len(trained) == sum(tx.zlib.crc32(str(r[0]).encode()) % 3 != 1 for r in long) and len(held) > 2
    assert any(b"dreadful" in p for pieces, label in trained for p in pieces if label)
    alone = tx.fit([t for _, t, _ in rows], [k % 2 for k, _, _ in rows], ["en"] * len(rows))
    gain = [tx.Scorer(m).logit("plain dreadful plain") - tx.Scorer(m).logit("plain plain plain") for m in (alone, model)]
    assert gain[1] > gain[0]


@pytest.mark.parametrize("rows", [40, 3400])
def test_folds_do_not_depend_on_the_size(monkeypatch, rows):
    """Every row calibrates once by a model that has not seen it, and the model learns from all rows."""
    trained = []

    def train(coded, feats, y, used, seed, model=None):
        trained.append(set(used.tolist()))
        return tx._new_model(np.random.default_rng(seed))

    monkeypatch.setattr(tx, "_train", train)
    tx.fit([f"word{k % 7}" for k in range(rows)], [k % 2 for k in range(rows)], ["en"] * rows)
    every = set(range(rows))
    assert len(trained) == 6 and trained[-1] == every
    left = [k for used in trained[:-1] for k in every - used]
    assert len(left) == rows and set(left) == every
