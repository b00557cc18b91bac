"""Repeated strings against brute force, and the suffix order against plain sorting."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from geoloom.llm import suffixdedup as sd


def brute(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    def words(n, alphabet="abcdé \n"):
        return "".join(rng.choice(list(alphabet), n))

    passage, other = words(90), words(45)
    texts = [None, "", "a" * 200, "ab" * 80, passage, words(60) + passage[10:70] + words(50), passage + words(30)]
    texts += [words(40) + passage[:55] + words(20) + other, other[:30] + words(80), words(300)]
    base = words(200)
    for k in range(12):
        texts.append(base[:k * 9] + "X" + base[k * 9 :])
    return texts + [base, base, words(30), "\x00" * 50 + words(40)]


@pytest.mark.parametrize("group", [512, 5, 1])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    rng = np.random.default_rng(11)
    texts = corpus(rng)
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    got = sd.measure_repeats(spark.createDataFrame(rows, "doc_id long, text string, k1 string").repartition(3), window=24, gram=6).collect()
    want = brute([(t or "").encode() for t in texts], 24)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        (i if i != 3 else None): w for i, w in enumerate(want)
    }


def brute_passages(texts, n):
    """(words inside passages of n words seen more than once, their maximal runs) of each text."""
    read = [t.encode().split() if t else [] for t in texts]
    seen = Counter(tuple(ws[i : i + n]) for ws in read for i in range(len(ws) - n + 1))
    out = []
    for ws in read:
        gone = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if seen[tuple(ws[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))))
    return out


@pytest.mark.parametrize("group", [512, 2])
def test_passages_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    rng = np.random.default_rng(12)

    def prose(n, k=400):
        return "".join(f"w{x}{rng.choice([' ', '  ', chr(10), chr(9)])}" for x in rng.integers(0, k, n))

    passage = prose(60)
    texts = [None, "", " ", passage, prose(50) + " ".join(passage.split()) + " " + prose(40), prose(90), "x " * 70, "y " * 12, "y " * 13]
    texts += [prose(30) + " ".join(passage.split()[k : k + 14]) + " " + prose(30) for k in range(0, 40, 3)] + [prose(200, 3), prose(150, 3)]
    base = prose(120).split()
    texts += [" ".join(base[: k * 9] + ["X"] + base[k * 9 :]) for k in range(10)] + [" ".join(base)] * 2
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3)
    got = {r.doc_id: (r.n_passage_words, r.n_passage_spans) for r in sd.measure_repeats(docs, window=4000, words=13).collect()}
    want = brute_passages(texts, 13)
    assert got == {(i if i != 3 else None): w for i, w in enumerate(want)} and sum(w > 0 for w, _ in want) > 20
    kept = {r.doc_id: r.text for r in sd.remove_passages(docs, 13).collect()}
    for i, (t, (gone, _)) in enumerate(zip(texts, want)):
        left = kept[i if i != 3 else None]
        assert left == t if not gone else len(left.split()) == len(t.split()) - gone


def test_long_document_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 500)
    rng = np.random.default_rng(2)
    part = "".join(rng.choice(list("abcdef"), 700))
    texts = [part + "".join(rng.choice(list("abcdef"), 900)), "zz" + part[100:650], part[300:420]]
    out = []
    data = [t.encode() for t in texts]
    for doc, p, run, *_ in sd.stretches(b"".join(data), np.cumsum([0] + [len(x) for x in data[:-1]]), np.cumsum([len(x) for x in data]), 24, 6):
        out += [(int(d), int(a) + k) for d, a, r in zip(doc, p, run) for k in range(r)]
    assert sorted(out) == [(d, i) for d, x in enumerate(data) for i in range(len(x) - 23)]


def test_suffix_order():
    rng = np.random.default_rng(7)
    for alphabet in (b"ab", b"\x00a\xff", bytes(range(1, 200))):
        parts = [bytes(rng.choice(list(alphabet), int(rng.integers(20, 60))).astype(np.uint8)) for _ in range(15)] + [b"a" * 40, b"a" * 33]
        runs = [len(x) - 15 for x in parts]
        masks = sd.repeated_starts(parts, runs, 16)
        seen = Counter(x[i : i + 16] for x, r in zip(parts, runs) for i in range(r))
        for x, r, m in zip(parts, runs, masks):
            assert m.tolist() == [seen[x[i : i + 16]] > 1 for i in range(r)]


def test_clashing_names(spark):
    rows = [(k, f"{k} " + "same words " * 60, *["own"] * 6) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n1 string, __N2 string, _k1 string, k2 string, spans string, code string")
    for cut in (sd.remove_repeats(docs), sd.remove_passages(docs, 51)):
        assert cut.columns == docs.columns
        assert all(list(r)[2:] == ["own"] * 6 and len(r.text) < 20 for r in cut.collect())


def test_remove_and_empty(spark):
    df = spark.createDataFrame([(1, "é" * 30 + "tail", 5), (2, "é" * 30 + "more", 6), (3, None, 7)], "doc_id long, text string, spans int")
    got = {r.doc_id: (r.text, r.spans) for r in sd.remove_repeats(df, window=24, gram=6).collect()}
    assert got == {1: ("tail", 5), 2: ("more", 6), 3: (None, 7)}
    assert sd.measure_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
