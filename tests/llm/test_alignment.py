"""Cross-tokenizer alignment against whole-text encoding and plain counting."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import alignment as al

FILES = [open(f"{al.TOKENIZERS}/{f}", "rb").read() for f in (al.SIDE_A, al.SIDE_B)]
HARD = [
    None, "", " ", "  two  spaces ", "a", "tab\tand\nlines\r\n\n", "x" * 3000, "no cut é à ñ", "ﬁ ² é 　 ​ ﻿ \x00 \x1f \x85", "▁ a", "<s> </s> <unk> <0x41> <|endoftext|>",
    "don't 's it's I'll 'll", "emoji 👩‍👩‍👧 漢字 العربية हिन्दी", "1234 5678 9.5", "end ", "same same same same", "same same same same", "[x] (y) {z} !! ?? ..", "À É ɏ ɐ ×÷ á b",
]


@pytest.fixture(scope="module")
def encoder():
    return al.Encoder(*FILES, fast=True)


def plain(encoder, text):
    """(ids of A, ids of B, groups) of a text encoded as a whole; None without tokens."""
    if not text:
        return None
    a, b = encoder.a.encode(" " + text, add_special_tokens=False).ids, encoder.b.encode(text)
    sides = [[encoder.a_bytes[i] for i in a], [encoder.b_bytes[i] for i in b]]
    if any(b"".join(s) != (" " + text).encode() for s in sides):
        return None
    groups, i, j, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a += len(sides[0][i])
            now[0].append(a[i])
            i += 1
        else:
            at_b += len(sides[1][j])
            now[1].append(b[j])
            j += 1
        if at_a == at_b:
            groups.append(now)
            now = ([], [])
    return a, b, groups


def brute(encoder, texts):
    read = [plain(encoder, t) for t in texts]
    links = [Counter((x, y) for a, b in r[2] for x in a for y in b) if r else Counter() for r in read]
    count = Counter(p for c in links for p in c)
    best: dict = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for r, c in zip(read, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in r[2]) if r else ""
        out.append((
            len(r[0]) if r else 0, len(r[1]) if r else 0, len(r[2]) if r else 0, sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(shown.encode()).hexdigest() if r else "",
        ))
    return out, {(x, y, n, n == best[x]) for (x, y), n in count.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limits", [{}, {"spill": 2000, "fan": 2, "met_bytes": 5000}])
def test_align(spark, encoder, limits):
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, n_a string, k int")
    want, pairs = brute(encoder, texts)
    rows, counted = al.align(docs.repartition(3), **limits)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, (tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in rows.collect()))) == sorted(
        key((k if k % 7 else None, *w)) for k, w in enumerate(want)
    )
    assert {tuple(r) for r in counted.select("a_id", "b_id", "n_docs", "best").collect()} == pairs
    assert all(w[0] > 0 for w, t in zip(want, texts) if t and "▁" not in t)


def test_long_texts_and_few_kept_pieces(encoder, monkeypatch):
    monkeypatch.setattr(al, "SEGMENT", 64)
    monkeypatch.setattr(al, "PIECES", 30)
    pieces = al._Pieces(encoder)
    text = "some words that go on and on, " * 40 + "x" * 500
    marks, digest, keys, links = al.align_text(pieces, text)
    (want,), _ = brute(encoder, [text])
    assert (*marks.tolist(), digest) == (*want[:4], want[-1]) and links.sum() == want[3]


@given(st.text(st.sampled_from(" aé.'1x\n\t-Ñ字"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_as_the_whole(text):
    encoder = _shared()
    found = al.align_text(al._Pieces(encoder), text)
    want = plain(encoder, text)
    shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want[2]) if want else ""
    assert (found is None) == (want is None) and (found is None or found[1] == hashlib.sha256(shown.encode()).hexdigest())


_kept = []


def _shared():
    if not _kept:
        _kept.append(al.Encoder(*FILES, fast=True))
    return _kept[0]


def test_both_engines_agree(encoder):
    assert al.agrees(FILES[0])
    own = al.Encoder(*FILES)
    assert own.quick is None and encoder.quick is not None
    chars = [chr(c) for c in range(1, 0x300)]
    texts = [f for c in chars for f in (c, f"a{c}b", f"a {c}1", f"{c}{c} {c}", f"1{c} ")] + ["don't we'll I'VE", "x" * 700, "字 a", "\u1c89 \ua7cb"]
    for ours, theirs in zip(own.a_ids(texts), encoder.a_ids(texts)):
        assert (ours == theirs).all()
    beside, other = encoder.beside(texts)
    assert sorted(beside + other) == sorted(texts) and own.beside(texts) == ([], texts)
    assert len(beside) > 1000 and all((x == y).all() for x, y in zip(own.a_ids(beside), encoder.joined_ids(beside)))


def test_large_groups(encoder, monkeypatch):
    text = "ab字" * 50 + " one two " + "\u1c89" * 40 + "été" * 30
    (want,), _ = brute(encoder, [text])
    for large in (0, 3, 10**9):
        monkeypatch.setattr(al, "LARGE", large)
        marks, digest, keys, links = al.align_text(al._Pieces(encoder), text)
        assert (*marks.tolist(), digest) == (*want[:4], want[-1]) and links.sum() == want[3] and len(keys) == len(links)


def test_merge_of_many_runs():
    import numpy as np

    rng = np.random.default_rng(3)
    total, runs = Counter(), []
    for _ in range(9):
        ids = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (200, 2))})
        rows = np.array([(a, b, n) for (a, b), n in zip(ids, rng.integers(1, 9, len(ids)))], dtype=al._ENTRY)
        total.update({(a << al._ID_BITS) | b: int(n) for a, b, n in rows.tolist()})
        runs.append(al._packed(rows))
    assert list(al.merged(runs)) == sorted(total.items())
    assert list(al.read_entries(runs[0], at_once=3)) == list(al.read_entries(runs[0]))


def test_empty_table(spark):
    rows, counted = al.align(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.collect() == [] and counted.collect() == []
