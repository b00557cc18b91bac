"""SimHash groups against brute force over all pairs."""

import numpy as np
import xxhash

from geoloom.llm import simhash as sh
from geoloom.plans.components import components


def plain_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (f"{f:016x}", label[i]) for i, f in fps}


def small_corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}é" for k in range(300)]
    base = [" ".join(rng.choice(vocabulary, 150)) for _ in range(25)]
    texts = [None, "", " \n", "One", "one", "one two", "x" * 5000]
    for t in base:
        ws = t.split(" ")
        for k in range(4):
            other = list(ws)
            for p in rng.integers(0, len(ws), k):
                other[p] = "changed"
            texts.append(" ".join(other))
    return list(enumerate(texts + base[:5]))


def test_components_of_documents(spark):
    rows = small_corpus()
    got = sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == plain_components(rows)


def test_plans_lose_no_link(spark):
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63, 40)}
    for x in list(fps):
        for n in (1, 2, 3, 4, 4, 4, 5):
            y = x & (2**64 - 1)
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.add(y - 2**64 if y >= 2**63 else y)
    fps = sorted(fps)
    want = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and want[b] < want[a]:
                    want[a], changed = want[b], True
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for plan in sh.PLANS:
        got = {r.node: r.root for r in components(sh.near_links(df, plan=plan)).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_crowded_anchor(spark, monkeypatch):
    monkeypatch.setattr(sh, "HOMES", 3)
    fps = [5, 7, 4, 6, 13, 12, 14, 1 << 40, (1 << 40) + 1, 0x7FFF000000000000]
    got = {r.node: r.root for r in components(sh.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    assert {got.get(x) for x in fps[:9]} == {4} and got.get(fps[9], fps[9]) == fps[9]


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicates(empty).collect() == []
    same = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "y"), (9, None, "z")],
                                 "doc_id long, text string, component_id string")
    assert sorted(r.component_id for r in sh.near_duplicates(same).collect()) == [1, 1, 1, 9]
    assert sorted((r.doc_id, r.component_id) for r in sh.keep_one(same).collect()) == [(1, "x"), (9, "z")]


def test_keep_one_judges_rows_apart(spark):
    rows = [(1, "a b c d e"), (1, "quite other words in this text"), (1, "a b c d e"), (2, "a b c d e"), (None, "x y z"), (None, "p q r s t u v"), (None, "x y z")]
    got = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[5]]))
