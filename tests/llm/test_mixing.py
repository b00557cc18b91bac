"""Pfair mixing: deviation below one block from the exact targets at every slot, whole rows, edge tables."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from geoloom.llm import mixing as mx

WEIGHTS = [
    {"a": 1.0}, {"a": 5, "b": 3}, {"a": 0.9999, "b": 0.0001}, {"a": 1 / 3, "b": 2 / 3}, {"a": 0.7, "b": 0.2999, "c": 0.0001}, {"x": 0.1, "y": 0.2, "z": 0.7},
    {str(k): 1 + k % 7 for k in range(60)}, {**{f"A{k}": 0.001 for k in range(500)}, **{f"B{k}": 1 / 60 for k in range(30)}},
    {str(k): float(n) ** 0.5 for k, n in enumerate(np.random.default_rng(1).integers(1, 10**6, 40))},
]


def worst_deviation(weights, order):
    """Largest distance of a source from its exact share after any slot.

    Between its own blocks a source's distance moves one way, so the slots before and after them show the largest.
    """
    total = sum(map(Fraction, weights.values()))
    places = defaultdict(list)
    for t, s in enumerate(order):
        places[s].append(t)
    worst = Fraction(0)
    for s, w in weights.items():
        share = Fraction(w) / total
        for k, t in enumerate(places[s]):
            worst = max(worst, abs(share * t - k), abs(share * (t + 1) - (k + 1)))
        worst = max(worst, abs(share * len(order) - len(places[s])))
    return worst


@pytest.mark.parametrize("weights", WEIGHTS)
def test_exact_targets(weights):
    n = 3000 if len(weights) > 100 else 20_000
    order = [s for s, _, _ in mx.Schedule(mx.whole_shares(weights)).slots(0, n)]
    assert worst_deviation(weights, order) < 1


def test_a_million_slots():
    for weights in ({"a": 0.9999, "b": 0.0001}, {"a": 1 / 3, "b": 2 / 3}):
        order = [s for s, _, _ in mx.Schedule(mx.whole_shares(weights)).slots(0, 1_000_000)]
        assert worst_deviation(weights, order) < 1
    assert abs(order.count("a") - 333_333) <= 1


@pytest.mark.parametrize("weights", WEIGHTS)
def test_chunks_carry_the_lags(weights):
    plan = mx.Schedule(mx.whole_shares(weights))
    n = 700
    whole = list(plan.slots(0, n))
    done = Counter()
    for t, (s, k, slot) in enumerate(whole):
        if t % (1 if len(weights) < 100 else 13) == 0:
            assert plan.done_before(t) == {s: done[s] for s in weights}, t
        assert k == done[s] + 1 and slot == t
        done[s] += 1
    assert [x for a in range(0, n, 70) for x in plan.slots(a, a + 70)] == whole


def test_whole_shares():
    assert mx.whole_shares({"a": 0.5, "b": 0.25, "c": 0.25}) == {"a": 2, "b": 1, "c": 1}
    got = mx.whole_shares({"a": 0.1, "b": 3})
    assert Fraction(got["a"], got["b"]) == Fraction(0.1) / 3


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mx, "CHUNK_ROWS", 16)
    monkeypatch.setattr(mx, "CHUNK_SLOTS", 20)
    rows = [(k, "abcd"[min(k % 9, 3)] if k % 50 else None, 1) for k in range(2000)] + [(5, "d", 1)] * 3 + [(None, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int").repartition(5)
    weights = {"a": 2, "b": 1.1, "c": 1, "d": 4.3, "none": 7}
    got = mx.mix(docs, weights, block_rows=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((a, b) for a, b, _ in rows)
    own = defaultdict(list)
    for r in got:
        own[r.source].append((r.mix_block - 1) * 4 + r.mix_row)
    assert all(sorted(v) == list(range(len(v))) for v in own.values())
    slots = {}
    for r in got:
        assert slots.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
    full = next(t for t in range(10**6) if t not in slots)
    here = {s: w for s, w in weights.items() if s != "none"}
    assert full > 100 and worst_deviation(here, [slots[t][0] for t in range(full)]) < 1
    assert {r.source: round(r.mix_weight, 9) for r in got} == {s: round(w / 8.4, 9) for s, w in here.items()} | {None: 1.0}
    assert min(r.mix_slot for r in got if r.source is None) > max(r.mix_slot for r in got if r.source is not None)
    again = mx.mix(docs.repartition(3), weights, block_rows=4)
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.mix_slot, r.mix_row) for r in rs)
    assert key(again.collect()) == key(got)
    laid = mx.mixed_order(again).collect()
    assert [(r.mix_slot, r.mix_row) for r in laid] == sorted((r.mix_slot, r.mix_row) for r in laid)


def test_edge_tables(spark):
    assert mx.mix(spark.createDataFrame([], "doc_id long, source string")).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, source string")
    assert sorted(r.mix_slot for r in mx.mix(docs, {"x": 1.0}).collect()) == [0, 1]
    assert len(mx.mix(docs, {"a": 0.0, None: 2.0}).collect()) == 2


def test_clashing_names_and_many_sources(spark):
    rows = [(k, f"s{k}", "=s", "h", "k", "slot") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _s string, _H string, k string, slot string")
    got = mx.mix(docs).collect()
    assert sorted(r.mix_slot for r in got) == list(range(3000)) and {tuple(r)[2:6] for r in got} == {("=s", "h", "k", "slot")}
