"""Nesting by a sweep: the same rows as the join, and few rows however deep the nest."""

import math
import random

import pytest

from geoloom.operators import spatial as sp
from geoloom.plans import sweep


def frame(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id long, min_x double, min_y double, max_x double, max_y double")


def tree(df, swept):
    return sorted(tuple(r) for r in sp.containment_tree(df, swept=swept).collect())


def test_holding_sums_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(sweep, "CHUNK_BITS", 3)
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        x, y = rng.randrange(12), rng.randrange(12)
        rows.append((x, y, x + rng.randrange(6), y + rng.randrange(6)))
    boxes = frame(spark, rows).selectExpr("*", "id * 3 + 1 AS w", "1L AS c")
    spots = [(k, float(rng.randrange(18)), float(rng.randrange(18))) for k in range(50)]
    got = sweep.holding_sums(boxes, spark.createDataFrame(spots, "key long, x double, y double"), ["c", "w"]).collect()
    want = {}
    for k, x, y in spots:
        held = [i for i, r in enumerate(rows) if r[0] <= x <= r[2] and r[1] <= y <= r[3]]
        want[k] = (len(held), sum(3 * i + 1 for i in held))
    assert {r.key: (r.c, r.w) for r in got} == want


@pytest.mark.parametrize("kind", ["nested", "crossing", "flat"])
def test_sweep_equals_join(spark, kind):
    rng = random.Random(kind)
    rows = []
    for k in range(40):
        if kind == "nested":
            rows += [(300 * (k % 4) + k, k, 300 * (k % 4) + 200 - k, 200 - k)] * (1 + k % 3 // 2)
        elif kind == "crossing":
            x, y = rng.randrange(20), rng.randrange(20)
            rows.append((x, y, x + rng.randrange(1, 15), y + rng.randrange(1, 15)))
        else:
            x = rng.randrange(6)
            rows.append((x, 0, x + rng.randrange(6), rng.choice([0, 0, 3])))
    df = frame(spark, rows)
    assert tree(df, True) == tree(df, False) == tree(df, None)


def test_a_deep_nest_costs_n_log_n(spark, monkeypatch):
    written = []
    plain = sweep.materialize

    def counted(df, name="table"):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(sweep, "materialize", counted)
    monkeypatch.setattr(sp, "materialize", counted)
    n = 600
    got = tree(frame(spark, [(k, k, 2 * n - k, 2 * n - k) for k in range(n)]), True)
    assert [(r[0], r[1], r[2]) for r in got] == [(k, k - 1 if k else None, k) for k in range(n)]
    assert sum(written) < 6 * n * math.log2(6 * n) < n * n / 2


def test_empty_and_single(spark):
    assert tree(frame(spark, []), True) == [] and tree(frame(spark, [(0, 0, 1, 1)]), True) == [(0, None, 0, "fg", 1.0)]
