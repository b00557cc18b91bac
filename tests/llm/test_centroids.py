"""Centroid clustering against plain whole-number arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from geoloom.llm import centroids as ce


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**62 for x in v)]
    mark = lambda r: ("~" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=mark)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((dist(v, c), n) for n, c in enumerate(cs)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for n in {n for _, n in found}:
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            cs[n] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    cut = lambda d: d if d < 2**63 else None
    total = lambda ds: None if any(cut(d) is None for d in ds) else cut(sum(ds))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    every = total([d for d, _ in found])
    return [(i, n, cut(d), total([e for e, m in found if m == n]), every, names[n]) for (i, _), (d, n) in zip(kept, found)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def run(spark, rows, dims, **more):
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    got, _ = ce.cluster(docs, dims=dims, **more)
    return sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)


@pytest.mark.parametrize("big", [1.0, 2.0**20, 2.0**54])
def test_against_brute_force(spark, big):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (300, 6)).round(2) + rng.integers(0, 4, (300, 1)) * 3
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.5] * 6), *((1000 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(150))]
    rows += [(900, None), (901, [1.0] * 5), (902, [None] + [1.0] * 5), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5), (905, []), (906, [1e300] * 6), (907, [big * 3.7, -big, 0.0, 0.0, 0.0, 0.0])]
    assert run(spark, rows, 6) == sorted(brute(rows, 16, 3, 6), key=repr)


def test_ties_and_few_vectors(spark):
    rows = [(k, [float(k % 3), 0.0]) for k in range(9)]
    assert run(spark, rows, 2, k=4) == sorted(brute(rows, 4, 3, 2), key=repr)
    assert run(spark, rows[:2], 2) == sorted(brute(rows[:2], 16, 3, 2), key=repr)
    assert run(spark, [], 2) == [] and run(spark, [(1, [math.nan, 1.0])], 2) == []


def test_filter_saves_comparisons():
    rng = np.random.default_rng(6)
    centroids = np.floor(rng.normal(0, 64, (16, 64)) * np.linspace(2, 0.1, 64)).astype(np.int64)
    v = centroids[rng.integers(0, 16, 2000)] + rng.integers(-6, 7, (2000, 64))
    spread = np.cov(v.T)
    turn = np.linalg.eigh(spread)[1][:, ::-1]
    near, rest = ce.project(v, turn, ce.LEAD)
    number, best, full = ce.nearest(v, near, rest, centroids, turn)
    every = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert full < 3 * len(v)
