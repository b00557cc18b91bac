"""Path editing with a tolerance against plain loops, and links of crowded ends."""

import math
import random

import pytest

from geoloom.operators import generate as gen
from geoloom.operators import graph


def points(spark, rows):
    return spark.createDataFrame(rows, "path_id long, seq long, x double, y double")


def walk(n, seed, path=1, first=0):
    rng, x, y, out = random.Random(seed), 0.0, 0.0, []
    for k in range(n):
        x, y = x + rng.uniform(-2, 3), y + rng.uniform(-2, 2)
        out.append((path, first + 3 * k, x, y))
    return out


def kept(rows, tol, tip=None):
    out = []
    for _, _, x, y in rows:
        if tip is None or math.hypot(x - tip[0], y - tip[1]) > tol:
            out.append((x, y))
            tip = (x, y)
    return out


def shown(df, path=1):
    return [(r.x, r.y) for r in sorted((r for r in df.collect() if r.path_id == path), key=lambda r: r.seq)]


@pytest.mark.parametrize("rows", [4, 4096])
def test_joined_points(spark, rows):
    given = walk(60, 1)
    assert shown(gen.joined_points(points(spark, given), 2.5, rows=rows)) == kept(given, 2.5)
    assert shown(gen.joined_points(points(spark, given + [(1, 1000, *given[-1][2:])]))) == [g[2:] for g in given]


def test_append_prepend_merge(spark):
    a, b = walk(8, 2), walk(15, 3, first=100)
    alone = walk(3, 4, path=2)
    left, right = points(spark, a), points(spark, b + alone)
    assert shown(gen.append_points(left, right, 2.5)) == [p[2:] for p in a] + kept(b, 2.5, a[-1][2:])
    before = kept(b[::-1], 2.5, a[0][2:])[::-1]
    assert shown(gen.append_points(left, right, 2.5, prepend=True)) == before + [p[2:] for p in a]
    assert shown(gen.append_points(left, right, 2.5), path=2) == kept(alone, 2.5)  # no path yet: the points begin one
    near = math.hypot(a[-1][2] - b[0][2], a[-1][3] - b[0][3])
    for tol, skip in ((near + 0.1, 1), (near - 0.1, 0)):
        assert shown(gen.merge_paths(left, right, tol)) == [p[2:] for p in a] + [p[2:] for p in b[skip:]]


def test_crowded_ends_are_linked_in_linear_size(spark):
    rng = random.Random(5)
    spots = [(k, rng.uniform(0, 0.6), rng.uniform(0, 0.6)) for k in range(400)] + [(400 + k, 0.6 + 0.9 * k, 5.0) for k in range(20)]
    df = spark.createDataFrame(spots, "vertex long, x double, y double")
    links = [(r.u, r.v) for r in graph._close(df, 1.0).collect()]
    assert len(links) < 500
    label = {k: k for k, _, _ in spots}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for u, v in links:
        label[top(u)] = top(v)
    plain = {k: k for k, _, _ in spots}
    for _ in range(25):
        for i, x, y in spots:
            for j, p, q in spots:
                if math.hypot(x - p, y - q) <= 1.0 and plain[j] < plain[i]:
                    plain[i] = plain[j]
        if all(plain[plain[k]] == plain[k] for k in plain):
            break
    groups = {frozenset(k for k in label if top(k) == t) for t in map(top, label)}
    assert groups == {frozenset(k for k in plain if plain[k] == t) for t in plain.values()}
