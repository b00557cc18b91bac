"""Exact clipping against sampled angles, and special places of circles, arcs and paths."""

import math
import random

from geoloom.operators import clipping

BOX = "id long, min_x double, min_y double, max_x double, max_y double"
CURVE = "id long, kind string, cx double, cy double, r double, a0 double, a1 double"


def pieces(spark, curves, boxes):
    rows = clipping.clip_curves(spark.createDataFrame(curves, CURVE), spark.createDataFrame(boxes, BOX)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r.piece):
        out.setdefault((r.id, r.box), []).append((r.kind, r.a0, r.a1))
    return out


def test_special_places(spark):
    circle, arc = (1, "circle", 0.0, 0.0, 2.0, 0.0, 0.0), (2, "arc", 0.0, 0.0, 2.0, math.pi / 2, 0.0)
    boxes = [(1, -3.0, -3.0, 3.0, 3.0), (2, 0.0, -3.0, 3.0, 3.0), (3, 2.0, -1.0, 4.0, 1.0), (4, 9.0, 9.0, 10.0, 10.0), (5, -1.0, -1.0, 1.0, 1.0), (6, -3.0, -1.0, 3.0, 1.0)]
    got = pieces(spark, [circle, arc, (3, "arc", 0.0, 0.0, 2.0, 1.0, 1.0), (4, "circle", 0.0, 0.0, 0.0, 0.0, 0.0)], boxes)
    near = lambda a, b: all(abs(x - y) < 1e-6 for x, y in zip(a, b))
    assert got[1, 1] == [("circle", 0.0, got[1, 1][0][2])] and near([got[1, 1][0][2]], [2 * math.pi])
    (kind, a0, a1), = got[1, 2]  # the right half, over the start of the circle
    assert kind == "arc" and near((a0, a1), (1.5 * math.pi, 2.5 * math.pi))
    assert (1, 3) not in got and (1, 4) not in got and (1, 5) not in got  # touched, far, inside the circle
    assert len(got[1, 6]) == 2 and near(got[1, 6][0][1:], (5 * math.pi / 6, 7 * math.pi / 6)) and near(got[1, 6][1][1:], (11 * math.pi / 6, 13 * math.pi / 6))
    assert near(got[2, 1][0][1:], (math.pi / 2, 2 * math.pi)) and near(got[2, 2][0][1:], (1.5 * math.pi, 2 * math.pi))
    assert not any(k[0] in (3, 4) for k in got)


def test_lengths_by_sampling(spark):
    rng = random.Random(2)
    curves = [(k, rng.choice(["circle", "arc"]), rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(1, 6), rng.uniform(0, 6), rng.uniform(0, 6)) for k in range(25)]
    boxes = [(k, x, y, x + rng.uniform(1, 8), y + rng.uniform(1, 8)) for k in range(8) for x, y in [(rng.uniform(-8, 4), rng.uniform(-8, 4))]]
    got = pieces(spark, curves, boxes)
    n = 4000
    for i, kind, cx, cy, r, a0, a1 in curves:
        start, turn = (0.0, 2 * math.pi) if kind == "circle" else (a0, (a1 - a0) % (2 * math.pi) if a1 < a0 else a1 - a0)
        for j, x0, y0, x1, y1 in boxes:
            angles = [start + turn * (k + 0.5) / n for k in range(n)]
            inside = sum(x0 <= cx + r * math.cos(a) <= x1 and y0 <= cy + r * math.sin(a) <= y1 for a in angles) * turn / n
            found = got.get((i, j), [])
            assert abs(sum(b - a for _, a, b in found) - inside) < 0.01
            assert all(b > a for _, a, b in found)


def test_path_runs(spark):
    path = [(1, k, x, y) for k, (x, y) in enumerate([(-5.0, 1.0), (1.0, 1.0), (2.0, 2.0), (9.0, 2.0), (9.0, 3.0), (1.0, 3.0), (1.0, 9.0)])]
    boxes = spark.createDataFrame([(7, 0.0, 0.0, 4.0, 4.0), (8, 20.0, 20.0, 30.0, 30.0)], BOX)
    rows = clipping.clip_paths(spark.createDataFrame(path, "path_id long, seq long, x double, y double"), boxes).collect()
    runs = {}
    for r in sorted(rows, key=lambda r: (r.run, r.seq)):
        runs.setdefault((r.path_id, r.box, r.run), []).append((r.x, r.y))
    assert runs == {(1, 7, 0): [(0.0, 1.0), (1.0, 1.0), (2.0, 2.0), (4.0, 2.0)], (1, 7, 4): [(4.0, 3.0), (1.0, 3.0), (1.0, 4.0)]}
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 4.5), (3, 2.0, 2.0)], "id long, x double, y double")
    assert sorted((r.id, r.box) for r in clipping.clip_points(points, boxes).collect()) == [(1, 7), (3, 7)]
