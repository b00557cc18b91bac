"""The shared plan shapes against plain Python, with tiny chunks and hot keys."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import ordered, spatial
from geoloom.operators.graph import chain_contours, slice_facets, stitch_paths
from geoloom.operators.ordered import merge_collinear, simplify_contour
from geoloom.plans.cells import Box, Line, cell_join, point_box
from geoloom.plans.chains import rank_chains
from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import scratch_path


def test_scan_equals_plain_window(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.choice([None, float(rnd.randint(0, 9))])) for k, n in (("hot", 300), ("cold", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    got = ordered_scan(
        df, ["k"], ["i"], chunk_of("i", 16), index="rn", running={"s": F.coalesce("v", F.lit(0.0))}, fill={"f": F.col("v")},
        lag={"p": F.struct("i", "v")}, lead={"n": F.col("v")},
    )
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns(
        {
            "rn": F.row_number().over(w).cast("bigint"),
            "s": F.sum(F.coalesce("v", F.lit(0.0))).over(upto),
            "f": F.last("v", ignorenulls=True).over(upto),
            "p": F.lag(F.struct("i", "v")).over(w),
            "n": F.lead("v").over(w),
        }
    )
    cols = ["k", "i", "v", "rn", "s", "f", "p", "n"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def _boxes(spark, prefix, rows):
    names = [f"{prefix}{c}" for c in ("id", "x0", "y0", "x1", "y1")]
    schema = f"{names[0]} bigint, " + ", ".join(f"{n} double" for n in names[1:])
    return spark.createDataFrame(rows, schema), Box(*names[1:])


@pytest.mark.parametrize("hot", [5, 20000])
def test_cell_join_with_hot_cells_and_long_boxes(spark, hot):
    rnd = random.Random(2)

    def make(n, seed):
        r = random.Random(seed)
        out = []
        for i in range(n):
            # a third of the boxes sit on one spot, some are very long
            x, y = (50.0, 50.0) if i % 3 == 0 else (r.uniform(0, 100), r.uniform(0, 100))
            w, h = (r.uniform(200, 4000), 1.0) if i % 40 == 1 else (r.uniform(0, 3), r.uniform(0, 3))
            out.append((i, x, y, x + w, y + h))
        return out

    a_rows, b_rows = make(120, 3), make(90, 4)
    a, a_box = _boxes(spark, "a", a_rows)
    b, b_box = _boxes(spark, "b", b_rows)
    got = sorted((r["aid"], r["bid"]) for r in cell_join(a, b, a_box, b_box, cell=2.0, hot=hot).collect())
    want = sorted(
        (p[0], q[0]) for p in a_rows for q in b_rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    )
    assert got == want
    assert rnd is not None


@pytest.mark.parametrize("hot", [8, None])
def test_intersections_with_copies_and_hot_cell(spark, hot):
    r = random.Random(5)
    segs = []
    for i in range(90):
        if i % 3 == 0:  # copies of one segment, some turned round
            s = (10.0, 10.0, 20.0, 21.0) if i % 2 else (20.0, 21.0, 10.0, 10.0)
        else:
            x, y = r.randint(0, 30), r.randint(0, 30)
            s = (float(x), float(y), float(x + r.randint(-9, 9)), float(y + r.randint(-9, 9)))
        segs.append((i, *s))
    df = spark.createDataFrame(segs, "id bigint, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["id_a"], r["id_b"]) for r in spatial.segment_intersections(df, cell=3.0, hot=hot).collect())
    want = []
    for a in segs:
        for b in segs:
            if a[0] < b[0]:
                dx, dy, ex, ey = a[3] - a[1], a[4] - a[2], b[3] - b[1], b[4] - b[2]
                det = dx * ey - dy * ex
                if det:
                    t = ((b[1] - a[1]) * ey - (b[2] - a[2]) * ex) / det
                    u = ((b[1] - a[1]) * dy - (b[2] - a[2]) * dx) / det
                    if 0 <= t <= 1 and 0 <= u <= 1:
                        want.append((a[0], b[0]))
    assert got == sorted(want)


def test_line_cells_find_points_on_steep_and_flat_lines(spark):
    lines = [(0, 0.0, 0.0, 0.0, 50.0), (1, 0.0, 7.0, 60.0, 7.0), (2, 0.0, 0.0, 40.0, 40.0)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 33), (44, 7), (25, 25), (25, 26)])]
    a = spark.createDataFrame(lines, "lid bigint, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(pts, "pid bigint, x double, y double")
    on = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) == (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    got = cell_join(a, b, Line("x1", "y1", "x2", "y2"), point_box("x", "y"), cell=3.0, keep=on, owner=(F.col("x"), F.col("y")))
    assert sorted((r["lid"], r["pid"]) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_rank_chains_and_rings(spark):
    rows, want = [], {}
    ids = list(range(100, 400))
    random.Random(6).shuffle(ids)
    at = 0
    for length, ring in ((1, False), (2, False), (77, False), (1, True), (2, True), (64, True), (100, True)):
        part = ids[at : at + length]
        at += length
        for i, node in enumerate(part):
            rows.append((node, part[i - 1] if i or ring else None))
        start = part.index(min(part)) if ring else 0
        for i in range(length):
            want[part[(start + i) % length]] = (part[start], i, ring)
    df = spark.createDataFrame(rows, "id bigint, prev bigint")
    got = {r["id"]: (r["chain"], r["pos"], r["is_ring"]) for r in rank_chains(df).collect()}
    assert got == want


def _fold_merge(angles, tol):
    runs, ref = [], None
    for i, a in enumerate(angles):
        if ref is None or abs(a - ref) > tol:
            ref = a
            runs.append(i)
    return runs


@pytest.mark.parametrize("rows", [4, 512])
def test_merge_collinear_is_the_sequential_fold(spark, rows):
    r = random.Random(7)
    segs, want = [], {}
    for path, n in ((1, 150), (2, 3)):
        x = y = 0.0
        angles = []
        for i in range(n):
            a = 0.05 * i % 1.3 + r.uniform(-0.02, 0.02)
            segs.append((path, i, x, y, x + math.cos(a), y + math.sin(a)))
            angles.append(math.atan2(y + math.sin(a) - y, x + math.cos(a) - x))
            x, y = x + math.cos(a), y + math.sin(a)
        want[path] = _fold_merge(angles, 0.2)
    df = spark.createDataFrame(segs, "path_id bigint, seq bigint, x1 double, y1 double, x2 double, y2 double")
    got = merge_collinear(df, ["path_id"], "seq", 0.2, rows=rows).collect()
    assert {p: sorted(r["seq"] for r in got if r["path_id"] == p) for p in want} == want
    assert sum(r["merged"] for r in got) == len(segs)


@pytest.mark.parametrize("rows", [5, 512])
def test_simplify_contour_is_the_sequential_fold(spark, rows):
    pts = [(1, i, math.cos(i / 30) * 50, math.sin(i / 30) * 50) for i in range(180)]
    tol = math.radians(4)
    kept, last, ref = [0], pts[0], None
    for prev, cur in zip(pts, pts[1:]):
        a = math.atan2(cur[3] - last[3], cur[2] - last[2])
        if ref is None:
            ref = a
        elif abs(math.remainder(a - ref, 2 * math.pi)) > tol:
            kept.append(prev[1])
            last = prev
            ref = math.atan2(cur[3] - prev[3], cur[2] - prev[2])
    kept.append(179)
    df = spark.createDataFrame(pts, "g bigint, pos bigint, x double, y double")
    got = simplify_contour(df, ["g"], "pos", 4.0, rows=rows)
    assert sorted(r["pos"] for r in got.collect()) == kept


def test_stitch_uses_each_segment_once_and_finds_rings(spark):
    segs = [
        (1, 0.0, 0.0, 1.0, 0.0), (2, 2.0, 0.0, 1.0, 0.0), (3, 2.0, 0.0, 3.0, 0.0),  # open path, one turned round
        (5, 9.0, 9.0, 9.0, 8.0), (4, 9.0, 8.0, 8.0, 8.0), (6, 8.0, 8.0, 9.0, 9.0),  # ring
        (7, 20.0, 20.0, 21.0, 20.0),  # lone
    ]
    df = spark.createDataFrame(segs, "id bigint, x1 double, y1 double, x2 double, y2 double")
    rows = {r["id"]: r for r in stitch_paths(df).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7]
    assert [(rows[i]["path_id"], rows[i]["pos"], rows[i]["reversed"]) for i in (1, 2, 3)] == [(1, 0, False), (1, 1, True), (1, 2, False)]
    assert {rows[i]["path_id"] for i in (4, 5, 6)} == {4} and all(rows[i]["is_ring"] for i in (4, 5, 6))
    assert sorted(rows[i]["pos"] for i in (4, 5, 6)) == [0, 1, 2]
    assert (rows[7]["path_id"], rows[7]["pos"], rows[7]["is_ring"]) == (7, 0, False)


def test_contours_of_a_tetrahedron(spark):
    a, b, c, d = (0.0, 0.0, 0.0), (6.0, 0.0, 0.0), (0.0, 6.0, 0.0), (1.0, 1.0, 6.0)
    faces = [(a, c, b), (a, b, d), (b, c, d), (c, a, d)]
    rows = [(1, i, *p, *q, *r) for i, (p, q, r) in enumerate(faces)]
    schema = "mesh_id bigint, facet_id bigint, " + ", ".join(f"{x}{i} double" for i in range(3) for x in "xyz")
    got = chain_contours(slice_facets(spark.createDataFrame(rows, schema), 1.0)).collect()
    for j in range(6):
        ring = sorted((r for r in got if r["slice"] == j), key=lambda r: r["pos"])
        assert [r["pos"] for r in ring] == [0, 1, 2] and all(r["is_closed"] for r in ring)
        for r, nxt in zip(ring, ring[1:] + ring[:1]):
            assert (r["x2"], r["y2"]) == pytest.approx((nxt["x1"], nxt["y1"]))


def test_hatch_length_approaches_area_at_an_angle(spark):
    ring = [(0.0, 0.0), (40.0, 0.0), (40.0, 30.0), (20.0, 12.0), (0.0, 30.0)]
    edges = [(1, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]
    df = spark.createDataFrame(edges, "g bigint, x1 double, y1 double, x2 double, y2 double")
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
    for style, sets in (("raster", 1), ("serpentine", 1), ("raster_grid", 2)):
        lines = ordered.hatch_fill(df, ["g"], 0.25, 33.0, style).collect()
        total = sum(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) for r in lines) * 0.25
        assert total == pytest.approx(area * sets, rel=0.01)


def test_clip_keeps_total_length_over_a_tiling(spark):
    r = random.Random(8)
    segs = [(i, r.uniform(0, 100), r.uniform(0, 100), r.uniform(0, 100), r.uniform(0, 100)) for i in range(60)]
    df = spark.createDataFrame(segs, "id bigint, x1 double, y1 double, x2 double, y2 double")
    ext = spark.createDataFrame([(0.0, 0.0, 100.0, 100.0)], "min_x double, min_y double, max_x double, max_y double")
    whole = sum(math.hypot(s[3] - s[1], s[4] - s[2]) for s in segs)
    by_grid = spatial.clip_to_grid(df, ext, 7.0, 9.0, [])
    tiles = spatial.tile_grid(ext, 7.0, 9.0)
    by_join = spatial.clip_to_boxes(df, tiles, "tile")
    for parts in (by_grid, by_join):
        assert parts.select(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] == pytest.approx(whole)


def test_deep_layout(spark):
    from geoloom.operators.layout import nearest_ancestor, node_transforms

    rows = [(k, k - 1 if k else None, f"level{k}", 1.0, 2.0, 0.0, 2.0) for k in range(11)] + [(50, 49, "stray", 3.0, 0.0, 0.0, 1.0)]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, level string, off_x double, off_y double, rot_deg double, scale double")
    got = {r.node_id: r for r in node_transforms(nodes).collect()}
    assert got[10].a == 2.0**11 and got[10].tx == 2.0**11 - 1 and got[50].tx == 3.0
    stopped = {r.node_id: r.a for r in node_transforms(nodes, "level4").collect()}
    assert stopped[10] == 2.0**7 and stopped[3] == 2.0**4
    marked = spark.createDataFrame([(0,)], "node_id long")
    near = {r.node_id: (r.ancestor, r.hops) for r in nearest_ancestor(nodes, marked).collect()}
    assert near[10] == (0, 10) and near[0] == (0, 0) and near[50] == (None, None)


def test_scratch_is_shared(spark, monkeypatch):
    from geoloom.plans.scratch import scratch_root

    class Plain:
        sparkContext = spark.sparkContext

        class conf:
            @staticmethod
            def get(key, *default):
                return "file:/warehouse" if key == "spark.sql.warehouse.dir" else default[0]

    assert scratch_root(Plain).startswith("file:/warehouse/_scratch/")
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or scratch_root(spark).startswith(named)


def test_affine_of_flat_groups(spark):
    from geoloom.operators.transform import estimate_affine

    rows = [(1, 3.0, 4.0, 6.0, 2.0)] * 3 + [(2, float(k), float(2 * k), float(5 * k), 7.0) for k in range(4)]
    got = {r.grp: r for r in estimate_affine(spark.createDataFrame(rows, "grp int, x double, y double, mx double, my double"), "grp").collect()}
    one = [6.0 * v / 26.0 for v in (3.0, 4.0, 1.0)]
    assert [got[1].a, got[1].c, got[1].tx] == pytest.approx(one)
    assert [got[2].a, got[2].c, got[2].tx] == pytest.approx([1.0, 2.0, 0.0], abs=1e-9) and got[2].ty == pytest.approx(7.0)


def test_booleans_of_nested_and_touching_boxes(spark):
    from geoloom.operators.generate import box_edges
    from geoloom.operators.spatial import polygon_boolean

    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 2.0, 2.0, 4.0, 4.0), (3, 10.0, 0.0, 20.0, 10.0), (4, 30.0, 0.0, 31.0, 1.0)]
    boxes = spark.createDataFrame(rows, "id long, min_x double, min_y double, max_x double, max_y double")
    got = {}
    for r in polygon_boolean(box_edges(boxes), "union", "intersection", "subtraction").collect():
        got.setdefault((r.poly_a, r.poly_b, r.mode), []).append((r.side, r.x1, r.y1, r.x2, r.y2))
    assert {k[:2] for k in got} == {(1, 2), (1, 3)}
    length = {k: sum(abs(c - a) + abs(d - b) for _, a, b, c, d in v) for k, v in got.items()}
    assert length[1, 2, "union"] == 40 and length[1, 2, "intersection"] == 8 and length[1, 2, "subtraction"] == 48
    # the shared edge lies on the right of 1, which is outside, and on the left of 3, which is inside
    assert {s for s, *_ in got[1, 3, "intersection"]} == {"a"} and length[1, 3, "intersection"] == 10
    assert length[1, 3, "union"] == 70


def test_scan_reads_its_input_once(spark):
    from geoloom.sources import dxf

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.range(100).selectExpr("'f' AS file", "id AS line_no", "CAST(id AS STRING) AS text").write
        path = scratch_path(spark, "lines")
        lines.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
        once = ordered_scan(table, ["file"], ["line_no"], chunk_of("line_no"), fill={"f": F.col("text")}, lead={"n": F.col("text")})
        twice = ordered_scan(once, ["file"], ["line_no"], chunk_of("line_no"), running={"s": F.lit(1)})
        for df in (once, twice, dxf.dxf_polylines(dxf.dxf_polyline_vertices(table), ["file", "path_id"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") <= 2 and plan.count("ReusedExchange") >= 1
        assert once._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ends_meet_across_cells(spark):
    from geoloom.operators.graph import next_connected, segment_ends

    rnd = random.Random(9)
    rows = []
    for k in range(60):
        x, y = rnd.choice([0.016, 0.032, 5.0, -0.016]), rnd.choice([0.0, 0.016, 7.0])
        rows.append((k, x + rnd.uniform(-8e-4, 8e-4), y + rnd.uniform(-8e-4, 8e-4), 100.0 + k, 50.0))
    rows += [(90, 200.0, 0.0, 300.0, 0.0), (91, 200.0008, 0.0, 300.0, 1.0), (92, 200.0016, 0.0, 300.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    ends = [(i, t, x, y) for i, x1, y1, x2, y2 in rows for t, x, y in ((0, x1, y1), (1, x2, y2))]
    label = {e[:2]: e[:2] for e in ends}
    changed = True
    while changed:
        changed = False
        for a in ends:
            for b in ends:
                if math.hypot(a[2] - b[2], a[3] - b[3]) <= 1e-3 and label[a[:2]] < label[b[:2]]:
                    label[b[:2]], changed = label[a[:2]], True
    groups = {}
    for r in segment_ends(df).collect():
        groups.setdefault(r.vertex, set()).add((r.id, r.tip))
    want = {}
    for e, top in label.items():
        want.setdefault(top, set()).add(e)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert {(r.id, r.mate) for r in next_connected(df).collect()} >= {(90, 91), (91, 90), (92, 90)}


def test_straight_path_settles_in_two_rounds(spark, monkeypatch):
    from geoloom.plans import scratch

    written = []
    plain = scratch.materialize
    monkeypatch.setattr(scratch, "materialize", lambda df, name="table": written.append(name) or plain(df, name))
    segs = spark.range(400).selectExpr("1L AS path_id", "id AS seq", "id * 1.0D AS x1", "0.0D AS y1", "id + 1.0D AS x2", "0.0D AS y2")
    got = merge_collinear(segs, ["path_id"], "seq", rows=4).collect()
    assert [(r["seq"], r["merged"]) for r in got] == [(0, 400)] and written.count("moved") <= 3
    written.clear()
    pts = spark.range(401).selectExpr("1L AS g", "id AS pos", "id * 1.0D AS x", "0.0D AS y")
    kept = simplify_contour(pts, ["g"], "pos", rows=4).collect()
    assert sorted(r["pos"] for r in kept) == [0, 400] and written.count("moved") <= 4
