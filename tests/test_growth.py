"""Plans that must hold on large tables, seen on small ones."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from geoloom.operators import graph, spatial
from geoloom.plans import cells, chains, scratch


@pytest.fixture
def plans(monkeypatch):
    """The plan of every table that is written meanwhile."""
    seen, write = [], scratch.materialize

    def noted(df, name="table"):
        seen.append(plan_of(df))
        return write(df, name)

    for module in (graph, spatial, chains, scratch):
        monkeypatch.setattr(module, "materialize", noted)
    return seen


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def prism(spark):
    """A square prism: eight wall triangles."""
    at = [(0, 0), (2, 0), (2, 2), (0, 2)]
    rows = []
    for k in range(4):
        (ax, ay), (bx, by) = at[k], at[(k + 1) % 4]
        rows.append((1, 2 * k, ax, ay, 0, bx, by, 0, bx, by, 3))
        rows.append((1, 2 * k + 1, ax, ay, 0, bx, by, 3, ax, ay, 3))
    names = "mesh_id long, facet_id long, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz")
    return spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], names)


def test_contours_broadcast_no_table_that_grows(spark, plans):
    got = graph.chain_contours(graph.slice_facets(prism(spark), 1.0))
    assert "BroadcastHashJoin" not in "".join([*plans, plan_of(got)])
    assert got.groupBy("slice").agg(F.countDistinct("contour"), F.sum("pos")).orderBy("slice").collect() == [(0, 1, 28), (1, 1, 28), (2, 1, 28)]


def cuts_of(spark, links):
    """Cuts (mesh, slice, facet, forward edge, backward edge), with an edge by its number."""
    edge = "struct<x:double,y:double,z:double,x2:double,y2:double,z2:double>"
    rows = [(m, s, f, 1.0, 2.0, 3.0, float(f), *[None if e is None else (None if e == 7 else 0.0, e / 1.0, 2.0, 3.0, 4.0, 5.0) for e in pair]) for m, s, f, *pair in links]
    return spark.createDataFrame(rows, f"mesh_id long, slice long, facet_id long, x1 double, y1 double, x2 double, y2 double, fwd {edge}, bwd {edge}")


def test_slices_are_linked_in_tasks_as_by_rounds(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    links = [(1, 0, f, f, (f + 1) % 90) for f in range(90)]  # a ring
    links += [(1, 1, f, 100 + f, 101 + f) for f in range(70)]  # an open chain
    links += [(2, 0, 5, 3, 3), (2, 0, 6, 8, 9), (None, 0, 7, 1, 2), (None, 0, 8, 2, 1)]  # on itself, alone, of no mesh
    for s in range(2, 8):  # edges of more than two facets, one with a null
        links += [(3, s, f, rnd.randrange(12), rnd.randrange(12)) for f in range(30)]
    cuts = cuts_of(spark, links)

    def got():
        rows = graph.chain_contours(cuts)
        return rows.columns, sorted(map(repr, rows.collect()))

    few = got()
    assert "ArrowPython" not in plan_of(graph._linked_by_rounds(cuts)) and len(few[1]) == len(links)
    monkeypatch.setattr(graph, "SLICE_ROWS", 20)  # larger slices by rounds, and many buffers in a task
    monkeypatch.setattr(graph, "TASK_CUTS", 100)
    assert got() == few
    rounds = graph._linked_by_rounds(cuts)
    assert (rounds.columns, sorted(map(repr, rounds.collect()))) == few


def test_contours_are_shuffled_once_without_their_edges(spark, plans):
    got = graph.chain_contours(graph.slice_facets(prism(spark), 1.0))
    plan = plan_of(got)
    assert plan.count("Exchange ") == 1 and "Join" not in plan and len(plans) == 1


def test_simplified_contours_of_a_chunk_are_joined_with_nothing(spark, monkeypatch):
    from geoloom.operators import ordered

    names = []
    monkeypatch.setattr(ordered, "materialize", lambda df, name="table", write=ordered.materialize: names.append(name) or write(df, name))
    at = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    rows = [(k, 3 * i if k == 2 else i, float(x), float(y)) for k in range(3) for i, (x, y) in enumerate(at)]
    rows += [r for r in rows if r[0] == 1] + [(4, 0, 1.0, 1.0), (None, 0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "g long, pos long, x double, y double")
    few = ordered.simplify_contour(points, ["g"], "pos", closed=F.col("g") < 9)
    assert "Join" not in plan_of(few) and "Exchange" not in plan_of(few) and names == ["contours", "long"]
    spread = ordered.simplify_contour(points, ["g"], "pos", closed=F.col("g") < 9, rows=3)
    got = sorted(map(tuple, few.collect()))
    assert got == sorted(map(tuple, spread.collect()))
    assert [r[1] for r in got if r[0] == 0] == [0, 2, 4, 6, 7, 8] and [r[1] for r in got if r[0] == 2] == [0, 6, 12, 18, 21, 22]
    assert [r[1:] for r in got if r[0] == 4] == [(0, 1.0, 1.0)] and len([r for r in got if r[0] == 1]) == 11


def test_fold_broadcasts_no_table_that_grows(spark, plans):
    from geoloom.operators.ordered import simplify_contour

    points = spark.range(40).select(F.lit(1).alias("g"), F.col("id").alias("pos"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    simplify_contour(points, ["g"], "pos", rows=8)
    assert any("Generate" not in p and "SortMergeJoin" in p for p in plans)
    folds = [p for p in plans if "aggregate(" in p]
    assert folds and "BroadcastHashJoin" not in folds[0]


@pytest.mark.parametrize("angle", [0.0, 30.0, 90.0, 200.0])
def test_rotation_joins_blocks_and_not_pixels(spark, angle):
    import math

    from geoloom.operators import raster

    have = {(0, 0): [5], (0, 1): [None], (3, 9): [7, 7], (1, 8): [2], (-1, 2): [6]}
    rows = [(r, c, v) for (r, c), values in have.items() for v in values] + [(None, 4, 1)]
    got = raster.rotate_pixels(spark.createDataFrame(rows, "row long, col long, val long"), angle, 3)
    assert "block" in next(x for x in plan_of(got).splitlines() if "Join" in x)
    w, h, a = 10, 4, math.radians(angle)
    cos, sin = math.cos(a), math.sin(a)
    out_w, out_h = (math.ceil(round(x, 9)) for x in (abs(w * cos) + abs(h * sin), abs(w * sin) + abs(h * cos)))
    want = []
    for r in range(out_h):
        for c in range(out_w):
            x, y = c - out_w / 2, r - out_h / 2
            values = have.get((math.floor(y * cos - x * sin + h / 2), math.floor(x * cos + y * sin + w / 2)), [None])
            want += [(r, c, 3 if v is None else v) for v in values]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_canvas_is_given_in_runs_of_squares(spark, monkeypatch):
    from geoloom.operators import raster

    monkeypatch.setattr(raster, "CANVAS_ROWS", 40_000)
    got = raster.rotate_pixels(spark.createDataFrame([(0, 0, 1), (7, 999, 2)], "row long, col long, val long"), 30.0)
    count = -(-got.count() // 40_000)
    assert count > 10 and f"rangepartitioning(block#N ASC NULLS FIRST, band#N ASC NULLS FIRST, {count})" in re.sub(r"#\d+L?", "#N", plan_of(got))
    tasks = got.filter("val = 0").groupBy(F.spark_partition_id()).agg(F.countDistinct(F.floor(F.col("col") / 64)))
    assert all(r[1] <= 3 for r in tasks.collect())


def test_canvas_broadcasts_no_table_that_grows(spark):
    from types import SimpleNamespace

    from geoloom.catalog.raster import _placed
    from geoloom.operators import raster

    boxes = spark.createDataFrame([(1, 0.0, 0.0, 96.0, 64.0), (2, 32.0, 0.0, 192.0, 64.0)], "id long, min_x double, min_y double, max_x double, max_y double")
    placed = _placed(SimpleNamespace(box=boxes))
    pixels = raster.fill_pixels(placed, ["id", "size"]).select("row", "col", F.col("size").alias("val"), F.col("size").alias("ord"))
    got = raster.rasterize_layers(pixels, 7, 2)
    assert "Broadcast" not in plan_of(placed) + plan_of(got)
    want = [(r, c, 6 if c == 0 else 10 if c < 6 else 8) for r in range(2) for c in range(7)]
    assert sorted((r["row"], r["col"], r["val"]) for r in got.collect()) == want


def test_ranges_do_not_grow_with_the_data(tmp_path):
    from geoloom.sources import datasource

    for k in range(3):
        (tmp_path / f"{k}.txt").write_bytes(b"X1Y2\n" * 20_000)
    parts = datasource.byte_ranges(str(tmp_path), 10)
    assert len(parts) <= datasource.RANGES + 3 and sum(p.end - p.start for p in parts) == 300_000
    reader = datasource.DrillReader.__new__(datasource.DrillReader)
    assert sum(1 for p in parts for _ in reader.rows(p, set())) == 60_000
    assert len(datasource.byte_ranges(str(tmp_path), 100_000)) == 3


def test_polygon_joins_broadcast_no_table_that_grows(spark, plans, monkeypatch):
    monkeypatch.setattr(cells, "MANY_ROWS", 0)
    names = [f"{c}{k}" for k in (1, 2) for c in "xy"]
    ring = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    rows = [(i, s, *(float(v + 2 * i) for v in e)) for i in range(2) for s, e in enumerate(ring)]
    edges = spark.createDataFrame(rows, "id long, seq long, " + ", ".join(f"{n} double" for n in names))
    got = spatial.polygon_boolean(edges, "intersection")
    assert "BroadcastHashJoin" not in "".join([*plans, plan_of(got)])
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == [
        (2.0, 2.0, 4.0, 2.0), (2.0, 4.0, 2.0, 2.0), (4.0, 2.0, 4.0, 4.0), (4.0, 4.0, 2.0, 4.0),
    ]


def test_pieces_of_pairs_are_cut_in_their_rows(spark, plans, monkeypatch):
    ring = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    rows = [(i, s, *(float(v + 2 * i) for v in e)) for i in range(4) for s, e in enumerate(ring)]
    rows += [(9, 0, 1.0, -1.0, 1.0, 9.0), (9, 1, 1.0, 9.0, 3.0, 9.0), (9, 2, 3.0, 9.0, 3.0, -1.0), (9, 3, 3.0, -1.0, 1.0, -1.0)]
    edges = spark.createDataFrame(rows, "id long, seq long, x1 double, y1 double, x2 double, y2 double")

    def got():
        plans.clear()
        found = spatial.polygon_boolean(edges, "union", "intersection", "subtraction")
        return sorted(map(tuple, found.collect()))

    few = got()
    assert "Window" not in "".join(plans)
    monkeypatch.setattr(spatial, "CHUNK_ROWS", 1)
    assert few and got() == few and any("Window" in p for p in plans)
    # the pieces of a polygon whose rows come twice are counted together, so none is inside
    twice = edges.unionByName(edges.filter("id = 1"))
    sides = spatial.polygon_boolean(twice, "intersection").select(F.when(F.col("side") == "a", F.col("poly_a")).otherwise(F.col("poly_b")).alias("id"))
    assert {r["id"] for r in sides.collect()} >= {2, 3} and sides.filter("id = 1").isEmpty()


def test_edges_of_pairs_are_spread_by_their_number(spark, plans, monkeypatch):
    monkeypatch.setattr(spatial, "BASE_ROWS", 3)
    ring = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    rows = [(i, s, *(float(v + 2 * i) for v in e)) for i in range(3) for s, e in enumerate(ring)]
    edges = spark.createDataFrame(rows, "id long, seq long, x1 double, y1 double, x2 double, y2 double")
    got = spatial.polygon_boolean(edges, "union")
    # three pairs (boxes 0 and 2 touch), two sides of four edges each: 24 rows
    assert any("REPARTITION_BY_NUM" in p and ", 9), REPARTITION_BY_NUM" in p for p in plans)
    assert got.groupBy("poly_a", "poly_b").count().orderBy("poly_a", "poly_b").collect()[0][2] == 8


def test_join_without_crowded_cells_looks_none_up(spark):
    def points(n):
        return spark.range(1000).select(F.col("id").alias(f"{n}_id"), (F.col("id") * 3.0).alias(f"{n}x"), (F.col("id") * 5.0).alias(f"{n}y"))

    met = cells.cell_join(points("a"), points("b"), cells.point_box("ax", "ay"), cells.point_box("bx", "by"), hot=100)
    assert "LeftOuter" not in plan_of(met)
    assert met.filter("a_id = b_id").count() == met.count() == 1000


def test_spots_alone_are_not_compared(spark):
    # far apart, but for two on both sides of the border of a wide cell
    spots = spark.createDataFrame([(i, 10.0 * i, 7.0 * i) for i in range(1, 200)] + [(900, 0.064 - 4e-4, 3.0), (901, 0.064 + 4e-4, 3.0)], "vertex long, x double, y double")
    assert {r["vertex"] for r in graph._crowded(spots, 1e-3).collect()} == {900, 901}
    assert [tuple(r) for r in graph._close(spots, 1e-3).select("u", "v").collect()] == [(900, 901)]


def test_walks_of_both_sides_are_not_joined(spark):
    rows = [(i, float(i), 0.0, i + 1.0, 0.0) for i in range(6)]
    out = graph.stitch_paths(spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double"))
    assert "Join" not in plan_of(out)
    assert sorted((r["id"], r["path_id"], r["pos"], r["reversed"]) for r in out.collect()) == [(i, 0, i, False) for i in range(6)]


def test_lone_nodes_are_read_in_no_round(spark, monkeypatch):
    counts, write = {}, scratch.materialize

    def noted(df, name="table"):
        out = write(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(chains, "materialize", noted)
    nodes = spark.createDataFrame([(i, None) for i in range(100, 160)] + [(0, None)] + [(i, i - 1) for i in range(1, 9)], "id long, prev long")
    out = {r["id"]: (r["chain"], r["pos"], r["is_ring"]) for r in chains.rank_chains(nodes).collect()}
    assert counts["heads"] == [1]
    assert out == {i: (0, i, False) for i in range(9)} | {i: (i, 0, False) for i in range(100, 160)}


def test_round_trip_shuffles_entities_and_no_line_to_number_it(spark, tmp_path):
    from geoloom.sources import dxf, lines, sinks

    shapes = spark.createDataFrame([(i, "line" if i % 2 else "point", None if i == 3 else f"l{i % 3}", float(i), 2.0, 3.0, 4.0) for i in range(40)],
                                   "id long, kind string, layer string, x1 double, y1 double, x2 double, y2 double")
    packed, long = sinks.write_dxf_lines(shapes, packed=True), sinks.write_dxf_lines(shapes)
    assert packed.count() == 40
    split = packed.select("id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    assert sorted(map(tuple, split.collect())) == sorted((r["id"], r["n"], r["text"] or "") for r in long.collect())
    sinks.save_dxf(packed, str(tmp_path / "d"))
    read = lines.read_lines(spark, str(tmp_path / "d"))
    assert "SortMergeJoin" not in plan_of(read)
    back = dxf.dxf_entities(read)
    assert sorted((r["kind"], r["x1"]) for r in back.collect()) == sorted(("LINE" if i % 2 else "POINT", float(i)) for i in range(40))
    codes = {r["code"] for r in dxf.dxf_pairs(read, ["0", "8"]).collect()}
    assert codes == {"0", "8"}


def test_mesh_tasks_grow_in_number_with_the_lines(spark, monkeypatch):
    from geoloom.sources import stl

    rows = [(f"m{f}", 7 * k + v, f"vertex {k}.0 {v}.0 {v * f}.5") for f in (1, 2) for k in range(50) for v in range(3)]
    text = spark.createDataFrame(rows, "file string, line_no long, text string")
    monkeypatch.setattr(stl, "TASK_ROWS", 30)
    out = stl.stl_ascii_facets(text)
    assert "hashpartitioning(file, facet_no, 11), REPARTITION_BY_NUM" in re.sub(r"#\d+L?", "", plan_of(out))
    assert sorted((r["file"], r["facet_no"], r["x1"], r["z2"]) for r in out.collect()) == [(f"m{f}", k, float(k), 2 * f + 0.5) for f in (1, 2) for k in range(50)]
