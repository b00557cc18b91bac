"""Readers on real files, written in the test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators.generate import arcs_from_bulge, tessellate_spline
from geoloom.operators.layout import flatten_tiles
from geoloom.operators.transform import estimate_affine
from geoloom.sources import drill, dxf, layout_xml, lines, sinks, vectors


def test_read_lines_numbers_split_files(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5003
    assert all(r["text"] == f"line {r['line_no']}" for r in rows)


def _lines(spark, text):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(text.split("\n"))], "file string, line_no bigint, text string")


def _entity(kind, marker, *pairs):
    return "\n".join(["0", kind, "100", "AcDbEntity", "8", "L1", "100", marker, *[str(v) for p in pairs for v in p]])


def test_drawing_with_all_kinds(spark):
    text = "\n".join(
        [
            "0\nSECTION\n2\nENTITIES",
            _entity("POINT", "AcDbPoint", (10, 1), (20, 2), (30, 3)),
            _entity("CIRCLE", "AcDbCircle", (10, 4), (20, 5), (30, 0), (40, 2.5)),
            _entity("ARC", "AcDbCircle", (10, 0), (20, 0), (30, 0), (40, 1), (100, "AcDbArc"), (50, 0), (51, 90)),
            _entity("LWPOLYLINE", "AcDbPolyline", (90, 4), (70, 1), (10, 0), (20, 0), (10, 2), (20, 0), (42, 1), (10, 2), (20, 2), (10, 0), (20, 2)),
            _entity("SPLINE", "AcDbSpline", (70, 8), (71, 2), *[(40, k) for k in (0, 0, 0, 1, 1, 1)], (10, 0), (20, 0), (10, 1), (20, 2), (10, 2), (20, 0)),
            "0\nENDSEC\n0\nEOF",
        ]
    )
    df = _lines(spark, text)
    got = {r["kind"]: r for r in dxf.dxf_entities(df).collect()}
    assert set(got) == {"POINT", "CIRCLE", "ARC"} and all(r["layer"] == "L1" for r in got.values())
    assert (got["POINT"]["x1"], got["POINT"]["z1"], got["CIRCLE"]["r"]) == (1.0, 3.0, 2.5)
    assert got["ARC"]["a1"] == pytest.approx(np.pi / 2)
    pieces = dxf.dxf_polylines(dxf.dxf_polyline_vertices(df), ["file", "path_id"]).orderBy("seq").collect()
    assert [(r["piece"], r["kind"]) for r in pieces] == [(1, "line"), (2, "arc"), (3, "line"), (3, "line")]
    assert (pieces[-1]["x2"], pieces[-1]["y2"]) == (0.0, 0.0)
    half = arcs_from_bulge(dxf.dxf_polylines(dxf.dxf_polyline_vertices(df), ["file", "path_id"]).filter("kind = 'arc'")).first()
    assert (half["r"], half["sweep"]) == pytest.approx((1.0, np.pi))
    spline = dxf.splines_from_parts(dxf.dxf_splines(df)).withColumn("id", F.col("entity"))
    points = tessellate_spline(spline).orderBy("i").collect()
    assert len(points) == 9
    for r in points[:-1]:  # one quadratic span is a Bezier curve
        t = r["i"] / 8
        assert (r["x"], r["y"]) == pytest.approx((2 * t, 4 * t * (1 - t)))
    assert (points[-1]["x"], points[-1]["y"]) == (2.0, 0.0)


def test_splines_keep_depth_and_fit_points(spark):
    ctrl = [(10, 1), (20, 2), (30, 3), (10, 4), (20, 5), (10, 6), (20, 7), (30, 8)]  # the second lies at no given depth
    fit = [(11, 1), (21, 2), (31, 9), (11, 4), (21, 5)]
    text = _entity("SPLINE", "AcDbSpline", (70, 8), (71, 2), *[(40, k) for k in (0, 0, 1)], *ctrl, *fit)
    parts = dxf.dxf_splines(_lines(spark, text + "\n0\nEOF"))
    got = sorted((r["part"], r["i"], r["v"]) for r in parts.collect())
    assert got == [
        ("fit_x", 1, 1.0), ("fit_x", 2, 4.0), ("fit_y", 1, 2.0), ("fit_y", 2, 5.0), ("fit_z", 1, 9.0),
        ("knot", 1, 0.0), ("knot", 2, 0.0), ("knot", 3, 1.0),
        ("x", 1, 1.0), ("x", 2, 4.0), ("x", 3, 6.0), ("y", 1, 2.0), ("y", 2, 5.0), ("y", 3, 7.0), ("z", 1, 3.0), ("z", 3, 8.0),
    ]
    one = dxf.splines_from_parts(parts).first()
    assert one["knots"] == [0.0, 0.0, 1.0] and [tuple(p) for p in one["ctrl"]] == [(1.0, 2.0, 3.0), (4.0, 5.0, 0.0), (6.0, 7.0, 8.0)]
    assert [tuple(p) for p in one["fit"]] == [(1.0, 2.0, 9.0), (4.0, 5.0, 0.0)]


def test_saved_drawing_reads_back(spark, tmp_path):
    rows = [(1, "line", "A", 0.0, 1.0, 2.0, 3.0), (2, "line", "B", 4.0, 5.0, 6.0, 7.0)]
    geoms = spark.createDataFrame(rows, "id bigint, kind string, layer string, x1 double, y1 double, x2 double, y2 double")
    sinks.save_dxf(sinks.write_dxf_lines(geoms), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out" / "layer=A")).collect()
    back = _lines(spark, "\n".join(r[0] for r in text))
    assert dxf.dxf_version(back).first()["supported"]
    got = dxf.dxf_entities(back).first()
    assert (got["layer"], got["x1"], got["y2"]) == ("A", 0.0, 3.0)


def test_drill_rules(spark):
    text = "M48\nINCH,TZ\nT01C0.05\nT02C0.10\nM95\nT01\nX-1000Y2000\nT99\nX500\nG00X1Y1\nX2Y2\nG05\nY3000\nM30"
    df = _lines(spark, text)
    head = drill.drill_header(df).first()
    assert (head["units"], head["zeros"], head["scale"], head["tools"]) == ("INCH", "TZ", 1e-4, {"T01": 0.05, "T02": 0.10})
    hits = drill.drill_hits(df, drill.drill_tools(df), drill.drill_header(df)).orderBy("line_no").collect()
    # an undefined tool changes nothing; a route move sets coordinates but makes no hit
    assert [(round(r["x"], 4), round(r["y"], 4), r["tool"], r["diameter"]) for r in hits] == [
        (-0.1, 0.2, "T01", 0.05), (0.05, 0.2, "T01", 0.05), (0.0002, 0.3, "T01", 0.05),
    ]


def test_vector_groups(spark):
    one = "struct<id:bigint,type:string,x_start:double,y_start:double,x_end:double,y_end:double,x_center:double,y_center:double,radius:double,start_angle:double,end_angle:double>"
    rows = [("red", [(1, "LINE", 0.0, 0.0, 1.0, 1.0, None, None, None, None, None), (2, "TEXT", *[None] * 9)])]
    got = vectors.vector_groups_to_geometry(spark.createDataFrame(rows, f"display_colour string, pattern array<{one}>")).collect()
    assert [(r["id"], r["kind"], r["stroke"], r["x2"]) for r in got] == [(1, "line", "red", 1.0)]


def test_layout_tiles(spark, tmp_path):
    tile = "<MTileDescription><Index>0</Index><CentreX>5</CentreX><CentreY>6</CentreY><XSize>10</XSize><YSize>12</YSize></MTileDescription>"
    layer = f"<MRecipeDeviceLayer><Tag>L</Tag><TileDescriptions>{tile}</TileDescriptions></MRecipeDeviceLayer>"
    device = f"<MRecipeDevice><Tag>D</Tag><Layers>{layer}</Layers></MRecipeDevice>"
    plate = f"<MRecipePlate><Tag>P</Tag><TransformInfo><OffsetX>3</OffsetX></TransformInfo><Devices>{device}</Devices></MRecipePlate>"
    (tmp_path / "l.xml").write_text(f"<MRecipe><Plates>{plate}</Plates></MRecipe>")
    plates = layout_xml.read_layout(spark, str(tmp_path / "l.xml"))
    assert sorted((r["node"], r["parent"]) for r in layout_xml.layout_nodes(plates).collect()) == [("P", None), ("P/D", "P"), ("P/D/L", "P/D")]
    tiles = layout_xml.layout_tiles(plates)
    assert tuple(tiles.first()) == ("P/D/L", 0, 5.0, 6.0, 10.0, 12.0)
    nodes = spark.createDataFrame(
        [("P/D/L", "layer", 0.0, 0.0, 2, 1, 100.0, 0.0)],
        "node_id string, level string, off_x double, off_y double, num_x bigint, num_y bigint, pitch_x double, pitch_y double",
    )
    copies = flatten_tiles(nodes, tiles.withColumnRenamed("parent", "layer_id")).collect()
    assert sorted(r["centre_x"] for r in copies) == [5.0, 105.0]


def test_affine_of_degenerate_groups(spark):
    rows = [
        *[(1, x, y, 2 * x - y + 1, x + 3 * y - 5) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (5.0, 7.0))],
        (2, 3.0, 4.0, 10.0, 20.0),  # one point: minimum norm
        (3, 0.0, 0.0, 7.0, 8.0),  # the origin alone: a pure translation
    ]
    got = {r["grp"]: r for r in estimate_affine(spark.createDataFrame(rows, "grp bigint, x double, y double, mx double, my double")).collect()}
    assert [got[1][c] for c in ("a", "b", "c", "d", "tx", "ty")] == pytest.approx([2, 1, -1, 3, 1, -5])
    a = np.array([[3.0, 4.0, 1.0]])
    (ra, rb), (rc, rd), (rx, ry) = np.linalg.pinv(a) @ np.array([[10.0, 20.0]])
    assert [got[2][c] for c in ("a", "b", "c", "d", "tx", "ty")] == pytest.approx([ra, rb, rc, rd, rx, ry])
    assert [got[3][c] for c in ("a", "b", "c", "d", "tx", "ty")] == pytest.approx([1, 0, 0, 1, 7, 8])
