"""Queries over the text and file sources and the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.catalog.joins import _PART, _ROUND_PART, _TILES
from geoloom.catalog.shapes import rounded
from geoloom.functions.geometry import fixed
from geoloom.operators import aggregate as agg
from geoloom.operators import spatial as sp
from geoloom.operators.transform import concat_geometries
from geoloom.plans.scratch import materialize, scratch_path
from geoloom.sources import datasource, drill, dxf, lines, sinks, stl, vectors

_REAL = "CAST({} AS DOUBLE)"


@query(
    "dxf_entities", "dxf_line",
    sql="""
    SELECT file, floor(min(line_no) / 2)::BIGINT AS entity, 'LINE' AS kind, max(CASE WHEN k = 5 THEN text END) AS layer,
           max(CASE WHEN k = 9 THEN text END)::DOUBLE AS x1, max(CASE WHEN k = 11 THEN text END)::DOUBLE AS y1,
           max(CASE WHEN k = 13 THEN text END)::DOUBLE AS x2, max(CASE WHEN k = 15 THEN text END)::DOUBLE AS y2
    FROM (SELECT *, line_no // 18 AS e, line_no % 18 AS k FROM fx_dxf_line) t GROUP BY file, e""",
)
def _(fx):
    return dxf.dxf_entities(fx.dxf_line).select("file", "entity", "kind", "layer", "x1", "y1", "x2", "y2")


@query(
    "dxf_round_trip", "segment", "curve", "point",
    sql="""
    SELECT 'LINE' AS kind, layer, x1, y1, x2, y2, NULL::DOUBLE AS r, NULL::DOUBLE AS a0, NULL::DOUBLE AS a1 FROM fx_segment
    UNION ALL SELECT 'POINT', layer, x, y, NULL, NULL, NULL, NULL, NULL FROM fx_point
    UNION ALL SELECT upper(kind), 'curves', cx, cy, NULL, NULL, r, CASE WHEN kind = 'arc' THEN round(a0, 6) END, CASE WHEN kind = 'arc' THEN round(a1, 6) END FROM fx_curve""",
)
def _(fx):
    # to text files per layer, read back by lines, and parsed
    shapes = concat_geometries(
        fx.segment.select(F.lit("line").alias("kind"), "id", "layer", "x1", "y1", "x2", "y2"),
        fx.point.select(F.lit("point").alias("kind"), (F.col("id") + 10**9).alias("id"), "layer", F.col("x").alias("x1"), F.col("y").alias("y1")),
        fx.curve.select("kind", (F.col("id") + 2 * 10**9).alias("id"), F.lit("curves").alias("layer"), "cx", "cy", "r", "a0", "a1"),
    )
    path = scratch_path(fx.spark, "drawing")
    sinks.save_dxf(sinks.write_dxf_lines(shapes, packed=True), path)
    back = dxf.dxf_entities(lines.read_lines(fx.spark, path))
    return back.select("kind", "layer", "x1", "y1", "x2", "y2", "r", fixed("a0", 6).alias("a0"), fixed("a1", 6).alias("a1"))


@query(
    "dxf_polylines", "vertex",
    sql="""
    , v AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 0.5 ELSE 0.0 END AS bulge, path_id % 2 AS flag, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
                   first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, count(*) OVER (PARTITION BY path_id) AS n
            FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    e AS (SELECT path_id, seq, bulge, x AS x1, y AS y1, coalesce(nx, CASE WHEN flag = 1 AND n > 1 THEN fx END) AS x2,
                 coalesce(ny, CASE WHEN flag = 1 AND n > 1 THEN fy END) AS y2 FROM v)
    SELECT path_id, CAST(2 * ((seq - 1) // 3) + CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS piece, seq,
           CASE WHEN bulge <> 0 THEN 'arc' ELSE 'line' END AS kind, x1, y1, x2, y2, CAST(bulge AS DOUBLE) AS bulge FROM e WHERE x2 IS NOT NULL""",
)
def _(fx):
    v = fx.vertex.withColumns(
        {"bulge": F.when(F.col("seq") % 3 == 0, 0.5).otherwise(0.0), "flag": (F.col("path_id") % 2).cast("int")}
    )
    return dxf.dxf_polylines(v, ["path_id"])


@query("dxf_layers", "dxf_line", sql="SELECT DISTINCT file, text AS layer FROM fx_dxf_line WHERE line_no % 18 = 5")
def _(fx):
    return dxf.dxf_layers(fx.dxf_line)


@query(
    "dxf_version", "dxf_line", "dxf_header",
    sql="SELECT file, text AS version, text IN ('AC1015', 'AC1018', 'AC1021', 'AC1024') AS supported FROM fx_dxf_header WHERE line_no = -1",
)
def _(fx):
    return dxf.dxf_version(fx.dxf_header.unionByName(fx.dxf_line))


@query("extract_layers", "segment",
       sql="SELECT id, layer, x1, y1, x2, y2 FROM fx_segment WHERE layer IN ('1-URGENT', '5-LOW')")
def _(fx):
    return dxf.extract_layers(fx.segment.drop("path_id"), ["1-URGENT", "5-LOW"])


@query(
    "match_line_sequence", "dxf_line",
    sql="""SELECT * FROM (SELECT file, line_no, text, CASE WHEN lead(line_no) OVER w = line_no + 1 THEN lead(text) OVER w END AS next_text,
                  min(CASE WHEN text = '8' THEN line_no END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS layer_line
           FROM fx_dxf_line WINDOW w AS (PARTITION BY file ORDER BY line_no)) q WHERE text = '0' AND next_text = 'LINE' AND layer_line IS NOT NULL""",
)
def _(fx):
    pairs = lines.match_line_sequence(fx.dxf_line, "^0$", "^LINE$")
    until = lines.each_match_until(fx.dxf_line, "^0$", "^8$").select("file", "line_no", F.col("next_line").alias("layer_line"))
    return pairs.join(until, ["file", "line_no"])


@query(
    "drill_header", "drill_program",
    sql="""
    SELECT file, max(CASE WHEN text LIKE 'METRIC%' THEN 'METRIC' END) AS units, max(CASE WHEN text LIKE 'METRIC%' THEN right(text, 2) END) AS zeros,
           max(CASE WHEN text LIKE 'VER,%' THEN substr(text, 5) END)::INTEGER AS version, max(CASE WHEN text LIKE 'FMAT,%' THEN substr(text, 6) END)::INTEGER AS format,
           string_agg(CASE WHEN text LIKE 'T_C%' THEN substr(text, 1, 2) || '=' || substr(text, 4) END, ' ' ORDER BY text) AS tools,
           0.01::DOUBLE AS scale
    FROM fx_drill_program WHERE line_no < 0 GROUP BY file""",
)
def _(fx):
    head = drill.drill_header(fx.drill_program)
    tools = F.transform(
        F.array_sort(F.map_entries("tools")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return head.withColumn("tools", F.array_join(tools, " "))


@query(
    "drill_hits", "drill_line",
    sql="""
    , p AS (SELECT file, line_no, text, last_value(CASE WHEN text LIKE 'T%' THEN text END IGNORE NULLS) OVER w AS tool,
                   last_value(CASE WHEN text LIKE '%Y%' THEN regexp_extract(text, 'Y(\\d+)', 1)::DOUBLE END IGNORE NULLS) OVER w AS y
            FROM fx_drill_line WINDOW w AS (PARTITION BY file ORDER BY line_no))
    SELECT file, line_no, regexp_extract(text, 'X(\\d+)', 1)::DOUBLE AS x, coalesce(y, 0) AS y, coalesce(tool, '0') AS tool FROM p WHERE text LIKE 'X%'""",
)
def _(fx):
    return drill.drill_hits(fx.drill_line, repeats=False).select("file", "line_no", "x", "y", "tool")


# every order writes eleven lines, so the truth follows from the order key alone
_HITS = """
    SELECT 'prog' || CAST(o_orderkey % 50 AS STRING) AS file, o_orderkey * 11 + 2 + h AS line_no, CAST(c AS BIGINT) AS copy,
           (CASE h WHEN 0 THEN 10000 + (o_orderkey * 7919) % 10007 ELSE 20000 + (o_orderkey * 31) % 401 END + CASE WHEN c > 0 THEN 50000 ELSE 0 END) * 0.01::DOUBLE AS x,
           (10000 + (o_orderkey * 104729) % 10009 + CASE WHEN c > 1 THEN 70000 ELSE 0 END) * 0.01::DOUBLE AS y,
           'T' || CAST(o_custkey % 4 + 1 AS STRING) AS tool,
           CASE o_custkey % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 WHEN 2 THEN 1.2 ELSE 3.0 END::DOUBLE AS diameter
    FROM orders CROSS JOIN (VALUES (0), (1)) AS a(h) CROSS JOIN (VALUES (0), (1), (2)) AS b(c)"""


def _program_hits(fx):
    program = fx.drill_program
    header, tools = drill.drill_facts(program)
    return drill.drill_hits(program, tools, header)


@query(
    "drill_route_mode", "drill_program",
    sql="""
    SELECT 'prog' || CAST(o_orderkey % 50 AS STRING) AS file, o_orderkey * 11 + 2 + h AS line_no,
           CAST(CASE h WHEN 0 THEN 10000 + (o_orderkey * 7919) % 10007 ELSE 20000 + (o_orderkey * 31) % 401 END AS DOUBLE) AS x,
           CAST(10000 + (o_orderkey * 104729) % 10009 AS DOUBLE) AS y
    FROM orders CROSS JOIN (VALUES (0), (1)) AS a(h)""",
)
def _(fx):
    return drill.drill_hits(fx.drill_program, repeats=False).select("file", "line_no", "x", "y")


@query("drill_step_repeat", sql=f"SELECT file, line_no, copy, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, tool, diameter FROM ({_HITS}) h")
def _(fx):
    return rounded(_program_hits(fx))


@query("drill_circles", sql=f"""SELECT file, line_no, copy, 'circle' AS kind, round(x, 4) + 0.0 AS cx, round(y, 4) + 0.0 AS cy, round(diameter / 2, 4) + 0.0 AS r, tool
                                FROM ({_HITS}) h""")  # fmt: skip
def _(fx):
    return rounded(drill.drill_circles(_program_hits(fx)))


_FACETS = "SELECT {} x0, y0, z0, x1, y1, z1, x2, y2, z2 FROM fx_facet WHERE greatest(z0, z1, z2) - least(z0, z1, z2) > 0.0001"


@query("stl_ascii_facets", "facet", sql=_FACETS.format("'mesh' || CAST(mesh_id AS STRING) AS file, facet_id % 12 AS facet_no,"))
def _(fx):
    return stl.stl_ascii_facets(fx.stl_line)


@query("stl_binary_facets", "facet", sql=_FACETS.format(""))
def _(fx):
    path = scratch_path(fx.spark, "stl")
    stl.write_binary_stl(fx.facet, path)
    return stl.stl_binary_facets(fx.spark, path + "/*.stl").select(*stl.CORNERS)


@query(
    "vectors_to_geometry", "curve", "segment", "point",
    sql="""
    SELECT id, 'line' AS kind, layer AS stroke, x1, y1, x2, y2, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy, NULL::DOUBLE AS r, NULL::DOUBLE AS a0, NULL::DOUBLE AS a1 FROM fx_segment
    UNION ALL SELECT id, kind, 'red', NULL, NULL, NULL, NULL, cx, cy, r, CASE WHEN kind = 'arc' THEN a0 END, CASE WHEN kind = 'arc' THEN a1 END FROM fx_curve
    UNION ALL SELECT id, 'point', layer, NULL, NULL, NULL, NULL, x, y, NULL, NULL, NULL FROM fx_point""",
)
def _(fx):
    lines_ = fx.segment.select(
        "id", F.lit("LINE").alias("type"), F.col("layer").alias("colour"), F.col("x1").alias("x_start"), F.col("y1").alias("y_start"),
        F.col("x2").alias("x_end"), F.col("y2").alias("y_end"),
    )
    curves = fx.curve.select(
        "id", F.upper("kind").alias("type"), F.lit("red").alias("colour"), F.col("cx").alias("x_center"), F.col("cy").alias("y_center"),
        F.col("r").alias("radius"), F.col("a0").alias("start_angle"), F.col("a1").alias("end_angle"),
    )
    points = fx.point.select("id", F.lit("POINT").alias("type"), F.col("layer").alias("colour"), F.col("x").alias("x_center"), F.col("y").alias("y_center"))
    records = lines_.unionByName(curves, True).unionByName(points, True)
    return vectors.vectors_to_geometry(records)


@query(
    "write_dxf_lines", "segment",
    sql="""
    , t AS (SELECT layer, id, unnest(['0', 'LINE', '100', 'AcDbEntity', '8', layer, '100', 'AcDbLine', '10', CAST(x1 AS STRING), '20', CAST(y1 AS STRING), '30', '0.0',
                   '11', CAST(x2 AS STRING), '21', CAST(y2 AS STRING), '31', '0.0']) AS text, unnest(range(20)) AS n FROM fx_segment)
    SELECT layer, id, n, text FROM t""",
)
def _(fx):
    return sinks.write_dxf_lines(fx.segment.withColumn("kind", F.lit("line")))


@query("write_by_layer", "segment", sql="SELECT id, layer, x1, y1, x2, y2 FROM fx_segment")
def _(fx):
    path = scratch_path(fx.spark, "layers")
    sinks.write_by_layer(fx.segment.drop("path_id"), path)
    return fx.spark.read.schema("id bigint, x1 double, y1 double, x2 double, y2 double, layer string").parquet(path)


@query("write_by_tile", "segment",
       sql="," + _TILES.format(pad=0) + _PART + f" SELECT id, tile, {_ROUND_PART} FROM p")
def _(fx):
    path = scratch_path(fx.spark, "tiles")
    ext = agg.extents_agg(fx.segment).drop("n")
    parts = sp.clip_to_grid(fx.segment, ext, 700.0, 600.0, [])
    sinks.write_by_tile(parts.select("id", "tile", "x1", "y1", "x2", "y2"), path)
    return rounded(fx.spark.read.schema("id bigint, x1 double, y1 double, x2 double, y2 double, tile bigint").parquet(path))


@query(
    "mark_commands", "vertex", "curve", "segment",
    sql="""
    , c AS (SELECT *, CASE kind WHEN 'circle' THEN 0 ELSE a0 END AS s FROM fx_curve)
    SELECT 'path' AS kind, path_id AS id, seq, CASE WHEN seq = 1 THEN 'jump' ELSE 'mark' END AS op, floor(x * 7.3 + 0.5)::INTEGER AS x,
           floor(y * 7.3 + 0.5)::INTEGER AS y, NULL::DOUBLE AS value FROM fx_vertex
    UNION ALL SELECT 'curve', id, 0, 'jump', floor((cx + r * cos(s)) * 7.3 + 0.5)::INTEGER, floor((cy + r * sin(s)) * 7.3 + 0.5)::INTEGER, NULL FROM c
    UNION ALL SELECT 'curve', id, 1, 'arc', floor(cx * 7.3 + 0.5)::INTEGER, floor(cy * 7.3 + 0.5)::INTEGER,
           CASE kind WHEN 'circle' THEN 360 ELSE round(degrees(CASE WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END), 4) + 0.0 END FROM c
    UNION ALL SELECT 'line', id, 0, 'jump', floor(x1 * 7.3 + 0.5)::INTEGER, floor(y1 * 7.3 + 0.5)::INTEGER, NULL FROM fx_segment
    UNION ALL SELECT 'line', id, 1, 'mark', floor(x2 * 7.3 + 0.5)::INTEGER, floor(y2 * 7.3 + 0.5)::INTEGER, NULL FROM fx_segment""",
)
def _(fx):
    paths = sinks.mark_path_commands(fx.vertex, 7.3).select(F.lit("path").alias("kind"), "*")
    shapes = fx.segment.select("id", F.lit("line").alias("kind"), "x1", "y1", "x2", "y2").unionByName(fx.curve, True)
    # the ids of lines and curves overlap, so each kind is written under its own name
    both = paths
    for kind, rows in (("line", shapes.filter("kind = 'line'")), ("curve", shapes.filter("kind <> 'line'"))):
        both = both.unionByName(sinks.mark_commands(rows, 7.3).select(F.lit(kind).alias("kind"), "*"))
    return rounded(both)


def _shapes(fx):
    return concat_geometries(
        fx.segment.select(F.lit("line").alias("kind"), "id", "layer", "x1", "y1", "x2", "y2"),
        fx.curve.select("kind", (F.col("id") + 2 * 10**9).alias("id"), F.lit("curves").alias("layer"), "cx", "cy", "r", "a0", "a1"),
    )


@query(
    "dxf_files", "segment", "curve",
    sql="""
    SELECT 'LINE' AS kind, layer, x1, y1, x2, y2, NULL::DOUBLE AS r, NULL::DOUBLE AS a0 FROM fx_segment WHERE layer IN ('1-URGENT', '5-LOW')
    UNION ALL SELECT upper(kind), 'curves', cx, cy, NULL, NULL, r, CASE WHEN kind = 'arc' THEN round(a0, 6) END FROM fx_curve""",
)
def _(fx):
    # written by the staged writer, read in byte ranges of a few entities, two layers and the curves only
    spark, path = datasource.register(fx.spark), scratch_path(fx.spark, "dxf")
    text = sinks.write_dxf_lines(_shapes(fx)).repartitionByRange("layer", "id").sortWithinPartitions("layer", "id", "n")
    text.select("text").write.format("dxf").mode("append").save(path)
    wanted = spark.read.format("dxf").options(rangeBytes=100_000, columns="kind,layer,x1,y1,x2,y2,r,a0", layers="1-URGENT,5-LOW,curves").load(path)
    return wanted.select("kind", "layer", "x1", "y1", "x2", "y2", "r", fixed("a0", 6).alias("a0"))


@query("stl_files", "facet", sql=f"SELECT 'binary' AS form, {_FACETS.format('').removeprefix('SELECT ')} UNION ALL SELECT 'text', {_FACETS.format('').removeprefix('SELECT ')}")
def _(fx):
    spark, binary, text = datasource.register(fx.spark), scratch_path(fx.spark, "mesh"), scratch_path(fx.spark, "mesh-text")
    fx.facet.select(*stl.CORNERS).write.format("stl").mode("append").save(binary)
    rows = fx.stl_line.repartitionByRange("file").sortWithinPartitions("file", "line_no")
    rows.select("text").write.format("dxf").mode("append").save(text)  # drawing lines or mesh lines, text is text
    forms = {"binary": binary, "text": text}
    parts = [spark.read.format("stl").option("rangeBytes", 50_000).load(p).select(F.lit(f).alias("form"), *stl.CORNERS) for f, p in forms.items()]
    return parts[0].unionByName(parts[1])


@query(
    "drill_files", "drill_program",
    sql="""
    SELECT 'prog' || CAST(o_orderkey % 50 AS STRING) AS file,
           CAST(CASE h WHEN 0 THEN 10000 + (o_orderkey * 7919) % 10007 ELSE 20000 + (o_orderkey * 31) % 401 END AS DOUBLE) AS x,
           CAST(10000 + (o_orderkey * 104729) % 10009 AS DOUBLE) AS y
    FROM orders CROSS JOIN (VALUES (0), (1)) AS a(h)""",
)
def _(fx):
    # one text file a program; the commands come back by byte ranges, ordered by where they stand
    spark, path = datasource.register(fx.spark), scratch_path(fx.spark, "programs")
    laid = fx.drill_program.repartitionByRange("file").sortWithinPartitions("file", "line_no")
    laid.select("file", "text").write.partitionBy("file").text(path)
    back = spark.read.format("drill").option("rangeBytes", 20_000).load(path)
    named = back.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), F.col("at").alias("line_no"), "text")
    named = materialize(named, "commands")  # the files are read once; the scan below reads its lines several times
    return drill.drill_hits(named, repeats=False).select("file", "x", "y")


@query(
    "dxf_polyline_text", "vertex",
    sql="""
    , s AS (SELECT path_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq))
    SELECT 'path' || CAST(path_id AS STRING) AS file, 'outline' AS layer, 6 + 2 * (seq - 1) AS seq, 'line' AS kind, x1, y1, x2, y2 FROM s WHERE x2 IS NOT NULL""",
)
def _(fx):
    # written as drawing lines, one file a path, and read back from the text
    lines_ = sinks.write_dxf_path_lines(fx.vertex.withColumn("layer", F.lit("outline")))
    head = 12  # lines before the first vertex, four a vertex after them
    place = F.when(F.col("seq") < 0, F.col("n")).otherwise(head + (F.col("seq") - 1) * 4 + F.col("n"))
    text = lines_.select(F.concat(F.lit("path"), F.col("id").cast("string")).alias("file"), place.cast("bigint").alias("line_no"), "text")
    pieces = dxf.dxf_polylines(dxf.dxf_polyline_vertices(text), ["file", "path_id", "layer"])
    return pieces.select("file", "layer", "seq", "kind", "x1", "y1", "x2", "y2")


@query(
    "dxf_spline_text", "segment",
    sql="""
    , t AS (SELECT 's' || CAST(id % 20 AS STRING) AS file, id * 16 AS entity, layer, unnest(['knot', 'knot', 'knot', 'knot', 'knot', 'knot', 'x', 'y', 'x', 'y', 'x', 'y']) AS part,
                   unnest([1, 2, 3, 4, 5, 6, 1, 1, 2, 2, 3, 3]) AS i, unnest([0.0, 0.0, 0.0, 1.0, 1.0, 1.0, x1, y1, x2, y1, x2, y2]) AS v FROM fx_segment)
    SELECT file, entity, layer, 2::INTEGER AS degree, 0::INTEGER AS flag, part, i::BIGINT AS i, v::DOUBLE AS v FROM t""",
)
def _(fx):
    def real(name):
        return F.col(name).cast("string")

    head = [F.lit(t) for t in ("0", "SPLINE", "8")] + [F.col("layer")] + [F.lit(t) for t in ("70", "0", "71", "2")]
    knots = [F.lit(t) for k in ("0", "0", "0", "1", "1", "1") for t in ("40", k)]
    points = [c for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2")) for c in (F.lit("10"), real(x), F.lit("20"), real(y))]
    body = [*head, *knots, *points]
    file = F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("file")
    rows = fx.segment.select(file, "id", F.posexplode(F.array(*body)).alias("n", "text"))
    return dxf.dxf_splines(rows.select("file", (F.col("id") * len(body) + F.col("n")).alias("line_no"), "text"))
