"""Queries over the spatial joins, tilings and boolean operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.catalog.shapes import rounded
from geoloom.functions.geometry import fixed
from geoloom.operators import aggregate as agg
from geoloom.operators import clipping
from geoloom.operators import spatial as sp
from geoloom.operators.generate import box_edges, path_to_segments, tile_grid

_CROSS = """
    , c AS (SELECT a.id AS id_a, b.id AS id_b, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy,
                   b.x1 AS bx, b.y1 AS by_, b.x2 - b.x1 AS ex, b.y2 - b.y1 AS ey
            FROM fx_segment a JOIN fx_segment b ON a.id < b.id
             AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
             AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)),
    p AS (SELECT *, ((bx - ax) * ey - (by_ - ay) * ex) / (dx * ey - dy * ex) AS t,
                 ((bx - ax) * dy - (by_ - ay) * dx) / (dx * ey - dy * ex) AS u FROM c WHERE dx * ey - dy * ex <> 0),
    x AS (SELECT id_a, id_b, ax + t * dx AS x, ay + t * dy AS y FROM p WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query("segment_intersections", "segment",
       sql=_CROSS + " SELECT id_a, id_b, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM x")
def _(fx):
    return rounded(sp.segment_intersections(fx.segment))


@query("snap_distinct", "segment",
       sql=_CROSS + """ SELECT CAST(floor(x / 10.0 + 0.5) AS BIGINT) AS kx, CAST(floor(y / 10.0 + 0.5) AS BIGINT) AS ky, count(*) AS n
                        FROM x GROUP BY 1, 2""")  # fmt: skip
def _(fx):
    return agg.snap_distinct(sp.segment_intersections(fx.segment), 10.0).select("kx", "ky", "n")


@query(
    "line_query", "segment", "curve",
    sql="""
    , l AS (SELECT id AS line_id, cx AS ax, cy AS ay, 9000 - 2 * cx AS dx, 9500 - 2 * cy AS dy FROM fx_curve),
    p AS (SELECT line_id, id, ax, ay, dx, dy, ((x1 - ax) * (y2 - y1) - (y1 - ay) * (x2 - x1)) / (dx * (y2 - y1) - dy * (x2 - x1)) AS t,
                 ((x1 - ax) * dy - (y1 - ay) * dx) / (dx * (y2 - y1) - dy * (x2 - x1)) AS u
          FROM l CROSS JOIN fx_segment WHERE dx * (y2 - y1) - dy * (x2 - x1) <> 0)
    SELECT line_id, id, row_number() OVER (PARTITION BY line_id ORDER BY t, id) AS hit, round(ax + t * dx, 4) + 0.0 AS x,
           round(ay + t * dy, 4) + 0.0 AS y FROM p WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""",
)
def _(fx):
    lines = fx.curve.select(
        F.col("id").alias("line_id"), F.col("cx").alias("x1"), F.col("cy").alias("y1"),
        (9000 - F.col("cx")).alias("x2"), (9500 - F.col("cy")).alias("y2"),
    )
    return rounded(sp.line_query(lines, fx.segment).drop("t"))


@query(
    "points_on_segments", "vertex", "chain",
    sql="""
    SELECT v.path_id, v.seq, c.id FROM fx_vertex v JOIN fx_chain c
      ON v.x BETWEEN least(c.x1, c.x2) AND greatest(c.x1, c.x2) AND v.y BETWEEN least(c.y1, c.y2) AND greatest(c.y1, c.y2)
     AND abs((c.x2 - c.x1) * (v.y - c.y1) - (c.y2 - c.y1) * (v.x - c.x1)) < 0.001""",
)
def _(fx):
    found = sp.points_on_segments(fx.vertex, fx.chain.drop("path_id"), 1e-5)
    return found.select(F.col("p_path_id").alias("path_id"), F.col("p_seq").alias("seq"), F.col("s_id").alias("id"))


@query(
    "segments_through_boxes", "segment", "box",
    sql="""
    , j AS (SELECT s.id AS s_id, b.id AS b_id, x1, y1, x2, y2, min_x, min_y, max_x, max_y FROM fx_segment s JOIN fx_box b
              ON least(x1, x2) <= max_x AND greatest(x1, x2) >= min_x AND least(y1, y2) <= max_y AND greatest(y1, y2) >= min_y),
    k AS (SELECT *, (x2 - x1) * (min_y - y1) - (y2 - y1) * (min_x - x1) AS k1, (x2 - x1) * (min_y - y1) - (y2 - y1) * (max_x - x1) AS k2,
                 (x2 - x1) * (max_y - y1) - (y2 - y1) * (min_x - x1) AS k3, (x2 - x1) * (max_y - y1) - (y2 - y1) * (max_x - x1) AS k4 FROM j)
    SELECT s_id, b_id FROM k WHERE NOT (least(k1, k2, k3, k4) > 0 OR greatest(k1, k2, k3, k4) < 0)""",
)
def _(fx):
    return sp.segments_through_boxes(fx.segment, fx.box)


@query(
    "point_in_polygon", "point", "box",
    sql="""SELECT p.id AS point, b.id AS poly FROM fx_point p JOIN fx_box b
           ON p.x >= min_x AND p.x < max_x AND p.y >= min_y AND p.y < max_y""",
)
def _(fx):
    return sp.point_in_polygon(fx.point, box_edges(fx.box))


@query(
    "points_in_boxes", "point", "box",
    sql="SELECT p.id AS point, b.id AS box FROM fx_point p JOIN fx_box b ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y",
)
def _(fx):
    found = sp.points_in_boxes(fx.point.select("id", "x", "y"), fx.box)
    return found.select(F.col("p_id").alias("point"), F.col("b_id").alias("box"))


_INSIDE = """a JOIN fx_box b ON a.id <> b.id AND a.min_x <= b.min_x AND a.min_y <= b.min_y AND a.max_x >= b.max_x AND a.max_y >= b.max_y"""


@query("box_contains", "box", sql=f"SELECT a.id AS outer, b.id AS inner FROM fx_box {_INSIDE}")
def _(fx):
    return sp.box_contains(fx.box)


@query(
    "containment_tree", "box",
    sql=f"""
    , p AS (SELECT b.id, arg_min(a.id, (a.max_x - a.min_x) * (a.max_y - a.min_y) * 1000000 - a.id) AS parent_id, count(*) AS depth
            FROM fx_box {_INSIDE} GROUP BY b.id)
    SELECT x.id, parent_id, coalesce(depth, 0) AS depth, CASE WHEN coalesce(depth, 0) % 2 = 0 THEN 'fg' ELSE 'bg' END AS fill,
           (max_x - min_x) * (max_y - min_y) AS area FROM fx_box x LEFT JOIN p ON x.id = p.id""",
)
def _(fx):
    return sp.containment_tree(fx.box)


# parts of one remainder lie in each other, 20 deep; every seventh nest is crossed by a long box, and boxes of size 0 and copies occur
_NEST = """SELECT p_partkey AS id, CAST(bx + k AS DOUBLE) AS min_x, CAST(by_ + k + CASE WHEN g % 7 = 0 AND k = 5 THEN 12 ELSE 0 END AS DOUBLE) AS min_y,
                   CAST(bx + 100 - k AS DOUBLE) AS max_x, CAST(by_ + 100 - k AS DOUBLE) AS max_y
            FROM (SELECT p_partkey, floor(p_partkey / 20) AS g, CASE WHEN p_partkey % 20 = 19 THEN 50 ELSE p_partkey % 20 - p_partkey % 2 * (p_partkey % 4 - 1) / 2 END AS k,
                         floor(p_partkey / 20) % 1000 * 200 AS bx, floor(floor(p_partkey / 20) / 1000) * 200 AS by_ FROM part) t"""


@query(
    "nesting_forest",
    sql=f"""
    WITH box AS ({_NEST}),
    p AS (SELECT b.id, arg_min(a.id, (a.max_x - a.min_x) * (a.max_y - a.min_y) * 1000000 - a.id) AS parent_id, count(*) AS depth
          FROM box a JOIN box b ON a.id <> b.id AND a.min_x <= b.min_x AND a.min_y <= b.min_y AND a.max_x >= b.max_x AND a.max_y >= b.max_y
               AND (a.min_x < b.min_x OR a.min_y < b.min_y OR a.max_x > b.max_x OR a.max_y > b.max_y OR a.id < b.id) GROUP BY b.id)
    SELECT x.id, parent_id, coalesce(depth, 0) AS depth, CASE WHEN coalesce(depth, 0) % 2 = 0 THEN 'fg' ELSE 'bg' END AS fill,
           (max_x - min_x) * (max_y - min_y) AS area FROM box x LEFT JOIN p ON x.id = p.id""",
)
def _(fx):
    fx.table("part").createOrReplaceTempView("part")
    return sp.containment_tree(fx.spark.sql(_NEST), swept=True)


# clipping checks: a part is the stretch of the line parameter inside both slabs
_PART = """
    q AS (SELECT *, CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN bx0 AND bx1 THEN 0 ELSE 2 END ELSE least((bx0-x1)/(x2-x1), (bx1-x1)/(x2-x1)) END AS ex,
                 CASE WHEN x2 = x1 THEN CASE WHEN x1 BETWEEN bx0 AND bx1 THEN 1 ELSE -1 END ELSE greatest((bx0-x1)/(x2-x1), (bx1-x1)/(x2-x1)) END AS lx,
                 CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN by0 AND by1 THEN 0 ELSE 2 END ELSE least((by0-y1)/(y2-y1), (by1-y1)/(y2-y1)) END AS ey,
                 CASE WHEN y2 = y1 THEN CASE WHEN y1 BETWEEN by0 AND by1 THEN 1 ELSE -1 END ELSE greatest((by0-y1)/(y2-y1), (by1-y1)/(y2-y1)) END AS ly
          FROM j),
    c AS (SELECT *, greatest(0, ex, ey) AS t0, least(1, lx, ly) AS t1 FROM q),
    p AS (SELECT *, x1 + (x2-x1)*t0 AS px1, y1 + (y2-y1)*t0 AS py1, x1 + (x2-x1)*t1 AS px2, y1 + (y2-y1)*t1 AS py2
          FROM c WHERE t0 < t1 OR (t0 <= t1 AND x1 = x2 AND y1 = y2))"""
_ROUND_PART = ", ".join(f"round(p{c}, 4) + 0.0 AS {c}" for c in ("x1", "y1", "x2", "y2"))

# the tiling of all segments, 700 x 600, no padding or shift
_TILES = """
    e AS (SELECT min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x1, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS y1 FROM fx_segment),
    n AS (SELECT *, CAST(ceil((x1 - x0 + {pad}) / 700) AS BIGINT) AS nx, CAST(ceil((y1 - y0 + {pad}) / 600) AS BIGINT) AS ny FROM e),
    tile AS (SELECT r * nx + c AS tile, r, c, nx, ny, (x0+x1)/2 - nx*350.0 + c*700 AS bx0, (y0+y1)/2 - ny*300.0 + r*600 AS by0,
                 (x0+x1)/2 - nx*350.0 + c*700 + 700 AS bx1, (y0+y1)/2 - ny*300.0 + r*600 + 600 AS by1
          FROM n CROSS JOIN range(60) AS a(r) CROSS JOIN range(60) AS b(c) WHERE r < ny AND c < nx),
    j AS (SELECT s.id, s.layer, s.x1, s.y1, s.x2, s.y2, t.* FROM fx_segment s JOIN tile t ON least(s.x1, s.x2) <= bx1 AND greatest(s.x1, s.x2) >= bx0
                AND least(s.y1, s.y2) <= by1 AND greatest(s.y1, s.y2) >= by0),"""


def _tiles(fx, pad=0.0):
    return tile_grid(agg.extents_agg(fx.segment).drop("n"), 700.0, 600.0, pad, pad)


@query("clip_to_boxes", "segment",
       sql="," + _TILES.format(pad=0) + _PART + f" SELECT id, tile, {_ROUND_PART} FROM p")
def _(fx):
    parts = sp.clip_to_boxes(fx.segment.select("id", "x1", "y1", "x2", "y2"), _tiles(fx), "tile")
    return rounded(parts.drop("t0", "t1"))


@query("clip_points_to_boxes", "point", "box", sql="SELECT p.id, b.id AS box, x, y FROM fx_point p JOIN fx_box b ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def _(fx):
    return clipping.clip_points(fx.point, fx.box)


# boxes near the curves, of about their size
_NEAR = """SELECT id * 4 + k AS id, cx + (k - 2) * (id % 9 + 3) * 1.5 AS min_x, cy - (k * 7 + id) % 23 AS min_y,
                  cx + (k - 2) * (id % 9 + 3) * 1.5 + (id * 5 + k * 11) % 60 + 1 AS max_x, cy + (k * 13 + id) % 31 + 1 AS max_y FROM fx_curve"""


@query(
    "clip_curves_to_boxes", "curve",
    sql=f"""
    , b AS ({_NEAR.replace("FROM fx_curve", "FROM fx_curve CROSS JOIN range(4) AS n(k)")}),
    c AS (SELECT id, kind, cx, cy, r, CASE kind WHEN 'circle' THEN 0 ELSE a0 END AS s, round(CASE WHEN kind = 'circle' THEN 2 * pi() WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END, 9) AS w
          FROM fx_curve),
    j AS (SELECT c.*, b.id AS box, min_x, min_y, max_x, max_y FROM c JOIN b ON w > 0 AND cx - r <= max_x AND cx + r >= min_x AND cy - r <= max_y AND cy + r >= min_y),
    v AS (SELECT *, unnest([(min_x - cx) / r, (max_x - cx) / r]) AS u, unnest([(min_y - cy) / r, (max_y - cy) / r]) AS q FROM j),
    a AS (SELECT id, box, acos(u) AS t FROM v WHERE abs(u) <= 1 UNION ALL SELECT id, box, -acos(u) FROM v WHERE abs(u) <= 1
          UNION ALL SELECT id, box, asin(q) FROM v WHERE abs(q) <= 1 UNION ALL SELECT id, box, pi() - asin(q) FROM v WHERE abs(q) <= 1),
    m AS (SELECT DISTINCT id, box, t FROM (SELECT id, box, round(t - s - floor((t - s) / (2 * pi())) * 2 * pi(), 9) AS t, w FROM a JOIN j USING (id, box)) z WHERE t > 0 AND t < w
          UNION SELECT id, box, 0 FROM j UNION SELECT id, box, w FROM j),
    i AS (SELECT id, box, t AS lo, lead(t) OVER (PARTITION BY id, box ORDER BY t) AS hi FROM m),
    k AS (SELECT i.*, j.kind, cx, cy, r, s, w FROM i JOIN j USING (id, box) WHERE hi IS NOT NULL AND cx + r * cos(s + (lo + hi) / 2) BETWEEN min_x - 1e-9 * r AND max_x + 1e-9 * r
                 AND cy + r * sin(s + (lo + hi) / 2) BETWEEN min_y - 1e-9 * r AND max_y + 1e-9 * r),
    h AS (SELECT *, CASE WHEN lag(hi) OVER o = lo THEN 0 ELSE 1 END AS begins FROM k WINDOW o AS (PARTITION BY id, box ORDER BY lo)),
    n AS (SELECT *, sum(begins) OVER (PARTITION BY id, box ORDER BY lo) AS run FROM h),
    p AS (SELECT id, box, run, max(kind) AS kind, max(cx) AS cx, max(cy) AS cy, max(r) AS r, max(s) AS s, max(w) AS w, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY id, box, run),
    e AS (SELECT *, min(lo) OVER g = 0 AND max(hi) OVER g = w AND kind = 'circle' AND count(*) OVER g > 1 AS wraps, min(hi) OVER g AS first_hi, max(lo) OVER g AS last_lo
          FROM p WINDOW g AS (PARTITION BY id, box)),
    f AS (SELECT id, box, kind, cx, cy, r, s, w, lo, CASE WHEN wraps AND lo = last_lo THEN hi + first_hi ELSE hi END AS hi FROM e WHERE NOT (wraps AND lo = 0))
    SELECT id, box, CAST(row_number() OVER (PARTITION BY id, box ORDER BY lo) - 1 AS INTEGER) AS piece, CASE WHEN kind = 'circle' AND lo = 0 AND hi = w THEN 'circle' ELSE 'arc' END AS kind, cx, cy, r,
           round(s + lo, 6) + 0.0 AS a0, round(s + hi, 6) + 0.0 AS a1 FROM f""",
)
def _(fx):
    fx.curve.createOrReplaceTempView("fx_curve")
    near = fx.spark.sql(_NEAR.replace("FROM fx_curve", "FROM fx_curve LATERAL VIEW explode(array(0L, 1L, 2L, 3L)) n AS k"))
    found = clipping.clip_curves(fx.curve, near)
    return found.withColumns({c: fixed(c, 6) for c in ("a0", "a1")})


@query(
    "clip_paths_to_boxes", "vertex",
    sql="""
    , b AS (SELECT path_id * 10 + k AS id, min(x) + k * 60 AS min_x, k * 35 + 5.0 AS min_y, min(x) + k * 60 + 190.0 AS max_x, k * 35 + 305.0 AS max_y
            FROM fx_vertex CROSS JOIN range(3) AS n(k) GROUP BY path_id, k),
    s AS (SELECT path_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    j AS (SELECT s.*, b.id AS box, min_x AS bx0, min_y AS by0, max_x AS bx1, max_y AS by1 FROM s JOIN b
          ON x2 IS NOT NULL AND least(x1, x2) <= max_x AND greatest(x1, x2) >= min_x AND least(y1, y2) <= max_y AND greatest(y1, y2) >= min_y),"""
    + _PART.split("p AS (")[0]
    + """ d AS (SELECT * FROM c WHERE t0 < t1),
    l AS (SELECT *, CASE WHEN lag(seq) OVER w + 1 = seq AND lag(t1) OVER w = 1 AND t0 = 0 THEN NULL ELSE seq END AS head FROM d WINDOW w AS (PARTITION BY path_id, box ORDER BY seq)),
    r AS (SELECT *, max(head) OVER (PARTITION BY path_id, box ORDER BY seq) AS run FROM l)
    SELECT path_id, box, run, seq - run + 1 AS seq, round(x1 + (x2 - x1) * t1, 4) + 0.0 AS x, round(y1 + (y2 - y1) * t1, 4) + 0.0 AS y FROM r
    UNION ALL SELECT path_id, box, run, 0, round(x1 + (x2 - x1) * t0, 4) + 0.0, round(y1 + (y2 - y1) * t0, 4) + 0.0 FROM r WHERE head IS NOT NULL""",
)
def _(fx):
    corner = fx.vertex.groupBy("path_id").agg(F.min("x").alias("x")).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    k = F.col("k").cast("double")
    boxes = corner.select(
        (F.col("path_id") * 10 + F.col("k")).alias("id"), (F.col("x") + k * 60).alias("min_x"), (k * 35 + 5.0).alias("min_y"),
        (F.col("x") + k * 60 + 190.0).alias("max_x"), (k * 35 + 305.0).alias("max_y"),
    )
    return rounded(clipping.clip_paths(fx.vertex, boxes))


@query(
    "clip_segments_to_parts", "segment", "box",
    sql=""", j AS (SELECT s.id, x1, y1, x2, y2, b.id AS box, min_x AS bx0, min_y AS by0, max_x AS bx1, max_y AS by1 FROM fx_segment s JOIN fx_box b
              ON least(x1, x2) <= max_x AND greatest(x1, x2) >= min_x AND least(y1, y2) <= max_y AND greatest(y1, y2) >= min_y),"""
    + _PART + f" SELECT id, box, {_ROUND_PART} FROM p",
)
def _(fx):
    parts = sp.clip_to_boxes(fx.segment.select("id", "x1", "y1", "x2", "y2"), fx.box)
    return rounded(parts.drop("t0", "t1"))


@query(
    "generate_tiles", "segment",
    sql="," + _TILES.format(pad=5) + _PART + """,
    l AS (SELECT *, sqrt((px2-px1)*(px2-px1) + (py2-py1)*(py2-py1)) AS len FROM p)
    SELECT id, tile, r AS row, c AS col, round(CASE WHEN len > 0 THEN px1 - (px2-px1)*2/len ELSE px1 END, 3) + 0.0 AS x1,
           round(CASE WHEN len > 0 THEN py1 - (py2-py1)*2/len ELSE py1 END, 3) + 0.0 AS y1,
           round(CASE WHEN len > 0 THEN px2 + (px2-px1)*2/len ELSE px2 END, 3) + 0.0 AS x2,
           round(CASE WHEN len > 0 THEN py2 + (py2-py1)*2/len ELSE py2 END, 3) + 0.0 AS y2 FROM l""",
)
def _(fx):
    ext = agg.extents_agg(fx.segment).drop("n")
    parts = sp.generate_tiles(fx.segment, ext, 700.0, 600.0, [], 5.0, 2.0)
    return rounded(parts.select("id", "tile", "row", "col", "x1", "y1", "x2", "y2"), 3)


_KNOT = [("k1", -3.0, -3.0, 3.0, 3.0), ("k1", -3.0, 3.0, 3.0, -3.0), ("k2", 0.0, -4.0, 0.0, 4.0)]


@query(
    "tile_knots", "segment",
    sql="," + _TILES.format(pad=5) + _PART + """,
    en AS (SELECT *, atan2(py2 - py1, px2 - px1) AS ang, 'start' AS tip, px1 AS ex_, py1 AS ey_ FROM p
           UNION ALL SELECT *, atan2(py2 - py1, px2 - px1), 'end', px2, py2 FROM p),
    ed AS (SELECT *, 'top' AS edge FROM en WHERE r <> ny - 1 AND abs(ey_ - by1) <= 0.001
           UNION ALL SELECT *, 'right' FROM en WHERE c <> nx - 1 AND abs(ex_ - bx1) <= 0.001),
    kn(knot_id, kx1, ky1, kx2, ky2) AS (VALUES ('k1', -3.0::DOUBLE, -3.0::DOUBLE, 3.0::DOUBLE, 3.0::DOUBLE), ('k1', -3.0, 3.0, 3.0, -3.0), ('k2', 0.0, -4.0, 0.0, 4.0))
    SELECT id, tile, tip, edge, k.knot_id, round(ex_ + kx1*cos(ang) - ky1*sin(ang), 3) + 0.0 AS x1, round(ey_ + kx1*sin(ang) + ky1*cos(ang), 3) + 0.0 AS y1,
           round(ex_ + kx2*cos(ang) - ky2*sin(ang), 3) + 0.0 AS x2, round(ey_ + kx2*sin(ang) + ky2*cos(ang), 3) + 0.0 AS y2
    FROM ed JOIN kn k ON k.knot_id = CASE WHEN id % 2 = 0 THEN 'k1' ELSE 'k2' END""",
)
def _(fx):
    ext = agg.extents_agg(fx.segment).drop("n")
    parts = sp.generate_tiles(fx.segment, ext, 700.0, 600.0, [], 5.0)
    parts = parts.withColumn("knot_id", F.when(F.col("id") % 2 == 0, "k1").otherwise("k2"))
    knot = fx.spark.createDataFrame(_KNOT, "knot_id string, x1 double, y1 double, x2 double, y2 double")
    return rounded(sp.tile_knots(parts, knot), 3)


@query(
    "stamp_pattern", "point", "curve",
    sql="""
    SELECT p.id AS anchor, c.id, kind, round(cx * cos(z / 10) - cy * sin(z / 10) + x, 4) + 0.0 AS cx, round(cx * sin(z / 10) + cy * cos(z / 10) + y, 4) + 0.0 AS cy, r,
           CASE WHEN kind = 'arc' THEN round(a0 + z / 10, 6) + 0.0 ELSE a0 END AS a0, CASE WHEN kind = 'arc' THEN round(a1 + z / 10, 6) + 0.0 ELSE a1 END AS a1
    FROM fx_point p JOIN fx_curve c ON p.id // 60 = c.id // 4""",
)
def _(fx):
    # a pattern is four curves; every anchor names one
    anchors = fx.point.withColumns({"pattern_id": F.floor(F.col("id") / 60), "angle": F.col("z") / 10})
    pattern = fx.curve.withColumn("pattern_id", F.floor(F.col("id") / 4))
    return rounded(sp.stamp_pattern(anchors, pattern), 4, a0=6, a1=6)


_RINGS = """
    , ring AS (SELECT id, s AS seq, CASE s WHEN 0 THEN min_x WHEN 3 THEN min_x ELSE max_x END AS x1, CASE WHEN s < 2 THEN min_y ELSE max_y END AS y1,
                   CASE WHEN s < 2 THEN max_x ELSE min_x END AS x2, CASE WHEN s IN (1, 2) THEN max_y ELSE min_y END AS y2
            FROM fx_box CROSS JOIN range(4) AS r(s)),
    cut AS (SELECT a.id, a.seq, b.id AS other, a.x1, a.y1, a.x2, a.y2,
                   CASE WHEN a.y1 = a.y2 THEN (b.x1 - a.x1) / (a.x2 - a.x1) ELSE (b.y1 - a.y1) / (a.y2 - a.y1) END AS t
            FROM ring a JOIN ring b ON a.id <> b.id AND (a.y1 = a.y2) <> (b.y1 = b.y2)
             AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2)
             AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2))"""


@query(
    "split_at_intersections", "box",
    sql=_RINGS + """,
    m AS (SELECT id, seq, x1, y1, x2, y2, t FROM cut WHERE t > 0 AND t < 1 UNION SELECT id, seq, x1, y1, x2, y2, 0 FROM ring
          UNION SELECT id, seq, x1, y1, x2, y2, 1 FROM ring),
    w AS (SELECT *, lead(t) OVER (PARTITION BY id, seq ORDER BY t) AS t1 FROM m)
    SELECT id, seq, round(x1 + (x2-x1)*t, 4) + 0.0 AS x1, round(y1 + (y2-y1)*t, 4) + 0.0 AS y1, round(x1 + (x2-x1)*t1, 4) + 0.0 AS x2,
           round(y1 + (y2-y1)*t1, 4) + 0.0 AS y2 FROM w WHERE t1 IS NOT NULL""",
)
def _(fx):
    edges = box_edges(fx.box)
    return rounded(sp.split_at_intersections(edges).drop("t"))


_BOOL = _RINGS + """,
    pr AS (SELECT a.id AS pa, b.id AS pb FROM fx_box a JOIN fx_box b ON a.id < b.id AND a.min_x <= b.max_x AND b.min_x <= a.max_x
           AND a.min_y <= b.max_y AND b.min_y <= a.max_y),
    lk AS (SELECT pa AS id, pb AS other, 'a' AS side FROM pr UNION ALL SELECT pb, pa, 'b' FROM pr),
    m AS (SELECT l.id, l.other, side, seq, x1, y1, x2, y2, t FROM cut c JOIN lk l ON c.id = l.id AND c.other = l.other WHERE t > 0 AND t < 1
          UNION SELECT l.id, l.other, side, seq, x1, y1, x2, y2, e FROM ring r JOIN lk l ON r.id = l.id CROSS JOIN (VALUES (0), (1)) AS z(e)),
    w AS (SELECT *, lead(t) OVER (PARTITION BY id, other, side, seq ORDER BY t) AS t1 FROM m),
    pc AS (SELECT id, other, side, seq, x1 + (x2-x1)*t AS x1, y1 + (y2-y1)*t AS y1, x1 + (x2-x1)*t1 AS x2, y1 + (y2-y1)*t1 AS y2 FROM w WHERE t1 IS NOT NULL),
    ins AS (SELECT pc.*, (x1+x2)/2 >= min_x AND (x1+x2)/2 < max_x AND (y1+y2)/2 >= min_y AND (y1+y2)/2 < max_y AS inside
            FROM pc JOIN fx_box b ON b.id = pc.other)
    SELECT CASE side WHEN 'a' THEN id ELSE other END AS poly_a, CASE side WHEN 'a' THEN other ELSE id END AS poly_b, side, seq,
           round(x1, 4) + 0.0 AS x1, round(y1, 4) + 0.0 AS y1, round(x2, 4) + 0.0 AS x2, round(y2, 4) + 0.0 AS y2
    FROM ins WHERE inside = {rule}"""


def _boolean(mode):
    def run(fx):
        return rounded(sp.polygon_boolean(box_edges(fx.box), mode).drop("mode"))

    return run


for _mode, _rule in (("union", "false"), ("intersection", "true"), ("subtraction", "(side = 'b')")):
    query(f"polygon_{_mode}", "box", sql=_BOOL.format(rule=_rule))(_boolean(_mode))


@query(
    "polygon_boolean", "box",
    sql=_BOOL.format(rule="inside").replace("SELECT CASE side WHEN 'a' THEN id ELSE other END AS poly_a", "SELECT mode, CASE side WHEN 'a' THEN id ELSE other END AS poly_a")
    .replace("FROM ins WHERE inside = inside", """FROM ins JOIN (VALUES ('union', false, false), ('intersection', true, true), ('subtraction', false, true)) AS z(mode, ra, rb)
             ON inside = CASE side WHEN 'a' THEN ra ELSE rb END"""),
)
def _(fx):
    return rounded(sp.polygon_boolean(box_edges(fx.box), "union", "intersection", "subtraction"))
