"""Queries over measures, generators, transforms and plain aggregations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.functions import affine, affine3
from geoloom.functions import geometry as g
from geoloom.functions.geometry import fixed
from geoloom.operators import aggregate as agg
from geoloom.operators import generate as gen
from geoloom.operators import measure as m
from geoloom.operators import transform as tr
from geoloom.plans.scan import chunk_of, ordered_scan


def rounded(df, places=4, **kept):
    """Doubles rounded for output; other columns as they are."""
    return df.select(
        *[fixed(c, kept.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# ---- measures ---------------------------------------------------------------------------


@query(
    "measure_segments", "segment",
    sql="""
    SELECT id, round(len, 4) + 0.0 AS length, round(len, 4) + 0.0 AS length_3d,
           round(CASE WHEN x2*x2 + y2*y2 > x1*x1 + y1*y1 THEN len ELSE -len END, 4) + 0.0 AS signed_length,
           round(ang, 6) + 0.0 AS angle,
           round((CASE WHEN ang < 0 THEN ang + 2 * pi() ELSE ang END) * 180 / pi(), 6) + 0.0 AS angle_deg,
           CASE WHEN x2 <> x1 THEN round((y2 - y1) / (x2 - x1), 6) + 0.0 END AS gradient,
           CASE WHEN x2 <> x1 THEN round(y1 - (y2 - y1) / (x2 - x1) * x1, 4) + 0.0 END AS intercept,
           CASE WHEN y2 < y1 THEN round(pi(), 6) ELSE 0.0 END AS roll,
           CASE WHEN x2 < x1 THEN round(pi(), 6) ELSE 0.0 END AS pitch,
           round(ang, 6) + 0.0 AS yaw
    FROM (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len,
                 CASE WHEN y2 = y1 AND x2 < x1 THEN pi() ELSE atan2(y2 - y1, x2 - x1) END AS ang FROM fx_segment) s""",
)
def _(fx):
    df = m.measure_segments(fx.segment)
    keep = "id length length_3d signed_length angle angle_deg gradient intercept roll pitch yaw".split()
    six = {c: 6 for c in ("angle", "angle_deg", "gradient", "roll", "pitch", "yaw")}
    return rounded(df.select(*keep), 4, **six)


@query(
    "measure_shapes", "vertex", "curve", "box", "segment",
    sql="""
    , seg AS (SELECT path_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_vertex
              WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    ends AS (SELECT path_id, arg_min(x, seq) hx, arg_min(y, seq) hy, arg_max(x, seq) tx, arg_max(y, seq) ty, count(*) n,
                    max(x) - min(x) AS w, max(y) - min(y) AS h FROM fx_vertex GROUP BY path_id HAVING count(*) > 1),
    sums AS (SELECT path_id, sum(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))) AS len, sum(x1*y2 - x2*y1) AS two
             FROM seg WHERE x2 IS NOT NULL GROUP BY path_id),
    al AS (
      SELECT e.path_id AS id, 'path' AS kind, len AS length,
             CASE WHEN n >= 4 THEN abs(two + tx*hy - hx*ty) / 2 ELSE 0 END AS area, sqrt(w*w + h*h) / 2 AS radius
      FROM ends e JOIN sums s ON e.path_id = s.path_id
      UNION ALL
      SELECT id, kind, sw * r, sw * r * r / 2, r FROM (SELECT *, CASE WHEN kind = 'circle' THEN 2 * pi()
             WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END AS sw FROM fx_curve) c
      UNION ALL
      SELECT id, 'box', 2 * (max_x - min_x + max_y - min_y), (max_x - min_x) * (max_y - min_y),
             sqrt((max_x-min_x)*(max_x-min_x) + (max_y-min_y)*(max_y-min_y)) / 2 FROM fx_box
      UNION ALL
      SELECT id, 'line', sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 0, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) / 2 FROM fx_segment)
    SELECT id, kind, round(length, 4) + 0.0 AS length, round(area, 4) + 0.0 AS area, round(radius, 4) + 0.0 AS radius FROM al""",
)
def _(fx):
    return rounded(m.measure_shapes(vertices=fx.vertex, curves=fx.curve, boxes=fx.box, segments=fx.segment))


_POINT_AT = """
    , seg AS (SELECT path_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_vertex
              WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    len AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len FROM seg WHERE x2 IS NOT NULL),
    run AS (SELECT *, sum(len) OVER (PARTITION BY path_id ORDER BY seq) - len AS before,
                   sum(len) OVER (PARTITION BY path_id) AS total,
                   row_number() OVER (PARTITION BY path_id ORDER BY seq DESC) AS back FROM len),
    hit AS (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS rn FROM run
            WHERE before + len > {t} * total OR back = 1)
    SELECT path_id, round(x1 + (x2 - x1) * ({t} * total - before) / len, 4) + 0.0 AS x,
           round(y1 + (y2 - y1) * ({t} * total - before) / len, 4) + 0.0 AS y
    FROM hit WHERE rn = 1"""


@query("point_at", "vertex", sql=_POINT_AT.format(t="0.3"))
def _(fx):
    return rounded(m.point_at(fx.vertex, 0.3))


@query("point_at_beyond", "vertex", sql=_POINT_AT.format(t="1.25"))
def _(fx):
    return rounded(m.point_at(fx.vertex, 1.25))


_SHAPES = """
    , sh AS (SELECT id, 'line' AS kind, x1, y1, x2, y2, 0.0 AS cx, 0.0 AS cy, 0.0 AS r, 0.0 AS a0, 0.0 AS sw FROM fx_segment
             UNION ALL SELECT id, kind, 0, 0, 0, 0, cx, cy, r, CASE WHEN kind = 'circle' THEN 0 ELSE a0 END,
                              CASE WHEN kind = 'circle' THEN 2 * pi() WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END FROM fx_curve
             UNION ALL SELECT id, 'ellipse', 0, 0, 0, 0, cx, cy, r, a0, a1 - a0 FROM fx_curve
             UNION ALL SELECT id, 'bezier2', x1, y1, x2, y2, y1, x2, 0, 0, 0 FROM fx_segment),
    pt AS (SELECT id, kind, i, CASE kind WHEN 'line' THEN x1 + (x2 - x1) * t WHEN 'bezier2' THEN (1 - t) * (1 - t) * x1 + 2 * t * (1 - t) * cx + t * t * x2
                                         ELSE cx + r * cos(a0 + sw * t) END AS x,
                  CASE kind WHEN 'line' THEN y1 + (y2 - y1) * t WHEN 'bezier2' THEN (1 - t) * (1 - t) * y1 + 2 * t * (1 - t) * cy + t * t * y2
                            ELSE cy + r * (CASE WHEN kind = 'ellipse' THEN 0.5 ELSE 1 END) * sin(a0 + sw * t) END AS y
           FROM (SELECT *, i / 6.0 AS t FROM sh CROSS JOIN range(7) AS n(i)) q)"""


def _shapes(fx):
    lines = fx.segment.select("id", F.lit("line").alias("kind"), "x1", "y1", "x2", "y2")
    curves = fx.curve.select("id", "kind", "cx", "cy", "r", "a0", "a1")
    ellipses = fx.curve.select("id", F.lit("ellipse").alias("kind"), "cx", "cy", F.col("r").alias("ra"), (F.col("r") / 2).alias("rb"), "a0", "a1")
    beziers = fx.segment.select(
        "id", F.lit("bezier2").alias("kind"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("y1").alias("x1"), F.col("x2").alias("y1"), "x2", "y2"
    )
    return tr.concat_geometries(lines, curves, ellipses, beziers)


@query("points_along_shapes", "segment", "curve", sql=_SHAPES + " SELECT id, kind, i, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM pt")
def _(fx):
    return rounded(gen.points_along(_shapes(fx), 7), 3)


@query(
    "split_even_shapes", "segment", "curve",
    sql=_SHAPES + """ SELECT id, i, round(x, 3) + 0.0 AS x1, round(y, 3) + 0.0 AS y1, round(nx, 3) + 0.0 AS x2, round(ny, 3) + 0.0 AS y2
    FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM pt WINDOW w AS (PARTITION BY id, kind ORDER BY i)) WHERE nx IS NOT NULL""",
)
def _(fx):
    return rounded(gen.split_even(_shapes(fx), 6), 3)


@query(
    "points_along_paths", "vertex",
    sql="""
    , s AS (SELECT path_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    l AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len FROM s WHERE x2 IS NOT NULL),
    c AS (SELECT *, sum(len) OVER (PARTITION BY path_id ORDER BY seq) AS upto, sum(len) OVER (PARTITION BY path_id) AS total FROM l),
    g AS (SELECT *, i * total / 10 AS goal FROM c CROSS JOIN range(11) AS n(i)),
    f AS (SELECT *, row_number() OVER (PARTITION BY path_id, i ORDER BY seq) AS rn FROM g WHERE upto >= goal - 1e-6 * total)
    SELECT path_id, i, round(x1 + (x2 - x1) * least(1, (goal - upto + len) / len), 3) + 0.0 AS x, round(y1 + (y2 - y1) * least(1, (goal - upto + len) / len), 3) + 0.0 AS y
    FROM f WHERE rn = 1""",
)
def _(fx):
    return rounded(gen.points_along_paths(m.measured_path_segments(fx.vertex), 11), 3)


@query(
    "extents_of", "segment",
    sql="""
    , b AS (SELECT id, least(x1, x2) AS min_x, least(y1, y2) AS min_y, greatest(x1, x2) AS max_x, greatest(y1, y2) AS max_y FROM fx_segment)
    SELECT id, min_x, min_y, max_x, max_y, max_x - min_x AS width, max_y - min_y AS height,
           round(sqrt((max_x-min_x)*(max_x-min_x) + (max_y-min_y)*(max_y-min_y)), 4) + 0.0 AS hypotenuse,
           (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y,
           (max_x - min_x) * (max_y - min_y) AS box_area, 2 * (max_x - min_x + max_y - min_y) AS box_perimeter,
           CASE WHEN min_x > 0 THEN min_x WHEN max_x < 0 THEN max_x ELSE 0.0 END AS near_x,
           CASE WHEN min_y > 0 THEN min_y WHEN max_y < 0 THEN max_y ELSE 0.0 END AS near_y
    FROM b""",
)
def _(fx):
    names = "min_x min_y max_x max_y width height hypotenuse centre_x centre_y box_area box_perimeter near_x near_y"
    return rounded(m.extents_of(fx.segment).select("id", *names.split()))


@query(
    "extend_ends", "vertex", "segment", "curve",
    sql="""
    , v AS (SELECT path_id, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py
            FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    h AS (SELECT path_id, seq - 1 AS seq, x - (nx - x) * 7 / sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) AS x,
                 y - (ny - y) * 7 / sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) AS y FROM v WHERE px IS NULL AND nx IS NOT NULL),
    t AS (SELECT path_id, seq + 1 AS seq, x + (x - px) * 7 / sqrt((px-x)*(px-x) + (py-y)*(py-y)) AS x,
                 y + (y - py) * 7 / sqrt((px-x)*(px-x) + (py-y)*(py-y)) AS y FROM v WHERE nx IS NULL AND px IS NOT NULL),
    l AS (SELECT *, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS len FROM fx_segment),
    al AS (SELECT 'path' AS kind, path_id AS id, seq, x, y FROM fx_vertex
           UNION ALL SELECT 'path', path_id, seq, x, y FROM h UNION ALL SELECT 'path', path_id, seq, x, y FROM t
           UNION ALL SELECT 'line', id, 0, CASE WHEN len > 0 THEN x1 - (x2 - x1) * 7 / len ELSE x1 END,
                            CASE WHEN len > 0 THEN y1 - (y2 - y1) * 7 / len ELSE y1 END FROM l
           UNION ALL SELECT 'line', id, 1, CASE WHEN len > 0 THEN x2 + (x2 - x1) * 7 / len ELSE x2 END,
                            CASE WHEN len > 0 THEN y2 + (y2 - y1) * 7 / len ELSE y2 END FROM l
           UNION ALL SELECT 'curve', id, 0, CASE kind WHEN 'arc' THEN a0 - 7 / r ELSE a0 END,
                            CASE WHEN kind <> 'arc' THEN a1 WHEN a1 < a0 THEN a1 + 2 * pi() + 7 / r ELSE a1 + 7 / r END FROM fx_curve)
    SELECT kind, id, CAST(seq AS BIGINT) AS seq, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM al""",
)
def _(fx):
    paths = m.extend_paths(fx.vertex, 7.0).select(F.lit("path").alias("kind"), F.col("path_id").alias("id"), "seq", "x", "y")
    lines = m.extend_segments(fx.segment, 7.0)
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit(1).cast("bigint").alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y")),
    )
    lines = lines.select(F.lit("line").alias("kind"), "id", F.inline(ends))
    arcs = m.extend_arcs(fx.curve, 7.0).select(
        F.lit("curve").alias("kind"), "id", F.lit(0).cast("bigint").alias("seq"), F.col("a0").alias("x"), F.col("a1").alias("y")
    )
    return rounded(paths.unionByName(lines).unionByName(arcs))


@query(
    "filter_in_box", "point",
    sql="SELECT id, x, y, z FROM fx_point WHERE x BETWEEN 1000 AND 8000 AND y BETWEEN 500 AND 6000 AND z >= 3 AND z <= 40",
)
def _(fx):
    return m.filter_in_box(fx.point, 1000, 500, 8000, 6000, 3, 40).select("id", "x", "y", "z")


@query(
    "path_flags", "vertex", "box",
    sql="""
    , v AS (SELECT path_id, seq, x, y FROM fx_vertex
            UNION ALL SELECT -1 - id, s, CASE WHEN s IN (1, 2) THEN max_x ELSE min_x END, CASE WHEN s IN (2, 3) THEN max_y ELSE min_y END
            FROM fx_box CROSS JOIN range(5) AS r(s))
    SELECT path_id, count(*) AS points,
           count(*) >= 4 AND arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS is_closed,
           true AS is_region
    FROM v GROUP BY path_id""",
)
def _(fx):
    rings = gen.box_polygon(fx.box).withColumn("path_id", -1 - F.col("id")).select("path_id", "seq", "x", "y")
    return m.path_flags(fx.vertex.unionByName(rings))


# ---- generators -------------------------------------------------------------------------


@query(
    "tessellate_arcs", "curve",
    sql="""
    SELECT id, i, round(cx + r * cos(a), 4) + 0.0 AS x, round(cy + r * sin(a), 4) + 0.0 AS y
    FROM (SELECT id, i, cx, cy, r, CASE WHEN kind = 'circle' THEN i / 32.0 * 2 * pi()
                 WHEN a1 < a0 THEN a0 + (a1 + 2 * pi() - a0) * i / 32.0 ELSE a0 + (a1 - a0) * i / 32.0 END AS a
          FROM fx_curve CROSS JOIN range(33) AS t(i)) p""",
)
def _(fx):
    return rounded(gen.tessellate_arcs(fx.curve, 32))


@query(
    "tessellate_ellipse", "curve",
    sql="""
    SELECT id, i, round(cx + r * cos(a0 + (a1 - a0) * i / 31.0), 4) + 0.0 AS x,
           round(cy + r / 2 * sin(a0 + (a1 - a0) * i / 31.0), 4) + 0.0 AS y
    FROM fx_curve CROSS JOIN range(32) AS t(i)""",
)
def _(fx):
    ellipses = fx.curve.withColumns({"ra": F.col("r"), "rb": F.col("r") / 2})
    return rounded(gen.tessellate_ellipse(ellipses, 32))


@query(
    "tessellate_bezier", "vertex",
    sql="""
    , c AS (SELECT path_id * 100000 + seq AS id, seq, x AS x0, y AS y0, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1,
                   lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(x, 3) OVER w AS x3, lead(y, 3) OVER w AS y3
            FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    s AS (SELECT *, i / 7.0 AS t FROM c CROSS JOIN range(8) AS r(i))
    SELECT 3 AS degree, id, i,
           round(pow(1-t, 3)*x0 + 3*pow(1-t, 2)*t*x1 + 3*(1-t)*t*t*x2 + t*t*t*x3, 4) + 0.0 AS x,
           round(pow(1-t, 3)*y0 + 3*pow(1-t, 2)*t*y1 + 3*(1-t)*t*t*y2 + t*t*t*y3, 4) + 0.0 AS y
    FROM s WHERE x3 IS NOT NULL AND seq % 3 = 1
    UNION ALL
    SELECT 2, id, i, round(pow(1-t, 2)*x0 + 2*(1-t)*t*x1 + t*t*x2, 4) + 0.0, round(pow(1-t, 2)*y0 + 2*(1-t)*t*y1 + t*t*y2, 4) + 0.0
    FROM s WHERE x2 IS NOT NULL AND seq % 2 = 1""",
)
def _(fx):
    out = None
    for degree, stride in ((3, 3), (2, 2)):
        # point p belongs to every window it falls in; the shared joint is repeated
        steps = F.explode(F.array(F.lit(0), F.lit(stride))) if degree == stride else None
        rows = fx.vertex.withColumn("back", steps)
        slot = (F.col("seq") - 1) % stride
        first = F.col("seq") - slot - F.when((slot == 0) & (F.col("back") > 0), stride).otherwise(0)
        rows = rows.filter((F.col("back") == 0) | (slot == 0)).withColumns({"first": first, "k": F.col("seq") - first})
        picks = [
            F.max(F.when(F.col("k") == k, F.col(axis))).alias(f"{axis}{k}") for k in range(degree + 1) for axis in "xy"
        ]
        curves = (
            rows.filter("first >= 1")
            .groupBy((F.col("path_id") * 100000 + F.col("first")).alias("id"))
            .agg(*picks)
            .dropna(subset=[f"x{degree}", "x0"])
        )
        part = gen.tessellate_bezier(curves, degree, 8).withColumn("degree", F.lit(degree))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


_SPLINE = """WITH RECURSIVE c AS (SELECT path_id * 100000 + seq // 12 AS id, row_number() OVER w - 1 AS j, x, y, count(*) OVER (PARTITION BY path_id, seq // 12) AS n
             FROM fx_vertex WINDOW w AS (PARTITION BY path_id, seq // 12 ORDER BY seq)),
    h AS (SELECT id, n, least({p}, n - 1) AS p FROM c WHERE j = 0 AND n > 1),
    s AS (SELECT id, n, p, i, (n - p) * i / (3.0 * n - 1) AS u FROM h JOIN range(40) AS r(i) ON i < 3 * n - 1),
    b AS (SELECT id, i, u, n, p, 0 AS d, j, CASE WHEN greatest(0, least(j - p, n - p)) <= u AND u < greatest(0, least(j + 1 - p, n - p)) THEN 1.0::DOUBLE ELSE 0.0 END AS v
          FROM s JOIN range(20) AS r(j) ON j < n + p
          UNION ALL
          SELECT id, i, u, n, p, d + 1, j, coalesce((u - t0) / nullif(t1 - t0, 0) * v, 0) + coalesce((t3 - u) / nullif(t3 - t2, 0) * nv, 0)
          FROM (SELECT *, lead(v) OVER (PARTITION BY id, i ORDER BY j) AS nv, greatest(0, least(j - p, n - p)) AS t0, greatest(0, least(j + d + 1 - p, n - p)) AS t1,
                       greatest(0, least(j + 1 - p, n - p)) AS t2, greatest(0, least(j + d + 2 - p, n - p)) AS t3 FROM b WHERE d < p) q WHERE nv IS NOT NULL),
    pt AS (SELECT b.id, b.i, sum(v * x) / sum(v) AS x, sum(v * y) / sum(v) AS y FROM b JOIN c ON c.id = b.id AND c.j = b.j WHERE d = p GROUP BY 1, 2
           UNION ALL SELECT c.id, 3 * c.n - 1, x, y FROM c WHERE j = c.n - 1 AND c.n > 1)
    SELECT id, i, round(x + 1e-6, 3) + 0.0 AS x, round(y + 1e-6, 3) + 0.0 AS y FROM pt"""


def _splines(fx, degree: int):
    # one spline per twelve successive vertices of a path, so its arrays stay short; clamped uniform knots
    pts = fx.vertex.groupBy((F.col("path_id") * 100000 + F.floor(F.col("seq") / 12)).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("ctrl")
    )
    n = F.size("ctrl")
    pts = pts.filter(n > 1).withColumn("degree", F.least(F.lit(degree), n - 1))
    span = n - F.col("degree")
    knots = F.transform(
        F.sequence(F.lit(0), n + F.col("degree")), lambda j: F.greatest(F.lit(0), F.least(j - F.col("degree"), span)).cast("double")
    )
    points = gen.tessellate_spline(pts.withColumn("knots", knots))
    # many values lie halfway between two roundings; both sides are lifted off them
    return rounded(points.withColumns({c: F.col(c) + 1e-6 for c in "xy"}), 3)


@query("tessellate_spline", "vertex", sql=_SPLINE.format(p=3))
def _(fx):
    return _splines(fx, 3)


@query("tessellate_spline_quintic", "vertex", sql=_SPLINE.format(p=5))
def _(fx):
    return _splines(fx, 5)


@query(
    "arcs_normalise", "segment", "curve",
    sql="""
    , b AS (SELECT id, CASE WHEN id % 2 = 0 THEN 0.5 ELSE -0.25 END AS bulge, x1, y1, x2, y2,
                   (x1+x2)/2 AS mx, (y1+y2)/2 AS my, x2-x1 AS dx, y2-y1 AS dy FROM fx_segment WHERE x1 <> x2 OR y1 <> y2),
    c AS (SELECT *, mx - dy * (1 - bulge*bulge) / (4 * bulge) AS cx, my + dx * (1 - bulge*bulge) / (4 * bulge) AS cy FROM b),
    s AS (SELECT id, 'bulge' AS src, cx, cy, sqrt((x1-cx)*(x1-cx) + (y1-cy)*(y1-cy)) AS r, 4 * atan(abs(bulge)) AS sweep FROM c
          UNION ALL
          SELECT id, 'points', cx, cy, r, CASE WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END
          FROM (SELECT *, atan2(r * sin(t0), r * cos(t0)) AS a0, atan2(r * sin(t1), r * cos(t1)) AS a1
                FROM (SELECT *, a0 AS t0, a1 AS t1 FROM fx_curve) q) z(id, kind, cx, cy, r, o0, o1, t0, t1, a0, a1))
    SELECT id, src, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy, round(r, 4) + 0.0 AS r, round(sweep, 6) + 0.0 AS sweep FROM s""",
)
def _(fx):
    bulged = gen.arcs_from_bulge(
        fx.segment.withColumn("bulge", F.when(F.col("id") % 2 == 0, 0.5).otherwise(-0.25))
    )
    x1, y1 = g.polar("cx", "cy", "r", F.col("a0"))
    x2, y2 = g.polar("cx", "cy", "r", F.col("a1"))
    three = fx.curve.select("id", "cx", "cy", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    out = [
        df.select("id", F.lit(src).alias("src"), "cx", "cy", "r", "sweep")
        for df, src in ((bulged, "bulge"), (gen.arcs_from_points(three), "points"))
    ]
    return rounded(out[0].unionByName(out[1]), 4, sweep=6)


@query(
    "points_along", "segment",
    sql="""
    SELECT id, i, round(x1 + (x2 - x1) * i / 4.0, 4) + 0.0 AS x, round(y1 + (y2 - y1) * i / 4.0, 4) + 0.0 AS y
    FROM fx_segment CROSS JOIN range(5) AS t(i)""",
)
def _(fx):
    return rounded(gen.points_along(fx.segment, 5))


@query(
    "split_even", "curve",
    sql="""
    , p AS (SELECT id, i, cx, cy, r, CASE WHEN kind = 'circle' THEN 0 ELSE a0 END AS s,
                   CASE WHEN kind = 'circle' THEN 2 * pi() WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END AS sw
            FROM fx_curve CROSS JOIN range(6) AS t(i))
    SELECT id, i, round(cx + r * cos(s + sw * i / 6), 4) + 0.0 AS x1, round(cy + r * sin(s + sw * i / 6), 4) + 0.0 AS y1,
           round(cx + r * cos(s + sw * (i + 1) / 6), 4) + 0.0 AS x2, round(cy + r * sin(s + sw * (i + 1) / 6), 4) + 0.0 AS y2
    FROM p""",
)
def _(fx):
    return rounded(gen.split_even(fx.curve, 6))


@query(
    "path_to_segments", "vertex",
    sql="""
    SELECT a.path_id, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM fx_vertex a JOIN fx_vertex b ON a.path_id = b.path_id AND b.seq = a.seq + 1""",
)
def _(fx):
    return gen.path_to_segments(fx.vertex)


@query(
    "segments_to_path", "vertex",
    sql="""
    SELECT path_id, string_agg(CAST(CAST(x AS BIGINT) AS STRING) || ' ' || CAST(CAST(y AS BIGINT) AS STRING), ';' ORDER BY seq) AS points
    FROM fx_vertex GROUP BY path_id HAVING count(*) > 1""",
)
def _(fx):
    paths = gen.pack_paths(gen.segments_to_path(gen.path_to_segments(fx.vertex)))
    text = F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("bigint"), p["y"].cast("bigint")))
    return paths.select("path_id", F.array_join(text, ";").alias("points"))


# what is kept depends on the last kept point, so the SQL goes along each path
def _fold(name: str, points: str) -> str:
    far = f"sqrt(({points}.x - lx) * ({points}.x - lx) + ({points}.y - ly) * ({points}.y - ly)) > 180.5"
    return f"""{name} AS (SELECT path_id, n, x, y, x AS lx, y AS ly, true AS kept FROM {points} WHERE n = 1
              UNION ALL SELECT {points}.path_id, {points}.n, {points}.x, {points}.y, CASE WHEN {far} THEN {points}.x ELSE lx END,
                     CASE WHEN {far} THEN {points}.y ELSE ly END, {far} FROM {name} JOIN {points} ON {points}.path_id = {name}.path_id AND {points}.n = {name}.n + 1)"""


@query(
    "segments_to_path_tolerance", "vertex",
    sql=f"""
    WITH RECURSIVE v AS (SELECT path_id, x, y, row_number() OVER (PARTITION BY path_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY path_id) AS k FROM fx_vertex), {_fold('f', 'v')}
    SELECT f.path_id, row_number() OVER (PARTITION BY f.path_id ORDER BY f.n) AS nth, f.x, f.y FROM f JOIN v USING (path_id, n) WHERE kept AND k > 1""",
)
def _(fx):
    kept = gen.segments_to_path(gen.path_to_segments(fx.vertex), 180.5)
    return ordered_scan(kept, ["path_id"], ["seq"], chunk_of("seq"), index="nth").select("path_id", "nth", "x", "y")


@query(
    "path_editing", "vertex",
    sql=f"""
    WITH RECURSIVE a AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM fx_vertex WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    m AS (SELECT 'merge' AS op, path_id, seq, x, y FROM a WHERE NOT (seq = 11 AND coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 180.5, false))),
    v AS (SELECT path_id, x, y, seq - 9 AS n FROM fx_vertex WHERE seq >= 10), {_fold('f', 'v')},
    u AS (SELECT path_id, x, y, 12 - seq AS n FROM fx_vertex WHERE seq <= 11), {_fold('h', 'u')}
    SELECT op, path_id, row_number() OVER (PARTITION BY op, path_id ORDER BY seq) AS nth, x, y FROM (
        SELECT * FROM m UNION ALL SELECT 'append', path_id, n + 9, x, y FROM f WHERE kept AND n > 1 UNION ALL SELECT 'append', path_id, seq, x, y FROM fx_vertex WHERE seq <= 10
        UNION ALL SELECT 'prepend', path_id, 12 - n, x, y FROM h WHERE kept AND n > 1 UNION ALL SELECT 'prepend', path_id, seq, x, y FROM fx_vertex WHERE seq >= 11) q""",
)
def _(fx):
    low, high = fx.vertex.where("seq <= 10"), fx.vertex.where("seq > 10")
    edited = {"merge": gen.merge_paths(low, high, 180.5), "append": gen.append_points(low, high, 180.5), "prepend": gen.append_points(high, low, 180.5, prepend=True)}
    out = None
    for op, rows in edited.items():
        nth = ordered_scan(rows, ["path_id"], ["seq"], chunk_of("seq"), index="nth").select(F.lit(op).alias("op"), "path_id", "nth", "x", "y")
        out = nth if out is None else out.unionByName(nth)
    return out


@query(
    "box_polygon", "box",
    sql="""
    SELECT id, s AS seq, CASE WHEN s IN (1, 2) THEN max_x ELSE min_x END AS x, CASE WHEN s IN (2, 3) THEN max_y ELSE min_y END AS y
    FROM fx_box CROSS JOIN range(5) AS r(s)""",
)
def _(fx):
    return gen.box_polygon(fx.box)


_COPIES = """
    SELECT node_id, x AS ix, y AS iy, off_x + x * pitch_x AS copy_x, off_y + y * pitch_y AS copy_y, {order} AS ord
    FROM fx_node CROSS JOIN range(10) AS a(x) CROSS JOIN range(10) AS b(y) WHERE x < num_x AND y < num_y"""
_COPY = ("node_id", "ix", "iy", "copy_x", "copy_y", "ord")


@query("grid_array", "node", sql=_COPIES.format(order="CASE WHEN y % 2 = 1 THEN y * num_x + num_x - 1 - x ELSE y * num_x + x END"))
def _(fx):
    return gen.grid_array(fx.node, "serpentine").select(*_COPY)


@query("grid_array_raster", "node", sql=_COPIES.format(order="x * num_y + y"))
def _(fx):
    return gen.grid_array(fx.node, "raster").select(*_COPY)


@query(
    "spiral_array", "node",
    sql="""WITH RECURSIVE n AS (SELECT node_id, off_x, off_y, pitch_x, pitch_y, num_x + 3 AS nx, num_y + 2 AS ny FROM fx_node),
    w AS (SELECT node_id, nx, ny, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, 0 AS dx, 1 AS dy, CAST(0 AS BIGINT) AS lo_x,
                 nx - 1 AS hi_x, CAST(0 AS BIGINT) AS lo_y, ny - 1 AS hi_y, CAST(0 AS BIGINT) AS ord FROM n
      UNION ALL
      SELECT node_id, nx, ny,
             x + CASE WHEN turn THEN dy ELSE dx END, y + CASE WHEN turn THEN -dx ELSE dy END,
             CASE WHEN turn THEN dy ELSE dx END, CASE WHEN turn THEN -dx ELSE dy END,
             lo_x + CASE WHEN turn AND dy = 1 THEN 1 ELSE 0 END, hi_x - CASE WHEN turn AND dy = -1 THEN 1 ELSE 0 END,
             lo_y + CASE WHEN turn AND dx = -1 THEN 1 ELSE 0 END, hi_y - CASE WHEN turn AND dx = 1 THEN 1 ELSE 0 END, ord + 1
      FROM (SELECT *, CASE WHEN dx = 1 THEN x = hi_x WHEN dx = -1 THEN x = lo_x WHEN dy = 1 THEN y = hi_y ELSE y = lo_y END AS turn FROM w) t
      WHERE ord + 1 < nx * ny)
    SELECT w.node_id, x AS ix, y AS iy, off_x + x * pitch_x AS copy_x, off_y + y * pitch_y AS copy_y, ord
    FROM w JOIN n ON w.node_id = n.node_id""",
)
def _(fx):
    # wider arrays than the layout's own, so that the spiral has more than one ring
    nodes = fx.node.withColumns({"num_x": F.col("num_x") + 3, "num_y": F.col("num_y") + 2})
    return gen.spiral_array(nodes, "bottom_left", clockwise=True).select(*_COPY)


_EXT = """e AS (SELECT layer, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x1, min(least(y1, y2)) AS y0,
                       max(greatest(y1, y2)) AS y1 FROM fx_segment GROUP BY layer)"""


@query(
    "tile_grid", "segment",
    sql=f"""
    , {_EXT},
    s AS (SELECT *, CAST(ceil((x1 - x0 + 20) / 500) AS BIGINT) AS nx, CAST(ceil((y1 - y0 + 10) / 400) AS BIGINT) AS ny FROM e),
    t AS (SELECT layer, r AS row, c AS col, r * nx + c AS tile, (x0 + x1) / 2 - nx * 250.0 + c * 500 + 3 AS mx,
                 (y0 + y1) / 2 - ny * 200.0 + r * 400 - 2 AS my
          FROM s CROSS JOIN range(60) AS a(r) CROSS JOIN range(60) AS b(c) WHERE r < ny AND c < nx)
    SELECT layer, tile, row, col, round(mx, 4) + 0.0 AS min_x, round(my, 4) + 0.0 AS min_y, round(mx + 500, 4) + 0.0 AS max_x,
           round(my + 400, 4) + 0.0 AS max_y FROM t""",
)
def _(fx):
    ext = agg.extents_agg(fx.segment, "layer").drop("n")
    return rounded(gen.tile_grid(ext, 500.0, 400.0, 20.0, 10.0, 3.0, -2.0))


@query(
    "hatch_lines", "box",
    sql="""
    , s AS (SELECT id, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy,
                   sqrt((max_x-min_x)*(max_x-min_x) + (max_y-min_y)*(max_y-min_y)) AS d FROM fx_box),
    k AS (SELECT *, CASE WHEN k % 2 = 1 THEN -d ELSE d END AS w, -d / 2 + k * 20.0 AS y, CAST(ceil(d / 20.0) AS BIGINT) AS n
          FROM s CROSS JOIN range(100) AS r(k) WHERE k < ceil(d / 20.0)),
    a AS (SELECT *, k AS pos, radians(30) AS t FROM k UNION ALL SELECT *, 2 * n - 1 - k, radians(120) FROM k)
    SELECT id, pos AS k, round(cx - w * cos(t) - y * sin(t), 4) + 0.0 AS x1, round(cy - w * sin(t) + y * cos(t), 4) + 0.0 AS y1,
           round(cx + w * cos(t) - y * sin(t), 4) + 0.0 AS x2, round(cy + w * sin(t) + y * cos(t), 4) + 0.0 AS y2 FROM a""",
)
def _(fx):
    return rounded(gen.hatch_lines(fx.box, 20.0, 30.0, "serpentine_grid"))


@query(
    "interleave", "segment",
    sql="SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY id) AS rn FROM fx_segment",
)
def _(fx):
    return gen.interleave(fx.segment.select("id", "layer"), "layer", "id")


# ---- transforms -------------------------------------------------------------------------


@query(
    "apply_transform", "segment",
    sql="""
    , a AS (SELECT id, x1 * 2 + 5 AS x1, y1 * 3 - 7 AS y1, x2 * 2 + 5 AS x2, y2 * 3 - 7 AS y2 FROM fx_segment),
    b AS (SELECT id, x1 + 0.5 * y1 AS x1, y1, x2 + 0.5 * y2 AS x2, y2 FROM a)
    SELECT id, round(x1 * cos(radians(30)) - y1 * sin(radians(30)), 4) + 0.0 AS x1, round(x1 * sin(radians(30)) + y1 * cos(radians(30)), 4) + 0.0 AS y1,
           round(x2 * cos(radians(30)) - y2 * sin(radians(30)), 4) + 0.0 AS x2, round(x2 * sin(radians(30)) + y2 * cos(radians(30)), 4) + 0.0 AS y2
    FROM b""",
)
def _(fx):
    move = affine.combine(
        affine.scale(2.0, 3.0), affine.translate(5.0, -7.0), affine.shear(0.5, 0.0), affine.rotate(math.radians(30))
    )
    return rounded(tr.apply_transform(fx.segment, move).select("id", "x1", "y1", "x2", "y2"))


_AFFINE = """
    , s AS (SELECT grp, count(*)::HUGEINT AS n, sum(x::HUGEINT) AS sx, sum(y::HUGEINT) AS sy, sum((x * x)::HUGEINT) AS sxx, sum((x * y)::HUGEINT) AS sxy,
                   sum((y * y)::HUGEINT) AS syy FROM fx_pair GROUP BY grp),
    e AS (SELECT grp, arg_min(x, x * 1000 + y) AS x1, arg_min(y, x * 1000 + y) AS y1, arg_min(mx, x * 1000 + y) AS u1, arg_min(my, x * 1000 + y) AS v1,
                 arg_max(x, x * 1000 + y) AS x2, arg_max(y, x * 1000 + y) AS y2, arg_max(mx, x * 1000 + y) AS u2, arg_max(my, x * 1000 + y) AS v2
          FROM fx_pair GROUP BY grp),
    l AS (SELECT e.*, (n * sxx - sx * sx) * (n * syy - sy * sy) > (n * sxy - sx * sy) * (n * sxy - sx * sy) AS whole,
                 nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0) AS len FROM e JOIN s USING (grp)),
    k AS (SELECT *, coalesce((x2 - x1) / len, 0) AS ux, coalesce((y2 - y1) / len, 0) AS uy, coalesce((u2 - u1) / len, 0) AS ku, coalesce((v2 - v1) / len, 0) AS kv FROM l),
    q AS (SELECT *, x1 - (x1 * ux + y1 * uy) * ux AS qx, y1 - (x1 * ux + y1 * uy) * uy AS qy FROM k),
    r AS (SELECT *, (u1 - ku * (x1 * ux + y1 * uy)) / (qx * qx + qy * qy + 1) AS gu, (v1 - kv * (x1 * ux + y1 * uy)) / (qx * qx + qy * qy + 1) AS gv FROM q),
    m AS (SELECT grp, CASE WHEN whole THEN 2 ELSE ku * ux + gu * qx END AS a, CASE WHEN whole THEN 1 ELSE kv * ux + gv * qx END AS b,
                 CASE WHEN whole THEN -1 ELSE ku * uy + gu * qy END AS c, CASE WHEN whole THEN 3 ELSE kv * uy + gv * qy END AS d,
                 CASE WHEN whole THEN grp ELSE gu END AS tx, CASE WHEN whole THEN -5 ELSE gv END AS ty FROM r)"""


@query(
    "apply_transform_3d", "point",
    sql="""
    , s AS (SELECT id, (x - 10) * 2 AS x, (y - 20) * 0.5 AS y, (z - 5) * 3 AS z FROM fx_point),
    a AS (SELECT id, x, y * cos(0.3) - z * sin(0.3) AS y, y * sin(0.3) + z * cos(0.3) AS z FROM s),
    b AS (SELECT id, x * cos(-0.2) + z * sin(-0.2) AS x, y, z * cos(-0.2) - x * sin(-0.2) AS z FROM a),
    c AS (SELECT id, x * cos(1.1) - y * sin(1.1) AS x, x * sin(1.1) + y * cos(1.1) AS y, z FROM b)
    SELECT id, round(x + 10 + 7, 3) + 0.0 AS x, round(y + 20 - 8, 3) + 0.0 AS y, round(z + 5 + 9, 3) + 0.0 AS z FROM c""",
)
def _(fx):
    turned = affine3.about(10.0, 20.0, 5.0, affine3.scale(2.0, 0.5, 3.0).then(affine3.rotate(0.3, -0.2, 1.1)))
    return rounded(affine3.apply_transform_3d(fx.point, turned.then(affine3.translate(7.0, -8.0, 9.0))).select("id", "x", "y", "z"), 3)


@query(
    "apply_group_transform", "pair", "segment",
    sql=_AFFINE + """
    SELECT id, id % 25 AS grp, round(a * x1 + c * y1 + tx, 4) + 0.0 AS x1, round(b * x1 + d * y1 + ty, 4) + 0.0 AS y1,
           round(a * x2 + c * y2 + tx, 4) + 0.0 AS x2, round(b * x2 + d * y2 + ty, 4) + 0.0 AS y2
    FROM fx_segment JOIN m ON m.grp = id % 25""",
)
def _(fx):
    maps = tr.estimate_affine(fx.pair, "grp")
    segs = fx.segment.withColumn("grp", F.col("id") % 25)
    return rounded(tr.apply_group_transform(segs, maps, "grp").select("id", "grp", "x1", "y1", "x2", "y2"))


@query(
    "translate_scale_rotate", "segment",
    sql="""
    , t AS (SELECT id, x1 + 10 AS x1, y1 - 20 AS y1, x2 + 10 AS x2, y2 - 20 AS y2 FROM fx_segment),
    s AS (SELECT id, mx + (x1 - mx) * 2 AS x1, my + (y1 - my) * 0.5 AS y1, mx + (x2 - mx) * 2 AS x2, my + (y2 - my) * 0.5 AS y2
          FROM (SELECT *, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM t) q)
    SELECT id, round(100 + (x1 - 100) * cos(0.7) - (y1 - 50) * sin(0.7), 4) + 0.0 AS x1, round(50 + (x1 - 100) * sin(0.7) + (y1 - 50) * cos(0.7), 4) + 0.0 AS y1,
           round(100 + (x2 - 100) * cos(0.7) - (y2 - 50) * sin(0.7), 4) + 0.0 AS x2, round(50 + (x2 - 100) * sin(0.7) + (y2 - 50) * cos(0.7), 4) + 0.0 AS y2
    FROM s""",
)
def _(fx):
    df = tr.translate_geometry(fx.segment, 10.0, -20.0)
    df = tr.rotate_geometry(tr.scale_geometry(df, 2.0, 0.5), 0.7, (100.0, 50.0))
    return rounded(df.select("id", "x1", "y1", "x2", "y2"))


@query(
    "align", "segment",
    sql=f"""
    , {_EXT}
    SELECT id, s.layer, 'corner' AS mode, s.x1 - e.x0 AS x1, s.y1 - e.y0 AS y1, s.x2 - e.x0 AS x2, s.y2 - e.y0 AS y2
    FROM fx_segment s JOIN e ON s.layer = e.layer
    UNION ALL
    SELECT id, s.layer, 'centre', s.x1 - (e.x0 + e.x1) / 2 + 50, s.y1 - (e.y0 + e.y1) / 2 - 60, s.x2 - (e.x0 + e.x1) / 2 + 50,
           s.y2 - (e.y0 + e.y1) / 2 - 60
    FROM fx_segment s JOIN e ON s.layer = e.layer""",
)
def _(fx):
    parts = [
        tr.align(fx.segment, "layer", mode, to).withColumn("mode", F.lit(mode))
        for mode, to in (("corner", (0.0, 0.0)), ("centre", (50.0, -60.0)))
    ]
    return parts[0].unionByName(parts[1]).select("id", "layer", "mode", "x1", "y1", "x2", "y2")


@query(
    "extents_of_curves", "curve",
    sql="""
    , w AS (SELECT *, CASE WHEN kind = 'circle' THEN 7.0 WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END AS sw FROM fx_curve),
    t AS (SELECT id, kind, cx, cy, r, a0 + sw * q AS th FROM w CROSS JOIN (VALUES (0), (1)) AS v(q) WHERE kind = 'arc'
          UNION ALL SELECT id, kind, cx, cy, r, n * pi() / 2 FROM w CROSS JOIN range(-8, 16) AS v(n) WHERE kind = 'circle' OR n * pi() / 2 BETWEEN a0 AND a0 + sw)
    SELECT id, round(min(cx + r * cos(th)), 4) + 0.0 AS min_x, round(min(cy + r * sin(th)), 4) + 0.0 AS min_y, round(max(cx + r * cos(th)), 4) + 0.0 AS max_x,
           round(max(cy + r * sin(th)), 4) + 0.0 AS max_y FROM t GROUP BY id""",
)
def _(fx):
    return rounded(m.curve_extents(fx.curve).select("id", "min_x", "min_y", "max_x", "max_y"))


@query(
    "estimate_affine", "pair",
    sql=_AFFINE + """
    SELECT grp, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(d, 6) + 0.0 AS d, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty FROM m""",
)
def _(fx):
    return rounded(tr.estimate_affine(fx.pair, "grp"), 6)


@query(
    "estimate_affine_far", "pair",
    sql="""
    SELECT DISTINCT grp, 2.0::DOUBLE AS a, 1.0::DOUBLE AS b, -1.0::DOUBLE AS c, 3.0::DOUBLE AS d, (56 + grp)::DOUBLE AS x, 177.0::DOUBLE AS y FROM fx_pair""",
)
def _(fx):
    # three more points per group span the plane; all design points lie ten million units out
    three = [(0.0, 0.0), (50.0, 0.0), (0.0, 50.0)]
    more = fx.pair.select("grp").distinct().select("grp", F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in three])))
    more = more.withColumns({"mx": 2 * F.col("x") - F.col("y") + F.col("grp"), "my": F.col("x") + 3 * F.col("y") - 5})
    far = fx.pair.unionByName(more).withColumns({"x": F.col("x") + 1e7, "y": F.col("y") + 1e7})
    maps = tr.estimate_affine(far, "grp")
    at = affine.from_columns().apply(F.lit(1e7 + 50), F.lit(1e7 + 44))
    return rounded(maps.select("grp", "a", "b", "c", "d", at[0].alias("x"), at[1].alias("y")), 3, a=6, b=6, c=6, d=6)


_ARC_MOVES = {"turned": (0.0, 2.0, -2.0, 0.0), "mirrored": (-1.5, 0.0, 0.0, 1.5)}


@query(
    "transform_curves", "curve",
    sql="""
    , w AS (SELECT *, CASE WHEN a1 < a0 THEN a1 + 2 * pi() - a0 ELSE a1 - a0 END AS sw FROM fx_curve),
    t AS (SELECT *, k / 4.0 AS t FROM w JOIN range(5) AS r(k) ON kind = 'arc' OR k = 0),
    p AS (SELECT *, cx + r * cos(a0 + sw * t) AS px, cy + r * sin(a0 + sw * t) AS py FROM t),
    m AS (SELECT 'turned' AS move, 0.0 AS a, 2.0 AS b, -2.0 AS c, 0.0 AS d, 2.0 AS f UNION ALL SELECT 'mirrored', -1.5, 0.0, 0.0, 1.5, 1.5)
    SELECT move, id, kind, CASE WHEN move = 'mirrored' AND kind = 'arc' THEN 4 - k ELSE k END AS k, round(f * r, 4) + 0.0 AS r,
           round(a * cx + c * cy + 3, 4) + 0.0 AS cx, round(b * cx + d * cy - 4, 4) + 0.0 AS cy,
           CASE WHEN kind = 'arc' THEN round(a * px + c * py + 3, 3) + 0.0 END AS px, CASE WHEN kind = 'arc' THEN round(b * px + d * py - 4, 3) + 0.0 END AS py
    FROM p CROSS JOIN m""",
)
def _(fx):
    out = None
    for name, (a, b, c, d) in _ARC_MOVES.items():
        part = tr.transform_curves(fx.curve, affine.Affine(a, b, c, d, 3.0, -4.0)).withColumn("move", F.lit(name))
        out = part if out is None else out.unionByName(part)
    arc = F.col("kind") == "arc"
    k = F.explode(F.when(arc, F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    rows = out.withColumn("k", k)
    px, py = g.polar("cx", "cy", "r", F.col("a0") + g.sweep("a0", "a1") * F.col("k") / 4.0)
    rows = rows.withColumns({"px": F.when(arc, px), "py": F.when(arc, py)})
    return rounded(rows.select("move", "id", "kind", "k", "r", "cx", "cy", "px", "py"), px=3, py=3)


@query(
    "two_point_alignment", "pair",
    sql="""
    , o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY x * 1000 + y) AS rn FROM (SELECT DISTINCT * FROM fx_pair) d),
    t AS (SELECT grp, max(CASE WHEN rn = 1 THEN x END) ax, max(CASE WHEN rn = 1 THEN y END) ay, max(CASE WHEN rn = 1 THEN mx END) amx,
                 max(CASE WHEN rn = 1 THEN my END) amy, max(CASE WHEN rn = 2 THEN x END) bx, max(CASE WHEN rn = 2 THEN y END) by_,
                 max(CASE WHEN rn = 2 THEN mx END) bmx, max(CASE WHEN rn = 2 THEN my END) bmy FROM o WHERE rn <= 2 GROUP BY grp),
    a AS (SELECT *, atan2(bmy - amy, amx - bmx) - atan2(by_ - ay, bx - ax) AS th FROM t WHERE bx IS NOT NULL),
    r AS (SELECT *, (amx + ax * cos(th) - ay * sin(th) + bmx + bx * cos(th) - by_ * sin(th)) / 2 AS ox,
                 (amy - ax * sin(th) - ay * cos(th) + bmy - bx * sin(th) - by_ * cos(th)) / 2 AS oy FROM a)
    SELECT grp, round(th, 6) + 0.0 AS angle, round(ox, 4) + 0.0 AS origin_x, round(oy, 4) + 0.0 AS origin_y,
           round(ox + 1.5, 4) + 0.0 AS beam_x, round(oy - 2.5, 4) + 0.0 AS beam_y FROM r""",
)
def _(fx):
    pairs = fx.pair.distinct().withColumn("o", F.col("x") * 1000 + F.col("y"))
    return rounded(tr.two_point_alignment(pairs, "grp", "o", (-1.0, 1.0), (1.5, -2.5)), 4, angle=6)


@query(
    "to_stage", "point",
    sql="""
    , t AS (SELECT id, 100 - (x * cos(0.02) - y * sin(0.02)) AS tx, 50 + x * sin(0.02) + y * cos(0.02) AS ty FROM fx_point),
    s AS (SELECT *, greatest(-9000, least(tx, 0)) AS sx, greatest(0, least(ty, 9500)) AS sy FROM t)
    SELECT id, round(sx, 4) + 0.0 AS stage_x, round(sy, 4) + 0.0 AS stage_y, round(sx - tx, 4) + 0.0 AS scan_x, round(sy - ty, 4) + 0.0 AS scan_y,
           sx - tx BETWEEN -300 AND 300 AND sy - ty BETWEEN -300 AND 300 AS in_bounds,
           round(-((x - 7) * cos(0.02) - (y - 9) * sin(0.02) + 100), 4) + 0.0 AS machine_x,
           round((x - 7) * sin(0.02) + (y - 9) * cos(0.02) + 50, 4) + 0.0 AS machine_y
    FROM s JOIN fx_point USING (id)""",
)
def _(fx):
    df = tr.to_stage(
        fx.point, None, None, angle=0.02, origin=(100.0, 50.0), inverts=(-1.0, 1.0),
        stage=(-9000.0, 0.0, 0.0, 9500.0), scanner=(-300.0, -300.0, 300.0, 300.0),
    )
    df = tr.machine_coordinates(df, (7.0, 9.0), 0.02, 100.0, 50.0, (-1.0, 1.0))
    return rounded(df.select("id", "stage_x", "stage_y", "scan_x", "scan_y", "in_bounds", "machine_x", "machine_y"))


@query(
    "map_geometries", "segment",
    sql="""SELECT id, x2 AS x1, y2 AS y1, x1 AS x2, y1 AS y2, round(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 4) + 0.0 AS len FROM fx_segment""",
)
def _(fx):
    def flipped(df):
        return df.select(
            "id", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")
        )

    def measured(pdf):
        import numpy as np

        return pdf.assign(len=np.round(np.hypot(pdf.x2 - pdf.x1, pdf.y2 - pdf.y1), 4))

    schema = "id bigint, x1 double, y1 double, x2 double, y2 double, len double"
    return tr.map_geometries(tr.map_geometries(fx.segment, flipped), measured, schema)


@query(
    "concat_geometries", "segment", "curve",
    sql="""
    SELECT 'line' AS kind, id, layer, x1, y1, x2, y2, CAST(NULL AS DOUBLE) AS cx, CAST(NULL AS DOUBLE) AS cy, CAST(NULL AS DOUBLE) AS r FROM fx_segment
    UNION ALL SELECT kind, id, NULL, NULL, NULL, NULL, NULL, cx, cy, r FROM fx_curve WHERE kind = 'arc'""",
)
def _(fx):
    lines = fx.segment.select(F.lit("line").alias("kind"), "id", "layer", "x1", "y1", "x2", "y2")
    curves = fx.curve.select("kind", "id", "cx", "cy", "r")
    return tr.of_kind(tr.concat_geometries(lines, curves), "line", "arc")


# ---- aggregations -----------------------------------------------------------------------


@query(
    "extents_agg", "segment",
    sql="""
    SELECT layer, count(*) AS n, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y, max(greatest(x1, x2)) AS max_x,
           max(greatest(y1, y2)) AS max_y FROM fx_segment GROUP BY layer""",
)
def _(fx):
    return agg.extents_agg(fx.segment, "layer")


@query(
    "path_stats", "vertex",
    sql="""
    , s AS (SELECT a.path_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS len
            FROM fx_vertex a JOIN fx_vertex b ON a.path_id = b.path_id AND b.seq = a.seq + 1)
    SELECT path_id, round(min(len), 4) + 0.0 AS min_length, round(sum(len), 4) + 0.0 AS length, count(*) - 1 AS joints FROM s GROUP BY path_id""",
)
def _(fx):
    return rounded(agg.path_stats(fx.vertex))


_TRAVEL = """
    , l AS (SELECT *, lag(x2) OVER w AS px, lag(y2) OVER w AS py FROM fx_segment WINDOW w AS (PARTITION BY layer ORDER BY id)),
    t AS (SELECT layer, count(*) AS marks, sum(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))) AS mark_length,
                 coalesce(sum(sqrt((x1-px)*(x1-px) + (y1-py)*(y1-py))), 0) AS jump_length,
                 count(CASE WHEN x1 = px AND y1 = py THEN 1 END) AS joints FROM l GROUP BY layer)"""


@query(
    "travel_distance", "segment",
    sql=_TRAVEL + " SELECT layer, marks, round(mark_length, 4) + 0.0 AS mark_length, round(jump_length, 4) + 0.0 AS jump_length, joints FROM t",
)
def _(fx):
    return rounded(agg.travel_distance(fx.segment, ["layer"], "id"))


@query(
    "process_time", "segment",
    sql=_TRAVEL + """ SELECT layer, round((mark_length / (100 + length(layer)) + jump_length / 900 + 1e-6 * joints * 150) * 3
           + 0.001 * 40 * 25, 4) + 0.0 AS seconds FROM t""",
)
def _(fx):
    params = (
        fx.segment.select("layer").distinct()
        .select(
            "layer",
            (F.length("layer") + 100).cast("double").alias("mark_speed"),
            F.lit(900.0).alias("jump_speed"),
            F.lit(150.0).alias("joint_delay_us"),
            F.lit(3).alias("passes"),
            F.lit(40).alias("tiles"),
            F.lit(25.0).alias("settle_ms"),
        )
    )
    travel = agg.travel_distance(fx.segment, ["layer"], "id")
    return rounded(agg.process_time(travel, params, "layer").select("layer", "seconds"))
