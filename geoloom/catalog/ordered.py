"""Queries over hatching, sequences, merging and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.catalog.shapes import rounded
from geoloom.operators import ordered as od
from geoloom.operators.generate import box_edges, path_to_segments


@query(
    "hatch_fill", "box",
    sql="""
    , e AS (SELECT id % 10 AS sheet, (min(min_x) + max(max_x)) / 2 AS cx, (min(min_y) + max(max_y)) / 2 AS cy,
                   sqrt(pow(max(max_x) - min(min_x), 2) + pow(max(max_y) - min(min_y), 2)) AS d FROM fx_box GROUP BY 1),
    h AS (SELECT e.*, k, cy - d / 2 + k * 25.0 AS y FROM e CROSS JOIN range(1000) AS r(k) WHERE k < ceil(d / 25.0)),
    x AS (SELECT h.sheet, k, y, b.min_x AS x FROM h JOIN fx_box b ON b.id % 10 = h.sheet AND y >= min_y AND y < max_y
          UNION ALL SELECT h.sheet, k, y, b.max_x FROM h JOIN fx_box b ON b.id % 10 = h.sheet AND y >= min_y AND y < max_y),
    r AS (SELECT *, row_number() OVER w AS rn, lead(x) OVER w AS nx FROM x WINDOW w AS (PARTITION BY sheet, k ORDER BY x))
    SELECT sheet, k, CASE WHEN k % 2 = 1 THEN -((rn + 1) // 2) ELSE (rn + 1) // 2 END AS n,
           CASE WHEN k % 2 = 1 THEN nx ELSE x END AS x1, round(y, 4) + 0.0 AS y1, CASE WHEN k % 2 = 1 THEN x ELSE nx END AS x2,
           round(y, 4) + 0.0 AS y2 FROM r WHERE rn % 2 = 1""",
)
def _(fx):
    edges = box_edges(fx.box).withColumn("sheet", F.col("id") % 10)
    return rounded(od.hatch_fill(edges, ["sheet"], 25.0, 0.0, "serpentine"))


@query(
    "paths_from_sequence", "vertex",
    sql="""
    SELECT path_id // 10 AS sheet, path_id * 100000 + seq AS ord, path_id * 100000 + 1 AS path_no, seq - 1 AS pos,
           count(*) OVER (PARTITION BY path_id) > 2 AS used
    FROM fx_vertex QUALIFY lead(x) OVER (PARTITION BY path_id ORDER BY seq) IS NOT NULL""",
)
def _(fx):
    segs = path_to_segments(fx.vertex).withColumns(
        {"sheet": F.floor(F.col("path_id") / 10), "ord": F.col("path_id") * 100000 + F.col("seq")}
    )
    return od.paths_from_sequence(segs, ["sheet"], "ord").select("sheet", "ord", "path_no", "pos", "used")


@query(
    "merge_collinear", "vertex",
    sql="""WITH RECURSIVE s AS (SELECT a.path_id, a.seq, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, atan2(b.y - a.y, b.x - a.x) AS ang
             FROM fx_vertex a JOIN fx_vertex b ON a.path_id = b.path_id AND b.seq = a.seq + 1),
    r AS (SELECT path_id, seq, ang AS ref, seq AS run FROM s WHERE seq = 1
          UNION ALL
          SELECT s.path_id, s.seq, CASE WHEN abs(ang - ref) > 0.8 THEN ang ELSE ref END, CASE WHEN abs(ang - ref) > 0.8 THEN s.seq ELSE run END
          FROM r JOIN s ON s.path_id = r.path_id AND s.seq = r.seq + 1)
    SELECT r.path_id, run AS seq, arg_min(x1, r.seq) AS x1, arg_min(y1, r.seq) AS y1, arg_max(x2, r.seq) AS x2, arg_max(y2, r.seq) AS y2,
           count(*) AS merged FROM r JOIN s ON s.path_id = r.path_id AND s.seq = r.seq GROUP BY r.path_id, run""",
)
def _(fx):
    # y always rises, so directions stay clear of the half turn
    return od.merge_collinear(path_to_segments(fx.vertex), ["path_id"], "seq", 0.8)


@query("nearest_first", "point",
       sql="""SELECT id, layer, round(sqrt((x-5000)*(x-5000) + (y-5000)*(y-5000)), 4) + 0.0 AS distance FROM fx_point
              ORDER BY floor(sqrt((x-5000)*(x-5000) + (y-5000)*(y-5000)) / 0.0001), id LIMIT 100""")  # fmt: skip
def _(fx):
    return rounded(od.nearest_first(fx.point, 100, (5000.0, 5000.0)).select("id", "layer", "distance"))


@query("nearest_first_grouped", "point",
       sql="""SELECT id, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY floor(sqrt(x*x + y*y) / 0.0001), id) AS INTEGER) AS rank
              FROM fx_point QUALIFY rank <= 20""")  # fmt: skip
def _(fx):
    return od.nearest_first(fx.point, 20, group="layer").select("id", "layer", "rank")


@query("largest_first", "box", sql="SELECT id, (max_x - min_x) * (max_y - min_y) AS area FROM fx_box ORDER BY area DESC, id")
def _(fx):
    return od.largest_first(fx.box).select("id", "area")
