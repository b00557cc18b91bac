"""Queries over connectivity, stitching and mesh slicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.catalog.shapes import rounded
from geoloom.operators import graph as gr
from geoloom.operators.ordered import simplify_contour
from geoloom.plans.scratch import materialize

_ENDS = """
    , en AS (SELECT id, 0 AS tip, x1 AS x, y1 AS y FROM fx_chain UNION ALL SELECT id, 1, x2, y2 FROM fx_chain)"""
_KIND = "CASE WHEN a.tip = 0 THEN 'start_to_' ELSE 'end_to_' END || CASE WHEN b.tip = 0 THEN 'start' ELSE 'end' END"


@query("connected_pairs", "chain",
       sql=_ENDS + f" SELECT a.id AS id_a, b.id AS id_b, {_KIND} AS kind FROM en a JOIN en b ON a.x = b.x AND a.y = b.y AND a.id < b.id")
def _(fx):
    return gr.connected_pairs(fx.chain)


_MEMBERS = _ENDS + """, v AS (SELECT *, min(id * 2 + tip) OVER w AS first_end, count(*) OVER w AS ends FROM en WINDOW w AS (PARTITION BY x, y))
    SELECT id, tip, first_end, ends FROM v"""


def _members(segments):
    """Vertex membership, each vertex named by its lowest end."""
    ends = materialize(gr.segment_ends(segments), "members")
    named = ends.groupBy("vertex").agg(F.min(F.col("id") * 2 + F.col("tip")).alias("first_end"), F.count(F.lit(1)).alias("ends"))
    return ends.join(named, "vertex").select("id", "tip", "first_end", "ends")


@query("segment_vertices", "chain", sql=_MEMBERS)
def _(fx):
    return _members(fx.chain)


@query("segment_vertices_near", "chain", sql=_MEMBERS)
def _(fx):
    # ends a few ten-thousandths off, to both sides of every cell border
    def off(c, k):
        return F.col(c) + ((F.col("id") * 7 + k) % 7 - 3) * 1.5e-4

    return _members(fx.chain.withColumns({c: off(c, k) for k, c in enumerate(("x1", "y1", "x2", "y2"))}))


@query("next_connected", "chain",
       sql=_ENDS + f""", p AS (SELECT a.id, b.id AS mate, {_KIND} AS kind, a.tip * 2 + b.tip AS code
                               FROM en a JOIN en b ON a.x = b.x AND a.y = b.y AND a.id <> b.id)
              SELECT id, mate, kind FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY mate, code) = 1""")  # fmt: skip
def _(fx):
    return gr.next_connected(fx.chain)


@query(
    "stitch_paths", "chain",
    sql="""WITH RECURSIVE en AS (SELECT id, 0 AS tip, x1 AS x, y1 AS y FROM fx_chain UNION ALL SELECT id, 1, x2, y2 FROM fx_chain),
    lone AS (SELECT x, y, min(id) AS id, min(tip) AS tip FROM en GROUP BY x, y HAVING count(*) = 1),
    hop AS (SELECT a.id, a.tip, b.id AS nid, b.tip AS ntip FROM en a JOIN en b ON a.x = b.x AND a.y = b.y AND a.id <> b.id),
    w AS (SELECT id AS head, id, tip, CAST(0 AS BIGINT) AS pos FROM lone
          UNION ALL SELECT head, nid, ntip, pos + 1 FROM w JOIN hop ON hop.id = w.id AND hop.tip = 1 - w.tip)
    SELECT id, head AS path_id, pos, tip = 1 AS reversed, false AS is_ring FROM w
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY head, pos) = 1""",
)
def _(fx):
    return gr.stitch_paths(fx.chain)


@query(
    "unused_segments", "chain", "segment",
    sql="""
    , s AS (SELECT id, x1, y1, x2, y2 FROM fx_chain UNION ALL SELECT id + 100000000000, x1, y1, x2, y2 FROM fx_segment),
    en AS (SELECT id, 0 AS tip, x1 AS x, y1 AS y FROM s UNION ALL SELECT id, 1, x2, y2 FROM s),
    rk AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY id, tip) AS rn, count(*) OVER (PARTITION BY x, y) AS n FROM en),
    used AS (SELECT id FROM rk WHERE rn < n OR rn % 2 = 0)
    SELECT id, x1, y1, x2, y2 FROM s WHERE id NOT IN (SELECT id FROM used)""",
)
def _(fx):
    loose = fx.segment.withColumn("id", F.col("id") + 100000000000)
    segs = fx.chain.select("id", "x1", "y1", "x2", "y2").unionByName(loose.select("id", "x1", "y1", "x2", "y2"))
    return gr.unused_segments(segs, gr.stitch_paths(segs))


# a wall triangle spans from its corner on the base to the top, or the other way round; its cut runs
# between the points where the plane meets the two edges that cross it
_CUT = """
    , e AS (SELECT mesh_id, facet_id, i, CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS ax, CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END AS ay,
                   CASE i WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS az, CASE i WHEN 0 THEN x1 WHEN 1 THEN x2 ELSE x0 END AS bx,
                   CASE i WHEN 0 THEN y1 WHEN 1 THEN y2 ELSE y0 END AS by_, CASE i WHEN 0 THEN z1 WHEN 1 THEN z2 ELSE z0 END AS bz
            FROM fx_facet CROSS JOIN range(3) AS r(i)),
    h AS (SELECT mesh_id, CAST(j AS BIGINT) AS slice, facet_id, az > bz AS down, ax + (j - az) / (bz - az) * (bx - ax) AS x,
                 ay + (j - az) / (bz - az) * (by_ - ay) AS y,
                 CASE WHEN (ax, ay, az) < (bx, by_, bz) THEN (ax, ay, az, bx, by_, bz) ELSE (bx, by_, bz, ax, ay, az) END AS edge
          FROM e JOIN range(25) AS r(j) ON j >= least(az, bz) AND j < greatest(az, bz)),
    s AS (SELECT mesh_id, slice, facet_id, max(CASE WHEN {fwd} THEN x END) AS x1, max(CASE WHEN {fwd} THEN y END) AS y1,
                 max(CASE WHEN NOT {fwd} THEN x END) AS x2, max(CASE WHEN NOT {fwd} THEN y END) AS y2,
                 any_value(CASE WHEN {fwd} THEN edge END) AS fe, any_value(CASE WHEN NOT {fwd} THEN edge END) AS be FROM h GROUP BY 1, 2, 3)"""
_CUTS = _CUT.format(fwd="down")
_PTS = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("x1", "y1", "x2", "y2"))


@query("slice_facets", "facet", sql=_CUTS + f" SELECT mesh_id, slice, facet_id, {_PTS} FROM s")
def _(fx):
    return rounded(gr.slice_facets(fx.facet, 1.0).drop("fwd", "bwd"))


_WALK = "WITH RECURSIVE " + _CUTS.lstrip().lstrip(",") + """,
    n AS (SELECT a.mesh_id, a.slice, a.facet_id, b.facet_id AS nid FROM s a JOIN s b ON a.mesh_id = b.mesh_id AND a.slice = b.slice AND a.be = b.fe),
    w AS (SELECT mesh_id, slice, facet_id AS contour, facet_id, CAST(0 AS BIGINT) AS pos FROM s
          UNION ALL SELECT w.mesh_id, w.slice, contour, nid, pos + 1 FROM w JOIN n ON n.mesh_id = w.mesh_id AND n.slice = w.slice
                    AND n.facet_id = w.facet_id WHERE nid > contour),
    ring AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY mesh_id, slice, facet_id ORDER BY contour) = 1)"""


@query("chain_contours", "facet",
       sql=_WALK + f" SELECT mesh_id, slice, facet_id, contour, pos, true AS is_closed, {_PTS} FROM ring JOIN s USING (mesh_id, slice, facet_id)")
def _(fx):
    return rounded(gr.chain_contours(gr.slice_facets(fx.facet, 1.0)))


@query(
    "contour_stats", "facet",
    sql="""SELECT p_partkey AS mesh_id, CAST(j AS BIGINT) AS slice, CAST(1 AS BIGINT) AS contours, CAST(8 AS BIGINT) AS segments,
                  2.0::DOUBLE * (p_size + 1 + p_partkey % 13 + 2) AS perimeter
           FROM part JOIN range(25) AS r(j) ON j < p_partkey % 17 + 3""",
)
def _(fx):
    rows = gr.chain_contours(gr.slice_facets(fx.facet, 1.0))
    return rounded(
        rows.groupBy("mesh_id", "slice").agg(
            F.count(F.when(F.col("pos") == 0, 1)).alias("contours"),
            F.count(F.lit(1)).alias("segments"),
            F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("perimeter"),
        )
    )


@query(
    "simplify_contour", "facet",
    sql=_WALK + """,
    p AS (SELECT mesh_id, slice, pos, x1 AS x, y1 AS y FROM ring JOIN s USING (mesh_id, slice, facet_id)),
    f AS (SELECT mesh_id, slice, pos, x AS lx, y AS ly, CAST(NULL AS DOUBLE) AS ref, x, y, pos AS keep FROM p WHERE pos = 0
          UNION ALL
          SELECT mesh_id, slice, pos, CASE WHEN bend THEN px ELSE lx END, CASE WHEN bend THEN py ELSE ly END,
                 CASE WHEN bend THEN atan2(y - py + 0.0, x - px + 0.0) WHEN ref IS NULL THEN ang ELSE ref END, x, y, CASE WHEN bend THEN pos - 1 END
          FROM (SELECT *, ref IS NOT NULL AND least(abs(ang - ref), 2 * pi() - abs(ang - ref)) > radians(1) AS bend
                FROM (SELECT p.mesh_id, p.slice, p.pos, lx, ly, ref, f.x AS px, f.y AS py, p.x, p.y,
                             atan2(p.y - ly + 0.0, p.x - lx + 0.0) AS ang
                      FROM f JOIN p ON p.mesh_id = f.mesh_id AND p.slice = f.slice AND p.pos = f.pos + 1) t) u),
    k AS (SELECT mesh_id, slice, keep AS pos FROM f WHERE keep IS NOT NULL
          UNION SELECT mesh_id, slice, max(pos) FROM p GROUP BY 1, 2)
    SELECT mesh_id, slice, pos, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM k JOIN p USING (mesh_id, slice, pos)
    UNION ALL SELECT mesh_id, slice, hi + 1, round(x, 4) + 0.0, round(y, 4) + 0.0
    FROM p JOIN (SELECT mesh_id, slice, max(pos) AS hi FROM p GROUP BY 1, 2) m USING (mesh_id, slice) WHERE pos = 0""",
)
def _(fx):
    rows = gr.chain_contours(gr.slice_facets(fx.facet, 1.0))
    points = rows.select("mesh_id", "slice", "contour", "pos", F.col("x1").alias("x"), F.col("y1").alias("y"), "is_closed")
    return rounded(simplify_contour(points, ["mesh_id", "slice", "contour"], "pos", closed=F.col("is_closed")).drop("contour"))
