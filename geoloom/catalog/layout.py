"""Queries over the layout tree and progress events."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.catalog import query
from geoloom.catalog.joins import _PART, _TILES
from geoloom.catalog.shapes import rounded
from geoloom.functions import affine
from geoloom.operators import aggregate as agg
from geoloom.operators import layout as lay
from geoloom.operators import progress as pg
from geoloom.plans.scratch import scratch_path
from geoloom.sources import layout_xml
from geoloom.streaming import progress as live


@query(
    "layout_from_xml", "node",
    sql="""
    SELECT CASE n.level WHEN 'plate' THEN n.node_id::STRING WHEN 'device' THEN n.parent_id::STRING || '/' || n.node_id
                ELSE p.parent_id::STRING || '/' || n.parent_id || '/' || n.node_id END AS node,
           CASE n.level WHEN 'device' THEN n.parent_id::STRING WHEN 'layer' THEN p.parent_id::STRING || '/' || n.parent_id END AS parent,
           n.level, n.off_x, n.off_y, n.rot_deg, n.scale, n.num_x, n.num_y, n.pitch_x, n.pitch_y
    FROM fx_node n LEFT JOIN fx_node p ON p.node_id = n.parent_id""",
)
def _(fx):
    path = scratch_path(fx.spark, "layout")
    layout_xml.write_layout(fx.node, path)
    return layout_xml.layout_nodes(layout_xml.read_layout(fx.spark, path))


_FLAT = """
    , i AS (SELECT p.node_id AS plate_id, px * p.num_y + py AS plate_copy, d.node_id AS device_id, dx * d.num_y + dy AS device_copy,
                   l.node_id AS layer_id, d.off_x + px * p.pitch_x AS device_x, d.off_y + py * p.pitch_y AS device_y,
                   l.off_x + dx * d.pitch_x AS layer_x, l.off_y + dy * d.pitch_y AS layer_y
            FROM fx_node p JOIN fx_node d ON d.parent_id = p.node_id AND d.level = 'device' JOIN fx_node l ON l.parent_id = d.node_id
            JOIN range(9) AS a(px) ON px < p.num_x JOIN range(9) AS b(py) ON py < p.num_y
            JOIN range(9) AS c(dx) ON dx < d.num_x JOIN range(9) AS e(dy) ON dy < d.num_y
            WHERE p.level = 'plate' AND l.level = 'layer')"""


@query("flatten_layout", "node", sql=_FLAT + " SELECT * FROM i")
def _(fx):
    return lay.flatten_layout(fx.node)


@query(
    "layout_extents", "node", "segment",
    sql=_FLAT + """, e AS (SELECT substr(layer, 1, 1)::BIGINT AS pattern, count(*) AS n, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0,
                   max(greatest(x1, x2)) AS x1, max(greatest(y1, y2)) AS y1 FROM fx_segment GROUP BY 1)
    SELECT plate_id, sum(n)::BIGINT AS n, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y
    FROM i JOIN e ON e.pattern = layer_id % 5 + 1 GROUP BY plate_id""",
)
def _(fx):
    patterns = fx.segment.withColumn("pattern", F.substring("layer", 1, 1).cast("bigint"))
    used = fx.node.filter("level = 'layer'").select(F.col("node_id").alias("layer_id"), (F.col("node_id") % 5 + 1).alias("pattern"))
    return lay.layout_extents(lay.flatten_layout(fx.node), used, agg.extents_agg(patterns, "pattern"))


@query(
    "layout_extents_placed", "node", "segment",
    sql=_FLAT + """, e AS (SELECT substr(layer, 1, 1)::BIGINT AS pattern, count(*) AS n, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0,
                   max(greatest(x1, x2)) AS x1, max(greatest(y1, y2)) AS y1 FROM fx_segment GROUP BY 1),
    q AS (SELECT plate_id, n, device_x + layer_x AS sx, device_y + layer_y AS sy, CASE WHEN layer_id % 2 = 0 THEN x0 ELSE -2 * y1 END AS x0,
                 CASE WHEN layer_id % 2 = 0 THEN x1 ELSE -2 * y0 END AS x1, CASE WHEN layer_id % 2 = 0 THEN y0 ELSE 2 * e.x0 END AS y0,
                 CASE WHEN layer_id % 2 = 0 THEN y1 ELSE 2 * e.x1 END AS y1 FROM i JOIN e ON e.pattern = layer_id % 5 + 1)
    SELECT plate_id, sum(n)::BIGINT AS n, min(x0 + sx) AS min_x, min(y0 + sy) AS min_y, max(x1 + sx) AS max_x, max(y1 + sy) AS max_y
    FROM q GROUP BY ROLLUP (plate_id)""",
)
def _(fx):
    # every second layer is turned by a quarter and doubled; the last row is the whole layout
    patterns = fx.segment.withColumn("pattern", F.substring("layer", 1, 1).cast("bigint"))
    used = fx.node.filter("level = 'layer'").select(F.col("node_id").alias("layer_id"), (F.col("node_id") % 5 + 1).alias("pattern"))
    turned = F.col("layer_id") % 2 == 1
    cells = {"a": F.when(turned, 0.0).otherwise(1.0), "b": F.when(turned, 2.0).otherwise(0.0), "c": F.when(turned, -2.0).otherwise(0.0), "d": F.when(turned, 0.0).otherwise(1.0)}
    instances = lay.flatten_layout(fx.node).withColumns(cells)
    return lay.layout_extents(instances, used, agg.extents_agg(patterns, "pattern"), apply=True, total=True)


# fiducials: every point marks a plate, a device or a layer
_FID = """fid AS (SELECT id, CASE id % 3 WHEN 0 THEN id % 4 WHEN 1 THEN 100 + id % 15 ELSE 1000 + id % 70 END AS node_id FROM fx_point)"""


def _fiducials(fx):
    i = F.col("id")
    return fx.point.select(
        "id", F.when(i % 3 == 0, i % 4).when(i % 3 == 1, 100 + i % 15).otherwise(1000 + i % 70).alias("node_id")
    )


@query("fiducial_count", "point", sql=f", {_FID} SELECT node_id, count(*) AS fiducials FROM fid GROUP BY ROLLUP (node_id)")
def _(fx):
    return agg.fiducial_count(_fiducials(fx))


@query(
    "nearest_ancestor", "node", "point",
    sql=f"""WITH RECURSIVE {_FID},
    up AS (SELECT node_id, node_id AS anc, parent_id, 0 AS hops FROM fx_node
           UNION ALL SELECT u.node_id, n.node_id, n.parent_id, hops + 1 FROM up u JOIN fx_node n ON n.node_id = u.parent_id),
    hit AS (SELECT node_id, arg_min(anc, hops) AS ancestor, min(hops) AS hops FROM up WHERE anc IN (SELECT node_id FROM fid) GROUP BY node_id)
    SELECT n.node_id, ancestor, hops FROM fx_node n LEFT JOIN hit USING (node_id)""",
)
def _(fx):
    return lay.nearest_ancestor(fx.node, _fiducials(fx))


@query(
    "valid_layers", "node", "point", "dxf_line",
    sql=f"""
    , {_FID}, f AS (SELECT DISTINCT file AS name FROM fx_dxf_line UNION SELECT 'par' || substr(file, 4) FROM fx_dxf_line)
    SELECT node_id, 'dwg' || (node_id % 25) AS pattern_file, 'par' || (node_id % 22) AS param_file, node_id IN (SELECT node_id FROM fid) AS needs_alignment
    FROM fx_node WHERE level = 'layer' AND 'dwg' || (node_id % 25) IN (SELECT name FROM f) AND 'par' || (node_id % 22) IN (SELECT name FROM f)""",
)
def _(fx):
    drawings = fx.dxf_line.select(F.col("file").alias("name"))
    files = drawings.unionByName(drawings.select(F.concat(F.lit("par"), F.substring("name", 4, 20)).alias("name")))
    layers = fx.node.filter("level = 'layer'").select(
        "node_id", F.concat(F.lit("dwg"), (F.col("node_id") % 25).cast("string")).alias("pattern_file"),
        F.concat(F.lit("par"), (F.col("node_id") % 22).cast("string")).alias("param_file"),
    )
    return lay.valid_layers(layers, files, _fiducials(fx))


_OWN = """o AS (SELECT node_id, parent_id, level, scale * cos(radians(rot_deg)) AS a, scale * sin(radians(rot_deg)) AS b, -scale * sin(radians(rot_deg)) AS c,
                       scale * cos(radians(rot_deg)) AS d, off_x AS tx, off_y AS ty FROM fx_node),
    w AS (SELECT node_id, level, parent_id AS up, a, b, c, d, tx, ty FROM o
          UNION ALL SELECT w.node_id, w.level, o.parent_id, o.a * w.a + o.c * w.b, o.b * w.a + o.d * w.b, o.a * w.c + o.c * w.d, o.b * w.c + o.d * w.d,
                           o.a * w.tx + o.c * w.ty + o.tx, o.b * w.tx + o.d * w.ty + o.ty FROM w JOIN o ON o.node_id = w.up)"""
_SIX = ", ".join(f"round({{p}}{c}, 6) + 0.0 AS {c}" for c in ("a", "b", "c", "d", "tx", "ty"))


@query("node_transforms", "node", sql=f"WITH RECURSIVE {_OWN} SELECT node_id, level, {_SIX.format(p='')} FROM w WHERE up IS NULL")
def _(fx):
    return rounded(lay.node_transforms(fx.node).drop("parent_id"), 6)


@query(
    "node_transforms_inverted", "node",
    sql=f"""WITH RECURSIVE {_OWN}, f AS (SELECT o.node_id, o.level, -o.a AS a, o.b, -o.c AS c, o.d,
                 p.tx - (o.tx - o.a * p.tx - o.c * p.ty) AS tx, p.ty + (o.ty - o.b * p.tx - o.d * p.ty) AS ty
            FROM o JOIN w p ON p.node_id = o.parent_id AND p.up IS NULL
            UNION ALL SELECT node_id, level, a, b, c, d, tx, ty FROM o WHERE parent_id IS NULL)
    SELECT node_id, level, {_SIX.format(p='')} FROM f""",
)
def _(fx):
    return rounded(lay.inverted_transforms(fx.node, True, False).drop("parent_id"), 6)


@query(
    "tile_local", "segment",
    sql="," + _TILES.format(pad=0) + _PART + """,
    m AS (SELECT *, (bx0 + bx1) / 2 AS mx, (by0 + by1) / 2 AS my FROM p),
    q2 AS (SELECT *, mx * cos(0.1) - my * sin(0.1) + 40 AS gx, mx * sin(0.1) + my * cos(0.1) - 30 AS gy FROM m)
    SELECT id, tile, round(px1 - mx, 4) + 0.0 AS x1, round(py1 - my, 4) + 0.0 AS y1, round(px2 - mx, 4) + 0.0 AS x2, round(py2 - my, 4) + 0.0 AS y2,
           round(500 - (gx * cos(0.03) - gy * sin(0.03)), 4) + 0.0 AS stage_x, round(600 + gx * sin(0.03) + gy * cos(0.03), 4) + 0.0 AS stage_y FROM q2""",
)
def _(fx):
    ext = agg.extents_agg(fx.segment).drop("n")
    layer_map = affine.rotate(0.1).then(affine.translate(40.0, -30.0))
    parts = lay.tile_local(
        fx.segment, ext, 700.0, 600.0, [], layer_map, origin=(500.0, 600.0), theta=0.03, inverts=(-1.0, 1.0)
    )
    return rounded(parts.select("id", "tile", "x1", "y1", "x2", "y2", "stage_x", "stage_y"))


@query(
    "progress_summary", "progress",
    sql="""
    , p AS (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, state, progress) AS nx FROM fx_progress),
    s AS (SELECT entity_id, count(*) AS events, arg_max(state, ROW(ts, state, progress)) AS state,
                 arg_max(greatest(0, least(100, progress)), ROW(ts, state, progress)) AS progress,
                 coalesce(sum(CASE WHEN state = 'RUNNING' THEN epoch_us(nx) - epoch_us(ts) END) / 1e6, 0) AS running_s FROM p GROUP BY entity_id),
    l AS (SELECT *, CASE WHEN state = 'COMPLETED' THEN 0 ELSE (100 - progress) / 100 * 600 END AS left_s FROM s),
    t AS (SELECT * FROM l UNION ALL SELECT NULL, sum(events)::BIGINT, 'ALL', avg(progress), sum(running_s), sum(left_s) FROM l)
    SELECT entity_id, events, state, round(progress, 4) + 0.0 AS progress, round(running_s, 4) + 0.0 AS running_s, round(left_s, 4) + 0.0 AS left_s FROM t""",
)
def _(fx):
    return rounded(pg.progress_summary(fx.progress, 600.0))


def _event_files(fx):
    path = scratch_path(fx.spark, "events")
    fx.progress.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return path


@query(
    "progress_stream", "progress",
    sql="""SELECT entity_id, max(ts) AS ts, arg_max(state, ts) AS state, round(arg_max(greatest(0, least(100, progress)), ts), 4) + 0.0 AS progress,
                  count(*) AS events FROM fx_progress GROUP BY entity_id""",
)
def _(fx):
    stream = live.latest_progress(live.read_progress(fx.spark, _event_files(fx)))
    out = live.run_to_table(stream, scratch_path(fx.spark, "latest"), scratch_path(fx.spark, "latest-log"))
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(
    "progress_running", "progress",
    sql="""
    , p AS (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, state, progress) AS nx FROM fx_progress),
    s AS (SELECT entity_id, max(ts) AS ts, count(*) AS events, arg_max(state, ROW(ts, state, progress)) AS state,
                 arg_max(greatest(0, least(100, progress)), ROW(ts, state, progress)) AS progress,
                 coalesce(sum(CASE WHEN state = 'RUNNING' THEN epoch_us(nx) - epoch_us(ts) END) / 1e6, 0) AS running_s FROM p GROUP BY entity_id)
    SELECT entity_id, ts, state, round(progress, 4) + 0.0 AS progress, events, round(running_s, 4) + 0.0 AS running_s,
           round(CASE WHEN state = 'COMPLETED' THEN 0 ELSE (100 - progress) / 100 * 600 END, 4) + 0.0 AS left_s FROM s""",
)
def _(fx):
    # three deliveries, events up to half a day late; the stream stops and starts again between them
    path, out, log = (scratch_path(fx.spark, n) for n in ("arriving", "running", "running-log"))
    events = fx.progress.withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("entity_id", "ts"), F.lit(43_200))
    events = events.withColumn("arrival", arrival)
    first, last = events.agg(F.min("arrival"), F.max("arrival")).first()
    share = (F.col("arrival") - (first or 0)) / max(1, (last or 0) - (first or 0) + 1)
    for k in range(3):
        events.where(F.floor(share * 3) == k).drop("arrival").write.mode("append").parquet(path)
        live.write_changes(live.running_progress(live.read_progress(fx.spark, path), 600.0, "1 day"), out, log)
    found = live.latest_changes(fx.spark, out).drop("closed")
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(
    "progress_stream_windows", "progress",
    sql="""
    , w AS (SELECT date_trunc('hour', ts) AS start, state, count(*) AS events FROM fx_progress GROUP BY 1, 2)
    SELECT start, state, events FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM fx_progress)""",
)
def _(fx):
    # only windows that the watermark has closed are written
    stream = live.state_counts(live.read_progress(fx.spark, _event_files(fx)))
    out = live.run_to_table(stream, scratch_path(fx.spark, "windows"), scratch_path(fx.spark, "windows-log"), "append")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
