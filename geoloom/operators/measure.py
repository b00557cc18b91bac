"""Measures, boxes, positions along shapes, and the filters built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators.generate import path_to_segments
from geoloom.operators.transform import is_region
from geoloom.plans.scan import CHUNK_ROWS, ordered_scan
from geoloom.plans.scratch import materialize


def measure_segments(segments: DataFrame) -> DataFrame:
    """Length, signed length, direction, gradient, intercept and orientation of each segment."""
    ends = ("x1", "y1", "x2", "y2")
    z1, z2 = ((F.col(c) if c in segments.columns else F.lit(0.0)) for c in ("z1", "z2"))
    dx, dy, dz = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), z2 - z1
    direction = g.angle(*ends)
    slope = g.gradient(*ends)
    return segments.withColumns(
        {
            "length": g.length(*ends),
            "length_3d": g.length3(dx, dy, dz),
            "signed_length": g.signed_length(*ends),
            "angle": direction,
            "angle_deg": F.degrees(g.positive_angle(direction)),
            "gradient": slope,
            "intercept": F.col("y1") - slope * F.col("x1"),
            "roll": F.atan2(dz + 0.0, dy + 0.0),
            "pitch": F.atan2(dz + 0.0, dx + 0.0),
            "yaw": direction,
        }
    )


def measure_paths(vertices: DataFrame) -> DataFrame:
    """Length, enclosed area and half diagonal of every path; all sums combine before the shuffle."""
    segs = path_to_segments(vertices)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = segs.groupBy("path_id").agg(
        F.sum(g.length("x1", "y1", "x2", "y2")).alias("length"),
        F.sum(cross).alias("twice_area"),
        *g.at_first("seq", "head_", "x1", "y1"),
        *g.at_last("seq", "tail_", "x2", "y2"),
        F.least(F.min("x1"), F.min("x2")).alias("min_x"),
        F.least(F.min("y1"), F.min("y2")).alias("min_y"),
        F.greatest(F.max("x1"), F.max("x2")).alias("max_x"),
        F.greatest(F.max("y1"), F.max("y2")).alias("max_y"),
        (F.count(F.lit(1)) + 1).alias("points"),
    )
    closing = F.col("tail_x2") * F.col("head_y1") - F.col("head_x1") * F.col("tail_y2")
    return sums.select(
        F.col("path_id").alias("id"),
        F.lit("path").alias("kind"),
        "length",
        F.when(F.col("points") >= 4, F.abs(F.col("twice_area") + closing) / 2).otherwise(F.lit(0.0)).alias("area"),
        (F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / 2).alias("radius"),
    )


def measure_curves(curves: DataFrame) -> DataFrame:
    turn = F.when(F.col("kind") == "circle", F.lit(g.TWO_PI)).otherwise(g.sweep("a0", "a1"))
    return curves.select(
        "id",
        "kind",
        (turn * F.col("r")).alias("length"),
        (turn * F.col("r") * F.col("r") / 2).alias("area"),
        F.col("r").alias("radius"),
    )


def measure_boxes(boxes: DataFrame) -> DataFrame:
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return boxes.select(
        "id",
        F.lit("box").alias("kind"),
        (2 * (w + h)).alias("length"),
        (w * h).alias("area"),
        (F.hypot(w, h) / 2).alias("radius"),
    )


def measure_lines(segments: DataFrame) -> DataFrame:
    span = g.length("x1", "y1", "x2", "y2")
    return segments.select(
        "id", F.lit("line").alias("kind"), span.alias("length"), F.lit(0.0).alias("area"), (span / 2).alias("radius")
    )


def measure_shapes(
    *,
    vertices: DataFrame | None = None,
    curves: DataFrame | None = None,
    boxes: DataFrame | None = None,
    segments: DataFrame | None = None,
) -> DataFrame:
    """One row (id, kind, length, area, radius) per shape of the tables given."""
    parts = []
    for table, measure in (
        (vertices, measure_paths),
        (curves, measure_curves),
        (boxes, measure_boxes),
        (segments, measure_lines),
    ):
        if table is not None:
            parts.append(measure(table))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def measured_path_segments(vertices: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Path segments with the length before (``len_from``) and after (``len_to``) each."""
    segs = path_to_segments(vertices, keep_chunk=True, chunk_rows=chunk_rows)
    # both the scan and its chunk totals read the segments: write them once
    segs = materialize(segs.withColumn("len", g.length("x1", "y1", "x2", "y2")), "segments")
    out = ordered_scan(segs, ["path_id"], ["seq"], "chunk", running={"len_to": F.col("len")})
    return out.withColumn("len_from", F.col("len_to") - F.col("len")).drop("chunk")


def point_at(vertices: DataFrame, t: float) -> DataFrame:
    """Point at fraction ``t`` of every path; outside 0..1 the end segment is extended."""
    segs = measured_path_segments(vertices)
    whole = segs.groupBy("path_id").agg(
        F.sum("len").alias("total"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    goal = F.lit(float(t)) * F.col("total")
    first, last = F.col("seq") == F.col("first_seq"), F.col("seq") == F.col("last_seq")
    holds = (
        (first | (F.col("len_from") <= goal)) & (last | (goal < F.col("len_to")))
        & (first | last | (F.col("len") > 0))
    )
    part = g.ratio(goal - F.col("len_from"), F.col("len"))
    return (
        segs.join(whole, "path_id")
        .filter(holds)
        .groupBy("path_id")  # rounding can leave two holders at a joint; the earlier one counts
        .agg(
            F.min_by(g.mix("x1", "x2", F.coalesce(part, F.lit(0.0))), "seq").alias("x"),
            F.min_by(g.mix("y1", "y2", F.coalesce(part, F.lit(0.0))), "seq").alias("y"),
        )
    )


def extents_of(segments: DataFrame) -> DataFrame:
    """Bounding box of each segment and what follows from it."""
    return extents_columns(segments.withColumns(g.segment_box()))


def extents_columns(boxes: DataFrame) -> DataFrame:
    """Width, height, diagonal, centre, area, perimeter and the box point nearest the origin."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")

    def nearest(axis: str) -> Column:
        return F.greatest(F.col(f"min_{axis}"), F.least(F.lit(0.0), F.col(f"max_{axis}")))

    return boxes.withColumns(
        {
            "width": w,
            "height": h,
            "hypotenuse": F.hypot(w, h),
            "centre_x": F.col("min_x") + w / 2,
            "centre_y": F.col("min_y") + h / 2,
            "box_area": w * h,
            "box_perimeter": 2 * (w + h),
            "near_x": nearest("x"),
            "near_y": nearest("y"),
        }
    )


def curve_extents(curves: DataFrame) -> DataFrame:
    """Exact bounding box of circles and arcs: the ends and the axis extremes that the arc passes."""
    turn = g.sweep("a0", "a1")
    circle = F.col("kind") == "circle"

    def passes(quarter: int) -> Column:
        return circle | (F.pmod(F.lit(quarter * math.pi / 2) - F.col("a0"), F.lit(2 * math.pi)) <= turn)

    (x0, y0), (x1, y1) = (g.polar("cx", "cy", "r", a) for a in (F.col("a0"), F.col("a0") + turn))

    def side(fn, one: Column, two: Column, quarter: int, extreme: Column) -> Column:
        return F.when(passes(quarter), extreme).otherwise(fn(one, two))

    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    out = curves.withColumns(
        {
            "min_x": side(F.least, x0, x1, 2, cx - r), "min_y": side(F.least, y0, y1, 3, cy - r),
            "max_x": side(F.greatest, x0, x1, 0, cx + r), "max_y": side(F.greatest, y0, y1, 1, cy + r),
        }
    )
    return extents_columns(out)


def extend_segments(segments: DataFrame, distance: float, start: bool = True, end: bool = True) -> DataFrame:
    """Lengthen lines at their start, end or both; a line of no length stays as it is."""
    reach = F.coalesce(g.ratio(F.lit(float(distance)), g.length("x1", "y1", "x2", "y2")), F.lit(0.0))
    t0 = -reach if start else F.lit(0.0)
    t1 = 1.0 + reach if end else F.lit(1.0)
    moved = {
        "x1": g.mix("x1", "x2", t0), "y1": g.mix("y1", "y2", t0),
        "x2": g.mix("x1", "x2", t1), "y2": g.mix("y1", "y2", t1),
    }
    return segments.withColumns(moved)


def extend_arcs(arcs: DataFrame, distance: float, start: bool = True, end: bool = True) -> DataFrame:
    """Lengthen arcs along their circle; circles stay as they are."""
    step = F.coalesce(g.ratio(F.lit(float(distance)), F.col("r")), F.lit(0.0))
    is_arc = F.col("kind") == "arc"
    a1 = F.col("a0") + g.sweep("a0", "a1")
    return arcs.withColumns(
        {
            "a0": F.when(is_arc, F.col("a0") - step if start else F.col("a0")).otherwise(F.col("a0")),
            "a1": F.when(is_arc, a1 + step if end else a1).otherwise(F.col("a1")),
        }
    )


def extend_paths(vertices: DataFrame, distance: float, start: bool = True, end: bool = True) -> DataFrame:
    """Add a point before the first and after the last vertex of every open path."""
    segs = path_to_segments(vertices)
    ends = segs.groupBy("path_id").agg(
        *g.at_first("seq", "h_", "seq", "x1", "y1", "x2", "y2"),
        *g.at_last("seq", "t_", "seq", "x1", "y1", "x2", "y2"),
        F.count(F.lit(1)).alias("n"),
    )
    closed = (F.col("n") >= 3) & (F.col("h_x1") == F.col("t_x2")) & (F.col("h_y1") == F.col("t_y2"))
    ends = ends.filter(~closed)

    def outside(s: str, at: Column) -> list[Column]:
        return [
            g.mix(f"{s}_x1", f"{s}_x2", at).alias("x"),
            g.mix(f"{s}_y1", f"{s}_y2", at).alias("y"),
        ]

    def reach(s: str) -> Column:
        span = g.length(f"{s}_x1", f"{s}_y1", f"{s}_x2", f"{s}_y2")
        return F.coalesce(g.ratio(F.lit(float(distance)), span), F.lit(0.0))

    out = vertices.select("path_id", "seq", "x", "y")
    if start:
        out = out.unionByName(
            ends.select("path_id", (F.col("h_seq") - 1).alias("seq"), *outside("h", -reach("h")))
        )
    if end:
        out = out.unionByName(
            ends.select("path_id", (F.col("t_seq") + 2).alias("seq"), *outside("t", 1.0 + reach("t")))
        )
    return out


def filter_in_box(
    points: DataFrame, min_x=-math.inf, min_y=-math.inf, max_x=math.inf, max_y=math.inf, min_z=None, max_z=None
) -> DataFrame:
    """Points inside closed bounds; plain comparisons that reach the file scan."""
    keep = F.lit(True)
    for name, low, high in (("x", min_x, max_x), ("y", min_y, max_y), ("z", min_z, max_z)):
        if low is not None and low > -math.inf:
            keep = keep & (F.col(name) >= float(low))
        if high is not None and high < math.inf:
            keep = keep & (F.col(name) <= float(high))
    return points.filter(keep)


def path_flags(vertices: DataFrame, tol: float = 0.0) -> DataFrame:
    """Point count, whether the ends meet, and whether the path bounds a region."""
    ends = vertices.groupBy("path_id").agg(
        F.count(F.lit(1)).alias("points"),
        *g.at_first("seq", "h_", "x", "y"),
        *g.at_last("seq", "t_", "x", "y"),
    )
    return ends.select(
        "path_id",
        "points",
        ((F.col("points") >= 4) & (g.length("h_x", "h_y", "t_x", "t_y") <= tol)).alias("is_closed"),
        is_region(F.lit("path")).alias("is_region"),
    )
