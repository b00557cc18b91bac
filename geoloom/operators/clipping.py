"""Exact clipping of curves, paths and points to boxes; segments are clipped in ``spatial``.

A curve is cut where it crosses the lines of a box, as angles, never as chords. The angles that lie in the sweep part
it into stretches, which are inside or outside as a whole; neighbouring stretches inside are one piece. A path
is clipped segment by segment, and runs of parts that follow each other without a gap are one path again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators.generate import path_to_segments
from geoloom.operators.spatial import BOX, clip_to_boxes
from geoloom.plans.cells import Box, cell_join, point_box
from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import materialize

TWO_PI = 2.0 * math.pi
#: decimals of an angle: closer crossings, as at a corner, are one
DIGITS = 9


def _boxes(boxes: DataFrame, key: str) -> DataFrame:
    return boxes.select(F.col(key).alias("box"), *(F.col(c).cast("double").alias(f"b_{c}") for c in BOX))


def clip_points(points: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """Points (id, x, y) with each box that holds them, borders included: (id, box, x, y)."""
    found = cell_join(points.select("id", "x", "y"), _boxes(boxes, key), point_box("x", "y"), Box(*(f"b_{c}" for c in BOX)))
    return found.select("id", "box", "x", "y")


def clip_curves(curves: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """Pieces of circles and arcs (id, kind, cx, cy, r, a0, a1) inside boxes: (id, box, piece, kind, cx, cy, r, a0, a1).

    A piece runs counter-clockwise from a0 to a1, which may pass a full turn; pieces count from 0 along the
    curve. A circle that lies inside whole stays a circle from 0; one that is cut has its pieces joined over its start. A
    curve that only touches a box, or has no length, leaves nothing.
    """
    full = F.col("kind") == "circle"
    named = curves.select(
        "id", "kind", "cx", "cy", "r", F.when(full, 0.0).otherwise(F.col("a0")).alias("start"),
        F.round(F.when(full, TWO_PI).otherwise(g.sweep("a0", "a1")), DIGITS).alias("turn"),
        (F.col("cx") - F.col("r")).alias("c_x0"), (F.col("cy") - F.col("r")).alias("c_y0"),
        (F.col("cx") + F.col("r")).alias("c_x1"), (F.col("cy") + F.col("r")).alias("c_y1"),
    ).where("r > 0 AND turn > 0")
    met = cell_join(named, _boxes(boxes, key), Box("c_x0", "c_y0", "c_x1", "c_y1"), Box(*(f"b_{c}" for c in BOX)))

    def crossings(line: str, centre: str, upright: bool) -> list[Column]:
        v = (F.col(line) - F.col(centre)) / F.col("r")
        one, other = (F.acos(v), -F.acos(v)) if upright else (F.asin(v), math.pi - F.asin(v))
        return [F.when(F.abs(v) <= 1.0, a) for a in (one, other)]

    at = [a for c in ("b_min_x", "b_max_x") for a in crossings(c, "cx", True)] + [a for c in ("b_min_y", "b_max_y") for a in crossings(c, "cy", False)]
    along = F.transform(F.array_compact(F.array(*at)), lambda a: F.round(F.pmod(a - F.col("start"), F.lit(TWO_PI)), DIGITS))
    inner = F.filter(along, lambda a: (a > 0.0) & (a < F.col("turn")))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), inner, F.array(F.col("turn")))))
    met = met.withColumn("marks", marks)
    slack = 1e-9 * F.col("r")

    def inside(lo: Column, hi: Column) -> Column:
        x, y = g.polar("cx", "cy", "r", F.col("start") + (lo + hi) / 2)
        return (
            (x >= F.col("b_min_x") - slack) & (x <= F.col("b_max_x") + slack) & (y >= F.col("b_min_y") - slack) & (y <= F.col("b_max_y") + slack)
        )

    stretches = F.zip_with(F.slice("marks", 1, F.size("marks") - 1), F.slice("marks", 2, F.size("marks") - 1), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    kept = F.filter(stretches, lambda s: inside(s["lo"], s["hi"]))

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), s["hi"].alias("hi"))))
        return F.when((F.size(done) > 0) & (last["hi"] == s["lo"]), joined).otherwise(F.concat(done, F.array(s)))

    met = met.withColumn("runs", F.aggregate(kept, F.array().cast("array<struct<lo:double,hi:double>>"), add))
    head, tail = F.get("runs", F.lit(0)), F.get("runs", F.size("runs") - 1)
    over = (F.col("kind") == "circle") & (F.size("runs") > 1) & (head["lo"] == 0.0) & (tail["hi"] == F.col("turn"))
    round_ = F.struct(tail["lo"].alias("lo"), (tail["hi"] + head["hi"]).alias("hi"))
    runs = F.when(over, F.concat(F.slice("runs", 2, F.size("runs") - 2), F.array(round_))).otherwise(F.col("runs"))
    rows = met.select("id", "box", "kind", "cx", "cy", "r", "start", "turn", F.posexplode(runs).alias("piece", "run"))
    whole = (F.col("kind") == "circle") & (F.col("run.lo") == 0.0) & (F.col("run.hi") == F.col("turn"))
    return rows.select(
        "id", "box", "piece", F.when(whole, "circle").otherwise("arc").alias("kind"), "cx", "cy", "r",
        (F.col("start") + F.col("run.lo")).alias("a0"), (F.col("start") + F.col("run.hi")).alias("a1"),
    )


def clip_paths(vertices: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """Paths (path_id, seq, x, y) inside boxes, as paths again: (path_id, box, run, seq, x, y).

    ``run`` is the seq of the segment a piece begins on; seq counts the vertices of a piece from 0. Parts that
    follow each other inside the box are one piece; a piece that only touches the box is none. The scan goes
    in chunks along each path, so a long one is not gathered.
    """
    segments = path_to_segments(vertices).withColumnRenamed("path_id", "id")
    parts = materialize(clip_to_boxes(segments, boxes.select(F.col(key).alias("box"), *BOX), "box"), "parts")
    keys, chunk = ["id", "box"], chunk_of("seq")
    linked = ordered_scan(parts, keys, ["seq"], chunk, lag={"last": F.struct("seq", "t1")})
    begins = F.col("last").isNull() | (F.col("last.seq") + 1 != F.col("seq")) | (F.col("last.t1") < 1.0) | (F.col("t0") > 0.0)
    marked = materialize(linked.withColumn("head", F.when(begins, F.col("seq"))).drop("last"), "marked")
    runs = ordered_scan(marked, keys, ["seq"], chunk, fill={"run": F.col("head")})
    tips = F.array(
        F.when(F.col("head").isNotNull(), F.struct(F.lit(0).alias("tip"), F.col("x1").alias("x"), F.col("y1").alias("y"))),
        F.struct(F.lit(1).alias("tip"), F.col("x2").alias("x"), F.col("y2").alias("y")),
    )
    points = runs.select("id", "box", "run", "seq", F.inline(F.array_compact(tips)))
    return points.select(F.col("id").alias("path_id"), "box", "run", (F.col("seq") - F.col("run") + F.col("tip")).alias("seq"), "x", "y")
