"""Affine moves, alignment, and stage coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import affine
from geoloom.functions import geometry as g
from geoloom.functions.affine import Affine

SEGMENT_POINTS = (("x1", "y1"), ("x2", "y2"))


def apply_transform(geoms: DataFrame, move: Affine, points=SEGMENT_POINTS) -> DataFrame:
    """Move every (x, y) column pair of a table by one map; a pure projection."""
    moved = {}
    for x, y in points:
        moved[x], moved[y] = move.apply(x, y)
    return geoms.withColumns(moved)


def apply_group_transform(geoms: DataFrame, maps: DataFrame, key: str, points=SEGMENT_POINTS) -> DataFrame:
    """Move each group by its own map (columns a, b, c, d, tx, ty keyed by ``key``).

    No hint: the optimizer broadcasts the maps while their size allows, and else joins by key.
    """
    joined = geoms.join(maps.select(key, "a", "b", "c", "d", "tx", "ty"), key)
    return apply_transform(joined, affine.from_columns(), points).drop("a", "b", "c", "d", "tx", "ty")


def transform_curves(curves: DataFrame, move: Affine) -> DataFrame:
    """Move circles and arcs: centre and start point move, radius and angles follow from them.

    A map that mirrors swaps the ends, so an arc still runs counter-clockwise from a0 to a1. The map
    must scale all directions alike, else the result is no circle; tessellate such curves first.
    """
    cx, cy = move.apply("cx", "cy")
    circle = F.col("kind") == "circle"
    mirrored = g.col(move.a * move.d - move.b * move.c) < 0
    # counter-clockwise from a0 to a1; seen in a mirror the arc starts at its old end
    from_ = F.when(circle, 0.0).when(mirrored, F.col("a1")).otherwise(F.col("a0"))
    x, y = move.apply(*g.polar("cx", "cy", "r", from_))
    start = F.atan2(y - cy, x - cx)
    return curves.withColumns(
        {
            "cx": cx, "cy": cy, "r": F.hypot(x - cx, y - cy),
            "a0": F.when(circle, F.col("a0")).otherwise(start),
            "a1": F.when(circle, F.col("a1")).otherwise(start + g.sweep("a0", "a1")),
        }
    )


def transform_paths(paths: DataFrame, move: Affine, points: str = "points") -> DataFrame:
    """Move paths held as arrays of points, inside the row."""

    def moved(p: Column) -> Column:
        x, y = move.apply(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return paths.withColumn(points, F.transform(points, moved))


def _segment_centre() -> tuple[Column, Column]:
    return (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2


def translate_geometry(segments: DataFrame, dx: float, dy: float) -> DataFrame:
    return apply_transform(segments, affine.translate(dx, dy))


def scale_geometry(segments: DataFrame, sx: float, sy: float, centre: tuple | None = None) -> DataFrame:
    """Scale about a given centre, or each shape about its own."""
    cx, cy = centre if centre else _segment_centre()
    return apply_transform(segments, affine.about(cx, cy, affine.scale(sx, sy)))


def rotate_geometry(segments: DataFrame, radians: float, centre: tuple | None = None) -> DataFrame:
    """Rotate about a given centre, or each shape about its own."""
    cx, cy = centre if centre else _segment_centre()
    return apply_transform(segments, affine.about(cx, cy, affine.rotate(radians)))


def align(segments: DataFrame, group: str, mode: str = "corner", to: tuple | DataFrame = (0.0, 0.0)) -> DataFrame:
    """Shift each group so that its minimum corner or its centre lands on ``to``.

    ``to`` is a point, or a table (group, to_x, to_y) such as the centres of other groups. The
    group boxes are pre-aggregated and joined back, so no group is gathered in one task.
    """
    x0, x1 = F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2"))
    y0, y1 = F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))
    if mode == "corner":
        ref = (x0, y0)
    elif mode == "centre":
        ref = ((x0 + x1) / 2, (y0 + y1) / 2)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    refs = segments.groupBy(group).agg(ref[0].alias("__rx"), ref[1].alias("__ry"))
    if isinstance(to, DataFrame):
        refs = refs.join(to.select(group, "to_x", "to_y"), group)
    else:
        refs = refs.withColumns({"to_x": F.lit(float(to[0])), "to_y": F.lit(float(to[1]))})
    moved = affine.translate(F.col("to_x") - F.col("__rx"), F.col("to_y") - F.col("__ry"))
    return apply_transform(segments.join(refs, group), moved).drop("__rx", "__ry", "to_x", "to_y")


def estimate_affine(pairs: DataFrame, group: str = "grp", kind: str = "fit", order: str | None = None) -> DataFrame:
    """Least-squares map from (x, y) to (mx, my) per group: columns a, b, c, d, tx, ty.

    Only central moments leave each task, so a group of any size costs one small row per task and
    the answer holds far from the origin. Groups
    whose points do not span the plane get the minimum-norm solution; when that solution
    shrinks a diagonal of 100 to nothing it becomes a translation. ``kind='first'``
    translates to the first measured point instead (``order`` says which is first).
    """
    if kind == "first":
        pos = F.col(order) if order else F.struct("x", "y", "mx", "my")
        first = pairs.groupBy(group).agg(F.min_by(F.struct("mx", "my"), pos).alias("p"))
        one, zero = F.lit(1.0), F.lit(0.0)
        return first.select(
            group, one.alias("a"), zero.alias("b"), zero.alias("c"), one.alias("d"),
            F.col("p.mx").alias("tx"), F.col("p.my").alias("ty"),
        )
    moments = {"n": F.count(F.lit(1)).cast("double"), **{f"m_{c}": F.avg(c) for c in ("x", "y", "mx", "my")}}
    for one, two in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "mx"), ("y", "mx"), ("x", "my"), ("y", "my")):
        moments[f"v_{one}_{two}"] = F.covar_pop(one, two)
    rows = pairs.groupBy(group).agg(*[v.alias(k) for k, v in moments.items()])
    vxx, vxy, vyy = F.col("v_x_x"), F.col("v_x_y"), F.col("v_y_y")
    rows = rows.withColumns({"det": vxx * vyy - vxy * vxy, "trace": vxx + vyy})
    # rank is judged on the moments about the mean, relative to the spread
    flat = F.col("det") <= 1e-12 * F.col("trace") * F.col("trace")
    # direction of the line that a flat group lies on; none for a single point
    some = F.col("trace") > 0
    ux = F.when(some, F.sqrt(F.greatest(vxx, F.lit(0.0)) / F.col("trace"))).otherwise(0.0)
    uy = F.when(some, F.when(vxy < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(vyy, F.lit(0.0)) / F.col("trace"))).otherwise(0.0)
    rows = rows.withColumns({"flat": flat, "ux": ux, "uy": uy})
    along = F.col("ux") * F.col("m_x") + F.col("uy") * F.col("m_y")
    across = F.col("m_x") * F.col("uy") - F.col("m_y") * F.col("ux")
    # the part of the mean across the line; all of it for a single point
    qx = F.when(some, across * F.col("uy")).otherwise(F.col("m_x"))
    qy = F.when(some, -across * F.col("ux")).otherwise(F.col("m_y"))

    def solve(m: str) -> tuple[Column, Column, Column]:
        px, py, mean = F.col(f"v_x_{m}"), F.col(f"v_y_{m}"), F.col(f"m_{m}")
        kx, ky = (px * vyy - py * vxy) / F.col("det"), (py * vxx - px * vxy) / F.col("det")
        # minimum norm: the slope along the line, and the rest along the part of the mean across it
        k = F.when(some, (F.col("ux") * px + F.col("uy") * py) / F.col("trace")).otherwise(0.0)
        c = (mean - k * along) / (qx * qx + qy * qy + 1.0)
        low = [k * F.col("ux") + c * qx, k * F.col("uy") + c * qy, c]
        full = [kx, ky, mean - kx * F.col("m_x") - ky * F.col("m_y")]
        return tuple(F.when(F.col("flat"), x).otherwise(y) for x, y in zip(low, full))

    (a, c, tx), (b, d, ty) = solve("mx"), solve("my")
    solved = rows.select(group, "flat", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), tx.alias("tx"), ty.alias("ty"))
    dx, dy = 100.0 * (F.col("a") + F.col("c")), 100.0 * (F.col("b") + F.col("d"))
    lost = F.col("flat") & (F.hypot(dx, dy) <= 1e-4)
    plain = {"a": F.lit(1.0), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(1.0), "tx": F.col("tx") + dx / 2, "ty": F.col("ty") + dy / 2}
    return solved.select(group, *[F.when(lost, v).otherwise(F.col(n)).alias(n) for n, v in plain.items()])


def two_point_alignment(
    pairs: DataFrame,
    group: str,
    order: str,
    inverts: tuple[float, float] = (1.0, 1.0),
    beam_offset: tuple[float, float] = (0.0, 0.0),
    target_angle: float = 0.0,
) -> DataFrame:
    """Angle error and origin of each group from its first two design / measured pairs.

    The two pairs come from min_by aggregates (smallest and second smallest ``order``), which
    combine before the shuffle.
    """
    ix, iy = inverts
    point = F.struct("x", "y", "mx", "my")
    first = pairs.groupBy(group).agg(F.min(order).alias("__o"), F.min_by(point, order).alias("p"))
    second = (
        pairs.join(first.select(group, "__o"), group)
        .filter(F.col(order) > F.col("__o"))
        .groupBy(group)
        .agg(F.min_by(point, order).alias("q"))
    )
    rows = first.join(second, group)
    expected = g.angle("p.x", "p.y", "q.x", "q.y") + target_angle
    actual = F.atan2(
        iy * (F.col("q.my") - F.col("p.my")) + 0.0, ix * (F.col("q.mx") - F.col("p.mx")) + 0.0
    )
    rows = rows.withColumn("angle", actual - expected)
    cos, sin = F.cos("angle"), F.sin("angle")

    def origin(s: str) -> tuple[Column, Column]:
        x, y = F.col(f"{s}.x"), F.col(f"{s}.y")
        return (
            F.col(f"{s}.mx") - ix * (x * cos - y * sin),
            F.col(f"{s}.my") - iy * (x * sin + y * cos),
        )

    (px, py), (qx, qy) = origin("p"), origin("q")
    return rows.select(
        group,
        "angle",
        ((px + qx) / 2).alias("origin_x"),
        ((py + qy) / 2).alias("origin_y"),
        ((px + qx) / 2 + beam_offset[0]).alias("beam_x"),
        ((py + qy) / 2 + beam_offset[1]).alias("beam_y"),
    )


def stage_position(x, y, angle, origin_x, origin_y, inverts=(1.0, 1.0)) -> tuple[Column, Column]:
    """Stage coordinates of a design point."""
    x, y, a = g.col(x), g.col(y), g.col(angle)
    ix, iy = inverts
    return (
        g.col(origin_x) + ix * (x * F.cos(a) - y * F.sin(a)),
        g.col(origin_y) + iy * (x * F.sin(a) + y * F.cos(a)),
    )


def to_stage(
    points: DataFrame,
    alignment: DataFrame | None,
    key: str | None,
    *,
    angle: float = 0.0,
    origin: tuple[float, float] = (0.0, 0.0),
    inverts: tuple[float, float] = (1.0, 1.0),
    stage: tuple[float, float, float, float] = (-math.inf, -math.inf, math.inf, math.inf),
    scanner: tuple[float, float, float, float] = (-math.inf, -math.inf, math.inf, math.inf),
) -> DataFrame:
    """Design points -> stage position clamped to the stage limits, the rest as scanner offset.

    ``alignment`` holds angle, beam_x, beam_y per ``key``; without it one fixed alignment is
    used. ``in_bounds`` tells whether the scanner can reach the rest.
    """
    if alignment is None:
        rows, a, ox, oy = points, F.lit(float(angle)), F.lit(float(origin[0])), F.lit(float(origin[1]))
    else:
        rows = points.join(alignment.select(key, "angle", "beam_x", "beam_y"), key)
        a, ox, oy = F.col("angle"), F.col("beam_x"), F.col("beam_y")
    tx, ty = stage_position("x", "y", a, ox, oy, inverts)
    rows = rows.withColumns({"target_x": tx, "target_y": ty})
    sx = F.greatest(F.lit(float(stage[0])), F.least(F.col("target_x"), F.lit(float(stage[2]))))
    sy = F.greatest(F.lit(float(stage[1])), F.least(F.col("target_y"), F.lit(float(stage[3]))))
    rows = rows.withColumns({"stage_x": sx, "stage_y": sy})
    rows = rows.withColumns(
        {"scan_x": F.col("stage_x") - F.col("target_x"), "scan_y": F.col("stage_y") - F.col("target_y")}
    )
    inside = F.col("scan_x").between(scanner[0], scanner[2]) & F.col("scan_y").between(scanner[1], scanner[3])
    return rows.withColumn("in_bounds", inside)


def machine_coordinates(
    points: DataFrame, cad_origin: tuple[float, float], angle: Column | float, beam_x, beam_y, inverts=(1.0, 1.0)
) -> DataFrame:
    """Design points -> machine coordinates: move to the origin, rotate, move to the beam, invert."""
    move = affine.combine(
        affine.translate(-cad_origin[0], -cad_origin[1]), affine.rotate(angle), affine.translate(g.col(beam_x), g.col(beam_y))
    )
    x, y = move.apply("x", "y")
    return points.withColumns({"machine_x": inverts[0] * x, "machine_y": inverts[1] * y})


def map_geometries(geoms: DataFrame, fn, schema=None) -> DataFrame:
    """Apply a user function to every geometry.

    Without ``schema``, ``fn`` maps a DataFrame to a DataFrame with Column expressions. With
    it, ``fn`` maps a pandas frame to a pandas frame and runs on Arrow batches.
    """
    if schema is None:
        return geoms.transform(fn)

    def batches(frames):
        for frame in frames:
            yield fn(frame)

    return geoms.mapInPandas(batches, schema)


def concat_geometries(*tables: DataFrame) -> DataFrame:
    """One table from several; columns a kind does not have are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def of_kind(geoms: DataFrame, *kinds: str) -> DataFrame:
    """Rows of the given kinds."""
    return geoms.filter(F.col("kind").isin(*kinds))


def is_region(kind: Column | str) -> Column:
    """Kinds that bound an area."""
    return g.col(kind).isin("path", "circle", "box", "ellipse")
