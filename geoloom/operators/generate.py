"""Row generators: tessellation, arrays, tiles, hatch lines, and path <-> segment forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import affine
from geoloom.functions import geometry as g
from geoloom.plans.scan import CHUNK_ROWS, chunk_of, chunked_fold, ordered_scan


def steps(n: Column | int, first: int = 0) -> Column:
    """One row per integer first..n."""
    stop = F.lit(n) if isinstance(n, int) else n
    return F.explode(F.sequence(F.lit(first).cast("bigint"), stop.cast("bigint")))


def curve_point(at: Column) -> tuple[Column, Column]:
    """Point at fraction ``at`` of a circle or arc row."""
    circle = F.col("kind") == "circle"
    a = F.when(circle, at * g.TWO_PI).otherwise(F.col("a0") + at * g.sweep("a0", "a1"))
    return g.polar("cx", "cy", "r", a)


def tessellate_arcs(curves: DataFrame, facets: int = 32) -> DataFrame:
    """facets + 1 points along every circle and arc."""
    facets = max(int(facets), 8)
    rows = curves.withColumn("i", steps(facets))
    x, y = curve_point(F.col("i") / float(facets))
    return rows.select("id", "i", x.alias("x"), y.alias("y"))


def tessellate_ellipse(ellipses: DataFrame, points: int = 32) -> DataFrame:
    """Points from start to end angle on the two semi-axes ra, rb."""
    rows = ellipses.withColumn("i", steps(points - 1))
    a = F.col("a0") + (F.col("a1") - F.col("a0")) * F.col("i") / float(points - 1)
    x = F.col("cx") + F.col("ra") * F.cos(a)
    y = F.col("cy") + F.col("rb") * F.sin(a)
    return rows.select("id", "i", x.alias("x"), y.alias("y"))


def ellipse_axes(ref_x, ref_y, cx, cy, ref_angle) -> tuple[Column, Column]:
    """Semi-axes of an ellipse that passes through a reference point at a known angle."""
    ra = g.ratio(g.col(ref_x) - g.col(cx), F.cos(g.col(ref_angle)))
    rb = g.ratio(g.col(ref_y) - g.col(cy), F.sin(g.col(ref_angle)))
    return ra, rb


def _blend(weights: list[Column], names: list[str]) -> Column:
    out = weights[0] * F.col(names[0])
    for w, n in zip(weights[1:], names[1:]):
        out = out + w * F.col(n)
    return out


def tessellate_bezier(curves: DataFrame, degree: int = 3, points: int = 8) -> DataFrame:
    """Sample quadratic or cubic curves. Control points are x0, y0 .. x{degree}, y{degree}."""
    rows = curves.withColumn("i", steps(points - 1)).withColumn("t", F.col("i") / float(points - 1))
    t, s = F.col("t"), 1.0 - F.col("t")
    weights = {2: [s * s, 2.0 * s * t, t * t], 3: [s * s * s, 3.0 * s * s * t, 3.0 * s * t * t, t * t * t]}[degree]
    return rows.select(
        "id",
        "i",
        _blend(weights, [f"x{k}" for k in range(degree + 1)]).alias("x"),
        _blend(weights, [f"y{k}" for k in range(degree + 1)]).alias("y"),
    )


def _basis(k: Column) -> Column:
    """The degree + 1 B-spline basis values that are not zero at ``u`` in the knot span that starts at knot ``k``."""
    knots, u = F.col("knots"), F.col("u")

    def share(top: Column, bottom: Column, value: Column) -> Column:
        return F.coalesce(F.when(bottom != 0.0, top / bottom * value), F.lit(0.0))

    def raised(low: Column, p: Column) -> Column:
        def value(j: Column) -> Column:
            a, b = F.get(knots, k - p + j), F.get(knots, k + j)
            c, d = F.get(knots, k - p + j + 1), F.get(knots, k + j + 1)
            return share(u - a, b - a, F.get(low, j - 1)) + share(d - u, d - c, F.get(low, j))

        return F.transform(F.sequence(F.lit(0), p), value)

    one = F.array(F.lit(1.0))
    return F.when(F.col("degree") < 1, one).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("degree")), one, raised))


def tessellate_spline(
    splines: DataFrame, samples: Column | None = None, closed: bool = False, periodic: bool = False
) -> DataFrame:
    """Sample B-splines (degree, knots, ctrl) of any degree: 3 points per control point by default.

    Only the degree + 1 control points that act on a sample are weighed. An open spline ends on its
    last control point, a closed one is sampled all round.
    """
    n = (samples if samples is not None else F.size("ctrl") * 3).cast("bigint")
    inner = n if closed else n - 1
    knots = F.col("knots")
    lo, hi = F.get(knots, F.lit(0)), F.get(knots, F.size(knots) - 1)
    if closed and periodic:
        lo, hi = F.get(knots, F.col("degree")), F.get(knots, F.size(knots) - F.col("degree") - 1)
    rows = splines.withColumn("i", steps(inner - 1)).withColumn("u", lo + (hi - lo) / inner * F.col("i"))
    span = F.size(F.filter(knots, lambda t: t <= F.col("u"))) - 1
    rows = rows.withColumn("degree", F.col("degree").cast("int")).withColumn("k", span)
    rows = rows.withColumn("n", _basis(F.col("k")))
    rows = rows.withColumn("near", F.transform("n", lambda w, j: F.get("ctrl", F.col("k") - F.col("degree") + j)))

    def summed(value) -> Column:
        each = F.zip_with("n", "near", lambda w, p: F.when(p.isNotNull(), value(w, p)).otherwise(F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v)

    total = summed(lambda w, p: w)
    out = rows.select(
        "id",
        "i",
        F.coalesce(g.ratio(summed(lambda w, p: w * p["x"]), total), F.lit(0.0)).alias("x"),
        F.coalesce(g.ratio(summed(lambda w, p: w * p["y"]), total), F.lit(0.0)).alias("y"),
    )
    if closed:
        return out
    last = splines.select("id", (n - 1).alias("i"), F.element_at("ctrl", -1).alias("p"))
    return out.unionByName(last.select("id", "i", "p.x", "p.y"))


def arcs_from_bulge(arcs: DataFrame) -> DataFrame:
    """Arcs given as two points and a bulge -> centre, radius, angles, sweep."""
    half = g.length("x1", "y1", "x2", "y2") / 2
    b = F.col("bulge")
    r = half * (b * b + 1) / (2 * b)
    to_centre = g.angle("x1", "y1", "x2", "y2") + F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half / r)))
    rows = arcs.filter((b != 0) & (half > 0)).withColumns(
        {"cx": F.col("x1") + r * F.cos(to_centre), "cy": F.col("y1") + r * F.sin(to_centre), "r": F.abs(r)}
    )
    start, end = g.angle("cx", "cy", "x1", "y1"), g.angle("cx", "cy", "x2", "y2")
    rows = rows.withColumns(
        {"a0": F.when(b < 0, end).otherwise(start), "a1": F.when(b < 0, start).otherwise(end)}
    )
    return rows.withColumn("sweep", g.sweep("a0", "a1"))


def arcs_from_points(arcs: DataFrame) -> DataFrame:
    """Arcs given as a centre and two points -> radius, angles, sweep."""
    rows = arcs.withColumns(
        {
            "r": g.length("cx", "cy", "x1", "y1"),
            "a0": g.angle("cx", "cy", "x1", "y1"),
            "a1": g.angle("cx", "cy", "x2", "y2"),
        }
    )
    return rows.withColumn("sweep", g.sweep("a0", "a1"))


def shape_point(shapes: DataFrame, at: Column) -> tuple[Column, Column]:
    """Point at fraction ``at`` of each row, by its ``kind``: line (also where there is no kind), circle, arc, ellipse, bezier2, bezier3.

    Beziers have control points x0, y0 .. x3, y3; an ellipse runs from a0 to a1 on the semi-axes ra and
    rb. Kinds whose columns the table lacks do not occur in it.
    """
    names = set(shapes.columns)
    kinds: list[tuple[str, tuple[Column, Column]]] = []
    if {"cx", "cy", "r", "a0", "a1"} <= names and "kind" in names:
        kinds += [("circle", curve_point(at)), ("arc", curve_point(at))]
    if {"cx", "cy", "ra", "rb", "a0", "a1"} <= names:
        a = F.col("a0") + (F.col("a1") - F.col("a0")) * at
        kinds.append(("ellipse", (F.col("cx") + F.col("ra") * F.cos(a), F.col("cy") + F.col("rb") * F.sin(a))))
    s = 1.0 - at
    for degree, weights in ((2, [s * s, 2.0 * s * at, at * at]), (3, [s * s * s, 3.0 * s * s * at, 3.0 * s * at * at, at * at * at])):
        if {f"{c}{k}" for c in "xy" for k in range(degree + 1)} <= names:
            kinds.append((f"bezier{degree}", tuple(_blend(weights, [f"{c}{k}" for k in range(degree + 1)]) for c in "xy")))
    line = (g.mix("x1", "x2", at), g.mix("y1", "y2", at)) if {"x1", "y1", "x2", "y2"} <= names else None
    out = line if line and "kind" not in names else tuple(F.when(F.col("kind") == "line", v) for v in line) if line else (F.lit(None), F.lit(None))
    for kind, point in kinds:
        out = tuple(F.when(F.col("kind") == kind, p).otherwise(o) for p, o in zip(point, out))
    return out


def points_along(shapes: DataFrame, n: int) -> DataFrame:
    """n evenly spaced points on every shape (see ``shape_point``), both ends included."""
    rows = shapes.withColumn("i", steps(n - 1))
    x, y = shape_point(shapes, F.col("i") / float(n - 1))
    return rows.select("id", *(["kind"] if "kind" in shapes.columns else []), "i", x.alias("x"), y.alias("y"))


def points_along_paths(measured: DataFrame, n: int) -> DataFrame:
    """n points evenly spaced along every path; ``measured`` is the result of ``measured_path_segments``.

    Each segment lists the points that fall on it. A point at a joint comes from the earlier segment.
    """
    total = measured.groupBy("path_id").agg(F.max("len_to").alias("total"))
    rows = measured.join(total, "path_id").filter("total > 0")
    unit = F.col("total") / (n - 1)
    low = F.greatest(F.ceil(F.col("len_from") / unit - 1e-9), F.lit(0))
    high = F.least(F.floor(F.col("len_to") / unit + 1e-9), F.lit(n - 1))
    rows = rows.withColumn("i", F.explode(F.when(low <= high, F.sequence(low, high))))
    t = F.coalesce(g.ratio(F.col("i") * unit - F.col("len_from"), F.col("len")), F.lit(0.0))
    points = rows.select("path_id", "i", "seq", g.mix("x1", "x2", t).alias("x"), g.mix("y1", "y2", t).alias("y"))
    return points.groupBy("path_id", "i").agg(F.min_by("x", "seq").alias("x"), F.min_by("y", "seq").alias("y"))


def split_even(shapes: DataFrame, n: int) -> DataFrame:
    """Split every shape (see ``shape_point``) into n chords."""
    rows = shapes.withColumn("i", steps(n - 1))
    x1, y1 = shape_point(shapes, F.col("i") / float(n))
    x2, y2 = shape_point(shapes, (F.col("i") + 1) / float(n))
    return rows.select("id", "i", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def path_to_segments(vertices: DataFrame, keep_chunk: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Consecutive vertices -> segments (path_id, seq, x1, y1, x2, y2); seq is the first vertex's."""
    rows = vertices.withColumn("chunk", chunk_of("seq", chunk_rows))
    rows = ordered_scan(rows, ["path_id"], ["seq"], "chunk", lead={"next": F.struct("x", "y")})
    return rows.filter("next IS NOT NULL").select(
        "path_id",
        "seq",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("next.x").alias("x2"),
        F.col("next.y").alias("y2"),
        *(["chunk"] if keep_chunk else []),
    )


def segments_to_path(segments: DataFrame, tol: float = 0.0, rows: int = 4096) -> DataFrame:
    """Ordered segments (path_id, seq, ...) -> path vertices (path_id, seq, x, y), in the long form.

    A point no farther than ``tol`` from the last kept one is dropped (:func:`joined_points`); seq grows along
    the path, with gaps.
    """
    ends = segments.select(
        "path_id",
        F.inline(
            F.array(
                F.struct((F.col("seq") * 2).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y")),
                F.struct((F.col("seq") * 2 + 1).alias("seq"), F.col("x2").alias("x"), F.col("y2").alias("y")),
            )
        ),
    )
    return joined_points(ends, tol, rows)


def joined_points(points: DataFrame, tol: float = 0.0, rows: int = 4096) -> DataFrame:
    """Path points (path_id, seq, x, y) without those no farther than ``tol`` from the last kept point before them.

    Without a tolerance a point is compared with its neighbour, by a scan; with one, what is kept depends on what was
    kept before, so the points go through a fold in chunks.
    """
    if tol <= 0:
        kept = ordered_scan(points, ["path_id"], ["seq"], chunk_of("seq"), lag={"before": F.struct("x", "y")})
        kept = kept.filter(F.col("before").isNull() | (F.col("before") != F.struct("x", "y")))
        return kept.select("path_id", "seq", "x", "y")
    empty = F.array().cast("array<struct<seq:bigint,x:double,y:double>>")

    def start(head: Column) -> Column:
        return F.struct(head["x"].alias("x"), head["y"].alias("y"), empty.alias("out"))

    def step(s: Column, v: Column, before: Column) -> Column:
        far = before.isNull() | (F.hypot(v["x"] - s["x"], v["y"] - s["y"]) > tol)
        return F.struct(
            F.when(far, v["x"]).otherwise(s["x"]).alias("x"), F.when(far, v["y"]).otherwise(s["y"]).alias("y"),
            F.when(far, F.array_append(s["out"], v)).otherwise(s["out"]).alias("out"),
        )

    items = points.select("path_id", F.col("seq").cast("bigint").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    folded = chunked_fold(items, ["path_id"], "seq", F.struct("seq", "x", "y"), start, step, rows=rows)
    return folded.select("path_id", F.inline("out"))


def _tips(paths: DataFrame) -> DataFrame:
    """First and last point of each path."""
    first, last = F.min_by(F.struct("x", "y"), "seq"), F.max_by(F.struct("x", "y"), "seq")
    return paths.groupBy("path_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), first.alias("head"), last.alias("tail"))


def merge_paths(paths: DataFrame, others: DataFrame, tol: float = 0.0) -> DataFrame:
    """Paths followed by the other path of the same path_id; its first point goes if it lies within ``tol`` of the end."""
    ends = _tips(paths).select("path_id", "hi", "tail").join(_tips(others).select("path_id", "lo", "head"), "path_id", "full")
    near = F.hypot(F.col("head.x") - F.col("tail.x"), F.col("head.y") - F.col("tail.y")) <= tol
    rows = others.join(ends, "path_id")
    rows = rows.where(~(F.coalesce(near, F.lit(False)) & (F.col("seq") == F.col("lo"))))
    moved = F.when(F.col("hi").isNull(), F.col("seq")).otherwise(F.col("hi") + 1 + F.col("seq") - F.col("lo"))
    return paths.select("path_id", "seq", "x", "y").unionByName(rows.select("path_id", moved.alias("seq"), "x", "y"))


def append_points(paths: DataFrame, points: DataFrame, tol: float = 0.0, prepend: bool = False) -> DataFrame:
    """Paths lengthened by points (path_id, seq, x, y) at their end, or with ``prepend`` at their start, from the nearest
    point outwards; a point within ``tol`` of the path's tip of that moment is left out."""
    sign = -1 if prepend else 1
    tips = _tips(paths)
    near, far = ("lo", "head") if prepend else ("hi", "tail")
    bounds = points.groupBy("path_id").agg((F.max("seq") if prepend else F.min("seq")).alias("first"))
    base = tips.select("path_id", F.col(near).alias("base"), F.col(far).alias("tip"))
    rows = points.join(bounds, "path_id").join(base, "path_id", "left")
    # counted from 1 outwards; the tip of the path itself is point 0
    outward = rows.select("path_id", ((F.col("seq") - F.col("first")) * sign + 1).alias("seq"), "x", "y")
    start = base.join(bounds, "path_id", "left_semi").select("path_id", F.lit(0).cast("bigint").alias("seq"), "tip.x", "tip.y")
    kept = joined_points(outward.unionByName(start), tol).where("seq > 0").join(base, "path_id", "left")
    added = kept.select("path_id", (F.coalesce("base", F.lit(0)) + F.col("seq") * sign).alias("seq"), "x", "y")
    return paths.select("path_id", "seq", "x", "y").unionByName(added)


def pack_paths(vertices: DataFrame) -> DataFrame:
    """Path vertices -> one row per path with its points as an array; each path must fit a row."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"], p["y"]))
    return vertices.groupBy("path_id").agg(points.alias("points"))


def box_polygon(boxes: DataFrame) -> DataFrame:
    """Closed 5-point ring of every box: (id, seq, x, y)."""
    ring = [("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y"), ("min_x", "min_y")]
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ring])
    return boxes.select("id", F.posexplode(points).alias("seq", "p")).select(
        "id", F.col("seq").cast("bigint").alias("seq"), "p.x", "p.y"
    )


def box_edges(boxes: DataFrame) -> DataFrame:
    """The four edges of every box: (id, seq, x1, y1, x2, y2); no shuffle."""
    x0, y0, x1, y1 = "min_x", "min_y", "max_x", "max_y"
    ring = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    edges = F.array(
        *[F.struct(*[F.col(c).alias(n) for c, n in zip(e, ("x1", "y1", "x2", "y2"))]) for e in ring]
    )
    return boxes.select("id", F.posexplode(edges).alias("seq", "e")).select(
        "id", F.col("seq").cast("bigint").alias("seq"), "e.*"
    )


def grid_array(nodes: DataFrame, style: str = "raster") -> DataFrame:
    """num_x by num_y (by num_z) offset copies of each row, with an ``ord`` column.

    ``raster`` runs column by column, ``serpentine`` row by row with odd rows reversed.
    """
    nx, ny = F.col("num_x"), F.col("num_y")
    deep = "num_z" in nodes.columns
    rows = nodes.withColumn("ix", steps(nx - 1)).withColumn("iy", steps(ny - 1))
    rows = rows.filter((nx > 0) & (ny > 0))
    x, y = F.col("ix"), F.col("iy")
    if style == "raster":
        order = x * ny + y
    elif style == "serpentine":
        order = y * nx + F.when(y % 2 == 1, nx - 1 - x).otherwise(x)
    else:
        raise ValueError(f"unknown style {style!r}")
    rows = rows.withColumns(
        {"copy_x": F.col("off_x") + x * F.col("pitch_x"), "copy_y": F.col("off_y") + y * F.col("pitch_y")}
    )
    if deep:
        rows = rows.withColumn("iz", steps(F.col("num_z") - 1))
        rows = rows.withColumn("copy_z", F.col("off_z") + F.col("iz") * F.col("pitch_z"))
        return rows.withColumn("ord", order * F.col("num_z") + F.col("iz"))
    return rows.withColumn("ord", order)


def spiral_array(nodes: DataFrame, start: str = "bottom_left", clockwise: bool = True) -> DataFrame:
    """Inward spiral order over the num_x by num_y copies of each row, in closed form.

    The start corner is moved to (0, 0) by flipping axes. Ring k starts after the cells outside
    it, and a cell's place on its ring follows from which of the four sides it lies on.
    """
    nx, ny = F.col("num_x"), F.col("num_y")
    right, top = start.endswith("right"), start.startswith("top")
    x_first = clockwise == (right != top)
    rows = nodes.withColumn("ix", steps(nx - 1)).withColumn("iy", steps(ny - 1))
    x = nx - 1 - F.col("ix") if right else F.col("ix")
    y = ny - 1 - F.col("iy") if top else F.col("iy")
    # (a, na): the axis walked first; (b, nb): the other one
    a, b, na, nb = (x, y, nx, ny) if x_first else (y, x, ny, nx)
    ring = F.least(a, b, na - 1 - a, nb - 1 - b)
    w, h = na - 2 * ring, nb - 2 * ring
    u, v = a - ring, b - ring
    place = (
        F.when(v == 0, u)
        .when(u == w - 1, w - 1 + v)
        .when(v == h - 1, w - 1 + h - 1 + w - 1 - u)
        .otherwise(2 * (w - 1) + h - 1 + h - 1 - v)
    )
    return rows.withColumns(
        {
            "copy_x": F.col("off_x") + F.col("ix") * F.col("pitch_x"),
            "copy_y": F.col("off_y") + F.col("iy") * F.col("pitch_y"),
            "ord": na * nb - w * h + place,
        }
    )


def grid_shape(ext: DataFrame, size_x: float, size_y: float, pad_x=0.0, pad_y=0.0, shift_x=0.0, shift_y=0.0) -> DataFrame:
    """Tile counts and lower corner of the tiling that covers padded extents, centred on them."""
    nx = F.ceil((F.col("max_x") - F.col("min_x") + pad_x) / size_x)
    ny = F.ceil((F.col("max_y") - F.col("min_y") + pad_y) / size_y)
    mid_x, mid_y = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    return ext.withColumns(
        {
            "nx": nx,
            "ny": ny,
            "grid_x": mid_x - nx * size_x / 2 + shift_x,
            "grid_y": mid_y - ny * size_y / 2 + shift_y,
        }
    )


def tile_grid(ext: DataFrame, size_x: float, size_y: float, pad_x=0.0, pad_y=0.0, shift_x=0.0, shift_y=0.0) -> DataFrame:
    """Equal tiles over each extents row (min_x .. max_y), numbered row by row."""
    keep = [c for c in ext.columns if c not in ("min_x", "min_y", "max_x", "max_y")]
    shape = grid_shape(ext, size_x, size_y, pad_x, pad_y, shift_x, shift_y).filter("nx > 0 AND ny > 0")
    cells = shape.withColumn("row", steps(F.col("ny") - 1)).withColumn("col", steps(F.col("nx") - 1))
    x0 = F.col("grid_x") + F.col("col") * size_x
    y0 = F.col("grid_y") + F.col("row") * size_y
    return cells.select(
        *keep,
        (F.col("row") * F.col("nx") + F.col("col")).alias("tile"),
        "row",
        "col",
        x0.alias("min_x"),
        y0.alias("min_y"),
        (x0 + size_x).alias("max_x"),
        (y0 + size_y).alias("max_y"),
    )


def hatch_lines(ext: DataFrame, pitch: float, angle_deg: float = 0.0, style: str = "raster") -> DataFrame:
    """Parallel lines at a pitch and angle across each extents row.

    ``serpentine`` turns every second line round; ``*_grid`` appends the same lines again,
    turned by 90 degrees and in reverse order.
    """
    import math

    if style not in ("raster", "serpentine", "raster_grid", "serpentine_grid"):
        raise ValueError(f"unknown style {style!r}")
    keep = [c for c in ext.columns if c not in ("min_x", "min_y", "max_x", "max_y")]
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    size = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    rows = ext.select(*keep, cx.alias("cx"), cy.alias("cy"), size.alias("size"))
    rows = rows.withColumn("n", F.ceil(F.col("size") / pitch)).filter("n > 0").withColumn("k", steps(F.col("n") - 1))
    away = F.col("size")
    if style.startswith("serpentine"):
        away = F.when(F.col("k") % 2 == 1, -away).otherwise(away)
    y = -F.col("size") / 2 + F.col("k") * pitch

    def placed(degrees: float, order: Column) -> DataFrame:
        turned = affine.rotate(math.radians(degrees)).then(affine.translate(F.col("cx"), F.col("cy")))
        x1, y1 = turned.apply(-away, y)
        x2, y2 = turned.apply(away, y)
        return rows.select(
            *keep, order.alias("k"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")
        )

    out = placed(angle_deg, F.col("k"))
    if style.endswith("_grid"):
        out = out.unionByName(placed(angle_deg + 90.0, 2 * F.col("n") - 1 - F.col("k")))
    return out


def interleave(items: DataFrame, list_col: str, order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Round-robin merge: rank of each item in its list, then position over all lists.

    ``rn`` is the rank in the list; sorting by (rn, list) gives the merged order.
    """
    return ordered_scan(items, [list_col], [order], chunk_of(order, chunk_rows), index="rn")
