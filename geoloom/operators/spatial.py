"""Spatial joins: crossings, containment, clipping, and the tilings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as g
from geoloom.operators.generate import box_edges, grid_shape, tile_grid
from geoloom.plans.cells import Box, Line, cell_join, point_box
from geoloom.plans.scan import CHUNK_ROWS, chunk_of, ordered_scan, written_scan
from geoloom.plans.sweep import nests
from geoloom.plans.scratch import growing, materialize

SEG = ("x1", "y1", "x2", "y2")
BOX = ("min_x", "min_y", "max_x", "max_y")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


# ---- segments with segments -------------------------------------------------------------


def _crossing(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    """Parameters and point where two segments cross; parallel segments never do."""
    ax1, ay1, ax2, ay2 = (F.col(c) for c in a)
    bx1, by1, bx2, by2 = (F.col(c) for c in b)
    dx, dy, ex, ey = ax2 - ax1, ay2 - ay1, bx2 - bx1, by2 - by1
    det = dx * ey - dy * ex
    t = F.when(det != 0.0, ((bx1 - ax1) * ey - (by1 - ay1) * ex) / det)
    u = F.when(det != 0.0, ((bx1 - ax1) * dy - (by1 - ay1) * dx) / det)
    derive = {"t": t, "u": u, "x": ax1 + t * dx, "y": ay1 + t * dy}
    return derive, F.col("t").between(0.0, 1.0) & F.col("u").between(0.0, 1.0)


def crossings(a: DataFrame, b: DataFrame, *, pair: Column | None = None, cell: float | None = None, hot: int | None = None) -> DataFrame:
    """Crossing pairs of two segment tables whose columns start with a_ and b_.

    Adds t and u, the fractions along each segment, and the crossing point.
    """
    a_seg, b_seg = tuple("a_" + c for c in SEG), tuple("b_" + c for c in SEG)
    derive, keep = _crossing(a_seg, b_seg)
    if pair is not None:
        keep = keep & pair
    options = {"hot": hot} if hot else {}
    return cell_join(
        a, b, Line(*a_seg), Line(*b_seg), cell=cell, derive=derive, keep=keep, owner=(F.col("x"), F.col("y")), **options
    )


def _shapes(segments: DataFrame) -> DataFrame:
    """Each segment with its end points in a fixed order, so that copies look alike."""
    flip = F.struct("x2", "y2") < F.struct("x1", "y1")
    ends = {
        n: F.when(flip, F.col(o)).otherwise(F.col(n))
        for n, o in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))
    }
    return segments.select("id", *[c.alias(n) for n, c in ends.items()])


def segment_intersections(a: DataFrame, b: DataFrame | None = None, *, cell: float | None = None, hot: int | None = None) -> DataFrame:
    """All crossings (id_a, id_b, x, y) of two segment sets, or of one set with itself.

    Copies of a segment cross the same partners and never each other, so each distinct segment
    is joined once and the copies are put back on the finished pairs.
    """
    options = {"cell": cell, "hot": hot}
    left = _shapes(a)
    right = left if b is None else _shapes(b)

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*SEG).agg(F.min("id").alias("id"))

    order = (F.col("a_id") < F.col("b_id")) if b is None else None
    ua = materialize(distinct(left), "shapes")
    ub = ua if b is None else materialize(distinct(right), "shapes")
    found = crossings(_prefixed(ua, "a_"), _prefixed(ub, "b_"), pair=order, **options).select("a_id", "b_id", "x", "y")

    def members(rows: DataFrame, unique: DataFrame, tag: str) -> DataFrame:
        return rows.join(unique.withColumnRenamed("id", f"{tag}_id"), list(SEG)).select(
            f"{tag}_id", F.col("id").alias(f"id_{tag}")
        )

    full = found.join(members(left, ua, "a"), "a_id").join(members(right, ub, "b"), "b_id")
    if b is None:
        low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
        return full.select(low.alias("id_a"), high.alias("id_b"), "x", "y")
    return full.select("id_a", "id_b", "x", "y")


def line_query(lines: DataFrame, segments: DataFrame, cell: float | None = None) -> DataFrame:
    """Crossings of query lines with a large segment set, numbered along each line.

    Lines with very many hits are ranked in stretches of their length.
    """
    found = crossings(
        _prefixed(lines.select("line_id", *SEG), "a_"), _prefixed(segments.select("id", *SEG), "b_"), cell=cell
    )
    hits = found.select(F.col("a_line_id").alias("line_id"), F.col("b_id").alias("id"), "t", "x", "y")
    hits = materialize(hits, "hits")  # the join runs once; ranking reads its result twice
    return written_scan(hits, ["line_id"], ["t", "id"], F.col("t"), index="hit")


# ---- points -----------------------------------------------------------------------------


def points_on_segments(points: DataFrame, segments: DataFrame, resolution: float = 1e-3) -> DataFrame:
    """Points (p_ columns) lying on segments: the way over the point is no longer than allowed."""
    p = _prefixed(points, "p_")
    reach = float(resolution) + 1e-9
    s = _prefixed(segments, "s_").withColumns(
        {
            "__x0": F.least("s_x1", "s_x2") - reach, "__y0": F.least("s_y1", "s_y2") - reach,
            "__x1": F.greatest("s_x1", "s_x2") + reach, "__y1": F.greatest("s_y1", "s_y2") + reach,
        }
    )
    if "z" in points.columns and "z1" in segments.columns:
        def span(ax, ay, az, bx, by, bz):
            return g.length3(F.col(bx) - F.col(ax), F.col(by) - F.col(ay), F.col(bz) - F.col(az))

        over = (
            span("s_x1", "s_y1", "s_z1", "p_x", "p_y", "p_z") + span("p_x", "p_y", "p_z", "s_x2", "s_y2", "s_z2")
            - span("s_x1", "s_y1", "s_z1", "s_x2", "s_y2", "s_z2")
        )
    else:
        over = (
            g.length("s_x1", "s_y1", "p_x", "p_y") + g.length("p_x", "p_y", "s_x2", "s_y2")
            - g.length("s_x1", "s_y1", "s_x2", "s_y2")
        )
    pairs = cell_join(
        p, s, point_box("p_x", "p_y"), Box("__x0", "__y0", "__x1", "__y1"), keep=F.abs(over) <= resolution
    )
    return pairs.drop("__x0", "__y0", "__x1", "__y1")


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (p_) inside closed boxes (b_)."""
    return cell_join(
        _prefixed(points, "p_"), _prefixed(boxes, "b_"), point_box("p_x", "p_y"), Box(*["b_" + c for c in BOX])
    )


def ray_crosses(px, py, x1, y1, x2, y2) -> Column:
    """Whether a ray from the point towards +x meets the edge; half-open in y."""
    px, py, x1, y1, x2, y2 = (g.col(c) for c in (px, py, x1, y1, x2, y2))
    spans = (y1 > py) != (y2 > py)
    return spans & (px < x1 + (py - y1) / (y2 - y1) * (x2 - x1))


def point_in_polygon(points: DataFrame, edges: DataFrame, *, key: str = "id", band: float | None = None) -> DataFrame:
    """Pairs (point id, polygon id) by ray parity.

    First points meet polygon boxes on cells. Then each candidate meets only the edges of its
    polygon in its own y band, and crossings are counted per pair, so a polygon of any size is
    spread over its bands.
    """
    poly = edges.select(F.col(key).alias("poly"), *SEG)
    boxes = poly.groupBy("poly").agg(
        F.least(F.min("x1"), F.min("x2")).alias("min_x"),
        F.least(F.min("y1"), F.min("y2")).alias("min_y"),
        F.greatest(F.max("x1"), F.max("x2")).alias("max_x"),
        F.greatest(F.max("y1"), F.max("y2")).alias("max_y"),
    )
    near = cell_join(
        points.select(F.col("id").alias("point"), F.col("x").alias("px"), F.col("y").alias("py")),
        boxes, point_box("px", "py"), Box(*BOX),
    ).select("point", "px", "py", "poly")
    return _parity(near, poly, ["point", "poly"], band).select("point", "poly")


def _parity(near: DataFrame, poly: DataFrame, keys: list[str], band: float | None = None) -> DataFrame:
    """Rows of ``near`` (keys, poly, px, py) that lie inside their polygon."""
    if band is None:
        band = poly.select(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 1.0
    rising = poly.filter("y1 <> y2").select(
        "poly",
        *[F.col(c).alias("r_" + c) for c in SEG],
        F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))).alias("band"),
    )
    met = near.withColumn("band", F.floor(F.col("py") / band)).join(rising, ["poly", "band"])
    crossed = met.filter(ray_crosses("px", "py", "r_x1", "r_y1", "r_x2", "r_y2"))
    return crossed.groupBy(*keys).count().filter("count % 2 = 1").drop("count")


# ---- boxes ------------------------------------------------------------------------------


def segments_through_boxes(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pairs (s_id, b_id) where the segment runs through, ends in, or touches the box."""
    s, b = _prefixed(segments.select("id", *SEG), "s_"), _prefixed(boxes.select("id", *BOX), "b_")
    return _clipped(s, b, keep_touching=True).select("s_id", "b_id")


def _clip_range(s: tuple[str, ...], b: tuple[str, ...]) -> tuple[Column, Column]:
    """Fractions where a segment enters and leaves a box, one slab per axis."""
    x1, y1, x2, y2 = (F.col(c) for c in s)
    bx0, by0, bx1, by1 = (F.col(c) for c in b)

    def slab(p: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        ta, tb = (low - p) / d, (high - p) / d
        inside = (p >= low) & (p <= high)
        flat = d == 0.0
        return (
            F.when(flat, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(ta, tb)),
            F.when(flat, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(ta, tb)),
        )

    ex, lx = slab(x1, x2 - x1, bx0, bx1)
    ey, ly = slab(y1, y2 - y1, by0, by1)
    return F.greatest(F.lit(0.0), ex, ey), F.least(F.lit(1.0), lx, ly)


def _clipped(s: DataFrame, b: DataFrame, keep_touching: bool, cell: float | None = None) -> DataFrame:
    seg, box = tuple("s_" + c for c in SEG), tuple("b_" + c for c in BOX)
    t0, t1 = _clip_range(seg, box)
    dot = (F.col("s_x1") == F.col("s_x2")) & (F.col("s_y1") == F.col("s_y2"))
    keep = F.col("t0") <= F.col("t1")
    if not keep_touching:
        keep = (F.col("t0") < F.col("t1")) | (keep & dot)
    owner = (g.mix("s_x1", "s_x2", "t0"), g.mix("s_y1", "s_y2", "t0"))
    return cell_join(s, b, Line(*seg), Box(*box), cell=cell, derive={"t0": t0, "t1": t1}, keep=keep, owner=owner)


def clip_to_boxes(segments: DataFrame, boxes: DataFrame, key: str = "id", cell: float | None = None) -> DataFrame:
    """The part of each segment inside each box: (segment columns, box ``key``, clipped ends).

    A segment that only touches a box leaves no part. Curves are tessellated before.
    """
    b = _prefixed(boxes.select(key, *BOX), "b_")
    found = _clipped(_prefixed(segments, "s_"), b, keep_touching=False, cell=cell)
    rest = [c for c in segments.columns if c not in SEG]
    return found.select(
        *[F.col("s_" + c).alias(c) for c in rest],
        F.col("b_" + key).alias("box" if key == "id" else key),
        g.mix("s_x1", "s_x2", "t0").alias("x1"),
        g.mix("s_y1", "s_y2", "t0").alias("y1"),
        g.mix("s_x1", "s_x2", "t1").alias("x2"),
        g.mix("s_y1", "s_y2", "t1").alias("y2"),
        "t0",
        "t1",
    )


def clip_to_grid(
    segments: DataFrame, ext: DataFrame, size_x: float, size_y: float, groups: list[str], **grid: float
) -> DataFrame:
    """Clip segments to the tiles of a regular grid by arithmetic, without a join of pairs.

    ``ext`` has one row of extents per group. Each segment is listed in the tile columns it
    spans and, in each column, only in the rows its line meets there.
    """
    shape = grid_shape(ext, size_x, size_y, **grid).select(*groups, "nx", "ny", "grid_x", "grid_y")
    if groups:
        rows = segments.join(shape, groups)
    else:
        only = shape.first()  # one row of numbers
        rows = segments.withColumns({c: F.lit(only[c]) for c in shape.columns})
    pad = 1e-9
    x0, x1 = F.least("x1", "x2"), F.greatest("x1", "x2")

    def inside(lo: Column, hi: Column, n: str) -> Column:
        a, b = F.greatest(F.lit(0).cast("bigint"), lo), F.least(F.col(n) - 1, hi)
        return F.explode(F.when(a <= b, F.sequence(a, b)))

    def at(v: Column, origin: str, size: float, shift: float) -> Column:
        return F.floor((v - F.col(origin)) / size + shift)

    rows = rows.withColumn("col", inside(at(x0, "grid_x", size_x, -pad), at(x1, "grid_x", size_x, pad), "nx"))
    left = F.col("grid_x") + F.col("col") * size_x
    low, high = Line(*SEG).rows(left - size_x * pad, left + size_x * (1 + pad))
    rows = rows.withColumn("row", inside(at(low, "grid_y", size_y, -pad), at(high, "grid_y", size_y, pad), "ny"))
    bottom = F.col("grid_y") + F.col("row") * size_y
    rows = rows.withColumns({"min_x": left, "min_y": bottom, "max_x": left + size_x, "max_y": bottom + size_y})
    t0, t1 = _clip_range(SEG, BOX)
    dot = (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))
    rows = rows.withColumns({"t0": t0, "t1": t1}).filter((F.col("t0") < F.col("t1")) | ((F.col("t0") <= F.col("t1")) & dot))
    ends = {
        "x1": g.mix("x1", "x2", "t0"), "y1": g.mix("y1", "y2", "t0"),
        "x2": g.mix("x1", "x2", "t1"), "y2": g.mix("y1", "y2", "t1"),
    }
    return rows.withColumn("tile", F.col("row") * F.col("nx") + F.col("col")).withColumns(ends).drop("grid_x", "grid_y")


def box_contains(boxes: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of boxes where both corners of the inner lie in the outer."""
    return _contained(boxes, boxes)


def _contained(boxes: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of all boxes and those asked for."""
    outer = _prefixed(boxes.select("id", *BOX), "o_")
    inner = _prefixed(asked.select("id", *BOX), "i_")
    keep = (
        (F.col("o_min_x") <= F.col("i_min_x")) & (F.col("o_min_y") <= F.col("i_min_y"))
        & (F.col("o_max_x") >= F.col("i_max_x")) & (F.col("o_max_y") >= F.col("i_max_y"))
        & (F.col("o_id") != F.col("i_id"))
    )
    # a container overlaps the lower corner of what it contains, so points stand for the inner boxes
    found = cell_join(outer, inner, Box(*["o_" + c for c in BOX]), point_box("i_min_x", "i_min_y"), keep=keep)
    return found.select(F.col("o_id").alias("outer"), F.col("i_id").alias("inner"))


#: mean containers of a box above which nests are swept rather than joined
DEEP = 16


def _mean_depth(boxes: DataFrame, sample: int = 2000) -> float:
    """About how many containers a box has, from some boxes against all."""
    n = boxes.count()
    some = boxes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0)
    return _contained(boxes, some).count() / max(1, some.count())


def containment_tree(boxes: DataFrame, swept: bool | None = None) -> DataFrame:
    """Parent, depth and fill of every box; the smallest container is the parent.

    Equal boxes nest by id: the lower id is outside. Each distinct box is taken once and
    stands for its copies. Shallow boxes are joined with their containers. Where boxes have many, a sweep
    (:func:`nests`) finds parents and depths in n log n rows, and only boxes whose containers cross each other are
    joined. Both ways give the same rows; ``swept`` chooses one, else a count on some boxes does.
    """
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    ranked = ordered_scan(
        boxes.select("id", *BOX, area.alias("area")), list(BOX), ["id"], chunk_of("id"),
        index="copy", lag={"twin": F.col("id")},
    )
    ranked = materialize(ranked, "boxes")
    unique = materialize(
        ranked.groupBy(*BOX).agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")), "boxes"
    )
    asked = unique
    found = None
    if swept is None:
        swept = _mean_depth(unique) > DEEP
    if swept:
        sure = materialize(nests(unique.select("id", "n", *BOX)), "nests")
        last = unique.select(F.col("id").alias("outer"), F.col("last").alias("around"))
        found = sure.join(last, "outer", "left").select(F.col("id").alias("lead"), "around", "above")
        asked = materialize(unique.join(sure.select("id"), "id", "left_anti"), "crossed")
    weight = unique.select(F.col("id").alias("outer"), "last", "n", area.alias("outer_area"))
    inside = _contained(unique, asked).join(weight, "outer")
    # innermost copy of the smallest container; of equal areas the later id is nested deeper
    inside = materialize(inside.select(F.col("inner").alias("lead"), "outer", "last", "n", "outer_area"), "inside")
    least = inside.groupBy("lead").agg(F.min("outer_area").alias("outer_area"), F.sum("n").alias("above"))
    nearest = inside.join(least, ["lead", "outer_area"]).groupBy("lead").agg(
        F.max_by("last", "outer").alias("around"), F.max("above").alias("above")
    )
    if found is not None:
        nearest = nearest.unionByName(found)
    rows = ranked.join(unique.select(*BOX, F.col("id").alias("lead")), list(BOX)).join(nearest, "lead", "left")
    depth = F.coalesce("above", F.lit(0).cast("bigint")) + F.col("copy") - 1
    return rows.select(
        "id",
        F.coalesce("twin", "around").alias("parent_id"),
        depth.alias("depth"),
        F.when(depth % 2 == 0, "fg").otherwise("bg").alias("fill"),
        "area",
    )


# ---- tilings ----------------------------------------------------------------------------


def generate_tiles(
    segments: DataFrame, ext: DataFrame, size_x: float, size_y: float, groups: list[str], padding: float = 5.0,
    extension: float = 0.0,
) -> DataFrame:
    """Clip segments to the tiling of their extents and lengthen each part at both ends."""
    from geoloom.operators.measure import extend_segments

    parts = clip_to_grid(segments, ext, size_x, size_y, groups, pad_x=padding, pad_y=padding)
    return extend_segments(parts, extension) if extension else parts


def tile_knots(parts: DataFrame, knot: DataFrame, resolution: float = 1e-3) -> DataFrame:
    """A turned copy of the knot where a part's start or end lies on its tile's top or right edge.

    The outermost tiles get none. ``knot`` has columns knot_id, x1, y1, x2, y2 and its rows meet
    the ends by ``knot_id``, an ordinary equi-join; ``parts`` names the knot each end takes.
    """
    angle = g.angle(*SEG)
    end = [
        F.struct(F.lit(e).alias("tip"), F.col(x).alias("ex"), F.col(y).alias("ey"))
        for e, x, y in (("start", "x1", "y1"), ("end", "x2", "y2"))
    ]
    top = (F.col("row") != F.col("ny") - 1) & (F.abs(F.col("ey") - F.col("max_y")) <= resolution)
    right = (F.col("col") != F.col("nx") - 1) & (F.abs(F.col("ex") - F.col("max_x")) <= resolution)
    ends = parts.withColumn("angle", angle).select("*", F.inline(F.array(*end)))
    ends = ends.withColumn("edge", F.explode(F.array_compact(F.array(F.when(top, "top"), F.when(right, "right")))))
    k = knot.select("knot_id", *[F.col(c).alias("k_" + c) for c in SEG])
    cos, sin = F.cos("angle"), F.sin("angle")

    def placed(n: str) -> list[Column]:
        x, y = F.col(f"k_x{n}"), F.col(f"k_y{n}")
        return [
            (x * cos - y * sin + F.col("ex")).alias(f"x{n}"),
            (x * sin + y * cos + F.col("ey")).alias(f"y{n}"),
        ]

    return ends.join(k, "knot_id").select("id", "tile", "tip", "edge", "knot_id", *placed("1"), *placed("2"))


def stamp_pattern(anchors: DataFrame, pattern: DataFrame) -> DataFrame:
    """Copy the pattern named by each anchor to the anchor, turned by its ``angle`` if it has one.

    Anchors and pattern curves meet by ``pattern_id``; a hot pattern is an ordinary skewed key
    that AQE splits, and nothing is broadcast unless the optimizer finds it small.
    """
    turn = F.col("angle") if "angle" in anchors.columns else F.lit(0.0)
    a = anchors.select(F.col("id").alias("anchor"), "pattern_id", F.col("x").alias("ax"), F.col("y").alias("ay"), turn.alias("turn"))
    rows = a.join(pattern, "pattern_id")
    cos, sin = F.cos("turn"), F.sin("turn")
    is_arc = F.col("kind") == "arc"
    return rows.select(
        "anchor", "id", "kind",
        (F.col("cx") * cos - F.col("cy") * sin + F.col("ax")).alias("cx"),
        (F.col("cx") * sin + F.col("cy") * cos + F.col("ay")).alias("cy"),
        "r",
        F.when(is_arc, F.col("a0") + F.col("turn")).otherwise(F.col("a0")).alias("a0"),
        F.when(is_arc, F.col("a1") + F.col("turn")).otherwise(F.col("a1")).alias("a1"),
    )


# ---- splitting and boolean operations ---------------------------------------------------


def boundary_cuts(edges: DataFrame, cutters: DataFrame | None = None) -> DataFrame:
    """Cut marks (id, seq, other, t): where each edge is crossed by edges of other shapes.

    Without ``cutters`` the edges cut each other; every crossing is then found once and marks
    both edges.
    """
    a = _prefixed(edges.select("id", "seq", *SEG), "a_")
    b = _prefixed((cutters if cutters is not None else edges).select("id", "seq", *SEG), "b_")
    if cutters is not None:
        found = crossings(a, b, pair=F.col("a_id") != F.col("b_id"))
        return found.select(F.col("a_id").alias("id"), F.col("a_seq").alias("seq"), F.col("b_id").alias("other"), "t")
    found = crossings(a, b, pair=F.col("a_id") < F.col("b_id"))
    both = F.array(
        F.struct(F.col("a_id").alias("id"), F.col("a_seq").alias("seq"), F.col("b_id").alias("other"), F.col("t").alias("t")),
        F.struct(F.col("b_id").alias("id"), F.col("b_seq").alias("seq"), F.col("a_id").alias("other"), F.col("u").alias("t")),
    )
    return found.select(F.inline(both))


BASE_ROWS = 100_000  # edges of pairs in a task


def _pieces(base: DataFrame, cuts: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Stretches between successive cut marks of every row of ``base`` (keys, ends).

    Marks are put in order per edge; an edge with very many cuts is cut into stretches, so it is
    not gathered in one task. Equal marks combine before the shuffle.
    """
    marks = cuts.filter((F.col("t") > tol) & (F.col("t") < 1 - tol)).select(*keys, "t")
    marks = marks.unionByName(base.select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")))
    marks = marks.groupBy(*keys, F.floor(F.col("t") / 1e-9 + 0.5).alias("mark")).agg(F.min("t").alias("t"))
    marks = materialize(marks, "marks")
    runs = written_scan(marks, keys, ["mark"], F.col("mark") / 1e9, lead={"t1": F.col("t")})
    ends = {
        "x1": g.mix("x1", "x2", "t"), "y1": g.mix("y1", "y2", "t"),
        "x2": g.mix("x1", "x2", "t1"), "y2": g.mix("y1", "y2", "t1"),
    }
    return growing(runs.filter("t1 IS NOT NULL")).join(base, keys).withColumns(ends).drop("t1", "mark")


def _pieces_in_rows(base: DataFrame, cuts: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """What ``_pieces`` gives, for edges of few cuts each: the marks of an edge lie in its row, so edges are shuffled once."""
    marks = cuts.filter((F.col("t") > tol) & (F.col("t") < 1 - tol)).select(*keys, "t")
    marks = marks.groupBy(*keys, F.floor(F.col("t") / 1e-9 + 0.5).alias("mark")).agg(F.min("t").alias("t"))
    marks = marks.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("marks"))
    for name in keys:
        base = base.filter(F.col(name).isNotNull())
    inner = F.coalesce("marks", F.array().cast("array<double>"))
    rows = growing(base).join(marks, keys, "left").withColumn("marks", F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))))
    steps = F.transform(F.slice("marks", 2, F.size("marks") - 1), lambda t1, i: F.struct(F.get("marks", i).alias("t"), t1.alias("t1")))
    rows = rows.select(*keys, *SEG, F.inline(steps))
    ends = {
        "x1": g.mix("x1", "x2", "t"), "y1": g.mix("y1", "y2", "t"),
        "x2": g.mix("x1", "x2", "t1"), "y2": g.mix("y1", "y2", "t1"),
    }
    return rows.withColumns(ends).drop("t1")


def split_at_intersections(edges: DataFrame, cutters: DataFrame | None = None, tol: float = 1e-9) -> DataFrame:
    """Cut each edge (id, seq, ends) where other shapes' edges cross it."""
    return _pieces(edges.select("id", "seq", *SEG), boundary_cuts(edges, cutters), ["id", "seq"], tol)


def meeting_boxes(edges: DataFrame) -> DataFrame:
    """(id, other): every two shapes whose bounding boxes meet, lower id first."""
    boxes = materialize(
        edges.groupBy("id").agg(
            F.least(F.min("x1"), F.min("x2")).alias("min_x"), F.least(F.min("y1"), F.min("y2")).alias("min_y"),
            F.greatest(F.max("x1"), F.max("x2")).alias("max_x"), F.greatest(F.max("y1"), F.max("y2")).alias("max_y"),
        ), "boxes",
    )
    met = cell_join(
        _prefixed(boxes, "a_"), _prefixed(boxes, "b_"), Box(*["a_" + c for c in BOX]), Box(*["b_" + c for c in BOX]),
        keep=F.col("a_id") < F.col("b_id"),
    )
    return met.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"))


def polygon_boolean(edges: DataFrame, *modes: str, pairs: DataFrame | None = None, tol: float = 1e-9) -> DataFrame:
    """Boundary pieces of the union, intersection or subtraction of polygon pairs, per mode asked for.

    ``pairs`` (id, other) names the pairs; without it every two polygons whose bounding boxes meet
    are taken, lower id first, so one inside the other is a pair too. Both polygons are cut at their
    crossings with the partner, and a piece stays by whether its midpoint lies in the partner; on
    the partner's boundary that is so along its left and lower sides only, so of edges that
    coincide each side is judged alike. ``side`` tells which polygon of the pair the piece comes from.
    """
    rules = {"union": (False, False), "intersection": (True, True), "subtraction": (False, True)}
    if not modes or set(modes) - set(rules):
        raise ValueError(f"modes are {sorted(rules)}, not {modes!r}")
    edges = materialize(edges.select("id", "seq", *SEG), "edges")
    cuts = materialize(boundary_cuts(edges), "cuts")
    if pairs is None:
        pairs = meeting_boxes(edges)
    sides = F.array(
        F.struct(F.col("id"), F.col("other"), F.lit("a").alias("side")),
        F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.lit("b").alias("side")),
    )
    links = materialize(pairs.select(F.inline(sides)), "links")
    keys = ["id", "seq", "other", "side"]
    # a few MB of links and edges give many times as many rows, which a task must not all take into its aggregate
    sizes = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(links.groupBy("id").agg(F.count(F.lit(1)).alias("m")), "id")
    rows = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    base = growing(edges.select("id", "seq", *SEG)).join(links, "id").repartition(rows // BASE_ROWS + 1, *keys)
    # no edge has more marks of one partner than it has cuts there, and its two ends
    most = cuts.groupBy("id", "seq", "other").count().agg(F.max("count")).first()[0] or 0
    cut = _pieces_in_rows if most < CHUNK_ROWS and tol >= 1e-9 else _pieces
    pieces = cut(base, growing(cuts).join(links, ["id", "other"]), keys, tol).withColumnRenamed("other", "poly")
    name = ["id", "seq", "poly", "side", "t"]
    mids = materialize(pieces.select(*name, *SEG), "pieces")
    px, py = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    near = mids.select(*name, px.alias("px"), py.alias("py"))
    inner = _parity(growing(near), edges.select(F.col("id").alias("poly"), *SEG), name).withColumn("inside", F.lit(True))
    inside = F.coalesce("inside", F.lit(False))

    def kept_in(mode: str) -> Column:
        for_a, for_b = rules[mode]
        return F.when(inside == F.when(F.col("side") == "a", for_a).otherwise(for_b), mode)

    kept = growing(mids).join(inner, name, "left").withColumn("mode", F.explode(F.array_compact(F.array(*[kept_in(m) for m in modes]))))
    first = F.col("side") == "a"
    return kept.select(
        F.when(first, F.col("id")).otherwise(F.col("poly")).alias("poly_a"),
        F.when(first, F.col("poly")).otherwise(F.col("id")).alias("poly_b"),
        "mode", "side", "seq", *SEG,
    )


__all__ = [
    "box_contains", "box_edges", "clip_to_boxes", "clip_to_grid", "containment_tree", "crossings", "generate_tiles",
    "line_query", "point_in_polygon", "points_in_boxes", "points_on_segments", "polygon_boolean", "segment_intersections",
    "segments_through_boxes", "split_at_intersections", "stamp_pattern", "tile_grid", "tile_knots",
]
