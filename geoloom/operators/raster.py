"""Pixel tables: placing shapes on a canvas, filling, outlining, layering, rotating."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import affine
from geoloom.operators.ordered import group_extents, paired_crossings, scan_crossings
from geoloom.operators.transform import apply_transform
from geoloom.plans.cells import Line
from geoloom.plans.scratch import growing

SEG = ("x1", "y1", "x2", "y2")


def _with_extents(df: DataFrame, groups: list[str]) -> DataFrame:
    """Add the extents of each row's group; of the whole table they are plain numbers."""
    ext = group_extents(df, groups)
    if groups:
        return df.join(ext, groups)
    only = ext.first()  # one row of numbers
    return df.withColumns({c: F.lit(only[c]).cast("double") for c in ext.columns})


def to_pixel_space(
    segments: DataFrame, dpi: tuple[float, float], pixel_size: float, angle_deg: float = 0.0, groups: list[str] | None = None
) -> DataFrame:
    """Scale by dpi / pixel size with y flipped, rotate, and shift to (0, 0).

    Adds the canvas size: width and height, in pixels, of each group.
    """
    groups = groups or []
    names = segments.columns
    rows = _with_extents(segments, groups)
    cx, cy = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    place = affine.combine(
        affine.translate(-cx, -cy),
        affine.scale(dpi[0] / pixel_size, -dpi[1] / pixel_size),
        affine.rotate(math.radians(angle_deg)),
    )
    rows = apply_transform(rows, place).select(*names)
    rows = apply_transform(_with_extents(rows, groups), affine.translate(-F.col("min_x"), -F.col("min_y")))
    size = {
        "width": F.ceil(F.col("max_x") - F.col("min_x")).cast("bigint"),
        "height": F.ceil(F.col("max_y") - F.col("min_y")).cast("bigint"),
    }
    return rows.withColumns(size).select(*names, "width", "height")


def fill_runs(edges: DataFrame, shape: list[str]) -> DataFrame:
    """Filled pixel runs (shape, row, first, last) of closed outlines in pixel space.

    Scan line r runs through the pixel centres of row r; a run holds the pixels whose centre lies
    between a pair of crossings.
    """
    rows = edges.select(
        *shape,
        F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"),
    )
    hits = scan_crossings(rows, shape, F.lit(0.5), 1.0, F.lit(2**62).cast("bigint")).select(*shape, "k", "u")
    pairs = paired_crossings(hits, [*shape, "k"], F.floor(F.col("u") / 4096))
    first, last = F.ceil(F.col("u") - 0.5), F.ceil(F.col("u_end") - 0.5) - 1
    return pairs.select(*shape, F.col("k").alias("row"), first.alias("first"), last.alias("last")).filter("first <= last")


def fill_pixels(edges: DataFrame, shape: list[str]) -> DataFrame:
    """Covered pixels (shape, row, col) of closed outlines."""
    return fill_runs(edges, shape).select(*shape, "row", F.explode(F.sequence("first", "last")).alias("col"))


def outline_pixels(segments: DataFrame, keep: list[str]) -> DataFrame:
    """Pixels the segments pass through: per pixel column, the rows the line covers there."""
    cols = F.sequence(F.floor(F.least("x1", "x2")), F.floor(F.greatest("x1", "x2")))
    rows = segments.withColumn("col", F.explode(cols))
    low, high = Line(*SEG).rows(F.col("col").cast("double"), F.col("col") + 1.0)
    return rows.select(*keep, F.explode(F.sequence(F.floor(low), F.floor(high))).alias("row"), "col")


def point_pixels(points: DataFrame, keep: list[str]) -> DataFrame:
    return points.select(*keep, F.floor("y").alias("row"), F.floor("x").alias("col"))


def rasterize(
    edges: DataFrame | None = None, shape: list[str] | None = None, lines: DataFrame | None = None, points: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Distinct covered pixels of filled shapes, outlines and points; copies combine before the shuffle."""
    keep = keep or []
    parts = []
    if edges is not None:
        parts.append(fill_pixels(edges, shape or ["id"]).select(*keep, "row", "col"))
    if lines is not None:
        parts.append(outline_pixels(lines, keep))
    if points is not None:
        parts.append(point_pixels(points, keep))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keep, "row", "col").agg().select(*keep, "row", "col") if keep else out.distinct()


def canvas(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All pixels of a canvas; rows are made by many tasks, columns within each."""
    return spark.range(height).select(
        F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("col")
    )


def rasterize_layers(pixels: DataFrame, width: int, height: int, background: int = 8) -> DataFrame:
    """Several value layers on one canvas: pixels (row, col, val, ord); the later layer wins."""
    top = pixels.groupBy("row", "col").agg(F.max_by("val", "ord").alias("val"))
    grid = canvas(pixels.sparkSession, width, height)
    return growing(grid).join(top, ["row", "col"], "left").withColumn("val", F.coalesce("val", F.lit(background).cast("bigint")))


SIDE = 64  # pixels along a square of a canvas that is filled at once, a power of two
CANVAS_ROWS = 8_000_000  # pixels of a canvas in a task


def rotate_pixels(pixels: DataFrame, angle_deg: float, background: int = 0, size: tuple[int, int] | None = None) -> DataFrame:
    """Rotate a pixel table about its centre; each output pixel takes the source pixel it falls in.

    The output canvas bounds the rotated input; its pixels with no source get the background. Each source pixel names the
    output pixels that fall in it, by the same arithmetic, so only source pixels are shuffled; the background is what they
    leave of each square of the canvas. Its area grows with the square of a long strip of pixels, so a task gives one run of
    squares below each other: their rows have the same few columns, and a written canvas takes little room.
    """
    if size is None:
        top = pixels.agg(F.max("col"), F.max("row")).first()
        size = (top[0] + 1, top[1] + 1)
    w, h = size
    a = math.radians(angle_deg)
    cos, sin = math.cos(a), math.sin(a)
    # a quarter turn must not gain a pixel from the rounding of its cosine
    out_w = math.ceil(round(abs(w * cos) + abs(h * sin), 9))
    out_h = math.ceil(round(abs(w * sin) + abs(h * cos), 9))
    x, y = F.col("col") - out_w / 2.0, F.col("row") - out_h / 2.0
    src_col, src_row = F.floor(x * cos + y * sin + w / 2.0), F.floor(y * cos - x * sin + h / 2.0)
    # the middle of a source pixel on the canvas, and how far from it an output pixel may lie
    mx, my = F.col("src_col") + 0.5 - w / 2.0, F.col("src_row") + 0.5 - h / 2.0
    reach = (abs(cos) + abs(sin)) / 2 + 1e-3

    def near(middle: Column, length: int) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil(middle - reach)), F.least(F.lit(length - 1), F.floor(middle + reach))
        return F.explode(F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))))

    src = pixels.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), "val")
    met = src.withColumn("col", near(mx * cos - my * sin + out_w / 2.0, out_w)).withColumn("row", near(mx * sin + my * cos + out_h / 2.0, out_h))
    met = met.filter((src_col == F.col("src_col")) & (src_row == F.col("src_row")))
    val = F.coalesce("val", F.lit(background).cast("bigint")).alias("val")
    block, band = F.floor(F.col("col") / SIDE), F.floor(F.col("row") / SIDE)
    place = (F.col("row") - band * SIDE) * SIDE + F.col("col") - block * SIDE
    taken = met.groupBy(block.alias("block"), band.alias("band")).agg(F.collect_set(place.cast("int")).alias("taken"))
    blocks = canvas(pixels.sparkSession, -(-out_w // SIDE), -(-out_h // SIDE)).select(F.col("col").alias("block"), F.col("row").alias("band"))
    blocks = growing(blocks).join(taken, ["block", "band"], "left")
    blocks = blocks.repartitionByRange(out_w * out_h // CANVAS_ROWS + 1, "block", "band").sortWithinPartitions("block", "band")
    every = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    left = F.when(F.col("taken").isNull(), every).otherwise(F.array_except(every, F.col("taken")))
    rest = blocks.select("block", "band", F.explode(left).alias("at")).select(
        (F.col("band") * SIDE + F.shiftright("at", SIDE.bit_length() - 1)).alias("row"), (F.col("block") * SIDE + F.col("at").bitwiseAND(F.lit(SIDE - 1))).alias("col"),
        F.lit(background).cast("bigint").alias("val"),
    )
    rest = rest.filter((F.col("row") < out_h) & (F.col("col") < out_w))
    return met.select("row", "col", val).unionByName(rest)
