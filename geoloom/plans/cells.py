"""Spatial joins on grid cells, as equi-joins Catalyst can shuffle and AQE can split.

Every row is listed in the cells it touches: a box in all cells it covers, a segment only in
the cells along its line, so a long diagonal costs its length and not its area. A pair that
meets in several cells is kept only in the cell that owns one agreed point of the pair (the
lower corner of the overlap, or the crossing point), so no distinct is needed.

* Long boxes: a box wider than ``SPAN`` cells is listed on a coarser grid, ``FAN`` times wider
  per level. Pairs of unequal level meet on the coarser grid; two rows that both belong to
  finer grids never meet there.
* Hot cells: cells are counted first (a pre-aggregated count). A crowded cell is cut into
  4, 16, 64.. parts, which lowers the number of pairs tried, and what stays crowded after
  that is salted: each side is dealt over its own salts and repeated on the other side's.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.plans.scratch import growing, materialize

SPAN = 4
FAN = 16
MAX_CUT = 6
HOT_ROWS = 20000
MANY_ROWS = 50000  # with more on both sides neither is broadcast
PAD = 1e-6  # of a cell: keeps a computed point inside a cell both rows are listed in


@dataclass(frozen=True)
class Box:
    """Rows listed in all cells their box covers. A point is a box of no size."""

    min_x: str
    min_y: str
    max_x: str
    max_y: str

    def bounds(self) -> tuple[Column, Column, Column, Column]:
        return F.col(self.min_x), F.col(self.min_y), F.col(self.max_x), F.col(self.max_y)

    def rows(self, low: Column, high: Column) -> tuple[Column, Column]:
        """y range of the shape between two x values."""
        return F.col(self.min_y), F.col(self.max_y)


@dataclass(frozen=True)
class Line:
    """Rows listed only in the cells along a segment."""

    x1: str
    y1: str
    x2: str
    y2: str

    def bounds(self) -> tuple[Column, Column, Column, Column]:
        x1, y1, x2, y2 = F.col(self.x1), F.col(self.y1), F.col(self.x2), F.col(self.y2)
        return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)

    def rows(self, low: Column, high: Column) -> tuple[Column, Column]:
        x1, y1, x2, y2 = F.col(self.x1), F.col(self.y1), F.col(self.x2), F.col(self.y2)
        bottom, top = F.least(y1, y2), F.greatest(y1, y2)
        left, right = F.greatest(low, F.least(x1, x2)), F.least(high, F.greatest(x1, x2))
        slope = (y2 - y1) / (x2 - x1)
        ya, yb = y1 + (left - x1) * slope, y1 + (right - x1) * slope
        steep = x1 == x2
        return (
            F.when(steep, bottom).otherwise(F.greatest(bottom, F.least(ya, yb))),
            F.when(steep, top).otherwise(F.least(top, F.greatest(ya, yb))),
        )


Shape = Box | Line


def point_box(x: str, y: str) -> Box:
    return Box(x, y, x, y)


def _side(shape: Shape) -> Column:
    x0, y0, x1, y1 = shape.bounds()
    return F.greatest(x1 - x0, y1 - y0)


def _profile(a: DataFrame, b: DataFrame, a_shape: Shape, b_shape: Shape):
    """Mean and largest sides and row counts of both inputs, in one pass over their boxes."""

    def sides(df: DataFrame, shape: Shape, tag: int) -> DataFrame:
        return df.select(_side(shape).alias("s"), F.lit(tag).alias("t"))

    grouped = (
        sides(a, a_shape, 0)
        .unionByName(sides(b, b_shape, 1))
        .groupBy("t")
        .agg(F.avg("s").alias("mean"), F.max("s").alias("top"), F.count(F.lit(1)).alias("n"))
    )
    found = {r["t"]: r for r in grouped.collect()}  # two rows
    return [(found[t]["mean"] or 0.0, found[t]["top"] or 0.0, found[t]["n"]) if t in found else (0.0, 0.0, 0) for t in (0, 1)]


def _cell_size(stats, a_shape: Shape, b_shape: Shape) -> float:
    (ma, _, na), (mb, _, nb) = stats
    if isinstance(a_shape, Line) and isinstance(b_shape, Line):
        size = (ma * na + mb * nb) / max(na + nb, 1)
    elif isinstance(a_shape, Line):
        size = mb or ma
    elif isinstance(b_shape, Line):
        size = ma or mb
    else:
        size = max(ma, mb)
    return size if size > 0 else 1.0


def _level(shape: Shape, cell: float, levels: int) -> Column:
    if isinstance(shape, Line):
        return F.lit(0)
    side = _side(shape)
    level = F.lit(levels)
    for k in reversed(range(levels)):
        level = F.when(side <= SPAN * cell * FAN**k, F.lit(k)).otherwise(level)
    return level


def _listed(df: DataFrame, shape: Shape, size: float) -> DataFrame:
    """One row per touched cell of a regular grid."""
    x0, _, x1, _ = shape.bounds()
    pad = size * PAD
    columns = F.sequence(F.floor((x0 - pad) / size), F.floor((x1 + pad) / size))
    out = df.withColumn("__cx", F.explode(columns))
    low, high = shape.rows(F.col("__cx") * size - pad, (F.col("__cx") + 1) * size + pad)
    return out.withColumn("__cy", F.explode(F.sequence(F.floor((low - pad) / size), F.floor((high + pad) / size))))


def _cut(df: DataFrame, shape: Shape, size: float, crowded: DataFrame) -> DataFrame:
    """List the rows of crowded cells again in the 2^k x 2^k parts of the cell they touch."""
    out = df.join(crowded, ["__cx", "__cy"], "left").withColumn("__k", F.coalesce("__k", F.lit(0)))
    parts = F.pow(F.lit(2.0), F.col("__k"))
    fine, whole = F.lit(size) / parts, parts.cast("bigint")
    pad = F.lit(size * PAD)
    x0, _, x1, _ = shape.bounds()

    def span(cell: str, lo: Column, hi: Column) -> Column:
        first = F.col(cell) * whole
        start = F.greatest(first, F.floor((lo - pad) / fine))
        stop = F.least(first + whole - 1, F.floor((hi + pad) / fine))
        return F.explode(F.when(start <= stop, F.sequence(start, stop)))

    out = out.withColumn("__sx", span("__cx", x0, x1))
    low, high = shape.rows(F.col("__sx") * fine - pad, (F.col("__sx") + 1) * fine + pad)
    return (
        out.withColumn("__sy", span("__cy", low, high))
        .drop("__cx", "__cy")
        .withColumnsRenamed({"__sx": "__cx", "__sy": "__cy"})
    )


def _counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    def tagged(df: DataFrame, left: int) -> DataFrame:
        return df.select(*keys, F.lit(left).alias("__a"), F.lit(1 - left).alias("__b"))

    both = tagged(a, 1).unionByName(tagged(b, 0))
    return both.groupBy(*keys).agg(F.sum("__a").alias("__na"), F.sum("__b").alias("__nb"))


def _salted(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
    """Deal rows over their own side's salts and repeat them on every salt of the other side."""
    rows = [c for c in df.columns if c not in (own_n, other_n)]
    mine = F.pmod(F.xxhash64(*rows), F.coalesce(F.col(own_n), F.lit(1)))
    theirs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other_n), F.lit(1)) - 1))
    return df.withColumn(own, mine).withColumn(other, theirs).drop(own_n, other_n)


@dataclass(frozen=True)
class _Join:
    a_shape: Shape
    b_shape: Shape
    hot: int
    balance: bool
    derive: dict[str, Column]
    keep: Column | None
    owner: tuple[Column, Column]
    many: bool = False

    def meet(self, a: DataFrame, b: DataFrame, size: float) -> DataFrame:
        left, right = _listed(a, self.a_shape, size), _listed(b, self.b_shape, size)
        keys = ["__cx", "__cy"]
        fine: Column = F.lit(size)
        if self.balance:
            left, right, keys = self._spread(left, right, keys, size)
        if "__k" in keys:
            fine = F.lit(size) / F.pow(F.lit(2.0), F.col("__k"))
        ax0, ay0, ax1, ay1 = self.a_shape.bounds()
        bx0, by0, bx1, by1 = self.b_shape.bounds()
        pairs = (growing(left) if self.many else left).join(right, keys).filter((ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1))
        if self.derive:
            pairs = pairs.withColumns(self.derive)
        if self.keep is not None:
            pairs = pairs.filter(self.keep)
        ox, oy = self.owner
        pairs = pairs.filter((F.floor(ox / fine) == F.col("__cx")) & (F.floor(oy / fine) == F.col("__cy")))
        return pairs.drop("__cx", "__cy", "__k", "__sa", "__sb")

    def _spread(self, left: DataFrame, right: DataFrame, keys: list[str], size: float):
        hot = self.hot
        load = F.sqrt(F.col("__na").cast("double") * F.col("__nb"))
        cuts = F.least(F.lit(MAX_CUT), F.ceil(F.log(load / hot) / math.log(4.0)).cast("int"))
        # written, so the optimizer knows how few they are and shuffles no listed row to look for them
        crowded = materialize(_counts(left, right, keys).filter(load > hot).select(*keys, cuts.alias("__k")), "crowded")
        if crowded.isEmpty():
            return left, right, keys
        left, right = _cut(left, self.a_shape, size, crowded), _cut(right, self.b_shape, size, crowded)
        keys = ["__k", *keys]
        salts = (
            _counts(left, right, keys)
            .filter(load > 2.0 * hot)
            .select(
                *keys,
                F.ceil(F.col("__na") / F.lit(hot)).alias("__ma"),
                F.ceil(F.col("__nb") / F.lit(hot)).alias("__mb"),
            )
        )
        salts = materialize(salts, "salts")
        left = _salted(left.join(salts, keys, "left"), "__sa", "__ma", "__sb", "__mb")
        right = _salted(right.join(salts, keys, "left"), "__sb", "__mb", "__sa", "__ma")
        return left, right, [*keys, "__sa", "__sb"]


def cell_join(
    a: DataFrame,
    b: DataFrame,
    a_shape: Shape,
    b_shape: Shape,
    *,
    cell: float | None = None,
    hot: int = HOT_ROWS,
    derive: dict[str, Column] | None = None,
    keep: Column | None = None,
    owner: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Pairs of rows whose shapes meet, each once. Column names of the two sides must differ.

    Two boxes meet when they overlap (closed bounds). With segments, ``owner`` must name a
    point lying on both shapes, built from ``derive`` columns, and ``keep`` the exact test.
    """
    stats = _profile(a, b, a_shape, b_shape)
    size = float(cell or _cell_size(stats, a_shape, b_shape))
    tops = [top for (_, top, _), shape in zip(stats, (a_shape, b_shape)) if isinstance(shape, Box)]
    levels = 0
    while tops and SPAN * size * FAN**levels < max(tops):
        levels += 1
    if owner is None:
        ax0, ay0, _, _ = a_shape.bounds()
        bx0, by0, _, _ = b_shape.bounds()
        owner = (F.greatest(ax0, bx0), F.greatest(ay0, by0))
    # Only when both sides together hold enough rows can any cell be crowded.
    balance = math.sqrt(float(stats[0][2]) * stats[1][2]) > hot
    many = min(stats[0][2], stats[1][2]) > MANY_ROWS
    join = _Join(a_shape, b_shape, hot, balance, derive or {}, keep, owner, many)
    if levels == 0:
        return join.meet(a, b, size)
    a = a.withColumn("__la", _level(a_shape, size, levels))
    b = b.withColumn("__lb", _level(b_shape, size, levels))
    out = None
    for k in range(levels + 1):
        grid = size * FAN**k
        pairs = [(F.col("__la") == k, F.col("__lb") <= k)]
        if k:
            pairs.append((F.col("__la") < k, F.col("__lb") == k))
        for a_rows, b_rows in pairs:
            if (isinstance(a_shape, Line) and k and (a_rows is pairs[0][0])):
                continue  # segments are never listed as owners of a coarser grid
            part = join.meet(a.filter(a_rows), b.filter(b_rows), grid)
            out = part if out is None else out.unionByName(part)
    return out.drop("__la", "__lb")
