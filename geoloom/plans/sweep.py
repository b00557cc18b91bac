"""Sums over the boxes that hold a point, by a sweep in ranks: n log n rows, however deep boxes lie in each other.

A box counts for the points right of and above its corners, with alternating signs, so the boxes that hold a point
are a sum over corners lower than it in x and in y. Corners and points are ranked along x and along y. At each
bit of the x rank, the ranks that agree above that bit form a group; its lower half lies left of its upper
half, and a running sum along y over the corners of the lower half answers the points of the upper half. Every
corner left of a point meets it at exactly one bit. Large groups run in chunks along y whose sums are handed on
(``ordered_scan``), so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.scan import ordered_scan
from geoloom.plans.scratch import discard, materialize

#: bits of the rows of one chunk
CHUNK_BITS = 16


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A written table with the place of each row, from 0, in the order of some columns."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    laid = materialize(laid.withColumn("__p", F.shiftright("__m", 33)), "ranked")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    first = laid.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.col("__first") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    out = materialize(laid.join(first.drop("__n"), "__p").withColumn(name, place).drop("__p", "__m", "__first"), "ranked")
    discard(laid)
    return out


def holding_sums(boxes: DataFrame, points: DataFrame, sums: list[str]) -> DataFrame:
    """For each row of ``points`` (key, x, y) the sums of some bigint columns over the boxes (min_x ... max_y) that hold it,
    borders included."""
    corners = [
        F.struct(F.col(x).alias("x"), F.lit(kx).alias("kx"), F.col(y).alias("y"), F.lit(ky).alias("ky"), F.lit(sign).alias("sign"))
        for x, kx, y, ky, sign in (("min_x", 0, "min_y", 0, 1), ("max_x", 2, "min_y", 0, -1), ("min_x", 0, "max_y", 2, -1), ("max_x", 2, "max_y", 2, 1))
    ]
    # at equal places a lower corner comes before a point, an upper one after it
    low = boxes.select(F.lit(None).cast("string").alias("key"), F.inline(F.array(*corners)), *sums)
    low = low.select("key", "x", "kx", "y", "ky", *((F.col(c) * F.col("sign")).alias(c) for c in sums))
    zero = [F.lit(0).cast("bigint").alias(c) for c in sums]
    asked = points.select(F.col("key").cast("string"), "x", F.lit(1).alias("kx"), "y", F.lit(1).alias("ky"), *zero)
    both = ranked(low.unionByName(asked), ["x", "kx"], "rx")
    placed = ranked(both.drop("x", "kx"), ["y", "ky"], "ry").drop("y", "ky")
    discard(both)
    bits = max(1, (placed.count() - 1).bit_length())
    listed = placed.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    upper = F.expr("shiftright(rx, bit) & 1") == 1
    listed = listed.where(F.when(F.col("key").isNull(), ~upper).otherwise(upper)).withColumn("half", F.expr("shiftright(rx, bit + 1)"))
    chunk = F.when(F.col("bit") < CHUNK_BITS, F.lit(0).cast("bigint")).otherwise(F.shiftright("ry", CHUNK_BITS))
    swept = ordered_scan(listed.select("key", "bit", "half", "ry", *sums), ["bit", "half"], ["ry"], chunk, running={f"upto_{c}": F.col(c) for c in sums})
    found = swept.where("key is not null").groupBy("key").agg(*(F.sum(f"upto_{c}").alias(c) for c in sums))
    some = [F.coalesce(F.col(f"found.{c}"), F.lit(0).cast("bigint")).alias(c) for c in sums]
    return points.alias("p").join(found.alias("found"), F.col("p.key").cast("string") == F.col("found.key"), "left").select("p.*", *some)


def nests(boxes: DataFrame) -> DataFrame:
    """(id, outer, above): the innermost container of each distinct box and the sum of ``n`` over its containers, for the boxes
    whose containers lie in each other; all other boxes are left out.

    ``boxes``: id, n, min_x ... max_y. The boxes that hold the lower corner and those that hold the upper one are
    compared by their number and by sums of hashes: where they agree they are the containers. The parent is
    the box whose containers, and itself, are all containers of the box, found by an equi-join on those sums.
    A chance agreement of sums takes two sets of equal size and 60 equal bits.
    """
    h = F.xxhash64("id")
    hashed = boxes.withColumns({"c": F.lit(1).cast("bigint"), "h1": h.bitwiseAND(F.lit((1 << 30) - 1)), "h2": F.shiftrightunsigned(h, 30).bitwiseAND(F.lit((1 << 30) - 1))})
    hashed = materialize(hashed, "hashed")
    tips = [F.struct(F.lit(t).alias("tip"), F.col(x).alias("x"), F.col(y).alias("y")) for t, (x, y) in enumerate((("min_x", "min_y"), ("max_x", "max_y")))]
    points = hashed.select("id", F.inline(F.array(*tips))).select(F.concat_ws("/", "id", "tip").alias("key"), "id", "tip", "x", "y")
    sums = ["c", "h1", "h2", "n"]
    held = holding_sums(hashed, points, sums)

    def at(tip: int, c: str) -> Column:
        return F.max(F.when(F.col("tip") == tip, F.col(c)))

    both = held.groupBy("id").agg(*(at(t, c).alias(f"{c}{t}") for t in (0, 1) for c in sums))
    sure = both.where(" AND ".join(f"{c}0 = {c}1" for c in sums)).select("id", *(F.col(f"{c}0").alias(f"all_{c}") for c in sums))
    sure = materialize(sure.join(hashed, "id"), "sure")  # a box holds its own corners
    above = [(F.col(f"all_{c}") - F.col(c)).alias(c) for c in sums]
    inner = sure.select("id", *above)
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    outer = sure.where(area > 0).select(F.col("id").alias("outer"), *(F.col(f"all_{c}").alias(c) for c in sums))
    top = inner.where("c = 0").select("id", F.lit(None).cast(boxes.schema["id"].dataType).alias("outer"), F.col("n").alias("above"))
    return top.unionByName(inner.where("c > 0").join(outer, sums).select("id", "outer", F.col("n").alias("above")))
