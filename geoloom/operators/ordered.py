"""Operators that depend on order: hatching, sequences, merging, sorting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import affine
from geoloom.functions import geometry as g
from geoloom.plans.scan import CHUNK_ROWS, chunk_of, chunked_fold, ordered_scan
from geoloom.plans.scratch import materialize

SEG = ("x1", "y1", "x2", "y2")


def group_extents(edges: DataFrame, groups: list[str]) -> DataFrame:
    return edges.groupBy(*groups).agg(
        F.min(F.least("x1", "x2")).alias("min_x"),
        F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"),
        F.max(F.greatest("y1", "y2")).alias("max_y"),
    )


def scan_crossings(edges: DataFrame, groups: list[str], v0: Column, pitch: Column | float, count: Column) -> DataFrame:
    """Where edges (u1, v1, u2, v2) meet the lines v = v0 + k * pitch, k < count: columns k, u.

    Half-open in v, so a shared vertex counts once and level edges never do. Each edge works
    out its own line numbers; nothing is joined.
    """
    low, high = F.least("v1", "v2"), F.greatest("v1", "v2")
    zero = F.lit(0).cast("bigint")
    first = F.greatest(zero, F.ceil((low - v0) / pitch))
    last = F.least(count - 1, F.ceil((high - v0) / pitch) - 1)
    rows = edges.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last))))
    v = v0 + F.col("k") * pitch
    return rows.withColumn(
        "u", F.col("u1") + (v - F.col("v1")) / (F.col("v2") - F.col("v1")) * (F.col("u2") - F.col("u1"))
    )


def paired_crossings(hits: DataFrame, keys: list[str], chunk: Column, invert: bool = False) -> DataFrame:
    """Pair the crossings of each line: 1-2, 3-4, or 2-3, 4-5 when inverted. Adds n and u_end.

    Crossings are numbered by a scan in chunks along the line, so a line with very many
    crossings is not gathered in one task.
    """
    # crossings at the same place may go in any order: the pairs come out the same
    ranked = ordered_scan(hits, keys, ["u"], chunk, index="rn", lead={"u_end": F.col("u")})
    odd = F.col("rn") % 2 == (0 if invert else 1)
    return ranked.filter(odd & F.col("u_end").isNotNull()).withColumn("n", F.floor((F.col("rn") + 1) / 2)).drop("rn")


def hatch_fill(
    edges: DataFrame,
    groups: list[str],
    pitch: float,
    angle_deg: float = 0.0,
    style: str = "raster",
    invert: bool = False,
) -> DataFrame:
    """Inside parts of hatch lines over the closed contours of each group.

    Lines are numbered k; sorting by (k, n) gives the drawing order: in ``serpentine`` odd lines
    run backwards, and in ``*_grid`` the lines follow again, turned by 90 degrees, in reverse.
    """
    if style not in ("raster", "serpentine", "raster_grid", "serpentine_grid"):
        raise ValueError(f"unknown style {style!r}")
    size = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    ext = group_extents(edges, groups).select(
        *groups,
        ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"),
        ((F.col("min_y") + F.col("max_y")) / 2).alias("cy"),
        size.alias("size"),
        F.ceil(size / pitch).alias("lines"),
    )
    based = edges.select(*groups, *SEG).join(ext, groups)

    def one(degrees: float, second: bool) -> DataFrame:
        turn = affine.translate(-F.col("cx"), -F.col("cy")).then(affine.rotate(math.radians(-degrees)))
        u1, v1 = turn.apply("x1", "y1")
        u2, v2 = turn.apply("x2", "y2")
        rows = based.select(
            *groups, "cx", "cy", "size", "lines",
            u1.alias("u1"), v1.alias("v1"), u2.alias("u2"), v2.alias("v2"),
        )
        v0 = -F.col("size") / 2
        hits = scan_crossings(rows, groups, v0, pitch, F.col("lines"))
        hits = hits.select(*groups, "k", "u", "cx", "cy", "size", "lines")
        pairs = paired_crossings(hits, [*groups, "k"], F.floor(F.col("u") / F.col("size") * 64), invert)
        back = affine.rotate(math.radians(degrees)).then(affine.translate(F.col("cx"), F.col("cy")))
        v = v0 + F.col("k") * pitch
        flip = (F.col("k") % 2 == 1) if style.startswith("serpentine") else F.lit(False)
        a, b = F.when(flip, F.col("u_end")).otherwise(F.col("u")), F.when(flip, F.col("u")).otherwise(F.col("u_end"))
        xa, ya = back.apply(a, v)
        xb, yb = back.apply(b, v)
        k = 2 * F.col("lines") - 1 - F.col("k") if second else F.col("k")
        n = F.when(flip, -F.col("n")).otherwise(F.col("n"))
        return pairs.select(
            *groups, k.alias("k"), n.alias("n"), xa.alias("x1"), ya.alias("y1"), xb.alias("x2"), yb.alias("y2")
        )

    out = one(angle_deg, False)
    if style.endswith("_grid"):
        out = out.unionByName(one(angle_deg + 90.0, True))
    return out


def paths_from_sequence(
    segments: DataFrame, groups: list[str], order: str, tol: float = 1e-3, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number the paths in ordered segments: a path breaks where an end misses the next start.

    Adds path_no (the order value of the path's first segment), pos, and used, which is false
    for a segment that joins neither neighbour.
    """
    rows = segments.withColumn("chunk", chunk_of(order, chunk_rows))
    rows = ordered_scan(
        rows, groups, [order], "chunk", lag={"last": F.struct("x2", "y2")}, lead={"next": F.struct("x1", "y1")}
    )
    joins_last = F.coalesce(g.length("last.x2", "last.y2", "x1", "y1") <= tol, F.lit(False))
    joins_next = F.coalesce(g.length("x2", "y2", "next.x1", "next.y1") <= tol, F.lit(False))
    rows = rows.withColumns({"used": joins_last | joins_next, "head": F.when(~joins_last, F.col(order))}).drop("last", "next")
    rows = materialize(rows, "sequence")
    rows = ordered_scan(
        rows, groups, [order], "chunk",
        fill={"path_no": F.col("head")}, running={"__nth": F.lit(1).cast("bigint")},
    )
    rows = materialize(rows, "sequence")
    # the place of a path's first segment rides along with its number, so nothing is joined back
    rows = ordered_scan(rows, groups, [order], "chunk", fill={"__first": F.when(F.col("head").isNotNull(), F.col("__nth"))})
    return rows.withColumn("pos", F.col("__nth") - F.col("__first")).drop("__nth", "__first", "head", "chunk")


def merge_collinear(segments: DataFrame, groups: list[str], order: str, tol: float = 1e-3, rows: int = 4096) -> DataFrame:
    """Merge consecutive segments while the direction stays within ``tol`` of the run's first.

    The direction a segment is compared with depends on where the last run began, so the runs
    come from a fold; the fold works in bounded chunks whatever the length of the path.
    """
    item = F.struct(F.col(order).alias("o"), g.angle(*SEG).alias("a"))
    empty = F.array().cast("array<bigint>")

    def start(_first: Column) -> Column:
        return F.struct(F.lit(None).cast("double").alias("ref"), empty.alias("out"))

    def step(s: Column, v: Column, _before: Column) -> Column:
        begins = s["ref"].isNull() | (F.abs(g.turn(v["a"] - s["ref"])) > tol)
        return F.struct(
            F.when(begins, v["a"]).otherwise(s["ref"]).alias("ref"),
            F.when(begins, F.array_append(s["out"], v["o"])).otherwise(s["out"]).alias("out"),
        )

    folded = chunked_fold(segments.select(*groups, order, *SEG), groups, order, item, start, step, rows=rows)
    heads = folded.select(*groups, F.explode("out").alias(order)).withColumn("run", F.col(order))
    marked = materialize(segments.select(*groups, order, *SEG).join(heads, [*groups, order], "left"), "runs")
    filled = ordered_scan(marked.withColumnRenamed("run", "head"), groups, [order], chunk_of(order), fill={"run": F.col("head")})
    return (
        filled.groupBy(*groups, "run")
        .agg(
            *g.at_first(order, "", "x1", "y1"),
            *g.at_last(order, "", "x2", "y2"),
            F.count(F.lit(1)).alias("merged"),
        )
        .withColumnRenamed("run", order)
    )


def simplify_contour(points: DataFrame, groups: list[str], order: str, tol_deg: float = 1.0, closed: Column | None = None, rows: int = 4096) -> DataFrame:
    """Drop contour points while the direction from the last kept point stays within a tolerance.

    Points are (groups, order, x, y). The first and last point stay; where ``closed`` (a column
    of ``points``) holds, the first point is repeated at the end.
    """
    tol = math.radians(tol_deg)
    item = F.struct(F.col(order).alias("o"), "x", "y")
    none = F.lit(None).cast("double")

    def start(head: Column) -> Column:
        return F.struct(head["x"].alias("lx"), head["y"].alias("ly"), none.alias("ref"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, v: Column, p: Column) -> Column:
        first = p.isNull()
        second = s["ref"].isNull()
        from_last = F.atan2(v["y"] - s["ly"] + 0.0, v["x"] - s["lx"] + 0.0)
        from_prev = F.atan2(v["y"] - p["y"] + 0.0, v["x"] - p["x"] + 0.0)
        bends = ~first & ~second & (F.abs(g.turn(from_last - s["ref"])) > tol)
        kept = F.when(first, v["o"]).when(bends, p["o"])
        return F.struct(
            F.when(first, v["x"]).when(bends, p["x"]).otherwise(s["lx"]).alias("lx"),
            F.when(first, v["y"]).when(bends, p["y"]).otherwise(s["ly"]).alias("ly"),
            F.when(first, none).when(second, from_last).when(bends, from_prev).otherwise(s["ref"]).alias("ref"),
            F.when(kept.isNotNull(), F.array_append(s["out"], kept)).otherwise(s["out"]).alias("out"),
        )

    given = closed if closed is not None else F.lit(False)
    pts = points.select(*groups, F.col(order), "x", "y", given.alias("closed"))
    # each point is shuffled once, into the chunk it lies in; a group of one chunk, as contours mostly are, is folded and kept there
    at = F.struct(F.col(order).alias("o"), "x", "y")
    packed = pts.withColumn("__chunk", chunk_of(order, rows)).groupBy(*groups, "__chunk").agg(
        F.array_sort(F.collect_list(at)).alias("items"), F.max("closed").alias("closed")
    )
    packed = materialize(packed, "contours")
    for name in (*groups, "__chunk"):
        packed = packed.filter(F.col(name).isNotNull())
    long = packed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*groups)
    long = materialize(long, "long")
    columns = [*groups, order, "x", "y"]
    if long.isEmpty():
        return _simplified_chunk(packed, groups, order, start, step).select(*columns)
    spread = packed.join(long, groups, "left_semi").select(*groups, "closed", F.inline("items")).withColumnRenamed("o", order)
    alone = packed.join(long, groups, "left_anti")
    return _simplified_chunk(alone, groups, order, start, step).select(*columns).unionByName(
        _simplified_groups(spread, groups, order, item, start, step, rows).select(*columns)
    )


def _simplified_chunk(packed: DataFrame, groups: list[str], order: str, start, step) -> DataFrame:
    """Kept points of groups that are one chunk each (items in order, closed)."""
    items = F.col("items")
    before = F.concat(F.array(F.lit(None).cast(packed.schema["items"].dataType.elementType)), F.slice(items, 1, F.size(items) - 1))
    pairs = F.zip_with(items, before, lambda v, p: F.struct(v.alias("v"), p.alias("p")))
    out = F.aggregate(pairs, start(items[0]), lambda s, x: step(s, x["v"], x["p"]))["out"]
    rows = packed.withColumns({"hi": F.element_at(items, -1)["o"], "lo": items[0]["o"]})
    rows = rows.withColumn("keep", F.array_distinct(F.array_append(out, F.col("hi"))))
    # of places without gaps or repeats each names its point; else they are looked up
    plain = F.forall(F.transform(items, lambda p, i: p["o"] == F.col("lo") + i), lambda b: b)
    named = F.transform("keep", lambda o: F.get(items, (o - F.col("lo")).cast("int")))
    kept = F.when(plain, named).otherwise(F.filter(items, lambda p: F.array_contains("keep", p["o"])))
    first = items[0]
    ring = F.array(F.struct((F.col("hi") + 1).alias("o"), first["x"].alias("x"), first["y"].alias("y")))
    kept = F.when(F.col("closed") & (F.col("hi") > F.col("lo")), F.concat(kept, ring)).otherwise(kept)
    return rows.select(*groups, F.inline(kept)).withColumnRenamed("o", order)


def _simplified_groups(pts: DataFrame, groups: list[str], order: str, item: Column, start, step, rows: int) -> DataFrame:
    """Kept points of groups of any size, by a fold in chunks."""
    folded = chunked_fold(pts, groups, order, item, start, step, rows=rows)
    kept = folded.select(*groups, F.explode("out").alias(order))
    ends = pts.groupBy(*groups).agg(
        F.min(order).alias("lo"), F.max(order).alias("hi"), F.max("closed").alias("closed"), *g.at_first(order, "", "x", "y"),
    )
    kept = kept.unionByName(ends.select(*groups, F.col("hi").alias(order))).distinct()
    out = kept.join(pts.drop("closed"), [*groups, order])
    ring = ends.filter("closed AND hi > lo").select(*groups, (F.col("hi") + 1).alias(order), "x", "y")
    return out.unionByName(ring)


def nearest_first(points: DataFrame, k: int, origin: tuple[float, float] = (0.0, 0.0), group: str | None = None, tol: float = 1e-4) -> DataFrame:
    """The k points nearest an origin, overall or per group; ties within ``tol`` go by id.

    Both forms keep k rows per task before anything is shuffled.
    """
    from pyspark.sql import Window

    far = F.hypot(F.col("x") - origin[0], F.col("y") - origin[1])
    rows = points.withColumns({"distance": far, "__key": F.floor(far / tol)})
    if group is None:
        return rows.orderBy("__key", "id").limit(k).drop("__key")
    w = Window.partitionBy(group).orderBy("__key", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__key")


def largest_first(boxes: DataFrame) -> DataFrame:
    """Boxes by falling area; a range-partitioned sort."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return boxes.withColumn("area", area).orderBy(F.col("area").desc(), "id")
