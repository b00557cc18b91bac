"""Connectivity: touching ends, stitched paths, mesh slices and their contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from geoloom.plans.cells import Box, cell_join, point_box
from geoloom.plans.chains import rank_chains
from geoloom.plans.components import components
from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import growing, materialize


def segment_ends(segments: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Both ends of every segment with the vertex they meet at: (id, tip, vertex); tip 0 is the start.

    Ends no farther apart than ``tol`` share a vertex, and so do chains of such ends; one row per end,
    however many meet. Each distinct spot is compared with the others of its cell and of the
    cells within ``tol``, and the close ones are joined into components.
    """
    ends = [
        F.struct(F.lit(i).alias("tip"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for i, (x, y) in enumerate((("x1", "y1"), ("x2", "y2")))
    ]
    ends = materialize(segments.select("id", F.inline(F.array(*ends))), "ends")
    spots = ends.select("x", "y").distinct().withColumn("vertex", F.monotonically_increasing_id())
    spots = materialize(spots, "spots")
    links = materialize(_close(spots, tol), "close")
    if not links.isEmpty():
        roots = components(links).select(F.col("node").alias("vertex"), "root")
        spots = growing(spots).join(roots, "vertex", "left").select("x", "y", F.coalesce("root", "vertex").alias("vertex"))
    return growing(ends).join(spots, ["x", "y"]).select("id", "tip", "vertex")


def _close(spots: DataFrame, tol: float) -> DataFrame:
    """Links (u, v) that tie all spots no farther apart than ``tol``, and chains of such spots.

    Spots of one small square are all within ``tol`` of each other and are tied to the first of them. Between
    squares the cell join compares spots, which cuts and salts crowded cells; only the first spots of two
    squares are put out, each pair once.
    """
    if tol <= 0:
        return spots.select(F.col("vertex").alias("u"), F.col("vertex").alias("v")).limit(0)
    spots = materialize(_crowded(spots, tol), "crowded")
    side = tol * 0.7  # its diagonal is below tol
    square = [F.floor(F.col(c) / side).alias(f"s{c}") for c in "xy"]
    placed = spots.select("vertex", "x", "y", *square)
    first = placed.groupBy("sx", "sy").agg(F.min("vertex").alias("first"))
    placed = materialize(growing(placed).join(first, ["sx", "sy"]), "squares")
    same = placed.where("vertex <> first").select(F.col("first").alias("u"), F.col("vertex").alias("v"))
    reach = {"a_x0": F.col("x") - tol, "a_y0": F.col("y") - tol, "a_x1": F.col("x") + tol, "a_y1": F.col("y") + tol}
    left = placed.select(F.col("first").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"), *(c.alias(n) for n, c in reach.items()))
    right = placed.select(F.col("first").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = (F.col("u") < F.col("v")) & (F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= tol)
    other = cell_join(left, right, Box(*reach), point_box("bx", "by"), keep=near)
    return same.unionByName(other.select("u", "v").distinct())


def _crowded(spots: DataFrame, tol: float) -> DataFrame:
    """Spots that may have another one within ``tol``: those that share a wide cell with any.

    A spot is listed in every cell its reach meets, mostly one. The shared cells are few unless the drawing is
    dense, so spots that lie alone are shuffled once, as a pre-aggregated row of their cell.
    """
    wide, reach = tol * 64, tol * 1.01
    listed = spots
    for axis in "xy":
        span = [F.floor((F.col(axis) + d) / wide) for d in (-reach, reach)]
        listed = listed.withColumn("c" + axis, F.explode(F.sequence(*span)))
    cells = listed.groupBy("cx", "cy").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high"))
    shared = materialize(cells.filter("low < high").select("cx", "cy"), "shared")
    return listed.join(shared, ["cx", "cy"], "left_semi").select("vertex", "x", "y").distinct()


_KINDS = ("start_to_start", "start_to_end", "end_to_start", "end_to_end")


def _kind(tip_a: Column, tip_b: Column) -> Column:
    code = tip_a * 2 + tip_b
    out = F.lit(_KINDS[3])
    for i in (2, 1, 0):
        out = F.when(code == i, _KINDS[i]).otherwise(out)
    return out


def connected_pairs(segments: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Touching ends (id_a, id_b, kind) as chains: each end with the next one by id at the same vertex.

    At a vertex of two ends this is the one pair. At a vertex of n ends it is the chain of n - 1
    pairs that ties them together, not their n^2 combinations, which ``segment_ends`` gives
    in linear size as vertex membership. The order at a vertex comes from a scan in chunks of the id.
    """
    ends = segment_ends(segments, tol).withColumn("o", F.col("id") * 2 + F.col("tip"))
    linked = ordered_scan(ends, ["vertex"], ["o"], chunk_of("o", 1 << 17), lead={"next": F.struct("id", "tip")})
    linked = linked.filter(F.col("next").isNotNull() & (F.col("next.id") != F.col("id")))
    return linked.select(
        F.col("id").alias("id_a"), F.col("next.id").alias("id_b"), _kind(F.col("tip"), F.col("next.tip")).alias("kind")
    )


def next_connected(segments: DataFrame, tol: float = 1e-3) -> DataFrame:
    """First segment by id that touches each segment, and how (start before end).

    A vertex only has to know its two lowest ids, so any number of ends may meet there.
    """
    ends = materialize(segment_ends(segments, tol), "ends")
    lowest = ends.groupBy("vertex").agg(F.min("id").alias("one"))
    second = (
        growing(ends).join(lowest, ["vertex"])
        .filter(F.col("id") > F.col("one"))
        .groupBy("vertex")
        .agg(F.min("id").alias("two"))
    )
    both = lowest.join(second, ["vertex"])
    mate = F.when(F.col("id") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    cand = materialize(growing(ends).join(both, ["vertex"]).select("id", "tip", "vertex", mate.alias("mate")), "mates")
    first = cand.groupBy("id").agg(F.min("mate").alias("mate"))
    at = growing(cand).join(first, ["id", "mate"])
    other = ends.select(F.col("id").alias("mate"), F.col("tip").alias("mate_tip"), "vertex")
    code = growing(at).join(other, ["mate", "vertex"]).groupBy("id", "mate").agg(F.min(F.col("tip") * 2 + F.col("mate_tip")).alias("code"))
    return code.select("id", "mate", _kind(F.floor(F.col("code") / 2), F.col("code") % 2).alias("kind"))


def stitch_paths(segments: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Order loose segments end to end, in any direction, into the longest paths.

    In: id, x1, y1, x2, y2; arcs and open paths take part by their two ends. At a vertex where
    more than two ends meet, ends pair up by id (1-2, 3-4). Out: id, path_id (the segment the
    path starts with), pos, reversed, is_ring. An open path starts at its lower free end, a
    ring at its lowest segment; a closed shape is a ring of its own.
    """
    ends = segment_ends(segments, tol).withColumn("o", F.col("id") * 2 + F.col("tip"))
    ranked = ordered_scan(
        ends, ["vertex"], ["o"], chunk_of("o", 1 << 17),
        index="rn", lag={"before": F.col("o")}, lead={"after": F.col("o")},
    )
    mates = ranked.select("o", F.when(F.col("rn") % 2 == 1, F.col("after")).otherwise(F.col("before")).alias("mate"))
    # A state is a segment walked towards one tip: id * 2 + tip of entry. Leaving through the other
    # tip, o ^ 1, leads into the mate of that tip; so the state before o left through mate(o).
    links = mates.select(F.col("o").alias("id"), F.when(F.col("mate").isNotNull(), F.col("mate").bitwiseXOR(F.lit(1))).alias("prev"))
    ranks = materialize(rank_chains(links), "walks")
    walk = ranks.select(
        F.col("id").alias("o"), F.col("chain"), F.col("pos"), F.col("is_ring"),
        F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 2).alias("tip"),
    )
    # Every path is walked from both sides; keep the walk that starts at the lower end.
    # A walk may pass a segment both ways, so the place decides within a chain.
    kept = walk.groupBy("id").agg(
        F.min(F.struct("chain", "pos", "tip")).alias("best"), F.min(F.struct("chain", (~F.col("is_ring")).alias("open"))).alias("shape")
    ).select("id", "best.*", (~F.col("shape.open")).alias("is_ring"))
    return kept.select(
        "id",
        F.floor(F.col("chain") / 2).alias("path_id"),
        "pos",
        (F.col("tip") == 1).alias("reversed"),
        "is_ring",
    )


def unused_segments(segments: DataFrame, stitched: DataFrame) -> DataFrame:
    """Segments that became part of no path of two or more segments, nor a closed shape."""
    stitched = materialize(stitched.select("id", "path_id", "is_ring"), "stitched")  # read twice
    used = stitched.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.max("is_ring").alias("ring"))
    used = stitched.join(used.filter("n > 1 OR ring"), "path_id").select("id")
    return segments.join(used, "id", "left_anti")


# ---- meshes -----------------------------------------------------------------------------


def facet_planes(facets: DataFrame, thickness: float, base: float | Column = 0.0) -> DataFrame:
    """One row per facet and cutting plane: plane j from the facet's lowest up to, not at, its top."""
    z0 = base if isinstance(base, Column) else F.lit(float(base))
    low, high = F.least("z0", "z1", "z2"), F.greatest("z0", "z1", "z2")
    first = F.ceil((low - z0) / thickness)
    last = F.ceil((high - z0) / thickness) - 1
    rows = facets.withColumn("slice", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.withColumn("z", z0 + F.col("slice") * thickness)


def slice_facets(facets: DataFrame, thickness: float, base: float | Column = 0.0) -> DataFrame:
    """Cut facets by level planes: one segment per facet and plane it spans, without a shuffle.

    Out: mesh_id, slice, facet_id, the forward point (x1, y1), the backward point (x2, y2), and
    the two mesh edges they lie on (fwd, bwd), written the same way from both facets that
    share an edge.
    """
    corner = [F.struct(F.col(f"z{i}").alias("z"), F.lit(i).alias("i"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(3)]
    sorted_ = facets.withColumn("v", F.array_sort(F.array(*corner)))
    # corners from low to high: l, m, h; the facet is turned when h follows l in its own order
    flat = [f"v[{k}].{axis} AS {n}{axis}" for k, n in enumerate("lmh") for axis in "xyz"]
    rows = sorted_.selectExpr("mesh_id", "facet_id", "z0", "z1", "z2", "pmod(v[2].i - v[0].i, 3) = 1 AS turned", *flat)
    rows = facet_planes(rows, thickness, base)
    # the plane meets the long edge l-h and one short edge: l-m below the middle corner, else m-h
    rows = rows.withColumn("upper", F.expr("z >= mz"))
    ends = [f"if(upper, {hi}{axis}, {lo}{axis}) AS {n}{axis}" for n, lo, hi in (("a", "l", "m"), ("b", "m", "h")) for axis in "xyz"]
    rows = rows.selectExpr("mesh_id", "slice", "facet_id", "turned", "z", "lx", "ly", "lz", "hx", "hy", "hz", *ends)
    points = [f"a{c} + (z - az) / (bz - az) * (b{c} - a{c}) AS s{c}" for c in "xy"]
    points += [f"l{c} + (z - lz) / (hz - lz) * (h{c} - l{c}) AS g{c}" for c in "xy"]
    # both facets of an edge name it from its lower to its higher end, which differ in z
    edges = [
        f"struct({p}x AS x, {p}y AS y, {p}z AS z, {q}x AS x2, {q}y AS y2, {q}z AS z2) AS {n}"
        for n, p, q in (("short", "a", "b"), ("long", "l", "h"))
    ]
    rows = rows.selectExpr("mesh_id", "slice", "facet_id", "turned", *points, *edges)
    pick = [("x1", "sx", "gx"), ("y1", "sy", "gy"), ("x2", "gx", "sx"), ("y2", "gy", "sy"), ("fwd", "short", "long"), ("bwd", "long", "short")]
    return rows.selectExpr("mesh_id", "slice", "facet_id", *[f"if(turned, {a}, {b}) AS {n}" for n, a, b in pick])


SLICE_ROWS = 65_536  # cuts of a mesh and slice that one task links
TASK_CUTS = 1_000_000  # cuts in a task that links slices


def chain_contours(cuts: DataFrame) -> DataFrame:
    """Link cut segments into contours: the next segment's forward edge is this one's backward edge.

    Out: the cut rows with contour (lowest facet of the ring), pos and is_closed. At an edge of more
    than two facets the ends pair up by rank. Slices of a mesh of up to ``SLICE_ROWS`` cuts are shuffled once and
    linked within tasks; larger ones are spread over many tasks, and their order comes from pointer doubling.
    """
    group = ["mesh_id", "slice"]
    sizes = cuts.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    large = sizes.observe(seen, F.sum("n").alias("rows")).filter(F.col("n") > SLICE_ROWS).select(*[F.col(c).alias("__" + c) for c in group])
    large = materialize(large, "large")
    tasks = (seen.get["rows"] or 0) // TASK_CUTS + 1
    if large.isEmpty():
        return _linked_in_tasks(cuts, tasks)
    among = F.col("mesh_id").eqNullSafe(F.col("__mesh_id")) & F.col("slice").eqNullSafe(F.col("__slice"))
    spread = _linked_by_rounds(cuts.join(large, among, "left_semi"))
    return _linked_in_tasks(cuts.join(large, among, "left_anti"), tasks).unionByName(spread)


def _edge_names(edge: str, dtype) -> list[Column]:
    """Two hashes of a mesh edge within its slice; equal edges have equal ones, nulls included."""
    fields = [F.col(edge)[f] for f in dtype.names] if isinstance(dtype, StructType) else [F.col(edge)]
    values = ["mesh_id", "slice", *[v for f in fields for v in (f.isNull(), f)]]
    return [F.xxhash64(F.lit(k), F.col(edge).isNull(), *values) for k in (1, 2)]


def _linked_in_tasks(cuts: DataFrame, tasks: int) -> DataFrame:
    """Contours of slices that fit a task: one shuffle of the cuts by slice, with two hashes for an edge."""
    kept = [c for c in cuts.columns if c not in ("fwd", "bwd")]
    names = [f"__{e}{k}" for e in ("fwd", "bwd") for k in (1, 2)]
    hashes = [h for e in ("fwd", "bwd") for h in _edge_names(e, cuts.schema[e].dataType)]
    rows = cuts.select(*kept, *[h.alias(n) for h, n in zip(hashes, names)])
    rows = rows.repartition(tasks, "mesh_id", "slice").sortWithinPartitions("mesh_id", "slice", "facet_id")
    fields = [cuts.schema[c] for c in kept]
    schema = StructType([*fields, StructField("pos", LongType()), StructField("is_closed", BooleanType()), StructField("contour", cuts.schema["facet_id"].dataType)])

    def linked(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def before(f1, f2, b1, b2):
            """The row before each row: of equal edges, the k-th backward one leads to the k-th forward one; -1 for none."""
            n = len(f1)
            one, two = np.concatenate([f1, b1]), np.concatenate([f2, b2])
            order = np.lexsort((two, one))  # stable: forward ends first, each side in the order of the rows
            one, two = one[order], two[order]
            begins = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            sizes = np.diff(np.r_[begins, 2 * n])
            into = order < n
            mate = np.arange(2 * n) + np.repeat(np.add.reduceat(into.astype(np.int64), begins), sizes)
            met = into & (mate < np.repeat(begins + sizes, sizes))
            prev = np.full(n, -1, np.int64)
            prev[order[met]] = order[mate[met]] - n
            return prev

        def ranked(prev):
            """Head, place and ring flag of each row by pointer doubling, as in plans/chains.py."""
            at = np.arange(len(prev))
            done = prev < 0
            head = np.where(done, at, prev)
            hops = (~done).astype(np.int64)
            low, low_hops = np.minimum(at, head), (head < at).astype(np.int64)
            rest = np.flatnonzero(~done)
            while len(rest):
                far = head[rest]
                lower = low[far] < low[rest]
                new = (head[far], hops[rest] + hops[far], np.where(lower, low[far], low[rest]),
                       np.where(lower, hops[rest] + low_hops[far], low_hops[rest]), done[far])
                head[rest], hops[rest], low[rest], low_hops[rest], done[rest] = new
                still = rest[~new[4]]
                if len(still) == len(rest) and not lower.any():
                    break  # only rings are left, and their least rows are known
                rest = still
            return np.where(done, head, low), np.where(done, hops, low_hops), ~done

        def placed(table):
            ends = [table.column(c).to_numpy() for c in names]
            chain, pos, ring = ranked(before(*ends))
            table = table.select(kept)
            return pa.table([*table.columns, pa.array(pos), pa.array(ring), table.column("facet_id").take(pa.array(chain))], names=schema.names)

        def last_border(table):
            """Where the last slice of the table begins."""
            differ = np.zeros(table.num_rows - 1, bool)
            for c in ("mesh_id", "slice"):
                col = table.column(c)
                a, b = col.slice(0, table.num_rows - 1), col.slice(1)
                unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                differ |= unlike.to_numpy()
            borders = np.flatnonzero(differ)
            return int(borders[-1]) + 1 if len(borders) else 0

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 3 * SLICE_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = last_border(table)
                if cut:
                    yield from placed(table.slice(0, cut)).to_batches()
                    table = table.slice(cut)
                held, count = table.to_batches(), table.num_rows
        if count:
            yield from placed(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.mapInArrow(linked, schema)


def _linked_by_rounds(cuts: DataFrame) -> DataFrame:
    """Contours of slices of any size. Nodes are numbered in the order of slice, mesh and facet, so one number names them."""
    ordered = cuts.sort("slice", "mesh_id", "facet_id").withColumn("node", F.monotonically_increasing_id())
    cuts = materialize(ordered, "cuts")
    none = F.lit(None).cast("bigint")
    roles = F.array(
        F.struct(F.col("fwd").alias("edge"), F.col("node").alias("into"), none.alias("out")),
        F.struct(F.col("bwd").alias("edge"), none.alias("into"), F.col("node").alias("out")),
    )
    ends = cuts.select("mesh_id", "slice", F.inline(roles))
    seams = ends.groupBy("mesh_id", "slice", "edge").agg(
        F.min("into").alias("id"), F.min("out").alias("prev"), F.count("into").alias("n_in"), F.count("out").alias("n_out")
    )
    seams = materialize(seams.filter("id IS NOT NULL AND prev IS NOT NULL"), "seams")
    links = seams.filter("n_in = 1 AND n_out = 1").select("id", "prev")
    shared = seams.filter("n_in > 1 OR n_out > 1").select("mesh_id", "slice", "edge")
    if not shared.isEmpty():
        met = growing(ends).join(shared, ["mesh_id", "slice", "edge"]).withColumn("side", F.col("into").isNotNull())
        met = met.withColumn("node", F.coalesce("into", "out"))
        ranked = ordered_scan(met, ["mesh_id", "slice", "edge", "side"], ["node"], chunk_of("node"), index="rn")
        keys = ["mesh_id", "slice", "edge", "rn"]
        into = ranked.filter("side").select(*keys, F.col("node").alias("id"))
        out = ranked.filter("NOT side").select(*keys, F.col("node").alias("prev"))
        links = links.unionByName(into.join(out, keys).select("id", "prev"))
    nodes = growing(cuts.select(F.col("node").alias("id"))).join(links, "id", "left")
    ranks = rank_chains(nodes).select(F.col("id").alias("node"), F.col("chain"), "pos", F.col("is_ring").alias("is_closed"))
    heads = cuts.select(F.col("node").alias("chain"), F.col("facet_id").alias("contour"))
    placed = growing(cuts.drop("fwd", "bwd")).join(ranks, "node")
    return growing(placed).join(heads, "chain").drop("node", "chain")
