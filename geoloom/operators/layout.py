"""The plate > device > layer > tile tree: instances, extents, transforms, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.plans.scratch import materialize
from geoloom.functions import affine
from geoloom.functions.affine import Affine
from geoloom.operators.generate import grid_array
from geoloom.operators.spatial import clip_to_grid
from geoloom.operators.transform import stage_position

CELLS = ("a", "b", "c", "d", "tx", "ty")


def flatten_layout(nodes: DataFrame) -> DataFrame:
    """One row per layer instance: a node's array repeats its children at added offsets.

    Two equi-joins on the parent; which side is small is left to the optimizer.
    """
    plates = grid_array(nodes.filter("level = 'plate'")).select(
        F.col("node_id").alias("plate_id"), F.col("ord").alias("plate_copy"),
        (F.col("copy_x") - F.col("off_x")).alias("__dx"), (F.col("copy_y") - F.col("off_y")).alias("__dy"),
    )
    devices = grid_array(nodes.filter("level = 'device'")).select(
        F.col("node_id").alias("device_id"), F.col("parent_id").alias("plate_id"), F.col("ord").alias("device_copy"),
        F.col("off_x").alias("device_x"), F.col("off_y").alias("device_y"),
        (F.col("copy_x") - F.col("off_x")).alias("__ex"), (F.col("copy_y") - F.col("off_y")).alias("__ey"),
    )
    layers = nodes.filter("level = 'layer'").select(
        F.col("node_id").alias("layer_id"), F.col("parent_id").alias("device_id"), F.col("off_x").alias("layer_x"), F.col("off_y").alias("layer_y")
    )
    rows = layers.join(devices, "device_id").join(plates, "plate_id")
    return rows.select(
        "plate_id", "plate_copy", "device_id", "device_copy", "layer_id",
        (F.col("device_x") + F.col("__dx")).alias("device_x"),
        (F.col("device_y") + F.col("__dy")).alias("device_y"),
        (F.col("layer_x") + F.col("__ex")).alias("layer_x"),
        (F.col("layer_y") + F.col("__ey")).alias("layer_y"),
    )


def flatten_tiles(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile instances of every layer: its array repeats its tiles (layer_id, tile, centre_x, centre_y)."""
    layers = grid_array(nodes.filter("level = 'layer'")).select(
        F.col("node_id").alias("layer_id"), F.col("ord").alias("layer_copy"),
        (F.col("copy_x") - F.col("off_x")).alias("__dx"), (F.col("copy_y") - F.col("off_y")).alias("__dy"),
    )
    moved = {"centre_x": F.col("centre_x") + F.col("__dx"), "centre_y": F.col("centre_y") + F.col("__dy")}
    return tiles.join(layers, "layer_id").withColumns(moved).drop("__dx", "__dy")


def layout_extents(
    instances: DataFrame, layer_patterns: DataFrame, pattern_extents: DataFrame, by: str = "plate_id", apply: bool = False, total: bool = False
) -> DataFrame:
    """Geometry count and combined extents over all layer instances, by node.

    layer_patterns: layer_id, pattern. pattern_extents: pattern, n and box, aggregated once per
    pattern before any join. Instances are counted per layer first, so repeats cost nothing. With ``apply`` each
    instance puts its pattern at its place: the box is mapped by the instance's matrix, where it has
    the columns a, b, c, d, and moved by the offsets of layer and device. With ``total`` a row without a node
    sums up the whole layout.
    """
    shift = {"__sx": F.col("device_x") + F.col("layer_x"), "__sy": F.col("device_y") + F.col("layer_y")}
    cells = [c for c in ("a", "b", "c", "d") if c in instances.columns] if apply else []
    counted = (instances.withColumns(shift) if apply else instances).groupBy(by, "layer_id", *cells).agg(
        F.count(F.lit(1)).alias("copies"),
        *(f(c).alias(f"{c}_{n}") for c in (shift if apply else {}) for n, f in (("lo", F.min), ("hi", F.max))),
    )
    rows = counted.join(layer_patterns, "layer_id").join(pattern_extents, "pattern")
    if apply:
        # a box keeps its sides along the axes: the extremes of a mapped box lie at its corners
        m = {c: F.col(c) if c in cells else F.lit(1.0 if c in "ad" else 0.0) for c in "abcd"}
        corners = [(x, y) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
        xs = [m["a"] * F.col(x) + m["c"] * F.col(y) for x, y in corners]
        ys = [m["b"] * F.col(x) + m["d"] * F.col(y) for x, y in corners]
        rows = rows.withColumns({
            "min_x": F.least(*xs) + F.col("__sx_lo"), "min_y": F.least(*ys) + F.col("__sy_lo"),
            "max_x": F.greatest(*xs) + F.col("__sx_hi"), "max_y": F.greatest(*ys) + F.col("__sy_hi"),
        })
    each = rows.groupBy(by).agg(
        F.sum(F.col("copies") * F.col("n")).alias("n"),
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
    )
    if not total:
        return each
    whole = each.agg(F.sum("n").alias("n"), *(f(c).alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))))
    return each.unionByName(whole.where("n IS NOT NULL").withColumn(by, F.lit(None).cast(each.schema[by].dataType)))


def valid_layers(layers: DataFrame, files: DataFrame, fiducials: DataFrame | None = None) -> DataFrame:
    """Layers (node_id, pattern_file, param_file) whose two files exist, and whether they need alignment."""
    names = files.select("name").distinct()
    ok = layers
    for column in ("pattern_file", "param_file"):
        ok = ok.join(names.withColumnRenamed("name", column), column, "left_semi")
    if fiducials is None:
        return ok
    marked = fiducials.select("node_id").distinct().withColumn("needs_alignment", F.lit(True))
    return ok.join(marked, "node_id", "left").withColumn("needs_alignment", F.coalesce("needs_alignment", F.lit(False)))


def invalid_layers(layers: DataFrame, files: DataFrame) -> DataFrame:
    """Layers that miss one of their files."""
    return layers.join(valid_layers(layers, files).select("node_id"), "node_id", "left_anti")


def own_transform() -> Affine:
    """A node's own map: scale, then rotation, then offset."""
    turn = affine.rotate(F.radians("rot_deg"))
    return affine.scale(F.col("scale"), F.col("scale")).then(turn).then(affine.translate(F.col("off_x"), F.col("off_y")))


def _cells(move: Affine) -> dict[str, Column]:
    return {n: getattr(move, n) for n in CELLS}


def _doubled(state: DataFrame, step, name: str) -> DataFrame:
    """Repeat ``step`` (joins each open node with the state of the node it points to) until none is open.

    Pointers reach twice as far each time, so a tree of depth n takes about log2(n) rounds; each
    round is a written table, and settled nodes are not written again.
    """
    state = materialize(state, name)
    settled, rounds = [], 0
    while True:
        settled.append(state.filter("up IS NULL"))
        rest = state.filter("up IS NOT NULL")
        if rest.isEmpty():
            break
        if rounds > 62:
            raise ValueError("the parents form a ring")
        rounds += 1
        every = settled[0]
        for part in settled[1:]:
            every = every.unionByName(part)
        state = materialize(step(rest, every.unionByName(rest)), name)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def node_transforms(nodes: DataFrame, top_level: str | None = None) -> DataFrame:
    """Absolute map of every node: own x parent x grandparent, up to the root.

    With ``top_level`` the product stops at the ancestor of that level, which still counts. A parent
    that is not among the nodes ends the product too.
    """
    own = nodes.withColumns(_cells(own_transform())).select("node_id", "parent_id", "level", *CELLS)
    stop = (F.col("level") == top_level) if top_level else F.lit(False)
    product = affine.from_columns().then(affine.from_columns("p_"))

    def step(rest: DataFrame, every: DataFrame) -> DataFrame:
        above = every.select(F.col("node_id").alias("up"), F.col("up").alias("p_up"), *[F.col(c).alias("p_" + c) for c in CELLS])
        known = F.col("p_a").isNotNull()
        cells = {n: F.when(known, v).otherwise(F.col(n)) for n, v in _cells(product).items()}
        return rest.join(above, "up", "left").select(
            "node_id", "parent_id", "level", *[v.alias(n) for n, v in cells.items()], F.col("p_up").alias("up")
        )

    return _doubled(own.withColumn("up", F.when(~stop, F.col("parent_id"))), step, "moves").drop("up")


def invert_about_parent(own: Affine, parent: Affine, invert_x: bool, invert_y: bool) -> Affine:
    """``own`` flipped on the inverted axes about the point the parent moves the origin to."""
    ox, oy = parent.tx, parent.ty
    flip = affine.scale(-1.0 if invert_x else 1.0, -1.0 if invert_y else 1.0)
    return affine.combine(affine.translate(-ox, -oy), own, flip, affine.translate(ox, oy))


def inverted_transforms(nodes: DataFrame, invert_x: bool, invert_y: bool) -> DataFrame:
    """Each node's own map flipped about its parent's absolute origin; top nodes keep theirs."""
    absolute = node_transforms(nodes).select(F.col("node_id").alias("parent_id"), *[F.col(c).alias("p_" + c) for c in CELLS])
    own = nodes.withColumns(_cells(own_transform())).select("node_id", "parent_id", "level", *CELLS)
    rows = own.join(absolute, "parent_id", "left")
    flipped = invert_about_parent(affine.from_columns(), affine.from_columns("p_"), invert_x, invert_y)
    cells = {n: F.when(F.col("p_a").isNotNull(), v).otherwise(F.col(n)) for n, v in _cells(flipped).items()}
    return rows.select("node_id", "parent_id", "level", *[v.alias(n) for n, v in cells.items()])


def nearest_ancestor(nodes: DataFrame, fiducials: DataFrame) -> DataFrame:
    """Closest node on the way up, itself included, that has fiducials; null when none has."""
    marked = fiducials.select("node_id").distinct().withColumn("has", F.lit(True))
    tree = nodes.select("node_id", "parent_id").join(marked, "node_id", "left")
    first = tree.select(
        "node_id", F.when(F.col("has"), F.col("node_id")).alias("ancestor"), F.when(F.col("has").isNull(), F.col("parent_id")).alias("up"),
        F.when(F.col("has"), 0).otherwise(1).alias("hops"),
    )

    def step(rest: DataFrame, every: DataFrame) -> DataFrame:
        above = every.select(F.col("node_id").alias("up"), F.col("ancestor").alias("p_ancestor"), F.col("up").alias("p_up"), F.col("hops").alias("p_hops"))
        return rest.join(above, "up", "left").select(
            "node_id", F.col("p_ancestor").alias("ancestor"), F.col("p_up").alias("up"), (F.col("hops") + F.col("p_hops")).alias("hops")
        )

    found = _doubled(first, step, "ancestors")
    return found.select("node_id", "ancestor", F.when(F.col("ancestor").isNotNull(), F.col("hops")).alias("hops"))


def tile_local(
    segments: DataFrame,
    ext: DataFrame,
    size_x: float,
    size_y: float,
    groups: list[str],
    layer_map: Affine = Affine(),
    *,
    origin: tuple[float, float] = (0.0, 0.0),
    theta: float = 0.0,
    inverts: tuple[float, float] = (1.0, 1.0),
    **grid: float,
) -> DataFrame:
    """Parts of each tile in the tile's own coordinates, with the tile's stage position."""
    parts = clip_to_grid(segments, ext, size_x, size_y, groups, **grid)
    mx, my = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    px, py = layer_map.apply(mx, my)
    sx, sy = stage_position(px, py, theta, origin[0], origin[1], inverts)
    return parts.withColumns(
        {
            "x1": F.col("x1") - mx, "y1": F.col("y1") - my, "x2": F.col("x2") - mx, "y2": F.col("y2") - my,
            "stage_x": sx, "stage_y": sy,
        }
    )
