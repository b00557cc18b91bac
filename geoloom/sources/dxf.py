"""Drawing text (group code / value line pairs) as geometry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import materialize
from geoloom.sources.lines import match_line_sequence

# Values fixed by the file format.
SUPPORTED_VERSIONS = ["AC1015", "AC1018", "AC1021", "AC1024"]
SINGLE_KINDS = ["POINT", "LINE", "CIRCLE", "ARC"]
KINDS = [*SINGLE_KINDS, "LWPOLYLINE", "SPLINE"]

PAIR_CHUNK = 32768


def dxf_pairs(lines: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(file, chunk, pair, code, value): an even line holds the code, the odd line after it the value.

    A pair never crosses a chunk border, so the value is looked up inside the chunk; the chunk
    stays with the rows, and later scans find them partitioned by it. With ``codes`` only pairs of these are
    wanted, and the code lines of others are not shuffled.
    """
    pair = F.floor(F.col("line_no") / 2)
    rows = lines.select("file", "line_no", F.trim("text").alias("code")).withColumn("chunk", chunk_of(pair, PAIR_CHUNK))
    if codes:
        rows = rows.filter((F.pmod(F.col("line_no"), F.lit(2)) != 0) | F.col("code").isin(codes))
    after = Window.partitionBy("file", "chunk").orderBy("line_no")
    rows = rows.withColumns({"pair": pair, "value": F.lead("code").over(after), "__next": F.lead("line_no").over(after)})
    whole = (F.pmod(F.col("line_no"), F.lit(2)) == 0) & (F.col("__next") == F.col("line_no") + 1)
    return rows.filter(whole).select("file", "chunk", "pair", "code", "value")


def dxf_items(lines: DataFrame) -> DataFrame:
    """Pairs of supported entities with the entity they belong to: (file, entity, kind, pair, code, value).

    An entity is named by the pair that opens it. The carry of the open entity is a scan in
    chunks of the file, so one huge drawing is not gathered in one task.
    """
    opens = F.when(F.col("code") == "0", F.struct(F.col("pair").alias("entity"), F.col("value").alias("kind")))
    rows = ordered_scan(dxf_pairs(lines), ["file"], ["pair"], "chunk", fill={"open": opens})
    return rows.filter(F.col("open.kind").isin(KINDS)).select(
        "file", "open.entity", "open.kind", "pair", "code", "value"
    )


def _only(code: str) -> Column:
    return F.when(F.col("code") == code, F.col("value"))


def _real(code: str) -> Column:
    return F.max(_only(code).cast("double"))


def dxf_entities(lines: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """POINT, LINE, CIRCLE and ARC rows: (file, entity, kind, layer, coordinates, radius, angles).

    x1, y1, z1 is the point, start or centre; angles come in degrees and leave in radians. Values
    of an entity combine before the shuffle. Only the number of the opening pair is carried along;
    the kind is one more value of the entity.
    """
    opens = F.when(F.col("code") == "0", F.col("pair"))
    codes = ["0", "8", "10", "20", "30", "11", "21", "31", "40", "50", "51"]
    rows = ordered_scan(dxf_pairs(lines, codes), ["file"], ["pair"], "chunk", fill={"entity": opens})
    rows = rows.filter("entity IS NOT NULL").groupBy("file", "entity").agg(
        F.max(_only("0")).alias("kind"),
        F.max(_only("8")).alias("layer"),
        *[_real(c).alias(n) for c, n in (("10", "x1"), ("20", "y1"), ("30", "z1"), ("11", "x2"), ("21", "y2"), ("31", "z2"))],
        _real("40").alias("r"),
        F.radians(_real("50")).alias("a0"),
        F.radians(_real("51")).alias("a1"),
    )
    rows = rows.filter(F.col("kind").isin(SINGLE_KINDS)).withColumn("layer", F.coalesce("layer", F.lit("0")))
    return rows.filter(F.col("layer").isin(layers)) if layers else rows


def dxf_polyline_vertices(lines: DataFrame) -> DataFrame:
    """LWPOLYLINE vertices: (file, path_id, layer, seq, x, y, bulge, flag).

    A vertex opens at its code 10; seq is the pair number of that line, so it grows along the
    polyline without counting.
    """
    items = materialize(dxf_items(lines).filter(F.col("kind") == "LWPOLYLINE").drop("kind"), "items")  # read twice
    heads = items.groupBy("file", "entity").agg(
        F.max(_only("8")).alias("layer"), F.max(_only("70")).cast("int").alias("flag")
    )
    rows = items.filter(F.col("code").isin("10", "20", "42"))
    rows = ordered_scan(
        rows, ["file"], ["pair"], chunk_of("pair", PAIR_CHUNK), fill={"seq": F.when(F.col("code") == "10", F.col("pair"))}
    )
    points = rows.groupBy("file", F.col("entity").alias("path_id"), "seq").agg(
        _real("10").alias("x"), _real("20").alias("y"), F.coalesce(_real("42"), F.lit(0.0)).alias("bulge")
    )
    return points.join(heads.withColumnRenamed("entity", "path_id"), ["file", "path_id"])


# Parts of a spline by group code, and the code that opens the values of one number.
SPLINE_PARTS = {"40": "knot", "10": "x", "20": "y", "30": "z", "11": "fit_x", "21": "fit_y", "31": "fit_z"}
SPLINE_OPENS = ["40", "10", "11"]


def dxf_splines(lines: DataFrame) -> DataFrame:
    """SPLINE rows in long form: (file, entity, layer, degree, flag, part, i, v) for knots, control and fit points.

    part is knot, x, y, z, fit_x, fit_y or fit_z; i numbers the knots, the control points and the fit points, so the
    coordinates of a point share it. A coordinate that the drawing leaves out has no row. ``splines_from_parts`` packs them.
    """
    items = materialize(dxf_items(lines).filter(F.col("kind") == "SPLINE").drop("kind"), "items")  # read twice
    heads = items.groupBy("file", "entity").agg(
        F.coalesce(F.max(_only("8")), F.lit("0")).alias("layer"),
        F.max(_only("71")).cast("int").alias("degree"),
        F.max(_only("70")).cast("int").alias("flag"),
    )
    run = F.when(F.col("code") == "40", "knot").when(F.col("code").isin("10", "20", "30"), "control").otherwise("fit")
    part = F.coalesce(*[F.when(F.col("code") == code, name) for code, name in SPLINE_PARTS.items()])
    rows = items.filter(F.col("code").isin(list(SPLINE_PARTS))).withColumns({"run": run, "part": part})
    opens = F.when(F.col("code").isin(SPLINE_OPENS), 1).otherwise(0).cast("bigint")
    rows = ordered_scan(rows, ["file", "entity", "run"], ["pair"], chunk_of("pair", PAIR_CHUNK), running={"i": opens})
    return rows.join(heads, ["file", "entity"]).select(
        "file", "entity", "layer", "degree", "flag", "part", "i", F.col("value").cast("double").alias("v")
    )


def splines_from_parts(parts: DataFrame) -> DataFrame:
    """One row per spline with its arrays of knots, control points and fit points; a point without z lies at 0."""
    keys = ["file", "entity", "layer", "degree", "flag"]
    own = {name: F.when(F.col("part") == name, F.col("v")) for name in SPLINE_PARTS.values()}
    have = [F.max(F.col("part") == name).alias("has_" + name) for name in ("knot", "x", "fit_x")]
    rows = parts.groupBy(*keys, "i").agg(*[F.max(v).alias(name) for name, v in own.items()], *have)

    def packed(name: str, opens: str, value: Column) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("has_" + opens), F.struct("i", value.alias("v")))))
        return F.transform(pairs, lambda p: p["v"]).alias(name)

    def point(x: str, y: str, z: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.coalesce(z, F.lit(0.0)).alias("z"))

    return rows.groupBy(*keys).agg(
        packed("knots", "knot", F.col("knot")), packed("ctrl", "x", point("x", "y", "z")), packed("fit", "fit_x", point("fit_x", "fit_y", "fit_z"))
    )


def dxf_polylines(vertices: DataFrame, groups: list[str]) -> DataFrame:
    """Polyline vertices (seq, x, y, bulge, flag) -> edges in pieces: straight runs and bulge arcs.

    Flag 1 closes the polyline with an edge back to its first vertex. Every arc is a piece of its
    own; straight edges between arcs share one.
    """
    vertices = materialize(vertices, "vertices")  # read twice
    rows = vertices.withColumn("chunk", chunk_of("seq"))
    rows = ordered_scan(
        rows, groups, ["seq"], "chunk", lead={"next": F.struct("x", "y")}, lag={"last_bulge": F.col("bulge")}
    )
    first = vertices.groupBy(*groups).agg(F.min_by(F.struct("x", "y"), "seq").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(first, groups)
    closing = (F.col("flag") == 1) & (F.col("n") > 1)
    rows = rows.withColumn("next", F.coalesce("next", F.when(closing, F.col("first")))).filter("next IS NOT NULL")
    arc = F.col("bulge") != 0
    after_arc = F.coalesce(F.col("last_bulge") != 0, F.lit(False))
    breaks = F.when(arc | after_arc | F.col("last_bulge").isNull(), 1).otherwise(0)
    rows = ordered_scan(rows.drop("first", "n"), groups, ["seq"], "chunk", running={"piece": breaks.cast("bigint")})
    return rows.select(
        *groups,
        "piece",
        "seq",
        F.when(arc, "arc").otherwise("line").alias("kind"),
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("next.x").alias("x2"),
        F.col("next.y").alias("y2"),
        "bulge",
    )


def dxf_layers(lines: DataFrame) -> DataFrame:
    """Distinct layer names per drawing: the code-8 value that follows an entity marker."""
    pairs = dxf_pairs(lines).drop("chunk").filter(
        (F.col("code") == "8") | ((F.col("code") == "100") & (F.col("value") == "AcDbEntity"))
    )
    rows = ordered_scan(pairs, ["file"], ["pair"], chunk_of("pair", PAIR_CHUNK), lag={"last_code": F.col("code")})
    return rows.filter("code = '8' AND last_code = '100'").select("file", F.col("value").alias("layer")).distinct()


def dxf_version(lines: DataFrame) -> DataFrame:
    """Header version per drawing and whether it is supported."""
    # The version stands three lines below its group code, two below its marker. The few marked
    # places are written, so the optimizer knows the table is small and no line is shuffled.
    at = match_line_sequence(lines, r"^\s*9\s*$", r"^\s*\$ACADVER\s*$").groupBy("file")
    at = materialize(at.agg((F.min("line_no") + 3).alias("line_no")), "versions")
    found = lines.join(at, ["file", "line_no"], "left_semi").select("file", F.trim("text").alias("version"))
    return found.withColumn("supported", F.col("version").isin(SUPPORTED_VERSIONS))


def extract_layers(geoms: DataFrame, layers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the named layers, all when none are named, optionally the first ``limit`` by id.

    Grouping by layer stays a later groupBy: rows of a layer are never packed into one value.
    """
    rows = geoms.filter(F.col("layer").isin(layers)) if layers else geoms
    return rows.orderBy("id").limit(limit) if limit is not None else rows
