"""Drill programs as header rows, hits and circles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import materialize
from geoloom.sources.lines import number

# Commands and number forms fixed by the file format.
NUMBER = r"(-?(?:\d+(?:\.\d+)?|\.\d+))"
X_VALUE = "X" + NUMBER
Y_VALUE = "Y" + NUMBER
HIT = r"^\s*[XY]"
UNITS = r"^\s*(INCH|METRIC)"
TOOL_DEFINITION = r"^\s*(T\d+)C(\d+(?:\.\d+)?|\.\d+)"
TOOL = r"^\s*(T\d+)"
END_OF_HEADER = r"^\s*M95"
END_OF_FILE = r"^\s*M30"
ROUTE_ON = r"^\s*G00"
DRILL_ON = r"^\s*(?:G81|G05)"
BLOCK_BEGIN = r"^\s*M25"
BLOCK_END = r"^\s*M01"
REPEAT = r"^\s*M02"
REPEATS_DONE = r"^\s*M08"
DEFAULT_DIAMETER = 0.1


def _text(pattern: str, group: int = 1):
    found = F.regexp_extract("text", pattern, group)
    return F.when(found != "", found)


def _marks(lines: DataFrame) -> DataFrame:
    """First hit, end-of-file and end-of-header line of each file; line numbers only, written once."""
    t, no = F.col("text"), F.col("line_no")
    hit, stop = t.rlike(HIT), t.rlike(END_OF_FILE)
    found = lines.filter(hit | stop | t.rlike(END_OF_HEADER)).groupBy("file").agg(
        F.min(F.when(hit, no)).alias("hit"), F.min(F.when(stop, no)).alias("stop"), F.min(F.when(~stop, no)).alias("end")
    )
    return materialize(found, "marks")


def _header_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Header-like lines before the first hit or the end-of-header mark, written once."""
    head = lines.filter(F.col("text").rlike(r"^\s*(INCH|METRIC|VER,|FMAT,|T\d+C)"))
    head = head.join(marks.select("file", "end"), "file", "left").filter("end IS NULL OR line_no < end")
    return materialize(head.drop("end"), "header")


def _tools(head: DataFrame) -> DataFrame:
    return (
        head.filter(F.col("text").rlike(TOOL_DEFINITION))
        .groupBy("file", _text(TOOL_DEFINITION).alias("tool"))
        .agg(F.max_by(number(F.col("text"), TOOL_DEFINITION, 2), "line_no").alias("diameter"))
    )


def drill_tools(lines: DataFrame) -> DataFrame:
    """(file, tool, diameter) from the header; the last definition of a tool counts."""
    return _tools(_header_lines(lines, _marks(lines)))


def drill_header(lines: DataFrame) -> DataFrame:
    """Units, zero suppression, version, format, tool map and unit scale of every file."""
    return drill_facts(lines)[0]


def drill_facts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header rows and tool rows of every file, from two passes over the lines."""
    marks = _marks(lines)
    head = _header_lines(lines, marks)
    facts = head.groupBy("file").agg(
        F.max_by(_text(UNITS), F.when(F.col("text").rlike(UNITS), F.col("line_no"))).alias("units"),
        F.max(F.when(F.col("text").rlike(UNITS), _text(r"(TZ|LZ)\s*$"))).alias("zeros"),
        F.max(number(F.col("text"), r"^\s*VER,\s*(\d+)")).cast("int").alias("version"),
        F.max(number(F.col("text"), r"^\s*FMAT,\s*(\d+)")).cast("int").alias("format"),
    )
    tools = _tools(head)
    maps = tools.groupBy("file").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "diameter")))).alias("tools")
    )
    # the text of each file's first hit: one known place per file, met while scanning
    at = marks.filter("stop IS NULL OR hit < stop").select("file", F.col("hit").alias("line_no"))
    first = lines.join(at, ["file", "line_no"]).select("file", F.col("text").alias("hit"))
    digits = F.length(F.regexp_replace(F.regexp_extract("hit", "[XY]" + NUMBER, 1), "-", ""))
    scale = (
        F.when(F.col("hit").isNull(), 1.0)
        .when(F.col("units") == "INCH", 1.0 / 10000)
        .when(digits <= 5, 1.0 / 100)
        .otherwise(1.0 / 1000)
    )
    header = facts.join(maps, "file", "left").join(first, "file", "left").withColumn("scale", scale).drop("hit")
    return materialize(header, "headers"), tools


def drill_commands(lines: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Every line with the modal state that holds there, in one scan.

    x, y: last coordinates given by a hit or a route move, 0 at the start. tool: last tool
    selected; with a tool table only its tools count. routing: between route-on and drill-on.
    block: line of the open or last pattern, null when none. tracking: inside a pattern.
    """
    t = F.col("text")
    hit, route = t.rlike(HIT), t.rlike(ROUTE_ON)
    rows = lines.withColumn("pick", F.when(~hit, _text(TOOL)))
    if tools is None:
        rows = rows.withColumn("known", F.col("pick").isNotNull())
    else:
        known = tools.select("file", F.col("tool").alias("pick"), F.lit(True).alias("known"))
        rows = rows.join(known, ["file", "pick"], "left")
    moves = hit | route
    begin, end = t.rlike(BLOCK_BEGIN), t.rlike(BLOCK_END)
    rows = ordered_scan(
        rows, ["file"], ["line_no"], chunk_of("line_no"),
        fill={
            "x": F.when(moves, number(t, X_VALUE)),
            "y": F.when(moves, number(t, Y_VALUE)),
            # the line of the selection: of fixed width, which keeps the chunk totals in the hash aggregate
            "picked": F.when(F.col("known"), F.col("line_no")),
            "routing": F.when(route, True).when(t.rlike(DRILL_ON), False),
            "block": F.when(begin, F.col("line_no")).when(t.rlike(REPEATS_DONE), F.lit(None)),
            "done": F.when(t.rlike(REPEATS_DONE), F.col("line_no")),
            "tracking": F.when(begin, True).when(end, False),
        },
    )
    names = lines.select("file", F.col("line_no").alias("picked"), _text(TOOL).alias("tool")).filter("tool IS NOT NULL")
    rows = rows.join(names, ["file", "picked"], "left")
    open_block = F.when(F.col("done").isNull() | (F.col("block") > F.col("done")), F.col("block"))
    return rows.select(
        "file", "line_no", "text",
        F.coalesce("x", F.lit(0.0)).alias("x"),
        F.coalesce("y", F.lit(0.0)).alias("y"),
        F.coalesce("tool", F.lit("0")).alias("tool"),
        F.coalesce("routing", F.lit(False)).alias("routing"),
        open_block.alias("block"),
        F.coalesce("tracking", F.lit(False)).alias("tracking"),
    )


def drill_hits(lines: DataFrame, tools: DataFrame | None = None, scales: DataFrame | None = None, repeats: bool = True) -> DataFrame:
    """Hits (file, line_no, copy, x, y, tool, diameter): modal coordinates, routing dropped.

    Hits of a step-and-repeat pattern come again at each cumulative offset (copy 1, 2, ..). With
    ``scales`` (file, scale) coordinates are in the file's unit.
    """
    # Written tables: the optimizer knows their size, so it broadcasts tools and scales only while
    # they are small; and the state of hits and repeats, read several times below, is made once.
    tools = materialize(tools, "tools") if tools is not None else None
    scales = materialize(scales.select("file", "scale"), "scales") if scales is not None else None
    state = drill_commands(lines, tools)
    state = materialize(state.filter(F.col("text").rlike(HIT) | F.col("text").rlike(REPEAT)), "drill")
    hits = state.filter(F.col("text").rlike(HIT) & ~F.col("routing"))
    out = hits.withColumn("copy", F.lit(0).cast("bigint"))
    if repeats:
        steps = state.filter(F.col("text").rlike(REPEAT) & F.col("block").isNotNull()).select(
            "file", "block", F.col("line_no").alias("at"),
            number(F.col("text"), X_VALUE).alias("dx"), number(F.col("text"), Y_VALUE).alias("dy"),
        )
        steps = steps.filter("dx IS NOT NULL OR dy IS NOT NULL")
        steps = ordered_scan(
            steps, ["file", "block"], ["at"], chunk_of("at"), index="nth",
            running={"sx": F.coalesce("dx", F.lit(0.0)), "sy": F.coalesce("dy", F.lit(0.0))},
        ).select("file", "block", "at", "nth", "sx", "sy")
        again = hits.filter("tracking AND block IS NOT NULL").join(steps, ["file", "block"]).filter("at > line_no")
        again = again.withColumns({"x": F.col("x") + F.col("sx"), "y": F.col("y") + F.col("sy"), "copy": F.col("nth")})
        out = out.unionByName(again.select(*out.columns))
    if tools is not None:
        out = out.join(tools, ["file", "tool"], "left")
    else:
        out = out.withColumn("diameter", F.lit(None).cast("double"))
    if scales is not None:
        out = out.join(scales, "file", "left")
        s = F.coalesce(F.col("scale"), F.lit(1.0))
        out = out.withColumns({"x": F.col("x") * s, "y": F.col("y") * s})
    return out.select(
        "file", "line_no", "copy", "x", "y", "tool", F.coalesce("diameter", F.lit(DEFAULT_DIAMETER)).alias("diameter")
    )


def drill_circles(hits: DataFrame) -> DataFrame:
    """Each hit as a circle of half the tool diameter."""
    return hits.select(
        "file", "line_no", "copy", F.lit("circle").alias("kind"), F.col("x").alias("cx"), F.col("y").alias("cy"),
        (F.col("diameter") / 2).alias("r"), "tool",
    )
