"""Text files as rows (file, line_no, text), and matching over runs of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import materialize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their 0-based number in the file.

    Files are split like any text source, so one huge file is read by many tasks. A line is
    known by its block's offset in the file and its place in the block; line counts per block,
    one small row each, turn that into the number in the file. They are written, so the optimizer knows how few they
    are and shuffles no line.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("lines").over(before), F.lit(0))).drop("lines")
    blocks = materialize(blocks, "blocks")
    # both passes must cut the files alike: a line of a block that was not counted, or by another task, ends the query
    same = F.shiftright("at", 33) == F.shiftright("first", 33)
    place = F.when(same, F.col("base") + F.col("at") - F.col("first")).otherwise(F.raise_error(F.lit("files were cut anew between two passes")))
    return raw.join(blocks, ["file", "block"], "left").select("file", place.alias("line_no"), "text")


def match_line_sequence(lines: DataFrame, first: str, second: str) -> DataFrame:
    """Places where a line matching ``first`` is directly followed by one matching ``second``."""
    # only lines that match either pattern are shuffled; neighbours differ by one line number
    marks = lines.filter(F.col("text").rlike(first) | F.col("text").rlike(second))
    rows = ordered_scan(
        marks, ["file"], ["line_no"], chunk_of("line_no"), lead={"next": F.struct("line_no", F.col("text").alias("next_text"))}
    )
    follows = F.col("next.line_no") == F.col("line_no") + 1
    return rows.filter(F.col("text").rlike(first) & follows & F.col("next.next_text").rlike(second)).select(
        "file", "line_no", "text", "next.next_text"
    )


def first_match_until(lines: DataFrame, target: str, stop: str | None = None) -> DataFrame:
    """First matching line of each file, if it comes before the first line matching ``stop``."""
    hit = F.col("text").rlike(target)
    ends = F.col("text").rlike(stop) if stop else F.lit(False)
    found = lines.filter(hit | ends).groupBy("file").agg(
        F.min(F.when(hit, F.struct("line_no", "text"))).alias("hit"), F.min(F.when(ends, F.col("line_no"))).alias("stop")
    )
    before = F.col("stop").isNull() | (F.col("hit.line_no") < F.col("stop"))
    return found.filter(F.col("hit").isNotNull() & before).select("file", "hit.line_no", "hit.text")


def each_match_until(lines: DataFrame, start: str, target: str) -> DataFrame:
    """For every line matching ``start``, the next line from there on that matches ``target``."""
    marks = lines.filter(F.col("text").rlike(start) | F.col("text").rlike(target))
    rows = marks.withColumn("neg", -F.col("line_no"))
    rows = ordered_scan(
        rows, ["file"], ["neg"], chunk_of("neg"), fill={"next_line": F.when(F.col("text").rlike(target), F.col("line_no"))}
    )
    return rows.filter(F.col("text").rlike(start) & F.col("next_line").isNotNull()).select("file", "line_no", "next_line")


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """A number taken out of a text, null when the pattern does not match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).cast("double")
