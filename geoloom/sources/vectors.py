"""Flat vector records as geometry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors_to_geometry(vectors: DataFrame) -> DataFrame:
    """Vector records (type, coordinates, colour) -> geometry rows with only their kind's columns set."""
    kind = F.lower("type")

    def of(*kinds: str):
        return kind.isin(*kinds)

    line, round_ = of("line"), of("arc", "circle")
    return vectors.filter(of("line", "arc", "circle", "point")).select(
        "id",
        kind.alias("kind"),
        F.col("colour").alias("stroke"),
        *[F.when(line, F.col(c)).alias(n) for c, n in (("x_start", "x1"), ("y_start", "y1"), ("x_end", "x2"), ("y_end", "y2"))],
        *[F.when(~line, F.col(c)).alias(n) for c, n in (("x_center", "cx"), ("y_center", "cy"))],
        F.when(round_, F.col("radius")).alias("r"),
        F.when(of("arc"), F.col("start_angle")).alias("a0"),
        F.when(of("arc"), F.col("end_angle")).alias("a1"),
    )


def vector_groups_to_geometry(groups: DataFrame) -> DataFrame:
    """Groups (display_colour, pattern array) -> geometry rows that carry their group's colour."""
    rows = groups.select(F.col("display_colour").alias("colour"), F.inline("pattern"))
    return vectors_to_geometry(rows)
