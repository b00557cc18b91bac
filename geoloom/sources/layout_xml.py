"""Layout files as node rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names fixed by the file format.
PLATE, DEVICE, LAYER, TILE, ROOT = "MRecipePlate", "MRecipeDevice", "MRecipeDeviceLayer", "MTileDescription", "MRecipe"

_MOVE = "TransformInfo struct<OffsetX:double,OffsetY:double,RotationDegZ:double,ScaleX:double,ScaleY:double>"
_ARRAY = "ArrayInfo struct<NumX:bigint,NumY:bigint,PitchX:double,PitchY:double>"
_TILE = f"TileDescriptions struct<{TILE}:array<struct<Index:bigint,CentreX:double,CentreY:double,XSize:double,YSize:double>>>"


def _inner(text: str) -> str:
    return text.replace(" ", ":", 1)


_BASE = f"Tag:string,{_inner(_MOVE)},{_inner(_ARRAY)}"
_LAYER = f"Layers struct<{LAYER}:array<struct<{_BASE},PatternFilePath:string,{_inner(_TILE)}>>>"
_DEVICE = f"Devices struct<{DEVICE}:array<struct<{_BASE},{_inner(_LAYER)}>>>"
SCHEMA = f"Tag string, {_MOVE}, {_ARRAY}, {_DEVICE}"


def _node(level: str, tag: Column, parent: Column, item: str) -> list[Column]:
    path = F.concat_ws("/", parent, tag)

    def at(name: str) -> Column:
        return F.col(f"{item}.{name}" if item else name)

    return [
        path.alias("node"),
        parent.alias("parent"),
        F.lit(level).alias("level"),
        at("TransformInfo.OffsetX").alias("off_x"),
        at("TransformInfo.OffsetY").alias("off_y"),
        F.coalesce(at("TransformInfo.RotationDegZ"), F.lit(0.0)).alias("rot_deg"),
        F.coalesce(at("TransformInfo.ScaleX"), F.lit(1.0)).alias("scale"),
        F.coalesce(at("ArrayInfo.NumX"), F.lit(1)).alias("num_x"),
        F.coalesce(at("ArrayInfo.NumY"), F.lit(1)).alias("num_y"),
        F.coalesce(at("ArrayInfo.PitchX"), F.lit(0.0)).alias("pitch_x"),
        F.coalesce(at("ArrayInfo.PitchY"), F.lit(0.0)).alias("pitch_y"),
    ]


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The plates of layout files, one nested row each."""
    return spark.read.option("rowTag", PLATE).schema(SCHEMA).xml(path)


def layout_nodes(plates: DataFrame) -> DataFrame:
    """Plate, device and layer rows with their parent's path; the nesting is unfolded in the row."""
    none = F.lit(None).cast("string")
    top = plates.select(*_node("plate", F.col("Tag"), none, ""))
    devices = plates.select(F.col("Tag").alias("plate"), F.explode(f"Devices.{DEVICE}").alias("d"))
    mid = devices.select(*_node("device", F.col("d.Tag"), F.col("plate"), "d"))
    layers = devices.select(F.concat_ws("/", "plate", "d.Tag").alias("device"), F.explode(f"d.Layers.{LAYER}").alias("l"))
    low = layers.select(*_node("layer", F.col("l.Tag"), F.col("device"), "l"))
    return top.unionByName(mid).unionByName(low)


def layout_tiles(plates: DataFrame) -> DataFrame:
    """Tile rows with their layer's path."""
    devices = plates.select(F.col("Tag").alias("plate"), F.explode(f"Devices.{DEVICE}").alias("d"))
    layers = devices.select("plate", F.col("d.Tag").alias("device"), F.explode(f"d.Layers.{LAYER}").alias("l"))
    tiles = layers.select(
        F.concat_ws("/", "plate", "device", "l.Tag").alias("parent"), F.explode(f"l.TileDescriptions.{TILE}").alias("t")
    )
    return tiles.select(
        "parent", F.col("t.Index").alias("tile"), F.col("t.CentreX").alias("centre_x"), F.col("t.CentreY").alias("centre_y"),
        F.col("t.XSize").alias("size_x"), F.col("t.YSize").alias("size_y"),
    )


def write_layout(nodes: DataFrame, path: str) -> None:
    """Write a three-level node table as layout files: one element per plate, with its devices and their layers.

    The format nests, so a plate and all below it are one row of the result.
    """

    def moved(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(
            "node_id", "parent_id",
            F.col("node_id").cast("string").alias("Tag"),
            F.struct(
                F.col("off_x").alias("OffsetX"), F.col("off_y").alias("OffsetY"), F.col("rot_deg").alias("RotationDegZ"),
                F.col("scale").alias("ScaleX"), F.col("scale").alias("ScaleY"),
            ).alias("TransformInfo"),
            F.struct(
                F.col("num_x").alias("NumX"), F.col("num_y").alias("NumY"), F.col("pitch_x").alias("PitchX"), F.col("pitch_y").alias("PitchY")
            ).alias("ArrayInfo"),
            *more,
        )

    layers = moved(nodes.filter("level = 'layer'"))
    packed = layers.groupBy("parent_id").agg(F.collect_list(F.struct("Tag", "TransformInfo", "ArrayInfo")).alias(LAYER))
    devices = moved(nodes.filter("level = 'device'")).join(packed.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    devices = devices.select(
        F.col("parent_id").alias("plate"),
        F.struct("Tag", "TransformInfo", "ArrayInfo", F.struct(LAYER).alias("Layers")).alias("device"),
    )
    nested = devices.groupBy("plate").agg(F.collect_list("device").alias(DEVICE))
    plates = moved(nodes.filter("level = 'plate'")).join(nested, F.col("node_id") == F.col("plate"), "left")
    rows = plates.select("Tag", "TransformInfo", "ArrayInfo", F.struct(DEVICE).alias("Devices"))
    rows.write.option("rowTag", PLATE).option("rootTag", ROOT).xml(path)
