"""State, running time and time left of processed entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.scan import ordered_scan


def progress_summary(events: DataFrame, estimate_s: float) -> DataFrame:
    """Latest state, clamped progress, seconds RUNNING and seconds left per entity, then overall.

    An event's state lasts until the entity's next event. Of events at the same time the last by state
    and progress counts. The overall row has no entity; its time left is the sum of what the entities
    still need.
    """
    stamped = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = F.floor(F.col("us") / F.lit(3_600_000_000))
    rows = ordered_scan(stamped, ["entity_id"], ["us", "state", "progress"], hour, lead={"until": F.col("us")})
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("last.progress")))
    running = F.when(F.col("state") == "RUNNING", F.col("until") - F.col("us"))
    per = rows.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.max(F.struct("us", "state", "progress")).alias("last"),
        F.coalesce(F.sum(running) / 1e6, F.lit(0.0)).alias("running_s"),
    )
    left = F.when(F.col("state") == "COMPLETED", 0.0).otherwise((100.0 - F.col("progress")) / 100.0 * estimate_s)
    per = per.select("entity_id", "events", F.col("last.state").alias("state"), clamped.alias("progress"), "running_s").withColumn("left_s", left)
    total = per.agg(
        F.sum("events").alias("events"), F.avg("progress").alias("progress"), F.sum("running_s").alias("running_s"), F.sum("left_s").alias("left_s")
    ).select(
        F.lit(None).cast("bigint").alias("entity_id"), "events", F.lit("ALL").alias("state"), "progress", "running_s", "left_s"
    )
    return per.unionByName(total)
