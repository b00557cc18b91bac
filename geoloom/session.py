"""Session settings the engine expects; everything else is left to the cluster."""

from __future__ import annotations

import atexit
import re
import shutil

from pyspark.sql import SparkSession

from geoloom.plans.scratch import scratch_root

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "geoloom", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; its scratch tables go when the process ends."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    folder = re.sub("^file:/*", "/", scratch_root(session))
    if folder.startswith("/"):
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return session
