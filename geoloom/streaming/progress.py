"""Progress over a live event stream.

``running_progress`` keeps one value per entity: what is certain up to the watermark, and the events after it, which
may still be joined by late ones. A batch reads and writes that value once per entity that has new rows and
puts out those entities only, each with the answer over all its events so far, whatever order they came in. An event-time
timer ends entities that stay silent.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "entity_id bigint, ts timestamp, state string, progress double"


def read_progress(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event files of a folder as a stream."""
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest state and clamped progress per entity; the state kept is one row per entity."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("progress")))
    latest = F.max(F.struct("ts", "state", clamped.alias("progress"))).alias("last")
    rows = events.groupBy("entity_id").agg(latest, F.count(F.lit(1)).alias("events"))
    return rows.select("entity_id", "last.ts", "last.state", "last.progress", "events")


def state_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per state and tumbling window; windows older than the watermark are closed and dropped."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = stamped.groupBy(F.window("ts", width), "state").agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("window.start").alias("start"), "state", "events")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain a stream into a written table and read it back.

    In ``complete`` mode every batch holds the whole result, so the newest batch folder is the
    answer; in ``append`` mode all batches together are.
    """
    spark = stream.sparkSession

    if mode == "append":
        query = (
            stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # found in the folder, so that a restart without new events still has the answer
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    batches = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={max(batches)}")


RUNNING_SCHEMA = (
    "entity_id bigint, ts timestamp, state string, progress double, events bigint, running_s double, left_s double, closed boolean"
)
_KEPT = "us bigint, state string, progress double, events bigint, running bigint, silent_at bigint, "
_KEPT += "late_us array<bigint>, late_state array<string>, late_progress array<double>"
_OUT = "entity_id bigint, us bigint, state string, progress double, events bigint, running bigint, closed boolean"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _folded(certain: tuple, events: list[tuple]) -> tuple:
    """(us, state, progress, events, running) after some events in order; an event's state lasts until the next one."""
    us, state, progress, n, running = certain
    for e in events:
        if state == "RUNNING":
            running += e[0] - us
        us, state, progress = e
        n += 1
    return us, state, progress, n, running


class EntityClock(StatefulProcessor):
    """The state of one entity: certain values, and the events that the watermark has not passed."""

    def __init__(self, idle_s: float | None):
        self.idle_ms = None if idle_s is None else int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", _KEPT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        certain, late, silent_at = (None, None, None, 0, 0), [], None
        if self.kept.exists():
            certain, silent_at, late = _read(self.kept.get())
        # of events at one time the last by state and progress counts, nulls first
        events = sorted(late + [(r.us, r.state, r.progress) for r in rows], key=_place)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        certain = _folded(certain, [e for e in events if e[0] <= passed])
        late = [e for e in events if e[0] > passed]
        now = _folded(certain, late)
        if self.idle_ms is not None:
            if silent_at is not None:
                self.handle.deleteTimer(silent_at)
            silent_at = now[0] // 1000 + self.idle_ms
            self.handle.registerTimer(silent_at)
        self.kept.update((*certain, silent_at, *(list(c) for c in zip(*late))) if late else (*certain, silent_at, [], [], []))
        yield _row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists():
            certain, _, late = _read(self.kept.get())
            self.kept.clear()
            yield _row(key, _folded(certain, late), True)

    def close(self) -> None:
        pass


def _read(kept: tuple) -> tuple[tuple, int | None, list[tuple]]:
    *certain, silent_at, us, states, progress = kept
    return tuple(certain), silent_at, list(zip(us or [], states or [], progress or []))


def _place(event: tuple) -> tuple:
    us, state, progress = event
    return us, state is not None, state or "", progress is not None, progress or 0.0


def _row(key, now: tuple, closed: bool) -> Row:
    us, state, progress, n, running = now
    return Row(entity_id=key[0], us=us, state=state, progress=progress, events=n, running=running, closed=closed)


def running_progress(events: DataFrame, estimate_s: float, late: str = "1 hour", idle_s: float | None = None) -> DataFrame:
    """Changed entities with state, clamped progress, seconds RUNNING and seconds left, as ``progress_summary`` has them.

    Rows up to ``late`` behind the newest one count wherever they belong; older ones are dropped. An entity
    silent for ``idle_s`` of event time is put out once more as closed and forgotten; later events begin
    it anew. Rows without an entity or time are left out. To be started by :func:`write_changes`.
    """
    stamped = events.where("entity_id is not null and ts is not null").withWatermark("ts", late)
    fed = stamped.select("entity_id", "ts", F.unix_micros("ts").alias("us"), "state", "progress")
    rows = fed.groupBy("entity_id").transformWithState(EntityClock(idle_s), _OUT, "update", "eventTime")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("progress")))
    left = F.when(F.col("state") == "COMPLETED", 0.0).otherwise((100.0 - clamped) / 100.0 * estimate_s)
    return rows.select(
        "entity_id", F.timestamp_micros("us").alias("ts"), "state", clamped.alias("progress"), "events",
        (F.col("running") / 1e6).alias("running_s"), left.alias("left_s"), "closed",
    )


def write_changes(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream of changed rows into one folder a batch; a batch that runs again replaces its folder."""
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)  # the store that processors with timers need
    try:
        query = (
            stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE[0]) if before is None else spark.conf.set(_STORE[0], before)


def latest_changes(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each entity among the changes written below ``path``."""
    rows = spark.read.schema(f"{RUNNING_SCHEMA}, batch bigint").parquet(path)
    columns = [c for c in rows.columns if c not in ("entity_id", "batch")]
    newest = F.max_by(F.struct(*columns), F.struct("batch", "closed")).alias("last")
    return rows.groupBy("entity_id").agg(newest).select("entity_id", "last.*")
