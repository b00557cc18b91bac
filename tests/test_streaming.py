"""Running time over a stream: late rows, restarts, silence, and what a batch writes."""

import random
from datetime import datetime, timedelta

import pytest

from geoloom.operators.progress import progress_summary
from geoloom.streaming import progress as live

START = datetime(2024, 1, 1)
STATES = ["RUNNING", "PAUSED", "RUNNING", "COMPLETED", None]


def events(n, entities, seed):
    rng = random.Random(seed)
    return [(rng.randrange(entities), START + timedelta(seconds=60 * k + rng.randrange(50)), rng.choice(STATES), rng.uniform(-5, 120)) for k in range(n)]


def deliver(spark, rows, path):
    spark.createDataFrame(rows, live.SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(spark, tmp, **more):
    stream = live.running_progress(live.read_progress(spark, f"{tmp}/in"), 600.0, **more)
    live.write_changes(stream, f"{tmp}/out", f"{tmp}/log")


def written(spark, tmp):
    return spark.read.parquet(f"{tmp}/out")


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)


def test_equals_the_batch_operator_with_late_rows(spark, tmp):
    rows = events(300, 7, 1)
    rows += [rows[5], rows[9]]  # repeated
    late = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=random.Random(str(r)).randrange(60))))
    for a in range(0, len(late), 101):
        deliver(spark, late[a : a + 101], f"{tmp}/in")
        drain(spark, tmp, late="2 hours")
    got = {r.entity_id: r for r in live.latest_changes(spark, f"{tmp}/out").collect()}
    want = progress_summary(spark.createDataFrame(rows, live.SCHEMA), 600.0).where("entity_id is not null").collect()
    assert len(got) == len(want)
    for w in want:
        g = got[w.entity_id]
        assert (g.events, g.state, g.closed) == (w.events, w.state, False)
        assert (g.progress, g.running_s, g.left_s) == pytest.approx((w.progress, w.running_s, w.left_s))


def test_a_batch_writes_changed_entities_only(spark, tmp):
    deliver(spark, events(100, 10, 2), f"{tmp}/in")
    drain(spark, tmp)
    more = [(3, START + timedelta(hours=2), "RUNNING", 5.0), (4, START + timedelta(hours=2), "PAUSED", 6.0)]
    deliver(spark, more, f"{tmp}/in")
    drain(spark, tmp)
    by_batch = {r.batch: r["count"] for r in written(spark, tmp).groupBy("batch").count().collect()}
    assert by_batch[0] == 10 and sorted(by_batch.values())[:-1] == [2] * (len(by_batch) - 1)
    drain(spark, tmp)  # nothing new
    assert written(spark, tmp).count() == 12


def test_silent_entities_close_and_begin_anew(spark, tmp):
    at = lambda m: START + timedelta(minutes=m)
    deliver(spark, [(1, at(0), "RUNNING", 10.0), (1, at(5), "RUNNING", 20.0), (2, at(6), "RUNNING", 1.0)], f"{tmp}/in")
    drain(spark, tmp, late="1 minute", idle_s=600.0)
    deliver(spark, [(2, at(30), "RUNNING", 50.0)], f"{tmp}/in")
    drain(spark, tmp, late="1 minute", idle_s=600.0)
    deliver(spark, [(2, at(31), "PAUSED", 60.0)], f"{tmp}/in")
    drain(spark, tmp, late="1 minute", idle_s=600.0)
    rows = written(spark, tmp).where("closed").collect()
    assert [(r.entity_id, r.running_s) for r in rows] == [(1, 300.0)]
    deliver(spark, [(1, at(40), "RUNNING", 0.0), (1, at(10), "RUNNING", 0.0)], f"{tmp}/in")  # the second is too late
    drain(spark, tmp, late="1 minute", idle_s=600.0)
    got = {r.entity_id: (r.events, r.running_s, r.closed) for r in live.latest_changes(spark, f"{tmp}/out").collect()}
    assert got[1] == (1, 0.0, False) and got[2][:2] == (3, 25 * 60.0)


def test_rows_without_entity_or_time(spark, tmp):
    deliver(spark, [(None, START, "RUNNING", 1.0), (1, None, "RUNNING", 1.0), (2, START, None, None)], f"{tmp}/in")
    drain(spark, tmp)
    got = live.latest_changes(spark, f"{tmp}/out").collect()
    assert [(r.entity_id, r.events, r.state, r.running_s) for r in got] == [(2, 1, None, 0.0)]
