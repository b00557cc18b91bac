"""File formats as data sources: ranges that cut records, pruning, and a writer that leaves only committed files."""

import os

import pytest
from pyspark.sql import functions as F

from geoloom.sources import datasource as ds
from geoloom.sources.stl import CORNERS


@pytest.fixture(scope="module")
def session(spark):
    return ds.register(spark)


def drawing(n):
    out = ["0", "SECTION", "2", "ENTITIES"]
    for k in range(n):
        # a layer named 0 and a value 0: neither is a start
        out += ["0", "LINE", "8", ["0", "a"][k % 2], "10", str(k), "20", "0", "11", "0", "21", f"{k}.5"]
        out += ["  0 ", "CIRCLE", "8", "b", "10", "0", "20", str(k), "40", "2"] if k % 3 == 0 else ["0", "TEXT", "1", "LINE"]
    return "\r\n".join([*out, "0", "ENDSEC", "0", "EOF"]) + "\r\n"


@pytest.mark.parametrize("step", [7, 64, 1000, 1 << 20])
def test_drawing_ranges(session, tmp_path, step):
    (tmp_path / "a.dxf").write_text(drawing(20), newline="")
    (tmp_path / "_hidden.dxf").write_text(drawing(3), newline="")
    rows = session.read.format("dxf").option("rangeBytes", step).load(str(tmp_path)).orderBy("at").collect()
    assert [(r.layer, r.x1, r.y2) for r in rows if r.kind == "LINE"] == [("0a"[k % 2], float(k), k + 0.5) for k in range(20)]
    assert [(r.layer, r.y1, r.r) for r in rows if r.kind == "CIRCLE"] == [("b", float(k), 2.0) for k in range(0, 20, 3)]


def test_pruning(session, tmp_path):
    (tmp_path / "a.dxf").write_text(drawing(6), newline="")
    some = session.read.format("dxf").options(columns="layer,x1", layers="a,b").load(str(tmp_path))
    assert some.columns == ["layer", "x1"] and {r.layer for r in some.collect()} == {"a", "b"}
    session.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = session.read.format("dxf").option("pushFilters", "true").load(str(tmp_path)).where(F.col("layer") == "b")
        assert {r.layer for r in pushed.collect()} == {"b"}
    finally:
        session.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("step", [30, 1 << 20])
def test_mesh_round_trip(session, tmp_path, step):
    rows = [[float(x) for x in (k, 0, 0, k, 1, 0, k, 0, 1 + k % 5)] for k in range(50)] + [[1.0, 1, 2, 1, 3, 2, 4, 1, 2]]
    facets = session.createDataFrame([[float(x) for x in r] for r in rows], [*CORNERS]).repartition(3)
    path = str(tmp_path / "out")
    facets.write.format("stl").mode("append").save(path)
    back = session.read.format("stl").option("rangeBytes", step).load(path).select(*CORNERS).collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, rows[:-1]))  # the flat one is no facet
    facets.limit(4).write.format("stl").mode("overwrite").save(path)
    assert session.read.format("stl").load(path).count() <= 4 and all(f.endswith(".stl") for f in os.listdir(path))


def test_drill_lines_and_odd_files(session, tmp_path):
    (tmp_path / "a.drl").write_bytes(b"M48\n\nT1\r\nX1Y2")
    (tmp_path / "b.drl").write_bytes(b"")
    for step in (3, 100):
        rows = session.read.format("drill").option("rangeBytes", step).load(str(tmp_path)).orderBy("at").collect()
        assert [(r.at, r.text) for r in rows] == [(0, "M48"), (5, "T1"), (9, "X1Y2")]
    (tmp_path / "none").mkdir()
    assert session.read.format("dxf").load(str(tmp_path / "none")).collect() == []


def test_only_committed_files_stay(tmp_path):
    """The tasks' files by hand: one task runs twice, one fails half way, one job is given up."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["0", "EOF"]})

    def failing():
        yield batch
        raise OSError("lost")

    job = ds.LineWriter({"path": str(tmp_path)}, overwrite=False)
    first, again, empty = job.write(iter([batch])), job.write(iter([batch])), job.write(iter([]))
    with pytest.raises(OSError):
        job.write(failing())
    job.commit([again, None, empty])
    assert first.name != again.name and [f.split("-", 2)[2] for f in os.listdir(tmp_path)] == [again.name]
    other = ds.LineWriter({"path": str(tmp_path)}, overwrite=False)
    other.write(iter([batch]))
    other.abort([])
    assert len(os.listdir(tmp_path)) == 1
