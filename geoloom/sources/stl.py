"""Mesh files as facet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.scan import chunk_of, ordered_scan
from geoloom.plans.scratch import qualified

FLAT = 1e-4
TASK_ROWS = 250_000  # vertex lines in a task
CORNERS = [f"{axis}{i}" for i in range(3) for axis in "xyz"]
_REAL = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
VERTEX = rf"^\s*vertex\s+({_REAL})\s+({_REAL})\s+({_REAL})"

# Layout of a binary mesh file: header bytes, then a 32-bit count, then records of fixed size.
HEADER_BYTES = 80
RECORD = [("normal", "<f4", 3), ("corners", "<f4", 9), ("attribute", "<u2")]


def _not_flat(limit: float) -> Column:
    return (F.greatest("z0", "z1", "z2") - F.least("z0", "z1", "z2")) > limit


def stl_ascii_facets(lines: DataFrame, flat: float = FLAT) -> DataFrame:
    """ASCII mesh text -> facets (file, facet_no, x0 .. z2), flat ones dropped.

    Vertex lines are numbered by a scan in chunks of the file; three in a row make a facet, which
    keeps its number whether or not flat facets before it were dropped. Mesh lines compress so well that
    tasks cut by shuffled bytes would hold millions of them, so the lines are counted first.
    """
    rows = lines.filter(F.col("text").rlike(VERTEX))
    parts = rows.count() // TASK_ROWS + 1
    rows = rows.withColumn("chunk", chunk_of("line_no")).repartition(parts, "file", "chunk")
    rows = ordered_scan(rows, ["file"], ["line_no"], "chunk", index="rn")
    at = F.col("rn") - 1
    xyz = [F.regexp_extract("text", VERTEX, i + 1).cast("double").alias(a) for i, a in enumerate("xyz")]
    rows = rows.select("file", "chunk", F.floor(at / 3).alias("facet_no"), (at % 3).alias("i"), *xyz)
    corners = [F.max(F.when(F.col("i") == int(c[1]), F.col(c[0]))).alias(c) for c in CORNERS]
    pieces = rows.groupBy("file", "chunk", "facet_no").agg(*corners).repartition(parts, "file", "facet_no")
    return pieces.groupBy("file", "facet_no").agg(*[F.max(c).alias(c) for c in CORNERS]).filter(_not_flat(flat))


def stl_binary_facets(spark: SparkSession, path: str, flat: float = FLAT, facets_per_task: int = 1 << 18) -> DataFrame:
    """Binary mesh files -> facets (file, facet_no, x0 .. z2).

    Files are listed by Spark and dealt to tasks in ranges of whole records, so a file of any size
    is read by many tasks.
    """
    record = _record().itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    held = F.expr(f"(length - {HEADER_BYTES + 4}) div {record}")
    starts = F.sequence(F.lit(0).cast("bigint"), held - 1, F.lit(facets_per_task).cast("bigint"))
    ranges = files.filter(held > 0).select("file", held.alias("held"), F.explode(starts).alias("first"))
    ranges = ranges.withColumn("count", F.least(F.lit(facets_per_task), F.col("held") - F.col("first")))
    schema = "file string, facet_no bigint, " + ", ".join(f"{c} double" for c in CORNERS)
    return ranges.repartition("file", "first").mapInPandas(_decoded, schema).filter(_not_flat(flat))


def _record():
    import numpy as np

    return np.dtype([(n, t, *([(s[0],)] if s else [])) for n, t, *s in RECORD])


def _opened(path: str):
    """File system and path within it."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _decoded(batches):
    import numpy as np
    import pandas as pd

    dtype, step = _record(), 1 << 16
    for batch in batches:
        for path, first, count in zip(batch["file"], batch["first"], batch["count"]):
            store, name = _opened(path)
            with store.open_input_file(name) as file:
                file.seek(HEADER_BYTES)
                told = int(np.frombuffer(file.read(4), "<u4")[0])
                end = min(first + count, told)  # bytes behind the told facets are none
                file.seek(HEADER_BYTES + 4 + first * dtype.itemsize)
                for start in range(first, end, step):
                    n = min(step, end - start)
                    records = np.frombuffer(file.read(n * dtype.itemsize), dtype, n)
                    out = pd.DataFrame(records["corners"].astype("f8"), columns=CORNERS)
                    out.insert(0, "facet_no", np.arange(start, start + n, dtype="i8"))
                    out.insert(0, "file", path)
                    yield out


def write_binary_stl(facets: DataFrame, path: str, facets_per_file: int = 65536) -> int:
    """Write facets (facet_id, x0 .. z2) as binary mesh files of bounded size; returns the file count.

    Each group of ids becomes one file, written by the task that holds it.
    """
    schema = "name string"
    folder = qualified(facets.sparkSession, path)
    keyed = facets.select("facet_id", *CORNERS).withColumn("part", F.floor(F.col("facet_id") / facets_per_file))

    def save(key, pdf):
        import numpy as np
        import pandas as pd

        dtype = _record()
        pdf = pdf.sort_values("facet_id")
        records = np.zeros(len(pdf), dtype)
        records["corners"] = pdf[CORNERS].to_numpy("f4")
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{key[0]}.stl"
        with store.open_output_stream(name) as out:
            out.write(b"\0" * HEADER_BYTES + np.uint32(len(pdf)).tobytes() + records.tobytes())
        return pd.DataFrame({"name": [name]})

    return keyed.groupBy("part").applyInPandas(save, schema).count()
