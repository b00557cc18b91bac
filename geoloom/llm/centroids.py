"""Centroid clustering in whole numbers, filtered by PCA-rotated coordinates.

Vectors and centroids are turned by the eigenvectors of the moments of all vectors. Stored with each vector
are its ``LEAD`` leading rotated coordinates and the norm of the rest. The squared distance of the leading
parts plus the squared difference of the rest norms never exceeds the true squared distance, so a vector
compares in whole numbers only with centroids whose bound, less an allowance for rounding, is not above the
best distance found so far. The answer is the plain one, ties to the smaller number, whatever the
rotation; only the number of full comparisons depends on it.

Every task adds up the vectors of each centroid before anything is shuffled, so a vector that fills a third of the table
costs no more than others; the driver sees the sums of ``k`` centroids and one matrix of moments.

Defined cases: vectors that are null, of another length, or with a null or non-finite component, or one of 2**62 or
more after scaling, are left out; equal ids and rows each count; vectors with a null id
are clustered but never start a centroid before others; with fewer vectors than centroids there are as many
centroids as vectors; a centroid without vectors stays; a distance beyond the range of a long is null, and so are the sums with it; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.plans.scratch import discard, materialize

CENTROIDS, ROUNDS, DIMS, SCALE, LEAD = 16, 3, 64, 64, 12
#: components below this take machine integers, larger ones Python's
SAFE = 1 << 26
_LIMIT = float(1 << 62)
_LONG = 1 << 63


def whole_vectors(docs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that are kept; v holds whole numbers."""
    scaled = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double") * scale)
    fits = F.forall("s", lambda x: F.coalesce(F.abs(x) < _LIMIT, F.lit(False)))  # not for NaN
    kept = docs.select(F.col(f"`{vec_id}`").alias("vec_id"), scaled.alias("s")).where(F.coalesce((F.size("s") == dims) & fits, F.lit(False)))
    return kept.select("vec_id", F.transform("s", lambda x: F.floor(x)).alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total += x.T @ x
        if total[-1, -1]:
            at = np.triu_indices(dims + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]), dtype=np.int32)), pa.array(total[at])], names=["at", "x"])

    return add


def rotation(vectors: DataFrame, dims: int = DIMS) -> np.ndarray:
    """Orthonormal columns, the direction of the largest variance first."""
    sums = vectors.select("v").mapInArrow(_moments(dims), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    full = np.zeros((dims + 1, dims + 1))
    rows, columns = np.triu_indices(dims + 1)
    for r in sums:
        full[rows[r["at"]], columns[r["at"]]] = r["x"]
    full = np.triu(full) + np.triu(full, 1).T
    n = max(full[-1, -1], 1.0)
    spread = full[:-1, :-1] / n - np.outer(full[-1, :-1], full[-1, :-1]) / n**2
    if not np.isfinite(spread).all():
        return np.eye(dims)
    return np.linalg.eigh(spread)[1][:, ::-1]


def project(x: np.ndarray, turn: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and the norm of the others."""
    y = x.astype(np.float64) @ turn
    return y[:, :lead], np.sqrt((y[:, lead:] ** 2).sum(axis=1))


def _projector(turn: np.ndarray, lead: int, dims: int, schema: T.StructType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, rest = project(_matrix(batch.column(1), dims), turn, lead)
            coords = pa.ListArray.from_arrays(np.arange(0, near.size + 1, lead, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, coords, pa.array(rest)], names=schema.names)

    return work


def nearest(v: np.ndarray, near: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of each vector, and how many distances were worked out in full."""
    c_near, c_rest = project(centroids, turn, near.shape[1])
    bound = np.empty((len(v), len(centroids)))
    for k in range(len(centroids)):
        bound[:, k] = ((near - c_near[k]) ** 2).sum(axis=1) + (rest - c_rest[k]) ** 2
    norms = ((near**2).sum(axis=1) + rest**2)[:, None] + (c_near**2).sum(axis=1) + c_rest**2
    bound -= 1e-9 * norms  # far above what rounding can add
    order = np.argsort(bound, axis=1, kind="stable")
    big = max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) >= SAFE
    if big:
        v, centroids = v.astype(object), centroids.astype(object)
    best, number = np.zeros(len(v), dtype=object if big else np.int64), np.full(len(v), -1, dtype=np.int64)
    full = 0
    left = np.arange(len(v))
    for step in range(len(centroids)):  # by rising bound; a vector is done when its next bound is above its best
        pick = order[left, step]
        if step:
            open_ = bound[left, pick] <= best[left].astype(np.float64) * (1 + 1e-12)
            left, pick = left[open_], pick[open_]
        if not len(left):
            break
        full += len(left)
        distance = ((v[left] - centroids[pick]) ** 2).sum(axis=1)
        better = (number[left] < 0) | (distance < best[left]) | ((distance == best[left]) & (pick < number[left]))
        best[left[better]], number[left[better]] = distance[better], pick[better]
    return number, best, full


def _adder(centroids: np.ndarray, turn: np.ndarray, dims: int, lead: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dims + 1), dtype=object)
        for batch in batches:
            v = _matrix(batch.column(0), dims)
            number, _, _ = nearest(v, _matrix(batch.column(1), lead), batch.column(2).to_numpy(), centroids, turn)
            for k in np.unique(number):
                own = v[number == k]
                if np.abs(own).max() < SAFE:
                    total = own.sum(axis=0)  # a batch has far fewer than 2**36 rows
                else:
                    total = own.astype(object).sum(axis=0)
                sums[k, :-1] += total.astype(object)
                sums[k, -1] += len(own)
        for k in np.flatnonzero(sums[:, -1]):
            at = pa.array(np.arange(dims + 1, dtype=np.int32))
            values = pa.array([Decimal(int(x)) for x in sums[k]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims + 1, k, dtype=np.int32)), at, values], names=["k", "at", "x"])

    return add


def _assigner(centroids: np.ndarray, turn: np.ndarray, dims: int, lead: int):
    names = np.array([hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids], dtype=object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, best, _ = nearest(_matrix(batch.column(1), dims), _matrix(batch.column(2), lead), batch.column(3).to_numpy(), centroids, turn)
            distance = pa.array([int(x) if x < _LONG else None for x in best] if best.dtype == object else best, pa.int64())
            columns = [batch.column(0), pa.array(number.astype(np.int32)), distance, pa.array(names[number] if len(number) else [], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "centroid_sha256"])

    return assign


def cluster(
    docs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS,
    scale: int = SCALE, lead: int = LEAD,
) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): rows of vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = materialize(whole_vectors(docs, vec_id, embedding, dims, scale), "vectors")
    lead = min(lead, dims)
    turn = rotation(vectors, dims)
    schema = T.StructType([*vectors.schema.fields, T.StructField("near", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])
    turned = materialize(vectors.mapInArrow(_projector(turn, lead, dims, schema), schema), "turned")
    discard(vectors)
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = turned.select("v", mark.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    out = T.StructType([turned.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                        T.StructField("centroid_sha256", T.StringType())])
    centroids = [[int(x) for x in r["v"]] for r in first]
    for _ in range(rounds if centroids else 0):
        added = turned.select("v", "near", "rest").mapInArrow(_adder(_table(centroids), turn, dims, lead), "k int, at int, x decimal(38,0)")
        sums = {(r["k"], r["at"]): int(r["x"]) for r in added.groupBy("k", "at").agg(F.sum("x").alias("x")).collect()}
        for c in {c for c, _ in sums}:
            centroids[c] = [sums[c, d] // sums[c, dims] for d in range(dims)]
    if not centroids:
        assigned = docs.sparkSession.createDataFrame([], out)
    else:
        assigned = materialize(turned.select("vec_id", "v", "near", "rest").mapInArrow(_assigner(_table(centroids), turn, dims, lead), out), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    fits = F.when((F.count("*") == F.count("distance")) & (total < F.lit(_LIMIT * 2)), total.cast("long"))
    each = assigned.groupBy("cluster").agg(fits.alias("cluster_inertia"))
    whole = Window.partitionBy(F.lit(0))  # over the k rows of clusters
    known = F.count("*").over(whole) == F.count("cluster_inertia").over(whole)
    summed = F.sum(F.col("cluster_inertia").cast("decimal(38,0)")).over(whole)
    each = each.withColumn("inertia", F.when(known & (summed < F.lit(_LIMIT * 2)), summed.cast("long")))
    rows = assigned.join(F.broadcast(each), "cluster")  # k rows at most
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def _table(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, dtype=np.int64)


def report(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))[0]


def _sql() -> str:
    """The same by long tables (vector, component), one round after the other; only finite vectors of moderate size."""
    steps = [
        f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
x AS MATERIALIZED (SELECT r, i, CAST(v[i] AS BIGINT) AS a FROM e, unnest(range(1, {DIMS + 1})) t(i)),
p AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k FROM e),
c0 AS MATERIALIZED (SELECT k, i, a FROM p JOIN x USING (r) WHERE k < {CENTROIDS})"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT x.r, c.k, sum((x.a - c.a) * (x.a - c.a)) AS d FROM x JOIN c{n} AS c USING (i) GROUP BY x.r, c.k)")
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{n} GROUP BY r)")
        if n < ROUNDS:
            steps.append(f"m{n} AS (SELECT k, i, sum(a) AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, i)")
            down = "(s - ((s % n) + n) % n) // n"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN a ELSE CAST({down} AS BIGINT) END AS a FROM c{n} LEFT JOIN m{n} USING (k, i))")
    return ",\n".join(steps) + f""",
h AS (SELECT k, sha256(string_agg(CAST(a AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN h USING (k)"""


SQL = _sql()
