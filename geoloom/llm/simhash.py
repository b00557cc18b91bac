"""SimHash near-duplicates: anchor-point covering of the fingerprints, then connected components.

A fingerprint of 64 bits is cut into blocks with thresholds t such that the sum of (t + 1) exceeds the
distance sought: of two fingerprints that link, some block differs in at most t bits. On each block a
covering code gives the anchors (a Hamming code of covering radius 1 beside free bits, or all values
where t is 0). Every fingerprint is at home at its nearest anchor and visits each anchor within radius
plus threshold that can be home to a partner, so linking pairs always meet at a home. Per anchor the
visitors are compared with the homes; of the links only a spanning forest leaves the task. An anchor
with very many homes is split by salt, its visitors going to each part.

Work for n distinct fingerprints: the first plan costs 35 rows each and n^2 / 21,000 comparisons, the
second 205 rows each and n^2 / 1,000,000; the cheaper one by the counted n is taken. Both are exact.

Defined cases: a null text has no words; a text without words has fingerprint zero and links like any
other; equal texts share a fingerprint; repeated ids are rows like others; a null id never is the
smallest (a component of null ids only has a null component_id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.names import free_names
from geoloom.plans.components import components
from geoloom.plans.scratch import materialize

WORDS, SEED, DISTANCE = 4, 42, 4
#: homes at one anchor and salt
HOMES = 4096
#: comparisons held at once
PAIRS = 2_000_000


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of whole ``text``."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    if len(ws) < WORDS:
        shingles, n = iter([b" ".join(ws)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(ws[k:] for k in range(WORDS)))), len(ws) - WORDS + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 65536):
        bits = np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def hex_digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@dataclass(frozen=True)
class Block:
    """``width`` bits from ``shift``, at most ``near`` of them differing; a Hamming code of 2^order - 1 bits, or none."""

    shift: int
    width: int
    near: int
    order: int

    @property
    def coded(self) -> int:
        return (1 << self.order) - 1 if self.order else 0

    def errors(self, weight: int) -> list[list[int]]:
        """By syndrome, the error patterns of at most ``weight`` bits."""
        out: list[list[int]] = [[] for _ in range(1 << self.order)]
        for w in range(weight + 1):
            for places in combinations(range(1, self.coded + 1), w):
                syndrome = mask = 0
                for p in places:
                    syndrome ^= p
                    mask |= 1 << (p - 1)
                out[syndrome].append(mask)
        return out

    def anchors(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Yields (places in ``fps``, anchors, whether it is their home)."""
        v = (fps.view(np.uint64) >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        every = np.arange(len(v))
        if not self.order:
            yield every, v, True
            return
        syndrome = np.zeros(len(v), dtype=np.int64)
        for p in range(1, self.coded + 1):
            syndrome ^= ((v >> np.uint64(p - 1)) & np.uint64(1)).astype(np.int64) * p
        free = [1 << p for p in range(self.coded, self.width)]
        for w in range(self.near + 1):
            flips = [sum(x) for x in combinations(free, w)]
            table = self.errors(1 + self.near - w)
            deep = max(map(len, table))
            masks = np.array([row + [-1] * (deep - len(row)) for row in table], dtype=np.int64)
            for k in range(deep):
                mask = masks[syndrome, k]
                some = np.flatnonzero(mask >= 0)
                at = v[some] ^ mask[some].astype(np.uint64)
                for flip in flips:
                    yield some, at ^ np.uint64(flip), w == 0 and k == 0


PLANS = {
    "three blocks": (Block(0, 24, 1, 4), Block(24, 24, 1, 4), Block(48, 16, 0, 0)),
    "two blocks": (Block(0, 33, 2, 5), Block(33, 31, 1, 5)),
}
_COSTS = {"three blocks": (35, 21e3), "two blocks": (205, 1.06e6)}


def choose_plan(n: int) -> str:
    """The plan with fewer rows plus comparisons for ``n`` fingerprints; a comparison counts a twentieth of a row."""
    return min(_COSTS, key=lambda p: _COSTS[p][0] * n + n * n / _COSTS[p][1] / 20)


VISIT = T.StructType().add("anchor", T.LongType()).add("fp", T.LongType()).add("visits", T.ByteType())
EDGE = T.StructType().add("u", T.LongType()).add("v", T.LongType())


def _dealer(plan: str):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for number, block in enumerate(PLANS[plan]):
                for some, at, home in block.anchors(fps):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(at.astype(np.int64) | (number << 40)),
                            pa.array(fps[some]),
                            pa.array(np.full(len(some), not home, dtype=np.int8)),
                        ],
                        names=VISIT.names,
                    )

    return deal


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component among these edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _comparer(distance: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and salt, homes first; homes of the last anchor are kept for the next batch."""
        kept_key, kept_fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        group = 0  # running number of the anchors, so that groups ascend over batches
        last = None
        for batch in batches:
            anchor, salt, visits, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if not len(fp):
                continue
            change = np.empty(len(fp), dtype=np.int64)
            change[0] = (anchor[0], salt[0]) != last
            change[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            key = group + np.cumsum(change)
            last, group = (anchor[-1], salt[-1]), int(key[-1])
            home = visits == 0
            keys, homes = np.concatenate([kept_key, key[home]]), np.concatenate([kept_fp, fp[home]])
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            size = high - low
            upto = np.cumsum(size)
            found_u, found_v = [], []
            start = 0
            while start < len(fp):
                before = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
                n = size[start:end]
                row = np.repeat(np.arange(start, end), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
                one, two = fp[row], homes[place]
                near = (np.bitwise_count((one ^ two).view(np.uint64)) <= distance) & (one != two)
                if near.any():
                    u, v = forest(one[near], two[near])
                    found_u.append(u)
                    found_v.append(v)
                start = end
            kept = keys == group
            kept_key, kept_fp = keys[kept], homes[kept]
            if found_u:
                u, v = forest(np.concatenate(found_u), np.concatenate(found_v))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=EDGE.names)

    return compare


def near_links(fps: DataFrame, distance: int = DISTANCE, plan: str | None = None) -> DataFrame:
    """A forest (u, v) that ties every two of the distinct fingerprints ``fp`` within ``distance`` bits.

    The plans hold for distances up to 4.
    """
    if distance > DISTANCE:
        raise ValueError("the anchor plans cover distances up to 4")
    if plan is None:
        plan = choose_plan(fps.count())
    visits = materialize(fps.select("fp").mapInArrow(_dealer(plan), VISIT), "visits")
    crowded = materialize(
        visits.where("visits = 0").groupBy("anchor").count().where(F.col("count") > HOMES)
        .select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts")), "crowded",
    )
    if crowded.isEmpty():
        spread = visits.withColumn("salt", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        spread = visits.join(crowded, "anchor", "left").withColumn(
            "salt",
            F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
                F.when(F.col("visits") == 0, F.array(own)).otherwise(every))),
        )
        # homes of a split anchor must meet the homes in its other parts too
        more = visits.where("visits = 0").join(crowded, "anchor").withColumn("salt", F.explode(every))
        more = more.where(F.col("salt") != own).withColumn("visits", F.lit(1).cast("byte"))
        spread = spread.select("anchor", "salt", "visits", "fp").unionByName(more.select("anchor", "salt", "visits", "fp"))
    met = spread.select("anchor", "salt", "visits", "fp").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "visits")
    return met.mapInArrow(_comparer(distance), EDGE)


def _rooted(fps: DataFrame, distance: int) -> DataFrame:
    """``fps`` (distinct fp, more) with the root fingerprint of each component, written."""
    linked = components(near_links(fps, distance)).withColumnRenamed("node", "fp")
    return materialize(fps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    marked = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    rooted = _rooted(fps, distance)
    lowest = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    placed = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "placed")
    return marked.join(placed, "fp").select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null last), then the smallest text hash.

    Rows are named by id and text, so rows that share an id but not a component are judged apart.
    """
    own_id, n1, n2, nth = free_names("id n1 n2 nth", docs)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row_id = F.col(f"`{doc_id}`")
    name = {own_id: F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.lit("?")), n1: F.xxhash64(body), n2: F.xxhash64(F.lit(1), body)}
    named = docs.select("*", *[c.alias(k) for k, c in name.items()])
    key = F.struct(row_id.isNull().alias("none"), row_id.alias("id"), *name)
    marked = materialize(named.select(key.alias("row"), fingerprints(F.col(f"`{text}`")).alias("fp")), "fingerprints")
    first = materialize(marked.groupBy("fp").agg(F.min("row").alias("row")), "distinct")
    kept = _rooted(first, distance).groupBy("root").agg(F.min("row").alias("row"))
    kept = materialize(kept.select(*(F.col("row")[k].alias(k) for k in name)), "kept")
    rank = Window.partitionBy(*name).orderBy(F.length(F.col(f"`{text}`")))
    met = named.join(kept, list(name)).withColumn(nth, F.row_number().over(rank)).where(F.col(nth) == 1)
    return met.select(*(F.col(f"`{c}`") for c in docs.columns))


def report(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
