"""Mixing sources to target weights by Pfair scheduling of their blocks.

Each source's rows, in a fixed shuffled order, are cut into blocks. A target weight is taken as the exact
fraction that the number stands for; with weights p / P the k-th block of a source is released at slot
floor((k - 1) P / p) and due by slot ceil(k P / p). The earliest deadline of the released blocks takes each
slot, so after every slot each source is less than one block from its exact share, however long the schedule.

The slots are scheduled in chunks by as many tasks. What earliest-deadline-first has finished before a chunk
needs no run from the start: of the blocks due by then all, and of the blocks whose window reaches over that
slot, taken by deadline, those for which a slot since their release is left (the jobs done by a slot are the
first basis of a scheduling matroid). So each chunk begins with the lags that the chunks before it leave. The
slots come back to the rows through small chunks of the order hash, a list of slots each, so no source is
sorted in one task and rows move once. When a source runs out its slots stay empty; nothing is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a target weight, or with one that is not above
zero, follow after all others in equal shares; equal rows take neighbouring places; an empty table gives no
rows; columns named like the results are replaced. The list of sources with their counts goes to the driver and to every
task of the schedule, as weights do; it grows with the number of sources only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.names import free_names
from geoloom.plans.scratch import materialize

BLOCK_ROWS = 32
#: slots that a task schedules at once, at least
CHUNK_SLOTS = 1 << 16
#: rows of one chunk of the order hash, about
CHUNK_ROWS = 1024
RESULTS = ("mix_weight", "mix_block", "mix_slot", "mix_row")


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    up = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * up) for s, x in exact.items()}
    down = math.gcd(*parts.values())
    return {s: p // down for s, p in parts.items()}


class Schedule:
    """Earliest-deadline-first schedule of endless sources with whole shares."""

    def __init__(self, shares: dict[str, int]):
        self.shares, self.total = shares, sum(shares.values())

    def release(self, s: str, k: int) -> int:
        return (k - 1) * self.total // self.shares[s]

    def due(self, s: str, k: int) -> int:
        return -(-k * self.total // self.shares[s])

    def done_before(self, slot: int) -> dict[str, int]:
        """Blocks of each source finished before ``slot``."""
        done = {s: p * slot // self.total for s, p in self.shares.items()}
        left = slot - sum(done.values())
        spanning = sorted((self.due(s, done[s] + 1), s) for s, p in self.shares.items() if p * slot % self.total)
        if not left or left == len(spanning):
            return {s: done[s] + (left > 0 and self.shares[s] * slot % self.total > 0) for s in done}
        first = min(self.release(s, done[s] + 1) for _, s in spanning)
        after: dict[int, int] = {}  # a taken slot -> where to look for the next free one

        def free(at: int) -> int:
            path = []
            while at in after:
                path.append(at)
                at = after[at]
            for x in path:
                after[x] = at
            return at

        for s, p in self.shares.items():
            for k in range(-(-first * p // self.total) + 1, done[s] + 1):
                at = free(self.release(s, k))
                after[at] = at + 1
        for _, s in spanning:
            at = free(self.release(s, done[s] + 1))
            if at < slot:
                after[at] = at + 1
                done[s] += 1
                left -= 1
                if not left:
                    break
        return done

    def slots(self, start: int, end: int) -> Iterator[tuple[str, int, int]]:
        """(source, block, slot) of the slots from ``start`` up to ``end``."""
        to_come = [(self.release(s, n + 1), self.due(s, n + 1), s, n + 1) for s, n in self.done_before(start).items()]
        heapq.heapify(to_come)
        ready: list[tuple[int, str, int]] = []
        for slot in range(start, end):
            while to_come and to_come[0][0] <= slot:
                _, due, s, k = heapq.heappop(to_come)
                heapq.heappush(ready, (due, s, k))
            due, s, k = heapq.heappop(ready)
            if slot >= due:
                raise AssertionError("a block missed its deadline")
            yield s, k, slot
            heapq.heappush(to_come, (self.release(s, k + 1), self.due(s, k + 1), s, k + 1))


def default_weights(counts: dict[str, int]) -> dict[str, float]:
    """Square roots of the row counts, which lift small sources."""
    return {s: float(n) ** 0.5 for s, n in counts.items()}


def _scheduler(told):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, blocks, end, size, offset = told.value
        plan = Schedule(shares)
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                rows = [x for x in plan.slots(chunk * size, min(end, (chunk + 1) * size)) if x[1] <= blocks[x[0]]]
                names, ks, slots = zip(*rows) if rows else ((), (), ())
                columns = [pa.array(names, pa.string()), pa.array(ks, pa.int64()), pa.array([x + offset for x in slots], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["s", "k", "slot"])

    return work


def scheduled(spark, weights: dict[str, float], blocks: dict[str, int], offset: int = 0) -> tuple[DataFrame, int]:
    """(rows (s, k, slot) of every block of every source, the slot after the last), the slots from ``offset`` on."""
    shares = whole_shares(weights)
    plan = Schedule(shares)
    end = max(plan.due(s, blocks[s]) for s in shares)
    # a chunk is no shorter than the longest window, which its first state looks back over
    size = max(CHUNK_SLOTS, min(end, -(-plan.total // min(shares.values()))))
    told = spark.sparkContext.broadcast((shares, blocks, end, size, offset))
    chunks = -(-end // size)
    return spark.range(0, chunks, 1, min(chunks, 10_000)).mapInArrow(_scheduler(told), "s string, k long, slot long"), offset + end


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", order_by: str = "doc_id", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``docs`` with mix_weight (share of the source among those scheduled with it), mix_block (of the source, from 1), mix_slot
    and mix_row (in the block)."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("?"))
    counts = {r["s"]: r["count"] for r in materialize(docs.groupBy(key.alias("s")).count(), "sources").collect()}
    if weights is None:
        wanted = default_weights(counts)
    else:
        wanted = {s: w for n, w in weights.items() if (s := "?" if n is None else f"={n}") in counts and w > 0}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    plan, shares, end = None, [], 0
    for part in (wanted, {s: 1.0 for s in counts if s not in wanted}):
        if part:
            rows, end = scheduled(spark, part, blocks, end)
            plan = rows if plan is None else plan.unionByName(rows)
            total = math.fsum(part.values())
            shares += [(s, w / total) for s, w in part.items()]
    if plan is None:
        plan = spark.createDataFrame([], "s string, k long, slot long")

    s, h, c, n, first, slots, weight, rank = free_names("s h c n first slots weight rank", docs)
    bits = max(0, (sum(counts.values()) // CHUNK_ROWS).bit_length())
    order = F.col(f"`{order_by}`").cast("string")
    hashed = docs.drop(*RESULTS).withColumn(s, key).withColumn(h, F.xxhash64(F.lit(7), order))
    hashed = hashed.withColumn(c, F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy(s).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(s, c).agg(F.count("*").alias(n))
    sizes = sizes.withColumn(first, F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")))
    held = F.sequence(F.expr(f"{first} div {block_rows}") + 1, F.expr(f"({first} + {n} - 1) div {block_rows}") + 1)
    each = sizes.select(s, c, first, F.explode(held).alias("k")).join(plan.withColumnRenamed("s", s), [s, "k"])
    listed = each.groupBy(s, c, first).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "slot"))), lambda x: x["slot"]).alias(slots))
    named = spark.createDataFrame(shares, f"{s} string, {weight} double")
    starts = materialize(listed.join(named, s), "chunks")
    place = Window.partitionBy(s, c).orderBy(h, order)
    ranked = hashed.join(starts, [s, c]).withColumn(rank, F.col(first) + F.row_number().over(place) - 1)
    block = F.expr(f"{rank} div {block_rows}") + 1
    at = (block - F.expr(f"{first} div {block_rows}")).cast("int")
    return ranked.select(
        *(F.col(f"`{x}`") for x in docs.columns if x not in RESULTS), F.col(weight).alias("mix_weight"), block.alias("mix_block"),
        F.element_at(slots, at).alias("mix_slot"), (F.col(rank) % block_rows).alias("mix_row"),
    )


def mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out in the order of the schedule, over as many range partitions as the session shuffles into."""
    return mixed.repartitionByRange("mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row")


def report(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
