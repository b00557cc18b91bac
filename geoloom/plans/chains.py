"""Rank the members of chains and rings by pointer doubling.

Each node knows at most one predecessor. One round squares the reach of every pointer, so a
chain of n nodes needs about log2(n) equi-joins on the node id; no group is ever collected.
Every round is a written table, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from geoloom.plans.scratch import growing, materialize


def rank_chains(nodes: DataFrame) -> DataFrame:
    """Order the nodes of every chain and ring.

    In: ``id`` (any orderable type) and ``prev`` (null at a chain head); no two nodes share a
    ``prev``. Out: id, chain (id of the head; the least id for a ring), pos (0-based),
    is_ring. Chain members keep their direction; a ring starts at its least id.

    State per node: the farthest predecessor reached (head) and how many hops away, the least id
    among the nodes passed (low) and how many hops away it is first met, and whether the head
    is the true head of a chain (done).
    """
    back = F.col("prev").isNotNull() & (F.col("prev") < F.col("id"))
    first = nodes.select(
        "id",
        F.coalesce("prev", "id").alias("head"),
        F.col("prev").isNotNull().cast("bigint").alias("hops"),
        F.when(back, F.col("prev")).otherwise(F.col("id")).alias("low"),
        back.cast("bigint").alias("low_hops"),
        F.col("prev").isNull().alias("done"),
    )
    state, seen = _written(first.withColumn("moved", F.lit(True)))
    settled = [state.filter("done")]
    heads = settled[0]
    if seen["open"] and seen["done"] > seen["open"] // 4:
        # every node looked up is someone's prev; heads that are not, as of lone nodes, need not be read in any round
        prevs = state.filter("NOT done").select(F.col("head").alias("id"))
        heads = materialize(growing(heads).join(prevs, "id", "left_semi"), "heads")
    while seen["open"]:
        # settled nodes are read, and written only once; a round writes the open ones
        known = heads
        for part in settled[1:]:
            known = known.unionByName(part)
        rest = state.filter("NOT done")
        far = known.unionByName(rest).select(
            F.col("id").alias("head"), *[F.col(c).alias("far_" + c) for c in ("head", "hops", "low", "low_hops", "done")]
        )
        lower = F.col("far_low") < F.col("low")
        stepped = growing(rest).join(far, "head").select(
            "id",
            F.col("far_head").alias("head"),
            (F.col("hops") + F.col("far_hops")).alias("hops"),
            F.when(lower, F.col("far_low")).otherwise(F.col("low")).alias("low"),
            F.when(lower, F.col("hops") + F.col("far_low_hops")).otherwise(F.col("low_hops")).alias("low_hops"),
            F.col("far_done").alias("done"),
            lower.alias("moved"),
        )
        renewed, now = _written(stepped)
        # Open chains close at least one node per round, so an idle round leaves only rings; their
        # least id is known once a whole round has not lowered it anywhere.
        idle = now["open"] == seen["open"] and now["moved"] == 0
        state, seen = renewed, now
        if idle:
            settled.append(state)
            break
        settled.append(state.filter("done"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(
        "id",
        F.when(F.col("done"), F.col("head")).otherwise(F.col("low")).alias("chain"),
        F.when(F.col("done"), F.col("hops")).otherwise(F.col("low_hops")).alias("pos"),
        (~F.col("done")).alias("is_ring"),
    )


def _written(state: DataFrame) -> tuple[DataFrame, dict]:
    """Write one round and take its open and moved counts from the same pass."""
    seen = Observation()
    counted = state.observe(
        seen,
        F.count(F.when(~F.col("done"), 1)).alias("open"),
        F.count(F.when(F.col("done"), 1)).alias("done"),
        F.count(F.when(~F.col("done") & F.col("moved"), 1)).alias("moved"),
    )
    table = materialize(counted, "chain")
    return table, seen.get
