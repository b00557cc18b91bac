"""Preference formatting: one shared prompt and two masked completions for each pair of conversations.

Turns of a pair are gathered in one row (the result is that row), ordered by turn, role and text. The
longest prefix of turns equal in role and text becomes the prompt, rendered once; what follows on each
side becomes a completion with a mask of the same length: 1 on what an assistant wrote and on the mark
that ends it, else 0. Everything stays in built-in functions.

Defined cases: a null role or text counts as empty; turns repeated under one number stay, in order of
role and text; a missing side is an empty conversation; rows without a pair or side are in no
conversation; equal sides give two empty completions; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column, trained: str) -> Column:
    def one(t: Column) -> Column:
        learn = F.when(t["role"] == trained, F.lit("1")).otherwise(F.lit("0"))
        head = F.repeat(F.lit("0"), F.length(t["role"]) + (len(OPEN) + 1))
        return F.concat(head, F.repeat(learn, F.length(t["text"]) + len(CLOSE)), F.lit("0"))

    return F.array_join(F.transform(turns, one), "")


def format_preferences(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``turns``: pair_id, side (0 chosen, 1 rejected), turn, role, text.

    Returns pair_id, n_prefix_turns, prompt, and chosen, chosen_mask, rejected, rejected_mask.
    """
    clean = turns.where("pair_id is not null and side in (0, 1)").select(
        "pair_id",
        F.struct(
            F.col("side").cast("int").alias("side"), "turn", F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    pairs = clean.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def of(side: int) -> Column:
        own = F.filter("ts", lambda t: t["side"] == side)
        return F.transform(own, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    sides = pairs.select("pair_id", of(0).alias("a"), of(1).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    sides = sides.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int"))
    rest = sides.select(
        "pair_id", F.col("n").cast("long").alias("n_prefix_turns"), F.slice("a", F.lit(1), F.col("n")).alias("common"),
        F.slice("a", F.col("n") + 1, F.greatest(F.size("a"), F.lit(1))).alias("a"),
        F.slice("b", F.col("n") + 1, F.greatest(F.size("b"), F.lit(1))).alias("b"),
    )
    return rest.select(
        "pair_id", "n_prefix_turns", _render(F.col("common")).alias("prompt"),
        _render(F.col("a")).alias("chosen"), _mask(F.col("a"), trained).alias("chosen_mask"),
        _render(F.col("b")).alias("rejected"), _mask(F.col("b"), trained).alias("rejected_mask"),
    )


def report(spark, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_preferences(
        turns.select(
            F.shiftright("conv_id", 1).alias("pair_id"), F.col("conv_id").bitwiseAND(F.lit(1)).alias("side"), "turn", "role", "text"
        )
    )


SQL = f"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN rn END) - 1, max(rn)) AS n FROM (
        SELECT pair_id, rn, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM t GROUP BY pair_id, rn) GROUP BY pair_id),
r AS (SELECT pair_id, side, rn, n, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS s,
             repeat('0', {len(OPEN) + 1} + length(role)) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(text) + {len(CLOSE)}) || '0' AS m
      FROM t JOIN n USING (pair_id))
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prefix_turns,
       coalesce(string_agg(s, '' ORDER BY rn) FILTER (rn <= n AND side = 0), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY rn) FILTER (rn > n AND side = 0), '') AS chosen,
       coalesce(string_agg(m, '' ORDER BY rn) FILTER (rn > n AND side = 0), '') AS chosen_mask,
       coalesce(string_agg(s, '' ORDER BY rn) FILTER (rn > n AND side = 1), '') AS rejected,
       coalesce(string_agg(m, '' ORDER BY rn) FILTER (rn > n AND side = 1), '') AS rejected_mask
FROM r GROUP BY pair_id"""
