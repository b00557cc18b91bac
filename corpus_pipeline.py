"""Corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark contamination, mixing.

Each stage works on all that its predecessor kept. ``run`` writes a stage's result as Parquet into the
shared scratch folder and reads it back for the next one.

Defined cases, for each stage: other columns pass through whatever their names; an empty table gives an empty one. A null or
empty text is never toxic by its words, is one group of near-duplicates with all texts of no words (one row
stays), has nothing to cut and no contamination. A null language takes the common threshold. Of rows with equal ids or texts
the near-duplicate stage keeps one a group: the smallest id, null last, then the smallest text hash; the other filtering
stages judge row by row. A null source is a source of its own. No labels: no document goes; no benchmark: none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, mixing, simhash, suffixdedup, toxicity
from geoloom.llm.names import free_names
from geoloom.plans.scratch import discard, materialize


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    model = toxicity.train(docs.select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    score, rejected = free_names("score rejected", docs)
    scored = toxicity.score_documents(docs, model, score=score, rejected=rejected)
    return scored.where(~F.col(rejected)).select(*_columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes, and then without passages of over 50 words, that occur more than once;
    n_chars follows."""
    shorter = materialize(suffixdedup.remove_repeats(docs), "shorter")
    return suffixdedup.remove_passages(shorter, 51).withColumn("n_chars", F.length("text").cast("long")).select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than a twentieth of the words."""
    (spans,) = free_names("spans", docs)
    found = decontaminate.find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=spans)
    return found.where(~decontaminate.is_contaminated(spans)).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule, with their slots."""
    return mixing.mixed_order(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: the classifier, hashes and suffix sorting have no SQL form; tests/llm/test_pipeline.py checks each stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return docs
