"""The training-data pipeline: toxicity, near-dedup, suffix-array dedup, benchmark decontamination, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written
as Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``, with what earlier stages decided in effect. A stage
starts with giving back the driver's memory of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, near_dedup, packing, suffix_dedup, tokens, toxicity
from quarry.llm.common import keep, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labelled ones among them, doesn't reject."""
    release(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of smallest id."""
    release(spark)
    return near_dedup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier; documents of which nothing is left go, empty ones stay."""
    release(spark)
    return suffix_dedup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    release(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, placed in sequences of at most 2048 tokens."""
    release(spark)
    return packing.pack(docs, tokens.public("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", cut_repeats),
          ("decontaminate", drop_contaminated), ("packing", pack)]

#: Trained taggers, sketches and tokenizers have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
