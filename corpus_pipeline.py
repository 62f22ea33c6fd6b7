"""The training-corpus pipeline: documents in, packed sequences out.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it
kept, and is written as Parquet before the next one reads it. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featurelens.llm import decontam, omh, packing, quality, suffixes
from featurelens.session import adapt, stored

TOKENIZER = "word_bpe_49k.json"

#: No SQL says what compression, sketches and tokenizers decide.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word rules or the compression bands go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates stays."""
    return omh.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that stand elsewhere too are cut out; every document stays."""
    return suffixes.strip(docs, length="n_chars" if "n_chars" in docs.columns else None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    import public_tokenizers

    return packing.placements(docs, str(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = adapt(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
