"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from featurelens.llm import (
    chat,
    decontam,
    identify,
    language,
    licences,
    negatives,
    omh,
    packing,
    quality,
    sharding,
    suffixes,
    warc,
    whitening,
)
from featurelens.session import adapt

#: The public tokenizer of the packing query.
PACKING_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, sf: function(adapt(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op8_compression_bands")
def compression_bands(spark, sf):
    return quality.assess(table(spark, sf, "documents"))


@query("op1_perspectives", chat.SQL)
def perspectives(spark, sf):
    seen = chat.perspectives(table(spark, sf, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return seen.withColumn("masks", F.array_join(spans, ",")).withColumnRenamed("conversation", "conv_id")


@query("op2_byte_shards")
def byte_shards(spark, sf):
    placed = sharding.shards(table(spark, sf, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op9_harmonic_packing")
def harmonic_packing(spark, sf):
    return packing.placements(table(spark, sf, "documents"), tokenizer_path(PACKING_TOKENIZER))


@query("op6_order_minhash")
def order_minhash(spark, sf):
    return omh.groups(table(spark, sf, "documents"))


@query("op5_suffix_columns")
def suffix_columns(spark, sf):
    return suffixes.digests(table(spark, sf, "documents"))


@query("op4_block_max_wand")
def block_max_wand(spark, sf):
    return decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_warc_index")
def warc_index(spark, sf):
    index = warc.write(table(spark, sf, "pages"), min_bytes=0)
    records = warc.read(index, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_licence_sentences")
def licence_sentences(spark, sf):
    return licences.scan(table(spark, sf, "documents"))


@query("op3_recurrent_scores")
def recurrent_scores(spark, sf):
    return language.score(table(spark, sf, "documents"))


@query("op11_shifted_cholesky")
def shifted_cholesky(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op12_threshold_negatives", negatives.SQL)
def threshold_negatives(spark, sf):
    moved = (F.col("label").cast("long") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings"), label=label)


@query("op13_family_machines")
def family_machines(spark, sf):
    return identify.identify(table(spark, sf, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
