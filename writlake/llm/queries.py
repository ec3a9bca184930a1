"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from writlake.llm import feistel, isobmff, jaccard, lm_bloom, mixing, packing, range_coder, runlength_index, toxicity, vamana
from writlake.llm.common import held_out_column, tokenizer_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.lm_scores(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out_column("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.shard_rows(table(spark, sf_dir, "documents"), n_shards=16, seed=20_240_601)


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.written_and_read(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength_index.dedup(table(spark, sf_dir, "documents"), least=400)


def op9_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isobmff.text_media_features(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_scores, op2_toxicity, op3_pack_documents, op4_mix_sources, op5_feistel_shards, op6_jaccard_components, op7_id_files, op8_repeated_strings, op9_graph_neighbours, op10_media_columns)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    return {"op4_mix_sources": mixing.oracle_sql()}
