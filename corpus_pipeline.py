"""The corpus pipeline: five stages, each working on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next one.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from writlake.llm import jaccard, mixing, packing, runlength_index, toxicity
from writlake.llm.common import Scratch, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.3
#: Bytes of a repeated passage at least; a passage of over 50 words has more (5.2 bytes a word are the fewest seen in such text).
REPEAT = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below the limit."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, "__toxic").where(F.col("__toxic") < REJECT).drop("__toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8."""
    return jaccard.keep_one(docs.select(*COLUMNS), words=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of REPEAT bytes that start twice, in whole characters."""
    return runlength_index.remove_repeats(docs.select(*COLUMNS), least=REPEAT).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture with as many tokens as there are; a document comes once for each epoch, and the last one of a leaf is cut."""
    mixed = mixing.mix(docs.select(*COLUMNS), permille=1000, carry=tuple(COLUMNS))
    return mixed.withColumn("text", mixing.cut_text("text", "take", "doc_tokens")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in sequences of 1024 tokens; its workers have other stages behind them, so that they remember less."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), remembered=200_000, piece_bytes=3 << 20, forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL can't express the classifier, the coder or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
    return STAGES[-1][1](spark, docs, sf_dir)
