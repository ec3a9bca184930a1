"""Structured Streaming over the same stateless operators: new texts are cleaned as they come, and the latest review of a document wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from writlake.functions import columns as C


def clean_stream(texts: DataFrame) -> DataFrame:
    """A stream of ``document_id``, ``full_page_text`` with the cleaned text, its ids and its first date."""
    out = texts.withColumn("cleaned_text", C.normalize("full_page_text"))
    return out.withColumns({"national_ids": C.national_ids("cleaned_text"), "first_date": C.first_date("cleaned_text")})


def latest(reviews: DataFrame) -> DataFrame:
    """The last review of each document by time; equal times by the larger version."""
    order = Window.partitionBy("document_id").orderBy(F.desc("reviewed_at"), F.desc("version"))
    return reviews.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def keep_latest(reviews: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of reviews so that the table holds the latest of each document.

    Every batch is written to a new version of the table, and the version read next is named by the batch before, so that a
    batch that is run again reads what it read the first time.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if number:
            batch = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{table}/v{number - 1}"))
        latest(batch).write.mode("overwrite").parquet(f"{table}/v{number}")

    return reviews.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
