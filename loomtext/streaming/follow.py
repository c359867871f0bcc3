"""Postings that follow a folder of documents as files are added to it.

Each new file is tokenized once; its counts are appended under the number of its
batch, so that a batch that is run again after a failure replaces itself. Batches
are independent: there is no state to keep and nothing arrives late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import postings as P


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts to append (doc_id, term, tf) of new Parquet files of documents (doc_id, text) to a table. once: ends when all files there are done."""
    new = spark.readStream.schema("doc_id long, text string").parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        counts = P.term_counts(batch.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", F.col("text"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = new.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema("doc_id long, term string, tf long, batch long").parquet(table).drop("batch")
