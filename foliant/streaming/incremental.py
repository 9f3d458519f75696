"""Indexing of chapters as they arrive (an extension of this library: batches of a stream through the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import chunk


def chunk_stream(chapters: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Chunk a stream of chapters (book_id, chapter_id, text) into Parquet below path, partitioned by batch: a batch that is repeated after a failure replaces its own rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        made = chunk(batch.select("book_id", "chapter_id", F.split("text", "\n").alias("blocks")))
        made.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = chapters.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
