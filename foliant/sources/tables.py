"""The parquet tables as books: source = book, document = chapter, line = block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a table in fewer splits than there are cores, such as one small file, dealt out to all; any other stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_id, text)"""
    return dealt(table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), "text"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_id, ordinal, text): a narrow step, no shuffle."""
    lines = F.posexplode(F.split("text", "\n")).alias("ordinal", "text")
    return chapters(spark, sf_dir).select("book_id", "chapter_id", lines)
