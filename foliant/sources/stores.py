"""Tables that are kept by key: upsert, point reads and cascading deletes over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys the one that is largest by `order`: one aggregation, combined before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("__top")
    return rows.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in rest])


class Store:
    """A Parquet table partitioned by book."""

    def __init__(self, spark: SparkSession, path: str, key: str = "book_id"):
        self.spark, self.path, self.key = spark, path, key

    def save(self, rows: DataFrame) -> None:
        """Replace the books that rows has; others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path)

    def load(self, book: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df if book is None else df.where(F.col(self.key) == book)

    def books(self) -> DataFrame:
        return self.load().select(self.key).distinct()

    def exists(self, book: str) -> bool:
        return bool(self.load(book).limit(1).count())

    def delete(self, book: str) -> None:
        """Remove one book's rows, which are a folder of their own; a book that the store lacks is no error."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(self.key, book)
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{folder}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def cascade(deleted: DataFrame, *derived: DataFrame, key: str = "book_id") -> list[DataFrame]:
    """Each derived table without the deleted books' rows."""
    return [d.join(deleted.select(key).distinct(), key, "left_anti") for d in derived]


class VectorIndex:
    """Chunks and their vectors, kept by book in two tables below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.chunks, self.vectors = Store(spark, f"{path.rstrip('/')}/chunks"), Store(spark, f"{path.rstrip('/')}/embeddings")

    def save(self, chunks: DataFrame, vectors: DataFrame) -> None:
        """Replace the books that chunks (book_id, chunk_id, chapter_id, text) has; vectors (book_id, chunk_id, embedding) must be one a chunk, of one length."""
        off = chunks.select("book_id", "chunk_id", F.lit(True).alias("c")).join(vectors.select("book_id", "chunk_id", F.lit(True).alias("v"), F.size("embedding").alias("n")), ["book_id", "chunk_id"], "full")
        n, wrong, low, high = off.agg(F.count("*"), F.count_if(F.col("c").isNull() | F.col("v").isNull()), F.min("n"), F.max("n")).first()
        if wrong or low != high:
            raise ValueError(f"{wrong} of {n} chunks and vectors have no counterpart; dimensions {low} to {high}")
        self.chunks.save(chunks)
        self.vectors.save(vectors)

    def load(self, book: str | None = None) -> DataFrame:
        """(book_id, chunk_id, chapter_id, text, embedding)"""
        return self.chunks.load(book).join(self.vectors.load(book), ["book_id", "chunk_id"])

    def exists(self, book: str) -> bool:
        return self.vectors.exists(book)

    def delete(self, book: str) -> None:
        self.chunks.delete(book)
        self.vectors.delete(book)
