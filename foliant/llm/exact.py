"""Exact duplicates with a heavy-hitter split.

Texts are told apart by SHA-256. Each task counts digests in a Misra-Gries summary of COUNTERS entries; the summaries
are added up, which keeps their guarantee: a digest of more than n / (COUNTERS + 1) of the n rows is among the COUNTERS
largest. A second pass counts those candidates exactly and finds their winners; the verified ones, at most COUNTERS
rows, are broadcast, and their rows are decided where they lie. No digest among the rest has more rows than that bound,
so an ordinary shuffle deals them evenly. Texts are read once; what is shuffled is a digest, an id and a number a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_text, materialise, small_batches

COUNTERS = 1023
#: Numbers of dropped rows that are broadcast, of 8 bytes each; more are joined, each number being there once.
BROADCAST_ROWS = 1_000_000


class Summary:
    """A Misra-Gries summary of digests: at most `counters` entries, each at most rows / (counters + 1) below the true count."""

    def __init__(self, counters: int = COUNTERS):
        self.counters = counters
        self.entries = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})

    def add(self, digests: pa.Array) -> None:
        """Count a batch exactly, then take the first count that finds no room from all."""
        batch = pa.table({"digest": digests, "n": pa.array(np.ones(len(digests), np.int64))})
        both = pa.concat_tables([self.entries, batch]).group_by("digest").aggregate([("n", "sum")])
        n = both["n_sum"].to_numpy()
        if len(n) > self.counters:
            n = n - np.partition(n, len(n) - self.counters - 1)[len(n) - self.counters - 1]
        left = n > 0
        self.entries = pa.table({"digest": both["digest"].filter(pa.array(left)).combine_chunks(), "n": pa.array(n[left])})


def summaries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n): the entries of a summary of each task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in batches:
            summary.add(batch["digest"])
        yield from summary.entries.to_batches()

    return digests.select("digest").mapInArrow(run, "digest binary, n long")


def _winner() -> Column:
    """Of a group's rows the one with the largest id, null last; of rows with that id the last written."""
    return F.max(F.struct("doc_id", "row"))


def frequent(numbered: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n, winner): the digests of over 1 / (counters + 1) of the rows of numbered (row, doc_id, digest), verified; at most `counters` rows, written."""
    added = summaries(numbered, counters).groupBy("digest").agg(F.sum("n").alias("least"))
    candidates = materialise(added.orderBy(F.desc("least"), "digest").limit(counters).select("digest"), "candidates")
    counted = numbered.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("n"), _winner().alias("winner"))
    return materialise(counted.where(F.col("n") * (counters + 1) > numbered.count()), "frequent")


def decided(numbered: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """numbered (row, doc_id, digest, ...) with n and winner (doc_id, row) of each row's group."""
    heavy = F.broadcast(frequent(numbered, counters))
    here = numbered.join(heavy, "digest")
    group = Window.partitionBy("digest")
    rest = numbered.join(heavy.select("digest"), "digest", "left_anti")
    return here.unionByName(rest.withColumn("n", F.count("*").over(group)).withColumn("winner", _winner().over(group)))


def _numbered(docs: DataFrame, keep: tuple[str, ...], normalise: Callable[[Column], Column] | None) -> DataFrame:
    small_batches(docs.sparkSession)
    text = empty_text()
    digest = F.unhex(F.sha2((normalise(text) if normalise else text).cast("binary"), 256))
    return docs.select(F.struct(*keep).alias("kept_columns"), F.col("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))


def groups(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs (doc_id, text): one row a row, dropped ones too.

    Texts are equal when identical after `normalise` (none: as they are). The row with the largest doc_id stays; a null id is smaller than any,
    and stays only where a group has no other. Of rows that repeat an id and text one stays, so `kept` holds once a group; group_size counts rows.
    Null texts count as empty ones. Texts may have any length; an empty table gives none. Other columns are not read, whatever their names.
    """
    found = decided(materialise(_numbered(docs, ("doc_id",), normalise).drop("kept_columns"), "digests"), counters)
    return found.select("doc_id", F.col("winner.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("winner.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), normalise: Callable[[Column], Column] | None = None, counters: int = COUNTERS) -> DataFrame:
    """Columns `keep` of the rows that stay (see groups), texts as they were.

    Rows are written once with their numbers; what is shuffled are digests and, where over BROADCAST_ROWS rows go, numbers.
    """
    written = materialise(_numbered(docs, keep, normalise), "documents")
    gone = decided(written.drop("kept_columns"), counters).where("row <> winner.row").select("row")
    gone = materialise(gone, "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return written.join(gone, "row", "left_anti").select("kept_columns.*")
