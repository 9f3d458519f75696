"""An index of a collection's blocks for lexical lookup: which blocks have which runs of three characters.

A query is in no block that lacks one of its runs, so only the blocks that have its rarest ones are read and tested. Postings are partitioned by a hash
of the run and sorted by it, blocks by the split that they lie in: a search reads the partitions that its queries need. Queries of under three characters have no
run; they are looked for in all blocks.

Postings are packed where the blocks lie: of some megabytes of text, each run is one row with the gaps between its blocks' numbers, so what is shuffled and kept is about a byte a posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search
from ..operators.contain import GRAM
from ..plans.scratch import small, written

#: Runs of a query whose postings are intersected: the rarest ones.
RAREST = 3
#: Blocks in a partition of blocks, and in one of postings; the most partitions of either.
PART, BUCKET, MOST = 1_000_000, 100_000, 4096
#: Characters of text whose postings are packed at once.
CHARS = 1 << 22


def runs(text: Column) -> Column:
    """The distinct runs of a short text."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def _codes(text: str) -> np.ndarray:
    """Each run of a text as a number, its characters' numbers in 21 bits each."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:] if len(c) >= GRAM else c[:0]


def _postings(blocks: list[int], texts: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, block): the distinct runs of each text, by code and block. blocks ascend; a text of over `most` characters is alone."""
    if len(texts) == 1 and len(texts[0]) > most:
        found = np.zeros(0, np.uint64)
        for k in range(0, len(texts[0]), most):
            found = np.union1d(found, _codes(texts[0][k : k + most + GRAM - 1]))
        return found, np.full(len(found), blocks[0], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    line = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    at = np.flatnonzero(line[2:] == line[:-2])
    there = np.zeros(0x110000, bool)
    there[chars] = True
    letters = np.flatnonzero(there)
    number = np.cumsum(there) - 1
    small, n = number[chars], len(letters)
    if n**GRAM * len(texts) >= 1 << 62:  # tens of thousands of different characters
        order = np.lexsort((line[at], _codes_at(chars, at)))
        code, row = _codes_at(chars, at)[order], line[at][order]
        new = np.flatnonzero((np.diff(code, prepend=code[:1] + np.uint64(1)) != 0) | (np.diff(row, prepend=-1) != 0))
        return code[new], np.asarray(blocks, np.int64)[row[new]]
    key = np.sort(((small[at] * n + small[at + 1]) * n + small[at + 2]) * len(texts) + line[at])
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    which, row = np.divmod(key, len(texts))
    a, b, c = (letters[x].astype(np.uint64) for x in (which // (n * n), which // n % n, which % n))
    return a << np.uint64(42) | b << np.uint64(21) | c, np.asarray(blocks, np.int64)[row]


def _codes_at(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b, c = (chars[at + k].astype(np.uint64) for k in range(GRAM))
    return a << np.uint64(42) | b << np.uint64(21) | c


def packed(part: int, code: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gram, part, n, first, width, gaps): of each run the number of its blocks, the first, and the gaps to each from the one before in `width` bytes, the first gap being 0."""
    if not len(code):
        return
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    n = np.diff(np.append(begin, len(code)))
    gap = np.diff(block, prepend=block[:1])
    gap[begin] = 0
    most = np.maximum.reduceat(gap, begin)
    widths = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)
    own = code[begin]
    letters = np.stack([own >> np.uint64(42), own >> np.uint64(21) & np.uint64(0x1FFFFF), own & np.uint64(0x1FFFFF)], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        data = gap[np.repeat(widths == width, n)].astype(f"<u{width}").tobytes()
        ends = np.append(0, np.cumsum(n[some] * width)).astype(np.int32)
        gaps = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        full = lambda x, kind, k=len(some): pa.array(np.full(k, x, kind))
        names = pa.array([letters[GRAM * k : GRAM * k + GRAM] for k in some.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([names, full(part, np.int32), pa.array(n[some].astype(np.int64)), pa.array(block[begin[some]]), full(width, np.int32), gaps], names=["gram", "part", "n", "first", "width", "gaps"])


def _packed(blocks: DataFrame, chars: int | None = None) -> DataFrame:
    """Packed postings of blocks (part, block, text)."""
    most = chars or CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        part, size = None, 0

        def told() -> Iterator[pa.RecordBatch]:
            held.sort()
            yield from packed(part, *_postings([b for b, _ in held], [t for _, t in held], most))
            held.clear()

        for batch in batches:
            for own, block, text in zip(batch["part"].to_pylist(), batch["block"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if held and (own != part or size + len(text) > most):
                    yield from told()
                    size = 0
                held.append((block, text))
                part, size = own, size + len(text)
        if held:
            yield from told()

    return blocks.where(F.length("text") >= GRAM).select("part", "block", "text").mapInArrow(run, "gram string, part int, n long, first long, width int, gaps binary")


def unpacked(postings: DataFrame) -> DataFrame:
    """A row for each block of packed postings, with their other columns."""
    kept = [c for c in postings.columns if c not in ("n", "first", "width", "gaps")]
    kind = dict(postings.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (first, width, gaps) in enumerate(zip(batch["first"].to_pylist(), batch["width"].to_pylist(), batch["gaps"].to_pylist(), strict=True)):
                block = first + np.cumsum(np.frombuffer(gaps, f"<u{width}").astype(np.int64))
                row = pa.array(np.full(len(block), k))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(row) for c in kept), pa.array(block)], names=[*kept, "block"])

    return postings.select(*kept, "first", "width", "gaps").mapInArrow(run, ", ".join([*(f"`{c}` {kind[c]}" for c in kept), "block long"]))


class GramIndex:
    """The index below a path: blocks (block, book_id, chapter_id, ordinal, text, part), packed postings (gram, part, n, first, width, gaps, bucket), counts (gram, n) and settings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, blocks: DataFrame, path: str, parts: int | None = None, buckets: int | None = None) -> GramIndex:
        """Index blocks (book_id, chapter_id, ordinal, text); null texts are kept, but found by nothing. Partitions follow the number of blocks, if not given."""
        index, n = cls(blocks.sparkSession, path), blocks.count()
        parts, buckets = parts or min(MOST, max(8, n // PART)), buckets or min(MOST, max(16, n // BUCKET))
        # blocks stay where they lie: a split is in one part, and blocks that lie together have numbers that are close
        part = F.pmod(F.spark_partition_id(), F.lit(parts)).cast("int")
        placed = blocks.select(F.monotonically_increasing_id().alias("block"), "book_id", "chapter_id", "ordinal", "text", part.alias("part"))
        placed.write.partitionBy("part").parquet(f"{index.path}/blocks")
        each = _packed(index.blocks().select("part", "block", F.lower("text").alias("text")))
        each = each.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        each.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{index.path}/postings")
        index.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{index.path}/settings")
        index.postings().groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{index.path}/counts")
        return index

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, part, block): the blocks that have the rarest runs of queries (query_id, query) of three characters and more: all that are read for them."""
        asked = queries.where(F.length("query") >= GRAM).select("query_id", F.explode(runs(F.lower("query"))).alias("gram"))
        common = asked.join(self.counts(), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "gram"))
        chosen = common.withColumn("rank", rank).where(F.col("rank") <= RAREST)
        chosen = written(chosen.select("query_id", "gram", F.count("*").over(Window.partitionBy("query_id")).alias("needed")), "grams")
        buckets = self.spark.read.parquet(f"{self.path}/settings").first()[0]
        own = [r[0] for r in chosen.select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()]
        there = self.postings().where(F.col("bucket").isin(own))
        met = unpacked(there.join(small(chosen), "gram").select("query_id", "needed", "part", "first", "width", "gaps")).groupBy("query_id", "part", "block").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
        return met.where("n = needed").select("query_id", "part", "block")

    def search(self, queries: DataFrame) -> DataFrame:
        """What search.lexical_many gives for the same blocks and queries (query_id, query, and book_id and chapter_id that limit them where there are such)."""
        limits = [c for c in ("book_id", "chapter_id") if c in queries.columns]
        found = written(self.candidates(queries), "candidates")
        parts = [r[0] for r in found.select("part").distinct().collect()]  # at most MOST
        asked = queries.select("query_id", F.lower("query").alias("q"), *[F.col(c).alias(f"__{c}") for c in limits])
        near = found.join(small(asked), "query_id")
        read = self.blocks().where(F.col("part").isin(parts)).join(small(near), ["part", "block"])
        fit = F.contains(F.lower("text"), F.col("q"))
        for c in limits:
            fit = fit & (F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)))
        hits = read.where(fit).select("query_id", "book_id", "chapter_id", "ordinal", (F.position(F.col("q"), F.lower("text")) - 1).cast("int").alias("match_pos"))
        brief = queries.where(F.length("query") < GRAM)
        return hits.unionByName(search.lexical_many(self.blocks(), brief)) if brief.where(F.length("query") > 0).limit(1).count() else hits
