"""Hard negatives by blocked dense products.

Anchors are dealt into blocks of bounded size. A block is broadcast and multiplied with each batch of candidate rows, in
float64, which is exact for integers below 2^53. The first pass keeps each anchor's best rows of its own label in every
task; such lists merge by taking the best of their union. The second pass has the positives' scores, hence the window of
scores that a negative may have, and keeps the best rows of other labels in each window likewise. What leaves a task is
a few rows an anchor, never a pair of all; rows are read where they lie.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, scratch, small_batches

#: What a block of anchors may take: bytes of vectors, and anchors, as a task holds a few best rows for each.
BLOCK_BYTES = 32 << 20
BLOCK_ANCHORS = 1 << 16
#: Scores held at once.
CELLS = 1 << 21
EXACT = 1 << 53
LONG = np.iinfo(np.int64)


def vectors(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of vector: places in the column, and the components as floor(scale * x)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.floor(flat[starts[at][:, None] + np.arange(d)].astype(np.float64) * scale)


def wide(x: np.ndarray) -> np.ndarray:
    """Rows whose product with another such row may reach 2^53."""
    return np.abs(x).max(axis=1, initial=0) >= math.sqrt(EXACT / max(1, x.shape[1]))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows of x with all of y: float64 holding integers, or long where wide rows are among them.

    Products with wide rows are made of Python's integers and end at the limits of a long.
    """
    wx, wy = wide(x), wide(y)
    if not wx.any() and not wy.any():
        return x @ y.T
    out = (np.where(wx[:, None], 0, x) @ np.where(wy[:, None], 0, y).T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = lambda m, v: [min(max(int(s), LONG.min), LONG.max) for s in whole(m).astype(object) @ whole(v).astype(object)] if m.shape[1] else 0
    for i in np.flatnonzero(wx):
        out[i] = exact(y, x[i])
    for j in np.flatnonzero(wy):
        out[:, j] = exact(x, y[j])
    return out


class Best:
    """For each of n slots the k best rows seen: highest score, then smallest id, then smallest row number."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LONG.min)
        self.id = np.full((n, k), LONG.max)
        self.row = np.full((n, k), LONG.max)
        self.n = np.zeros(n, np.int64)

    def least(self) -> np.ndarray:
        """The score a row needs at least, of each slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        score = score.astype(np.int64)
        full = self.n[slot] == self.k
        use = ~full | (score > self.score[slot, -1]) | ((score == self.score[slot, -1]) & (ids <= self.id[slot, -1]))
        slot, score, ids, row = slot[use], score[use], ids[use], row[use]
        if not len(slot):
            return
        touched = np.unique(slot)
        held = np.arange(self.k) < self.n[touched][:, None]
        slot = np.concatenate([np.repeat(touched, self.n[touched]), slot])
        score, ids, row = (np.concatenate([a[touched][held], b]) for a, b in ((self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, ~score, slot))  # the complement falls as the score rises, down to the least long
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        at, order = (slot[rank < self.k], rank[rank < self.k]), order[rank < self.k]
        self.score[at], self.id[at], self.row[at] = score[order], ids[order], row[order]
        self.n[touched] = np.bincount(np.searchsorted(touched, at[0]), minlength=len(touched))

    def rows(self) -> tuple[np.ndarray, ...]:
        """slot, score, id and row of all that is held."""
        slot, place = np.nonzero(np.arange(self.k) < self.n[:, None])
        return slot, self.score[slot, place], self.id[slot, place], self.row[slot, place]


def leading(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells that fit, without those that k or more of their line surpass."""
    if scores.shape[1] > k and np.count_nonzero(fit) > 8 * k * len(scores):
        low = -np.inf if scores.dtype == np.float64 else LONG.min
        masked = np.where(fit, scores, low)
        fit &= masked >= np.partition(masked, -k, axis=1)[:, -k, None]
    return np.nonzero(fit)


class Block:
    """Anchors of one length of vector, in order of label; with their positives, what a second pass needs."""

    def __init__(self, x: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray):
        order = np.lexsort((row, label))
        self.x, self.row, self.id, self.label = x[order], row[order], ids[order], label[order]

    def aim(self, positives: dict[int, list[tuple[int, int]]], low: int, high: int, k: int) -> None:
        """Take in (id, score) of each anchor's positives, best first; a negative's score n has low * p <= 100 * n <= high * p."""
        self.positives = [positives.get(r, []) for r in self.row.tolist()]
        self.low, self.high = np.full((len(self.row), k), LONG.max), np.full((len(self.row), k), LONG.min)
        for i, some in enumerate(self.positives):
            for j, (_, p) in enumerate(some):
                self.low[i, j], self.high[i, j] = -(-low * p // 100), min(high * p // 100, LONG.max)

    def same(self, best: Best, y: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        """Pass one: rows of an anchor's label, but the anchor itself."""
        for value in np.intersect1d(label, self.label):
            of = np.flatnonzero(label == value)
            first, last = np.searchsorted(self.label, value), np.searchsorted(self.label, value, "right")
            step = max(1, CELLS // len(of))
            for a in range(first, last, step):
                part = slice(a, min(last, a + step))
                s = products(self.x[part], y[of])
                i, j = leading(s, (s >= best.least()[part, None]) & (self.row[part, None] != row[of]), best.k)
                best.add(i + a, s[i, j], ids[of[j]], row[of[j]])

    def other(self, best: Best, y: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        """Pass two: rows of other labels, for each positive those in its window."""
        k = self.low.shape[1]
        step = max(1, CELLS // len(row))
        for first in range(0, len(self.row), step):
            part = slice(first, first + step)
            s = products(self.x[part], y)
            least = np.maximum(self.low, best.least().reshape(-1, k))[part]
            top = self.high[part]
            fit = (s >= least.min(axis=1)[:, None]) & (s <= top.max(axis=1)[:, None]) & (self.label[part, None] != label)
            few = np.count_nonzero(fit) <= 8 * k * best.k * len(s)
            i, j = np.nonzero(fit) if few else (None, None)
            for p in range(k):
                if few:
                    v = s[i, j]
                    use = (v >= least[i, p]) & (v <= top[i, p])
                    a, b = i[use], j[use]
                else:
                    a, b = leading(s, fit & (s >= least[:, p, None]) & (s <= top[:, p, None]), best.k)
                best.add((a + first) * k + p, s[a, b], ids[b], row[b])


    def told(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> list:
        """What is known of each negative found: anchor, place among its positives, both ids, the positive's score, then the negative's."""
        anchor, place = np.divmod(slot, self.low.shape[1])
        pairs = np.array([self.positives[a][p] for a, p in zip(anchor.tolist(), place.tolist(), strict=True)], np.int64).reshape(-1, 2)
        return [self.row[anchor], place, self.id[anchor], pairs[:, 0], pairs[:, 1], ids, score, row]


def blocks(anchors: pa.Table, scale: int) -> dict[int, Block]:
    """A block for each length of vector of anchors (row, id, label, vector)."""
    out = {}
    for part in anchors.combine_chunks().to_batches():
        row, ids, label = (part[c].to_numpy() for c in ("row", "id", "label"))
        for at, x in vectors(part["vector"], scale):
            out[x.shape[1]] = Block(x, row[at], ids[at], label[at])
    return out


def _best(rows: DataFrame, sent, compare: str, k: int, slots: int, scale: int, names: str, emit: Callable[..., list]) -> DataFrame:
    """Of each task, what emit(block, slot, score, id, row) makes of its best rows: k of each slot, `slots` an anchor. `compare` is a method of Block."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(", ".join(f"{c} long" for c in names.split()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        best = {d: Best(len(b.row) * slots, k) for d, b in held.items()}
        for batch in batches:
            row, ids, label = (batch[c].to_numpy() for c in ("row", "id", "label"))
            for at, y in vectors(batch["vector"], scale):
                if y.shape[1] in held:
                    getattr(held[y.shape[1]], compare)(best[y.shape[1]], y, row[at], ids[at], label[at])
        for d, b in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in emit(held[d], *b.rows())], names=target.names)
        del best, held
        release()

    return rows.select("row", "id", "label", "vector").mapInArrow(run, target)


def _ranked(found: DataFrame, of: list[str], score: str, id: str, row: str, k: int) -> DataFrame:
    """The k best of each group, with their rank from 1."""
    order = Window.partitionBy(*of).orderBy(F.desc(score), id, row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block_bytes: int = BLOCK_BYTES, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors among rows (id, label, vector).

    A score is the inner product of floor(scale * x) of two rows; higher ones come first, ties by smaller id. An anchor's positives are its first `positives`
    other rows of its label, a positive's negatives the first `negatives` rows of other labels with low * p <= 100 * score <= high * p. Where there are fewer,
    those are returned; none, no row. Ids and labels are integers.

    Rows without an id, label or vector, or with a null or non-finite component (after scaling too) take no part. Rows that repeat an id are rows of their own: each
    is an anchor, and positive of the others. Vectors of different length have no score; empty ones score 0. Equal vectors tie. Scores of rows with components over
    about 2^23 are computed as whole integers and end at the limits of a long. An empty table, or no anchor, gives none. Other columns are not read.

    Each block of anchors, of `block_bytes` and `block_anchors` at most on average, is two passes over the rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf")))
    use = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", is_anchor.alias("anchor"))
    use = use.where("id is not null and label is not null and vector is not null").where(finite)
    table = materialise(use.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, size = table.where("anchor").agg(F.count("*"), F.sum(F.size("vector") * 8)).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    count = max(math.ceil(size / block_bytes), math.ceil(n / block_anchors), 1)
    dealt, out = scratch(spark, "anchors"), scratch(spark, "negatives")
    anchors = table.where("anchor").select("row", "id", "label", "vector", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("block"))
    anchors.write.partitionBy("block").parquet(dealt)
    anchors = spark.read.schema(anchors.schema).parquet(dealt)
    for b in range(count):
        held = blocks(anchors.where(F.col("block") == b).toArrow(), scale)
        sent = spark.sparkContext.broadcast(held)
        found = _best(table, sent, "same", positives, 1, scale, "anchor positive score row", lambda block, slot, score, ids, row: [block.row[slot], ids, score, row])
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for anchor, positive, score in _ranked(found, ["anchor"], "score", "positive", "row", positives).orderBy("anchor", "rank").select("anchor", "positive", "score").toLocalIterator():
            near[anchor].append((positive, score))
        sent.destroy()
        for block in held.values():
            block.aim(near, low, high, positives)
        sent = spark.sparkContext.broadcast(held)
        found = _best(table, sent, "other", negatives, positives, scale, "anchor place anchor_id positive_id positive_score negative_id negative_score row", lambda block, slot, score, ids, row: block.told(slot, score, ids, row))
        _ranked(found, ["anchor", "place"], "negative_score", "negative_id", "row", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        sent.destroy()
    return spark.read.schema(RESULT).parquet(out)
