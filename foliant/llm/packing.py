"""Best-fit packing with Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so a packing instance of any size is a histogram
of at most `capacity` entries; only that reaches the driver. There, dominance first fixes for good the sets that some best packing has:
lengths that nothing fits beside, pairs that fill a sequence exactly, and a length that can take only one partner, with the
largest that fits. What remains is packed by best fit, longest first, in whole groups: sequences in the same state are
handled together, so the work depends on the number of different lengths and not of documents.

The plan comes back as runs: of the documents of one length, those with ranks from a to b go to consecutive sequences. Each
piece finds its place from its rank among equals. Ranks are counted in buckets with offsets, so a
length that a third of all documents share does not meet in one task.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import UNUSUAL, Vocabulary, mapped
from .common import Memo, map_batches, materialise

CAPACITY = 4096
END = 1


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, of a vocabulary of words that drops white space."""

    def __init__(self, path: str, limit: int = 144 << 20):
        import regex

        self.v = Vocabulary(path)
        #: Fixed value: the pattern of the vocabulary's file.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.bytes = [struct.pack("<I", i) for i in range(self.v.tokenizer.get_vocab_size())]
        self.chunks: Memo = Memo(self._chunk, limit)

    def _chunk(self, chunk: str) -> bytes:
        pieces = (chunk,) if chunk.isalpha() else self.pieces.findall(chunk)
        if len(pieces) == 1:
            table = self.bytes
            return b"".join([table[t.id] for t in self.v.model.tokenize(mapped(pieces[0]))])
        memo = self.chunks  # a piece is a chunk of one piece
        return b"".join([memo[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        if "<|" in text or UNUSUAL.search(text):
            ids = self.v.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, piece, start, length and ids_crc32: each text's ids and the end id, cut only where longer than the capacity."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def setup():
        encoder = WordEncoder(path)

        def step(batch: pa.RecordBatch) -> dict:
            row, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(batch["__text"]):
                ids = encoder.encode(x.as_py() or "") + struct.pack("<I", END)
                n = len(ids) // 4
                for k, a in enumerate(range(0, n, capacity)):
                    b = min(a + capacity, n)
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            at = pa.array(row, pa.int32())
            return {c: batch[c].take(at) for c in keep} | {"piece": piece, "start": start, "length": length, "ids_crc32": crc}

        return step

    return map_batches(docs.select(*keep, F.col("text").cast("string").alias("__text")), f"{ddl}, piece int, start long, length long, ids_crc32 long", setup)


class Plan:
    """Runs (length, first rank, end rank, first sequence, documents a sequence, offset) that pack a histogram."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = [0] * (capacity + 2)
        for size, n in histogram.items():
            self.left[size] = n
        self.given = list(self.left)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        self.reduce()
        self.best_fit()

    def take(self, size: int, n: int, base: int, each: int, offset: int) -> None:
        """Put n documents of a size into sequences from `base` on, `each` of them in one."""
        a = self.given[size] - self.left[size]
        self.left[size] -= n
        self.runs.append((size, a, a + n, base, each, offset))

    def set_of(self, n: int, *sizes: int) -> None:
        """Fix n sequences that each hold just these sizes."""
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            k = sizes.count(size)
            self.take(size, n * k, self.sequences, k, offset)
            offset += k * size
        self.sequences += n
        self.fixed += n

    def largest(self, limit: int) -> int:
        """The largest size left up to a limit, 0 for none."""
        while limit > 0 and not self.left[limit]:
            limit -= 1
        return max(limit, 0)

    def smallest(self, but: int = 0) -> tuple[int, int]:
        """The two smallest sizes left, counting copies and leaving out one copy of `but`; beyond the capacity for none."""
        found = []
        for size in range(1, self.capacity + 1):
            n = self.left[size] - (size == but)
            found += [size] * min(n, 2)
            if len(found) >= 2:
                break
        found += [self.capacity + 1] * 2
        return found[0], found[1]

    def reduce(self) -> None:
        """Repeat the dominance rules until none applies.

        A set dominates all others with its largest document x if what stands beside x can be exchanged for any
        other company of x: nothing, if nothing fits; a partner y with x + y equal to the capacity; or the
        largest y that fits, if no two documents do.
        """
        c, changed = self.capacity, True
        while changed:
            changed = False
            for x in range(c, 0, -1):
                if not self.left[x]:
                    continue
                first, second = self.smallest(x)
                if x + first > c:
                    self.set_of(self.left[x] if x + x > c else 1, x)
                    changed = True
                    continue
                y = c - x
                if y and self.left[y] and (y != x or self.left[x] > 1):
                    self.set_of(self.left[x] // 2 if x == y else min(self.left[x], self.left[y]), x, y)
                    changed = True
                    continue
                if first + second > y:
                    y = self.largest(y)
                    if y == x and self.left[x] < 2:
                        y = self.largest(y - 1)
                    # as copies run out the smallest sizes only grow, so the rule holds for all of them
                    n = self.left[x] // 2 if x == y else min(self.left[x], self.left[y])
                    if y and n:
                        self.set_of(n, x, y)
                        changed = True

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequence that has room; sequences in one state at a time."""
        c = self.capacity
        groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, number)
        mask = 0

        def put(room: int, base: int, n: int) -> None:
            nonlocal mask
            if n and room:
                groups.setdefault(room, []).append((base, n))
                mask |= 1 << room

        for size in range(c, 0, -1):
            while n := self.left[size]:
                above = mask >> size
                if above:
                    room = size + (above & -above).bit_length() - 1
                    base, count = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        mask &= ~(1 << room)
                else:
                    room, base, count = c, self.sequences, -(-n // (c // size))
                    self.sequences += count
                each = room // size
                full = min(count, n // each)
                if full:
                    self.take(size, full * each, base, each, c - room)
                    put(room - each * size, base, full)
                rest = min(n - full * each, each) if full < count else 0
                if rest:
                    self.take(size, rest, base + full, rest, c - room)
                    put(room - rest * size, base + full, 1)
                put(room, base + full + bool(rest), count - full - bool(rest))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",), bucket_rows: int = 500_000) -> DataFrame:
    """pieces_of() with sequence_id and offset: every piece in one sequence of at most `capacity` ids, without gaps.

    A null or empty text is the end id alone. Repeated rows are packed as documents of their own; no rows
    give no sequences. Only `keep` and `text` are read. The driver sees one row for each length, at most `capacity`.
    Ranks are counted among about `bucket_rows` pieces at most at a time, however many share a length.
    """
    spark = docs.sparkSession
    made = pieces_of(docs, path, capacity, keep).select("*", F.monotonically_increasing_id().alias("__row"))
    made = materialise(made, "pieces")
    buckets = max(64, made.count() // bucket_rows)
    bucket = F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int")
    counts = materialise(made.groupBy("length", bucket.alias("__bucket")).agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = Plan(histogram, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "__bucket", before.alias("__before"))
    ranked = made.select("*", bucket.alias("__bucket"), (F.row_number().over(Window.partitionBy("length", bucket).orderBy("__row")) - 1).alias("__rank"))
    ranked = ranked.join(offsets, ["length", "__bucket"]).select(*keep, "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__rank")).alias("__rank"))
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(runs)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def setup():
        runs = shared.value
        span = runs[:, 2].max() + 1 if len(runs) else 1
        keys = runs[:, 0] * span + runs[:, 1]

        def step(batch: pa.RecordBatch) -> dict:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            _, a, _, base, each, offset = runs[np.searchsorted(keys, length * span + rank, side="right") - 1].T
            i = rank - a
            return {c: batch[c] for c in (*keep, "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(base + i // each), "offset": pa.array(offset + i % each * length)}

        return step

    return map_batches(ranked, f"{ddl}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", setup)

