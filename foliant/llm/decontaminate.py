"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows: `width` consecutive words of an item, or all words of a
shorter one. Texts are word sequences, and a block is two words. The shift table says how far a
block lets the search jump: a block that no pattern has lets it pass by a whole window less one word.
Only where a block ends some pattern does a hash of the window's words, that block among them, name the patterns to compare
directly. Windows of each length have tables of their own, so a short item does not shorten the jumps of the others.

Words are numbers, and a window is a place in the items' one row of numbers, so tables take a few hundred bytes a word of the benchmark.
Documents stream through the search where they lie. The benchmark is read in blocks of a fixed number of
words, and each block is broadcast; one block is the usual case. Of several, each is a pass over the texts that keeps
only what it found, by the text's hash; texts are neither written nor shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, materialise, with_text

WIDTH = 13
#: Words of the benchmark that one broadcast covers: tables of at most about 250 MB in each worker.
BLOCK_WORDS = 400_000
_SPACE = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = bytes.maketrans(bytes(range(65, 91)) + bytes(_SPACE), bytes(range(97, 123)) + b" " * len(_SPACE))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def hashed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h


class WuManber:
    """All windows of one length, of items that are rows of word numbers."""

    def __init__(self, length: int, items: list[tuple[int, np.ndarray]]):
        n = self.length = length
        self.stream = np.concatenate([w for _, w in items])
        sizes = np.array([len(w) for _, w in items])
        first = np.cumsum(sizes) - sizes
        inside = np.arange(len(self.stream)) - np.repeat(first, sizes)
        left = np.repeat(sizes, sizes) - inside
        owner = np.repeat(np.array([i for i, _ in items], np.int64), sizes)
        starts = np.flatnonzero(left >= n)
        rows = self.stream[starts[:, None] + np.arange(n)] if n < 3 else np.lib.stride_tricks.sliding_window_view(self.stream, n)[starts]
        h = hashed(rows)
        #: Hashes of the windows, to tell at once that there is none.
        self.some = {x for a in range(0, len(rows), 10_000) for x in map(hash, map(tuple, rows[a : a + 10_000].tolist()))}
        del rows
        order = np.argsort(h, kind="stable")
        self.hashes, self.at, self.owner = h[order], starts[order], owner[starts[order]]
        self.shift: dict[int, int] = {}
        if n > 1:
            # the block of an item's words j - 1 and j ends its window at j, or, before the first window's end, lies n - 1 - j words before that
            ends = np.flatnonzero(inside >= 1)
            keys = self.stream[ends - 1].astype(np.int64) << 32 | self.stream[ends]
            shift = np.maximum(0, n - 1 - inside[ends])
            order = np.lexsort((shift, keys))
            keys, shift = keys[order], shift[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            self.shift = dict(zip(keys[new].tolist(), shift[new].tolist(), strict=True))

    def same(self, ids: list[int]) -> np.ndarray:
        """The items that have the window, one by one compared with those whose hash is its; none if no item has."""
        window = np.array(ids, self.stream.dtype)
        h = hashed(window[None, :])[0]
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hits = [k for k in range(lo, hi) if np.array_equal(self.stream[self.at[k] : self.at[k] + self.length], window)]
        return np.unique(self.owner[hits]) if hits else self.owner[:0]

    def search(self, words: list[bytes], ids: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """(start, items) of each occurrence of each window."""
        n, shift, total, number, some = self.length, self.shift.get, len(words), ids.get, self.some
        known: dict[tuple[int, ...], np.ndarray] = {}
        end, jump = n, n - 1
        while end <= total:
            last = number(words[end - 1])
            if last is None:
                end += n
                continue
            if jump:
                before = number(words[end - 2])
                step = jump if before is None else shift(before << 32 | last, jump)
                if step:
                    end += step
                    continue
            window = [number(w, -1) for w in words[end - n : end]]
            if window[0] >= 0 and min(window) >= 0:
                key = tuple(window)
                if hash(key) in some:
                    found = known.get(key)
                    if found is None:
                        found = known[key] = self.same(window)
                    if len(found):
                        yield end - n, found
            end += 1


class Matcher:
    """The windows of items (id, words): at most about 600 bytes a word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WIDTH):
        self.names = [i for i, _ in items]
        self.ids: dict[bytes, int] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for at, (_, words) in enumerate(items):
            if words:
                row = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], np.int32)
                by.setdefault(min(width, len(words)), []).append((at, row))
        self.tables = [WuManber(n, rows) for n, rows in by.items()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) ranges of hit words, and the ids of items with an occurrence."""
        ranges, items = [], set()
        for table in self.tables:
            for start, found in table.search(words, self.ids):
                ranges.append((start, start + table.length))
                items.update(found.tolist())
        return merged(ranges), {self.names[i] for i in items}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, limit: int, width: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's rows (item_id, text) as words in lists of at most about `limit`, read one block after another; a longer item in parts that share width - 1 words."""
    rows, held = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(r[1])
        for a in range(0, max(1, len(words) - width + 1), limit):
            part = words[a : a + limit + width - 1]
            rows.append((r[0], b" ".join(part)))
            held += len(part)
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


RESULT = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def verdict(n_words: int, hits: int, ids: list[str], share: int) -> tuple:
    return n_words, hits, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), hits > 0 and share * hits >= n_words


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Columns `keep`, n_words, n_hit, n_items, items (ids as strings, sorted), items_sha256 and contaminated.

    contaminated: at least one word is hit, and n_hit x share >= n_words. Null texts have no words; items
    without words have no windows; null item ids or texts are left out; repeated rows are each judged; an empty benchmark hits
    nothing, an empty table gives no rows. Only `keep` and `text` are read. The whole text is searched.

    The driver holds one block of the benchmark, of about `block_words` words. Beyond one block, each is a pass over the texts whose finds are written;
    they are joined to the rows by the text's 128-bit hash.
    """
    rows, column = with_text(docs, keep)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    several = blocks(benchmark, block_words, width)
    items, following = next(several, []), next(several, None)
    if not following:
        return _search(rows, items, ddl, keep, column, width, share)
    texts, parts = docs.select(F.col("text").cast("string").alias("__text")), []
    while items:
        parts.append(materialise(_finds(texts, items, width), "benchmark-block"))
        items, following = following, next(several, None) if following else None
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = _counted(rows, ddl, keep, column)
    return _judged(counted.join(found, counted.__key == found.key, "left").drop("key"), ddl, keep, share)


def _matcher(items: list[tuple[str, bytes]], width: int) -> Matcher:
    return Matcher([(i, words.split()) for i, words in items], width)


def _search(rows: DataFrame, items: list, ddl: str, keep: tuple[str, ...], column: str, width: int, share: int) -> DataFrame:
    """The result of a benchmark of one block."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def setup():
        matcher = kept(key, lambda: _matcher(shared.value, width))

        def step(batch: pa.RecordBatch) -> dict:
            out = {c: batch[c] for c in keep} | {k: [] for k in NAMES}
            for text in batch[column]:
                words = words_of(text.as_py())
                ranges, found = matcher.find(words)
                for k, v in zip(NAMES, verdict(len(words), sum(b - a for a, b in ranges), sorted(found), share), strict=True):
                    out[k].append(v)
            return out

        return step

    return map_batches(rows, f"{ddl}, {RESULT}", setup)


def _key(text: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _finds(texts: DataFrame, items: list, width: int) -> DataFrame:
    """(key, hit, items) of each text that has a window of one block."""
    shared = texts.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def setup():
        matcher = kept(key, lambda: _matcher(shared.value, width))

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"key": [], "hit": [], "items": []}
            seen = set()
            for text in batch["__text"]:
                text = text.as_py() or ""
                ranges, found = matcher.find(words_of(text))
                if ranges and (own := _key(text)) not in seen:
                    seen.add(own)
                    out["key"].append(own)
                    out["hit"].append([{"a": a, "b": b} for a, b in ranges])
                    out["items"].append(sorted(found))
            return out

        return step

    found = map_batches(texts, "key string, hit array<struct<a:int,b:int>>, items array<string>", setup)
    return found.groupBy("key").agg(F.first("hit").alias("hit"), F.first("items").alias("items"))


def _counted(rows: DataFrame, ddl: str, keep: tuple[str, ...], column: str) -> DataFrame:
    """keep, n_words and the text's hash."""

    def setup():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [t.as_py() or "" for t in batch[column]]
            return {c: batch[c] for c in keep} | {"__n": [len(words_of(t)) for t in texts], "__key": list(map(_key, texts))}

        return step

    return map_batches(rows, f"{ddl}, __n long, __key string", setup)


def _judged(rows: DataFrame, ddl: str, keep: tuple[str, ...], share: int) -> DataFrame:
    def setup():
        def step(batch: pa.RecordBatch) -> dict:
            out = {c: batch[c] for c in keep} | {k: [] for k in NAMES}
            for n, hit, ids in zip(*[batch[c].to_pylist() for c in ("__n", "__hit", "__items")], strict=True):
                hits = sum(b - a for a, b in merged([(r["a"], r["b"]) for r in hit or []]))
                for k, v in zip(NAMES, verdict(n, hits, ids or [], share), strict=True):
                    out[k].append(v)
            return out

        return step

    return map_batches(rows.select(*keep, "__n", F.col("hit").alias("__hit"), F.col("items").alias("__items")), f"{ddl}, {RESULT}", setup)
