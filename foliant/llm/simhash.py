"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits; those that differ in at most three are linked. Two halves of 32 bits
share the difference, so in one of them it is at most one bit. Each half's space is covered by
anchors: the code words of the perfect [31, 26] Hamming code, with either value of the last bit,
so that every half lies within distance one (the covering radius) of an anchor. A fingerprint
has one home anchor in each half and is replicated to all anchors within radius plus threshold, that is
within two. If two fingerprints are within one bit in a half, the second visits the home of the first; so
comparing visitors with residents at each anchor finds every link: at most 2 x 18 rows a fingerprint.

Equal fingerprints are merged before anything is replicated, so copies cost one row. At an anchor
links are reduced to a spanning forest before they leave the task. An anchor
with over `most` rows is split into squares of residents against visitors, so no task holds
more than two sides of `most` rows, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, with_text
from .components import components

WIDTH = 3
SEED = 42
BITS = 3
SMALL = 8  # groups up to this size are compared by offsets, all groups of a batch at once


def shingles(text: str | None) -> list[bytes]:
    """The hashed units of a text: word triples, or the whole sequence of fewer words; none without words.

    A-Z are lower-cased; words end at ASCII white space (space, and 9 to 13).
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) < WIDTH:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))


def fingerprint(text: str | None) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' hashes. No words: zero."""
    import xxhash

    units = shingles(text)
    if not units:
        return 0
    ones, done, step = np.zeros(64, np.int64), 0, 1 << 15
    while done < len(units):
        part = units[done : done + step]
        h = np.fromiter((xxhash.xxh64_intdigest(u, SEED) for u in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += step
    return int.from_bytes(np.packbits(2 * ones > len(units), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and fp (the 64 bits as a long) of each row of docs, over whole texts."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows, text = with_text(docs, keep)

    def setup():
        def step(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(x.as_py()) for x in batch[text]], np.uint64)
            return {c: batch[c] for c in keep} | {"fp": pa.array(found.view(np.int64))}

        return step

    return map_batches(rows, f"{ddl}, fp long", setup)


def _changes() -> np.ndarray:
    """[32, 18]: by syndrome of a half, what to flip to reach each anchor within two, its home first; 0 repeats the home's.

    The half's lowest bit is free; bits 1 to 31 are the code's, and a bit's number is its column in the
    parity check, so a word is a code word if the numbers of its set bits cancel out under exclusive or.
    """
    rows = []
    for s in range(32):
        home = (1 << s) if s else 0
        near = [home, home | 1] + [(1 << i) | (1 << (i ^ s)) for i in range(1, 32) if s and i < i ^ s]
        rows.append(near + [home] * (18 - len(near)))
    return np.array(rows, np.uint64)


CHANGES = _changes()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of uint64 fingerprints: key of each anchor, the fingerprint's index, and whether it is at home there."""
    keys, index, home = [], [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = np.zeros(len(x), np.int64)
        for i in range(1, 32):
            syndrome ^= np.where((x >> np.uint64(i)) & np.uint64(1), i, 0)
        change = CHANGES[syndrome]
        use = np.ones(change.shape, bool)
        use[:, 2:] = change[:, 2:] != change[:, :1]
        at = (x[:, None] ^ change) | np.uint64(half << 32)
        rows = np.broadcast_to(np.arange(len(x))[:, None], use.shape)
        first = np.zeros(use.shape, bool)
        first[:, 0] = True
        keys.append(at[use])
        index.append(rows[use])
        home.append(first[use])
    return np.concatenate(keys).view(np.int64), np.concatenate(index), np.concatenate(home)


def compare(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that join the components of the fingerprints at one anchor.

    Each member is compared with those that no component has yet, so a dense group costs little more than one scan.
    """
    rest, left, right = np.arange(len(fps)), [], []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        stack = [seed]
        while stack and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[stack.pop()]) <= bits
            if near.any():
                hit, rest = rest[near], rest[~near]
                stack.extend(hit.tolist())
                left.append(fps[hit])
                right.append(np.full(len(hit), fps[seed]))
    none = fps[:0]
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(distinct: DataFrame, most: int = 20_000, bits: int = BITS) -> DataFrame:
    """(a, b): links between different fingerprints (fp) enough to connect all that are within `bits`."""

    def spread():
        def step(batch: pa.RecordBatch) -> dict:
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            keys, index, home = anchors(fps.view(np.uint64))
            return {"key": pa.array(keys), "fp": pa.array(fps[index]), "home": pa.array(home)}

        return step

    rows = map_batches(distinct.select("fp"), "key long, fp long, home boolean", spread)
    large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = materialise(large.select("key", F.ceil(F.col("n") / most).cast("int").alias("side")), "large-anchors")
    if not large.limit(1).count():
        return _at_anchors(rows.withColumn("square", F.lit(0)), bits)
    marked = rows.join(large, "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    # a resident meets all blocks of visitors, and visits those of the other residents as well
    squares = F.when(F.col("side").isNull(), F.array(F.struct(F.lit(0).alias("square"), F.col("home").alias("home")))).when(
        F.col("home"), F.concat(F.transform(every, lambda j: F.struct((own * F.col("side") + j).alias("square"), F.lit(True).alias("home"))), F.transform(every, lambda i: F.struct((i * F.col("side") + own).alias("square"), F.lit(False).alias("home"))))
    ).otherwise(F.transform(every, lambda i: F.struct((i * F.col("side") + own).alias("square"), F.lit(False).alias("home"))))
    return _at_anchors(marked.select("key", "fp", F.explode(squares).alias("s")).select("key", "fp", "s.home", "s.square"), bits)


def _at_anchors(rows: DataFrame, bits: int) -> DataFrame:
    """Compare within each (key, square): rows arrive sorted, so only the group at hand is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            part = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "square", "fp", "home")])
            part = np.concatenate([*held, part], axis=1) if held else part
            new = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1
            last = new[-1] if len(new) else 0
            yield from groups(part[:, :last], new[:-1])
            held = [part[:, last:]]
        if held:
            yield from groups(held[0], np.zeros(0, np.int64))

    def groups(part: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not part.shape[1]:
            return
        edges = np.concatenate([[0], cuts, [part.shape[1]]]).astype(np.int64)
        sizes = np.diff(edges)
        fps, home = part[2].view(np.uint64), part[3].astype(bool)
        left, right = [], []
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[group] <= SMALL
        for d in range(1, SMALL):
            i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
            if not len(i):
                break
            good = i[(home[i] | home[i + d]) & (np.bitwise_count(fps[i] ^ fps[i + d]) <= bits)]
            left.append(fps[good])
            right.append(fps[good + d])
        for i in np.flatnonzero(sizes > SMALL):
            at = slice(edges[i], edges[i + 1])
            if home[at].any():
                a, b = compare(fps[at], bits)
                left.append(a)
                right.append(b)
        if not left:
            return
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    dealt = rows.select("key", "square", "fp", "home").repartition("key", "square").sortWithinPartitions("key", "square")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def classes(made: DataFrame, most: int = 20_000) -> DataFrame:
    """(fp, root, component, alone): of each fingerprint in made (doc_id, fp), its component's smallest fingerprint and smallest doc_id, and whether one row is all of it."""
    distinct = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = materialise(components(links(distinct, most)), "roots")
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "root", "n")
    smallest = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    joined = named.join(smallest, "root", "left")
    return materialise(joined.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component"), (F.col("root").isNull() & (F.col("n") == 1)).alias("alone")), "components")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), most: int = 20_000, salts: int = 16) -> DataFrame:
    """Columns `keep` (doc_id among them), fp and component_id: the smallest doc_id that links lead to, its own included.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other.
    Rows with a null doc_id take part, but never name a component unless no member has an id. Repeated rows are
    equal fingerprints. An empty table gives none. Only `keep` and `text` are read.

    A row that is alone names itself; only the other fingerprints are joined, with `salts` parts each, so that one that a third of all rows have is met by many tasks.
    """
    made = materialise(fingerprints(docs, keep), "fingerprints")
    table = classes(made, most).where("not alone").select("fp", F.col("component").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    dealt = made.withColumn("__salt", (F.monotonically_increasing_id() % salts).cast("int"))
    return dealt.join(table, ["fp", "__salt"], "left").select(*keep, "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def group(made: DataFrame, most: int = 20_000) -> DataFrame:
    """(row) of the row that stays of each component of made (doc_id, row, fp): smallest doc_id, null last, then smallest row."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    of_fp = made.groupBy("fp").agg(least.alias("least"))
    return of_fp.join(classes(made, most).select("fp", "root"), "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
