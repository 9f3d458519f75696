"""Chunks of chapters of any length: the fold of `chunks.cut`, run apart in parts of a chapter.

What the fold knows where a part begins is one number, the first block of the chunk that is open, at most `target` blocks back. Each part says for every such block which one is open at its end
and how many chunks it closed; a chapter's parts are strung together from these lists, and each part then cuts its own chunks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id
from ..plans.scratch import small, written
from .chunks import OVERLAP, TARGET
from .positions import BOOK, _sum_before

#: Blocks of a part.
SIZE = 1 << 17
KEYS = ["book_id", "chapter_id", "part"]


def states(tokens: np.ndarray, back: int, chapter_start: bool, target: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(open, closed) for each block that may be open where a part begins: the block open at its end, as a number of blocks before the end, and the chunks closed between.

    `tokens` begins with the `back` blocks before the part, which are these blocks, unless the chapter starts here: then its first block alone.
    A chunk that is at most the overlap long leaves its first block open, not the one that the overlap gives; the chunk after it never is, so two hops lead to a cut whose open block follows from its place.
    """
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    n = len(tokens)
    kept = np.searchsorted(sums, sums - overlap)  # of a cut at each place, the first block that the overlap takes

    def cut(first: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(sums, sums[first] + target, side="right") - 1, at)

    def hop(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(open block, cut or n, chunks closed) after one or two cuts."""
        one = np.minimum(cut(first, at), n)
        second = np.where(one < n, np.maximum(first, kept[one]), first)
        odd = (one < n) & (second > kept[one])
        two = np.where(odd, np.minimum(cut(second, np.minimum(one + 1, n)), n), one)
        last = np.where(odd & (two < n), kept[two], second)
        return last, two, (one < n).astype(np.int64) + (odd & (two < n))

    places = np.arange(back, n)
    opened, nexts, hops = (x.tolist() for x in hop(kept[places], places + 1))
    for i in range(n - back - 1, -1, -1):
        if nexts[i] < n:
            j = nexts[i] - back
            opened[i], hops[i] = opened[j], hops[i] + hops[j]
    entries = np.array([0]) if chapter_start else np.arange(back)
    first, at, closed = hop(entries, np.maximum(entries + 1, back))
    on = at < n
    first[on], closed[on] = np.array(opened)[at[on] - back], closed[on] + np.array(hops)[at[on] - back]
    return n - first, closed


def cuts(tokens: np.ndarray, back: int, first: int, target: int, overlap: int) -> tuple[list[tuple[int, int]], int]:
    """The chunks that a part closes, as [first, end) places in `tokens`, whose first `back` are before the part, and the block open at its end."""
    sums = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)]).tolist()
    out: list[tuple[int, int]] = []
    at = max(back, first + 1)
    while (end := max(bisect_right(sums, sums[first] + target) - 1, at)) < len(tokens):
        out.append((first, end))
        first, at = max(first, bisect_left(sums, sums[end] - overlap)), end + 1
    return out, first


def chunk_parts(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP, size: int = SIZE) -> DataFrame:
    """The chunks that `chunks.chunk` gives, of blocks (book_id, chapter_id, ordinal, text), for chapters that no row or task should hold.

    Ordinals of a chapter run from 0 without gaps or repeats. A null text counts as empty. Only two numbers a block go to the parts; texts are shuffled once, by chunk. The lists of a chapter's
    parts come to one task: up to `target` pairs of numbers for each `size` blocks, about 50 MB for a chapter of a billion blocks.
    """
    reach = max(target, overlap + 1)
    if overlap > target or size < reach:
        raise ValueError(f"the overlap ({overlap}) must not be above the target ({target}), nor a part ({size} blocks) below {reach} blocks")
    told = blocks.select(F.col("book_id").cast("string").alias("book_id"), F.col("chapter_id").cast("long").alias("chapter_id"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    part, chars = F.floor(F.col("ordinal") / size), F.length("text").cast("long")
    near = F.col("ordinal") >= (part + 1) * size - reach
    sized = told.select("book_id", "chapter_id", F.explode(F.when(near, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"), "ordinal", F.greatest(F.lit(1), F.floor(chars / 4)).cast("long").alias("tokens"), chars.alias("chars"))
    sized = written(sized, "sized")

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        book, chapter, number = rows.loc[rows.index[0], KEYS]
        back = int((rows["ordinal"] < number * size).sum())
        if back == len(rows):  # a chapter that ends with the part before
            return pd.DataFrame(columns=[*KEYS, "opened", "closed", "chars"])
        opened, closed = states(rows["tokens"].to_numpy(), back, number == 0, target, overlap)
        return pd.DataFrame({"book_id": [book], "chapter_id": [chapter], "part": [number], "opened": [opened], "closed": [closed], "chars": [int((rows["chars"].to_numpy()[back:] + 1).sum())]})

    def strung(lists: pd.DataFrame) -> pd.DataFrame:
        lists = lists.sort_values("part")
        out, opened, closed, chars = [], 0, 0, 0  # the open block, as a number of blocks before the part
        for row in lists.itertuples():
            out.append((row.book_id, row.chapter_id, row.part, opened, closed, chars, row.part == len(lists) - 1))
            entry = len(row.opened) - opened if row.part else 0
            opened, closed, chars = int(row.opened[entry]), closed + int(row.closed[entry]), chars + row.chars
        return pd.DataFrame(out, columns=[*KEYS, "opened", "number", "before", "ends"])

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        head = rows.iloc[0]
        tokens, chars = rows["tokens"].to_numpy(), rows["chars"].to_numpy()
        back = int((rows["ordinal"] < head["part"] * size).sum())
        found, first = cuts(tokens, back, back - int(head["opened"]), target, overlap)
        if head["ends"]:
            found.append((first, len(tokens)))
        starts = np.concatenate([[0], np.cumsum(chars + 1)])
        starts += head["before"] - starts[back]
        base, at = int(head["ordinal"]), np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame(
            {
                "book_id": head["book_id"],
                "chapter_id": head["chapter_id"],
                "ordinal": head["number"] + np.arange(len(at)),
                "first_block": base + at[:, 0],
                "n_blocks": at[:, 1] - at[:, 0],
                "start_offset": starts[at[:, 0]],
                "end_offset": starts[at[:, 1]] - 1,
            }
        )

    keys = "book_id string, chapter_id long, part long"
    lists = sized.groupBy(*KEYS).applyInPandas(mapped, f"{keys}, opened array<int>, closed array<int>, chars long")
    entries = lists.groupBy("book_id", "chapter_id").applyInPandas(strung, f"{keys}, opened int, number long, before long, ends boolean")
    entries = written(entries, "entries")
    made = sized.join(small(entries), KEYS).groupBy(*KEYS).applyInPandas(folded, "book_id string, chapter_id long, ordinal long, first_block long, n_blocks long, start_offset long, end_offset long")
    each = made.select("book_id", "chapter_id", F.struct(*made.columns[2:]).alias("c"), F.explode(F.expr("sequence(first_block, first_block + n_blocks - 1)")).alias("ordinal"))
    texts = each.join(told, ["book_id", "chapter_id", "ordinal"]).groupBy("book_id", "chapter_id", "c").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("l"))
    text = F.array_join("l.text", "\n")
    flat = texts.select("book_id", "chapter_id", "c.*", text.alias("text"), F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int").alias("token_count"))
    return flat.select(chunk_id(F.col("book_id"), F.col("chapter_id"), F.col("ordinal")).alias("chunk_id"), "book_id", "chapter_id", "ordinal", "text", "token_count", "first_block", "n_blocks", "start_offset", "end_offset")


def whole_books(blocks: DataFrame, most: int = BOOK) -> DataFrame:
    """blocks (book_id, chapter_id, ordinal, text) with each book as one chapter, number 0: its chapters' blocks on end, in order of chapter_id."""
    counts = blocks.groupBy("book_id", F.col("chapter_id").alias("spine_index")).agg(F.count("*").alias("n"))
    before = _sum_before(counts, "n", "before", most).select("book_id", F.col("spine_index").alias("chapter_id"), "before")
    return blocks.join(before, ["book_id", "chapter_id"]).select("book_id", F.lit(0).cast("long").alias("chapter_id"), (F.col("before") + F.col("ordinal")).alias("ordinal"), "text")
