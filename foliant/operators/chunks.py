"""Chunks of about 800 tokens with whole-block overlap, and greedy paragraph packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_id

TARGET, OVERLAP = 800, 80
SCHEMA = "book_id string, chapter_id long, ordinal int, text string, token_count int, first_block int, n_blocks int, start_offset int, end_offset int"


def cut(tokens: list[int], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[first, end) block ranges. A block that would pass the target closes the chunk; the next begins with the trailing blocks that fit the overlap."""
    out: list[tuple[int, int]] = []
    first, held = 0, 0
    for i, n in enumerate(tokens):
        if held + n > target and i > first:
            out.append((first, i))
            first, held = i, 0
            while first > out[-1][0] and held + tokens[first - 1] <= overlap:
                first -= 1
                held += tokens[first]
        held += n
    if tokens:
        out.append((first, len(tokens)))
    return out


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def chunk(chapters: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of chapters (book_id, chapter_id, blocks array<string>): the fold is within a row, so nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, chapter, blocks in zip(frame["book_id"], frame["chapter_id"], frame["blocks"], strict=True):
                starts, at = [], 0
                for b in blocks:
                    starts.append(at)
                    at += len(b) + 1
                for k, (i, j) in enumerate(cut([estimate(b) for b in blocks], target, overlap)):
                    text = "\n".join(blocks[i:j])
                    rows.append((book, chapter, k, text, estimate(text), i, j - i, starts[i], starts[j - 1] + len(blocks[j - 1])))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    made = chapters.select(F.col("book_id").cast("string").alias("book_id"), F.col("chapter_id").cast("long").alias("chapter_id"), "blocks").where("blocks is not null").mapInPandas(run, SCHEMA)
    return made.select(chunk_id(F.col("book_id"), F.col("chapter_id"), F.col("ordinal")).alias("chunk_id"), "*")


#: Characters of pieces that are handed on at once.
HELD = 4_000_000


def pack_paragraphs(texts: DataFrame, most: int) -> DataFrame:
    """(id, piece, text): paragraphs (split at blank lines) packed greedily up to `most` tokens, without overlap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, chars = [], 0
            for key, text in zip(frame["id"], frame["text"], strict=True):
                piece, held, n = "", 0, 0
                for p in (text or "").split("\n\n"):
                    size = len(p) // 4
                    if piece and held + size > most:
                        rows.append((key, n, piece.strip()))
                        piece, held, n = p, size, n + 1
                    else:
                        piece, held = (piece + "\n\n" + p if piece else p), held + size
                if piece:
                    rows.append((key, n, piece.strip()))
                chars += len(text or "")
                if chars > HELD:
                    yield pd.DataFrame(rows, columns=["id", "piece", "text"])
                    rows, chars = [], 0
            yield pd.DataFrame(rows, columns=["id", "piece", "text"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, piece int, text string")
