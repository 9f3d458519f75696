"""WordPiece ids by greedy longest match."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def words(text: str) -> Iterator[str]:
    """Words and single punctuation characters, found as they are asked for."""
    word = ""
    for c in text:
        mark = c in string.punctuation or unicodedata.category(c).startswith("P")
        if c.isspace() or mark:
            if word:
                yield word
            word = ""
            if mark:
                yield c
        else:
            word += c
    if word:
        yield word


def pieces(word: str, vocabulary: dict[str, int]) -> list[str]:
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                break
        else:
            return ["[UNK]"]
        out.append(piece)
        at = end
    return out


def encode(text: str, vocabulary: dict[str, int], length: int = 512, specials: bool = True) -> tuple[list[int], list[int]]:
    """(ids, attention mask), cut to leave room for [CLS] and [SEP], padded to `length`."""
    room = length - 2 if specials else length
    every = (p for w in words(text.lower()) for p in pieces(w, vocabulary))
    found = list(islice(every, room)) if room >= 0 else list(every)[:room]
    ids = [vocabulary.get(p, vocabulary["[UNK]"]) for p in (["[CLS]", *found, "[SEP]"] if specials else found)]
    pad = length - len(ids)
    return ids + [vocabulary["[PAD]"]] * pad, [1] * len(ids) + [0] * pad


#: Ids that are handed on at once.
HELD = 1 << 18


def encode_texts(texts: DataFrame, vocabulary: dict[str, int], length: int = 512) -> DataFrame:
    """ids and mask of texts (id, text); the vocabulary is broadcast, and a parameter of bounded size."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)
    kind = texts.schema["id"].dataType.simpleString()

    def lists(rows: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // max(1, length))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                both = [[np.array(x, np.int32) for x in encode(t.as_py() or "", shared.value, length)] for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["id"], lists([b[0] for b in both]), lists([b[1] for b in both])], names=["id", "ids", "mask"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, ids array<int>, mask array<int>")
