"""Chunks of a chapter in parts against the fold over its blocks."""

import random

import numpy as np
import pytest

from foliant.operators import chunks, parts


def lengths(rng, n):
    """Token counts: small, about the target, huge, and runs of ones."""
    kinds = [lambda: 1, lambda: rng.randrange(1, 6), lambda: rng.randrange(1, 40), lambda: rng.choice([1, 2, 18, 19, 20, 21, 500])]
    out = []
    while len(out) < n:
        kind = rng.choice(kinds)
        out += [kind() for _ in range(rng.randrange(1, 30))]
    return out[:n]


@pytest.mark.parametrize("overlap", [0, 3, 19, 20])
def test_states_and_cuts_give_the_fold(overlap):
    rng, target = random.Random(overlap), 20
    reach = max(target, overlap + 1)
    for n in (*range(1, 60), 300, 1000):
        tokens, size = lengths(rng, n), rng.choice([reach, reach + 1, 37, 64])
        got, opened, closed = [], 0, 0
        for lo in range(0, n, size):
            base, hi = max(0, lo - reach), min(n, lo + size)
            own, back = np.array(tokens[base:hi]), lo - base
            assert closed == len(got)
            found, first = parts.cuts(own, back, back - opened, target, overlap)
            got += [(base + a, base + b) for a, b in found]
            ends, counts = parts.states(own, back, lo == 0, target, overlap)
            assert lo == 0 or len(ends) == back
            entry = back - opened if lo else 0
            opened, closed = int(ends[entry]), closed + int(counts[entry])
            assert base + first == hi - opened
        assert [*got, (n - opened, n)] == chunks.cut(tokens, target, overlap), (n, size)


def test_chapters_in_parts_equal_chapters_in_rows(spark):
    rng = random.Random(5)
    texts = {("a", 1): ["x" * (4 * t + rng.randrange(4)) for t in lengths(rng, 700)], ("a", 2): [""], ("b", 1): ["é𝄞" * 30] * 130, ("b", 2): ["", "y" * 9000, "", "z" * 10], ("c", 1): ["w"] * 128}
    rows = spark.createDataFrame([(*k, v) for k, v in texts.items()], "book_id string, chapter_id long, blocks array<string>")
    flat = spark.createDataFrame([(*k, i, t) for k, v in texts.items() for i, t in enumerate(v)], "book_id string, chapter_id long, ordinal int, text string")
    want = chunks.chunk(rows, 20, 4)
    for size in (32, 64, 1000):
        got = parts.chunk_parts(flat.repartition(3), 20, 4, size).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), size


def test_odd_input(spark):
    none = spark.createDataFrame([], "book_id string, chapter_id long, ordinal int, text string")
    assert parts.chunk_parts(none).collect() == []
    blank = spark.createDataFrame([("a", 1, 0, None, 7), ("a", 1, 1, "x", 7)], "book_id string, chapter_id long, ordinal int, text string, part int")
    assert [r.text for r in parts.chunk_parts(blank).collect()] == ["\nx"]
    for wrong in ({"overlap": 801}, {"size": 10}):
        with pytest.raises(ValueError):
            parts.chunk_parts(none, **wrong)


def test_a_book_is_one_chapter(spark):
    rows = [("a", 5, 0, "one"), ("a", 5, 1, "two"), ("a", 9, 0, "three"), ("b", 1, 0, "x")]
    flat = spark.createDataFrame(rows, "book_id string, chapter_id long, ordinal int, text string")
    want = [("a", 0, 0, "one"), ("a", 0, 1, "two"), ("a", 0, 2, "three"), ("b", 0, 0, "x")]
    for most in (2, 100):
        assert sorted(map(tuple, parts.whole_books(flat, most).collect())) == sorted(want)
