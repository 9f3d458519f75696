"""Hard negatives, exact duplicates and turn repair against brute force, in blocks and segments, on odd tables."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import exact, negatives, turns

# hard negatives

VECTORS = "id long, label long, vector array<float>, score int, row string"


def brute_negatives(rows, anchor=lambda i: i % 5 == 0, positives=5, negs=3):
    use = []
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, label, [math.floor(float(np.float32(x)) * 256) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(use):
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, k == label) for m, (j, k, w) in enumerate(use) if m != n and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted((t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fit[:negs], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("id") % 5 == 0, **more).collect()))


def random_rows(n, dims, seed, labels=3):
    rng = np.random.default_rng(seed)
    some = rng.normal(size=(12, dims)) / 4
    return [(i, int(rng.integers(labels)), [float(x) for x in (some[rng.integers(12)] + (rng.normal(size=dims) / 9 if rng.random() < 0.7 else 0))], 1, "x") for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rows = random_rows(90, 6, 1)
    expected = brute_negatives(rows)
    assert len(expected) > 50 and mined(spark, rows) == expected


def test_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CELLS", 64)
    rows = random_rows(60, 4, 2)
    assert mined(spark, rows, block_anchors=3) == brute_negatives(rows)
    assert mined(spark, rows, block_bytes=64) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = random_rows(40, 3, 3)
    rows += [(5, 1, None, None, None), (10, None, [1.0, 0.0, 0.0], 1, ""), (None, 1, [1.0, 0.0, 0.0], 1, ""), (15, 2, [float("nan"), 0.0, 0.0], 1, ""), (20, 2, [float("inf"), 0.0, 0.0], 1, ""), (25, 2, [None, 0.0, 0.0], 1, "")]
    rows += [(100, 0, [0.5, 0.5], 1, ""), (101, 0, [0.5, 0.25], 1, ""), (102, 1, [0.4, 0.3], 1, ""), (103, 0, [], 1, ""), (105, 1, [], 1, "")]  # other lengths meet their like alone
    rows += [rows[0], rows[0], (200, 1, [0.5] * 3, 1, ""), (201, 1, [0.5] * 3, 1, ""), (205, 1, [0.5] * 3, 1, "")]  # repeated rows, ties
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_beyond_exact_floats(spark):
    rows = [(i, i % 2, [float(2**30 + 2**10 * i), float(i), 1.0], 1, "") for i in range(12)] + [(50 + i, i % 2, [1.0 + i, 2.0, 3.0], 1, "") for i in range(6)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, [(i, None, None, None, None) for i in range(3)]) == [] and mined(spark, [(1, 1, [1.0], 1, "")]) == []
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine(empty, F.col("id") % 5 == 0).collect() == []


def test_best_rows_merge(spark):
    rng = random.Random(4)
    best, all_rows = negatives.Best(3, 2), []
    for _ in range(20):
        part = [(rng.randrange(3), rng.choice([negatives.LONG.min, -5, 0, 7, negatives.LONG.max]), rng.randrange(9), rng.randrange(99)) for _ in range(rng.randrange(1, 6))]
        all_rows += part
        best.add(*(np.array(c, np.int64) for c in zip(*part, strict=True)))
        expected = [x for s in range(3) for x in sorted(((s, -v, i, r) for t, v, i, r in all_rows if t == s), key=lambda x: (x[1], x[2], x[3]))[:2]]
        assert [(s, -v, i, r) for s, v, i, r in zip(*(c.tolist() for c in best.rows()), strict=True)] == expected


# exact duplicates


def brute_groups(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), k == ids.index(top), hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def grouped(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int, winner string").repartition(4)
    return sorted(map(tuple, exact.groups(df, **more).collect()), key=repr)


@pytest.mark.parametrize("counters", [1, 3, exact.COUNTERS])
def test_groups_equal_brute_force(spark, counters):
    rng = random.Random(counters)
    texts = ["hot"] * 60 + ["warm"] * 20 + [f"text {rng.randrange(40)}" for _ in range(80)] + [None, "", None, "x" * 100_000, "x" * 100_000, " ", "\n", "😀"]
    rows = [(i, t, "d", None, "w") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert grouped(spark, rows, counters=counters) == brute_groups(rows)


def test_groups_of_odd_rows(spark):
    rows = [(None, "a", None, None, None), (None, "b", None, None, None), (3, "b", None, None, None), (4, "c", None, None, None), (4, "c", None, None, None)]
    got = grouped(spark, rows)
    assert [r[:4] for r in got if r[4] == hashlib.sha256(b"a").hexdigest()] == [(None, None, 1, True)]
    assert sorted((r[:4] for r in got if r[4] == hashlib.sha256(b"b").hexdigest()), key=repr) == [(3, 3, 2, True), (None, 3, 2, False)]
    assert sorted(r[3] for r in got if r[0] == 4) == [False, True]
    assert grouped(spark, [(1, "t", None, None, None)]) == brute_groups([(1, "t")])
    assert exact.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_survivors_keep_their_columns(spark, monkeypatch):
    rows = [(i, t, "en", "x") for i, t in enumerate(["a", "A ", "b", "a", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string")
    keep = ("doc_id", "text", "digest")
    assert sorted(map(tuple, exact.deduplicate(df, keep).collect())) == [(1, "A ", "x"), (2, "b", "x"), (3, "a", "x"), (5, "", "x")]
    fold = lambda c: F.trim(F.lower(c))
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, exact.deduplicate(df, keep, fold).collect())) == [(2, "b", "x"), (3, "a", "x"), (5, "", "x")]


def test_summary_keeps_every_frequent_digest():
    rng = random.Random(5)
    stream = [b"hot"] * 300 + [b"warm"] * 150 + [b"%d" % rng.randrange(200) for _ in range(400)]
    rng.shuffle(stream)
    for k in (1, 2, 4, 9):
        s = exact.Summary(k)
        for a in range(0, len(stream), 37):
            s.add(pa.array(stream[a : a + 37], pa.binary()))
        held = dict(zip(s.entries["digest"].to_pylist(), s.entries["n"].to_pylist(), strict=True))
        assert len(held) <= k
        for d in set(stream):
            true = stream.count(d)
            assert true - len(stream) / (k + 1) <= held.get(d, 0) <= true


def test_hot_texts_are_not_shuffled(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}", "", 0, "") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int, winner string")
    numbered = exact.materialise(exact._numbered(df, ("doc_id",), None).drop("kept_columns"), "test")
    heavy = exact.frequent(numbered, 3)
    assert [tuple(r)[1:] for r in heavy.select("digest", "n", "winner.doc_id").collect()] == [(100, 199)]
    plan = exact.decided(numbered, 3)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


# turns

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def brute_report(conv, turns_):
    """By recursion over whole edit strings: least (cost, string)."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    rows = sorted(turns_, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def least(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        to = NEXT[state]
        name = {"u": "user", "a": "assistant"}[to]
        if inserts < 3:
            c, s, r = least(i, to, inserts + 1)
            found.append((c + 5, "I" + s, (name + ":", *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, s, r = least(i + 1, state, 0)
            found.append((c + 2, "D" + s, r))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] else 0
                c, s, r = least(i + 1, to, 0)
                found.append((c + 1 + more, "R" + s, (name + ":" + text, *r)))
                first = role[:1]
                if first == to or (first == "s" and state == ""):
                    c, s, r = least(i + 1, first, 0)
                    found.append((c + more, "K" + s, (role + ":" + text, *r)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = least(0, "", 0)
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_repair(rows):
    by = {conv: [] for conv, *_ in rows}
    for conv, *rest in damaged(rows):
        by[conv].append(tuple(rest))
    return sorted((brute_report(c, t) for c, t in by.items()), key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, code string, fault int, present string"


def repaired(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, None) for r in rows], CONVERSATIONS).repartition(3)
    return sorted(map(tuple, turns.repair(turns.damage(df), **more).collect()), key=repr)


def random_conversations(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["yes.", "no", "a b?", " ", "", None, f"t{rng.randrange(5)}!", "end. \t\n", "ü😀。"])))
    return rows


def test_repair_equals_brute_force(spark):
    rows = random_conversations(250, 6)
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_in_segments_equals_the_whole(spark):
    rows = random_conversations(60, 7, 14)
    whole = brute_repair(rows)
    assert repaired(spark, rows, long_rows=3, segment=2) == whole
    assert repaired(spark, rows, long_bytes=10, segment=5) == whole


def test_segments_of_one_long_conversation(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"b{t}!", "c", f"d {t}", "", f"e{t}?"])) for t in range(700)]
    whole = repaired(spark, rows)
    assert repaired(spark, rows, long_rows=100, segment=64) == whole
    assert whole[0][6] > 100 and len(whole[0][7]) > 600


def test_repair_of_odd_rows(spark):
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "dropped."), (None, None, None, None), (None, 3, "user", "x."), (-4, -2, "assistant", "y" * 200_000), (-4, -9, "user", "z.")] + [(77, 5, "user", "same.")] * 4
    got = repaired(spark, rows)
    assert got == brute_repair(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert repaired(spark, rows, long_rows=0, segment=2) == got
    assert turns.repair(turns.damage(spark.createDataFrame([], CONVERSATIONS))).collect() == []


def test_a_conversation_cut_by_batches(spark):
    rows = random_conversations(40, 9)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        assert repaired(spark, rows) == brute_repair(rows)
    finally:
        spark.conf.set(key, before)
