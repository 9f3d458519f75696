"""Containment and similarity joins, and clustering in rounds, against all pairs."""

import collections
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import contain, entities, linkage, search, similar, themes


def rows(df):
    return sorted(map(tuple, df.collect()))


def random_texts(n, seed, letters="ab c😀é"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ab", "abcdef ", "ab c😀é\n"])
def test_containment_equals_all_pairs(spark, letters):
    inner = [("x" if i % 3 else "y", i, t) for i, t in enumerate(random_texts(60, 1, letters))] + [("x", 90, None), (None, 91, "a"), ("z", 92, "a")]
    outer = [("x" if i % 2 else "y", i, t) for i, t in enumerate(random_texts(60, 2, letters))] + [("x", 90, None), (None, 91, "a")]
    expected = sorted((b, i, j) for b, i, s in inner for c, j, t in outer if b is not None and b == c and s is not None and t is not None and s in t)
    got = contain.contained(spark.createDataFrame(inner, "book_id string, inner_id int, inner string"), spark.createDataFrame(outer, "book_id string, outer_id int, outer string"))
    assert rows(got) == expected and expected
    none = spark.createDataFrame([], "book_id string, inner_id int, inner string")
    assert contain.contained(none, spark.createDataFrame(outer, "book_id string, outer_id int, outer string")).collect() == []


def test_variations_equal_all_pairs(spark):
    rng = random.Random(3)
    names = sorted({" ".join(rng.choice(["ann", "hannah", "lee", "an", "joann", "smith", "mith"]) for _ in range(rng.randrange(1, 4))) for _ in range(80)})
    mentions = spark.createDataFrame([(b, n.title(), 1) for b in ("p", "q") for n in names if b == "p" or len(n) % 2], "book_id string, text string, chapter_id long")
    expected = []
    for b in ("p", "q"):
        own = [n for n in names if b == "p" or len(n) % 2]
        expected += [(b, n, min([m for m in own if n in m], key=lambda m: (-len(m), m))) for n in own]
    assert rows(entities.variations(mentions)) == sorted(expected)


def test_one_very_long_word_does_no_harm(spark):
    rng = random.Random(4)
    word = "A" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    some = [("b", "Ann"), ("b", "Hannah"), ("b", word), ("b", word[50:58].title()), ("b", word[:40])]
    began = time.time()
    got = dict((v, c) for _, v, c in rows(entities.variations(spark.createDataFrame(some, "book_id string, text string"))))
    assert time.time() - began < 60
    assert got["ann"] == ("hannah" if "ann" not in word.lower() else word.lower()) and got[word[50:58]] == got[word[:40].lower()] == word.lower()


def sparse(n, seed, terms=30, copies=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = rng.sample(range(terms), rng.randrange(0, 8))
        out += [("b" if i % 4 else "c", i, t, round(rng.random() * rng.choice([1, 5]), 6)) for t in own]
    for k in range(copies):
        out += [(b, n + k, t, 2 * x) for b, i, t, x in out if i == 1]
    return out


def cosines(data):
    by = {}
    for b, i, t, x in data:
        by.setdefault((b, i), {})[t] = x
    norm = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in by.items()}
    return {(b, i, j): sum(x * by[b, j].get(t, 0) for t, x in by[b, i].items()) / (norm[b, i] * norm[b, j]) for (b, i) in by for (c, j) in by if b == c and i < j and norm[b, i] and norm[c, j]}


def test_similar_pairs_that_rounding_lifts_to_the_cut(spark):
    c = 0.2999997
    rows = [("b", 1, 0, 1.0), ("b", 2, 0, c), ("b", 2, 1, (1 - c * c) ** 0.5), ("b", 3, 0, 0.2999994), ("b", 3, 2, (1 - 0.2999994**2) ** 0.5)]
    pairs, _ = similar.similar_pairs(spark.createDataFrame(rows, "book_id string, chapter_id long, index int, value double"), 0.3)
    assert [tuple(r) for r in pairs.collect()] == [("b", 1, 2, 0.3)]


@pytest.mark.parametrize("cut", [0.05, 0.6, 1.0])
def test_similar_pairs_equal_all_pairs(spark, cut):
    data = sparse(70, 5, copies=6)
    df = spark.createDataFrame(data + [("b", 999, 3, 0.0)], "book_id string, chapter_id long, index int, value double")
    pairs, member = similar.similar_pairs(df, cut)
    of = {(r.book_id, r.chapter_id): r.class_id for r in member.collect()}
    got = {(r.book_id, r.a, r.b): r.similarity for r in pairs.collect()}
    true = {k: round(v, 6) for k, v in cosines(data).items()}
    for (b, i, j), s in true.items():
        x, y = sorted((of[b, i], of[b, j]))
        assert got.get((b, x, y), 1.0 if x == y else None) == (pytest.approx(s, abs=2e-6) if s >= cut or x == y else None)
    assert ("b", 999) not in of and len({of["b", i] for i in (1, 70, 75)}) == 1
    with pytest.raises(ValueError):
        similar.similar_pairs(df, 0)


@pytest.mark.parametrize(("block", "cells", "strip"), [(8192, 1 << 22, 1 << 21), (7, 1 << 22, 5), (16, 40, 9)])
def test_similar_pairs_are_the_same_in_any_squares(spark, monkeypatch, block, cells, strip):
    """Pairs come with the sizes of their classes, whatever block a class is in; no shuffle holds pairs."""
    monkeypatch.setattr(similar, "CELLS", cells)
    monkeypatch.setattr(similar, "STRIP", strip)
    data = sparse(90, 8, copies=5)
    member, distinct = similar.classes(spark.createDataFrame(data, "book_id string, chapter_id long, index int, value double"))
    found = similar.sized_pairs(member, distinct, 0.3, block)
    of = {(r.book_id, r.chapter_id): r.class_id for r in member.collect()}
    size = collections.Counter((b, c) for (b, _), c in of.items())
    want = {}
    for (b, i, j), v in cosines(data).items():
        x, y = sorted((of[b, i], of[b, j]))
        if x != y and round(v, 6) >= 0.3:
            want[b, x, y] = (pytest.approx(v, abs=2e-6), size[b, x], size[b, y])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {r[:3]: r[3:] for r in got} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_pairs_below_the_cut_are_not_made(spark):
    df = spark.createDataFrame(sparse(300, 6, terms=200), "book_id string, chapter_id long, index int, value double")
    _, distinct = similar.classes(df)
    every = sum(r.n for r in similar.all_pairs_bound(distinct).collect())
    assert similar.candidates(distinct, 0.7).count() < every / 20


def members(groups):
    return [sorted(g) for g in groups]


def random_points(n, seed, terms=40):
    """Books of sparse rows without ties: every chapter shares a term with all others."""
    rng = random.Random(seed)
    return [(b, i, t, round(rng.random() + 0.01, 9)) for b in ("p", "q") for i in range(n if b == "p" else n // 2) for t in [0, *rng.sample(range(1, terms), 6)]]


def one_by_one(points, b, dense=None):
    ids = sorted({i for x, i, *_ in points if x == b})
    m = np.zeros((len(ids), 1 + max(t for _, _, t, _ in points)))
    for x, i, t, v in points:
        if x == b:
            m[ids.index(i), t] = v
    d = np.array([dense[b, i] for i in ids]) if dense else None
    return [(b, k, ids[i]) for k, g in enumerate(themes.cluster(themes.similarity(m, d, None if d is None else np.ones(len(ids), bool)))) for i in g]


VECTORS = "book_id string, chapter_id long, index int, value double"


def test_rounds_equal_merging_one_by_one(spark, local=25):
    data = random_points(80, 7)
    v = spark.createDataFrame(data, VECTORS)
    got = themes.assign(v, v.select("book_id", "chapter_id").distinct(), most=0, block=16, local=local)
    assert rows(got) == sorted(one_by_one(data, "p") + one_by_one(data, "q"))


def test_rounds_with_dense_vectors(spark):
    data, rng = random_points(56, 8), np.random.default_rng(8)
    dense = {(b, i): rng.normal(size=5) for b, i, *_ in data}
    v = spark.createDataFrame(data, VECTORS)
    d = spark.createDataFrame([(b, i, x.tolist()) for (b, i), x in dense.items()], "book_id string, chapter_id long, centroid array<double>")
    own = v.select("book_id", "chapter_id").distinct()
    assert rows(themes.assign(v, own, d, most=0, block=16, local=20)) == sorted(one_by_one(data, "p", dense) + one_by_one(data, "q", dense))
    with pytest.raises(ValueError):
        themes.assign(v, own, d.where("chapter_id <> 3"), most=0)


def test_rounds_where_the_last_chapters_have_no_dense_vector(spark):
    data, rng = random_points(56, 18), np.random.default_rng(18)
    dense = {(b, i): rng.normal(size=5) for b, i, *_ in data if i < (30 if b == "p" else 99)}
    v = spark.createDataFrame(data, VECTORS)
    d = spark.createDataFrame([(b, i, x.tolist()) for (b, i), x in dense.items()], "book_id string, chapter_id long, centroid array<double>")
    got = themes.assign(v, v.select("book_id", "chapter_id").distinct(), d, most=0, block=16, local=20)
    m, x, has = np.zeros((56, 40)), np.zeros((56, 5)), np.arange(56) < 30
    for b, i, t, y in data:
        if b == "p":
            m[i, t] = y
    for i in range(30):
        x[i] = dense["p", i]
    want = [("p", k, i) for k, g in enumerate(themes.cluster(themes.similarity(m, x, has))) for i in g]
    assert rows(got) == sorted(want + one_by_one(data, "q", dense))


def test_rounds_with_ties_copies_and_chapters_without_words(spark):
    rng = random.Random(9)
    data = [("p", i, t, 1.0) for i in range(90) for t in rng.sample(range(12), 2)] + [("p", 200 + i, 50, 2.0) for i in range(60)] + [("q", 1, 1, 1.0)]
    own = spark.createDataFrame([(b, i) for b, i in sorted({(b, i) for b, i, *_ in data})] + [("p", 500 + i) for i in range(70)] + [("e", i) for i in range(3)], "book_id string, chapter_id long")
    v = spark.createDataFrame(data, VECTORS)
    got = [rows(themes.assign(v, own, most=0, block=8, local=k)) for k in (60,)]
    assert sorted((b, i) for b, _, i in got[0]) == rows(own)
    assert len({t for b, t, _ in got[0] if b == "p"}) in range(25, 51) and len({t for b, t, _ in got[0] if b == "e"}) == 3
    assert len({t for b, t, i in got[0] if b == "p" and 200 <= i < 260}) == 1
    part = rows(themes.assign(v, own, most=10, block=8, local=200))
    assert [r for r in part if r[0] == "p"] == [r for r in got[0] if r[0] == "p"] and len(part) == own.count()


def test_finish_equals_one_by_one():
    rng = np.random.default_rng(10)
    x = np.abs(rng.normal(size=(60, 20)))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    made = linkage.finish(np.arange(60), np.ones(60), x, False)
    assert len(made) == 59
    groups = {i: {i} for i in range(60)}
    for a, b, _, _ in sorted(made, key=lambda m: (-m[2], m[3]))[: 60 - 25]:
        groups[a] |= groups.pop(b)
    assert sorted(members(groups.values())) == sorted(members(themes.cluster(themes.similarity(x), 25, 25)))


def test_rounds_look_again_only_for_what_a_merge_changed(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.abs(rng.normal(size=(60, 6))) * (rng.random((60, 6)) < 0.5)
    x[:, 0] += 0.01
    x[40:50] = x[:10]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    points = spark.createDataFrame([("b", i, list(range(6)), r.tolist()) for i, r in enumerate(x)], "book_id string, id long, index array<int>, value array<double>")
    seen, inner = [], linkage._partners
    monkeypatch.setattr(linkage, "_partners", lambda *a: seen.append(a[4].count() if len(a) > 4 else a[0].count()) or inner(*a))
    some = rows(linkage.merges(points, block=16, local=34, few=0).drop("similarity"))
    asked, seen[:] = sum(seen), []
    assert some == rows(linkage.merges(points, block=16, local=34, few=1000).drop("similarity")) and len(some) == 59
    assert len(seen) > 1 and asked < sum(seen)


def test_only_ends_of_lengths_that_the_other_side_has_are_made(spark):
    rng = random.Random(3)
    paths = ["", *("".join(rng.choices("a/b", k=rng.randint(1, 6))) for _ in range(60)), "x" * 400]
    left = spark.createDataFrame([(k, p) for k in ("b", "c") for p in sorted(set(paths))] + [("b", None), (None, "a")], "book_id string, a string")
    right = spark.createDataFrame([(k, p, len(p)) for k in ("b", "d") for p in sorted(set(paths[:20]))], "book_id string, b string, n int")
    want = {("b", x, y, len(y)) for x in paths for y in paths[:20] if x.endswith(y) or y.endswith(x)}
    got = [tuple(r) for r in search.ends_alike(left, "a", right, "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    long = spark.range(1).select(search.suffixes(F.lit("y" * 300 + "ab"), F.array(F.lit(303), F.lit(2), F.lit(0))).alias("s")).first().s
    assert long == ["ab", ""]  # 303 ends before


def test_labels_of_repeated_sections_and_points(spark):
    sections = spark.createDataFrame([("b", "s1", "t/a.x"), ("b", "s1", "t/a.x"), ("b", "s2", "t/a.x"), ("b", None, "q"), ("b", "s3", None), ("c", "s1", "a.x")], "book_id string, spine_item_id string, href string")
    points = spark.createDataFrame([("b", 1, "one", "a.x#1"), ("b", 3, "three", "u/t/a.x"), ("b", 2, "two", "a.x#2"), ("b", 9, "nine", "z"), ("c", 1, None, "a.x"), ("c", None, "none", "x")], "book_id string, ord int, label string, src string")
    got = sorted((tuple(r) for r in search.attach_labels(sections, points).collect()), key=str)
    assert got == sorted([("b", "s1", "t/a.x", "three"), ("b", "s2", "t/a.x", "three"), ("b", None, "q", None), ("b", "s3", None, None), ("c", "s1", "a.x", None)], key=str)
