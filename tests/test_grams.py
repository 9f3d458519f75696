"""The index for lexical lookup against the scan of all blocks."""

import random

from foliant.operators import search
from foliant.sources import grams
from foliant.sources.grams import GramIndex


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(1)
    words = ["sea", "Ship", "the", "a", "ÄÖÜ", "x.y", "😀", "harbour", "ab", "", "THE"]
    blocks = [(f"b{i % 4}", i % 7, i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(300)] + [("b0", 1, 900, None), ("b0", 1, 901, ""), ("b9", None, 902, "the sea " * 5000)]
    df = spark.createDataFrame(blocks, "book_id string, chapter_id long, ordinal int, text string").repartition(3)
    index = GramIndex.build(df, str(tmp_path / "g"), parts=5, buckets=7)
    texts = ["sea", "the sea", "harbour ship", "ab", "a", "", None, "äöü", "😀", "x.y", "nowhere", "SEA A", "e", "sea sea sea sea", "ea sh"]
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")
    assert rows(index.search(queries)) == rows(search.lexical_many(df, queries)) and index.search(queries).count() > 100
    limited = spark.createDataFrame([(i, t, b, c) for i, t in enumerate(texts) for b, c in ((None, None), ("b1", None), ("b2", 3))], "query_id long, query string, book_id string, chapter_id long").selectExpr("query_id * 10 + hash(book_id, chapter_id) % 7 as query_id", "query", "book_id", "chapter_id")
    assert rows(index.search(limited)) == rows(search.lexical_many(df, limited))
    read = {r.query_id: r["count"] for r in index.candidates(queries).groupBy("query_id").count().collect()}
    hits = {r.query_id: r["count"] for r in index.search(queries).groupBy("query_id").count().collect()}
    assert 10 not in read and all(read[i] >= n for i, n in hits.items() if len(texts[i]) > 2) and read[2] < 150


def test_an_empty_collection_and_no_queries(spark, tmp_path):
    kind = "book_id string, chapter_id long, ordinal int, text string"
    index = GramIndex.build(spark.createDataFrame([("b", 1, 1, "the sea")], kind), str(tmp_path / "g"))
    assert index.search(spark.createDataFrame([], "query_id long, query string")).collect() == []
    assert [tuple(r) for r in index.search(spark.createDataFrame([(1, "SEA")], "query_id long, query string")).collect()] == [(1, "b", 1, 1, 4)]


def test_postings_are_packed(spark, tmp_path, monkeypatch):
    """A run is one row for all blocks whose texts are packed together, with every block that has it once."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab😀\0é") for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["ab" * 900, "xyz", None, ""]
    df = spark.createDataFrame([(f"b{i % 3}", i % 5, i, t) for i, t in enumerate(texts)], "book_id string, chapter_id long, ordinal int, text string")
    for chars, least in ((1 << 22, 10), (700, 1)):
        monkeypatch.setattr(grams, "CHARS", chars)
        index = GramIndex.build(df, str(tmp_path / f"g{chars}"), parts=2, buckets=3)
        ordinal = {r.block: r.ordinal for r in index.blocks().collect()}
        want = sorted({(t[k : k + 3], i) for i, t in enumerate(texts) if t for k in range(len(t) - 2)})
        got = sorted((r.gram, ordinal[r.block]) for r in grams.unpacked(index.postings().select("gram", "first", "width", "gaps")).collect())
        assert got == want and sum(r.n for r in index.counts().collect()) == len(want)
        assert index.postings().count() * least < len(want)


def test_very_many_characters_are_told_apart():
    many = [chr(k) for k in range(0x4E00, 0x4E00 + 20_000)] + [chr(k) for k in range(0x20000, 0x20000 + 40_000)]
    rng = random.Random(3)
    texts = ["".join(rng.sample(many, 20_000)) for _ in range(8)] + ["ab", *["abc"] * 30_000]
    code, block = grams._postings(list(range(len(texts))), texts, 1 << 22)
    want = sorted({(ord(t[k]) << 42 | ord(t[k + 1]) << 21 | ord(t[k + 2]), i) for i, t in enumerate(texts) for k in range(len(t) - 2)})
    assert list(zip(code.tolist(), block.tolist(), strict=True)) == want
