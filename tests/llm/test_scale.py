"""Draws over many candidates of one text, and equal small payloads."""

import random

from pyspark.sql import functions as F

from foliant.llm import secrets, warc


def test_draws_are_spread_over_all_candidates_of_a_text(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(9000)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24)) for _ in range(500)]
    text = " ".join(w for i, k in enumerate(keys) for w in [*words[18 * i : 18 * i + 18], k])
    found = secrets.candidates(spark.createDataFrame([(1, text), (2, " ".join(words[:600] + keys[:3]))], "doc_id long, text string"), ("doc_id",))
    n = {r.doc_id: (r.tested, r.prose) for r in found.select("doc_id", F.size("tested").alias("tested"), F.size("prose").alias("prose")).collect()}
    assert n[1][0] == 500 and 20 * secrets.DRAWS < n[1][1] < 90 * secrets.DRAWS and n[2] == (3, 3 * secrets.DRAWS)
    chosen = spark.range(500).select(F.array(F.col("id") * 140).alias("t")).select(F.pmod(F.xxhash64(F.col("t")[0].cast("int")), F.lit(500)).alias("h"), (F.col("t")[0] / 140).alias("i")).where(f"h < {secrets.DRAWN}").collect()
    assert max(r.i for r in chosen) > 400 and min(r.i for r in chosen) < 100
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("spans")).first()[0]
    assert spans >= 450


def test_small_payloads_are_spread(spark):
    big = "x" * 1200
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://e.org/").alias("url"), F.when(F.col("id") % 10 == 0, F.lit(big)).alias("html"))
    made = warc.page_records(pages)
    got = {(r.record_type, r.refers_to): r["count"] for r in made.groupBy("record_type", "refers_to").count().collect()}
    assert got == {("response", None): 2701, ("revisit", 2990): 299}
    plan = made._jdf.queryExecution().toString()
    assert "1048576" in plan


def test_every_candidate_has_strings_in_the_null(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    text = " ".join(w for _ in range(300) for w in [*(word("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(18)), word("ABCDEFGHabcdefgh0123456789", 24)])
    caught, null = [], secrets.null_of_prose
    monkeypatch.setattr(secrets, "null_of_prose", lambda found: caught.append(found.select(F.size("tested"), F.size("prose")).first()) or null(found))
    secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert caught[0][0] == 300 and caught[0][1] > 290 * secrets.DRAWS
