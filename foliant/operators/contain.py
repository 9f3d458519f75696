"""Which texts contain which: an equality join on one rare gram of each, then a test.

A text is contained in another only if all its grams (runs of three characters) are among the other's. Each inner text is met at its rarest gram alone, each outer
text gives its distinct grams, so neither all substrings nor all pairs are made; a very long text gives no more rows than there are different grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, in one pass; the empty run for n = 0."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(book_id, inner_id, outer_id) where a text of outer (book_id, outer_id, outer) contains one of inner (book_id, inner_id, inner) of its book, itself included.

    Texts of fewer than GRAM characters are their own gram; the empty text is in every text. Null texts and books contain and are contained in nothing; ids may
    repeat, each pair of rows that fits is a row. A gram that very many texts have is a hot key of a plain join, which Spark splits.
    """
    inner, outer = inner.where("inner is not null"), outer.where("outer is not null")
    size = F.least(F.length("inner"), F.lit(GRAM))
    lengths = sorted(r[0] for r in inner.select(size.alias("n")).distinct().collect())  # four at most
    if not lengths:
        return inner.join(outer, "book_id").select("book_id", "inner_id", "outer_id")
    # long texts are not carried along with their grams, nor with what they meet, but by a hash; two texts of one hash are both tested
    hashed = outer.withColumn("hash", F.xxhash64("outer"))
    different = hashed.select("book_id", "hash", "outer").distinct()
    of_outer = different.select("book_id", "hash", F.explode(F.concat(*[grams(F.col("outer"), n) for n in lengths])).alias("gram"))
    common = of_outer.groupBy("book_id", "gram").agg(F.count("*").alias("n"))
    own = F.when(size == GRAM, grams(F.col("inner"), GRAM)).otherwise(F.array("inner"))
    texts = inner.select("book_id", "inner").distinct().withColumn("key", F.xxhash64("inner"))
    rarest = texts.select("book_id", "key", F.explode(own).alias("gram")).join(common, ["book_id", "gram"], "left")
    rarest = rarest.groupBy("book_id", "key").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    # texts of one hash are met at one gram, so it must be one of each: those that lack it are met at their own
    rarest = texts.join(rarest, ["book_id", "key"]).select("book_id", "inner", F.when(F.contains("inner", "gram"), F.col("gram")).otherwise(F.substring("inner", 1, GRAM)).alias("gram"))
    met = rarest.join(of_outer, ["book_id", "gram"]).drop("gram").join(different, ["book_id", "hash"]).where(F.contains("outer", "inner")).select("book_id", "inner", "hash", "outer")
    return inner.join(met, ["book_id", "inner"]).join(hashed, ["book_id", "hash", "outer"]).select("book_id", "inner_id", "outer_id")


def longest_containing(texts: DataFrame) -> DataFrame:
    """(book_id, text, whole): of each different text of texts (book_id, text) the longest other text of its book that contains it, ties to the smaller; null if there is none."""
    names = texts.select("book_id", "text").where("text is not null").distinct()
    pairs = contained(names.select("book_id", F.col("text").alias("inner_id"), F.col("text").alias("inner")), names.select("book_id", F.col("text").alias("outer_id"), F.col("text").alias("outer")))
    held = pairs.where("inner_id <> outer_id").groupBy("book_id", F.col("inner_id").alias("text")).agg(F.min_by("outer_id", F.struct(-F.length("outer_id"), "outer_id")).alias("whole"))
    return names.join(held, ["book_id", "text"], "left")
