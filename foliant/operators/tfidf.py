"""TF-IDF keywords, bigrams, vocabulary and chapter vectors.

Counts are aggregations on (book, chapter, term), which spread a large book over all tasks. Document
frequencies count distinct (book, chapter, term) rows, and a book's number of chapters is one row a book.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenise
from ..functions.words import STOPWORDS

TOP_KEYWORDS, TOP_BIGRAMS, VOCABULARY = 50, 30, 100


def is_keyword(term: Column, stop: Sequence[str] = STOPWORDS) -> Column:
    return (F.length(term) >= 3) & ~term.isin(*stop)


def term_counts(chapters: DataFrame, terms: Column) -> DataFrame:
    """(book_id, chapter_id, term, tf)"""
    return chapters.select("book_id", "chapter_id", F.explode(terms).alias("term")).groupBy("book_id", "chapter_id", "term").agg(F.count("*").alias("tf"))


def scored(counts: DataFrame, chapters: DataFrame, top: int, keep: Column | None = None) -> DataFrame:
    """(book_id, chapter_id, term, tf, df, tfidf, rank): tf x ln(chapters / df) of terms with tf of 2 and more, the best of each chapter."""
    # words that are left out anyway are not counted, and both branches use the same columns, so that texts are not cut into words twice
    counts = counts.where(keep) if keep is not None else counts
    size = chapters.groupBy("book_id").agg(F.count_distinct("chapter_id").alias("n"))
    df = counts.groupBy("book_id", "term").agg(F.sum(F.when(F.col("tf") > 0, F.lit(1).cast("long"))).alias("df"))
    rare = counts.where("tf >= 2")
    score = rare.join(df, ["book_id", "term"]).join(size, "book_id").withColumn("tfidf", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy(F.desc("tfidf"), "term"))
    return score.select("book_id", "chapter_id", "term", "tf", "df", "tfidf", rank.alias("rank")).where(F.col("rank") <= top)


def keywords(chapters: DataFrame, top: int = TOP_KEYWORDS, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """The best keywords of each chapter of chapters (book_id, chapter_id, text), words of `stop` left out."""
    return scored(term_counts(chapters, tokenise(F.col("text"))), chapters, top, is_keyword(F.col("term"), stop))


def bigrams(chapters: DataFrame, top: int = TOP_BIGRAMS, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """The same for pairs of neighbours after stopwords and short words are left out; a row-local step makes the pairs."""
    words = F.filter(tokenise(F.col("text")), lambda w: is_keyword(w, stop))
    listed = chapters.select("book_id", "chapter_id", words.alias("words"))
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return scored(term_counts(listed, pairs), chapters, top)


def vocabulary(keywords: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """(book_id, term, score, index): terms by the sum of their scores over the chapters' best lists."""
    total = keywords.groupBy("book_id", "term").agg(F.round(F.sum("tfidf"), 6).alias("score"))
    index = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("score"), "term")) - 1
    return total.withColumn("index", index).where(F.col("index") < most)


def vectors(keywords: DataFrame, vocab: DataFrame) -> DataFrame:
    """(book_id, chapter_id, index, value): sparse vectors of the chapters' best terms over the vocabulary."""
    return keywords.join(vocab.select("book_id", "term", "index"), ["book_id", "term"]).select("book_id", "chapter_id", "index", F.col("tfidf").alias("value"))
