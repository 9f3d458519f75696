"""A corpus pipeline of five stages over `documents`.

Language ID drops documents without a language; SimHash keeps one document of each group of near copies;
decontamination drops documents that hold benchmark passages; the secret scan masks what it finds; packing
lays the rest out in sequences. Each stage's result is written and read again as the next one's input.

All stages read the columns of documents by name and carry no others, so further columns may have any name; null values in any column stay as they are;
an empty table gives an empty one. What a stage makes of null and empty texts, repeated rows and null ids is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, langid, packing, secrets, simhash
from foliant.llm.common import materialise, rows_of
from foliant.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a predicted language: those without text or letters go, null texts among them.

    Repeated rows are each judged, and so stay or go together; a null id is no reason to go. Without any labelled row there is no language to
    predict, and no document stays.
    """
    model = langid.fit(docs.where(langid.fold() != 2), vocabulary("piece_bpe_32k.model"))
    return langid.identify(docs, model, (*COLUMNS,)).where("lang_pred <> 'und'").select(COLUMNS)


#: Ids of dropped rows that are broadcast, of 8 bytes each; more are joined, without a skewed key, as each is there once.
BROADCAST_ROWS = 1_000_000


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component, null ids last; of rows with that id, one.

    Texts without words, null ones among them, are near copies of each other. Ids may repeat: rows are told apart by a number that is written with them.
    Texts are written once and only row numbers are shuffled, unless over BROADCAST_ROWS rows go.
    """
    docs = docs.select(COLUMNS)
    numbered = materialise(simhash.fingerprints(docs.select("*", F.monotonically_increasing_id().alias("row")), (*COLUMNS, "row")), "numbered")
    groups = simhash.group(numbered.select("doc_id", "row", "fp"))
    gone = materialise(numbered.select("row").join(groups, "row", "left_anti"), "copies")
    small = gone.count() <= BROADCAST_ROWS
    return numbered.join(F.broadcast(gone) if small else gone, "row", "left_anti").select(COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not contaminated: those without words, null texts among them, stay; repeated rows are each judged."""
    found = decontaminate.decontaminate(docs, rows_of(spark, sf_dir, "benchmark"), (*COLUMNS,))
    return found.where("not contaminated").select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row, with its secrets masked and n_chars counted anew where there were any; a null or empty text stays null or empty."""
    # a column of its own first: within one select, Spark would resolve `text` in redact's lambdas to the new column
    found = secrets.scan(docs, (*COLUMNS,)).withColumn("masked", secrets.redact(F.col("text"), F.col("spans")))
    n_chars = F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their places in sequences; a null or empty text is the end id alone, repeated rows are documents of their own."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("clean_of_benchmark", clean_of_benchmark), ("mask_secrets", mask_secrets), ("pack", pack)]

#: The stages learn a model, hash, and tokenise: SQL cannot express them. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
