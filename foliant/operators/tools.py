"""The tools that answer questions about a book, each from tables to a table, and their registry.

Requests are tables, so that one run answers those of many people; what is joined to them is by book and chapter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paging import position_percent
from ..plans.scratch import small, written
from . import search, vectors

SNIPPET = 300
#: Places of blocks up to which they are broadcast, rather than all blocks shuffled.
PLACES = 500_000


def current_position(positions: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """label, block, n_blocks and percent of positions (person_id, book_id, chapter_id, ordinal).

    sections: (book_id, chapter_id, label). A chapter that sections lack has no label and no place; a null ordinal, or one
    that the chapter lacks, stands for its beginning: block and percent are null.
    """
    sizes = blocks.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n_blocks"))
    known = sections.select("book_id", "chapter_id", "label").join(sizes, ["book_id", "chapter_id"], "left")
    inside = (F.col("ordinal") >= 0) & (F.col("ordinal") < F.col("n_blocks"))
    placed = positions.join(known, ["book_id", "chapter_id"], "left")
    return placed.select("person_id", "book_id", "chapter_id", "label", F.when(inside, F.col("ordinal") + 1).alias("block"), "n_blocks", F.when(inside, position_percent(F.col("ordinal"), F.col("n_blocks"))).alias("percent"))


def book_structure(sections: DataFrame, blocks: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter_id, label, n_blocks, current): a book's sections with their blocks; current (book_id, chapter_id) marks where one is."""
    sizes = search.structure(blocks).select("book_id", "chapter_id", "n_blocks")
    listed = sections.join(sizes, ["book_id", "chapter_id"], "left").select("book_id", "chapter_id", "label", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
    if current is None:
        return listed.withColumn("current", F.lit(False))
    marks = current.select("book_id", "chapter_id").distinct().withColumn("current", F.lit(True))
    return listed.join(marks, ["book_id", "chapter_id"], "left").withColumn("current", F.coalesce("current", F.lit(False)))


def lexical_search(blocks: DataFrame, requests: DataFrame, sections: DataFrame, most: int = search.DISPLAY) -> DataFrame:
    """(query_id, rank, book_id, chapter_id, label, ordinal, text, total, more): what is shown of each request's hits, in book order.

    requests: (query_id, query, scope, book_id, chapter_id), chapter_id being the current one. The scope full_book is the whole book; any other, and none, the current chapter.
    """
    limited = requests.withColumn("chapter_id", F.when(F.col("scope") == "full_book", F.lit(None)).otherwise(F.col("chapter_id")).cast(requests.schema["chapter_id"].dataType))
    # a request without a place has no scope to search
    placed = limited.where(F.col("book_id").isNotNull() & ((F.col("scope") == "full_book") | F.col("chapter_id").isNotNull()))
    shown = written(search.shown_of(blocks, placed, most), "shown")
    labels = sections.select("book_id", "chapter_id", "label")
    # only places that are shown are looked up in the blocks
    texts = blocks.select("book_id", "chapter_id", "ordinal", "text").join(small(shown.select("book_id", "chapter_id", "ordinal").distinct(), PLACES), ["book_id", "chapter_id", "ordinal"], "left_semi")
    named = shown.join(labels, ["book_id", "chapter_id"], "left").join(texts, ["book_id", "chapter_id", "ordinal"])
    return named.select("query_id", "rank", "book_id", "chapter_id", F.coalesce("label", F.col("chapter_id").cast("string")).alias("label"), "ordinal", "text", "total", "more")


def surrounding_context(blocks: DataFrame, requests: DataFrame, radius: int = 5) -> DataFrame:
    """(query_id, block_id, ordinal, text): the blocks within `radius` of each request's block, within its chapter.

    blocks have a block_id; requests: (query_id, book_id, block_id, current_block_id). The block `current`, and none, is the current one; a block that the
    book lacks, and no current one, give no rows.
    """
    asked = requests.select("query_id", "book_id", F.when(F.coalesce("block_id", F.lit("current")) == "current", F.col("current_block_id")).otherwise(F.col("block_id")).alias("block_id"))
    centres = asked.join(blocks.select("book_id", "block_id", "chapter_id", F.col("ordinal").alias("centre")), ["book_id", "block_id"])
    near = centres.select("query_id", "book_id", "chapter_id", F.explode(F.sequence(F.col("centre") - radius, F.col("centre") + radius)).alias("ordinal"))
    return near.join(blocks, ["book_id", "chapter_id", "ordinal"]).select("query_id", "block_id", "ordinal", "text")


def chapter_full_text(blocks: DataFrame, requests: DataFrame, sections: DataFrame) -> DataFrame:
    """(query_id, chapter_id, label, text) of requests (query_id, book_id, chapter_id, current_id): `current`, and none, is the current chapter.

    sections: (book_id, chapter_id, label). A chapter that the book lacks has neither label nor text. Only chapters that are asked for are put together.
    """
    kind = sections.schema["chapter_id"].dataType
    wanted = F.when(F.coalesce(F.col("chapter_id").cast("string"), F.lit("current")) == "current", F.col("current_id")).otherwise(F.expr(f"try_cast(chapter_id as {kind.simpleString()})"))
    asked = requests.select("query_id", "book_id", wanted.alias("chapter_id"))
    known = asked.select("book_id", "chapter_id").distinct()
    texts = search.full_text(blocks.join(known, ["book_id", "chapter_id"], "left_semi"))
    joined = asked.join(sections.select("book_id", "chapter_id", "label"), ["book_id", "chapter_id"], "left").join(texts, ["book_id", "chapter_id"], "left")
    return joined.select("query_id", F.when(F.col("text").isNotNull(), F.col("chapter_id")).alias("chapter_id"), "label", "text")


def semantic_search(index: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int = 10, key: str = "vec_id", scope: str | None = None) -> DataFrame:
    """(query_id, rank, key, chapter_id, similarity, snippet): the nearest chunks with their text, similarity in whole percent, cut off.

    chunks: (key, chapter_id, text). Only the hits, at most `limit` a query, are joined. Hits without a chunk are left out, as are hits outside
    the scope, a column of index and queries, before the cut. `scoped` makes such a column of a request's scope.
    """
    hits = vectors.nearest(index, queries, limit, key, scope)
    found = chunks.select(key, "chapter_id", F.left("text", F.lit(SNIPPET)).alias("snippet")).join(hits, key)
    return found.select("query_id", "rank", key, "chapter_id", F.expr("cast(score * 100 as int)").alias("similarity"), "snippet")


def scoped(requests: DataFrame, column: str = "chapter_id") -> DataFrame:
    """requests (query_id, embedding, scope, current_id, chapter_ids) with the chapters that each may see in a list, null for all.

    The scope current_chapter is the current one, chapters those of the list; full_book, anything else, and chapters without a list, is the whole book.
    """
    of = F.when(F.col("scope") == "current_chapter", F.array("current_id")).when(F.col("scope") == "chapters", F.col("chapter_ids"))
    return requests.select("query_id", "embedding", of.alias(column))


def stored_summaries(requests: DataFrame, sections: DataFrame, stored: DataFrame) -> DataFrame:
    """requests (book_id, chapter_id, current_id) with what is stored (book_id, chapter_id, ...) for the chapter of its book that each resolves to; nothing is made anew."""
    asked = search.chapter_ids(requests, sections)
    kept = stored.select("book_id", F.col("chapter_id").alias("resolved"), "summary", "key_points", "characters")
    return asked.join(kept, ["book_id", "resolved"], "left").select(*requests.columns, "resolved", "summary", "key_points", "characters")


def gathered_summaries(chapters: DataFrame, stored: DataFrame) -> DataFrame:
    """(book_id, n, text) of books whose chapters (book_id, chapter_id, place) have stored summaries (book_id, chapter_id, summary): those alone, in order."""
    own = chapters.join(stored.select("book_id", "chapter_id", "summary"), ["book_id", "chapter_id"])
    listed = F.array_sort(F.collect_list(F.struct("place", "chapter_id", "summary")))
    return own.groupBy("book_id").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["summary"]), "\n\n").alias("text"))


def stored_synopses(books: DataFrame, stored: DataFrame) -> DataFrame:
    """books (book_id, title, author) with their stored synopsis, characters and themes, null where there is none."""
    return books.select("book_id", "title", "author").join(stored, "book_id", "left")


def by_title(books: DataFrame, slug: str | Column) -> DataFrame:
    """The first book in library order whose title contains the slug, in either case."""
    from .conversations import library_order

    wanted = F.lower(F.lit(slug) if isinstance(slug, str) else slug)
    return library_order(books.where(F.contains(F.lower("title"), wanted))).limit(1)


#: The tools by the names that requests give.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "get_current_position": current_position,
    "lexical_search": lexical_search,
    "semantic_search": semantic_search,
    "get_surrounding_context": surrounding_context,
    "get_book_structure": book_structure,
    "get_chapter_summary": stored_summaries,
    "get_chapter_full_text": chapter_full_text,
    "get_book_synopsis": stored_synopses,
}


def _concepts(*tables: DataFrame) -> DataFrame:
    from . import concepts

    return concepts.display(concepts.lookup(*tables))


TOOLS["book_concept_map_lookup"] = _concepts


def call(name: str, *tables: DataFrame, **arguments) -> DataFrame:
    """The result of a tool by name; a name that no tool has is an error."""
    if name not in TOOLS:
        raise ValueError(f"Unknown tool: {name}")
    return TOOLS[name](*tables, **arguments)
