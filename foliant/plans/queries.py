"""The registered queries: each operator over the parquet tables, or over a small fixed table where it needs columns that they lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cfi, markup, paging, text
from ..operators import blocks as block_ops
from ..operators import chunks, concepts, conversations, dom, entities, parts, positions, router, search, similar, tfidf, themes, tools, vectors
from ..sources import captured, cells, grams, stores
from ..sources.tables import blocks, chapters, table
from . import index
from .derived import derived
from .fixtures import FIXTURES
from .scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def n2_keywords(spark, sf):
    return tfidf.keywords(chapters(spark, sf))


@query
def n3_bigrams(spark, sf):
    return tfidf.bigrams(chapters(spark, sf))


@query
def a1_term_frequency(spark, sf):
    counts = tfidf.term_counts(chapters(spark, sf), text.tokenise(F.col("text")))
    return counts.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


@query
def a2_document_frequency(spark, sf):
    counts = tfidf.term_counts(chapters(spark, sf), text.tokenise(F.col("text")))
    return counts.groupBy("book_id", "term").agg(F.count("*").alias("df"))


@query
def n4_vocabulary(spark, sf):
    return tfidf.vocabulary(tfidf.keywords(chapters(spark, sf)))


@query
def n4_vectors(spark, sf):
    keywords = tfidf.keywords(chapters(spark, sf))
    return tfidf.vectors(keywords, tfidf.vocabulary(keywords))


@query
def p7_block_ids(spark, sf):
    b = blocks(spark, sf)
    return b.select("book_id", "chapter_id", "ordinal", text.block_id(F.col("chapter_id"), F.col("text"), F.col("ordinal")).alias("block_id"), text.tokens_at_least_one(F.col("text")).alias("tokens"))


@query
def w2_block_offsets(spark, sf):
    return search.offsets(blocks(spark, sf)).select("book_id", "chapter_id", "ordinal", "start_offset")


@query
def a10_structure(spark, sf):
    return search.structure(blocks(spark, sf))


@query
def a12_full_text(spark, sf):
    return search.full_text(blocks(spark, sf)).select("book_id", "chapter_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"))


@query
def w11_position_percent(spark, sf):
    b = search.structure(blocks(spark, sf))
    rows = blocks(spark, sf).join(b, ["book_id", "chapter_id"])
    return rows.select("book_id", "chapter_id", "ordinal", paging.position_percent(F.col("ordinal"), F.col("n_blocks")).alias("percent"))


@query
def n1_chunks(spark, sf):
    made = chunks.chunk(chapters(spark, sf).select("book_id", "chapter_id", F.split("text", "\n").alias("blocks")))
    return made.select("chunk_id", "book_id", "chapter_id", "ordinal", F.sha2("text", 256).alias("text_sha256"), "token_count", "n_blocks", "start_offset", "end_offset")


@query
def n1_book_chunks(spark, sf):
    """Each book as one chapter, cut in parts."""
    made = parts.chunk_parts(parts.whole_books(blocks(spark, sf)))
    return made.select("chunk_id", "book_id", "chapter_id", "ordinal", F.sha2("text", 256).alias("text_sha256"), "token_count", "first_block", "n_blocks", "start_offset", "end_offset")


def _asked(spark, sf):
    """The first two words of each benchmark item, or its only one."""
    words = F.array_join(F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), 1, 2), " ")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("query"))


@query
def p9_lexical_search(spark, sf):
    return search.lexical_many(blocks(spark, sf), _asked(spark, sf))


@query
def p9_indexed_search(spark, sf):
    return grams.GramIndex.build(blocks(spark, sf), index.fresh(spark, "grams")).search(_asked(spark, sf))


@query
def p9_index_share(spark, sf):
    """Of each query, the blocks that the index reads, and that it has."""
    made = grams.GramIndex.build(blocks(spark, sf), index.fresh(spark, "grams"))
    return made.candidates(_asked(spark, sf)).groupBy("query_id").agg(F.count("*").alias("n_read")).withColumn("n_blocks", F.lit(made.blocks().count()))


@query
def t3_lexical_display(spark, sf):
    return search.display(search.lexical_many(blocks(spark, sf), _asked(spark, sf))).select("query_id", "rank", "book_id", "chapter_id", "ordinal", "total", "more")


@query
def w4_surrounding(spark, sf):
    centres = search.lexical_many(blocks(spark, sf), _asked(spark, sf)).select("book_id", "chapter_id", F.col("ordinal").alias("centre")).distinct()
    return search.surrounding(blocks(spark, sf), centres, 2).select("book_id", "chapter_id", "centre", "ordinal", F.length("text").alias("n_chars"))


@query
def p5_strip_html(spark, sf):
    plain = text.strip_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(plain).alias("n_chars"), F.sha2(plain, 256).alias("text_sha256"))


@query
def p1_block_parse(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("spine_item_id"), "html")
    return block_ops.parse(pages).select("spine_item_id", "ordinal", "block_id", "type", "text")


@query
def p2_annotated_html(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("spine_item_id"), "html")
    return block_ops.annotated(pages).select("spine_item_id", F.sha2("html", 256).alias("html_sha256"))


@query
def p6_block_types(spark, sf):
    """The elements of each page, by name."""
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag")
    return table(spark, sf, "pages").select("page_id", tags).groupBy("page_id", "tag").agg(F.count("*").alias("n")).select("page_id", "tag", "n", text.block_type(F.col("tag")).alias("type"))


@query
def p13_css(spark, sf):
    return derived(spark, sf, "css").select("id", text.sanitise_css(F.col("css")).alias("css"))


@query
def p15_visible_block(spark, sf):
    return positions.visible_block(derived(spark, sf, "boxes"))


@query
def j1_spine_manifest(spark, sf):
    return derived(spark, sf, "spine").join(derived(spark, sf, "manifest").withColumnRenamed("id", "idref"), ["book_id", "idref"]).select("book_id", "pos", "idref", "href", "media_type")


@query
def j2_navigation_labels(spark, sf):
    sections = derived(spark, sf, "manifest").select("book_id", F.col("id").alias("spine_item_id"), "href")
    return search.attach_labels(sections, derived(spark, sf, "points"))


@query
def j3_section_labels(spark, sf):
    return search.section_label(derived(spark, sf, "sections")).select("book_id", "spine_item_id", "label")


@query
def s8_resources(spark, sf):
    return search.resources(derived(spark, sf, "requests"), derived(spark, sf, "files")).withColumn("media_type", text.media_type(F.col("path")))


@query
def j12_links(spark, sf):
    sections = derived(spark, sf, "manifest").select("book_id", F.col("id").alias("spine_item_id"), "href")
    return search.links(derived(spark, sf, "anchors"), sections)


@query
def s14_new_books(spark, sf):
    from ..sources.epub import new_books

    return new_books(derived(spark, sf, "found"), derived(spark, sf, "owned"))


@query
def chapter_id_resolution(spark, sf):
    return search.chapter_ids(derived(spark, sf, "chapter_requests"), derived(spark, sf, "sections"))


@query
def t1_library_order(spark, sf):
    books = conversations.library_order(derived(spark, sf, "library"))
    return conversations.numbered(books.select("book_id")).select("book_id", "place")


@query
def s11_latest(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return stores.latest(rows, ["user_id", "event_type"], ["event_id"])


@query
def k14_cascade_delete(spark, sf):
    c = chapters(spark, sf).select("book_id", "chapter_id")
    deleted = spark.createDataFrame([("src1",), ("src7",)], "book_id string")
    (left,) = stores.cascade(deleted, c)
    return left.groupBy("book_id").agg(F.count("*").alias("n"))


@query
def w5_turns(spark, sf):
    return conversations.turns(table(spark, sf, "conversations"))


@query
def t2_conversation_order(spark, sf):
    m = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    return m.orderBy(F.desc("last_turn"), "conv_id")


@query
def n18_budget(spark, sf):
    e = table(spark, sf, "events")
    return conversations.budget_summary(e.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "No matches for it").otherwise(F.col("event_type")).alias("result")))


@query
def a9_trace_time(spark, sf):
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(*map(F.lit, ("user", "llm", "tool", "assistant"))), (F.col("event_id") % 4 + 1).cast("int"))
    return conversations.trace_time(e.select(F.col("user_id").alias("trace_id"), kind.alias("kind"), F.round("value", 3).alias("exec_time")))


def _questions(spark, sf):
    own = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.lit("Frankenstein or the Modern Tale").alias("title"), F.lit("Mary Shelley").alias("author"))
    return own.union(spark.sql(FIXTURES["questions"]).select("question_id", "question", "title", "author"))


@query
def n16_router(spark, sf):
    return router.heuristics(_questions(spark, sf)).select("question_id", "route", "confidence")


def _counts(spark, sf):
    from pyspark.sql import Window

    spine = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, sf, "documents").select(F.col("source").alias("book_id"), spine.alias("spine_index"), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 500)).cast("int").alias("pages"), F.col("n_chars").alias("length"))


@query
def w6_global_page(spark, sf):
    c = _counts(spark, sf)
    return positions.global_page(c, c.select("book_id", (F.col("spine_index") * 2).alias("spine_index"), F.lit(3).alias("local_page")))


@query
def w7_starting_page(spark, sf):
    c = _counts(spark, sf)
    return positions.starting_page(c, c.select("book_id", (F.col("spine_index") * 2 - 1).alias("spine_index")))


@query
def w8_local_position(spark, sf):
    c = _counts(spark, sf)
    asked = c.select("book_id", (F.col("spine_index") * 7 - 1).cast("long").alias("global_page"))
    return positions.local_position(c, asked)


@query
def a8_page_totals(spark, sf):
    return _counts(spark, sf).groupBy("book_id").agg(F.sum("pages").alias("pages"))


@query
def locations(spark, sf):
    return positions.locations(_counts(spark, sf))


@query
def w10_boundaries(spark, sf):
    return positions.boundaries(_counts(spark, sf))


@query
def w10_spine_of_location(spark, sf):
    c = _counts(spark, sf)
    return positions.spine_of_location(positions.boundaries(c), c.select("book_id", (F.col("spine_index") * 3).alias("location")))


@query
def cfi_generate(spark, sf):
    c = _counts(spark, sf)
    path = F.array((F.col("spine_index") % 5).cast("int"), F.lit(0))
    made = cfi.generate_full(F.col("spine_index"), F.concat(F.lit("ch"), F.col("spine_index")), path, F.col("length").cast("int"))
    return c.select("book_id", "spine_index", made.alias("cfi"), cfi.generate_base(F.col("spine_index"), F.lit(None).cast("string")).alias("base"))


def _trees(spark, sf):
    return written(dom.parse(table(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")), "trees")


@query
def dom_cfis(spark, sf):
    """The identifier of a place in each text node of each page: behind its last character."""
    at = dom.positions(_trees(spark, sf))
    named = cfi.generate_full(F.col("id").cast("int"), F.concat(F.lit("p"), F.col("id")), F.col("dom_path"), F.col("char_offset"))
    return at.select(F.col("id").alias("page_id"), "node", "element", named.alias("cfi"))


@query
def dom_round_trip(spark, sf):
    """Of each page, its text nodes, and those that the identifier of their middle leads back to."""
    trees = _trees(spark, sf)
    at = dom.positions(trees, "middle")
    named = at.select("id", "node", "node_offset", cfi.parse_full(cfi.generate_full(F.lit(0), F.lit(None).cast("string"), F.col("dom_path"), F.col("char_offset"))).alias("c"))
    back = dom.resolve(trees, named.select("id", "node", "node_offset", "c.dom_path", "c.char_offset"))
    same = (F.col("node") == F.col("to_node")) & (F.col("node_offset") == F.col("to_offset"))
    return back.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("n_nodes"), F.count_if(F.coalesce(same, F.lit(False))).alias("n_same"))


@query
def cfi_parse(spark, sf):
    c = derived(spark, sf, "cfis")
    base, full = cfi.parse_base(F.col("cfi")), cfi.parse_full(F.col("cfi"))
    return c.select("id", "cfi", base["spine_index"].alias("base_spine"), base["idref"].alias("base_idref"), full["spine_index"].alias("spine"), full["idref"].alias("idref"), F.array_join(full["dom_path"], ",").alias("dom_path"), full["char_offset"].alias("char_offset"))


@query
def swipe(spark, sf):
    asked = ("start_page", "current_page", "total_pages", "velocity", "spine_index", "total_spines")
    cols = derived(spark, sf, "swipes").select("id", *[F.col(c) if c == "velocity" else F.col(c).cast("int").alias(c) for c in asked])
    s = paging.swipe(*map(F.col, asked))
    return cols.select("*", s["action"].alias("action"), s["page"].alias("page"))


@query
def scrubber(spark, sf):
    c = _counts(spark, sf).groupBy("book_id").agg(F.sum("pages").alias("total"))
    pages = c.select("book_id", "total", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("page"))
    v = paging.scrub_value(F.col("page"), F.col("total"))
    return pages.select("book_id", "page", F.round(v, 6).alias("value"), paging.scrub_page(v, F.col("total")).alias("back"))


@query
def formatting(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.price(F.floor(F.col("p_retailprice") / 100) / 10).alias("price"), text.context_length(F.col("p_partkey") * 12_500).alias("context"), text.clamp(F.col("p_size") / 10, 1.0, 2.2).alias("font"), text.preview(F.col("p_name"), 8).alias("preview"))


@query
def headers_to_bold(spark, sf):
    return derived(spark, sf, "markdown").select("id", F.sha2(text.bold_headers(F.col("text")), 256).alias("text_sha256"))


@query
def short_address(spark, sf):
    names = ("road", "city", "town", "village", "state", "country", "name")
    return derived(spark, sf, "addresses").select("id", text.short_address(*map(F.col, names)).alias("address"))


@query
def selection_context(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.substring("text", 40, 12).alias("selected"))
    return d.select("doc_id", F.sha2(text.selection_context(F.col("text"), F.col("selected"), 60), 256).alias("context_sha256"))


@query
def summary_replies(spark, sf):
    from ..operators.replies import parse_summary

    return parse_summary(derived(spark, sf, "summaries")).select("id", "summary", F.array_join("key_points", ";").alias("key_points"), F.array_join("characters", ";").alias("characters"))


@query
def synopsis_replies(spark, sf):
    from ..operators.replies import parse_synopsis

    found = parse_synopsis(derived(spark, sf, "synopses"))
    return found.select("id", "synopsis", F.array_join(F.transform("characters", lambda c: F.concat_ws("=", c["name"], c["description"])), ";").alias("characters"), F.array_join("themes", ";").alias("themes"))


@query
def paragraph_packing(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunks.pack_paragraphs(docs, 200).select("id", "piece", F.length("text").alias("n_chars"))


@query
def v2_nearest(spark, sf):
    v = table(spark, sf, "embeddings")
    return vectors.nearest(v.select("vec_id", "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


def _indexed(spark, sf):
    """A new cell index of all embeddings, and the stated queries: ids divisible by 100."""
    v = table(spark, sf, "embeddings")
    return cells.CellIndex.build(v, index.fresh(spark, "cells"), scopes=("label",)), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query
def v2_index_exact(spark, sf):
    made, asked = _indexed(spark, sf)
    return made.search(asked, exact=True)


@query
def v2_index_scoped(spark, sf):
    made, asked = _indexed(spark, sf)
    return made.search(asked, 5, scope="label", exact=True)


@query
def v2_index_recall(spark, sf):
    """Of each query, how many of its ten nearest rows the index finds, whether it finds the row itself first, and the part of the table that it looks at."""
    made, asked = _indexed(spark, sf)
    true = vectors.nearest(table(spark, sf, "embeddings"), asked).select("query_id", "vec_id", F.lit(1).alias("true"))
    hits = made.search(asked).join(true, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("true").alias("found"), F.max((F.col("rank") == 1) & (F.col("vec_id") == F.col("query_id"))).alias("itself"))
    return hits.join(made.share(asked), "query_id")


@query
def v2_nearest_scoped(spark, sf):
    v = table(spark, sf, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), 5, scope="label")


@query
def a7_centroids(spark, sf):
    c = vectors.centroids(table(spark, sf, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


@query
def n10_similarity(spark, sf):
    return vectors.pairwise(vectors.centroids(table(spark, sf, "embeddings"), "label"), "label", "centroid")


@query
def l2_norms(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 5).alias("unit"))


@query
def n5_mentions(spark, sf):
    return entities.mentions(blocks(spark, sf))


@query
def n6_entities(spark, sf):
    found = index.written(entities.mentions(blocks(spark, sf)), "mentions")
    return entities.candidates(found, entities.variations(found)).withColumn("chapter_ids", _listed("chapter_ids"))


def _listed(column):
    """A list as text, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda c: c.cast("string")))


@query
def n8_cooccurrence(spark, sf):
    return index.concept_map(chapters(spark, sf), blocks(spark, sf)).cooccurrence


@query
def n9_salience(spark, sf):
    found = index.written(entities.mentions(blocks(spark, sf)), "mentions")
    known = entities.candidates(found, entities.variations(found))
    return entities.salience(known, chapters(spark, sf), tfidf.keywords(chapters(spark, sf))).withColumn("chapter_ids", _listed("chapter_ids"))


@query
def n13_events(spark, sf):
    made = index.concept_map(chapters(spark, sf), blocks(spark, sf)).events
    return made.withColumn("participants", F.array_join("participants", ";")).withColumn("chapter_ids", _listed("chapter_ids"))


@query
def n12_themes(spark, sf):
    keywords = index.written(tfidf.keywords(chapters(spark, sf)), "keywords")
    return themes.themes(themes.assign(tfidf.vectors(keywords, tfidf.vocabulary(keywords)), chapters(spark, sf)), keywords)


def _hits(spark, sf):
    m = index.concept_map(chapters(spark, sf), blocks(spark, sf))
    first = m.entities.select(F.concat_ws(":", "book_id", "rank").alias("question_id"), "book_id", F.concat(F.lit("who is "), F.col("text"), F.lit(" here")).alias("question"))
    return first, concepts.lookup(first, m.entities, m.themes, m.events)


@query
def n15_concept_lookup(spark, sf):
    return _hits(spark, sf)[1]


@query
def n17_disambiguation(spark, sf):
    asked, hits = _hits(spark, sf)
    routed = router.heuristics(asked.select("question_id", "question", F.lit("T").alias("title"), F.lit(None).cast("string").alias("author")))
    return router.disambiguate(routed.select("question_id", "route", "confidence"), hits)


@query
def u1_relevant_chapters(spark, sf):
    return concepts.relevant_chapters(_hits(spark, sf)[1])


@query
def a11_build_stats(spark, sf):
    return index.build_stats(chapters(spark, sf), blocks(spark, sf))


@query
def epub_sections(spark, sf):
    from ..sources.epub import read_sections

    return read_sections(_archive(spark, sf)).select("path", "title", "spine_index", "spine_item_id", "ncx_label", F.length("html").alias("n_chars"), F.col("error").isNotNull().alias("broken"))


@query
def wordpiece(spark, sf):
    from ..operators.wordpiece import encode_texts

    letters = [chr(c) for c in range(97, 123)]
    vocabulary = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *("##" + c for c in letters), ".", ",", "the", "##er", "##th"])}
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    made = encode_texts(docs, vocabulary, 512)
    return made.select("id", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n"))


@query
def p12_body(spark, sf):
    inside = markup.body(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(inside).alias("n_chars"), F.sha2(inside, 256).alias("body_sha256"))


@query
def p12_self_closing(spark, sf):
    closed = markup.close_empty(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(closed).alias("n_chars"), F.sha2(closed, 256).alias("html_sha256"))


@query
def p12_image_links(spark, sf):
    images = derived(spark, sf, "files").groupBy("book_id").agg(F.array_sort(F.collect_set("path")).alias("images"))
    return derived(spark, sf, "pictures").join(images, "book_id", "left").select("book_id", "id", markup.image_links(F.col("html"), F.col("base_path"), F.coalesce("images", F.array().cast("array<string>"))).alias("html"))


@query
def p14_linked_styles(spark, sf):
    return search.linked_styles(derived(spark, sf, "styled"), derived(spark, sf, "styles"))


@query
def p10_title(spark, sf):
    return tools.by_title(derived(spark, sf, "library"), "U").select("book_id", "title")


@query
def p11_conversations_of_book(spark, sf):
    return conversations.by_book(derived(spark, sf, "asked_conversations"), "1-URGENT").select("conv_id", "updated_ts")


@query
def t4_entity_top(spark, sf):
    found = index.written(entities.mentions(blocks(spark, sf)), "mentions")
    known = entities.candidates(found, entities.variations(found))
    return entities.salience(known, chapters(spark, sf), tfidf.keywords(chapters(spark, sf))).select("book_id", "entity_id", "rank")


@query
def t5_concept_display(spark, sf):
    return concepts.display(_hits(spark, sf)[1])


@query
def layout_keys(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.layout_key(F.format_string("%.1f", F.col("p_size") / 10), F.col("p_size") * 2, F.lit(820), F.lit(1180)).alias("layout"))


@query
def page_arithmetic(spark, sf):
    d = table(spark, sf, "documents")
    pages = paging.page_count(F.col("n_chars"), F.lit(640))
    return d.select("doc_id", pages.alias("pages"), paging.current_page(F.col("n_chars") / 3, F.lit(640), pages).alias("page"), F.sha2(text.first_words(F.col("text"), 5), 256).alias("head_sha256"))


@query
def s2_epub_metadata(spark, sf):
    from ..sources.epub import read_sections

    return read_sections(_archive(spark, sf), content=False).select("path", "title", "author", "spine_index", "spine_item_id", "href", "media_type", "ncx_label", F.col("html").isNull().alias("unread"), F.col("error").isNotNull().alias("broken"))


@query
def s3_epub_section(spark, sf):
    from ..sources.epub import section_at

    return section_at(_archive(spark, sf), 1).select("path", "spine_index", "spine_item_id", F.sha2("html", 256).alias("html_sha256"))


def _archive(spark, sf):
    """Archives of four documents each, every seventh a broken one."""
    from ..sources.epub import write_archives

    docs = table(spark, sf, "documents")
    book = F.floor(F.col("doc_id") / 4).cast("string")
    html = F.concat(F.lit("<html><body><p>"), F.coalesce("text", F.lit("")), F.lit("</p></body></html>"))
    label = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")))
    sections = docs.select(book.alias("path"), F.concat(F.lit("Book "), book).alias("title"), F.lit("A. Writer").alias("author"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("spine_item_id"), F.col("doc_id").alias("place"), label.alias("label"), html.alias("html"), F.when(F.col("doc_id") % 2 == 0, F.encode(F.coalesce("source", F.lit("")), "utf-8")).alias("image"))
    broken = F.when(F.pmod(F.col("path").cast("long"), F.lit(7)) == 0, F.lit("no archive").cast("binary")).otherwise(F.col("content"))
    return write_archives(sections).select("path", broken.alias("content"))


@query
def s10_store(spark, sf):
    store = stores.Store(spark, index.fresh(spark, "store"))
    sizes = chapters(spark, sf).groupBy("book_id").agg(F.count("*").alias("n"))
    store.save(sizes)
    store.save(sizes.where("book_id = 'src1'").withColumn("n", -F.col("n")))
    return store.load().select("book_id", "n")


@query
def v1_index_shape(spark, sf):
    return vectors.shape(table(spark, sf, "embeddings"))


@query
def v3_embed(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return vectors.embed(docs, _letters).select("id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


def _letters():
    """Stands in for a model: a text's letter counts."""
    import numpy as np

    return lambda texts: np.stack([np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=256)[97:123] for t in texts])


def _sections(spark, sf):
    return chapters(spark, sf).select("book_id", "chapter_id", F.concat(F.lit("Chapter "), "chapter_id").alias("label"))


@query
def tool_current_position(spark, sf):
    d = table(spark, sf, "documents")
    people = d.select(F.concat_ws("-", "source", "doc_id").alias("person_id"), F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 3).cast("int").alias("ordinal"))
    return tools.current_position(people, _sections(spark, sf), blocks(spark, sf))


@query
def tool_book_structure(spark, sf):
    current = chapters(spark, sf).groupBy("book_id").agg(F.min("chapter_id").alias("chapter_id"))
    return tools.book_structure(_sections(spark, sf), blocks(spark, sf), current)


@query
def tool_semantic_search(spark, sf):
    v = table(spark, sf, "embeddings")
    chunk_texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(v.select("vec_id", F.col("label").alias("chapter_id")), "vec_id")
    found = tools.semantic_search(v.select("vec_id", "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), chunk_texts)
    return found.select("query_id", "rank", "vec_id", "chapter_id", "similarity", F.sha2("snippet", 256).alias("snippet_sha256"))


@query
def tool_chapter_summary(spark, sf):
    return tools.stored_summaries(derived(spark, sf, "chapter_requests"), derived(spark, sf, "sections"), derived(spark, sf, "stored_summaries"))


@query
def j11_gathered_summaries(spark, sf):
    return tools.gathered_summaries(derived(spark, sf, "places"), derived(spark, sf, "stored_summaries"))


@query
def tool_book_synopsis(spark, sf):
    return tools.stored_synopses(derived(spark, sf, "library").withColumn("author", F.lit(None).cast("string")), derived(spark, sf, "stored_synopses"))


def _every_hundredth(spark, sf):
    """The stated set of requests: every document whose id is divisible by 100."""
    return table(spark, sf, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("source").alias("book_id"), F.col("doc_id").alias("current_id"), "text")


@query
def tool_lexical_search(spark, sf):
    scope = F.when(F.col("query_id") % 200 == 0, "full_book").otherwise("current_chapter")
    asked = _every_hundredth(spark, sf).select("query_id", F.substring("text", 1, 6).alias("query"), scope.alias("scope"), "book_id", F.col("current_id").alias("chapter_id"))
    return tools.lexical_search(blocks(spark, sf), asked, _sections(spark, sf)).select("query_id", "rank", "chapter_id", "label", "ordinal", F.sha2("text", 256).alias("text_sha256"), "total", "more")


@query
def tool_surrounding_context(spark, sf):
    own = text.block_id(F.col("chapter_id"), F.col("text"), F.col("ordinal"))
    known = blocks(spark, sf).withColumn("block_id", own)
    first = known.where("ordinal = 0 and chapter_id % 100 = 0").select(F.col("chapter_id").alias("query_id"), "book_id", F.col("block_id").alias("current_block_id"))
    asked = first.select("query_id", "book_id", F.when(F.col("query_id") % 200 == 0, "current").when(F.col("query_id") % 300 == 0, "no block").otherwise(F.col("current_block_id")).alias("block_id"), "current_block_id")
    return tools.surrounding_context(known, asked, 2).select("query_id", "block_id", "ordinal", F.length("text").alias("n_chars"))


@query
def tool_chapter_full_text(spark, sf):
    wanted = F.when(F.col("query_id") % 200 == 0, "current").when(F.col("query_id") % 300 == 0, "II").otherwise(F.col("query_id").cast("string"))
    asked = _every_hundredth(spark, sf).select("query_id", "book_id", wanted.alias("chapter_id"), "current_id")
    found = tools.chapter_full_text(blocks(spark, sf), asked, _sections(spark, sf))
    return found.select("query_id", "chapter_id", "label", F.sha2("text", 256).alias("text_sha256"))


@query
def tool_semantic_search_scoped(spark, sf):
    v = table(spark, sf, "embeddings").withColumnRenamed("label", "chapter_id")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text").join(v.select("vec_id", "chapter_id"), "vec_id")
    scope = F.when(F.col("vec_id") % 300 == 0, "full_book").when(F.col("vec_id") % 300 == 100, "current_chapter").otherwise("chapters")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", scope.alias("scope"), F.col("chapter_id").alias("current_id"), F.array(F.col("chapter_id"), F.lit(0)).alias("chapter_ids"))
    found = tools.semantic_search(v, tools.scoped(asked), texts, scope="chapter_id")
    return found.select("query_id", "rank", "vec_id", "chapter_id", "similarity")


@query
def s9_vector_index(spark, sf):
    kept = stores.VectorIndex(spark, index.fresh(spark, "vector-index"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    chunks_ = table(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chapter_id"), "text").join(v.select("chunk_id"), "chunk_id")
    kept.save(chunks_, v.join(chunks_.select("book_id", "chunk_id"), "chunk_id"))
    kept.delete("src1")
    return kept.load().select("book_id", "chunk_id", F.length("text").alias("n_chars"), F.size("embedding").alias("dim"))


@query
def s10_deleted(spark, sf):
    store = stores.Store(spark, index.fresh(spark, "store"))
    store.save(chapters(spark, sf).groupBy("book_id").agg(F.count("*").alias("n")))
    store.delete("src1")
    store.delete("no book")
    return store.load().select("book_id", "n")


@query
def u4_sparse_cosine(spark, sf):
    keywords = index.written(tfidf.keywords(chapters(spark, sf)), "keywords")
    sparse = index.written(tfidf.vectors(keywords, tfidf.vocabulary(keywords)), "vectors")
    return vectors.sparse_cosine(sparse, chapters(spark, sf).where("chapter_id % 100 = 0").select("book_id", "chapter_id"))


@query
def n10_similar_pairs(spark, sf):
    """Classes of chapters whose keyword vectors have a cosine of .3 or more, with the number of chapters in each."""
    keywords = index.written(tfidf.keywords(chapters(spark, sf)), "keywords")
    return similar.sized_pairs(*similar.classes(tfidf.vectors(keywords, tfidf.vocabulary(keywords))), 0.3)


@query
def n18_guardrails(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 13).cast("int").alias("round"), (F.col("event_id") % 3 == 0).alias("escalates"))
    return conversations.guarded(e).select("question_id", "seq", "allowed", "refused")


@query
def n14_mixed_themes(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chapter_id"), "embedding").join(chapters(spark, sf).select("book_id", "chapter_id"), "chapter_id")
    return index.concept_map(chapters(spark, sf), blocks(spark, sf), v).themes


@query
def json_arguments(spark, sf):
    return derived(spark, sf, "tool_calls").select("id", *[text.json_argument(F.col("arguments"), n).alias(n) for n in ("query", "scope")], text.json_argument(F.col("arguments"), "limit").cast("int").alias("most"))


@query
def iso_times(spark, sf):
    return derived(spark, sf, "times").select("id", text.iso_time(F.col("t")).alias("seconds"))


@query
def s12_summaries(spark, sf):
    return captured.summaries(derived(spark, sf, "encyclopedia"))


@query
def s12_search(spark, sf):
    return captured.search_hits(derived(spark, sf, "encyclopedia_search"))


@query
def s12_places(spark, sf):
    return captured.places(derived(spark, sf, "place_search"))


@query
def s7_images(spark, sf):
    from ..sources.epub import read_resources

    return read_resources(_archive(spark, sf)).select("path", "resource", "file_name", "media_type", F.octet_length("content").alias("n_bytes"))
