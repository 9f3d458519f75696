"""Entities, themes, events, concept lookup and disambiguation: fixed cases and brute force."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import concepts, conversations, entities, positions, router, search, themes, tools, vectors
from foliant.sources import captured, epub, stores
from foliant.plans.fixtures import FIXTURES, sample_epub

MENTION = "book_id string, chapter_id long, ordinal int, text string, offset int"
ENTITY = "book_id string, entity_id string, text string, frequency long, chapter_ids array<long>, salience double, rank int"


def test_candidates_count_mentions_of_all_variations(spark):
    said = [("Ann Lee", 1), ("Ann", 1), ("Ann", 2), ("Lee", 3), ("Bob", 1), ("Bob", 1), ("Cy", 5), ("Cy", 5), ("Cy", 5)]
    m = spark.createDataFrame([("b", c, 0, t, 0) for t, c in said], MENTION)
    got = {r.entity_id: (r.text, r.frequency, r.chapter_ids) for r in entities.candidates(m, entities.variations(m)).collect()}
    ids = {t: spark.range(1).select(text.entity_id(F.lit(t)).alias("x")).first().x for t in ("ann lee", "cy")}
    assert got == {ids["ann lee"]: ("Ann Lee", 4, [1, 2, 3]), ids["cy"]: ("Cy", 3, [5])}


def test_salience_by_definition(spark):
    rng = random.Random(1)
    n = 9
    rows = [("b", f"e{i}", rng.choice(["Ann", "Ann Lee", "Sea"]) + str(i % 2) * 0, rng.randrange(3, 80), sorted(rng.sample(range(n), rng.randrange(1, n)))) for i in range(30)]
    keys = {(c, w): rng.random() * 8 for c in range(n) for w in ("ann", "lee", "sea") if rng.random() < 0.5}
    known = spark.createDataFrame(rows, "book_id string, entity_id string, text string, frequency long, chapter_ids array<long>")
    chapters = spark.createDataFrame([("b", c, "x") for c in range(n)], "book_id string, chapter_id long, text string")
    keywords = spark.createDataFrame([("b", c, w, v) for (c, w), v in keys.items()], "book_id string, chapter_id long, term string, tfidf double")
    want = {}
    for _, e, t, f, cs in rows:
        boost = min(0.3, sum(keys.get((c, w), 0) / 10 for c in cs for w in t.lower().split(" ")) / max(1, len(cs)))
        want[e] = round((0.4 * min(1, f / 50) + 0.4 * min(1, len(cs) / max(1, n // 3)) + boost) * (1 if len(cs) >= 2 else 0.5), 6)
    got = entities.salience(known, chapters, keywords, 10).collect()
    order = sorted(want, key=lambda e: (-want[e], e))[:10]
    assert [r.entity_id for r in sorted(got, key=lambda r: r.rank)] == order
    assert all(abs(r.salience - want[r.entity_id]) < 2e-6 for r in got)


def test_events_join_pairs_once(spark):
    known = spark.createDataFrame([("b", f"e{i}", f"N{i}", 5, cs, 0.5, i + 1) for i, cs in enumerate([[1, 2, 3], [2, 3], [9], [3, 1], [1, 2]])], ENTITY)
    met = {("e0", "e1"): 5, ("e0", "e2"): 9, ("e0", "e3"): 3, ("e0", "e4"): 2, ("e1", "e3"): 4, ("e3", "e4"): 8}
    cooc = spark.createDataFrame([("b", *p, n) for k, n in met.items() for p in (k, k[::-1])], "book_id string, e1 string, e2 string, n long")
    got = {r.event_id: (r.participants, r.chapter_ids, r.rank) for r in entities.events(known, cooc).collect()}
    assert got == {"e0_e1": (["N0", "N1"], [2, 3], 1), "e0_e3": (["N0", "N3"], [1, 3], 2), "e1_e3": (["N1", "N3"], [3], 3), "e3_e4": (["N3", "N4"], [1], 4)}
    label = entities.events(known, cooc).where("event_id = 'e0_e1'").first().label
    assert label == "Interaction: N0 & N1"


def test_themes_of_given_clusters(spark):
    assigned = spark.createDataFrame([("b", 0, c) for c in (1, 2, 3)] + [("b", 1, 4), ("one", 0, 7)], "book_id string, theme int, chapter_id long")
    keywords = spark.createDataFrame([("b", 1, "sea", 2.0), ("b", 2, "sea", 1.0), ("b", 2, "ship", 2.5), ("b", 3, "ash", 2.5), ("b", 4, "road", 1.0)], "book_id string, chapter_id long, term string, tfidf double")
    got = {(r.book_id, r.theme_id): (r["keywords"], r.chapter_ids, r.cohesion, r.rank) for r in themes.themes(assigned, keywords).collect()}
    assert got == {("b", "theme_0"): (["sea", "ash", "ship"], [1, 2, 3], 0.6, 1), ("b", "theme_1"): (["road"], [4], 0.2, 2), ("one", "theme_0"): ([], [7], 1.0, 1)}
    cut = themes.themes(assigned, keywords, 2).where("theme_id = 'theme_0' and book_id = 'b'").first()
    assert cut["keywords"] == ["sea", "ash"] and cut.label == "Sea & Ash"


def test_dense_vectors_are_mixed_where_the_first_has_one(spark):
    rng = np.random.default_rng(3)
    sparse, dense, has = rng.random((6, 4)), rng.random((6, 3)), np.array([1, 0, 1, 1, 0, 1], bool)
    cos = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    got = themes.similarity(sparse, np.where(has[:, None], dense, 0), has)
    for i in range(6):
        for j in range(i + 1, 6):
            s = cos(sparse[i], sparse[j])
            assert abs(got[i, j] - (0.7 * (cos(dense[i], dense[j]) if has[j] else 0) + 0.3 * s if has[i] else s)) < 1e-12 and got[i, j] == got[j, i]
    rows = [("b", c, i, float(sparse[c, i])) for c in range(6) for i in range(4)]
    v = spark.createDataFrame(rows, "book_id string, chapter_id long, index int, value double")
    chapters = spark.createDataFrame([("b", c) for c in range(6)], "book_id string, chapter_id long")
    centroids = spark.createDataFrame([("b", c, [float(x) for x in dense[c]]) for c in range(6) if has[c]], "book_id string, chapter_id long, centroid array<double>")
    clusters = {}
    for r in themes.assign(v, chapters, centroids).collect():
        clusters.setdefault(r.theme, []).append(r.chapter_id)
    assert sorted(map(sorted, clusters.values())) == sorted(map(sorted, themes.cluster(got)))
    assert themes.assign(v, chapters, most=5).select("chapter_id").distinct().count() == 6  # in rounds


def test_sparse_cosine_against_dense_rows(spark):
    rng = np.random.default_rng(4)
    m = np.where(rng.random((8, 5)) < 0.5, rng.random((8, 5)), 0)
    v = spark.createDataFrame([("b", c, i, float(m[c, i])) for c in range(8) for i in range(5) if m[c, i]], "book_id string, chapter_id long, index int, value double")
    got = {(r.a, r.b): r.similarity for r in vectors.sparse_cosine(v, spark.createDataFrame([("b", 2), ("b", 2), ("c", 1)], "book_id string, chapter_id long")).collect()}
    assert got == {(2, c): round(float(m[2] @ m[c] / math.sqrt((m[2] @ m[2]) * (m[c] @ m[c]))), 6) for c in range(8) if c != 2 and m[2] @ m[c]}


CONCEPTS = [("e1", "Ann Lee", 0.9, [1, 2, 3, 4, 5, 6]), ("e2", "Lee", 0.6, [2]), ("e3", "Bob", 0.2, [9])]


def concept_tables(spark):
    e = spark.createDataFrame([("b", i, t, 5, cs, s, k + 1) for k, (i, t, s, cs) in enumerate(CONCEPTS)], ENTITY)
    t = spark.createDataFrame([("b", "t0", "Sea & Ship", ["sea", "ship"], list(range(20)), 1), ("b", "t1", "Roads", ["road"], [5], 2)], "book_id string, theme_id string, label string, keywords array<string>, chapter_ids array<long>, rank int")
    v = spark.createDataFrame([("b", "x", "Interaction: Ann Lee & Bob", ["Ann Lee", "Bob"], [1, 9], 1)], "book_id string, event_id string, label string, participants array<string>, chapter_ids array<long>, rank int")
    return e, t, v


def contains_either(a, b):
    return a in b or b in a


def test_sparse_cosine_of_blocks_shuffles_chapters_not_pairs(spark, monkeypatch):
    rng = random.Random(5)
    data = [(b, c, k, rng.choice([0.0, 1.0, 2.5])) for b in ("p", "q") for c in range(30) for k in rng.sample(range(9), 3)] + [("p", 1, 4, 1.5), ("p", 40, 99, 1.0), (None, 1, 1, 1.0)]
    rows_of, norms = {}, {}
    for b, c, k, x in data[:-1]:
        own = rows_of.setdefault((b, c), {})
        own[k] = own.get(k, 0) + x
        norms[b, c] = norms.get((b, c), 0) + x * x
    want = {}
    for (b, c), x in rows_of.items():
        for (d, e), y in rows_of.items():
            if b == d and c != e and c % 3 == 0 and x.keys() & y.keys():
                n = (norms[b, c] * norms[d, e]) ** 0.5
                want[b, c, e] = round(sum(x[k] * y[k] for k in x.keys() & y.keys()) / n, 6) if n else 0.0
    monkeypatch.setattr(vectors, "OTHERS", 1)
    v = spark.createDataFrame(data, "book_id string, chapter_id long, index int, value double").repartition(3)
    got = vectors.sparse_cosine(v, v.where("chapter_id % 3 = 0").select("book_id", "chapter_id"), block=4)
    assert got.count() == len(want) and all(abs(want[r.book_id, r.a, r.b] - r.similarity) < 2e-6 for r in got.collect())
    assert "keys: [book_id, a, b]" not in (plan := got._jdf.queryExecution().toString()) and "sum((x" not in plan


def test_lookup_matches_both_ways(spark):
    e, t, v = concept_tables(spark)
    asked = ["ann", "who is ann lee at sea", "road", "nothing of it", "bob", "the ship"]
    q = spark.createDataFrame([(f"q{i}", "b", x) for i, x in enumerate(asked)] + [("other", "c", "ann")], "question_id string, book_id string, question string")
    hits = concepts.lookup(q, e, t, v)
    got = sorted((r.question_id, r.kind, r.rank, r.label) for r in hits.collect())
    want = []
    for i, x in enumerate(asked):
        named = [("entity", [n for _, n, _, _ in CONCEPTS if contains_either(n.lower(), x)])]
        named += [("theme", [n for n, ws in (("Sea & Ship", ["sea", "ship"]), ("Roads", ["road"])) if any(contains_either(y.lower(), x) for y in [n, *ws])])]
        named += [("event", ["Interaction: Ann Lee & Bob"] if any(contains_either(y, x) for y in ("interaction: ann lee & bob", "ann lee", "bob")) else [])]
        want += [(f"q{i}", k, r + 1, n) for k, ns in named for r, n in enumerate(ns)]
    assert got == sorted(want) and any(k == "theme" for _, k, *_ in got)
    chapters = {(r.question_id, r.chapter_id) for r in concepts.relevant_chapters(hits).collect()}
    assert {c for k, c in chapters if k == "q0"} == {1, 2, 3, 4, 5, 6, 9} and len(chapters) == concepts.relevant_chapters(hits).count()


def test_display_caps(spark):
    rows = [("q", k, r, f"{k}{r}", 0.5, list(range(30))) for k in ("entity", "theme", "event") for r in range(1, 9)]
    hits = spark.createDataFrame(rows, "question_id string, kind string, rank int, label string, salience double, chapter_ids array<long>")
    got = {}
    for r in concepts.display(hits).collect():
        got.setdefault(r.kind, set()).add((r.rank, len(r.chapter_ids)))
    assert got == {"entity": {(r, 5) for r in range(1, 6)}, "theme": {(r, 10) for r in range(1, 4)}, "event": {(r, 5) for r in range(1, 4)}}


def test_disambiguation_takes_the_surer_route(spark):
    hits = [("many", "entity", 1, "Ann", 0.1, [3, 1]), ("many", "theme", 1, "Sea", None, [2]), ("many", "event", 1, "x", None, [8]), ("salient", "entity", 1, "Ann", 0.75, [4]), ("two", "entity", 1, "A", 0.1, [1]), ("two", "entity", 2, "B", 0.1, [2]), ("half", "entity", 1, "A", 0.5, [1]), ("weak", "entity", 1, "A", 0.1, [1]), ("event", "event", 1, "x", None, [1]), ("clear", "entity", 1, "A", 0.9, [1]), ("sure", "entity", 1, "A", 0.9, [1])]
    routed = [(q, "ambiguous", 0.4) for q in ("many", "salient", "two", "half", "weak", "event", "none")] + [("clear", "not_book", 0.8), ("sure", "ambiguous", 0.9)]
    got = {r.question_id: (r.route, r.confidence, r.suggested_chapters, r.suggested_queries) for r in router.disambiguate(spark.createDataFrame(routed, "question_id string, route string, confidence double"), spark.createDataFrame(hits, "question_id string, kind string, rank int, label string, salience double, chapter_ids array<long>")).collect()}
    assert got["many"] == ("book", 0.9, [1, 2, 3], ["Ann"]) and got["salient"] == ("book", 0.9, [4], ["Ann"])
    assert got["two"] == ("book", 0.8, [1, 2], ["A", "B"]) and got["half"][:2] == ("book", 0.8) and got["weak"][:2] == ("book", 0.7)
    assert got["event"][:2] == got["none"][:2] == ("not_book", 0.65)
    assert got["clear"] == ("not_book", 0.8, [], []) and got["sure"] == ("ambiguous", 0.9, [], [])


def test_who_is_alice_is_about_the_book(spark):
    asked = spark.createDataFrame([("q", "Who is Alice?", "Wonderland", None)], "question_id string, question string, title string, author string")
    hits = spark.createDataFrame([("q", "entity", 1, "Alice", 0.9, [1])], "question_id string, kind string, rank int, label string, salience double, chapter_ids array<long>")
    r = router.disambiguate(router.heuristics(asked).select("question_id", "route", "confidence"), hits).first()
    assert r.route == "book" and r.confidence >= 0.7


# lookups, places and stores


@pytest.mark.parametrize(("held", "chars"), [(200_000, 4_000_000), (5, 100)])
def test_what_is_shown_needs_the_first_hits_alone(spark, monkeypatch, held, chars):
    """Equal to `display` of all hits; queries that are alike and hits beyond the first are not handed on."""
    import random

    rng, handed = random.Random(9), {}
    monkeypatch.setattr(search, "HELD", held)
    monkeypatch.setattr(search, "QUERY_CHARS", chars)
    monkeypatch.setattr(search, "written", lambda df, name, real=search.written: handed.setdefault(name, real(df, name)))
    rows = [(rng.choice("xy"), c, o, rng.choice([None, "", "The sea", "the Sand by the sea", "a"])) for c in range(30) for o in range(20)]
    blocks = spark.createDataFrame(rows, "book_id string, chapter_id long, ordinal int, text string").repartition(3)
    asked = [(k, rng.choice(["the", "SEA", "a", "", None, "none"]), rng.choice(["x", "y", None]), rng.choice([None, 3, 7, 29])) for k in range(120)]
    queries = spark.createDataFrame(asked, "query_id int, query string, book_id string, chapter_id long")
    for some in (["book_id", "chapter_id"], []):
        handed.clear()
        own = queries.select("query_id", "query", *some)
        want = search.display(search.lexical_many(blocks, own), 3).drop("match_pos")
        got = search.shown_of(blocks, own, 3)
        assert want.count() and sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())), some
        if held > 5:
            # of each different query and task three places at most
            assert handed["first-hits"].count() <= 3 * blocks.rdd.getNumPartitions() * handed["groups"].count()


def test_lexical_search_against_all_blocks(spark):
    rng = random.Random(5)
    rows = [(b, c, o, "".join(rng.choices("abAB ", k=30))) for b in ("x", "y") for c in (1, 2) for o in range(15)] + [("x", 3, 0, None), ("x", 3, 1, "")]
    blocks = spark.createDataFrame(rows, "book_id string, chapter_id long, ordinal int, text string")
    asked = [(i, q, scope, book, chapter) for i, (q, scope, book, chapter) in enumerate([("ab", "full_book", "x", 1), ("AB", None, "x", 2), ("a b", "current_chapter", "y", 1), ("", "full_book", "x", 1), (None, "full_book", "x", 1), ("ab", "current_chapter", "x", 1), ("b", "full_book", None, 1), ("b", None, "x", None)])]
    requests = spark.createDataFrame(asked, "query_id long, query string, scope string, book_id string, chapter_id long")
    sections = spark.createDataFrame([("x", 1, "One")], "book_id string, chapter_id long, label string")
    got = {}
    for r in tools.call("lexical_search", blocks, requests, sections, most=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chapter_id, r.ordinal, r.label, r.total, r.more))
    for i, q, scope, book, chapter in asked:
        hits = [(c, o) for b, c, o, t in rows if q and t and book and b == book and (scope == "full_book" or c == chapter) and q.lower() in t.lower()]
        assert sorted(got.get(i, [])) == [(k + 1, c, o, "One" if (book, c) == ("x", 1) else str(c), len(hits), max(0, len(hits) - 4)) for k, (c, o) in enumerate(sorted(hits)[:4])], i
    whole = search.lexical_many(blocks, requests.select("query_id", "query"))
    assert {(r.query_id, r.book_id, r.chapter_id, r.ordinal, r.match_pos) for r in whole.collect()} == {(i, b, c, o, t.lower().find(q.lower())) for i, q, *_ in asked if q for b, c, o, t in rows if t and q.lower() in t.lower()}


def test_scoped_nearest_and_text_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(f"v{i}", [float(x) for x in rng.random(4)], int(rng.integers(0, 4))) for i in range(60)]
    index = spark.createDataFrame(rows, "vec_id string, embedding array<float>, chapter_id int")
    asked = spark.createDataFrame([("q0", rows[0][1], "full_book", 1, None), ("q1", rows[1][1], "current_chapter", 2, None), ("q2", rows[2][1], "chapters", 2, [0, 3]), ("q3", rows[3][1], "chapters", 2, None)], "query_id string, embedding array<float>, scope string, current_id int, chapter_ids array<int>")
    got = {}
    for r in vectors.nearest(index, tools.scoped(asked), 5, scope="chapter_id").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for i, seen in enumerate(({0, 1, 2, 3}, {2}, {0, 3}, {0, 1, 2, 3})):
        a = np.array(rows[i][1], np.float32).astype(float)
        cos = lambda x: round(float(a @ x / math.sqrt((a @ a) * (x @ x))), 6)  # noqa: B023, E731
        want = sorted((-cos(np.array(e, np.float32).astype(float)), k) for k, e, c in rows if c in seen)[:5]
        assert sorted(got[f"q{i}"]) == [(r + 1, k) for r, (_, k) in enumerate(want)]


def test_current_block_and_chapter(spark):
    blocks = spark.createDataFrame([("b", c, o, f"t{c}{o}", f"id{c}{o}") for c in (1, 2) for o in range(8)], "book_id string, chapter_id long, ordinal int, text string, block_id string")
    asked = spark.createDataFrame([(1, "b", "current", "id14"), (2, "b", None, "id20"), (3, "b", "id27", None), (4, "b", "gone", "id10"), (5, "b", "current", None)], "query_id long, book_id string, block_id string, current_block_id string")
    got = {}
    for r in tools.call("get_surrounding_context", blocks, asked, radius=2).collect():
        got.setdefault(r.query_id, []).append(r.text)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["t12", "t13", "t14", "t15", "t16"], 2: ["t20", "t21", "t22"], 3: ["t25", "t26", "t27"]}
    sections = spark.createDataFrame([("b", 1, "I"), ("b", 2, "II")], "book_id string, chapter_id long, label string")
    asked = spark.createDataFrame([(1, "b", "current", 2), (2, "b", None, 1), (3, "b", "2", 1), (4, "b", "II", 1), (5, "b", "9", 1)], "query_id long, book_id string, chapter_id string, current_id long")
    got = {r.query_id: (r.chapter_id, r.label, r.text and r.text[:8]) for r in tools.call("get_chapter_full_text", blocks, asked, sections).collect()}
    assert got == {1: (2, "II", "t20\n\nt21"), 2: (1, "I", "t10\n\nt11"), 3: (2, "II", "t20\n\nt21"), 4: (None, None, None), 5: (None, None, None)}


def test_places_against_a_scan(spark):
    rng = random.Random(7)
    sizes = {b: [rng.randrange(0, 6) for _ in range(rng.randrange(1, 7))] for b in "abcde"}
    counts = spark.createDataFrame([(b, i, n) for b, ns in sizes.items() for i, n in enumerate(ns)], "book_id string, spine_index int, pages int")
    asked = spark.createDataFrame([(b, p) for b in "abcdef" for p in [*range(-2, 40), None]], "book_id string, global_page long")
    got = {(r.book_id, r.global_page): (r.spine_index, r.local_page) for r in positions.local_position(counts, asked).collect()}
    for (b, p), found in got.items():
        ns = sizes.get(b)
        flat = [(i, k) for i, n in enumerate(ns or []) for k in range(n)]
        want = (0, 0) if not ns or p is None or p < 1 else flat[p - 1] if p <= len(flat) else (len(ns) - 1, max(0, ns[-1] - 1))
        assert found == want, (b, p)
    assert len(got) == 6 * 43


def test_links_have_one_row_each(spark):
    sections = spark.createDataFrame([("b", "s1", "a/ch.xhtml"), ("b", "s2", "b/ch.xhtml"), ("b", "s3", "c.xhtml"), ("d", "s0", "gone.xhtml")], "book_id string, spine_item_id string, href string")
    anchors = spark.createDataFrame([("b", x) for x in ("b/ch.xhtml#p", "ch.xhtml", "x/c.xhtml", "#top", "http://e.org/c.xhtml", "gone.xhtml")], "book_id string, link string")
    got = {r.link: (r.kind, r.spine_item_id, r.fragment) for r in search.links(anchors, sections).collect()}
    assert got == {"b/ch.xhtml#p": ("internal", "s2", "p"), "ch.xhtml": ("internal", "s1", None), "x/c.xhtml": ("internal", "s3", None), "#top": ("anchor", None, "top"), "http://e.org/c.xhtml": ("external", None, None), "gone.xhtml": ("unknown", None, None)}
    assert search.links(anchors, sections).count() == 6


def test_vector_index(spark, tmp_path):
    chunks = spark.createDataFrame([(b, i, 1, f"t{i}") for b, i in (("a", 1), ("a", 2), ("b/c", 3))], "book_id string, chunk_id long, chapter_id long, text string")
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b/c", 3, [1.0, 1.0])], "book_id string, chunk_id long, embedding array<float>")
    kept = stores.VectorIndex(spark, str(tmp_path / "index"))
    kept.save(chunks, v)
    assert kept.load("a").count() == 2 and kept.exists("b/c")
    kept.delete("b/c")
    kept.delete("none")
    assert not kept.exists("b/c") and kept.load().count() == 2
    with pytest.raises(ValueError):
        kept.save(chunks, v.limit(2))
    with pytest.raises(ValueError):
        kept.save(chunks, v.withColumn("embedding", F.when(F.col("chunk_id") == 1, F.col("embedding")).otherwise(F.slice("embedding", 1, 1))))


def test_guardrails_by_a_fold(spark):
    rng = random.Random(8)
    rows = [(q, i, rng.choice([None, 1, 5, 10, 11]), rng.choice([None, True, False])) for q in range(6) for i in range(16)]
    got = {(r.question_id, r.seq): (r.allowed, r.refused) for r in conversations.guarded(spark.createDataFrame(rows, "question_id long, seq long, round int, escalates boolean")).collect()}
    for q in range(6):
        calls = widened = 0
        for _, i, rnd, esc in (r for r in rows if r[0] == q):
            why = "round" if (rnd or 1) > 10 else "escalation" if esc and widened >= 1 else "budget" if calls >= 8 else None
            widened += bool(esc and (rnd or 1) <= 10)
            calls += why is None
            assert got[q, i] == (why is None, why)


def test_numbered_is_the_order(spark):
    rows = spark.range(1000).repartition(7).orderBy(F.desc("id"))
    assert sorted((r.place, r.id) for r in conversations.numbered(rows).collect()) == [(i + 1, 999 - i) for i in range(1000)]
    assert conversations.numbered(rows.where("false")).count() == 0


def test_images_of_an_archive(spark):
    archive = spark.createDataFrame([("a.epub", bytearray(sample_epub())), ("b.epub", bytearray(b"x")), ("c.epub", None)], "path string, content binary")
    assert [tuple(r) for r in epub.read_resources(archive).collect()] == [("a.epub", "OPS/p.png", "p.png", "image/png", bytearray(b"x"))]
    assert [r.resource for r in epub.read_resources(archive, "text/css").collect()] == ["OPS/s.css"]


def test_captured_replies(spark):
    got = {r.query: (r.outcome, r.title, r.image, r.page) for r in captured.summaries(spark.sql(FIXTURES["encyclopedia"])).collect()}
    assert got == {"sea": ("found", "Sea", "t.jpg", "http://e.org/Sea"), "ship": ("found", "Ship", "o.jpg", None), "gone": ("not_found", None, None, None), "busy": ("http_error", None, None, None), "odd": ("invalid", None, None, None)}
    assert [tuple(r) for r in captured.places(spark.sql(FIXTURES["place_search"])).collect()] == [("bath", 1, 51.38, -2.36, "Bath", "Bath, Somerset, UK"), ("51.4,-2.3", 1, 51.4, -2.3, "Hill Farm", "Hill Farm, UK")]
    assert [(r.rank, r.snippet) for r in captured.search_hits(spark.sql(FIXTURES["encyclopedia_search"])).collect()] == [(1, "the sea is"), (2, "ice")]


def test_a_dense_text_is_counted_by_its_entities_not_by_its_pairs():
    rng = np.random.default_rng(5)
    codes, places = rng.integers(0, 40, 60_000), rng.integers(0, 15_000, 60_000)  # 120 million pairs within a window
    began = time.process_time()
    a, b, n = entities.near_counts(codes, places)
    assert time.process_time() - began < 4
    at = np.zeros((40, 15_000 + 2 * entities.WINDOW), np.int64)
    np.add.at(at, (codes, places + entities.WINDOW), 1)
    upto = np.pad(at.cumsum(axis=1), ((0, 0), (1, 0)))
    near = upto[:, 2 * entities.WINDOW + 1 :] - upto[:, : -2 * entities.WINDOW - 1]
    whole = at[:, entities.WINDOW : -entities.WINDOW] @ near.T
    assert len(n) == 40 * 39 // 2 and (whole[a, b] == n).all()


@pytest.mark.parametrize("cells", [1, 30, 1 << 16])
def test_pairs_of_the_first_entities_alone(cells):
    rng = np.random.default_rng(6)
    codes, places = rng.integers(0, 25, 300) * 2, rng.integers(0, 900, 300)
    every = {(i, j): k for i, j, k in zip(*(x.tolist() for x in entities.near_counts(codes, places, 40)), strict=True)}
    some = entities.near_counts(codes, places, 40, cells, first=11)
    assert {(i, j): k for i, j, k in zip(*(x.tolist() for x in some), strict=True)} == {p: k for p, k in every.items() if p[0] < 11}
    total = entities.PairCounts(50, 100, 40)
    got = {}
    for _ in range(3):
        total.add(*entities.near_counts(codes, places, 40))
        for i, j, k in (t for part in total.taken(False) for t in zip(*(x.tolist() for x in part), strict=True)) if total.full() else ():
            got[i, j] = got.get((i, j), 0) + k
    for i, j, k in (t for part in total.taken() for t in zip(*(x.tolist() for x in part), strict=True)):
        got[i, j] = got.get((i, j), 0) + k
    assert got == {p: 3 * k for p, k in every.items()}


def test_pairs_of_many_entities_cost_less_than_a_row_of_all_of_them_each():
    rng = np.random.default_rng(8)
    codes, places = rng.integers(0, 3000, 120_000), rng.integers(0, 60_000, 120_000)
    began = time.thread_time()
    a, b, n = entities.near_counts(codes, places, first=1000)
    assert time.thread_time() - began < 8  # 14 s by rows of running counts, 4 s by bins
    at = np.flatnonzero(codes == 7)
    near = np.bincount(codes[np.flatnonzero((np.abs(places[None, :] - places[at][:, None]) <= entities.WINDOW)) % len(codes)], minlength=3000)
    mine = a == 7
    assert (a < 1000).all() and (near[b[mine]] == n[mine]).all() and mine.sum() == np.count_nonzero(near[8:])


def test_names_that_overlap_themselves_are_found_without_overlap():
    names = [("ana", 0), ("anan", 1), ("aa", 2), ("bob", 3), ("lee", 4)]
    find = entities._finder(names)
    rng = np.random.default_rng(9)
    for size in (0, 1, 30, 400):
        text = "".join(rng.choice(list("aanbo le"), size))
        which, places = find(text)
        assert sorted(zip(which.tolist(), places.tolist(), strict=True)) == sorted((k, m.start()) for k, (v, _) in enumerate(names) for m in re.finditer(v, text))
    assert len(find(None)[0]) == 0
