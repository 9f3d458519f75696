"""Functions on columns and row-local kernels, with fixed inputs and brute force."""

import hashlib

from pyspark.sql import functions as F

from foliant.functions import cfi, markup, paging, text
from foliant.operators import blocks, chunks, entities, themes, wordpiece
from foliant.operators.replies import parse_summary, parse_synopsis
from foliant.plans.fixtures import FIXTURES, sample_epub
from foliant.sources import epub


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_token_estimates(spark):
    got = [one(spark, text.tokens_at_least_one(F.lit(t))) for t in ("", "word", "Hello, world!", "a" * 400)]
    assert got == [1, 1, 3, 100]
    assert one(spark, text.tokens_rough(F.lit(""))) == 0


def test_tokenise_is_ascii(spark):
    assert one(spark, text.tokenise(F.lit("Élan vital, DON'T"))) == ["lan", "vital", "don", "t"]


def test_strip_html_decodes_in_order(spark):
    assert one(spark, text.strip_html(F.lit("<p>a &amp;lt; b\n\n c&nbsp;d</p>"))) == "a < b c d"
    assert blocks.plain("<p>a &amp;lt; b\n\n c&nbsp;d</p>") == "a < b c d"


def test_block_id_matches_kernel(spark):
    got = one(spark, text.block_id(F.lit("s1"), F.lit("  Two\n Words "), F.lit(3)))
    assert got == blocks.block_key("s1", "  Two\n Words ", 3) == hashlib.sha256(b"s1|two words|3").hexdigest()[:12]


def test_css(spark):
    assert one(spark, text.sanitise_css(F.lit("p { margin-left: 56%; }"))) == "p { /* [sanitized margin-left] */ }"
    assert one(spark, text.sanitise_css(F.lit("p { margin: 1.25em 45%; }"))) == "p { margin: 1.25em 45%; }"


def test_cfi_round_trip(spark):
    made = cfi.generate_full(F.lit(1), F.lit("ch02"), F.array(F.lit(1), F.lit(0), F.lit(0)), F.lit(42))
    assert one(spark, made) == "epubcfi(/6/4[ch02]!/4/2/2:42)"
    assert one(spark, cfi.parse_full(made)) == (1, "ch02", [1, 0, 0], 42)
    assert one(spark, cfi.parse_full(F.lit("epubcfi(/6/4[ch02]!/4/2/1:42)"))) == (1, "ch02", [1, 0], 42)
    assert one(spark, cfi.parse_base(F.lit("epubcfi(/6/2!)"))) == (0, None)
    assert one(spark, cfi.parse_base(F.lit("invalid"))) is None
    assert one(spark, cfi.parse_base(F.lit("epubcfi(/5/2!)"))) is None


def test_swipe_needs_more_than_the_threshold(spark):
    act = lambda *a: tuple(one(spark, paging.swipe(*map(F.lit, a))))
    assert act(2, 2, 5, 0.5, 0, 3) == ("snap", 2)
    assert act(2, 2, 5, 0.51, 0, 3) == ("snap", 3)
    assert act(4, 4, 5, 0.9, 0, 3) == ("transition_forward", None)
    assert act(4, 4, 5, 0.9, 2, 3) == ("bounce", None)
    assert act(0, 0, 5, -0.9, 1, 3) == ("transition_backward", None)
    assert act(0, 9, 5, 0.0, 0, 1) == ("snap", 4)


def test_formatting(spark):
    assert [one(spark, text.price(F.lit(x))) for x in (0.25, 1.2, 15.0)] == ["$0.25", "$1", "$15"]
    assert [one(spark, text.context_length(F.lit(x))) for x in (128_000, 1_000_000, 1_500_000)] == ["128K", "1M", "1.5M"]
    assert one(spark, text.event_label(F.lit(None).cast("string"), F.array(F.lit("A"), F.lit("B")))) == "Interaction: A & B"
    assert one(spark, text.label_of_words(F.array(F.lit("sea"), F.lit("ship")))) == "Sea & Ship"


def brute_chunks(sizes, target, overlap):
    out, current = [], []
    for i, n in enumerate(sizes):
        if current and sum(sizes[j] for j in current) + n > target:
            out.append(list(current))
            back = []
            for j in reversed(current):
                if sum(sizes[x] for x in back) + sizes[j] > overlap:
                    break
                back.insert(0, j)
            current = back
        current.append(i)
    return out + [current] if current else out


def test_chunks_against_a_fold():
    import random

    rng = random.Random(5)
    for _ in range(2000):
        sizes = [rng.choice([1, 5, 30, 80, 300, 900]) for _ in range(rng.randrange(12))]
        got = [list(range(a, b)) for a, b in chunks.cut(sizes)]
        want = brute_chunks(sizes, 800, 80)
        assert got == want, sizes


def test_chunk_table(spark):
    rows = [("b", 1, ["x" * 4000, "y" * 100, "z" * 100]), ("b", 2, []), ("b", 3, None)]
    got = chunks.chunk(spark.createDataFrame(rows, "book_id string, chapter_id long, blocks array<string>")).collect()
    assert [(r.chapter_id, r.ordinal, r.n_blocks, r.start_offset) for r in got] == [(1, 0, 1, 0), (1, 1, 2, 4001)]


def test_block_parse_orders_three_families():
    html = '<h1>T</h1><div>only <b>text</b></div><p>para</p><div><p>in</p></div><img src="a.png"><div><img src="b.png"></div><p> </p>'
    assert [(k, t) for _, _, k, t in blocks.find(html)] == [("heading1", "T"), ("paragraph", "only text"), ("paragraph", "para"), ("paragraph", "in"), ("image", "a.png"), ("image", "b.png")]
    marked = blocks.annotate(html, "s")
    assert marked.count("data-block-id") == 6 and "<h1 data-block-id=" in marked


def test_spans_and_sentence_starts():
    assert entities.spans("Anna saw Victor. Then Mary Shelley spoke to Mr Monday") == [("Victor", 9), ("Then Mary Shelley", 17), ("Mr Monday", 44)]
    assert entities.spans("Alone") == []


def test_variations_are_maximal(spark):
    rows = [("b", 1, 0, t, 0) for t in ("Ann", "Ann Lee", "Lee", "Joanna", "Bob")] + [("c", 1, 0, "Ann", 0)]
    got = {(r.book_id, r.variation): r.canonical for r in entities.variations(spark.createDataFrame(rows, "book_id string, chapter_id long, ordinal int, text string, offset int")).collect()}
    assert got == {("b", "ann"): "ann lee", ("b", "ann lee"): "ann lee", ("b", "lee"): "ann lee", ("b", "joanna"): "joanna", ("b", "bob"): "bob", ("c", "ann"): "ann"}


def test_cooccurrence_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [("b", c, f"e{rng.randrange(4)}", rng.randrange(3000)) for c in (1, 2) for _ in range(40)]
    want = {}
    for c in (1, 2):
        own = [r for r in rows if r[1] == c]
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                if x[2] != y[2] and abs(x[3] - y[3]) <= 500:
                    for p in ((x[2], y[2]), (y[2], x[2])):
                        want[p] = want.get(p, 0) + 1
    got = {(r.e1, r.e2): r.n for r in entities.cooccurrence(spark.createDataFrame(rows, "book_id string, chapter_id long, entity_id string, pos int")).collect()}
    assert got == want


def test_cooccurrence_within_chapters_equals_the_range_join(spark):
    import random

    rng = random.Random(4)
    words = ["ann", "ann lee", "lee", "bob", "sea", "the", "of"]
    chapters = spark.createDataFrame([("b", c, " ".join(rng.choices(words, k=700))) for c in range(3)] + [("b", 3, None), ("b", 4, ""), ("c", 5, "bob bob")], "book_id string, chapter_id long, text string")
    names = spark.createDataFrame([("b", "ann", "ann lee"), ("b", "ann lee", "ann lee"), ("b", "bob", "bob"), ("b", "sea", "sea"), ("c", "bob", "bob")], "book_id string, variation string, canonical string")
    known = spark.createDataFrame([("b", "entity_ann_lee"), ("b", "entity_bob"), ("b", "entity_sea"), ("c", "entity_bob")], "book_id string, entity_id string")
    want = {tuple(r) for r in entities.cooccurrence(entities.occurrences(chapters, names, known)).collect()}
    assert want and {tuple(r) for r in entities.cooccurrence_in(chapters, names, known).collect()} == want
    assert {tuple(r) for r in entities.cooccurrence_in(chapters, names, known, most=2).collect()} == want  # books in several passes


def test_a_book_whose_names_fit_one_pass_is_not_cut_by_the_books_before_it(spark):
    """The names of `a` leave two places of the first pass, `b` has three: its pairs must be of one pass."""
    text = "ann met bob and cid by the sea"
    chapters = spark.createDataFrame([(b, k, text) for k, b in enumerate("abc")], "book_id string, chapter_id long, text string")
    listed = [("a", "ann"), ("a", "bob"), ("b", "ann"), ("b", "bob"), ("b", "cid"), *(("c", w) for w in ("ann", "bob", "cid", "sea"))]
    names = spark.createDataFrame([(b, w, w) for b, w in listed], "book_id string, variation string, canonical string")
    known = spark.createDataFrame([(b, f"entity_{w}") for b, w in listed], "book_id string, entity_id string")
    want = {(b, f"entity_{x}", f"entity_{y}", 1) for b, x in listed for c, y in listed if b == c and x != y}
    for most in (2, 3, 4, 5, 6, 9, 10):
        assert {tuple(r) for r in entities.cooccurrence_in(chapters, names, known, most=most).collect()} == want, most
    for _, held in entities._passes(chapters, names, 4):
        assert sum(map(len, held.values())) <= 4


def test_names_of_a_pass_are_small_in_a_worker():
    """A worker's memory for the names of a pass, as they come from their broadcast."""
    import pickle
    import tracemalloc

    from pyspark.sql import Row

    held = {b: [(f"name {k}", Row(code=k, n_asked=9, n_all=5000)) for k in range(5000)] for b in "ab"}
    sent = pickle.dumps(entities._tables(held), protocol=5)
    tracemalloc.start()
    got = pickle.loads(sent)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 40 * 10_000 and len(sent) < 40 * 10_000
    names, codes, n_asked, n_all = got["b"]
    assert (names[7].as_py(), codes[7], n_asked, n_all) == ("name 7", 7, 9, 5000)


def test_near_counts_in_small_blocks():
    import numpy as np

    rng = np.random.default_rng(2)
    codes, places = rng.integers(0, 5, 300), rng.integers(0, 4000, 300)
    want = np.zeros((5, 5), int)
    for i in range(300):
        for j in range(300):
            if codes[i] != codes[j] and abs(places[i] - places[j]) <= 500:
                want[codes[i], codes[j]] += 1
    for cells in (5, 64, 1 << 22):
        got = np.zeros((len(want), len(want)), int)
        a, b, n = entities.near_counts(codes, places, cells=cells)
        got[a, b] = got[b, a] = n
        assert (got == want).all() and (a < b).all() and (n > 0).all()


def test_clusters_stop_at_the_least_and_by_distance():
    import numpy as np

    same = np.ones((4, 4))
    assert themes.cluster(same, least=2, target=2) == [[2], [3, 0, 1]] or len(themes.cluster(same, least=2, target=2)) == 2
    apart = np.eye(5)
    assert themes.cluster(apart, least=1, target=5) == [[0], [1], [2], [3], [4]]
    assert len(themes.cluster(apart, least=1, target=3)) == 3


def test_clusters_against_a_full_search():
    import numpy as np

    def plain(sim, least, target, distance):
        groups, at = [[i] for i in range(len(sim))], lambda a, b: sum(sim[x][y] for x in a for y in b) / (len(a) * len(b))
        while len(groups) > least:
            pairs = [(round(at(a, b), 9), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
            best, i, j = max(pairs)
            if 1 - best > distance and len(groups) <= target:
                break
            groups = [g for k, g in enumerate(groups) if k not in (-i, -j)] + [groups[-i] + groups[-j]]
        return groups

    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 30, 60):
        for _ in range(6):
            m = np.triu(rng.integers(0, 5, (n, n)) / 4, 1)
            m = m + m.T + np.eye(n)
            assert themes.cluster(m, 3, 8, 0.4) == plain(m, 3, 8, 0.4)


def test_replies(spark):
    rows = {r.id: r for r in parse_summary(spark.sql(FIXTURES["summaries"])).collect()}
    assert rows[1][1:] == ("It begins. It goes on.", ["first", "second"], ["Ann", "Bob", "Cy"])
    assert rows[2][1:] == ("free text", [], [])
    assert rows[3].summary == "a" and rows[3].characters == []
    rows = {r.id: r for r in parse_synopsis(spark.sql(FIXTURES["synopses"])).collect()}
    assert rows[1].synopsis == "All of it. More." and rows[1].themes == ["love"]
    assert [tuple(c) for c in rows[1].characters] == [("Ann", "the heroine: brave")]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccccccc"), (2, None)], "id long, text string")
    assert [(r.piece, r.text) for r in chunks.pack_paragraphs(df, 2).collect()] == [(0, "aaaa\n\nbbbb"), (1, "cccccccc")]


def test_wordpiece():
    v = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "!"])}
    assert wordpiece.encode("Playing! x", v, 8) == ([2, 4, 5, 6, 1, 3, 0, 0], [1, 1, 1, 1, 1, 1, 0, 0])


def test_epub(spark, tmp_path):
    (tmp_path / "a.EPUB").write_bytes(sample_epub())
    (tmp_path / "b.epub").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no book")
    rows = sorted(epub.scan(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.spine_index or 0))
    assert [(r.title, r.spine_item_id, r.ncx_label) for r in rows if not r.error] == [("Sample EPUB", "c1", None), ("Sample EPUB", "c2", "Child")]
    assert "Hello from EPUB" in rows[0].html and sum(r.error is not None for r in rows) == 1
    assert epub.scan(spark, str(tmp_path), content=False, most=1).where("error is null").count() == 1


def test_markup(spark):
    rows = {r.id: r.html for r in spark.sql(FIXTURES["markup"]).select("id", markup.close_empty(F.col("html")).alias("html")).collect()}
    assert rows == {1: '<p>a<i></i>b<br/>c<span class="x"></span>d</p>', 2: "plain", 3: '<div></div><hr/><a id="n"></a>', 4: ""}
    images = F.array(*map(F.lit, ("OPS/img/cover.jpg", "x/fig.svg", "OPS/img/plate.png")))
    got = {r.id: r.html for r in spark.sql(FIXTURES["pictures"]).select("id", markup.image_links(F.col("html"), F.col("base_path"), images).alias("html")).collect()}
    assert got[1] == '<p><img alt="a" src="epub://image/OPS/img/cover.jpg"/>x<img src="none.png"></p>'
    assert got[2] == '<img src="epub://image/fig.svg">' and got[3].startswith('<img src="epub://image/OPS/img/plate.png" width="3"> and')
    assert one(spark, markup.body(F.lit("<html><BODY class='a'> x\n</BODY>"))) == " x\n" and one(spark, markup.body(F.lit("y"))) == "y"
    assert one(spark, markup.resolve(F.lit("a/b"), F.lit("../../../c/./d.png"))) == "c/d.png"
    assert one(spark, markup.body(F.lit(None).cast("string"))) is None and one(spark, markup.close_empty(F.lit(None).cast("string"))) is None


def test_sections_by_place(spark):
    archive = spark.createDataFrame([("a.epub", bytearray(sample_epub())), ("b.epub", bytearray(b"x"))], "path string, content binary")
    assert [[r.spine_item_id for r in epub.section_at(archive, i).collect()] for i in (0, 1, 2, -1)] == [["c1"], ["c2"], [], []]


def test_embeddings_are_unit_vectors(spark):
    import numpy as np
    from foliant.operators import vectors

    seen = spark.createDataFrame([(1, "ab" * 3000), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in vectors.embed(seen, lambda: lambda texts: np.array([[3 * bool(t), 4 * (len(t) == 2048)] for t in texts])).collect()}
    assert got[2] == got[3] == [0.0, 0.0] and [round(x, 6) for x in got[1]] == [0.6, 0.8]


def test_tools(spark):
    import pytest
    from foliant.operators import tools

    with pytest.raises(ValueError, match="Unknown tool: x"):
        tools.call("x")
    blocks_ = spark.createDataFrame([("b", 1, i, t) for i, t in enumerate(("one", "two", "two"))], "book_id string, chapter_id long, ordinal int, text string")
    sections = spark.createDataFrame([("b", 1, "I"), ("b", 2, None)], "book_id string, chapter_id long, label string")
    asked = spark.createDataFrame([("r1", "b", 1, 1), ("r2", "b", 1, 9), ("r3", "b", 1, None), ("r4", "c", 1, 0), ("r5", None, None, None)], "person_id string, book_id string, chapter_id long, ordinal int")
    got = {r.person_id: (r.label, r.block, r.n_blocks, r.percent) for r in tools.call("get_current_position", asked, sections, blocks_).collect()}
    assert got == {"r1": ("I", 2, 3, 67), "r2": ("I", None, 3, None), "r3": ("I", None, 3, None), "r4": (None,) * 4, "r5": (None,) * 4}
    listed = tools.call("get_book_structure", sections, blocks_, asked.limit(1)).collect()
    assert {(r.chapter_id, r.n_blocks, r.current) for r in listed} == {(1, 3, True), (2, 0, False)}


def test_packed_paragraphs_are_handed_on_in_bounded_frames(spark):
    import pandas as pd

    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    caught = []
    texts.select = lambda *c: type("Caught", (), {"mapInPandas": lambda self, run, schema: caught.append(run)})()
    chunks.pack_paragraphs(texts, 200)
    frame = pd.DataFrame({"id": range(30), "text": ["word " * 100_000 + "\n\nend"] * 29 + [None]})
    got = list(caught[0](iter([frame])))
    assert len(got) > 1 and max(f["text"].str.len().sum() for f in got) < 2 * chunks.HELD
    assert [tuple(r) for f in got for r in f[["id", "piece"]].itertuples(index=False)] == [(i, n) for i in range(29) for n in (0, 1)]


def test_archives_are_made_and_handed_on_one_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    rows = [(f"b{b}", f"T{b}", None, f"c{i}", None if i == 2 else i, f"L{i}" if i else None, "x" * 50_000, bytearray(b"png") if i == 1 else None) for b in range(4) for i in (2, 0, 1)]
    made = epub.write_archives(spark.createDataFrame(rows, "path string, title string, author string, spine_item_id string, place int, label string, html string, image binary"))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    got = sorted((r.path, r.spine_index, r.title, r.spine_item_id, r.ncx_label, len(r.html)) for r in epub.read_sections(made).collect())
    assert got == [(f"b{b}", i, f"T{b}", f"c{i}", f"L{i}" if i else None, 50_000) for b in range(4) for i in range(3)]
    assert sorted((r.path, r.file_name, bytes(r.content)) for r in epub.read_resources(made).collect()) == [(f"b{b}", "p1.png", b"png") for b in range(4)]
    monkeypatch.setattr(epub, "HELD", 100_000)
    held = made.toArrow().combine_chunks().to_batches()
    caught = []
    made.select = lambda *c: type("Caught", (), {"mapInArrow": lambda self, run, schema: caught.append(run)})()
    epub.read_sections(made)
    batches = list(caught[0](iter(held)))
    assert sum(b.num_rows for b in batches) == 12 and max(b.num_rows for b in batches) <= 3 and isinstance(batches[0], pa.RecordBatch)


def test_wordpiece_ids_are_handed_on_in_bounded_batches(spark):
    import pyarrow as pa

    v = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "##b"])}
    texts, caught = spark.createDataFrame([(1, "a")], "id long, text string"), []
    texts.select = lambda *c: type("Caught", (), {"mapInArrow": lambda self, run, schema: caught.append(run)})()
    wordpiece.encode_texts(texts, v, 512)
    batch = pa.RecordBatch.from_pydict({"id": list(range(1300)), "text": ["ab a. " * (i % 7) if i % 5 else None for i in range(1300)]})
    got = list(caught[0](iter([batch])))
    assert max(b.num_rows for b in got) * 512 <= wordpiece.HELD and [i for b in got for i in b["id"].to_pylist()] == list(range(1300))
    assert [tuple(r) for b in got for r in zip(b["ids"].to_pylist(), b["mask"].to_pylist())] == [wordpiece.encode(t or "", v, 512) for t in batch["text"].to_pylist()]
    listed = wordpiece.words("one, two")
    assert next(listed) == "one" and list(listed) == [",", "two"]  # no more words than a length has room for are looked for
