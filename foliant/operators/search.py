"""Lexical lookup, neighbourhoods, structure and text of a book's blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import written

DISPLAY = 10


def lexical(blocks: DataFrame, query: str | Column, scope: Column | None = None) -> DataFrame:
    """Blocks that contain a query in either case, with the place of its first occurrence (from 0). An empty query finds nothing."""
    q = F.lower(F.lit(query) if isinstance(query, str) else query)
    found = blocks if scope is None else blocks.where(scope)
    return found.where((F.length(q) > 0) & F.contains(F.lower("text"), q)).withColumn("match_pos", F.instr(F.lower("text"), q) - 1 if isinstance(query, str) else F.position(q, F.lower("text")) - 1)


#: Characters of queries that one automaton holds; more queries are more passes over the blocks.
QUERY_CHARS = 4_000_000


def lexical_many(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, book_id, chapter_id, ordinal, match_pos) for a stated set of queries (query_id, query).

    Queries may have a book_id, and with it a chapter_id, that they are limited to, where these are not null. One automaton finds
    all queries of a block in one pass over its lower-cased text. Null and empty queries find nothing, and so do null texts.
    """
    limits = [c for c in ("book_id", "chapter_id") if c in queries.columns]
    kind = {c: blocks.schema[c].dataType.simpleString() for c in ("book_id", "chapter_id", "ordinal")} | {"query_id": queries.schema["query_id"].dataType.simpleString()}
    asked = queries.where(F.length("query") > 0).select("query_id", F.lower("query").alias("q"), *limits)
    lower = blocks.select("book_id", "chapter_id", "ordinal", F.lower("text").alias("t"))
    out, held, size = None, [], 0
    for row in [*asked.toLocalIterator(), None]:
        if row is not None:
            held.append(tuple(row))
            size += len(row[1]) + 50
        if held and (row is None or size >= QUERY_CHARS):
            part = _found(lower, held, limits, kind)
            out, held, size = part if out is None else out.unionByName(part), [], 0
    return blocks.sparkSession.createDataFrame([], f"query_id {kind['query_id']}, book_id {kind['book_id']}, chapter_id {kind['chapter_id']}, ordinal {kind['ordinal']}, match_pos int") if out is None else out


def _found(blocks: DataFrame, queries: list[tuple], limits: list[str], kind: dict[str, str]) -> DataFrame:
    """The hits of one automaton's queries (id, text, and what they are limited to)."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)
    names = ["query_id", "book_id", "chapter_id", "ordinal", "match_pos"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        by: dict[str, list[tuple]] = {}
        for i, q, *limit in shared.value:
            by.setdefault(q, []).append((i, *limit))
        for q, wanted in by.items():
            machine.add_word(q, (q, wanted))
        machine.make_automaton()
        for frame in frames:
            rows = []
            for book, chapter, ordinal, text in frame.itertuples(index=False, name=None):
                first: dict[str, tuple[int, list]] = {}
                for end, (q, wanted) in machine.iter(text or ""):
                    first.setdefault(q, (end - len(q) + 1, wanted))
                rows += [(i, book, chapter, ordinal, at) for at, wanted in first.values() for i, *limit in wanted if all(x is None or x == y for x, y in zip(limit, (book, chapter), strict=False))]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return blocks.mapInPandas(run, ", ".join(f"{c} {kind.get(c, 'int')}" for c in names))


#: Places that a task holds before it hands them on.
HELD = 200_000


def shown_of(blocks: DataFrame, queries: DataFrame, most: int = DISPLAY) -> DataFrame:
    """(query_id, book_id, chapter_id, ordinal, rank, total, more): what `display` gives for the hits of `lexical_many`.

    Queries of one text and one place are looked for once, and each task hands on the first hits of a query and how many there are, not all of them.
    """
    limits = [c for c in ("book_id", "chapter_id") if c in queries.columns]
    kind = {c: blocks.schema[c].dataType.simpleString() for c in ("book_id", "chapter_id", "ordinal")}
    asked = written(queries.where(F.length("query") > 0).select("query_id", F.lower("query").alias("q"), *limits), "asked")
    groups = written(asked.select("q", *limits).distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
    lower = blocks.select("book_id", "chapter_id", "ordinal", F.lower("text").alias("t"))
    ddl = ", ".join(["group long", *(f"{c} {k}" for c, k in kind.items()), "n long"])
    part, held, size = None, [], 0
    for row in [*groups.select("group", "q", *limits).toLocalIterator(), None]:
        if row is not None:
            held.append((*row, *[None] * (2 - len(limits))) if limits != ["chapter_id"] else (row[0], row[1], None, row[2]))
            size += len(row[1]) + 50
        if held and (row is None or size >= QUERY_CHARS):
            found = _first_hits(lower, held, most, ddl)
            part, held, size = found if part is None else part.unionByName(found), [], 0
    if part is None:
        part = blocks.sparkSession.createDataFrame([], ddl)
    part = written(part, "first-hits")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("book_id", "chapter_id", "ordinal"))
    first = part.withColumn("rank", rank).where(F.col("rank") <= most).drop("n").join(part.groupBy("group").agg(F.sum("n").alias("total")), "group")
    alike = asked.alias("a").join(groups.alias("g"), (F.col("a.q") == F.col("g.q")) & _same(limits)).select("a.query_id", "g.group")
    return alike.join(first, "group").select("query_id", "book_id", "chapter_id", "ordinal", "rank", "total", F.greatest(F.col("total") - most, F.lit(0)).alias("more"))


def _same(columns: list[str]) -> Column:
    """Whether columns of a and g are equal, or both null."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}"))
    return same


def _first_hits(blocks: DataFrame, groups: list[tuple], most: int, ddl: str) -> DataFrame:
    """(group, book_id, chapter_id, ordinal, n) of groups (group, text, book or none, chapter or none): a task's first hits of each, n of one of them being how many it stands for."""
    shared, names = blocks.sparkSession.sparkContext.broadcast(groups), [c.split()[0] for c in ddl.split(", ")]
    order = lambda place: [(x is not None and x == x, x if x is not None and x == x else 0) for x in place]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine, at, wanted = ahocorasick.Automaton(), {}, {}
        for group, q, book, chapter in shared.value:
            if q not in at:
                machine.add_word(q, at.setdefault(q, len(at)))
            wanted.setdefault((book, chapter), {}).setdefault(at[q], []).append(group)
        machine.make_automaton()
        found: dict[int, list] = {}  # of a group how many hits, and places among which the first are
        size = 0

        def told() -> Iterator[pd.DataFrame]:
            rows = [(g, *place, n if k == 0 else 0) for g, (n, places) in found.items() for k, place in enumerate(sorted(places, key=order)[:most])]
            found.clear()
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)

        for frame in frames:
            last, here = None, []
            for book, chapter, ordinal, text in frame.itertuples(index=False, name=None):
                if (book, chapter) != last:
                    last = (book, chapter)
                    here = [wanted[p] for p in {(book, chapter), (book, None), (None, chapter), (None, None)} if p in wanted]
                if not here or not text:
                    continue
                for k in {k for _, k in machine.iter(text)}:
                    for groups in here:
                        for g in groups.get(k, ()):
                            held = found.setdefault(g, [0, []])
                            held[0] += 1
                            held[1].append((book, chapter, ordinal))
                            size += 1
                            if len(held[1]) > 8 * most + 8:
                                size -= len(held[1]) - most
                                held[1] = sorted(held[1], key=order)[:most]
            if size > HELD:
                yield from told()
                size = 0
        yield from told()

    return blocks.mapInPandas(run, ddl)


def display(hits: DataFrame, most: int = DISPLAY) -> DataFrame:
    """The first hits of each query in book order, and how many more blocks hit."""
    w = Window.partitionBy("query_id")
    ranked = hits.withColumn("rank", F.row_number().over(w.orderBy("book_id", "chapter_id", "ordinal"))).where(F.col("rank") <= most)
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    return ranked.join(totals, "query_id").withColumn("more", F.greatest(F.col("total") - most, F.lit(0)))


def offsets(blocks: DataFrame) -> DataFrame:
    """Each block's start in its chapter's text, one separator between blocks."""
    w = Window.partitionBy("book_id", "chapter_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("start_offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def surrounding(blocks: DataFrame, centres: DataFrame, radius: int = 5) -> DataFrame:
    """Blocks within `radius` of each centre (book_id, chapter_id, centre), within its chapter."""
    near = centres.select("book_id", "chapter_id", "centre", F.explode(F.sequence(F.col("centre") - radius, F.col("centre") + radius)).alias("ordinal"))
    return near.join(blocks, ["book_id", "chapter_id", "ordinal"])


def structure(blocks: DataFrame) -> DataFrame:
    """(book_id, chapter_id, n_blocks, n_chars)"""
    return blocks.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


def full_text(blocks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """A chapter's blocks in order, joined."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return blocks.groupBy("book_id", "chapter_id").agg(F.array_join(F.transform(listed, lambda b: b["text"]), separator).alias("text"))


def section_label(sections: DataFrame) -> DataFrame:
    """label: the navigation's, else the title, else Untitled."""
    return sections.withColumn("label", F.coalesce("ncx_label", "title", F.lit("Untitled")))


def chapter_ids(requests: DataFrame, sections: DataFrame) -> DataFrame:
    """requests (book_id, chapter_id, current_id) with resolved: `current` or an exact section id (book_id, spine_item_id) of its book, null for anything else."""
    known = sections.select(F.col("book_id").alias("__book"), F.col("spine_item_id").alias("__known")).distinct()
    joined = requests.join(known, (requests.book_id == F.col("__book")) & (requests.chapter_id == F.col("__known")), "left")
    return joined.select(*requests.columns, F.when(F.col("chapter_id") == "current", F.col("current_id")).otherwise(F.col("__known")).alias("resolved"))


def suffixes(c: Column, lengths: Column | None = None) -> Column:
    """All ends of a string, or those of some lengths (an array), the empty one last: what it ends with is then an equality, and a join needs no broadcast."""
    if lengths is None:
        return F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(c, i, F.length(c)))
    return F.transform(F.filter(lengths, lambda n: n <= F.length(c)), lambda n: F.substring(c, F.length(c) - n + 1, n))


def _lengths(values: DataFrame, c: str) -> Column:
    """The lengths that a column's strings have, longest first, as an array: no more numbers than the longest string has characters."""
    there = sorted((r[0] for r in values.select(F.length(c)).distinct().collect() if r[0] is not None), reverse=True)
    return F.array(*map(F.lit, there)).cast("array<int>")


def ends_alike(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(book_id, a, b and right's other columns): pairs of values of a book of which one ends with the other, for tables that are at hand (written) with each value of a book once.

    Only ends as long as some value on the other side are made.
    """
    ends = lambda df, c, other, to, least: df.select("*", F.explode(suffixes(F.col(c), F.filter(_lengths(other, to), lambda n: n + least <= F.length(c)))).alias(to))
    left, names = left.select("book_id", a), ["book_id", a, b, *[c for c in right.columns if c not in ("book_id", b)]]
    longer_a = ends(left, a, right, b, 0).join(right, ["book_id", b]).select(names)
    longer_b = ends(right, b, left, a, 1).join(left, ["book_id", a]).select(names)
    return longer_a.union(longer_b)


def attach_labels(sections: DataFrame, points: DataFrame) -> DataFrame:
    """sections (book_id, spine_item_id, href) with the label of their book's last navigation point (book_id, ord, label, src) whose target ends with the section's href or the reverse."""
    targets = points.select("book_id", "ord", "label", F.regexp_replace("src", "#.*$", "").alias("__src"))
    last = written(targets.groupBy("book_id", "__src").agg(F.max_by("label", "ord").alias("label"), F.max("ord").alias("ord")), "targets")
    own = written(sections.select("book_id", "spine_item_id", "href").distinct(), "sections")
    hrefs = written(own.select("book_id", "href").distinct(), "hrefs")
    labels = ends_alike(hrefs, "href", last, "__src").groupBy("book_id", "href").agg(F.max_by("label", "ord").alias("ncx_label"))
    return own.join(labels, ["book_id", "href"], "left").select("book_id", "spine_item_id", "href", "ncx_label")


def resources(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The file (book_id, path) of each request (book_id, request) in its book: exact path, else file name, else suffix; with its rank of fit."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    asked, known = written(requests.select("book_id", "request").distinct(), "requests"), written(files.select("book_id", "path").distinct(), "files")
    by_name = asked.withColumn("__name", name("request")).join(known.withColumn("__name", name("path")), ["book_id", "__name"])
    by_name = by_name.select("book_id", "request", "path", F.when(F.col("path") == F.col("request"), 1).otherwise(2).alias("fit"))
    fits = by_name.union(ends_alike(asked, "request", known, "path").select("book_id", "request", "path", F.lit(3)))
    best = fits.groupBy("book_id", "request").agg(F.min(F.struct("fit", "path")).alias("b"))
    return asked.join(best, ["book_id", "request"], "left").select("book_id", "request", F.col("b.path").alias("path"), F.col("b.fit").alias("fit"))


def links(anchors: DataFrame, sections: DataFrame) -> DataFrame:
    """kind (internal, external, anchor or unknown), spine item and fragment of each link (book_id, link), one row a link.

    A link finds an item (book_id, spine_item_id, href) of its book by file name; of items with one file name, the one whose whole path it states, else the smallest.
    """
    path, fragment = F.regexp_extract("link", "^([^#]*)", 1), F.nullif(F.regexp_extract("link", "#(.*)$", 1), F.lit(""))
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    items = sections.groupBy("book_id", F.regexp_extract("href", r"([^/]*)$", 1).alias("__file")).agg(F.min("spine_item_id").alias("__by_file")).where("__file <> ''")
    exact = sections.groupBy("book_id", F.col("href").alias("__path")).agg(F.min("spine_item_id").alias("__by_path"))
    parts = anchors.select("book_id", "link", path.alias("__path"), file.alias("__file"), fragment.alias("fragment"))
    joined = parts.join(items, ["book_id", "__file"], "left").join(exact, ["book_id", "__path"], "left").withColumn("__item", F.coalesce("__by_path", "__by_file"))
    external = F.col("link").rlike("^https?://")
    kind = F.when(external, "external").when(F.col("__path") == "", "anchor").when(F.col("__item").isNotNull(), "internal").otherwise("unknown")
    return joined.select("book_id", "link", kind.alias("kind"), F.when(~external & (F.col("__path") != ""), F.col("__item")).alias("spine_item_id"), "fragment")


def linked_styles(sections: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, spine_item_id, css): the style sheets that a section (book_id, spine_item_id, html, base_path) links, in order, each with a line end; null if none.

    A link finds the file (book_id, path, css) of its book by its path below base_path, else by the path as it stands, else by its file name; of files with one
    name, the one with the smallest path, then the smallest content.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    link = r"""(?i)<link[^>]+href\s*=\s*["']([^"']+\.css)["'][^>]*>"""
    hrefs = sections.select("book_id", "spine_item_id", "base_path", F.posexplode(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("at", "href"))
    keys = files.select("book_id", F.explode(F.array(F.struct(F.lit(1).alias("by"), F.col("path").alias("key")), F.struct(F.lit(2).alias("by"), name(F.col("path")).alias("key")))).alias("k"), "path", "css")
    known = keys.groupBy("book_id", F.col("k.key").alias("key")).agg(F.min_by("css", F.struct("k.by", "path", "css")).alias("css"))
    full = F.when(F.col("base_path") == "", F.col("href")).otherwise(F.concat_ws("/", "base_path", "href"))
    tried = hrefs.select("book_id", "spine_item_id", "at", F.posexplode(F.array(full, F.col("href"), name(F.col("href")))).alias("try", "key"))
    found = tried.join(known, ["book_id", "key"]).groupBy("book_id", "spine_item_id", "at").agg(F.min_by("css", "try").alias("css"))
    joined = found.groupBy("book_id", "spine_item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "css"))), lambda x: F.concat(x["css"], F.lit("\n"))), "").alias("css"))
    return sections.select("book_id", "spine_item_id").join(joined, ["book_id", "spine_item_id"], "left")
