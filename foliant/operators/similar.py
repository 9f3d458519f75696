"""Pairs of sparse vectors whose cosine reaches a cut.

Vectors of a book meet in squares of two blocks, a product of two tables each: what is shuffled is vectors, once for every block of their book, never pairs, and a task holds one square.
Equal vectors are one: a text that very many chapters repeat is compared once.

Where cuts are high and terms many, `candidates` tells apart from prefixes which pairs can reach a cut. Each vector's terms stand in one order for its book, rare ones first. Its prefix is as short as
leaves a rest of a length below the cut; two vectors with a cosine of the cut or more have a term in both prefixes (else what they share lies in the rest of the one whose prefix ends first, and such a
product is below the cut). Prefixes are joined on their terms; sums over the prefixes and the lengths of the rests bound a cosine from above. With few terms nearly all pairs have one in both, so the squares don't use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Similarities are rounded to this many decimals before they are cut, so a cosine that is below the cut by less than half a unit reaches it; what rounding may take from a bound comes on top.
DIGITS = 6
SLACK = 0.5 * 10**-DIGITS + 1e-9


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, chapter_id, class_id) of each of vectors (book_id, chapter_id, index, value), and (book_id, class_id, terms) of the different unit vectors among them.

    A class is named by its smallest chapter. Zero values and zero vectors, whose cosine with any other is 0, are left out.
    """
    whole = vectors.where("value <> 0 and index is not null").groupBy("book_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, x: s + x["value"] * x["value"]))
    unit = whole.withColumn("norm", norm).select("book_id", "chapter_id", F.transform("t", lambda x: F.struct(x["index"].alias("index"), F.round(x["value"] / F.col("norm"), 12).alias("x"))).alias("terms"))
    unit = written(unit.withColumn("hash", F.sha2(F.to_json("terms"), 256)), "unit-vectors")
    named = unit.groupBy("book_id", "hash").agg(F.min("chapter_id").alias("class_id"))
    member = written(unit.select("book_id", "chapter_id", "hash").join(named, ["book_id", "hash"]).drop("hash"), "members")
    return member, unit.join(named.select("book_id", F.col("class_id").alias("chapter_id")), ["book_id", "chapter_id"]).select("book_id", F.col("chapter_id").alias("class_id"), "terms")


def prefixes(distinct: DataFrame, cut: float) -> DataFrame:
    """(book_id, index, class_id, x, rest): the terms of each vector's prefix, and the length of what is not in it."""
    each = distinct.select("book_id", "class_id", F.explode("terms").alias("t")).select("book_id", "class_id", "t.*")
    common = each.groupBy("book_id", "index").agg(F.count("*").alias("df"))
    placed = each.join(common, ["book_id", "index"]).groupBy("book_id", "class_id").agg(F.array_sort(F.collect_list(F.struct("df", "index", "x"))).alias("t"))
    # the square of what remains from each term on; the prefix is the terms before which it is not yet below that of the cut
    steps = F.expr("aggregate(reverse(t), cast(array() as array<double>), (s, e) -> concat(array(coalesce(get(s, 0), 0D) + e.x * e.x), s))")
    held = placed.withColumn("left", steps).withColumn("n", F.size(F.filter("left", lambda r: r >= max(cut - SLACK, 0.0) ** 2)))
    rest = F.sqrt(F.coalesce(F.try_element_at("left", F.col("n") + 1), F.lit(0.0)))
    return held.where("n > 0").select("book_id", "class_id", rest.alias("rest"), F.explode(F.slice("t", 1, F.col("n"))).alias("e")).select("book_id", "class_id", "rest", "e.index", "e.x")


def candidates(distinct: DataFrame, cut: float) -> DataFrame:
    """(book_id, a, b): pairs a < b of different vectors (class_id) whose bound reaches the cut."""
    p = written(prefixes(distinct, cut), "prefixes")
    left = p.select("book_id", "index", F.col("class_id").alias("a"), F.col("x").alias("xa"), F.col("rest").alias("ra"))
    right = p.select("book_id", "index", F.col("class_id").alias("b"), F.col("x").alias("xb"), F.col("rest").alias("rb"))
    met = left.join(right, ["book_id", "index"]).where("a < b").groupBy("book_id", "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("head"), F.first("ra").alias("ra"), F.first("rb").alias("rb"))
    return met.where(F.col("head") + F.greatest("ra", "rb") >= cut - SLACK).select("book_id", "a", "b")


#: Vectors of a block, numbers of a table over a block's terms, and products that are looked at at once.
BLOCK, CELLS, STRIP = 8192, 1 << 22, 1 << 21


def similar_pairs(vectors: DataFrame, cut: float) -> tuple[DataFrame, DataFrame]:
    """(book_id, a, b, similarity) of classes a < b of equal vectors with a cosine of `cut` or more, to six decimals, and (book_id, chapter_id, class_id): the classes' members.

    vectors: (book_id, chapter_id, index, value) with values of 0 and more, cut over 0. Members of one class have a cosine of 1. Chapters without a value are in no class.
    """
    member, distinct = classes(vectors)
    return sized_pairs(member, distinct, cut).select("book_id", "a", "b", "similarity"), member


def sized_pairs(member: DataFrame, distinct: DataFrame, cut: float, block: int = BLOCK) -> DataFrame:
    """(book_id, a, b, similarity, n_a, n_b) of `classes`: the pairs of `similar_pairs`, with the number of chapters in either class."""
    if cut <= 0:
        raise ValueError("pairs below any cut are all pairs")
    sizes = member.groupBy("book_id", "class_id").agg(F.count("*").alias("n"))
    listed = distinct.join(sizes, ["book_id", "class_id"]).select("book_id", "class_id", "n", F.col("terms.index").alias("index"), F.col("terms.x").alias("x"))
    listed = written(listed, "distinct-vectors")
    sides = listed.groupBy("book_id").agg(F.ceil(F.count("*") / block).cast("int").alias("sides"))
    squares = F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda q: F.struct(F.least("p", q).alias("lo"), F.greatest("p", q).alias("hi"))))
    dealt = listed.join(sides, "book_id").withColumn("p", F.pmod(F.xxhash64("class_id"), F.col("sides")).cast("int")).withColumn("q", squares)
    dealt = dealt.select("book_id", "q.lo", "q.hi", "p", "class_id", "n", "index", "x").repartition("book_id", "lo", "hi").sortWithinPartitions("book_id", "lo", "hi", "class_id")
    names = ["book_id", "a", "b", "similarity", "n_a", "n_b"]

    def square(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks().to_batches()[0]
        lo, hi, p, n = (batch[c].to_numpy() for c in ("lo", "hi", "p", "n"))
        ids = batch["class_id"].to_numpy(zero_copy_only=False)
        first = np.flatnonzero(p == lo[0])
        second = first if lo[0] == hi[0] else np.flatnonzero(p == hi[0])
        if not len(first) or not len(second):
            return
        columns = np.unique(batch["index"].flatten().to_numpy())
        width, step = max(1, CELLS // batch.num_rows), max(1, STRIP // len(second))
        terms = [columns[k : k + width] for k in range(0, len(columns), width)]
        whole = _table(batch, columns) if len(terms) == 1 else None
        for k in range(0, len(first), step):
            rows = first[k : k + step]
            if whole is not None:
                s = whole[rows] @ whole[second].T
            else:
                s = np.zeros((len(rows), len(second)))
                for some in terms:
                    t = _table(batch, some)
                    s += t[rows] @ t[second].T
            i, j = np.nonzero(s >= cut - SLACK)
            value = np.round(s[i, j], DIGITS)
            fit = (value >= cut) & (j > i + k if second is first else True)
            i, j, value = rows[i[fit]], second[j[fit]], value[fit]
            if len(i):
                swap = ids[i] > ids[j]
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                yield pa.RecordBatch.from_arrays([batch["book_id"].take(pa.array(a)), batch["class_id"].take(pa.array(a)), batch["class_id"].take(pa.array(b)), pa.array(value), pa.array(n[a]), pa.array(n[b])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            book = held["book_id"].combine_chunks().dictionary_encode().indices.to_numpy()
            new = (np.diff(book) != 0) | (np.diff(held["lo"].to_numpy()) != 0) | (np.diff(held["hi"].to_numpy()) != 0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield from square(held.slice(a, b - a))
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from square(held)

    kind = dict(listed.dtypes)
    ddl = f"book_id {kind['book_id']}, a {kind['class_id']}, b {kind['class_id']}, similarity double, n_a long, n_b long"
    return dealt.mapInArrow(run, ddl)


def _table(batch: pa.RecordBatch, columns: np.ndarray) -> np.ndarray:
    """Rows of sparse vectors over the given columns, ascending; other terms are left out."""
    lengths = np.diff(batch["index"].offsets.to_numpy())
    index, line = batch["index"].flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
    at = np.minimum(np.searchsorted(columns, index), len(columns) - 1)
    known = columns[at] == index
    out = np.zeros((len(lengths), len(columns)))
    out[line[known], at[known]] = batch["x"].flatten().to_numpy()[known]
    return out


def all_pairs_bound(distinct: DataFrame) -> DataFrame:
    """(book_id, n): how many pairs of different vectors a book has, to compare with the candidates."""
    return distinct.groupBy("book_id").agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("n"))
