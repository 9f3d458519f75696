"""Dense vectors: normalising, centroids, similarity and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
BLOCK = 2048  # queries searched in one pass
ROWS = 512  # rows that a block is compared with at once, whatever the size of an Arrow batch
PASSES = 16  # passes in one plan; what more passes have found is written first


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty or zero vectors; six decimals."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), F.round(dot(a, b) / n, 6)).otherwise(F.lit(0.0))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """The unit-length mean of each group's vectors (embedding)."""
    return centroids_by(vectors, [group])


#: Groups whose sums a task holds; beyond that they are handed on and begun anew.
GROUPS = 10_000


def centroids_by(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys and centroid, as centroids() of several columns.

    Each task adds up whole vectors, so what is shuffled is a vector a group and task. Null components don't count, and vectors may differ in length.
    """
    from pyspark.sql.types import StructType

    sums = StructType.fromDDL("total array<double>, n array<long>")
    target = StructType([*vectors.select(*keys).schema, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(target), {}

        def told() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], schema[i].type) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([v[i] for v in held.values()], schema[len(keys) + i].type) for i in (0, 1))], schema=schema)

        for batch in batches:
            codes, places = {}, np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(zip(*(batch[k].to_pylist() for k in keys), strict=True)):
                places[i] = codes.setdefault(key, len(codes))
            lengths = np.diff(batch["embedding"].offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            flat = batch["embedding"].flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            width = int(lengths.max(initial=0))
            cell = places[row] * width + at
            total, n = np.bincount(cell, value, len(codes) * width).reshape(len(codes), width), np.bincount(cell, there, len(codes) * width).astype(np.int64).reshape(len(codes), width)
            longest = np.zeros(len(codes), np.int64)
            np.maximum.at(longest, places, lengths)
            for key, i in codes.items():
                own = total[i, : longest[i]], n[i, : longest[i]]
                if key in held:
                    wide = max(longest[i], len(held[key][0]))
                    own = tuple(np.pad(x, (0, wide - len(x))) + np.pad(y, (0, wide - len(y))) for x, y in zip(held[key], own, strict=True))
                held[key] = own
            if len(held) > GROUPS:
                yield told()
                held.clear()
        if held:
            yield told()

    parts = vectors.where("embedding is not null").select(*keys, "embedding").mapInArrow(run, target)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("total", "n")).alias("i", "s"))
    mean = each.groupBy(*keys, "i").agg(F.try_divide(F.sum("s.total"), F.sum("s.n")).alias("m"))
    listed = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return listed.select(*keys, normalised(F.col("centroid")).alias("centroid"))


#: Chapters that are asked for in one block, and their book's other chapters that are compared with it at once.
ASKED, OTHERS = 1024, 512


def sparse_cosine(vectors: DataFrame, asked: DataFrame, block: int = ASKED) -> DataFrame:
    """(book_id, a, b, similarity): cosines of sparse vectors (book_id, chapter_id, index, value), chapters a that are asked for (book_id, chapter_id) against all others of their book.

    Keys that one of a pair lacks count as zero, so pairs without a common key are left out: their cosine is 0. A chapter is one row; a block of chapters that are asked for
    meets parts of its book's chapters, a product of two tables each, so what is shuffled is chapters, not pairs.
    """
    from pyspark.sql.types import StructType

    from ..plans.scratch import written

    # equal keys of a chapter are added to each other, as a pair's sum over its equal keys does
    keys = vectors.where("book_id is not null and chapter_id is not null").groupBy("book_id", "chapter_id", "index").agg(F.sum(F.col("value").cast("double")).alias("value"), F.sum(F.col("value") * F.col("value")).cast("double").alias("square"))
    terms = F.array_sort(F.collect_list(F.when(F.col("index").isNotNull(), F.struct("index", F.coalesce("value", F.lit(0.0)).alias("value")))))
    listed = keys.groupBy("book_id", "chapter_id").agg(F.transform(terms, lambda t: t["index"].cast("long")).alias("index"), F.transform(terms, lambda t: t["value"]).alias("value"), F.sqrt(F.sum("square")).alias("norm"))
    listed = written(listed, "chapters")
    a = listed.join(asked.select("book_id", "chapter_id").distinct(), ["book_id", "chapter_id"], "left_semi")
    sides = a.groupBy("book_id").agg(F.ceil(F.count("*") / block).cast("int").alias("sides"))
    row = ["book_id", "chapter_id", "index", "value", "norm"]
    # a block of those asked for meets each of as many parts as its book has OTHERS x 16 chapters
    parts = listed.groupBy("book_id").agg(F.ceil(F.count("*") / (16 * OTHERS)).cast("int").alias("parts")).join(sides, "book_id")
    every, of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)), lambda n: F.pmod(F.xxhash64("chapter_id"), F.col(n)).cast("int")
    left = a.join(parts, "book_id").select(*row, F.lit(0).alias("side"), of("sides").alias("p"), every("parts").alias("q"))
    right = listed.join(parts, "book_id").select(*row, F.lit(1).alias("side"), every("sides").alias("p"), of("parts").alias("q"))
    dealt = left.unionByName(right).repartition("book_id", "p", "q").sortWithinPartitions("book_id", "p", "q", "side", "chapter_id")
    kind = vectors.schema["chapter_id"].dataType.simpleString()
    target = StructType.fromDDL(f"book_id {vectors.schema['book_id'].dataType.simpleString()}, a {kind}, b {kind}, similarity double")

    def dense(batch: pa.RecordBatch, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values over the given columns, and where there are any; others are left out."""
        lengths = np.diff(batch["index"].offsets.to_numpy())
        index, line = batch["index"].flatten().to_numpy(), np.repeat(np.arange(len(lengths)), lengths)
        at = np.minimum(np.searchsorted(columns, index), len(columns) - 1)
        known = columns[at] == index
        value, there = np.zeros((len(lengths), len(columns))), np.zeros((len(lengths), len(columns)), np.float32)
        value[line[known], at[known]] = batch["value"].flatten().to_numpy(zero_copy_only=False)[known]
        there[line[known], at[known]] = 1
        return value, there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, held = None, [], None
        for batch in batches:
            codes = batch["book_id"].dictionary_encode()
            places = np.stack([codes.indices.to_numpy(), batch["p"].to_numpy(), batch["q"].to_numpy(), batch["side"].to_numpy()], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(places, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                piece, key = batch.slice(begin, end - begin), (batch["book_id"][begin].as_py(), *places[begin, 1:3].tolist())
                if key != now:
                    now, block, held = key, [], None
                if places[begin, 3] == 0:
                    block.append(piece)
                    continue
                if not block:
                    continue
                if held is None:
                    first = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
                    columns = np.unique(first["index"].flatten().to_numpy())
                    held = first["chapter_id"].to_numpy(zero_copy_only=False), first["norm"].to_numpy(zero_copy_only=False), columns, *dense(first, columns)
                ids, norms, columns, x, has = held
                for k in range(0, piece.num_rows, OTHERS):
                    other = piece.slice(k, OTHERS)
                    y, seen = dense(other, columns)
                    chapter = other["chapter_id"].to_numpy(zero_copy_only=False)
                    i, j = np.nonzero((has @ seen.T > 0) & (ids[:, None] != chapter))
                    n = norms[i] * other["norm"].to_numpy(zero_copy_only=False)[j]
                    cosine = np.divide((x @ y.T)[i, j], n, out=np.zeros(len(n)), where=n > 0)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch["book_id"][begin], len(i)), pa.array(ids[i]), pa.array(chapter[j]), pa.array(cosine)], names=target.names)

    return dealt.mapInArrow(run, target).select("book_id", "a", "b", F.round("similarity", 6).alias("similarity"))


def check(chunks: int, vectors: DataFrame) -> None:
    """An index needs as many vectors as chunks, all of one length."""
    n, low, high = vectors.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n != chunks:
        raise ValueError(f"{chunks} chunks, but {n} vectors")
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions")


def shape(vectors: DataFrame) -> DataFrame:
    """(n, least, most, valid): how many vectors there are and their dimensions; valid if there are any and all have one length."""
    made = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    return made.withColumn("valid", F.coalesce(F.col("least") == F.col("most"), F.lit(False)))


def embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], limit: int = 2048) -> DataFrame:
    """(id, embedding) of texts (id, text): unit vectors that a model gives for the first `limit` characters of each text.

    load() makes the model once a task: a function from a list of texts to a matrix. A null text counts as empty; a zero vector stays; no rows, no vectors.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            if batch.num_rows:
                m = np.asarray(model([t or "" for t in batch["text"].to_pylist()]), np.float64)
                n = np.sqrt((m * m).sum(axis=1, keepdims=True))
                unit = np.divide(m, n, out=np.zeros_like(m), where=n > 0).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(unit), pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", F.substring("text", 1, limit).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def nearest(index: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", scope: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best of index (key, embedding) for each of queries (query_id, embedding), exactly.

    scope names a column of both; a query then sees only rows with its value, or with one of its values where the queries' column is a list (filtered before
    the cut); a null sees all. Queries are
    a stated set, searched in blocks of BLOCK: each is broadcast, each task keeps the k best of its rows with one matrix product a
    batch, and only those are shuffled. Ties go to the smaller key.
    """
    kind = index.schema[key].dataType.simpleString()
    columns = ["query_id", "embedding", *([scope] if scope else [])]
    out, block, passes = None, [], 0
    rows = queries.select(*columns).toLocalIterator()
    while True:
        row = next(rows, None)
        if row is not None:
            block.append(tuple(row))
        if block and (row is None or len(block) == BLOCK):
            part = _block(index, block, k, key, kind, scope, queries.schema["query_id"].dataType.simpleString())
            out, block, passes = part if out is None else out.unionByName(part), [], passes + 1
            if passes % PASSES == 0:
                from ..plans.scratch import written

                out = written(out, "nearest")
        if row is None:
            break
    if out is None:
        return index.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kind}, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(index: DataFrame, block: list[tuple], k: int, key: str, kind: str, scope: str | None, id_kind: str) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(block)

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        ids = [r[0] for r in rows]
        q = unit(np.array([r[1] for r in rows], np.float64))
        scopes = [None if r[2] is None else set(r[2]) if isinstance(r[2], list) else {r[2]} for r in rows] if scope else []
        best: list[np.ndarray] | None = None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            keys = batch[key].to_numpy(zero_copy_only=False)
            v = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            score = np.round(q @ unit(v).T, 6)
            if scope:
                values, code = np.unique(np.array([repr(x) for x in batch[scope].to_pylist()]), return_inverse=True)
                seen = np.array([[True] * len(values) if s is None else [v in s for v in values] for s in ({*map(repr, x)} if x is not None else None for x in scopes)])
                score[~seen[:, code]] = -np.inf
            all_keys = np.broadcast_to(keys, score.shape)
            if best is not None and best[0].shape[1] == k:
                # a row that no query has a place for is left out
                use = ~(score < best[0][:, -1:]).all(axis=0)
                score, all_keys = score[:, use], all_keys[:, use]
            if best is not None:
                score, all_keys = np.concatenate([best[0], score], axis=1), np.concatenate([best[1], all_keys], axis=1)
            order = np.stack([np.lexsort((b, -a))[:k] for a, b in zip(score, all_keys, strict=True)])
            best = [np.take_along_axis(score, order, 1), np.take_along_axis(all_keys, order, 1)]
        if best is not None:
            at, hit = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at]), pa.array(best[1][at, hit]), pa.array(best[0][at, hit])], names=["query_id", key, "score"])

    # embeddings of a table have one length; nulls cannot be compared
    rows = index.where("embedding is not null").select(key, "embedding", *([scope] if scope else []))
    return rows.mapInArrow(run, f"query_id {id_kind}, {key} {kind}, score double")


def pairwise(vectors: DataFrame, key: str, value: str, cells: int = 16) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of a set, such as a book's centroids: the result is as large as its square.

    Rows fall in `cells` parts; two parts meet at one key, so no side is broadcast and no task has more than two parts.
    """
    part = F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")
    own = vectors.select(F.col(key).alias("k"), F.col(value).alias("v"), part.alias("p"))
    met = own.select("k", "v", "p", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("q"))
    met = met.select("k", "v", "p", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    x, y = met.select(*[F.col(c).alias(f"x{c}") for c in ("k", "v", "p")], "lo", "hi"), met.select(*[F.col(c).alias(f"y{c}") for c in ("k", "v", "p")], "lo", "hi")
    apart = ((F.col("lo") == F.col("hi")) | (F.col("xp") != F.col("yp"))) & (F.col("xk") < F.col("yk"))
    return x.join(y, ["lo", "hi"]).where(apart).select(F.col("xk").alias("a"), F.col("yk").alias("b"), cosine(F.col("xv"), F.col("yv")).alias("similarity"))
