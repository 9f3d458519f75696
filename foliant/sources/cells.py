"""An index of vectors in cells: approximate nearest neighbours from a few cells, or exact ones from those that a bound leaves.

Unit vectors are dealt to the nearest of `cells` centres, which are fitted on a bounded sample; every row is indexed. The table is partitioned by cell and,
within a cell, in order of the distance to its centre (radius), so a search reads the cells that its queries probe and no others. How many cells a query
probes is chosen when the index is made: as many as gave the wanted recall against brute force on the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vectors import BLOCK, ROWS, K
from ..plans.scratch import written

#: Rows that the centres are fitted on, the bytes they may take, and the rows of them that the recall is measured with.
SAMPLE, SAMPLE_BYTES, TESTS = 16_384, 64 << 20, 256
#: The most cells that are made of themselves: the square root of the number of rows, up to this.
CELLS = 4096
ROUNDS = 12
RECALL = 0.95


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def centres(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means over unit rows, seeded far apart; a centre that loses all its rows moves to the row worst served."""
    rng = np.random.default_rng(seed)
    best = np.full(len(sample), -np.inf)
    found = np.empty((cells, sample.shape[1]))
    for c in range(cells):
        far = np.maximum(1 - best, 0) if c else np.ones(len(sample))
        found[c] = sample[rng.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(sample))]
        best = np.maximum(best, sample @ found[c])
    for _ in range(ROUNDS):
        score = sample @ found.T
        cell = score.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, sample)
        lost = np.flatnonzero(np.bincount(cell, minlength=cells) == 0)
        if len(lost):
            sums[lost] = sample[np.argsort(score.max(axis=1), kind="stable")[: len(lost)]]
        found = np.where(np.abs(sums).max(axis=1, keepdims=True, initial=0) > 0, unit(sums), found)
    return found


def enough(sample: np.ndarray, found: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest cells hold that part of the true k neighbours, by brute force within the sample."""
    asked = sample[:: max(1, len(sample) // TESTS)][:TESTS]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    cell = (sample @ found.T).argmax(axis=1)
    order = np.argsort(-(asked @ found.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(found)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


class Probe(NamedTuple):
    """What a task needs of a block of queries: ids, unit vectors, scopes, the queries of each cell, and the radii that they look at there."""

    ids: list
    vectors: np.ndarray
    scopes: list
    of: dict[int, np.ndarray]
    radii: dict[int, tuple[float, float]]


class CellIndex:
    """The index below a path: cells (cell, centre, n, low, high), settings (key, dims, probes, ...) and vectors (key, embedding, radius, scopes, cell)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = spark.read.parquet(f"{self.path}/settings").first()
        self.key = self.settings["key"]
        rows = sorted(spark.read.parquet(f"{self.path}/centres").collect())
        self.centres = np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), self.settings["dims"])

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", scopes: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE, k: int = K, recall: float = RECALL) -> CellIndex:
        """Index vectors (key, embedding, scopes...) of one length. Rows without a vector, or with a null or non-finite component, are left out, as they have no neighbours.

        At most `sample` rows fit the centres, those with the smallest hashes of their keys; all rows are indexed. No row, no index.
        """
        spark, path = vectors.sparkSession, path.rstrip("/")
        use = cls._valid(vectors, key, scopes)
        n, low, high = use.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n or low != high:
            raise ValueError(f"{n} vectors of {low} to {high} dimensions")
        take = min(sample, max(1, SAMPLE_BYTES // (8 * max(1, low))))
        some = use.orderBy(F.xxhash64(key), key).limit(take).select("embedding").toArrow()["embedding"]
        some = unit(some.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, low))
        cells = max(1, min(cells or min(CELLS, math.isqrt(n)), len(some)))
        found = centres(some, cells)
        spark.createDataFrame([(c, x.tolist()) for c, x in enumerate(found)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        made = spark.createDataFrame([(key, low, enough(some, found, k, recall), list(scopes))], "key string, dims int, probes int, scopes array<string>")
        made.coalesce(1).write.parquet(f"{path}/settings")
        index = cls(spark, path)
        index._write(use)
        return index

    @staticmethod
    def _valid(vectors: DataFrame, key: str, scopes: tuple[str, ...]) -> DataFrame:
        odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return vectors.select(key, "embedding", *scopes).where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).where(~odd)

    def add(self, vectors: DataFrame) -> None:
        """Index further rows by the same centres."""
        use = self._valid(vectors, self.key, tuple(self.settings["scopes"]))
        if use.where(F.size("embedding") != self.settings["dims"]).limit(1).count():
            raise ValueError(f"vectors of other than {self.settings['dims']} dimensions")
        self._write(use)

    def _write(self, vectors: DataFrame) -> None:
        from pyspark.sql.types import StructType

        shared, dims = self.spark.sparkContext.broadcast(self.centres), self.settings["dims"]
        target = StructType([*vectors.schema, *StructType.fromDDL("radius double, cell int")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = unit(batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims))
                score = v @ shared.value.T
                cell = score.argmax(axis=1)
                length = np.abs(v).max(axis=1, initial=0) > 0
                radius = np.sqrt(np.maximum(1 + length - 2 * score[np.arange(len(v)), cell], 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(radius), pa.array(cell.astype(np.int32))], names=target.names)

        dealt = vectors.mapInArrow(run, target)
        # a cell that holds very many rows is many ranges: rows of one radius are told apart by their keys
        order = ["cell", "radius", F.xxhash64(self.key)]
        dealt.repartitionByRange(*order).sortWithinPartitions("cell", "radius").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")
        written_ = self.rows()
        extent = written_.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
        extent.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/extents")

    def rows(self) -> DataFrame:
        """All that is indexed, cell and radius included."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _extents(self) -> np.ndarray:
        """(n, low, high) of each cell; an empty one has no extent."""
        out = np.array([(0, np.inf, -np.inf)] * len(self.centres), np.float64)
        for r in self.spark.read.parquet(f"{self.path}/extents").collect():
            out[r["cell"]] = r["n"], r["low"], r["high"]
        return out

    def _blocks(self, queries: DataFrame, scope: str | None) -> Iterator[tuple[list, np.ndarray, list]]:
        block: list[tuple] = []
        rows = queries.where("embedding is not null").select("query_id", "embedding", *([scope] if scope else [])).toLocalIterator()
        while True:
            row = next(rows, None)
            if row is not None:
                block.append(tuple(row))
            if block and (row is None or len(block) == BLOCK):
                yield [r[0] for r in block], unit(np.array([r[1] for r in block], np.float64).reshape(len(block), self.settings["dims"])), [r[2] for r in block] if scope else []
                block = []
            if row is None:
                return

    def search(self, queries: DataFrame, k: int = K, probes: int | None = None, scope: str | None = None, exact: bool = False) -> DataFrame:
        """(query_id, key, score, rank): for each of queries (query_id, embedding) the k best rows of the cells it probes, ties to the smaller key.

        exact: what further cells may hold is looked at as well, so the result is that of vectors.nearest. Two points of unit length are no closer than the difference of
        their distances to a centre; a cell whose radii all differ from the query's distance by more than the k-th best row does is not read.
        Queries are a stated set, searched in blocks; scope names a column of both, as in vectors.nearest; a query without a vector gives no row.
        """
        probes = min(probes or self.settings["probes"], len(self.centres))
        kinds = queries.schema["query_id"].dataType.simpleString(), self.rows().schema[self.key].dataType.simpleString()
        ddl = f"query_id {kinds[0]}, {self.key} {kinds[1]}, score double"
        parts: DataFrame | None = None
        extents = self._extents()
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        for ids, q, scopes in self._blocks(queries, scope):
            score = q @ self.centres.T
            near = np.zeros(score.shape, bool)
            np.put_along_axis(near, np.argsort(-score, axis=1, kind="stable")[:, :probes], True, axis=1)
            found = self._found(ids, q, scopes, near, None, k, scope, ddl)
            if exact:
                found = written(best(found).drop("rank"), "near")
                least = {r["query_id"]: (r["n"], r["s"]) for r in found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).collect()}
                floor = np.array([s if n == k else -1.0 for n, s in (least.get(i, (0, -1.0)) for i in ids)]) - 1e-6
                length = np.abs(q).max(axis=1, initial=0) > 0
                reach = np.where(length, np.sqrt(np.maximum(2 - 2 * floor, 0)) + 1e-9, np.inf)[:, None]
                distance = np.sqrt(np.maximum(1 + length[:, None] - 2 * score, 0))
                more = ~near & (extents[:, 1] <= distance + reach) & (extents[:, 2] >= distance - reach)
                found = found.unionByName(self._found(ids, q, scopes, more, (distance - reach, distance + reach), k, scope, ddl))
            found = written(best(found).drop("rank"), "found")
            parts = found if parts is None else parts.unionByName(found)
        if parts is None:
            return self.spark.createDataFrame([], f"{ddl}, rank int")
        return best(parts)

    def share(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, share): the part of all rows that each query is compared with."""
        probes = min(probes or self.settings["probes"], len(self.centres))
        n = self._extents()[:, 0]
        kind = queries.schema["query_id"].dataType.simpleString()
        out = []
        for ids, q, _ in self._blocks(queries, None):
            cells = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]
            out += list(zip(ids, (n[cells].sum(axis=1) / max(n.sum(), 1)).tolist(), strict=True))
        return self.spark.createDataFrame(out, f"query_id {kind}, share double")

    def _found(self, ids: list, q: np.ndarray, scopes: list, use: np.ndarray, radii: tuple[np.ndarray, np.ndarray] | None, k: int, scope: str | None, ddl: str) -> DataFrame:
        """Each task's k best rows of each query from the cells that `use` (query, cell) marks."""
        of = {int(c): np.flatnonzero(use[:, c]) for c in np.flatnonzero(use.any(axis=0))}
        within = {c: (float(radii[0][i, c].min()), float(radii[1][i, c].max())) for c, i in of.items()} if radii else {}
        rows = self.rows().where(F.col("cell").isin(list(of)) if len(of) < len(self.centres) else F.lit(True))
        if within:
            rows = rows.where(F.col("radius").between(min(x for x, _ in within.values()), max(x for _, x in within.values())))
        seen = [None if s is None else {repr(x) for x in s} if isinstance(s, list) else {repr(s)} for s in scopes]
        sent, key, dims = self.spark.sparkContext.broadcast(Probe(ids, q, seen, of, within)), self.key, self.settings["dims"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = sent.value
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size, least = 0, np.full(len(probe.ids), -np.inf)

            def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                query, score, keys = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((keys, -score, query))
                query, score, keys = query[order], score[order], keys[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                least[query[place == k - 1]] = score[place == k - 1]
                return query[place < k], score[place < k], keys[place < k]

            # a batch is compared by a few rows at once, of which each query keeps no more than its k best before they are held
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                cell, radius = batch["cell"].to_numpy(), batch["radius"].to_numpy()
                keys = batch[key].to_numpy(zero_copy_only=False)
                v = unit(batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dims))
                tags = np.array([repr(x) for x in batch[scope].to_pylist()], object) if scope else None
                for c in np.unique(cell).tolist():
                    if c not in probe.of:
                        continue
                    low, high = probe.radii.get(c, (-np.inf, np.inf))
                    at = np.flatnonzero((cell == c) & (radius >= low) & (radius <= high))
                    asked = probe.of[c]
                    score = np.round(probe.vectors[asked] @ v[at].T, 6)
                    fit = score >= least[asked, None]
                    if tags is not None:
                        fit &= np.array([[s is None or t in s for t in tags[at]] for s in (probe.scopes[i] for i in asked)], bool).reshape(fit.shape)
                    if len(at) > k:
                        # ties with the k-th best stay, their keys decide
                        score[~fit] = -np.inf
                        fit &= score >= np.partition(score, len(at) - k, axis=1)[:, len(at) - k, None]
                    i, j = np.nonzero(fit)
                    held.append((asked[i], score[i, j], keys[at[j]]))
                    size += len(i)
                    if size > 4 * k * len(probe.ids) + 100_000:
                        held = [cut()]
                        size = len(held[0][0])
            if size:
                query, score, keys = cut()
                yield pa.RecordBatch.from_arrays([pa.array([probe.ids[i] for i in query.tolist()]), pa.array(keys), pa.array(score)], names=["query_id", key, "score"])

        return rows.select(key, "embedding", "cell", "radius", *([scope] if scope else [])).mapInArrow(run, ddl)
