"""The cell index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import vectors
from foliant.sources.cells import CellIndex, centres, enough, unit


def table(spark, n=1500, dims=12, seed=0, groups=30):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(groups, dims))
    rows = [(i, (mid[rng.integers(groups)] + rng.normal(size=dims) / 2).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def asked(v, every=50):
    return v.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    v = table(spark)
    return v, CellIndex.build(v, str(tmp_path_factory.mktemp("cells") / "index"), scopes=("label",))


def test_recall_share_and_self_match(made):
    v, index = made
    q = asked(v)
    true = {(r.query_id, r.vec_id) for r in vectors.nearest(v, q).collect()}
    got = index.search(q).collect()
    assert len(true & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(true)
    assert all(r.vec_id == r.query_id and r.score == 1.0 for r in got if r.rank == 1)
    shares = [r.share for r in index.share(q).collect()]
    assert len(shares) == q.count() and np.mean(shares) < 0.5


def test_exact_search_equals_brute_force(made):
    v, index = made
    assert rows(index.search(asked(v), exact=True)) == rows(vectors.nearest(v, asked(v)))
    assert rows(index.search(asked(v), 4, probes=1, scope="label", exact=True)) == rows(vectors.nearest(v, asked(v), 4, scope="label"))


def test_rows_of_a_batch_are_compared_by_a_few_at_once(spark, made, monkeypatch):
    v, index = made
    assert vectors.ROWS * vectors.BLOCK <= 1 << 20
    # many equal vectors: ties go to the smaller key across slices as well
    same = table(spark, 60, seed=9).crossJoin(spark.range(20)).selectExpr("vec_id + id * 100 as vec_id", "embedding", "label").repartition(2)
    q = same.where("vec_id % 7 = 0").selectExpr("vec_id query_id", "embedding", "label")
    whole = rows(vectors.nearest(same, q))
    some = CellIndex.build(same, str(index.path) + "-same", scopes=("label",))
    monkeypatch.setattr(vectors, "ROWS", 16)
    monkeypatch.setattr("foliant.sources.cells.ROWS", 16)
    assert rows(vectors.nearest(same, q)) == whole == rows(some.search(q, exact=True))


def test_few_cells_are_read(made):
    v, index = made
    q = asked(v).limit(1)
    plan = index.rows().where(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    assert index.share(q, 1).first().share < 0.2 and index.share(q, 10**6).first().share == 1.0
    cells = {r.vec_id: r.cell for r in index.rows().collect()}
    assert len({cells[r.vec_id] for r in index.search(q, 10, probes=2).collect()}) <= 2


def test_every_row_is_indexed_and_rows_are_added(spark, tmp_path):
    v = table(spark, 400, seed=1)
    index = CellIndex.build(v, str(tmp_path / "i"), sample=50, cells=9)
    assert rows(index.rows().select("vec_id")) == rows(v.select("vec_id"))
    more = table(spark, 100, seed=2).withColumn("vec_id", F.col("vec_id") + 1000)
    index.add(more)
    both = v.unionByName(more)
    again = CellIndex(spark, str(tmp_path / "i"))
    assert rows(again.search(asked(both), exact=True)) == rows(vectors.nearest(both, asked(both)))
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"))


def test_odd_vectors(spark, tmp_path):
    zero, one = [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]
    some = [(i, one if i % 2 else zero, 1) for i in range(40)] + [(50, [0.6, 0.8, 0.0], None), (51, [-1.0, 0.0, 0.0], 2)]
    odd = [(60, None, 1), (None, one, 1), (61, [float("nan"), 0.0, 0.0], 1), (62, [None, 0.0, 0.0], 1)]
    kind = "vec_id long, embedding array<float>, label int"
    v, all_rows = spark.createDataFrame(some, kind), spark.createDataFrame(some + odd, kind)
    index = CellIndex.build(all_rows, str(tmp_path / "i"), scopes=("label",))
    assert index.rows().count() == len(some)
    q = v.where("vec_id in (0, 1, 50, 51)").selectExpr("vec_id query_id", "embedding", "label")
    for probes in (1,):
        assert rows(index.search(q, probes=probes, exact=True)) == rows(vectors.nearest(v, q))
        assert rows(index.search(q, probes=probes, exact=True, scope="label")) == rows(vectors.nearest(v, q, scope="label"))
    assert index.search(all_rows.where("embedding is null").selectExpr("vec_id query_id", "embedding"), exact=True).collect() == []
    with pytest.raises(ValueError):
        CellIndex.build(v.where("false"), str(tmp_path / "none"))


def test_keys_of_text(spark, tmp_path):
    v = table(spark, 200, seed=3).withColumn("vec_id", F.concat(F.lit("k"), F.col("vec_id").cast("string")))
    index = CellIndex.build(v, str(tmp_path / "i"))
    q = v.where("vec_id like '%7'").selectExpr("vec_id query_id", "embedding")
    assert rows(index.search(q, exact=True)) == rows(vectors.nearest(v, q))


def test_centres_and_probes():
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(300, 5)))
    found = centres(x, 12)
    assert np.allclose(np.sqrt((found * found).sum(axis=1)), 1) and len(np.unique((x @ found.T).argmax(axis=1))) == 12
    assert enough(x, found, 10, 1.0) <= 12 and enough(x, found, 10, 0.5) <= enough(x, found, 10, 0.99)
    same = np.repeat(x[:1], 20, axis=0)
    assert centres(same, 4).shape == (4, 5)


def test_centroids_add_whole_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(("a", "b", None)[i % 3], i % 2, rng.normal(size=4).tolist()) for i in range(90)] + [("c", 1, [1.0, None, 3.0, 4.0]), ("c", 1, [3.0, 2.0]), ("c", 1, None), ("d", 1, [])]
    v = spark.createDataFrame(data, "book_id string, chapter_id int, embedding array<double>").repartition(3)
    expected = {}
    for b in ("a", "b", None):
        for c in (0, 1):
            m = np.mean([x for k, d, x in data if k == b and d == c], axis=0)
            expected[b, c] = m / np.sqrt((m * m).sum())
    expected["c", 1] = np.array([2.0, 2.0, 3.0, 4.0]) / np.sqrt(33)
    for groups in (1,):
        monkeypatch.setattr(vectors, "GROUPS", groups)
        got = {(r.book_id, r.chapter_id): r.centroid for r in vectors.centroids_by(v, ["book_id", "chapter_id"]).collect()}
        assert set(got) == set(expected) and all(np.allclose(got[k], expected[k]) for k in got)
