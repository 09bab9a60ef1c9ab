"""The vector index: cells, pruning and upkeep, against scans by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import vector_index
from fathom.sources.snapshots import Store

CENTRES = np.random.default_rng(5).normal(size=(12, 8)) * 10


def clustered(n, seed):
    """n vectors round a dozen points, a third of them round one; some are copies."""
    rng = np.random.default_rng(seed)
    near = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, len(CENTRES), n))
    made = (CENTRES[near] + rng.normal(size=(n, 8)) * 0.5).astype(np.float32)
    made[n // 2 : n // 2 + n // 20] = made[0]
    return made


def rows(spark, vectors, ids, model="m"):
    data = [(f"{i:05d}", f"{i:05d}", model, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(data, "id string, owner string, model string, embedding array<float>")


def committed(store, new=None, gone=None, models=(), **options):
    base = store.snapshot()
    parts, totals = vector_index.add_segment(store, base, new, gone, models, **options)
    return store.commit(base, parts, totals=totals)


def scan(held, query, k):
    """The k nearest of a dictionary of vectors, one after another."""
    far = {i: float(np.sqrt(((v.astype(float) - query) ** 2).sum())) for i, v in held.items()}
    best = sorted((round(d, 9), i) for i, d in far.items())[:k]
    return [(f"{i:05d}", pytest.approx(1 / (1 + d))) for d, i in best]


def found(df):
    return [(r["id"], r["score"]) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Three versions: all vectors; some replaced and some deleted; those of another model deleted."""
    store = Store(spark, str(tmp_path_factory.mktemp("vectors")))
    first = clustered(1500, 1)
    committed(store, rows(spark, first, range(1500)).unionByName(rows(spark, first[:50, :5], range(50), "other")))
    second = clustered(300, 2)
    gone = spark.createDataFrame([(f"{i:05d}",) for i in range(700, 900)] + [("absent",)], "owner string")
    committed(store, rows(spark, second, range(1300, 1600)), gone)
    committed(store, models=["other"])
    return store


@pytest.fixture(scope="module")
def held():
    first, second = clustered(1500, 1), clustered(300, 2)
    before = dict(enumerate(first))
    after = {i: v for i, v in before.items() if not 700 <= i < 900} | dict(zip(range(1300, 1600), second, strict=True))
    return before, after


def test_search_equals_a_scan(store, held):
    probes = [CENTRES[0], CENTRES[3] + 0.3, held[0][0].astype(float), np.zeros(8), np.full(8, 1000.0)]
    for version, state in ((1, held[0]), (3, held[1])):
        for query, k in zip(probes, (10, 3, 100, 10, 1), strict=True):
            got = found(vector_index.search(store, store.snapshot(version), query, k, "m"))
            assert got == scan(state, query, k), (version, k)


def test_clusters_are_not_read_far_away(store):
    one = vector_index.Search(store, store.snapshot(), CENTRES[3] + 0.3, 3, "m")
    radius = one.radius()
    cells = one.reached(radius)
    assert one.cells.n[cells].sum() < 0.35 * one.cells.n.sum()
    assert one.read(cells, radius).count() < 0.35 * one.read(range(len(one.cells.n))).count()
    assert "PushedFilters" in one.read(cells, radius)._jdf.queryExecution().toString() and "distance" in one.read(cells, radius)._jdf.queryExecution().toString()


def test_bounds_hold_for_every_vector(store, held):
    """No vector is nearer than the bound of its cell, on spread vectors and queries too."""
    cells = vector_index.Cells(store, store.snapshot(1), "m")
    at = {r["id"]: r["cell"] for r in vector_index.living(store, store.snapshot(1)).filter("model = 'm'").select("id", "cell").collect()}
    rng = np.random.default_rng(9)
    for _ in range(30):
        query = rng.normal(size=8) * rng.choice([0.1, 5, 20])
        bound, slack = cells.bounds(query), cells.slack(query) ** 0.5
        for i, v in held[0].items():
            assert np.sqrt(((v - query) ** 2).sum()) >= bound[at[f"{i:05d}"]] - slack


def test_more_than_there_is_and_nothing(spark, store, held, tmp_path):
    assert len(found(vector_index.search(store, store.snapshot(), np.zeros(8), 5000, "m"))) == len(held[1])
    assert found(vector_index.search(store, store.snapshot(), np.zeros(5), 3, "other")) == []  # deleted
    assert found(vector_index.search(store, store.snapshot(), np.zeros(5), 3, "unknown")) == []
    empty = Store(spark, str(tmp_path))
    assert found(vector_index.search(empty, empty.snapshot(), np.zeros(3), 3, "m")) == []
    committed(empty, rows(spark, [], []))
    assert found(vector_index.search(empty, empty.snapshot(), np.zeros(3), 3, "m")) == []
    committed(empty, rows(spark, np.ones((3, 3), dtype=np.float32), range(3)))  # copies alone
    assert [i for i, _ in found(vector_index.search(empty, empty.snapshot(), np.zeros(3), 2, "m"))] == ["00000", "00001"]


def test_totals_count_what_came_and_went(store, held):
    assert store.snapshot(1).totals["vectors"] == 1550
    assert store.snapshot(2).totals["vectors"] == len(held[1]) + 50
    assert store.snapshot(3).totals["vectors"] == len(held[1])
    assert vector_index.living(store, store.snapshot()).count() == len(held[1])


def test_many_queries_equal_scans_and_recall_is_measured(spark, store, held):
    asked = [i for i in held[1] if i % 100 == 0]
    queries = spark.createDataFrame([(i, [float(x) for x in held[1][i]]) for i in asked], "query_id long, query array<double>")
    many = vector_index.search_many(store, store.snapshot(), queries, 7, "m").orderBy("query_id", "rank").collect()
    for i in asked:
        assert [(r["id"], r["score"]) for r in many if r["query_id"] == i] == scan(held[1], held[1][i].astype(float), 7)
    every = vector_index.recall(store, store.snapshot(), queries, 1000, 7, "m").first()
    assert every["recall"] == 1 and every["n"] == 7 * len(asked)
    few = vector_index.recall(store, store.snapshot(), queries, 3, 7, "m").first()
    assert 0.5 < few["recall"] <= 1


def test_merge_keeps_the_living(spark, store, held, tmp_path):
    other = Store(spark, str(tmp_path))
    committed(other, rows(spark, clustered(400, 3), range(400)))
    committed(other, gone=spark.createDataFrame([(f"{i:05d}",) for i in range(0, 400, 2)], "owner string"))
    base = other.snapshot()
    replace, _ = vector_index.merge(other, base)
    after = other.commit(base, {}, replace)
    state = {i: v for i, v in enumerate(clustered(400, 3)) if i % 2}
    assert after.parts["gone_vectors"] == [] and vector_index.living(other, after).count() == 200
    for query in (np.zeros(8), CENTRES[0]):
        assert found(vector_index.search(other, after, query, 12, "m")) == scan(state, query, 12)


def test_refused_rows(spark, store, tmp_path):
    with pytest.raises(Exception, match="owner is null"):
        committed(store, rows(spark, clustered(2, 4), [1, 2]).withColumn("owner", F.lit(None).cast("string")))
    with pytest.raises(Exception):
        committed(store, rows(spark, clustered(2, 4)[:, :3], [1, 2]))
    other = Store(spark, str(tmp_path))
    some = rows(spark, clustered(10, 4), range(10))
    committed(other, some.withColumn("embedding", F.when(F.col("id") > "00004", F.col("embedding"))))
    assert len(found(vector_index.search(other, other.snapshot(), np.zeros(8), 10, "m"))) == 5
