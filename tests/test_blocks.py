"""Sparse vectors in the block search, and its tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import knn, sparse, vector_index
from flowlens.schemas import VECTORS
from flowlens.sources.vectors import VectorStore


def _sparse(rng, n, width=384, words=12):
    out = np.zeros((n, width))
    for row in out:
        row[rng.integers(0, width, words)] = rng.choice([-1.0, 1.0, 2.0], words)
    return out


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_folded_scores_are_never_below_the_products(metric):
    rng = np.random.default_rng(3)
    q, b = _sparse(rng, 50), _sparse(rng, 300)
    b[7, 3], b[8] = np.inf, np.nan
    scores = knn._Scores(q, b, metric)
    assert scores.above is not None and scores.above.queries.shape[1] == knn.FOLDED
    every = np.arange(len(q))
    sound = np.isfinite(b).all(axis=1)
    exact = knn.space(q, metric) @ knn.space(b, metric)[sound].T
    slack = scores.above.error[:, None]
    assert np.isfinite(slack).all()
    assert (scores.above.products(every, slice(0, len(b)))[:, sound] >= exact - slack).all()


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_sparse_vectors_find_their_nearest(metric):
    rng = np.random.default_rng(4)
    q, b = _sparse(rng, 60), _sparse(rng, 3000)
    b[1500:] = b[rng.integers(0, 1500, 1500)]  # copies: ties go to the smaller id
    b[5] = 0.0
    lists = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    queries = pa.table({"query_id": pa.array(range(len(q))), "embedding": lists(q), "bound": pa.array(np.full(len(q), np.inf))})
    base = pa.table({"id": pa.array(rng.permutation(len(b))), "embedding": lists(b),
                     "cell": pa.array((np.arange(len(b)) % 7).astype(np.int32))})
    found = knn._meet(5, metric, "id", "embedding", [], None)(queries, base).to_pylist()
    gap = np.round(knn.distances(q, b, metric), 6) + 0.0
    ids = base["id"].to_numpy()
    for i in range(len(q)):
        own = sorted((round(r["distance"], 6), r["id"]) for r in found if r["query_id"] == i)
        assert own == sorted((round(float(g), 6), int(n)) for g, n in zip(gap[i], ids))[:5]


def test_blocks_meet_in_tasks_of_their_own(spark, tmp_path):
    """Long tasks of few bytes are not put together, whatever the session's number of shuffle partitions."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((600, 4)))]
    base = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = base.withColumnRenamed("id", "query_id")
    found = knn.knn(base, queries, 3, "l2", cells=6, block_rows=20)
    assert found.count() == 1800
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def _odd(rng, n):
    """Sparse rows with some in common places, copies, zeros, and rows that are no numbers."""
    out = _sparse(rng, n)
    out[:, 7] = 1.0
    out[:, 20] = rng.integers(0, 2, n)
    out[n // 2 :] = out[rng.integers(0, n // 2, n - n // 2)]
    out[3], out[4] = 0.0, -out[5]
    out[6, 9], out[8, 9] = np.nan, np.inf
    return out


@pytest.mark.parametrize("k", [1, 5, 700])
def test_packed_vectors_find_their_nearest(k):
    rng = np.random.default_rng(6)
    q, b = _odd(rng, 80), _odd(rng, 600)
    lists = lambda x: pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    ids = pa.array(rng.permutation(len(b)) // 2)  # each id twice
    queries = pa.table({"query_id": pa.array(range(len(q))), "embedding": lists(q), "bound": pa.array(np.full(len(q), np.inf))})
    base = pa.table({"id": ids, "embedding": lists(b), "cell": pa.array((np.arange(len(b)) % 7).astype(np.int32))})
    choose = lambda rows, asks: (np.arange(7)[None, :] + asks["query_id"].to_numpy()[:, None]) % 3 > 0
    pack = lambda t: t.set_column(1, "embedding", sparse.pack(t["embedding"]))
    plain = knn._meet(k, "cosine", "id", "embedding", [], None, choose)
    task = knn._meet_packed(k, "id", "embedding", [], choose, (T.FloatType(), T.FloatType()), 384)
    rows = lambda t: sorted(zip(*t.to_pydict().values()))
    want = rows(plain(queries, base))
    assert rows(task(pack(queries), pack(base))) == want and len(want) > 70 * min(k, 100)
    # Within the k-th distance and id of a first search nothing else is found.
    last = {}
    for n, gap, i in want:
        last[n] = max(last.get(n, (0.0, 0)), (gap, i))
    some = [n in last for n in range(len(q))]
    asks = queries.filter(pa.array(some))
    asks = asks.set_column(2, "bound", pa.array([g for g, _ in (last[n] for n in asks["query_id"].to_pylist())])).append_column(
        "bound_id", pa.array([i for _, i in (last[n] for n in asks["query_id"].to_pylist())]))
    assert rows(task(pack(asks), pack(base))) == want


def test_packed_vectors_multiply_few_pairs(monkeypatch):
    rng = np.random.default_rng(7)
    x = _sparse(rng, 4000)
    x[:, :7] += 1.0  # words that every text has
    met = []
    meet = sparse.Search._meet
    monkeypatch.setattr(sparse.Search, "_meet", lambda self, asks, rows, turn: (met.append(len(asks) * len(rows)), meet(self, asks, rows, turn))[1])
    rows = sparse.unpack(sparse.pack(pa.array(list(x), pa.list_(pa.float64()))), T.DoubleType(), 384)
    full = np.full(len(x), len(x))
    row, column, gap = sparse.Search(rows, rows, np.arange(len(x)), 2, np.full(len(x), 0.05), full).run()
    assert (np.bincount(row, minlength=len(x)) >= 1).all() and sum(met) < len(x) ** 2 / 5


def test_a_store_of_sparse_vectors_is_searched_packed(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i % 400, f"f{i}", v.tolist(), "x", 0.1, "a", "b", 0) for i, v in enumerate(_odd(rng, 500)) if np.isfinite(v).all()]
    df = spark.createDataFrame(rows, VECTORS)
    store = VectorStore(spark, str(tmp_path / "store"))
    store.append(df.filter("id % 2 = 0"), 0, leaves=6)
    store.append(df.filter("id % 2 = 1"), 1)
    seen = []
    monkeypatch.setattr(knn, "_meet_packed", lambda *a, task=knn._meet_packed: (seen.append(a), task(*a))[1])
    asked = df.select(F.col("flow_id").alias("query_id"), "embedding")
    shown = lambda found: sorted(map(tuple, found.select("query_id", "rank", "distance", "id").collect()))
    want = shown(knn.knn(df, asked, 4, fields=[]))
    assert shown(store.nearest(asked, 4, fields=[])) == want and seen
    # A batch whose components were not counted is searched as it is.
    seen.clear()
    stats = store.stats().drop("nonzero").filter("batch_id = 1").drop("batch_id").toArrow()
    spark.createDataFrame(stats.to_pandas()).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
        f"{store.path}/stats/batch_id=1")
    assert shown(store.nearest(asked, 4, fields=[])) == want and not seen


def test_a_block_is_sent_the_leaves_of_its_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((800, 8)))]
    base = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = base.withColumnRenamed("id", "query_id")
    index = vector_index.build_index(base, str(tmp_path / "index"), leaf_rows=20)
    shown = lambda found: sorted(map(tuple, found.select("query_id", "rank", "distance", "id").collect()))
    want = shown(vector_index.search_index(index, asked, 3))
    sent, search = [], vector_index._search

    def watched(*args):
        def own(asks):
            sent.extend(args[-1](asks).select("cells", "leaves", "_cells").collect())
            return args[-1](asks)

        return search(*args[:-1], own)

    monkeypatch.setattr(vector_index, "_search", watched)
    monkeypatch.setattr(vector_index, "_rows", lambda *_: 200)  # several blocks of rows
    assert shown(vector_index.search_index(index, asked, 3)) == want
    assert sent and all(r["cells"] and len(r["cells"]) == len(r["leaves"]) and set(r["cells"]) <= set(r["_cells"]) for r in sent)


@pytest.mark.parametrize("n", [51_282, 615_384])
def test_either_side_is_sent_a_few_times(n):
    assert n / knn._rows(knn.BLOCK_ROWS, n, 64) <= 8
