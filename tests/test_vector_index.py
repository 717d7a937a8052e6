"""The stored index, the exact search through its tree, and the vector store by leaf."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators.knn import knn
from flowlens.operators.vector_index import (
    build_index, calibrate, encode, exact_search, kmeans, multiplied, part_ranges, recall, search_index,
)
from flowlens.sources.vectors import VectorStore
from flowlens.suite.registry import queries

SCHEMA = "id long, flow_id string, embedding array<float>, label string, confidence float, src_ip string, dst_ip string, detected_at bigint"


def clustered(n=900, width=24, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(30, width))
    x = (centers[rng.integers(0, 30, n)] + rng.normal(size=(n, width)) * 0.2).astype(np.float32)
    x[n // 2 :: 7] = x[3]  # a group of equal vectors
    x[5] = 0
    return x


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, f"f{i}", v.tolist(), "DoS" if i % 3 else "Botnet", 0.5, "a", "b", i * 10) for i, v in enumerate(clustered())]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def asked(df):
    return df.select(F.col("id").alias("query_id"), "embedding", "detected_at")


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["distance"], r["id"]) for r in df.select("query_id", "rank", "distance", "id").collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_search_through_the_tree(spark, base, tmp_path, metric):
    index = build_index(base, str(tmp_path / "index"), metric=metric, leaf_rows=20)
    assert index.table(spark, "leaves").count() > 20
    assert index.table(spark, "rows").count() == base.count()
    want = rows_of(knn(base, asked(base), 4, metric, fields=[]))
    assert rows_of(exact_search(index, asked(base), 4, fields=[])) == want
    assert rows_of(search_index(index, asked(base), 4, probes=1 << 20, rerank=None, fields=[])) == want


def test_exact_search_of_earlier_rows(spark, base):
    want = rows_of(knn(base, asked(base), 3, fields=[], before="detected_at"))
    assert rows_of(knn(base, asked(base), 3, fields=[], before="detected_at", tree=True)) == want
    assert rows_of(knn(base, asked(base), 3, fields=[], before="detected_at", cells=9)) == want


def test_cells_of_later_rows_are_not_visited(spark, base, monkeypatch):
    from flowlens.operators import knn as module

    late = base.withColumn("detected_at", F.when(F.col("label") == "DoS", 10_000_000).otherwise(F.col("detected_at")))
    far = late.withColumn("embedding", F.when(F.col("label") == "DoS", F.transform("embedding", lambda x: -x - 5)).otherwise(F.col("embedding")))
    queries_ = asked(far.filter("label = 'Botnet'"))
    visits = []
    search = module._search
    monkeypatch.setattr(module, "_search", lambda v, *rest: (visits.append(v), search(v, *rest))[1])
    found = knn(far, queries_, 2, fields=["detected_at"], before="detected_at", cells=12)
    assert found.filter("detected_at >= 10000000").isEmpty()
    seen = {r["cell"] for v in visits for r in v.select("cell").distinct().collect()}
    assert len(seen) < 12


def test_leaves_keep_their_size(spark, base, tmp_path):
    sizes = []
    for k, part in enumerate((base.filter("id < 300"), base)):
        index = build_index(part, str(tmp_path / str(k)), leaf_rows=15)
        sizes.append(index.table(spark, "leaves").agg(F.count(F.lit(1)), F.percentile_approx("n", 0.5)).first())
    assert sizes[1][0] > 2 * sizes[0][0] and sizes[1][1] <= 2 * sizes[0][1] + 5


def test_codes_rank_rows():
    x = clustered(400, 12).astype(np.float64)
    books = [kmeans(x[:, a:b], 64) for a, b in part_ranges(12, 6)]
    codes = encode(x, books)
    assert codes.shape == (400, 6) and codes.dtype == np.uint8
    for (a, b), book, code in zip(part_ranges(12, 6), books, codes.T):
        gap = ((x[:, None, a:b] - book[None]) ** 2).sum(axis=2)
        assert np.allclose(gap[np.arange(400), code], gap.min(axis=1))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    found = queries()["v6_approximate"](spark, f"/root/testdata/{sf}")
    assert {(r["recall_reached"], r["quarter_kept"]) for r in found.select("recall_reached", "quarter_kept").distinct().collect()} == {(True, True)}


def test_calibration(spark, base, tmp_path):
    index = build_index(base, str(tmp_path / "index"), leaf_rows=20)
    narrow = search_index(index, asked(base), 5, probes=1, rerank=8, fields=[])
    exact = knn(base, asked(base), 5, fields=[])
    index, reached = calibrate(index, asked(base), 5, target=0.95)
    assert recall(narrow, exact) < reached and reached >= 0.95
    assert recall(search_index(index, asked(base), 5, fields=[]), exact) > 0.9
    assert multiplied(index, asked(base)).agg(F.max("multiplied")).first()[0] < base.count()
    with pytest.raises(ValueError):
        build_index(base, str(tmp_path / "ip"), metric="ip")
    with pytest.raises(ValueError):
        build_index(base.limit(0), str(tmp_path / "none"))


# --------------------------------------------------------------------------- the store


def files_of(folder):
    return {p: (os.path.getmtime(p), os.path.getsize(p)) for p in glob.glob(f"{folder}/rows/**/*.parquet", recursive=True)}


def test_store_only_adds(spark, base, tmp_path):
    path = str(tmp_path / "store")
    store = VectorStore(spark, path)
    assert store.centers() is None and store.read().collect() == []
    assert store.nearest(asked(base), 3).collect() == []
    parts = [base.filter(F.col("id") % 3 == k) for k in range(3)]
    store.append(parts[0], 0, leaves=25)
    first = files_of(path)
    store.append(parts[1], 1)
    store.append(parts[2], 2)
    store.append(parts[2], 2)  # a replay
    later = files_of(path)
    assert {p: later[p] for p in first} == first and store.read().count() == base.count()
    old = parts[0].unionByName(parts[1])
    want = rows_of(knn(old, asked(parts[2]), 4, fields=[]))
    assert rows_of(store.nearest(asked(parts[2]), 4, fields=[], before_batch=2)) == want
    assert rows_of(store.nearest(asked(base), 4, fields=[])) == rows_of(knn(base, asked(base), 4, fields=[]))


def test_lookups_read_bounded_leaves(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(g * 1000 + i, f"f{g}-{i}", (np.eye(16)[g] + rng.normal(size=16) * 0.01).tolist(), "x", 0.1, "a", "b", 0)
            for g in range(16) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    store = VectorStore(spark, str(tmp_path / "store"))
    for batch in range(3):
        store.append(df.withColumn("id", F.col("id") + 100 * batch).withColumn("flow_id", F.concat("flow_id", F.lit(f"-{batch}"))), batch, leaves=16)
    opened = []

    class Watched(VectorStore):
        def leaves(self, leaves, before_batch=None):
            opened.append(list(leaves))
            return super().leaves(leaves, before_batch)

    ask = asked(df.filter("id = 2003"))
    found = Watched(spark, store.path).nearest(ask, 5, fields=["flow_id"], before_batch=2)
    assert found.count() == 5
    held = {r["leaf"] for r in store.stats().select("leaf").distinct().collect()}
    assert len(held) > 8 and max(map(len, opened)) <= len(held) / 4
    read = store.leaves(opened[0], 2).inputFiles()
    assert 0 < len(read) and all(f"/leaf={opened[0][0]}/" in f or len(opened[0]) > 1 for f in read)
    assert len(read) <= len(store.leaves(sorted(held)).inputFiles()) / 4


def test_the_approximate_query_gives_all_its_hits(spark):
    found = queries()["v6_approximate"](spark, "/root/testdata/sf0.001").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("last")).collect()
    assert found and {(r["n"], r["last"]) for r in found} == {(5, 5)}
