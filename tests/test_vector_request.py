"""The vector request: its filters, its checks and its answers."""

import pytest
from pyspark.sql import functions as F

from flowlens.plans.catalog import Catalog
from flowlens.plans.request import RequestError
from flowlens.plans.vectors import capped_top_k, filter_condition, vector_query


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, [float(i), 1.0], label, i / 10) for i, label in enumerate(["DoS", "DDoS", None, "a\"b", "Botnet", "DoS"])]
    return spark.createDataFrame(rows, "id long, embedding array<double>, label string, confidence double")


def holds(field, op, value):
    return {"field": field, "op": op, "value": value}


@pytest.mark.parametrize("raw,want", [
    (holds("label", "eq", "DoS"), [0, 5]), (holds("label", "ne", "DoS"), [1, 3, 4]), (holds("label", "in", ["DoS", "DDoS"]), [0, 1, 5]),
    (holds("label", "not_in", ["DoS", "DDoS"]), [3, 4]), (holds("label", "like", "D%S"), [0, 1, 5]),
    ([holds("confidence", "gt", 0.15), holds("confidence", "lte", 4e-1)], [2, 3, 4]),
    ([{"not": {"any": [holds("label", "eq", "DoS"), holds("id", "lt", 3)]}}, holds("id", "gte", 4)], [4]),
    (holds("id", "in", []), []), (holds("label", "eq", 'a"b'), [3]), ({"field": "label", "op": "is_null"}, [2]),
    ({"any": [holds("id", "eq", 1), [holds("id", "eq", 2), holds("label", "eq", "x")]]}, [1]), ({"not": holds("id", "gte", 1)}, [0]),
    ([], [0, 1, 2, 3, 4, 5]), ({"any": []}, []),
])
def test_filters(table, raw, want):
    types = {f.name: f.dataType for f in table.schema.fields}
    assert [r["id"] for r in table.filter(filter_condition(raw, types)).orderBy("id").collect()] == want


@pytest.mark.parametrize("raw", [
    "id == 1", 5, {"field": "label"}, holds("nope", "eq", 1), holds("label", "is", 1), {"any": holds("id", "eq", 1)}, holds("label", "like", 5),
    {"not": "x"}, {"any": [], "not": []}, [holds("id", "eq", 1), "x"], holds("id", "eq", {"sql": "1"}),
])
def test_bad_filters(table, raw):
    with pytest.raises(RequestError):
        filter_condition(raw, {f.name: f.dataType for f in table.schema.fields})


def test_request(table):
    catalog = Catalog({"kb": table, "other": table}, ["kb"])
    found = vector_query(catalog, {"collection": "kb", "embedding": [1, 1], "top_k": 2, "output_fields": ["label"]})
    assert found.columns == ["rank", "distance", "id", "label"]
    assert [(r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    for bad in ({"collection": "other", "embedding": [1.0, 1.0]}, {"collection": "kb"}, {"embedding": [1.0]},
                {"collection": "kb", "embedding": []}, {"collection": "kb", "embedding": ["x"]},
                {"collection": "kb", "embedding": [1.0, 1.0], "top_k": "5"},
                {"collection": "kb", "embedding": [1.0, 1.0], "output_fields": ["nope"]},
                {"collection": "kb", "embedding": [1.0, 1.0], "sql": "1"}):
        with pytest.raises(RequestError):
            vector_query(catalog, bad)


def test_caps():
    assert [capped_top_k(k) for k in (None, 0, 7, 1000)] == [5, 1, 7, 100] and capped_top_k(1000, None) == 1000


def test_queries_go_to_few_cells(spark, monkeypatch):
    """Far-apart groups: a query's bound keeps it out of all cells but its own."""
    from flowlens.operators import knn as module

    rows = [(g * 100 + i, [1.0 if d == g else 0.001 * (i % 7) for d in range(8)]) for g in range(8) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(16)
    queries = df.select(F.col("id").alias("query_id"), "embedding")
    visits = []
    search = module._search
    monkeypatch.setattr(module, "_search", lambda v, *rest: (visits.append(v.count()), search(v, *rest))[1])
    found = module.knn(df, queries, 3, cells=8)
    assert found.count() == 3 * len(rows)
    assert len(visits) == 2 and sum(visits) < 3 * len(rows)  # of 8 cells
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
