"""Registered queries for vector search over the ``embeddings`` table; every row is a query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators.knn import approximate_knn, fit_cells, hits, knn, with_cells
from flowlens.operators.latest import upsert
from flowlens.operators.vector_index import build_index, calibrate, exact_search, multiplied, recall, search_index
from flowlens.plans.catalog import Catalog
from flowlens.plans.vectors import capped_top_k, vector_query
from flowlens.session import scratch_path, written
from flowlens.suite.registry import query, register

_DISTANCE = {
    "cosine": "1 - list_cosine_similarity(q.v, b.v)",
    "l2": "list_distance(q.v, b.v)",
    "ip": "-list_inner_product(q.v, b.v)",
}


def _sql(metric: str, k: int, condition: str = "true", columns: str = "label") -> str:
    return f"""
WITH vectors AS (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.label, round({_DISTANCE[metric]}, 6) + 0 AS distance
 FROM vectors q, vectors b WHERE {condition}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
SELECT query_id, rank, distance, id{', ' + columns if columns else ''} FROM ranked
WHERE rank <= {k}"""


def _base(v):
    return v.table("embeddings").withColumnRenamed("vec_id", "id")


def _queries(v):
    return v.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def _shown(df):
    return df.withColumns({"rank": F.col("rank").cast("bigint"), "distance": F.round("distance", 6)})


for _metric in ("cosine", "l2", "ip"):
    register(f"v1_knn_{_metric}",
             lambda v, m=_metric: _shown(knn(_base(v), _queries(v), 5, m)), _sql(_metric, 5))
register("o6_top_k_cap",
         lambda v: _shown(knn(_base(v), _queries(v), capped_top_k(1000), fields=[])), _sql("cosine", 100, columns=""))
register("v2_knn_filtered",
         lambda v: _shown(knn(_base(v), _queries(v), 5, where="label == 3")), _sql("cosine", 5, "b.label = 3"))
register("v2_knn_request_filter",
         lambda v: _shown(knn(_base(v), _queries(v), 3, where=[{"field": "label", "op": "in", "value": [1, 4]}])),
         _sql("cosine", 3, "b.label IN (1, 4)"))
register("v3_output_fields",
         lambda v: _shown(knn(_base(v), _queries(v), 5, fields=[])), _sql("cosine", 5, columns=""))


@query("v4_hit_shape", _sql("cosine", 5))
def _hit_shape(v):
    shaped = hits(knn(_base(v), _queries(v), 5))
    return _shown(shaped.select("query_id", "rank", "hit.id", "hit.distance", "hit.fields.label"))


register("v5_upsert",
         lambda v: upsert(
             v.table("embeddings").select("vec_id", "label"),
             v.table("embeddings").select((F.col("vec_id") * 2).alias("vec_id"), (F.col("label") + 100).alias("label")),
             ["vec_id"]),
         "SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, coalesce(n.label, o.label) AS label FROM embeddings o "
         "FULL JOIN (SELECT vec_id * 2 AS vec_id, label + 100 AS label FROM embeddings) n ON o.vec_id = n.vec_id")


def _approximate(v, probes):
    base = _base(v)
    centroids = fit_cells(base, 16)
    return _shown(approximate_knn(with_cells(base, centroids), _queries(v), centroids, probes, fields=["label"]))


register("v6_approximate_all_cells", lambda v: _approximate(v, 16), _sql("cosine", 5))


def _index(v):
    return build_index(_base(v), scratch_path(v.spark, "index"))


register("v6_index_all_leaves",
         lambda v: _shown(search_index(_index(v), _queries(v), probes=1 << 20, rerank=None)), _sql("cosine", 5))
register("v6_index_exact", lambda v: _shown(exact_search(_index(v), _queries(v))), _sql("cosine", 5))
register("v6_index_l2", lambda v: _shown(knn(_base(v), _queries(v), 5, "l2", tree=True)), _sql("l2", 5))


def _fixed_cells(v, probes):
    """The first 16 vectors as centres, so that SQL can repeat the choice of cells."""
    base = _base(v)
    rows = base.filter("id < 16").orderBy("id").select("embedding").collect()
    centroids = np.array([r["embedding"] for r in rows], dtype=np.float64)
    return _shown(approximate_knn(with_cells(base, centroids), _queries(v), centroids, probes, fields=["label"]))


@query("v6_approximate", f"""
WITH exact AS ({_sql("cosine", 5)}),
vectors AS (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings),
gap AS (SELECT x.vec_id, c.vec_id AS cell, 1 - list_cosine_similarity(x.v, c.v) AS d
 FROM vectors x, vectors c WHERE c.vec_id < 16),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS nth FROM gap),
pairs AS (SELECT q.vec_id AS query_id, b.vec_id AS id, b.label,
  round(1 - list_cosine_similarity(q.v, b.v), 6) + 0 AS distance
 FROM vectors q JOIN near p ON p.vec_id = q.vec_id AND p.nth <= 4 JOIN near h ON h.cell = p.cell AND h.nth = 1
 JOIN vectors b ON b.vec_id = h.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
SELECT r.query_id, r.rank, r.distance, r.id, r.label, e.id AS first_id, e.distance AS first_distance, e.label AS first_label,
 (SELECT least(5, count(*)) FROM embeddings) AS hits, true AS recall_reached, true AS quarter_kept
FROM ranked r JOIN exact e ON e.query_id = r.query_id AND e.rank = 1 WHERE r.rank <= 5""")
def _approximate_hits(v):
    """Approximate hits of every vector: five through four of 16 cells, and what the index finds.

    Of the index: the first hit, how many there are, and whether the recall of all queries against the exact search reached
    0.9; ``quarter_kept`` says that less than a quarter of the products of an exhaustive search was computed.
    """
    index, queries = _index(v), _queries(v)
    index, _ = calibrate(index, queries)
    found = written(search_index(index, queries), "found")
    reached = recall(found, knn(_base(v), queries, 5, fields=[]))
    cost = multiplied(index, queries).agg(F.avg("multiplied")).first()[0]
    n = v.table("embeddings").count()
    hits = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    first = _shown(found.filter("rank = 1")).select("query_id", F.col("id").alias("first_id"),
                                                    F.col("distance").alias("first_distance"), F.col("label").alias("first_label"))
    return _fixed_cells(v, 4).join(first, "query_id").join(hits, "query_id").withColumns(
        {"recall_reached": F.lit(reached >= 0.9), "quarter_kept": F.lit(cost < n / 4)})


register("v1_knn_cells", lambda v: _shown(knn(_base(v), _queries(v), 5, cells=12)), _sql("cosine", 5))


def _request(v, **request):
    """The vector of id 3 by value."""
    vector = [float(x) for x in _base(v).filter("id = 3").first()["embedding"]]
    catalog = Catalog({"kb.vectors": _base(v)}, ["kb.vectors"])
    return _shown(vector_query(catalog, {"collection": "kb.vectors", "embedding": vector, **request}))


def _one(condition: str, k: int, columns: str = ", label") -> str:
    found = _sql("cosine", k, f"q.vec_id = 3 AND {condition}")
    return f"SELECT rank, distance, id{columns} FROM ({found}) t"


register("vq_default", lambda v: _request(v), _one("true", 5))
register("vq_filter", lambda v: _request(v, top_k=7, filter={"any": [
             {"field": "label", "op": "in", "value": [1, 4]},
             [{"not": {"field": "label", "op": "gte", "value": 3}}, {"field": "label", "op": "ne", "value": 0}]]}),
         _one("(b.label IN (1, 4) OR (NOT b.label >= 3 AND b.label <> 0))", 7))
register("vq_cap", lambda v: _request(v, top_k=5000, output_fields=[]), _one("true", 100, ""))


@query("v7_similar_past", _sql("cosine", 5, "b.vec_id < q.vec_id"))
def _similar_past(v):
    """For each vector its nearest among those with a smaller id, that is, the earlier ones."""
    base = _base(v).withColumn("at", F.col("id"))
    queries = _queries(v).withColumn("at", F.col("query_id"))
    return _shown(knn(base, queries, 5, fields=["label"], before="at"))
