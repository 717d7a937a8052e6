"""The vector request: collection, embedding, top_k, filter and output fields, as a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.knn import DEFAULT_K, knn
from flowlens.plans.catalog import Catalog
from flowlens.plans.olap import predicate
from flowlens.plans.request import Filter, RequestError

#: Fixed value: neighbours of one request at most, unless the server lifts it.
TOP_K_CAP = 100


def filter_condition(raw: list | dict, types: dict[str, T.DataType]) -> Column:
    """The filter of a vector request over columns of these types.

    A request filter (``field``, ``op``, ``value``, as in a traffic request), a list of filters that must all hold,
    ``{"any": [...]}`` of which one must hold, or ``{"not": ...}``; these may contain one another.
    """
    if isinstance(raw, list):
        return reduce(lambda a, b: a & b, [filter_condition(r, types) for r in raw], F.lit(True))
    if not isinstance(raw, dict):
        raise RequestError("a filter is an object or a list of them")
    if set(raw) == {"any"}:
        if not isinstance(raw["any"], list):
            raise RequestError("any needs a list")
        return reduce(lambda a, b: a | b, [filter_condition(r, types) for r in raw["any"]], F.lit(False))
    if set(raw) == {"not"}:
        return ~filter_condition(raw["not"], types)
    f = Filter.parse(raw)
    if f.field not in types:
        raise RequestError(f"no column {f.field!r}")
    return predicate(F.col(f.field), types[f.field], f)


def capped_top_k(top_k: int | None, cap: int | None = TOP_K_CAP) -> int:
    """The neighbours a request gets: DEFAULT_K unless it names a number, at least 1, at most ``cap`` (None lifts it)."""
    if top_k is None:
        return DEFAULT_K
    if isinstance(top_k, bool) or not isinstance(top_k, int):
        raise RequestError("top_k must be a whole number")
    return max(1, top_k if cap is None else min(top_k, cap))


def vector_query(catalog: Catalog, request: dict, cap: int | None = TOP_K_CAP, id_col: str = "id",
                 vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The neighbours of one vector: rank, distance, the id and ``output_fields`` (all others when missing).

    ``request``: ``collection`` (must be allowed), ``embedding`` (list of numbers), and optionally ``top_k``,
    ``filter`` (:func:`filter_condition`) and ``output_fields``.
    """
    unknown = set(request) - {"collection", "embedding", "top_k", "filter", "output_fields"}
    if unknown:
        raise RequestError(f"unknown fields: {sorted(unknown)}")
    name, embedding = request.get("collection"), request.get("embedding")
    if not isinstance(name, str):
        raise RequestError("collection must be a name")
    catalog.check([name])
    if not isinstance(embedding, list) or not embedding or not all(
            isinstance(x, (int, float)) and not isinstance(x, bool) for x in embedding):
        raise RequestError("embedding must be a list of numbers")
    base = catalog.view(name)
    types = {f.name: f.dataType for f in base.schema.fields}
    fields = request.get("output_fields")
    if fields is not None:
        missing = [f for f in fields if f not in types]
        if missing:
            raise RequestError(f"no columns {missing}")
    where = filter_condition(request["filter"], types) if request.get("filter") else None
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField(vector, T.ArrayType(T.DoubleType()))])
    query = base.sparkSession.createDataFrame([(0, [float(x) for x in embedding])], schema)
    found = knn(base, query, capped_top_k(request.get("top_k"), cap), metric, where=where, fields=fields, id_col=id_col,
                vector=vector)
    return found.drop("query_id")
