"""The declarative OLAP request: what to compute, as plain values.

``OlapRequest.parse`` takes the JSON object (a dict) and checks its shape and names; columns are looked
up later, against the schemas of the views.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

AGGREGATIONS = ("count", "count_distinct", "sum", "avg", "min", "max")
JOIN_KINDS = ("inner", "left", "right", "full", "cross")
FILTER_OPS = (
    "eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "like", "ilike", "is_null", "is_not_null",
)
OP_ALIASES = {"i_like": "ilike"}
NULL_OPS = ("is_null", "is_not_null")
LIST_OPS = ("in", "not_in")

_NAME = re.compile(r"[A-Za-z0-9_]+\Z")


class RequestError(ValueError):
    """The request is malformed, or names something that does not exist or is not allowed."""


def check_name(name: Any, what: str) -> str:
    """An ASCII identifier."""
    if not isinstance(name, str) or not _NAME.match(name):
        raise RequestError(f"{what} {name!r} must consist of [a-zA-Z0-9_]")
    return name


def check_field(name: Any, what: str = "field") -> str:
    """A column, or ``alias.column``."""
    if not isinstance(name, str):
        raise RequestError(f"{what} {name!r} must be text")
    parts = name.split(".")
    if len(parts) > 2:
        raise RequestError(f"{what} {name!r} has more than one qualifier")
    for part in parts:
        check_name(part, what)
    return name


def check_collection(name: Any) -> str:
    if not isinstance(name, str):
        raise RequestError(f"collection {name!r} must be text")
    for part in name.split("."):
        check_name(part, "collection")
    return name


def _choice(value: Any, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise RequestError(f"{what} {value!r} is not one of {', '.join(allowed)}")
    return value


def _items(raw: dict, key: str) -> list:
    value = raw.get(key, [])
    if not isinstance(value, list):
        raise RequestError(f"{key} must be a list")
    return value


def _need(raw: Any, key: str, what: str) -> Any:
    if not isinstance(raw, dict) or key not in raw:
        raise RequestError(f"{what} needs {key!r}")
    return raw[key]


@dataclass(frozen=True)
class Metric:
    agg: str
    field: str
    alias: str

    @staticmethod
    def parse(raw: dict) -> Metric:
        agg = _choice(_need(raw, "agg", "metric"), AGGREGATIONS, "aggregation")
        name = _need(raw, "field", "metric")
        if name == "*" and agg != "count":
            raise RequestError(f"'*' is for count only, not {agg}")
        return Metric(
            agg,
            name if name == "*" else check_field(name),
            check_name(_need(raw, "alias", "metric"), "alias"),
        )


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None

    @staticmethod
    def parse(raw: dict) -> Filter:
        name = check_field(_need(raw, "field", "filter"))
        op = _need(raw, "op", "filter")
        op = _choice(OP_ALIASES.get(op, op) if isinstance(op, str) else op, FILTER_OPS, "operator")
        value = raw.get("value") if op in NULL_OPS else _need(raw, "value", "filter")
        if isinstance(value, dict) or (isinstance(value, list) and op not in LIST_OPS):
            raise RequestError(f"operator {op} does not take {type(value).__name__}")
        if isinstance(value, list) and any(isinstance(v, (list, dict)) for v in value):
            raise RequestError("a value list holds plain values only")
        return Filter(name, op, value)


@dataclass(frozen=True)
class JoinOn:
    left: str
    right: str


@dataclass(frozen=True)
class Join:
    collection: str
    alias: str
    kind: str
    on: tuple[JoinOn, ...]
    filters: tuple[Filter, ...]

    @staticmethod
    def parse(raw: dict) -> Join:
        collection = check_collection(_need(raw, "collection", "join"))
        kind = _choice(raw.get("kind", "inner"), JOIN_KINDS, "join kind")
        on = tuple(
            JoinOn(
                check_field(_need(c, "left", "join condition")),
                check_name(_need(c, "right", "join condition"), "right column"),
            )
            for c in _items(raw, "on")
        )
        if kind == "cross":
            on = ()
        elif not on:
            raise RequestError(f"a {kind} join needs at least one 'on' pair")
        alias = raw.get("alias") or collection.split(".")[-1]
        filters = tuple(Filter.parse(f) for f in _items(raw, "filters"))
        return Join(collection, check_name(alias, "alias"), kind, on, filters)


@dataclass(frozen=True)
class OrderBy:
    field: str
    descending: bool = False

    @staticmethod
    def parse(raw: dict) -> OrderBy:
        direction = _choice(raw.get("dir", "asc"), ("asc", "desc"), "direction")
        return OrderBy(check_field(_need(raw, "field", "order_by")), direction == "desc")


@dataclass(frozen=True)
class Branch:
    """One SELECT: the request itself, or one member of ``union_all``."""

    collection: str
    alias: str
    dimensions: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    filters: tuple[Filter, ...] = ()
    joins: tuple[Join, ...] = ()

    @staticmethod
    def parse(raw: dict, collection: str, joins: tuple[Join, ...] = ()) -> Branch:
        alias = raw.get("alias") or collection.split(".")[-1]
        branch = Branch(
            collection,
            check_name(alias, "alias"),
            tuple(check_field(d, "dimension") for d in _items(raw, "dimensions")),
            tuple(Metric.parse(m) for m in _items(raw, "metrics")),
            tuple(Filter.parse(f) for f in _items(raw, "filters")),
            joins,
        )
        aliases = [branch.alias] + [j.alias for j in joins]
        if len(set(aliases)) != len(aliases):
            raise RequestError(f"duplicate aliases in {aliases}; give each join its own alias")
        return branch


@dataclass(frozen=True)
class OlapRequest:
    main: Branch
    union_all: tuple[Branch, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None
    collections: tuple[str, ...] = field(default=())

    @staticmethod
    def parse(raw: dict) -> OlapRequest:
        collection = check_collection(_need(raw, "collection", "request"))
        joins = tuple(Join.parse(j) for j in _items(raw, "joins"))
        main = Branch.parse(raw, collection, joins)
        branches = tuple(
            Branch.parse(u, check_collection(u.get("collection") or collection))
            for u in _items(raw, "union_all")
        )
        limit = raw.get("limit")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
            raise RequestError(f"limit {limit!r} must be a non-negative integer")
        used = [collection] + [j.collection for j in joins] + [b.collection for b in branches]
        return OlapRequest(
            main,
            branches,
            tuple(OrderBy.parse(o) for o in _items(raw, "order_by")),
            limit,
            tuple(dict.fromkeys(used)),
        )
