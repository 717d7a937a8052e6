"""Request parsing, the catalog, and OLAP semantics on small tables with NULLs and copies."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowlens.plans.catalog import Catalog
from flowlens.plans.olap import olap_query, olap_result
from flowlens.plans.request import OlapRequest, RequestError

COUNT = [{"agg": "count", "field": "*", "alias": "hits"}]


def _base(**more):
    return {"collection": "net.flows", **more}


@pytest.mark.parametrize("bad", [
    {},
    {"collection": "net.flows;drop"},
    {"collection": "net..flows"},
    _base(dimensions=["src_ip; DROP TABLE x"]),
    _base(dimensions=["a.b.c"]),
    _base(dimensions=["größe"]),
    _base(dimensions="src_ip"),
    _base(metrics=[{"agg": "median", "field": "x", "alias": "m"}]),
    _base(metrics=[{"agg": "sum", "field": "*", "alias": "m"}]),
    _base(metrics=[{"agg": "sum", "field": "x", "alias": "a b"}]),
    _base(metrics=[{"agg": "sum", "field": "x"}]),
    _base(filters=[{"field": "x", "op": "between", "value": 1}]),
    _base(filters=[{"field": "x", "op": "eq"}]),
    _base(filters=[{"field": "x", "op": "eq", "value": [1, 2]}]),
    _base(filters=[{"field": "x", "op": "in", "value": [[1]]}]),
    _base(filters=[{"field": "x", "op": "eq", "value": {"a": 1}}]),
    _base(joins=[{"collection": "net.events", "kind": "inner"}]),
    _base(joins=[{"collection": "net.events", "kind": "semi", "on": [{"left": "a", "right": "a"}]}]),
    _base(joins=[{"collection": "net.events", "alias": "x y", "on": [{"left": "a", "right": "a"}]}]),
    _base(joins=[{"collection": "net.flows", "on": [{"left": "a", "right": "a"}]}]),
    _base(order_by=[{"field": "x", "dir": "up"}]),
    _base(limit=-1),
    _base(limit=True),
])
def test_malformed_requests_are_refused(bad):
    with pytest.raises(RequestError):
        OlapRequest.parse(bad)


def test_accepted_spellings():
    req = OlapRequest.parse(_base(
        dimensions=["src_ip", "se.label"],
        filters=[{"field": "a", "op": "i_like", "value": "%x%"}, {"field": "b", "op": "is_null"}],
        joins=[{"collection": "net.security_events", "alias": "se", "on": [{"left": "a", "right": "b"}]},
               {"collection": "net.other", "kind": "cross", "on": []}],
        order_by=[{"field": "src_ip"}], unknown_key=1,
    ))
    assert [f.op for f in req.main.filters] == ["ilike", "is_null"]
    assert [j.alias for j in req.main.joins] == ["se", "other"]
    assert [j.kind for j in req.main.joins] == ["inner", "cross"]
    assert req.collections == ("net.flows", "net.security_events", "net.other")


@pytest.fixture(scope="module")
def small(spark):
    left = [(1, "a", 1.5, 10), (1, "a", 2.5, None), (2, "b", None, 30), (None, "c", 4.0, 40), (3, "O'Neil\\", 0.5, 50)]
    right = [(1, "x", 7), (1, "y", None), (2, "x", 9), (None, "z", 1), (4, "w", 2)]
    return Catalog(
        {"t.left": spark.createDataFrame(left, "k int, name string, v double, n bigint"),
         "t.right": lambda: spark.createDataFrame(right, "k int, tag string, w int"),
         "t.hidden": spark.createDataFrame([(1,)], "k int")},
        allowed=["t.left", "t.right"], row_cap=100,
    )


def _rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def _names(catalog, *filters, **more):
    found = olap_query(catalog, {"collection": "t.left", "dimensions": ["name"], "filters": list(filters), **more})
    return sorted(r["name"] for r in found.collect())


def _f(field, op, value=None):
    return {"field": field, "op": op, "value": value}


def test_filters_on_nulls_and_literals(small):
    assert _names(small, _f("k", "is_null")) == ["c"]
    assert _names(small, _f("k", "ne", 1)) == ["O'Neil\\", "b"]
    assert _names(small, _f("k", "not_in", [1, 2])) == ["O'Neil\\"]
    assert _names(small, _f("k", "in", [])) == []
    assert len(_names(small, _f("k", "not_in", []))) == 5
    assert _names(small, _f("k", "not_in", [1, None])) == []
    assert _names(small, _f("k", "eq", None)) == []
    assert _names(small, _f("k", "eq", True)) == ["a", "a"]
    assert _names(small, _f("k", "eq", "2")) == ["b"]
    assert _names(small, _f("k", "gt", 1.5)) == ["O'Neil\\", "b"]
    assert _names(small, _f("k", "eq", 1.5)) == []
    assert _names(small, _f("k", "lt", 10**12)) == ["O'Neil\\", "a", "a", "b"]
    assert _names(small, _f("n", "eq", 30.0)) == ["b"]
    assert _names(small, _f("name", "eq", "O'Neil\\")) == ["O'Neil\\"]
    assert _names(small, _f("name", "like", "O'%")) == ["O'Neil\\"]
    assert _names(small, _f("name", "like", "A")) == []
    assert _names(small, _f("name", "ilike", "A")) == ["a", "a"]
    with pytest.raises(RequestError):
        _names(small, _f("k", "eq", "many"))
    with pytest.raises(RequestError):
        _names(small, _f("nowhere", "eq", 1))


def test_projection_keeps_duplicates_and_star_gives_all(small):
    assert _names(small).count("a") == 2
    assert olap_query(small, {"collection": "t.left"}).columns == ["k", "name", "v", "n"]


def test_order_puts_nulls_last_both_ways(small):
    for direction, expect in (("asc", [0.5, 1.5, 2.5, 4.0, None]), ("desc", [4.0, 2.5, 1.5, 0.5, None])):
        found = olap_query(small, {"collection": "t.left", "dimensions": ["v"],
                                   "order_by": [{"field": "v", "dir": direction}]})
        assert [r["v"] for r in found.collect()] == expect


def test_alias_may_hide_a_source_column(small):
    found = olap_query(small, {
        "collection": "t.left", "dimensions": ["name"], "filters": [_f("n", "gte", 30)],
        "metrics": [{"agg": "sum", "field": "v", "alias": "n"}], "order_by": [{"field": "n", "dir": "desc"}]})
    assert [tuple(r) for r in found.collect()] == [("c", 4.0), ("O'Neil\\", 0.5), ("b", None)]


JOIN = {"collection": "t.right", "alias": "r", "on": [{"left": "k", "right": "k"}]}


@pytest.mark.parametrize("kind,expect", [
    ("inner", [("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")]),
    ("left", [("O'Neil\\", None), ("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("c", None)]),
    ("right", [(None, "w"), (None, "z"), ("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")]),
])
def test_join_kinds(small, kind, expect):
    found = olap_query(small, {"collection": "t.left", "dimensions": ["name", "tag"], "joins": [{**JOIN, "kind": kind}]})
    assert _rows(found) == sorted(expect, key=repr)


def test_full_and_cross_sizes(small):
    def size(**join):
        return olap_query(small, {"collection": "t.left", "dimensions": ["name", "r.tag"], "joins": [join]}).count()

    assert size(**{**JOIN, "kind": "full"}) == 9
    assert size(collection="t.right", alias="r", kind="cross") == 25
    total = olap_query(small, {"collection": "t.left", "metrics": COUNT,
                               "joins": [{"collection": "t.right", "alias": "r", "kind": "cross"}]})
    assert total.first()["hits"] == 25


def test_star_over_a_join_keeps_both_sides(small):
    found = olap_query(small, {"collection": "t.left", "joins": [JOIN]})
    assert found.columns == ["k", "name", "v", "n", "r_k", "tag", "w"]


def test_join_filter_after_left_join(small):
    request = {"collection": "t.left", "dimensions": ["name", "r.tag"],
               "joins": [{**JOIN, "kind": "left", "filters": [_f("tag", "eq", "x")]}]}
    assert _rows(olap_query(small, request)) == [("a", "x"), ("a", "x"), ("b", "x")]
    request["joins"][0]["filters"] = [_f("tag", "is_null")]
    assert _rows(olap_query(small, request)) == [("O'Neil\\", None), ("c", None)]
    request["joins"][0]["filters"] = [_f("tag", "eq", "")]
    assert _rows(olap_query(small, request, fill_defaults=True)) == [("O'Neil\\", ""), ("c", "")]


def test_fill_defaults_in_metrics(small):
    request = {"collection": "t.left", "dimensions": ["name"], "joins": [{**JOIN, "kind": "left"}],
               "metrics": [{"agg": "count", "field": "r.w", "alias": "c"}, {"agg": "sum", "field": "r.w", "alias": "s"},
                           {"agg": "avg", "field": "r.w", "alias": "a"}, {"agg": "min", "field": "r.w", "alias": "m"}]}
    plain = {r["name"]: tuple(r)[1:] for r in olap_query(small, request).collect()}
    filled = {r["name"]: tuple(r)[1:] for r in olap_query(small, request, fill_defaults=True).collect()}
    assert plain["c"] == (0, None, None, None)
    assert filled["c"] == (1, 0, 0.0, 0)
    assert plain["a"] == (2, 14, 7.0, 7)


def test_names_must_resolve(small):
    for dims in (["r.nothing"], ["q.k"], ["nothing"]):
        with pytest.raises(RequestError):
            olap_query(small, {"collection": "t.left", "dimensions": dims, "joins": [JOIN]})
    two = [JOIN, {**JOIN, "alias": "s"}]
    with pytest.raises(RequestError):
        olap_query(small, {"collection": "t.left", "dimensions": ["tag"], "joins": two})
    assert olap_query(small, {"collection": "t.left", "dimensions": ["r.tag", "s.tag"], "joins": two}).columns == [
        "r_tag", "s_tag"]


def test_every_collection_meets_the_allowlist(small):
    for request in (
        {"collection": "t.hidden"},
        {"collection": "t.left", "joins": [{**JOIN, "collection": "t.hidden"}]},
        {"collection": "t.left", "dimensions": ["k"], "union_all": [{"collection": "t.hidden", "dimensions": ["k"]}]},
    ):
        with pytest.raises(RequestError):
            olap_query(small, request)


def test_allowlist_refresh(spark):
    views = {"a": spark.range(1), "b": spark.range(2)}
    with pytest.raises(RequestError):
        olap_query(Catalog(views, None), {"collection": "a"})
    catalog = Catalog(views, ["b", "a"])
    assert catalog.collections() == ["a", "b"]

    def failing():
        raise OSError("unreachable")

    assert not catalog.refresh(failing) and catalog.collections() == ["a", "b"]
    assert catalog.refresh(lambda: ["b"]) and catalog.collections() == ["b"]
    assert catalog.refresh(lambda: None) and catalog.collections() == []


def test_union_checks(small):
    with pytest.raises(RequestError):
        olap_query(small, {"collection": "t.left", "dimensions": ["k"], "union_all": [{"dimensions": ["k", "v"]}]})
    found = olap_query(small, {
        "collection": "t.left", "dimensions": ["name"], "joins": [JOIN], "limit": 3,
        "union_all": [{"collection": "t.right", "dimensions": ["tag"]}], "order_by": [{"field": "name", "dir": "desc"}]})
    assert found.columns == ["name"]
    assert [r["name"] for r in found.collect()] == ["z", "y", "x"]


def test_envelope_and_cap(small):
    small.row_cap = 3
    try:
        whole = olap_result(small, {"collection": "t.left", "dimensions": ["name"], "limit": 10})
        part = olap_result(small, {"collection": "t.left", "dimensions": ["name"], "limit": 2})
    finally:
        small.row_cap = 100
    assert (whole["row_count"], whole["truncated"]) == (3, True)
    assert (part["row_count"], part["truncated"]) == (2, False)
    assert whole["columns"] == ["name"] and "Project" in whole["compiled_query"]
    with pytest.raises(ValueError):
        olap_result(Catalog({}, [], row_cap=None), {"collection": "a"})


# --------------------------------------------------------------------------- against brute force


def _brute_join(left, right, kind, late):
    out = []
    hit_right = set()
    for l in left:
        found = [i for i, r in enumerate(right) if l["k"] is not None and l["k"] == r["k"]]
        hit_right.update(found)
        out += [(l, right[i]) for i in found]
        if not found and kind in ("left", "full"):
            out.append((l, None))
    if kind in ("right", "full"):
        out += [(None, r) for i, r in enumerate(right) if i not in hit_right]
    if late is not None:
        out = [p for p in out if p[1] is not None and p[1]["g"] is not None and p[1]["g"] != late]
    return out


def _value(pair, side, name):
    row = pair[side]
    return None if row is None else row[name]


@pytest.mark.parametrize("kind,late", list(itertools.product(["inner", "left", "right", "full"], [None, "q"])))
def test_joined_metrics_equal_brute_force(spark, kind, late):
    """A third of both sides shares one key; the weighted partial sums must give the plain join's results."""
    rng = random.Random(f"{kind}{late}")

    def table(n):
        return [{"k": rng.choice([0, 0, None, *range(1, 9)]), "g": rng.choice(["p", "q", None]),
                 "x": rng.choice([None, 1, 2, 5]), "y": rng.choice([None, 0.5, 2.25])} for _ in range(n)]

    left, right = table(60), table(50)
    schema = "k int, g string, x bigint, y double"
    make = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    catalog = Catalog({"l": make(left), "r": make(right)}, ["l", "r"], row_cap=None)
    request = {
        "collection": "l", "dimensions": ["l.g", "r.g"],
        "metrics": COUNT + [
            {"agg": a, "field": f, "alias": f"{a}_{f.replace('.', '_')}"}
            for a in ("count", "count_distinct", "sum", "avg", "min", "max") for f in ("l.x", "r.y")],
        "joins": [{"collection": "r", "kind": kind, "on": [{"left": "k", "right": "k"}],
                   "filters": [_f("g", "ne", late)] if late else []}],
    }
    got = {(r["l_g"], r["r_g"]): tuple(r)[2:] for r in olap_query(catalog, request).collect()}
    expect = {}
    for pair in _brute_join(left, right, kind, late):
        expect.setdefault((_value(pair, 0, "g"), _value(pair, 1, "g")), []).append(pair)
    assert got.keys() == expect.keys()
    for key, pairs in expect.items():
        row = [len(pairs)]
        columns = [[v for p in pairs if (v := _value(p, side, f)) is not None] for side, f in ((0, "x"), (1, "y"))]
        for fn in (len, lambda v: len(set(v)), lambda v: sum(v) if v else None,
                   lambda v: sum(v) / len(v) if v else None, lambda v: min(v, default=None),
                   lambda v: max(v, default=None)):
            row += [fn(c) for c in columns]
        assert got[key] == pytest.approx(tuple(row)), key


@pytest.mark.parametrize("kind", ["inner", "left", "full"])
def test_limited_join_rows_equal_brute_force(spark, kind):
    """Rows cut per key before the join must not change the first rows of the result."""
    rng = random.Random(kind)
    table = lambda n: [{"k": rng.choice([0, 0, 0, *range(1, 6)]), "g": None, "x": rng.randrange(40), "y": None}
                       for _ in range(n)]
    left, right = table(120), table(110)
    make = lambda rows: spark.createDataFrame([(r["k"], r["x"]) for r in rows], "k int, x int")
    catalog = Catalog({"l": make(left), "r": make(right)}, ["l", "r"], row_cap=50)
    found = olap_query(catalog, {
        "collection": "l", "dimensions": ["l.x", "r.x"], "limit": 37,
        "joins": [{"collection": "r", "kind": kind, "on": [{"left": "k", "right": "k"}]}],
        "order_by": [{"field": "l_x", "dir": "desc"}, {"field": "r_x"}]})
    pairs = [(_value(p, 0, "x"), _value(p, 1, "x")) for p in _brute_join(left, right, kind, None)]
    pairs.sort(key=lambda p: (p[0] is None, -(p[0] or 0), p[1] is None, p[1] or 0))
    assert [tuple(r) for r in found.collect()] == pairs[:37]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hot_join_key_stays_small(spark):
    """20,000 rows of one key on both sides: 400 million pairs are counted, not built."""
    hot = spark.range(20000).select(F.lit("h").alias("k"), (F.col("id") % 7).alias("g"))
    catalog = Catalog({"l": hot, "r": hot}, ["l", "r"])
    on = [{"left": "k", "right": "k"}]
    found = olap_query(catalog, {"collection": "l", "metrics": COUNT, "joins": [{"collection": "r", "on": on}]})
    assert found.first()["hits"] == 20000**2
    rows = olap_query(catalog, {"collection": "l", "dimensions": ["l.g", "r.g"], "limit": 5,
                                "joins": [{"collection": "r", "on": on}],
                                "order_by": [{"field": "l_g"}, {"field": "r_g", "dir": "desc"}]})
    assert [tuple(r) for r in rows.collect()] == [(0, 6)] * 5
