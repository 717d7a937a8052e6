"""Registered queries for the OLAP request: P*, J*, A*, O1, O2, U*."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.plans.catalog import Catalog
from flowlens.plans.olap import olap_query
from flowlens.suite.registry import query, register
from flowlens.suite.views import Views


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floating columns as doubles with ``digits`` decimals, so that engines compare equal."""
    return df.select(*[
        F.round(F.col(f.name).cast("double"), digits).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def _ask(
    name: str, sql: str, row_cap: int | None = None, fill_defaults: bool = False, digits: int = 4,
    cents: tuple[str, ...] = (), **request
) -> None:
    """Register a request; ``cents`` names sums of amounts with two decimals, compared as whole cents."""
    def run(v: Views) -> DataFrame:
        found = olap_query(v.catalog(row_cap), request, fill_defaults=fill_defaults)
        return rounded(found.withColumns({c: F.round(F.col(c) * 100).cast("bigint") for c in cents}), digits)

    register(name, run, sql)


def _where(field, op, value=None):
    return {"field": field, "op": op, "value": value}


def _metric(agg, field, alias):
    return {"agg": agg, "field": field, "alias": alias}


HITS = _metric("count", "*", "hits")
ID = ["flow_id", "src_ip", "dst_port"]

_ask("p1_project", "SELECT src_ip, dst_port FROM flows",
     collection="net.flows", dimensions=["src_ip", "dst_port"])
register("p2_select_all", lambda v: olap_query(v.catalog(), {"collection": "net.flows"}),
         "SELECT * FROM flows")

for key, op, value, condition in [
    ("p3_eq", "eq", 443, "dst_port = 443"),
    ("p4_ne", "ne", 443, "dst_port <> 443"),
    ("p5_gt", "gt", 80, "dst_port > 80"),
    ("p6_gte", "gte", 80, "dst_port >= 80"),
    ("p7_lt", "lt", 443, "dst_port < 443"),
    ("p8_lte", "lte", 443, "dst_port <= 443"),
    ("p9_in", "in", [22, 53], "dst_port IN (22, 53)"),
    ("p10_not_in", "not_in", [22, 53], "dst_port NOT IN (22, 53)"),
]:
    _ask(key, f"SELECT flow_id, src_ip, dst_port FROM flows WHERE {condition}",
         collection="net.flows", dimensions=ID, filters=[_where("dst_port", op, value)])
_ask("p9_in_scalar", "SELECT flow_id, src_ip, dst_port FROM flows WHERE src_ip = '10.0.0.7'",
     collection="net.flows", dimensions=ID, filters=[_where("src_ip", "in", "10.0.0.7")])
_ask("p11_like", "SELECT flow_id, application_name FROM flows WHERE application_name LIKE 'TLS._hop%'",
     collection="net.flows", dimensions=["flow_id", "application_name"],
     filters=[_where("application_name", "like", "TLS._hop%")])
_ask("p12_ilike", "SELECT flow_id, application_name FROM flows WHERE application_name ILIKE '%dns%'",
     collection="net.flows", dimensions=["flow_id", "application_name"],
     filters=[_where("application_name", "ilike", "%dns%")])
_ask("p13_is_null",
     "SELECT f.flow_id, f.src_ip FROM flows f LEFT JOIN security_events se ON f.flow_id = se.flow_id "
     "WHERE se.label IS NULL",
     collection="net.flows", dimensions=["flow_id", "src_ip"],
     joins=[{"collection": "net.security_events", "alias": "se", "kind": "left",
             "on": [{"left": "flow_id", "right": "flow_id"}], "filters": [_where("label", "is_null")]}])
_ask("p14_is_not_null", "SELECT flow_id, src_ip FROM flows WHERE src_ip IS NOT NULL",
     collection="net.flows", dimensions=["flow_id", "src_ip"], filters=[_where("src_ip", "is_not_null")])
_ask("p15_and",
     "SELECT flow_id, src_ip, dst_port FROM flows WHERE dst_port >= 80 AND protocol = 6 "
     "AND packets_per_second > 1.5 AND src_ip LIKE '10.0.0.1%'",
     collection="net.flows", dimensions=ID,
     filters=[_where("dst_port", "gte", 80), _where("protocol", "eq", 6.0),
              _where("packets_per_second", "gt", 1.5), _where("src_ip", "like", "10.0.0.1%")])
_ask("p16_literal_types",
     "SELECT flow_id, src_ip FROM classified_flows WHERE is_threat = 1 AND dst_port > 79.5 "
     "AND confidence >= cast(0.9 AS float) AND collected_at >= TIMESTAMP '2024-01-10 00:00:00'",
     collection="net.classified_flows", dimensions=["flow_id", "src_ip"],
     filters=[_where("is_threat", "eq", True), _where("dst_port", "gt", 79.5),
              _where("confidence", "gte", 0.9), _where("collected_at", "gte", "2024-01-10T00:00:00Z")])

# Columns of other types: prices with two decimals and days, from the stored doubles and timestamps.
_TYPED = ("SELECT o_orderkey, cast(round(o_totalprice * 100) AS bigint) AS cents, "
          "cast(o_totalprice AS decimal(12,2)) AS price, cast(o_orderdate AS date) AS day FROM {orders}")


def _typed(name: str, condition: str, *filters: dict) -> None:
    def run(v: Views) -> DataFrame:
        orders = v.spark.sql(_TYPED, orders=v.table("orders"))
        found = olap_query(Catalog({"shop.typed": orders}, ["shop.typed"], None),
                           {"collection": "shop.typed", "dimensions": ["o_orderkey", "cents"], "filters": list(filters)})
        return found

    register(name, run, f"SELECT o_orderkey, cents FROM ({_TYPED.format(orders='orders')}) t WHERE {condition}")


_typed("p16_decimal", "price > 150000.005 AND price <> 200000.004 AND price <= 300000.999",
       _where("price", "gt", 150000.005), _where("price", "ne", "200000.004"), _where("price", "lte", 300000.999))
_typed("p16_date_time", "cast(day AS timestamp) < TIMESTAMP '1996-01-10 12:00:00' AND day >= DATE '1995-06-17'",
       _where("day", "lt", "1996-01-10T12:00:00Z"), _where("day", "gte", "1995-06-17"))

# ------------------------------------------------------------------ joins

ON_ID = [{"left": "flow_id", "right": "flow_id"}]

_ask("j1_inner",
     "SELECT f.flow_id, f.src_ip, cf.label, round(cast(cf.confidence AS double), 4) AS confidence "
     "FROM flows f JOIN classified_flows cf ON f.flow_id = cf.flow_id",
     collection="net.flows", dimensions=["flow_id", "src_ip", "cf.label", "cf.confidence"],
     joins=[{"collection": "net.classified_flows", "alias": "cf", "on": ON_ID}])
_ask("j1_inner_metrics",
     "SELECT cf.label, count(*) AS hits, count(f.src_port) AS ports, "
     "cast(sum(f.bidirectional_bytes) AS bigint) AS bytes, round(avg(f.packets_per_second), 4) AS pps, "
     "min(cf.dst_port) AS low, max(f.bidirectional_packets) AS high, "
     "count(DISTINCT f.dst_ip) AS targets "
     "FROM flows f JOIN classified_flows cf ON f.src_ip = cf.src_ip AND f.dst_port = cf.dst_port "
     "GROUP BY cf.label",
     collection="net.flows", dimensions=["cf.label"],
     metrics=[HITS, _metric("count", "src_port", "ports"), _metric("sum", "bidirectional_bytes", "bytes"),
              _metric("avg", "packets_per_second", "pps"), _metric("min", "cf.dst_port", "low"),
              _metric("max", "bidirectional_packets", "high"), _metric("count_distinct", "dst_ip", "targets")],
     joins=[{"collection": "net.classified_flows", "alias": "cf",
             "on": [{"left": "src_ip", "right": "src_ip"}, {"left": "dst_port", "right": "dst_port"}]}])
_ask("j2_left",
     "SELECT f.flow_id, se.label FROM flows f LEFT JOIN security_events se ON f.flow_id = se.flow_id",
     collection="net.flows", dimensions=["flow_id", "se.label"],
     joins=[{"collection": "net.security_events", "alias": "se", "kind": "left", "on": ON_ID}])
_ask("j2_left_defaults",
     "SELECT f.flow_id, coalesce(se.label, '') AS label FROM flows f "
     "LEFT JOIN security_events se ON f.flow_id = se.flow_id",
     fill_defaults=True,
     collection="net.flows", dimensions=["flow_id", "se.label"],
     joins=[{"collection": "net.security_events", "alias": "se", "kind": "left", "on": ON_ID}])

_NULLED = "SELECT flow_id, src_ip, CASE WHEN dst_port = 443 THEN NULL ELSE dst_port END AS port FROM {events}"


def _nulled(name: str, sql: str, row_cap: int | None = None, **request) -> None:
    """Flows left-joined with events, whose own port is sometimes NULL; only misses take the default."""
    def run(v: Views) -> DataFrame:
        catalog = Catalog({"net.flows": v.flows, "net.ports": v.spark.sql(_NULLED, events=v.security_events)},
                          ["net.flows", "net.ports"], row_cap)
        return olap_query(catalog, request, fill_defaults=True)

    register(name, run, sql)


_PORTS = [{"collection": "net.ports", "alias": "p", "kind": "left", "on": ON_ID}]
_PORT_SQL = ("SELECT f.flow_id, CASE WHEN p.flow_id IS NULL THEN 0 ELSE p.port END AS port FROM flows f LEFT JOIN ("
             + _NULLED.format(events="security_events") + ") p ON f.flow_id = p.flow_id")
_nulled("j2_left_defaults_nulls", _PORT_SQL, collection="net.flows", dimensions=["flow_id", "p.port"], joins=_PORTS)
_nulled("j2_defaults_limited", f"SELECT * FROM ({_PORT_SQL}) t ORDER BY port NULLS LAST, flow_id LIMIT 300",
        row_cap=1000, collection="net.flows", dimensions=["flow_id", "p.port"], joins=_PORTS,
        order_by=[{"field": "port"}, {"field": "flow_id"}], limit=300)
_ask("j2_left_metrics",
     "SELECT f.application_name, count(*) AS hits, count(se.confidence) AS scored, "
     "round(avg(cast(se.confidence AS double)), 4) AS confidence, "
     "cast(coalesce(sum(se.bidirectional_packets), 0) AS bigint) AS packets "
     "FROM flows f LEFT JOIN security_events se ON f.flow_id = se.flow_id GROUP BY f.application_name",
     collection="net.flows", dimensions=["application_name"],
     metrics=[HITS, _metric("count", "se.confidence", "scored"), _metric("avg", "se.confidence", "confidence"),
              _metric("sum", "se.bidirectional_packets", "packets")],
     joins=[{"collection": "net.security_events", "alias": "se", "kind": "left", "on": ON_ID}])
_ask("j3_right",
     "SELECT se.label, f.flow_id FROM security_events se RIGHT JOIN flows f ON se.flow_id = f.flow_id",
     collection="net.security_events", alias="se", dimensions=["label", "f.flow_id"],
     joins=[{"collection": "net.flows", "alias": "f", "kind": "right", "on": ON_ID}])
_ask("j4_full",
     "SELECT f.src_ip, r.dst_ip, f.dst_port FROM flows f FULL JOIN repeat_flows r ON f.flow_id = r.flow_id",
     collection="net.flows", dimensions=["src_ip", "r.dst_ip", "dst_port"],
     joins=[{"collection": "net.repeat_flows", "alias": "r", "kind": "full", "on": ON_ID}])
_ask("j4_full_metrics",
     "SELECT f.application_name, r.dst_port, count(*) AS hits, "
     "cast(sum(f.bidirectional_bytes) AS bigint) AS bytes, max(r.bidirectional_packets) AS packets "
     "FROM flows f FULL JOIN repeat_flows r ON f.flow_id = r.flow_id GROUP BY 1, 2",
     collection="net.flows", dimensions=["application_name", "r.dst_port"],
     metrics=[HITS, _metric("sum", "bidirectional_bytes", "bytes"),
              _metric("max", "r.bidirectional_packets", "packets")],
     joins=[{"collection": "net.repeat_flows", "alias": "r", "kind": "full", "on": ON_ID}])
_ask("j5_cross",
     "SELECT r.r_name, n.n_name, n.n_regionkey FROM region r CROSS JOIN nation n",
     collection="shop.region", dimensions=["r_name", "n.n_name", "n.n_regionkey"],
     joins=[{"collection": "shop.nation", "alias": "n", "kind": "cross"}])
_ask("j5_cross_metrics",
     "SELECT f.application_name, r.r_name, count(*) AS hits, "
     "cast(sum(f.bidirectional_packets) AS bigint) AS packets "
     "FROM flows f CROSS JOIN region r GROUP BY 1, 2",
     collection="net.flows", dimensions=["application_name", "r.r_name"],
     metrics=[HITS, _metric("sum", "bidirectional_packets", "packets")],
     joins=[{"collection": "shop.region", "alias": "r", "kind": "cross"}])
_ask("j6_several_pairs",
     "SELECT f.flow_id, r.src_port AS src_port FROM flows f JOIN repeat_flows r "
     "ON f.src_ip = r.src_ip AND f.dst_ip = r.dst_ip AND f.collected_at = r.collected_at",
     collection="net.flows", dimensions=["flow_id", "r.src_port"],
     joins=[{"collection": "net.repeat_flows", "alias": "r",
             "on": [{"left": c, "right": c} for c in ("src_ip", "dst_ip", "collected_at")]}])
_ask("j7_join_sequence",
     "SELECT n.n_name, count(*) AS n_lines, cast(round(sum(l.l_extendedprice) * 100) AS bigint) AS revenue, "
     "round(avg(l.l_discount), 6) AS discount, count(DISTINCT o.o_custkey) AS customers "
     "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
     "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
     "GROUP BY n.n_name",
     digits=6, cents=("revenue",), collection="shop.lineitem", dimensions=["n.n_name"],
     metrics=[_metric("count", "*", "n_lines"), _metric("sum", "l_extendedprice", "revenue"),
              _metric("avg", "l_discount", "discount"), _metric("count_distinct", "o.o_custkey", "customers")],
     joins=[{"collection": "shop.orders", "alias": "o", "on": [{"left": "l_orderkey", "right": "o_orderkey"}]},
            {"collection": "shop.customer", "alias": "c", "on": [{"left": "o_custkey", "right": "c_custkey"}]},
            {"collection": "shop.nation", "alias": "n", "on": [{"left": "c_nationkey", "right": "n_nationkey"}]}])
_ask("j8_default_alias",
     "SELECT f.src_ip, cf.label AS label, count(*) AS hits FROM flows f "
     "JOIN classified_flows cf ON f.flow_id = cf.flow_id GROUP BY 1, 2",
     collection="net.flows", dimensions=["src_ip", "classified_flows.label"], metrics=[HITS],
     joins=[{"collection": "net.classified_flows", "on": ON_ID}])
_ask("j9_join_filter",
     "SELECT f.flow_id, se.label FROM flows f LEFT JOIN security_events se ON f.flow_id = se.flow_id "
     "WHERE se.label = 'DoS' AND f.dst_port >= 80",
     collection="net.flows", dimensions=["flow_id", "se.label"], filters=[_where("dst_port", "gte", 80)],
     joins=[{"collection": "net.security_events", "alias": "se", "kind": "left", "on": ON_ID,
             "filters": [_where("label", "eq", "DoS")]}])
_ask("j9_join_rows_limited",
     "SELECT f.src_ip, cf.dst_ip, cf.src_port FROM flows f "
     "JOIN classified_flows cf ON f.src_ip = cf.src_ip "
     "ORDER BY f.src_ip, cf.src_port DESC, cf.dst_ip LIMIT 500",
     row_cap=1000,
     collection="net.flows", dimensions=["src_ip", "cf.dst_ip", "cf.src_port"],
     joins=[{"collection": "net.classified_flows", "alias": "cf",
             "on": [{"left": "src_ip", "right": "src_ip"}]}],
     order_by=[{"field": "src_ip"}, {"field": "src_port", "dir": "desc"}, {"field": "dst_ip"}], limit=500)

# ------------------------------------------------------------------ aggregates

for key, metric, expression in [
    ("a1_count_star", _metric("count", "*", "m"), "count(*)"),
    ("a2_count_field", _metric("count", "dst_ip", "m"), "count(dst_ip)"),
    ("a3_count_distinct", _metric("count_distinct", "dst_ip", "m"), "count(DISTINCT dst_ip)"),
    ("a4_sum", _metric("sum", "bidirectional_bytes", "m"), "cast(sum(bidirectional_bytes) AS bigint)"),
    ("a4_sum_double", _metric("sum", "packets_per_second", "m"), "round(sum(packets_per_second), 4)"),
    ("a5_avg", _metric("avg", "bidirectional_packets", "m"), "round(avg(bidirectional_packets), 4)"),
    ("a6_min", _metric("min", "collected_at", "m"), "min(collected_at)"),
    ("a7_max", _metric("max", "src_port", "m"), "max(src_port)"),
]:
    _ask(key, f"SELECT src_ip, {expression} AS m FROM flows GROUP BY src_ip",
         collection="net.flows", dimensions=["src_ip"], metrics=[metric])
_ask("a8_group_by",
     "SELECT src_ip, dst_port, application_name, count(*) AS hits, "
     "cast(sum(bidirectional_bytes) AS bigint) AS bytes FROM flows GROUP BY ALL",
     collection="net.flows", dimensions=["src_ip", "dst_port", "application_name"],
     metrics=[HITS, _metric("sum", "bidirectional_bytes", "bytes")])
_ask("a9_global",
     "SELECT count(*) AS hits, count(DISTINCT src_ip) AS sources, "
     "cast(max(bidirectional_bytes) AS bigint) AS most FROM flows",
     collection="net.flows",
     metrics=[HITS, _metric("count_distinct", "src_ip", "sources"), _metric("max", "bidirectional_bytes", "most")])
_ask("a10_alias_of_source_column",
     "SELECT src_ip, max(dst_port) AS dst_port FROM flows WHERE dst_port < 8000 GROUP BY src_ip",
     collection="net.flows", dimensions=["src_ip"], metrics=[_metric("max", "dst_port", "dst_port")],
     filters=[_where("dst_port", "lt", 8000)])

# ------------------------------------------------------------------ order, limit, union

_ask("o1_order_by",
     "SELECT src_ip, dst_port, flow_id FROM flows ORDER BY src_ip, dst_port DESC, flow_id LIMIT 200",
     collection="net.flows", dimensions=["src_ip", "dst_port", "flow_id"],
     order_by=[{"field": "src_ip"}, {"field": "dst_port", "dir": "desc"}, {"field": "flow_id"}], limit=200)
_ask("o1_order_by_unselected",
     "SELECT src_ip, dst_ip FROM flows ORDER BY collected_at DESC, flow_id LIMIT 50",
     collection="net.flows", dimensions=["src_ip", "dst_ip"],
     order_by=[{"field": "collected_at", "dir": "desc"}, {"field": "flow_id"}], limit=50)
_ask("o2_cap",
     "SELECT flow_id, collected_at FROM flows ORDER BY collected_at, flow_id LIMIT 1000",
     row_cap=1000, collection="net.flows", dimensions=["flow_id", "collected_at"],
     order_by=[{"field": "collected_at"}, {"field": "flow_id"}], limit=5000)
_ask("u1_union_all",
     "SELECT src_ip, count(*) AS hits FROM security_events WHERE label = 'DoS' GROUP BY 1 UNION ALL "
     "SELECT src_ip, count(*) FROM security_events WHERE label = 'DDoS' GROUP BY 1 UNION ALL "
     "SELECT dst_ip, count(*) FROM flows GROUP BY 1",
     collection="net.security_events", dimensions=["src_ip"], metrics=[HITS],
     filters=[_where("label", "eq", "DoS")],
     union_all=[{"dimensions": ["src_ip"], "metrics": [HITS], "filters": [_where("label", "eq", "DDoS")]},
                {"collection": "net.flows", "dimensions": ["dst_ip"], "metrics": [_metric("count", "*", "n")]}])
_ask("u2_union_order_limit",
     "SELECT * FROM (SELECT src_ip, dst_ip, dst_port FROM flows UNION ALL "
     "SELECT dst_ip, src_ip, src_port FROM repeat_flows) ORDER BY dst_port DESC, src_ip, dst_ip LIMIT 100",
     collection="net.flows", dimensions=["src_ip", "dst_ip", "dst_port"],
     union_all=[{"collection": "net.repeat_flows", "dimensions": ["dst_ip", "src_ip", "src_port"]}],
     order_by=[{"field": "dst_port", "dir": "desc"}, {"field": "src_ip"}, {"field": "dst_ip"}], limit=100)
_ask("u3_union_join_in_first",
     "SELECT f.src_ip, count(*) AS hits FROM flows f JOIN security_events se ON f.flow_id = se.flow_id "
     "GROUP BY 1 UNION ALL SELECT dst_ip, count(*) FROM flows GROUP BY 1",
     collection="net.flows", dimensions=["src_ip"], metrics=[HITS],
     joins=[{"collection": "net.security_events", "alias": "se", "on": ON_ID}],
     union_all=[{"dimensions": ["dst_ip"], "metrics": [HITS]}])


@query("p17_threat_predicate",
       "SELECT flow_id, label, cast(label <> 'BENIGN' AS smallint) AS threat FROM classified_flows")
def _threat(v: Views) -> DataFrame:
    from flowlens.functions.scalar import is_threat

    return v.classified_flows.select("flow_id", "label", is_threat().alias("threat"))
