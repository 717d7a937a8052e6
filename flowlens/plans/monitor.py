"""The ready-made monitoring queries.

``now`` is a timestamp column or literal; it defaults to the clock. Every "latest" and "top" query is
``orderBy`` + ``limit``, which Spark runs as a top-k per task and never as a full sort. Ties are broken
by the remaining columns, so results do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.probabilities import json_number
from flowlens.functions.scalar import is_threat, month_key, round2
from flowlens.plans.catalog import Catalog, StoredTable
from flowlens.plans.olap import olap_query
from flowlens.schemas import LABELS
from flowlens.sources.storage import MONTH

# Columns and rows at most of the recent-flows summary.
RECENT_COLUMNS = [
    "collected_at", "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
    "application_name", "bidirectional_packets", "bidirectional_bytes", "bidirectional_duration_ms",
    "packets_per_second", "bytes_per_second",
]
RECENT_MAX = 100


def since(rows: DataFrame | StoredTable, ts: str, interval: str, now: Column | None = None) -> DataFrame:
    """Rows younger than ``interval``, e.g. ``1 DAY``; of a stored table only the months that can hold them."""
    oldest = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {interval}")
    if isinstance(rows, StoredTable):
        return rows.months().filter((F.col(MONTH) >= month_key(oldest)) & (F.col(ts) > oldest)).drop(MONTH)
    return rows.filter(F.col(ts) > oldest)


def _newest(df: DataFrame, ts: str, columns: Sequence[str], n: int) -> DataFrame:
    rest = [c for c in columns if c != ts]
    return df.select(*columns).orderBy(F.desc(ts), *rest).limit(n)


def recent_threats(events: DataFrame, n: int = 50) -> DataFrame:
    """D1."""
    columns = ["detected_at", "label", "confidence", "src_ip", "dst_ip", "src_port", "dst_port"]
    return _newest(events, "detected_at", columns, n)


def attack_breakdown(events: DataFrame | StoredTable, now: Column | None = None) -> DataFrame:
    """Events and mean confidence per label over the last day."""
    return (
        since(events, "detected_at", "1 DAY", now)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"))
        .orderBy(F.desc("count"), "label")
    )


def top_sources(
    events: DataFrame | StoredTable, now: Column | None = None, n: int = 20, interval: str = "1 HOUR"
) -> DataFrame:
    """D3: sources with the most events in the last hour."""
    return (
        since(events, "detected_at", interval, now)
        .groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"))
        .orderBy(F.desc("events"), "src_ip").limit(n)
    )


def flow_probabilities(events: DataFrame, flow_id: str | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """One column per class probability, for one flow or for all."""
    df = events if flow_id is None else events.filter(F.col("flow_id") == flow_id)
    return df.select(
        "flow_id", "label", "confidence",
        *[json_number("probabilities", x).alias(f"p_{x.lower()}") for x in labels],
    )


def flow_count(flows: DataFrame) -> DataFrame:
    """D5."""
    return flows.agg(F.count(F.lit(1)).alias("flows"))


def latest_flows(flows: DataFrame, n: int = 10) -> DataFrame:
    """D6."""
    columns = ["collected_at", "src_ip", "dst_ip", "application_name", "bidirectional_bytes"]
    return _newest(flows, "collected_at", columns, n)


def syn_flows(flows: DataFrame) -> DataFrame:
    """Flows with at least one SYN packet."""
    return flows.filter(F.col("bidirectional_syn_packets") > 0).agg(F.count(F.lit(1)).alias("syn_flows"))


def top_applications(flows: DataFrame, n: int = 5) -> DataFrame:
    """D8."""
    return (
        flows.groupBy("application_name").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "application_name").limit(n)
    )


def recent_security_events(classified: DataFrame, n: int = 100) -> DataFrame:
    """The newest flows whose label is not BENIGN."""
    columns = ["collected_at", "label", "confidence", "flow_id", "src_ip", "dst_ip"]
    return _newest(classified.filter(is_threat() == 1), "collected_at", columns, n)


def hits_per_source(catalog: Catalog, collection: str, label: str, limit: int | None = 50) -> DataFrame:
    """Rows per source for one label, most first."""
    return olap_query(catalog, {
        "collection": collection,
        "dimensions": ["src_ip"],
        "metrics": [{"agg": "count", "field": "*", "alias": "hits"}],
        "filters": [{"field": "label", "op": "eq", "value": label}],
        "order_by": [{"field": "hits", "dir": "desc"}, {"field": "src_ip"}],
        "limit": limit,
    })


def hits_of_two_labels(catalog: Catalog, collection: str, first: str, second: str, limit: int | None = 100) -> DataFrame:
    """Hits per source for two labels in one result; a source may appear twice."""
    hits = [{"agg": "count", "field": "*", "alias": "hits"}]
    return olap_query(catalog, {
        "collection": collection,
        "dimensions": ["src_ip"],
        "metrics": hits,
        "filters": [{"field": "label", "op": "eq", "value": first}],
        "union_all": [{
            "dimensions": ["src_ip"], "metrics": hits,
            "filters": [{"field": "label", "op": "eq", "value": second}],
        }],
        "order_by": [{"field": "hits", "dir": "desc"}, {"field": "src_ip"}],
        "limit": limit,
    })


def events_with_flows(catalog: Catalog, events: str, classified: str, limit: int | None = 50) -> DataFrame:
    """Events joined to classified flows by flow id, counted per source."""
    return olap_query(catalog, {
        "collection": events,
        "dimensions": ["src_ip"],
        "metrics": [{"agg": "count", "field": "*", "alias": "hits"}],
        "joins": [{"collection": classified, "alias": "cf", "kind": "inner",
                   "on": [{"left": "flow_id", "right": "flow_id"}]}],
        "order_by": [{"field": "hits", "dir": "desc"}, {"field": "src_ip"}],
        "limit": limit,
    })


def dns_flows(catalog: Catalog, collection: str, limit: int | None = 200) -> DataFrame:
    """Flows whose application name contains "dns" in any case."""
    return olap_query(catalog, {
        "collection": collection,
        "dimensions": ["src_ip", "application_name"],
        "filters": [{"field": "application_name", "op": "ilike", "value": "%dns%"}],
        "limit": limit,
    })


def recent_flows(flows: DataFrame, n: int = RECENT_MAX) -> DataFrame:
    """The newest flows as a 13-column summary; ``n`` is clamped to 1..100, rates have 2 decimals."""
    n = max(1, min(n, RECENT_MAX))
    return _newest(flows, "collected_at", RECENT_COLUMNS, n).withColumns({
        "packets_per_second": round2("packets_per_second"),
        "bytes_per_second": round2("bytes_per_second"),
    })
