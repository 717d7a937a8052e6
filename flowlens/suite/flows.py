"""Registered queries for metering and the scalar functions over flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalar
from flowlens.operators import metering
from flowlens.operators.latest import last_per_key
from flowlens.schemas import FEATURES
from flowlens.suite.registry import register
from flowlens.suite.requests import rounded

IDLE_S = 12 * 3600
ACTIVE_S = 48 * 3600

# Packets by unordered endpoint pair, with times in ms, as the checking engine writes them.
PAIRS_SQL = """
pairs AS (
 SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN fwd THEN src_port ELSE dst_port END AS port_a,
  CASE WHEN fwd THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN fwd THEN dst_port ELSE src_port END AS port_b
 FROM (SELECT *, epoch_us(ts) // 1000 AS t, (src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port)) AS fwd
       FROM packets) p)
"""
_KEY = "ip_a, port_a, ip_b, port_b, protocol"

register("w1_inter_arrival", lambda v: metering.inter_arrival(v.packets),
         f"WITH {PAIRS_SQL} SELECT {_KEY}, t, n, t - lag(t) OVER (PARTITION BY {_KEY} ORDER BY t) AS gap_ms "
         f"FROM (SELECT {_KEY}, t, count(*) AS n FROM pairs GROUP BY ALL) i")

SESSIONS_SQL = f"""
gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY {_KEY} ORDER BY t, seq) AS gap FROM pairs),
numbered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {IDLE_S * 1000} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {_KEY} ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS session FROM gaps)
"""
register("w2_idle_sessions", lambda v: metering.sessions(v.packets, IDLE_S),
         f'WITH {PAIRS_SQL}, {SESSIONS_SQL} SELECT {_KEY}, min(t) AS start, max(t) AS "end", '
         "count(*) AS packets, cast(sum(size) AS bigint) AS bytes "
         f"FROM numbered GROUP BY {_KEY}, session")


def _flows_sql(group: str) -> str:
    """Flow rows from ``members``: pairs with ``flow`` and the gap inside the flow."""
    return f"""
SELECT first(src_ip ORDER BY t, seq) AS src_ip, first(dst_ip ORDER BY t, seq) AS dst_ip,
 first(src_port ORDER BY t, seq) AS src_port, first(dst_port ORDER BY t, seq) AS dst_port,
 min(t) AS first_ms, max(t) AS last_ms, count(*) AS packets, cast(sum(size) AS bigint) AS bytes,
 count(*) FILTER (src_ip = sender AND src_port = sender_port) AS src2dst_packets,
 cast(coalesce(sum(size) FILTER (src_ip = sender AND src_port = sender_port), 0) AS bigint) AS src2dst_bytes,
 cast(min(size) AS double) AS min_ps, round(cast(cast(avg(size) AS float) AS double), 3) AS mean_ps,
 round(cast(cast(coalesce(stddev_samp(size), 0) AS float) AS double), 3) AS stddev_ps, cast(max(size) AS double) AS max_ps,
 cast(cast(coalesce(min(iat), 0) AS float) AS double) AS min_piat, cast(cast(coalesce(avg(iat), 0) AS float) AS double) AS mean_piat,
 round(cast(cast(coalesce(stddev_samp(iat), 0) AS float) AS double), 0) AS stddev_piat, cast(cast(coalesce(max(iat), 0) AS float) AS double) AS max_piat,
 count(*) FILTER (syn) AS syn, count(*) FILTER (ack) AS ack, count(*) FILTER (psh) AS psh,
 count(*) FILTER (rst) AS rst, count(*) FILTER (fin) AS fin
FROM (SELECT *, t - lag(t) OVER w AS iat, first_value(src_ip) OVER w AS sender,
       first_value(src_port) OVER w AS sender_port FROM members
      WINDOW w AS (PARTITION BY {group} ORDER BY t, seq)) m
GROUP BY {group}
"""


def _flow_view(flows):
    """The columns the SQL above computes; the 32-bit statistics are rounded to what they can hold."""
    def stat(name, alias, digits):
        return F.round(F.col(name).cast("double"), digits).alias(alias)

    return flows.select(
        "src_ip", "dst_ip", "src_port", "dst_port",
        F.col("bidirectional_first_seen_ms").alias("first_ms"),
        F.col("bidirectional_last_seen_ms").alias("last_ms"),
        F.col("bidirectional_packets").alias("packets"), F.col("bidirectional_bytes").alias("bytes"),
        "src2dst_packets", "src2dst_bytes",
        stat("bidirectional_min_ps", "min_ps", 3), stat("bidirectional_mean_ps", "mean_ps", 3),
        stat("bidirectional_stddev_ps", "stddev_ps", 3), stat("bidirectional_max_ps", "max_ps", 3),
        stat("bidirectional_min_piat_ms", "min_piat", 0), stat("bidirectional_mean_piat_ms", "mean_piat", 3),
        stat("bidirectional_stddev_piat_ms", "stddev_piat", 0),
        stat("bidirectional_max_piat_ms", "max_piat", 0),
        *[F.col(f"bidirectional_{f}_packets").alias(f) for f in metering.FLAGS],
    )


register("a12_flow_statistics", lambda v: _flow_view(metering.meter(v.packets, IDLE_S, None)),
         f"WITH {PAIRS_SQL}, {SESSIONS_SQL}, members AS (SELECT *, session AS flow FROM numbered) "
         + _flows_sql(f"{_KEY}, flow"))
# The flows of both timeouts, as the common table expression "metered"; a chain of starts per session.
METERED_SQL = f"""WITH RECURSIVE {PAIRS_SQL}, {SESSIONS_SQL},
chain AS (
 SELECT {_KEY}, session, min(t) AS flow FROM numbered GROUP BY {_KEY}, session
 UNION ALL
 SELECT c.ip_a, c.port_a, c.ip_b, c.port_b, c.protocol, c.session, min(n.t) AS flow
 FROM chain c JOIN numbered n ON c.ip_a = n.ip_a AND c.port_a = n.port_a AND c.ip_b = n.ip_b
  AND c.port_b = n.port_b AND c.protocol = n.protocol AND c.session = n.session
  AND n.t > c.flow + {ACTIVE_S * 1000}
 GROUP BY c.ip_a, c.port_a, c.ip_b, c.port_b, c.protocol, c.session),
members AS (
 SELECT n.*, c.flow FROM numbered n ASOF JOIN chain c ON c.ip_a = n.ip_a AND c.port_a = n.port_a
  AND c.ip_b = n.ip_b AND c.port_b = n.port_b AND c.protocol = n.protocol AND c.session = n.session
  AND n.t >= c.flow),
metered AS ({_flows_sql(f"{_KEY}, session, flow")})
"""
register("t7_meter", lambda v: _flow_view(metering.meter(v.packets, IDLE_S, ACTIVE_S)),
         METERED_SQL + "SELECT * FROM metered")

# ------------------------------------------------------------------ scalar functions

register("f1_flow_id", lambda v: v.flows.select(scalar.flow_id().alias("id"), "flow_id"),
         "SELECT src_ip || ':' || src_port || '->' || dst_ip || ':' || dst_port || ':' || protocol AS id, "
         "flow_id FROM flows")
register("f2_packets_per_second",
         lambda v: rounded(v.flows.select("flow_id", scalar.per_second("bidirectional_packets").alias("r"))),
         "SELECT flow_id, round(CASE WHEN bidirectional_duration_ms > 0 THEN bidirectional_packets / "
         "(bidirectional_duration_ms / 1000.0e0) ELSE 0 END, 4) AS r FROM flows")
register("f3_bytes_per_second",
         lambda v: rounded(v.flows.select("flow_id", scalar.per_second("bidirectional_bytes").alias("r"))),
         "SELECT flow_id, round(CASE WHEN bidirectional_duration_ms > 0 THEN bidirectional_bytes / "
         "(bidirectional_duration_ms / 1000.0e0) ELSE 0 END, 4) AS r FROM flows")
register("f4_parse_time",
         lambda v: v.table("events").select(
             "event_id", scalar.parse_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
             .alias("utc"), scalar.parse_time("event_type").alias("none")),
         "SELECT event_id, ts - INTERVAL 2 HOUR AS utc, cast(NULL AS timestamp) AS none FROM events")
register("f5_guess_flag",
         lambda v: v.table("events").select(
             "event_id", scalar.guess_flag(F.col("event_type") == "view").alias("flag"),
             scalar.guess_flag((F.col("event_id") % 2).cast("string")).alias("text_flag")),
         "SELECT event_id, cast(event_type = 'view' AS smallint) AS flag, cast(event_id % 2 AS smallint) AS text_flag "
         "FROM events")
register("f6_defaults",
         lambda v: scalar.with_defaults(v.flows.select(
             "flow_id", F.expr("nullif(bidirectional_max_ps, bidirectional_mean_ps)").alias("bidirectional_max_ps")))
         .select("flow_id", "bidirectional_max_ps", "bidirectional_fin_packets", "requested_server_name"),
         "SELECT flow_id, coalesce(nullif(bidirectional_max_ps, bidirectional_mean_ps), cast(0 AS float)) "
         "AS bidirectional_max_ps, cast(0 AS bigint) AS bidirectional_fin_packets, '' AS requested_server_name FROM flows")
register("f8_feature_frame", lambda v: scalar.feature_frame(v.flows),
         "SELECT flow_id, src_ip, dst_ip, src_port, dst_port, cast(protocol AS int) AS protocol, "
         f"{', '.join(FEATURES)} FROM flows")
register("f7_feature_vector",
         lambda v: v.flows.select("flow_id", F.posexplode(scalar.feature_vector()).alias("i", "x"))
         .select("flow_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 2).alias("x")),
         "SELECT flow_id, i, round(cast(x AS double), 2) AS x FROM (SELECT flow_id, "
         f"unnest(range({len(FEATURES)})) AS i, unnest([{', '.join(f'cast({c} AS float)' for c in FEATURES)}]) "
         "AS x FROM flows)")
register("f14_month_key", lambda v: v.flows.select("flow_id", scalar.month_key("collected_at").alias("yyyymm")),
         "SELECT flow_id, cast(year(collected_at) * 100 + month(collected_at) AS int) AS yyyymm FROM flows")
register("f18_round",
         lambda v: v.flows.select("flow_id", scalar.round2("bytes_per_second").alias("r")),
         "SELECT flow_id, round(bytes_per_second, 2) AS r FROM flows")
register("f19_summary_text",
         lambda v: v.classified_flows.select(scalar.summary_text().alias("text")),
         "SELECT concat_ws(' ', label, 'flow from', src_ip || ':' || src_port, 'to', dst_ip || ':' || dst_port, "
         "'protocol', protocol, 'packets', bidirectional_packets, 'bytes', bidirectional_bytes, 'duration_ms', "
         "bidirectional_duration_ms) AS text FROM classified_flows")

# ------------------------------------------------------------------ last record per key

register("w3_last_record",
         lambda v: last_per_key(
             v.repeat_flows.select("flow_id", "collected_at", "bidirectional_bytes", "src_port"),
             ["flow_id"], ["collected_at"]),
         "SELECT flow_id, collected_at, bidirectional_bytes, src_port FROM repeat_flows "
         "QUALIFY row_number() OVER (PARTITION BY flow_id "
         "ORDER BY collected_at DESC, bidirectional_bytes DESC, src_port DESC) = 1")
