"""Registered queries for monitoring: D*, O5, P18 to P20, A11, T8 to T10."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import windows
from flowlens.operators.augment import run_summary
from flowlens.plans import monitor
from flowlens.suite.registry import register
from flowlens.suite.requests import rounded

NOW = "(SELECT max(collected_at) FROM classified_flows WHERE is_threat = 1)"


def _now(events):
    """The newest event's time, so that relative queries do not depend on the clock."""
    return events.agg(F.max("detected_at")).scalar()


register("d1_recent_threats", lambda v: rounded(monitor.recent_threats(v.security_events)),
         "SELECT detected_at, label, round(cast(confidence AS double), 4) AS confidence, src_ip, dst_ip, "
         "src_port, dst_port FROM security_events "
         "ORDER BY detected_at DESC, label, confidence, src_ip, dst_ip, src_port, dst_port LIMIT 50")
register("d2_attack_breakdown",
         lambda v: rounded(monitor.attack_breakdown(v.security_events, _now(v.security_events))),
         "SELECT label, count(*) AS count, round(avg(cast(confidence AS double)), 4) AS avg_confidence "
         f"FROM security_events WHERE detected_at > {NOW} - INTERVAL 1 DAY GROUP BY label")
register("d3_top_sources",
         lambda v: monitor.top_sources(v.security_events, _now(v.security_events)),
         f"SELECT src_ip, count(*) AS events FROM security_events WHERE detected_at > {NOW} "
         "- INTERVAL 1 HOUR GROUP BY src_ip ORDER BY events DESC, src_ip LIMIT 20")
_P = ", ".join(
    f"round(cast(CASE WHEN label = '{x}' THEN confidence ELSE rest END AS double), 4) AS p_{x.lower()}"
    for x in ["BENIGN", "DoS", "DDoS", "PortScan", "BruteForce", "WebAttack", "Botnet", "Malware"]
)
register("d4_flow_probabilities", lambda v: rounded(monitor.flow_probabilities(v.security_events)),
         f"SELECT flow_id, label, round(cast(confidence AS double), 4) AS confidence, {_P} FROM "
         "(SELECT *, cast((1.0e0 - cast(confidence AS double)) / 7 AS float) AS rest FROM security_events)")
register("d5_flow_count", lambda v: monitor.flow_count(v.flows), "SELECT count(*) AS flows FROM flows")
register("d6_latest_flows", lambda v: monitor.latest_flows(v.flows),
         "SELECT collected_at, src_ip, dst_ip, application_name, bidirectional_bytes FROM flows "
         "ORDER BY collected_at DESC, src_ip, dst_ip, application_name, bidirectional_bytes LIMIT 10")
register("d7_syn_flows", lambda v: monitor.syn_flows(v.flows),
         "SELECT count(*) AS syn_flows FROM flows WHERE bidirectional_syn_packets > 0")
register("d8_top_applications", lambda v: monitor.top_applications(v.flows),
         "SELECT application_name, count(*) AS n FROM flows GROUP BY 1 "
         "ORDER BY n DESC, application_name LIMIT 5")
register("d9_recent_security_events", lambda v: rounded(monitor.recent_security_events(v.classified_flows)),
         "SELECT collected_at, label, round(cast(confidence AS double), 4) AS confidence, flow_id, src_ip, "
         "dst_ip FROM classified_flows WHERE label <> 'BENIGN' "
         "ORDER BY collected_at DESC, label, confidence, flow_id, src_ip, dst_ip LIMIT 100")
register("d10_hits_per_source",
         lambda v: monitor.hits_per_source(v.catalog(1000), "net.security_events", "DoS"),
         "SELECT src_ip, count(*) AS hits FROM security_events WHERE label = 'DoS' GROUP BY src_ip "
         "ORDER BY hits DESC, src_ip LIMIT 50")
register("d11_hits_of_two_labels",
         lambda v: monitor.hits_of_two_labels(v.catalog(1000), "net.security_events", "DoS", "DDoS"),
         "SELECT * FROM (SELECT src_ip, count(*) AS hits FROM security_events WHERE label = 'DoS' "
         "GROUP BY 1 UNION ALL SELECT src_ip, count(*) FROM security_events WHERE label = 'DDoS' GROUP BY 1) "
         "ORDER BY hits DESC, src_ip LIMIT 100")
register("d12_events_with_flows",
         lambda v: monitor.events_with_flows(v.catalog(1000), "net.security_events", "net.classified_flows"),
         "SELECT se.src_ip, count(*) AS hits FROM security_events se "
         "JOIN classified_flows cf ON se.flow_id = cf.flow_id GROUP BY 1 ORDER BY hits DESC, se.src_ip LIMIT 50")
register("d13_dns_flows", lambda v: monitor.dns_flows(v.catalog(), "net.flows", limit=None),
         "SELECT src_ip, application_name FROM flows WHERE application_name ILIKE '%dns%'")

register("o5_recent_flows", lambda v: monitor.recent_flows(v.flows, 500),
         "SELECT collected_at, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, application_name, "
         "bidirectional_packets, bidirectional_bytes, bidirectional_duration_ms, "
         "round(packets_per_second, 2) AS packets_per_second, round(bytes_per_second, 2) AS bytes_per_second "
         "FROM flows ORDER BY collected_at DESC, flow_id LIMIT 100")
register("p18_last_day",
         lambda v: monitor.since(v.flows, "collected_at", "1 DAY", v.flows.agg(F.max("collected_at")).scalar())
         .select("flow_id", "collected_at"),
         "SELECT flow_id, collected_at FROM flows WHERE collected_at > "
         "(SELECT max(collected_at) FROM flows) - INTERVAL 1 DAY")
register("p20_flag_predicate",
         lambda v: v.flows.filter(F.col("bidirectional_rst_packets") > 0)
         .select("flow_id", "bidirectional_rst_packets"),
         "SELECT flow_id, bidirectional_rst_packets FROM flows WHERE bidirectional_rst_packets > 0")
register("a11_run_summary", lambda v: run_summary(v.classified_flows),
         "SELECT count(*) AS flows_fetched, count(label) AS flows_classified, "
         "cast(sum(is_threat) AS bigint) AS threats_written, count(*) FILTER (label = 'UNKNOWN') AS unknown_labels "
         "FROM classified_flows")

register("t8_flow_rate", lambda v: rounded(windows.rate_per_minute(v.flows, "collected_at")),
         "SELECT date_trunc('minute', collected_at) AS window_start, count(*) AS per_minute, "
         "round(count(*) / 60.0e0, 4) AS per_second FROM flows GROUP BY 1")
register("t9_event_rate",
         lambda v: rounded(windows.rate_per_minute(windows.threats(v.classified_flows), "collected_at")),
         "SELECT date_trunc('minute', collected_at) AS window_start, count(*) AS per_minute, "
         "round(count(*) / 60.0e0, 4) AS per_second FROM classified_flows WHERE label <> 'BENIGN' GROUP BY 1")
register("t10_label_window", lambda v: windows.label_counts(v.classified_flows, "collected_at"),
         "SELECT date_trunc('minute', collected_at) - to_minutes(k) AS window_start, label, count(*) AS n "
         "FROM classified_flows, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE label <> 'BENIGN' GROUP BY 1, 2")
