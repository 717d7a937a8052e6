"""Table schemas, the label domain and the feature order."""

from __future__ import annotations

from pyspark.sql import types as T

# Class order (it names the probabilities) and the 22 model inputs in order.
LABELS = ["BENIGN", "DoS", "DDoS", "PortScan", "BruteForce", "WebAttack", "Botnet", "Malware"]
BENIGN = "BENIGN"
UNKNOWN = "UNKNOWN"
FEATURES = [
    "bidirectional_duration_ms", "bidirectional_packets", "bidirectional_bytes",
    "src2dst_packets", "dst2src_packets", "src2dst_bytes", "dst2src_bytes",
    "packets_per_second", "bytes_per_second",
    "bidirectional_min_ps", "bidirectional_mean_ps", "bidirectional_stddev_ps", "bidirectional_max_ps",
    "bidirectional_min_piat_ms", "bidirectional_mean_piat_ms",
    "bidirectional_stddev_piat_ms", "bidirectional_max_piat_ms",
    "bidirectional_syn_packets", "bidirectional_ack_packets", "bidirectional_psh_packets",
    "bidirectional_rst_packets", "bidirectional_fin_packets",
]


_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(),
    "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()),
    "array<bigint>": T.ArrayType(T.LongType()),
}


def _struct(text: str) -> T.StructType:
    """``name type`` pairs, separated by commas; needs no running session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The 13 statistical columns a flow producer may leave out.
STATISTICS = _struct(
    "bidirectional_min_ps float, bidirectional_mean_ps float, bidirectional_stddev_ps float,"
    "bidirectional_max_ps float, bidirectional_min_piat_ms float, bidirectional_mean_piat_ms float,"
    "bidirectional_stddev_piat_ms float, bidirectional_max_piat_ms float,"
    "bidirectional_syn_packets bigint, bidirectional_ack_packets bigint,"
    "bidirectional_psh_packets bigint, bidirectional_rst_packets bigint,"
    "bidirectional_fin_packets bigint"
)

FLOWS = T.StructType(
    _struct(
        "collected_at timestamp, flow_id string, src_ip string, dst_ip string, src_port int,"
        "dst_port int, protocol smallint, ip_version smallint, bidirectional_first_seen_ms bigint,"
        "bidirectional_last_seen_ms bigint, bidirectional_duration_ms bigint,"
        "bidirectional_packets bigint, bidirectional_bytes bigint, src2dst_packets bigint,"
        "src2dst_bytes bigint, dst2src_packets bigint, dst2src_bytes bigint,"
        "application_name string, application_category_name string,"
        "application_is_guessed smallint, application_confidence float,"
        "requested_server_name string, packets_per_second double, bytes_per_second double"
    ).fields
    + STATISTICS.fields
)

# The raw form carries the time as ISO-8601 text and the guess flag as a boolean or a number.
FLOWS_RAW = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name in ("collected_at", "application_is_guessed")
                      else f.dataType)
        for f in FLOWS.fields
    ]
)

CLASSIFIED_FLOWS = _struct(
    "classified_at timestamp, flow_id string, src_ip string, dst_ip string, src_port int,"
    "dst_port int, protocol smallint, collected_at timestamp, bidirectional_duration_ms bigint,"
    "bidirectional_packets bigint, bidirectional_bytes bigint, packets_per_second double,"
    "bytes_per_second double, label string, confidence float, probabilities string,"
    "is_threat smallint"
)

SECURITY_EVENTS = _struct(
    "event_id string, detected_at timestamp, flow_id string, src_ip string, dst_ip string,"
    "src_port int, dst_port int, protocol smallint, label string, confidence float,"
    "probabilities string, bidirectional_packets bigint, bidirectional_bytes bigint,"
    "bidirectional_duration_ms bigint"
)

CLASSIFIER_ALARMS = _struct(
    "alarm_id string, classified_at timestamp, flow_id string, src_ip string, dst_ip string,"
    "src_port int, dst_port int, protocol smallint, label string, confidence float,"
    "probabilities string, is_threat smallint"
)

PACKETS = _struct(
    "ts timestamp, seq bigint, src_ip string, dst_ip string, src_port int, dst_port int,"
    "protocol smallint, ip_version smallint, size bigint, syn boolean, ack boolean, psh boolean,"
    "rst boolean, fin boolean"
)

VECTORS = _struct(
    "id bigint, flow_id string, embedding array<float>, label string, confidence float,"
    "src_ip string, dst_ip string, detected_at bigint"
)

INCIDENTS = _struct(
    "incident_id string, detected_at timestamp, attack_type string, affected_hosts array<string>,"
    "confidence double, summary string, recommended_action string, rag_context_ids array<bigint>"
)

# Columns the classification run reads from the stored flows.
FETCH_COLUMNS = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "collected_at"] + FEATURES


def parse_labels(text: str) -> list[str]:
    """Label list from comma-separated text: trimmed, empties dropped, at least one must remain."""
    labels = [part.strip() for part in text.split(",") if part.strip()]
    if not labels:
        raise ValueError("the label list is empty")
    return labels
