"""Registered queries for scoring, augmenting and incidents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowlens.functions.probabilities import best_class, json_number, label_index, pick_confidence, text_hash
from flowlens.operators import augment, incidents
from flowlens.operators.scoring import ModelBackend, score
from flowlens.schemas import FEATURES, LABELS
from flowlens.suite.registry import query, register
from flowlens.suite.requests import rounded
from flowlens.suite.views import Views, _hash

register("f15_label_pick",
         lambda v: v.flows.select(
             "flow_id", text_hash(F.col("flow_id")).alias("h"), label_index(F.col("flow_id"), 8).alias("pick")),
         f"SELECT flow_id, {_hash('flow_id')} AS h, cast({_hash(chr(102) + 'low_id || ' + repr(':label'))} % 8 AS int) "
         "AS pick FROM flows")
register("f16_confidence",
         lambda v: rounded(v.flows.select(
             "flow_id", pick_confidence(F.col("flow_id"), label_index(F.col("flow_id"), 8)).alias("confidence"))),
         "SELECT flow_id, round(cast(confidence AS double), 4) AS confidence FROM classified_flows")


@query("f9_best_class", """
SELECT flow_id, CASE WHEN last >= 8 THEN 'UNKNOWN' ELSE
  ['BENIGN', 'DoS', 'DDoS', 'PortScan', 'BruteForce', 'WebAttack', 'Botnet', 'Malware'][last + 1] END AS label,
 cast(top AS double) AS confidence
FROM (SELECT flow_id, list_max(p) AS top, len(p) - list_position(list_reverse(p), list_max(p)) AS last
 FROM (SELECT flow_id, [cast(x AS float) FOR x IN [src_port % 7, dst_port % 11, bidirectional_packets % 9,
   bidirectional_bytes % 8, src_port % 5, src_port % 3, dst_port % 4, dst_port % 6, bidirectional_packets % 10]] AS p
  FROM flows) q) r""")
def _best_class(v: Views):
    """Whole numbers as nine class weights: ties are common, and the ninth class has no name."""
    columns = [("src_port", 7), ("dst_port", 11), ("bidirectional_packets", 9), ("bidirectional_bytes", 8),
               ("src_port", 5), ("src_port", 3), ("dst_port", 4), ("dst_port", 6), ("bidirectional_packets", 10)]
    weights = F.array(*[(F.col(c) % n).cast("float") for c, n in columns])
    label, confidence = best_class(weights)
    return v.flows.select("flow_id", label.alias("label"), confidence.cast("double").alias("confidence"))


register("f12_json_number",
         lambda v: v.table("events").select(
             "event_id", json_number("props", "k").alias("k"), json_number("props", "none").alias("none")),
         "SELECT event_id, coalesce(cast(json_extract_string(props, '$.k') AS double), 0) AS k, "
         "cast(0 AS double) AS none FROM events")

_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)
register("f10_probability_json",
         lambda v: rounded(v.classified_flows.select(
             "flow_id", F.explode(F.from_json("probabilities", "map<string,double>")).alias("class", "p"))),
         "SELECT flow_id, class, round(cast(CASE WHEN label = class THEN confidence "
         "ELSE cast((1.0e0 - cast(confidence AS double)) / 7 AS float) END AS double), 4) AS p "
         f"FROM classified_flows, (SELECT unnest([{_LABEL_LIST}]) AS class)")

register("c2_deterministic_backend",
         lambda v: rounded(score(v.flows).select("flow_id", "label", "confidence")),
         "SELECT flow_id, label, round(cast(confidence AS double), 4) AS confidence FROM classified_flows")


def _linear(classes: int = len(LABELS)):
    """A fixed linear model with softmax, as a stand-in for a trained one."""
    def load():
        weights = np.cos(np.arange(len(FEATURES) * classes, dtype=np.float64)).reshape(len(FEATURES), classes)

        def predict(matrix):
            x = np.log1p(np.abs(matrix.astype(np.float64))) @ weights
            e = np.exp(x - x.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    return load


_X = ", ".join(f"ln(1 + abs(cast(cast({c} AS float) AS double)))" for c in FEATURES)
_DOTS = ", ".join(
    "list_sum([x[i + 1] * cos(i * 8 + %d) FOR i IN range(%d)])" % (j, len(FEATURES)) for j in range(len(LABELS))
)
register("c3_model_backend",
         lambda v: rounded(score(v.flows, ModelBackend(_linear())).select("flow_id", "label", "confidence"), 3),
         "SELECT flow_id, ['BENIGN', 'DoS', 'DDoS', 'PortScan', 'BruteForce', 'WebAttack', 'Botnet', 'Malware']"
         "[list_position(z, list_max(z))] AS label, "
         "round(cast(cast(1.0 / list_sum([exp(y - list_max(z)) FOR y IN z]) AS float) AS double), 3) AS confidence "
         f"FROM (SELECT flow_id, [{_DOTS}] AS z FROM (SELECT flow_id, [{_X}] AS x FROM flows) a) b")



def opened(df):
    """``df`` with a column per class probability in place of the JSON text."""
    parsed = df.withColumn("_p", F.from_json("probabilities", "map<string,double>"))
    return rounded(parsed.withColumns({f"p_{x.lower()}": F.coalesce(F.col("_p")[x], F.lit(0.0)) for x in LABELS}).drop("probabilities", "_p"))


_P = ", ".join(
    f"round(cast(CASE WHEN label = '{x}' THEN confidence ELSE cast((1.0e0 - cast(confidence AS double)) / 7 AS float) END "
    f"AS double), 4) AS p_{x.lower()}" for x in LABELS
)
_CLASSIFIED = (
    "classified_at, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, collected_at, "
    "bidirectional_duration_ms, bidirectional_packets, bidirectional_bytes, "
    "round(packets_per_second, 4) AS packets_per_second, round(bytes_per_second, 4) AS bytes_per_second, "
    f"label, round(cast(confidence AS double), 4) AS confidence, is_threat, {_P}"
)
register("c5_classified_flows", lambda v: opened(v.classified_flows),
         f"SELECT {_CLASSIFIED} FROM classified_flows")
_EVENTS = (
    "SELECT detected_at, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, label, "
    "round(cast(confidence AS double), 4) AS confidence, bidirectional_packets, bidirectional_bytes, "
    f"bidirectional_duration_ms, {_P} FROM security_events"
)
register("c5_security_events", lambda v: opened(v.security_events.drop("event_id")), _EVENTS)
_PROBS = "'{' || " + " || ',' || ".join(
    f"'\"{x}\":' || printf('%.4f', cast(CASE WHEN label_idx = {i} THEN confidence ELSE rest END AS double))"
    for i, x in enumerate(LABELS)
) + " || '}'"
_AUDIT = (
         "SELECT classified_at, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, label, "
         f"round(cast(confidence AS double), 4) AS confidence, {_PROBS} AS probabilities, is_threat FROM "
         "(SELECT *, cast((1.0e0 - cast(confidence AS double)) / 7 AS float) AS rest FROM classified_flows)")
register("c6_audit_rows",
         lambda v: rounded(augment.classifier_alarms(v.scored, now=F.col("collected_at")).drop("alarm_id")), _AUDIT)
register("j10_augment",
         lambda v: rounded(augment.augment(
             v.classified_flows.select("flow_id", "label", "confidence"),
             v.repeat_flows.withColumn("flow_id", F.regexp_replace("flow_id", "^10.0.0.1", "10.0.0.9"))
             .unionByName(v.flows))
             .select("flow_id", "label", "confidence", "collected_at", "bidirectional_bytes")),
         "SELECT c.flow_id, c.label, round(cast(c.confidence AS double), 4) AS confidence, f.collected_at, "
         "f.bidirectional_bytes FROM classified_flows c JOIN (SELECT * FROM "
         "(SELECT regexp_replace(flow_id, '^10.0.0.1', '10.0.0.9') AS flow_id, collected_at, src_port, "
         "bidirectional_bytes FROM repeat_flows "
         "UNION ALL SELECT flow_id, collected_at, src_port, bidirectional_bytes FROM flows) u "
         "QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY collected_at DESC) = 1) f "
         "ON c.flow_id = f.flow_id")

register("e2_incidents",
         lambda v: rounded(incidents.incidents(v.security_events, "flow_id").select(
             "batch", "attack_type", F.array_join("affected_hosts", ",").alias("affected_hosts"),
             "confidence", "detected_at", "events")),
         """
SELECT batch, label AS attack_type, array_to_string(list_sort(list_distinct(list(dst_ip))), ',') AS affected_hosts,
 round(avg(cast(confidence AS double)), 4) AS confidence, min(detected_at) AS detected_at, count(*) AS events
FROM (SELECT *, (row_number() OVER (ORDER BY date_trunc('second', detected_at), %s %% 256, flow_id) - 1) // 50
 AS batch FROM security_events) b
GROUP BY batch, label""" % _hash("flow_id"))
