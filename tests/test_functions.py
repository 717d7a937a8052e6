"""Scalar functions, probabilities, scoring and augmenting."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import probabilities as pr
from flowlens.functions import scalar
from flowlens.operators import augment
from flowlens.operators.latest import last_per_key, upsert
from flowlens.operators.scoring import DeterministicBackend, ModelBackend, PipelineBackend, score
from flowlens.schemas import (
    CLASSIFIED_FLOWS, CLASSIFIER_ALARMS, FEATURES, FETCH_COLUMNS, FLOWS, LABELS, SECURITY_EVENTS, parse_labels,
)

BASE = {
    "collected_at": dt.datetime(2024, 1, 1, 12), "flow_id": "", "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2",
    "src_port": 12345, "dst_port": 80, "protocol": 6, "ip_version": 4, "bidirectional_first_seen_ms": 1000,
    "bidirectional_last_seen_ms": 2000, "bidirectional_duration_ms": 1000, "bidirectional_packets": 10,
    "bidirectional_bytes": 1500, "src2dst_packets": 6, "src2dst_bytes": 900, "dst2src_packets": 4,
    "dst2src_bytes": 600, "application_name": "HTTP", "application_category_name": "Web",
}


def flows(spark, ids, **more):
    rows = []
    for i, flow_id in enumerate(ids):
        row = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in FLOWS.fields}
        row = {k: float(v) if FLOWS[k].dataType.simpleString() in ("float", "double") else v for k, v in row.items()}
        row |= BASE | {"flow_id": flow_id, "src_port": 1000 + i} | more
        rows.append(tuple(row[f.name] for f in FLOWS.fields))
    return spark.createDataFrame(rows, FLOWS)


def test_flow_id_and_rates(spark):
    df = flows(spark, ["x"], src_port=12345).select(
        scalar.flow_id().alias("id"),
        scalar.per_second("bidirectional_packets").alias("p"), scalar.per_second("bidirectional_bytes").alias("b"))
    assert tuple(df.first()) == ("10.0.0.1:12345->10.0.0.2:80:6", 10.0, 1500.0)
    rates = flows(spark, ["x"], bidirectional_duration_ms=2000, bidirectional_packets=20, bidirectional_bytes=4000)
    assert tuple(rates.select(scalar.per_second("bidirectional_packets"),
                              scalar.per_second("bidirectional_bytes")).first()) == (10.0, 2000.0)
    zero = flows(spark, ["x"], bidirectional_duration_ms=0)
    assert tuple(zero.select(scalar.per_second("bidirectional_packets"),
                             scalar.per_second("bidirectional_bytes")).first()) == (0.0, 0.0)


def test_time_and_flag_parsing(spark):
    texts = ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00.123456+00:00", "2024-01-01T12:00:00+02:00", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.parse_time("t").cast("string"))
    assert [r[0] for r in df.collect()] == [
        "2024-01-01 10:00:00", "2024-01-01 10:00:00.123456", "2024-01-01 10:00:00", None, None]
    flags = spark.createDataFrame([("true",), ("1",), ("false",), ("0",), (None,)], "f string")
    assert [r[0] for r in flags.select(scalar.guess_flag("f")).collect()] == [1, 1, 0, 0, 0]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,)], "f boolean").select(
        scalar.guess_flag("f")).collect()] == [1, 0]


def test_optional_columns_default(spark):
    row = scalar.with_defaults(spark.createDataFrame([(1, None)], "a int, bidirectional_min_ps float")).first()
    assert row.bidirectional_min_ps == 0 and row.bidirectional_fin_packets == 0 and row.requested_server_name == ""
    kept = scalar.with_defaults(spark.createDataFrame([(7.5,)], "bidirectional_max_ps float")).first()
    assert kept.bidirectional_max_ps == 7.5


def test_labels_text():
    assert parse_labels(" BENIGN , Scan,,Attack ") == ["BENIGN", "Scan", "Attack"]
    with pytest.raises(ValueError):
        parse_labels(" , ")


def _best(spark, values, labels=LABELS):
    label, confidence = pr.best_class(F.col("p"), labels)
    row = spark.createDataFrame([(values,)], "p array<float>").select(label, confidence).first()
    return row[0], row[1]


def test_best_class(spark):
    assert _best(spark, [0.1, 0.7, 0.2]) == ("DoS", pytest.approx(0.7))
    assert _best(spark, [0.4, 0.4, 0.2])[0] == "DoS"  # the last maximum
    assert _best(spark, [0.0] * 8 + [0.9])[0] == "UNKNOWN"
    assert _best(spark, []) == ("BENIGN", 1.0)
    assert _best(spark, [0.1, math.nan, 0.2])[0] == "UNKNOWN"
    assert _best(spark, None)[0] == "UNKNOWN"
    assert _best(spark, [0.2, 0.8], ["BENIGN"])[0] == "UNKNOWN"


def _json(spark, fn, values, labels):
    return spark.createDataFrame([(values,)], "p array<float>").select(fn(F.col("p"), labels)).first()[0]


def test_probability_json(spark):
    assert json.loads(_json(spark, pr.json_sorted, [0.9, 0.1], ["BENIGN", "DoS"])) == {"BENIGN": 0.9, "DoS": 0.1}
    text = _json(spark, pr.json_sorted, [0.5, 0.25, 0.25], ["b", "a", "c"])
    assert list(json.loads(text)) == ["a", "b", "c"]
    assert _json(spark, pr.json_sorted, [0.5], ["b", "a"]) == '{"b":0.5}'
    assert _json(spark, pr.json_label_order, [0.9, 0.1], ["BENIGN", "DoS"]) == '{"BENIGN":0.9000,"DoS":0.1000}'
    assert _json(spark, pr.json_label_order, [0.5], ["b", "a"]) == '{"b":0.5000}'
    assert _json(spark, pr.json_label_order, [0.5, 0.2, 0.3], ["b", "a"]) == '{"b":0.5000,"a":0.2000}'
    number = spark.createDataFrame([('{"DoS":0.25,"x":"?"}',)], "t string").select(
        pr.json_number("t", "DoS"), pr.json_number("t", "x"), pr.json_number("t", "Nope")).first()
    assert tuple(number) == (0.25, 0.0, 0.0)


def test_deterministic_backend(spark):
    df = flows(spark, [f"f{i}" for i in range(2000)])
    rows = score(df).select("flow_id", "label", "confidence", "probabilities").collect()
    assert {r.label for r in rows} == set(LABELS)
    for r in rows:
        assert sum(r.probabilities) == pytest.approx(1, abs=1e-4) and len(r.probabilities) == 8
        assert 0.72 <= r.confidence <= 0.9775 and max(r.probabilities) == r.confidence
        assert r.probabilities[LABELS.index(r.label)] == r.confidence
    again = score(df.repartition(3)).select("flow_id", "label").collect()
    assert {(r.flow_id, r.label) for r in again} == {(r.flow_id, r.label) for r in rows}


def test_custom_and_single_labels(spark):
    df = flows(spark, [f"f{i}" for i in range(200)])
    rows = score(df, DeterministicBackend(), ["BENIGN", "Scan", "Attack"]).collect()
    assert {r.label for r in rows} == {"BENIGN", "Scan", "Attack"} and {len(r.probabilities) for r in rows} == {3}
    one = score(df, None, ["BENIGN"]).select("label", F.size("probabilities").alias("n")).distinct().collect()
    assert [tuple(r) for r in one] == [("BENIGN", 1)]


def test_model_backend_keeps_every_row_and_order_of_features(spark):
    def load():
        def predict(x):
            assert x.shape[1] == len(FEATURES) and x.dtype == np.float32
            out = np.zeros((len(x), 3), dtype=np.float32)
            out[:, 1] = x[:, FEATURES.index("bidirectional_packets")]
            out[:, 2] = 10
            return out

        return predict

    df = flows(spark, ["a"], bidirectional_packets=11).unionByName(flows(spark, ["b", "c"], bidirectional_packets=3))
    got = {r.flow_id: (r.label, r.confidence) for r in score(df, ModelBackend(load), ["x", "y", "z"]).collect()}
    assert got == {"a": ("y", 11.0), "b": ("z", 10.0), "c": ("z", 10.0)}
    assert score(df.limit(0), ModelBackend(load)).count() == 0


def _field(number, value):
    """One protocol-buffer field: an integer, or bytes with their length."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _onnx_linear(weights):
    """An ONNX model: output = Softmax(input x weights)."""
    def node(kind, inputs, output):
        return b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, kind)

    def value(name, width):
        shape = _field(1, _field(2, "n")) + _field(1, _field(1, width))
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))

    rows, classes = weights.shape
    tensor = _field(1, rows) + _field(1, classes) + _field(2, 1) + _field(8, "w") + _field(9, weights.tobytes())
    graph = (_field(1, node("MatMul", ["input", "w"], "z")) + _field(1, node("Softmax", ["z"], "output"))
             + _field(2, "g") + _field(5, tensor) + _field(11, value("input", rows)) + _field(12, value("output", classes)))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_onnx_backend(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    from flowlens.operators.scoring import onnx_model

    weights = np.zeros((len(FEATURES), 3), dtype=np.float32)
    weights[FEATURES.index("bidirectional_packets"), 2] = 0.1
    weights[FEATURES.index("bidirectional_fin_packets"), 1] = 5
    (tmp_path / "m.onnx").write_bytes(_onnx_linear(weights))
    df = flows(spark, ["a"], bidirectional_packets=100).unionByName(
        flows(spark, ["b"], bidirectional_packets=1, bidirectional_fin_packets=3))
    got = score(df, ModelBackend(onnx_model(str(tmp_path / "m.onnx"))), ["BENIGN", "Scan", "DoS"]).collect()
    assert {r.flow_id: r.label for r in got} == {"a": "DoS", "b": "Scan"}
    for r in got:
        assert len(r.probabilities) == 3 and sum(r.probabilities) == pytest.approx(1, abs=1e-5)


def test_pipeline_backend(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    df = flows(spark, [f"a{i}" for i in range(20)], bidirectional_packets=100).unionByName(
        flows(spark, [f"b{i}" for i in range(20)], bidirectional_packets=1))
    train = df.select(
        array_to_vector(scalar.feature_vector().cast("array<double>")).alias("features"),
        F.when(F.col("bidirectional_packets") > 50, 1.0).otherwise(0.0).alias("label"))
    model = RandomForestClassifier(numTrees=5, seed=1).fit(train)
    scored = score(df, PipelineBackend(model), ["BENIGN", "DoS"])
    assert set(df.columns) | {"probabilities", "label", "confidence"} == set(scored.columns)
    assert {(r.flow_id[0], r.label) for r in scored.collect()} == {("a", "DoS"), ("b", "BENIGN")}


def _scored(spark, labelled):
    """Flows with given labels; the confidence is at the label, the rest is shared."""
    df = flows(spark, [i for i, _, _ in labelled])
    rows = []
    for flow_id, label, conf in labelled:
        p = [(1 - conf) / 7] * 8
        if label in LABELS:
            p[LABELS.index(label)] = conf
        rows.append((flow_id, label, conf, p))
    return df.join(spark.createDataFrame(rows, "flow_id string, label string, confidence float, probabilities array<float>"),
                   "flow_id")


@pytest.mark.parametrize("labelled,threats", [
    ([("a", "BENIGN", 0.95), ("b", "DoS", 0.88), ("c", "PortScan", 0.76)], {"b": "DoS", "c": "PortScan"}),
    ([("a", "BENIGN", 0.9), ("b", "DoS", 0.9), ("c", "BENIGN", 0.9)], {"b": "DoS"}),
    ([("a", "BruteForce", 0.9), ("b", "WebAttack", 0.9), ("c", "Botnet", 0.9)],
     {"a": "BruteForce", "b": "WebAttack", "c": "Botnet"}),
    ([("a", "UNKNOWN", 0.9), ("b", "Malware", 0.8)], {"a": "UNKNOWN", "b": "Malware"}),
])
def test_augment_and_split(spark, labelled, threats):
    scored = _scored(spark, labelled)
    classified = augment.classified_flows(scored)
    assert classified.schema.names == CLASSIFIED_FLOWS.names
    rows = classified.collect()
    assert {r.flow_id: r.is_threat for r in rows} == {i: int(i in threats) for i, _, _ in labelled}
    assert all(set(json.loads(r.probabilities)) == set(LABELS) for r in rows)
    assert all(r.classified_at is not None and r.bidirectional_bytes == 1500 for r in rows)
    events = augment.security_events(scored)
    assert events.schema.names == SECURITY_EVENTS.names
    assert {r.flow_id: r.label for r in events.collect()} == threats
    alarms = augment.classifier_alarms(scored)
    assert alarms.schema.names == CLASSIFIER_ALARMS.names
    assert alarms.select("alarm_id").distinct().count() == len(labelled)
    assert {r.src_ip for r in alarms.collect()} == {"10.0.0.1"}


def test_outside_results(spark):
    """Unknown ids are dropped; a repeated flow id uses its last record, once per result."""
    known = flows(spark, ["known"], bidirectional_bytes=1).unionByName(
        flows(spark, ["known"], bidirectional_bytes=2, collected_at=dt.datetime(2024, 1, 2)))
    results = spark.createDataFrame(
        [("known", "DoS", 0.9, [0.1, 0.9]), ("ghost", "DoS", 0.9, [0.1, 0.9]), ("known", "BENIGN", 0.8, [0.8, 0.2])],
        "flow_id string, label string, confidence float, probabilities array<float>")
    got = augment.augment(results, known)
    assert sorted((r.label, r.bidirectional_bytes) for r in got.collect()) == [("BENIGN", 2), ("DoS", 2)]
    assert augment.augment(results.limit(0), known).count() == 0


def test_hot_results_are_not_shuffled(spark):
    """More distinct ids than hot ones, and one id with a third of the rows: every row once."""
    from flowlens.operators.skew import join_unique

    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = join_unique(left, right, "k", hot_keys=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2


def test_last_per_key_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, t int, v string")
    last = last_per_key(df, ["k"], ["t"])
    assert sorted(map(tuple, last.collect())) == [("a", 2, "z"), ("b", 1, "w")]
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    new = upsert(df.select("k", "v").filter("v != 'z'"), spark.createDataFrame([("a", "new"), ("c", "c")], "k string, v string"), ["k"])
    assert sorted(map(tuple, new.collect())) == [("a", "new"), ("b", "w"), ("c", "c")]


def test_fetch_columns():
    assert len(FETCH_COLUMNS) == 29 and len(FEATURES) == 22 and len(FLOWS.fields) == 37


def test_feature_frame(spark):
    frame = scalar.feature_frame(flows(spark, ["x"]))
    assert len(frame.columns) == 28 and frame.columns[6:] == FEATURES
    assert len(flows(spark, ["x"]).select(scalar.feature_vector().alias("v")).first().v) == 22
