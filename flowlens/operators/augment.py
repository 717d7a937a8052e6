"""From scored flows to classified flows, security events and audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.probabilities import json_label_order, json_sorted
from flowlens.functions.scalar import is_threat
from flowlens.operators.latest import last_per_key
from flowlens.operators.skew import join_unique
from flowlens.schemas import CLASSIFIED_FLOWS, CLASSIFIER_ALARMS, LABELS, SECURITY_EVENTS


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def classified_flows(
    scored: DataFrame, labels: Sequence[str] = LABELS, now: Column | None = None
) -> DataFrame:
    """Every scored flow, with the threat flag and the probabilities as JSON."""
    return _typed(
        scored.withColumns({
            "classified_at": F.current_timestamp() if now is None else now,
            "is_threat": is_threat(),
            "probabilities": json_sorted(F.col("probabilities"), labels),
        }),
        CLASSIFIED_FLOWS,
    )


def security_events(
    scored: DataFrame, labels: Sequence[str] = LABELS, now: Column | None = None
) -> DataFrame:
    """The threats only (every label but BENIGN), each with a new event id."""
    return _typed(
        scored.filter(is_threat() == 1).withColumns({
            "event_id": F.expr("uuid()"),
            "detected_at": F.current_timestamp() if now is None else now,
            "probabilities": json_sorted(F.col("probabilities"), labels),
        }),
        SECURITY_EVENTS,
    )


def classifier_alarms(
    scored: DataFrame, labels: Sequence[str] = LABELS, now: Column | None = None
) -> DataFrame:
    """One audit row per scored flow, probabilities in label order with four decimals."""
    return _typed(
        scored.withColumns({
            "alarm_id": F.expr("uuid()"),
            "classified_at": F.current_timestamp() if now is None else now,
            "is_threat": is_threat(),
            "probabilities": json_label_order(F.col("probabilities"), labels),
        }),
        CLASSIFIER_ALARMS,
    )


def augment(results: DataFrame, flows: DataFrame) -> DataFrame:
    """Outside results joined to the last flow of the same id; results without a flow are dropped.

    ``results`` holds flow_id, label, confidence and probabilities. A flow id is a bare 5-tuple, so one busy
    conversation may hold much of either side: flows are cut to their last record before they are shuffled,
    and the results of the most frequent ids are not shuffled at all.
    """
    return join_unique(results, last_per_key(flows, ["flow_id"], ["collected_at"]), "flow_id")


def run_summary(classified: DataFrame) -> DataFrame:
    """Flows classified, threats, and flows whose label is unknown, in one pass."""
    return classified.agg(
        F.count(F.lit(1)).alias("flows_fetched"),
        F.count("label").alias("flows_classified"),
        F.coalesce(F.sum(F.col("is_threat").cast("bigint")), F.lit(0)).alias("threats_written"),
        F.count_if(F.col("label") == "UNKNOWN").alias("unknown_labels"),
    )
