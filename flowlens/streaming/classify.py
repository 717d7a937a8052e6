"""Incremental classification with three outputs."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.scalar import moment
from flowlens.operators.augment import classified_flows, classifier_alarms, security_events
from flowlens.operators.scoring import Backend, score
from flowlens.schemas import CLASSIFIED_FLOWS, CLASSIFIER_ALARMS, LABELS, SECURITY_EVENTS
from flowlens.sources.snapshots import SnapshotTable
from flowlens.sources.storage import fetch_columns, overwrite_batch

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outputs:
    """Folders of the three tables; without ``alarms`` no audit rows are written.

    With ``snapshots`` they are tables of :mod:`flowlens.sources.snapshots`, which merge and expire months.
    """

    classified: str
    events: str
    alarms: str | None = None
    snapshots: bool = False

    def table(self, spark: SparkSession, name: str) -> SnapshotTable:
        """One of ``classified``, ``events`` and ``alarms`` as a snapshot table."""
        return SnapshotTable(spark, getattr(self, name), *TABLES[name])


#: Schema, time column and order of each output.
TABLES = {
    "classified": (CLASSIFIED_FLOWS, "collected_at", ("collected_at", "label", "src_ip")),
    "events": (SECURITY_EVENTS, "detected_at", ("detected_at", "label", "src_ip")),
    "alarms": (CLASSIFIER_ALARMS, "classified_at", ("classified_at", "label", "src_ip")),
}


def write_scored(
    scored: DataFrame, batch_id: int, outputs: Outputs, labels: Sequence[str] = LABELS, now: Column | None = None
) -> None:
    """Write all flows, the threats and the audit rows of one batch. Runs jobs.

    Each table gets the batch under its own folder, and a second attempt replaces it. A failed audit write
    is logged and does not fail the batch.
    """
    spark = scored.sparkSession
    # One range sort serves all three: their orders begin with a time of the flow or of the run.
    scored = scored.repartitionByRange("collected_at", "label", "src_ip").persist()

    def put(name: str, rows: DataFrame) -> None:
        _, ts, order = TABLES[name]
        if outputs.snapshots:
            outputs.table(spark, name).append(rows, batch_id, dealt=True)
        else:
            overwrite_batch(rows, getattr(outputs, name), batch_id, ts, order, dealt=True)

    try:
        put("classified", classified_flows(scored, labels, now))
        put("events", security_events(scored, labels, now))
        if outputs.alarms:
            try:
                put("alarms", classifier_alarms(scored, labels, now))
            except Exception:  # the audit copy must not hold up the run
                log.warning("audit rows of batch %s were not written", batch_id, exc_info=True)
    finally:
        scored.unpersist()


def start_classification(
    flows: DataFrame,
    outputs: Outputs,
    checkpoint: str,
    backend: Backend | None = None,
    labels: Sequence[str] = LABELS,
    since: dt.datetime | None = None,
    now: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score every new flow once.

    The checkpoint is the progress. ``since`` bounds the first run (:func:`flowlens.streaming.cursor.first_cursor`
    gives a day); files per trigger bound a batch. By default the query takes what there is and ends, so a
    scheduler can start it every few minutes; a running one holds the checkpoint, so runs do not overlap.
    """
    if since is not None:
        flows = flows.filter(F.col("collected_at") > moment(since))

    def write(batch: DataFrame, batch_id: int) -> None:
        write_scored(score(fetch_columns(batch), backend, labels), batch_id, outputs, labels, now)

    return (
        flows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_threats(
    classified: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Pass all threats on as they come; a stateless filter into a Parquet file sink."""
    from flowlens.operators.windows import threats

    return (
        threats(classified).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
