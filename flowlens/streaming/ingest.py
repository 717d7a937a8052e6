"""Continuous ingest of raw flows into the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.sources.flows import MALFORMED, typed
from flowlens.sources.storage import FLOW_ORDER, overwrite_batch


def start_ingest(
    raw: DataFrame, table: str, rejected: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write typed flows to ``table`` and records that do not fit the schema, as text, to ``rejected``.

    A replayed batch replaces its own folder, so restarts neither lose nor repeat rows. ``trigger`` holds
    the arguments of ``DataStreamWriter.trigger``; by default the query takes what there is and ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # One pass over the text decides and writes both; the parsed batch is read twice.
        batch = batch.persist()
        try:
            overwrite_batch(typed(batch.filter(F.col(MALFORMED).isNull())), table, batch_id, "collected_at", FLOW_ORDER)
            bad = batch.filter(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("value"))
            bad.write.mode("overwrite").text(f"{rejected.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
