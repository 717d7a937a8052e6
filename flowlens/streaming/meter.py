"""T7 for streams: packets to flows with idle and active timeouts.

:func:`start_metering` runs the batch meter on every micro-batch together with the flows that are still open, so a busy
pair is merged per millisecond, sorted per time slice and summed per slice in many tasks, as in
:mod:`flowlens.operators.metering`; no task holds a pair. The state is one record for each open flow, written under the
number of its batch: a replayed batch starts from the state of the one before and replaces its own output and state.

Packets count in order of arrival: those of one batch by time, and one that is older than the last packet of its pair's
open flow counts at the time of that one. A flow is passed on when a packet ends it, or when the watermark, the newest
time less ``late``, passes its idle timeout. A packet behind the watermark whose flow is gone opens one of its own, which
is passed on at once; none is dropped.

:func:`idle_sessions` is the variant without an active timeout, on built-in session windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.metering import ACTIVE_S, IDLE_S, PAIR, SLICE_S, flow_sums, flows_from_sums, with_pair
from flowlens.session import passing_scratch, written
from flowlens.sources.storage import BATCH, FLOW_ORDER, _delete, _glob, overwrite_batch

#: Keys that the packets of one pair are dealt over where they are compared with the pair's open flow.
SALTS = 64


def _settled(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``pairs`` with no packet before the last one of its pair's open flow.

    Only pairs with such packets, which are few, are joined to their packets, which are dealt over several keys.
    """
    first = pairs.groupBy(*PAIR).agg(F.min("t").alias("_first"))
    late = first.join(held.select(*PAIR, "last"), PAIR).filter("_first < last").drop("_first")
    late = written(late, "late")
    if late.isEmpty():
        return pairs
    late = late.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("t", "seq"), F.lit(SALTS)).cast("int"))
    return salted.join(late, [*PAIR, "_salt"], "left").withColumn("t", F.greatest("t", "last")).drop("_salt", "last")


class OpenFlows:
    """The open flows and the newest time after each batch, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/{BATCH}={batch_id}"

    def before(self, batch_id: int) -> tuple[DataFrame | None, int | None]:
        """The open flows and the newest time that the batch before left; None for the first batch."""
        known = [int(f.rsplit("=", 1)[1]) for f in _glob(self.spark, f"{self.path}/clock/{BATCH}=*")]
        earlier = [b for b in known if b < batch_id]
        if not earlier:
            return None, None
        newest = max(earlier)
        clock = self.spark.read.schema("newest long").parquet(self._at("clock", newest)).first()
        return self.spark.read.parquet(self._at("open", newest)), clock["newest"]

    def put(self, batch_id: int, flows: DataFrame, newest: int | None) -> None:
        """Store what the batch leaves, the clock last, and remove what no replay needs."""
        clock = self.spark.range(1).select(F.lit(newest).cast("long").alias("newest"))
        for name, rows in (("open", flows), ("clock", clock)):
            rows.write.mode("overwrite").parquet(self._at(name, batch_id))
        for name in ("open", "clock"):
            for folder in _glob(self.spark, f"{self.path}/{name}/{BATCH}=*"):
                if int(folder.rsplit("=", 1)[1]) < batch_id - 1:
                    _delete(self.spark, folder)


def meter_batch(packets: DataFrame, batch_id: int, flows: str, state: OpenFlows, idle_s: float, active_s: float,
                late_s: float, slice_s: int = SLICE_S) -> None:
    """Meter one batch: finished flows go to the table ``flows`` under the number of the batch, open ones to ``state``."""
    spark, idle_ms = packets.sparkSession, int(idle_s * 1000)
    held, before = state.before(batch_id)
    with passing_scratch(spark):
        pairs = with_pair(packets).persist()
        try:
            newest = pairs.agg(F.max("t")).first()[0]
            newest = max((t for t in (before, newest) if t is not None), default=None)
            settled = pairs if held is None else _settled(pairs, held)
            sums = flow_sums(settled, idle_ms, int(active_s * 1000), slice_s * 1000, held)
            over = F.max("start").over(Window.partitionBy(*PAIR))
            mark = F.lit(None if newest is None else newest - int(late_s * 1000)).cast("long")
            is_open = (F.col("start") == over) & ~F.coalesce(F.col("last") + idle_ms + 1 < mark, F.lit(False))
            sums = written(sums.withColumn("_open", is_open), "flow-sums")
            overwrite_batch(flows_from_sums(sums.filter("NOT _open")), flows, batch_id, "collected_at", FLOW_ORDER)
            state.put(batch_id, sums.filter("_open").drop("_open").withColumn("lead", F.lit(None).cast("long")), newest)
        finally:
            pairs.unpersist()


def start_metering(
    packets: DataFrame,
    flows: str,
    state: str,
    checkpoint: str,
    idle_s: float = IDLE_S,
    active_s: float = ACTIVE_S,
    late_s: float = 10,
    slice_s: int = SLICE_S,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Meter a stream of packets into the stored flow table ``flows``, with the open flows below ``state``."""
    kept = OpenFlows(packets.sparkSession, state)

    def write(batch: DataFrame, batch_id: int) -> None:
        meter_batch(batch, batch_id, flows, kept, idle_s, active_s, late_s, slice_s)

    return (
        packets.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def idle_sessions(packets: DataFrame, idle_s: float = IDLE_S, late: str = "10 seconds") -> DataFrame:
    """T7 without an active timeout: packets and bytes per idle-gap session, on session windows.

    Session windows that touch are merged, so packets exactly ``idle_s`` apart stay together.
    """
    gap = f"{int(idle_s * 1000)} milliseconds"
    timed = with_pair(packets).withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)
    return (
        timed.groupBy(*PAIR, F.session_window("ts", gap).alias("w"))
        .agg(F.min("t").alias("start"), F.max("t").alias("end"),
             F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
        .drop("w")
    )
