"""The batch form of incremental classification, with a saved keyset cursor."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.operators.scoring import Backend, score
from flowlens.plans.catalog import StoredTable
from flowlens.schemas import LABELS
from flowlens.sources.storage import MONTH, _glob
from flowlens.streaming.classify import Outputs, write_scored

_SCHEMA = "version bigint, at_us bigint, flow_id string"
DEFAULT_LIMIT = 1000
EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Cursor:
    """The last flow that was processed (time in microseconds); ``version`` counts the runs that ended."""

    version: int
    at_us: int
    flow_id: str | None = None


def first_cursor(now: dt.datetime) -> Cursor:
    """Without saved state a run starts a day back. ``now`` without a zone is UTC."""
    now = now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)
    since = now - dt.timedelta(hours=24) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return Cursor(0, since // dt.timedelta(microseconds=1))


def load_cursor(spark: SparkSession, folder: str, now: dt.datetime) -> Cursor:
    """The newest completely written cursor, or the first one."""
    done = _glob(spark, f"{folder.rstrip('/')}/version=*/_SUCCESS")
    if not done:
        return first_cursor(now)
    newest = max(done, key=lambda p: int(p.split("version=")[1].split("/")[0]))
    row = spark.read.schema(_SCHEMA).json(newest.rsplit("/", 1)[0]).first()
    return Cursor(row["version"], row["at_us"], row["flow_id"])


def save_cursor(spark: SparkSession, folder: str, cursor: Cursor) -> None:
    """Write the cursor to a folder of its own; it counts once the folder is complete."""
    row = [(cursor.version, cursor.at_us, cursor.flow_id)]
    target = f"{folder.rstrip('/')}/version={cursor.version}"
    spark.createDataFrame(row, _SCHEMA).coalesce(1).write.mode("overwrite").json(target)


def after(cursor: Cursor) -> Column:
    """Flows beyond the cursor. Without a flow id the time is exclusive; otherwise ties go by flow id."""
    at = F.timestamp_micros(F.lit(cursor.at_us))
    newer = F.col("collected_at") > at
    if cursor.flow_id is None:
        return newer
    # The first condition alone reaches the Parquet statistics.
    same = (F.col("collected_at") == at) & (F.col("flow_id") > F.lit(cursor.flow_id))
    return (F.col("collected_at") >= at) & (newer | same)


def beyond(flows: DataFrame | StoredTable, cursor: Cursor) -> DataFrame:
    """The flows beyond the cursor; of a stored table only the months from the cursor's on."""
    if isinstance(flows, StoredTable):
        at = EPOCH + dt.timedelta(microseconds=cursor.at_us)
        return flows.months().filter(F.col(MONTH) >= at.year * 100 + at.month).filter(after(cursor)).drop(MONTH)
    return flows.filter(after(cursor))


def page(flows: DataFrame | StoredTable, cursor: Cursor, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """The next ``limit`` flows in order of (collected_at, flow_id), and any that tie with the last.

    No row is skipped when many share the time at the page's end. Counts per second, summed up over days and
    seconds of a day, show the second the page ends in; only flows of that second are put in order. Runs two jobs.
    """
    rows = beyond(flows, cursor)
    if limit is None:
        return rows
    second = F.unix_seconds("collected_at")
    seconds = rows.groupBy(second.alias("s")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "day", F.floor(F.col("s") / 86400))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = seconds.groupBy("day").agg(F.sum("n").alias("n")).withColumn("days_before", earlier(Window.orderBy("day")))
    placed = seconds.withColumn("before", earlier(Window.partitionBy("day").orderBy("s"))).join(
        days.select("day", "days_before"), "day").withColumn("before", F.col("before") + F.col("days_before"))
    end = placed.filter(F.col("before") + F.col("n") >= limit).agg(F.min(F.struct("s", "before")).alias("m")).first()["m"]
    if end is None:
        return rows
    last = rows.filter(second == end["s"]).select("collected_at", "flow_id").orderBy("collected_at", "flow_id")
    top = last.limit(limit - end["before"]).agg(F.max(F.struct("collected_at", "flow_id")).alias("m"))
    top = top.select(F.unix_micros("m.collected_at").alias("at_us"), "m.flow_id").first()
    at = F.timestamp_micros(F.lit(top["at_us"]))
    same = (F.col("collected_at") == at) & F.coalesce(F.col("flow_id") <= F.lit(top["flow_id"]), F.lit(True))
    return rows.filter((F.col("collected_at") <= at) & ((F.col("collected_at") < at) | same))


def last_of(rows: DataFrame) -> DataFrame:
    """T4: the (collected_at, flow_id) a cursor advances to, as one row; NULLs when there are no rows."""
    top = rows.agg(F.max(F.struct("collected_at", "flow_id")).alias("m"))
    return top.select("m.collected_at", "m.flow_id")


def run_once(
    flows: DataFrame | StoredTable,
    outputs: Outputs,
    state: str,
    now: dt.datetime,
    backend: Backend | None = None,
    labels: Sequence[str] = LABELS,
    limit: int | None = DEFAULT_LIMIT,
) -> Cursor:
    """One run: the next page, scored and written under the run's number, then the cursor.

    A run that dies before saving the cursor is repeated under the same number and replaces its output.
    Unlike the stream, a run never sees a flow that arrives with a time at or before the cursor (T13).
    """
    spark = flows.spark if isinstance(flows, StoredTable) else flows.sparkSession
    cursor = load_cursor(spark, state, now)
    scored = score(page(flows, cursor, limit), backend, labels).persist()
    try:
        end = last_of(scored).select(F.unix_micros("collected_at").alias("at_us"), "flow_id").first()
        if end["at_us"] is None:
            return cursor
        advanced = Cursor(cursor.version + 1, end["at_us"], end["flow_id"])
        write_scored(scored, advanced.version, outputs, labels)
        save_cursor(spark, state, advanced)
        return advanced
    finally:
        scored.unpersist()
