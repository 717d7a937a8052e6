"""Stored tables in Parquet, partitioned by month and sorted inside the files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.scalar import moment, month_key
from flowlens.schemas import FETCH_COLUMNS
from flowlens.session import written

MONTH = "yyyymm"
BATCH = "batch_id"
FLOW_ORDER = ["collected_at", "src_ip", "dst_ip"]

# Days a table keeps its rows; security events are kept for good.
RETENTION_DAYS = {"flows": 90, "classified_flows": 30, "classifier_alarms": 30}


def laid_out(df: DataFrame, ts: str, order: Sequence[str], files: int | None = None, dealt: bool = False) -> DataFrame:
    """Add the month, and give each task one range of the sort key.

    Ranges keep a busy month or second from landing in one task, and give files with narrow key ranges,
    which row-group statistics can skip. ``files`` defaults to the shuffle partitions. Rows that are ``dealt``
    in such ranges already are only sorted where they are.
    """
    keys = [MONTH, *order]
    with_month = df.withColumn(MONTH, month_key(ts))
    if dealt:
        return with_month.sortWithinPartitions(*keys)
    ranged = with_month.repartitionByRange(files, *keys) if files else with_month.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def append(df: DataFrame, path: str, ts: str, order: Sequence[str], files: int | None = None) -> None:
    """Append rows to a table partitioned by month. Runs a job."""
    laid_out(df, ts, order, files).write.mode("append").partitionBy(MONTH).parquet(path)


def overwrite_batch(df: DataFrame, path: str, batch_id: int, ts: str, order: Sequence[str], dealt: bool = False) -> None:
    """Write one batch of a table under its own ``batch_id``; writing it again replaces it."""
    (
        laid_out(df, ts, order, dealt=dealt).write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(MONTH).parquet(f"{path.rstrip('/')}/{BATCH}={batch_id}")
    )


def _partitions(batched: bool) -> list[T.StructField]:
    month = T.StructField(MONTH, T.IntegerType())
    return [T.StructField(BATCH, T.LongType()), month] if batched else [month]


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    ts: str,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
    with_month: bool = False,
) -> DataFrame:
    """The rows of a stored table with ``since`` < time <= ``until``; only their months are read.

    ``with_month`` keeps the month column, on which further conditions prune months too.
    """
    parts = _partitions(bool(_glob(spark, f"{path.rstrip('/')}/{BATCH}=*")))
    df = spark.read.schema(T.StructType(schema.fields + parts)).parquet(path)
    if since is not None:
        df = df.filter((F.col(MONTH) >= since.year * 100 + since.month) & (F.col(ts) > moment(since)))
    if until is not None:
        df = df.filter((F.col(MONTH) <= until.year * 100 + until.month) & (F.col(ts) <= moment(until)))
    return df.select(*schema.names, *([MONTH] if with_month else []))


def fetch_columns(flows: DataFrame) -> DataFrame:
    """S3: the 29 columns scoring needs."""
    return flows.select(*FETCH_COLUMNS)


def retain(df: DataFrame, ts: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows that are not older than ``days``."""
    now = F.current_timestamp() if now is None else now
    return df.filter(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def expire(
    spark: SparkSession, path: str, schema: T.StructType, ts: str, days: int, now: dt.datetime
) -> None:
    """Remove rows older than ``days`` from a stored table; ``now`` is in UTC.

    Whole months go without being read; only the month of the cut is rewritten, through the shared folder.
    """
    path = path.rstrip("/")
    cut = now - dt.timedelta(days=days)
    month = cut.year * 100 + cut.month
    batches = _glob(spark, f"{path}/{BATCH}=*/{MONTH}=*")
    parts = _partitions(bool(batches))
    at_cut = {}
    for folder in batches or _glob(spark, f"{path}/{MONTH}=*"):
        values = tuple(v.split("=", 1)[1] for v in folder.split("/")[-len(parts):])
        if not values[-1].isdigit():
            continue  # rows without a time have no age
        if int(values[-1]) < month:
            _delete(spark, folder)
        elif int(values[-1]) == month:
            at_cut[values] = folder
    if not at_cut:
        return
    rows = spark.read.schema(T.StructType(schema.fields + parts)).option("basePath", path).parquet(*at_cut.values())
    kept = written(retain(rows, ts, days, moment(now)), "retain")
    names = [p.name for p in parts]
    left = {tuple(str(v) for v in r) for r in kept.select(*names).distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(path)
    for values, folder in at_cut.items():
        if values not in left:
            _delete(spark, folder)


def with_generated(df: DataFrame, id_column: str | None = None, time_column: str | None = None) -> DataFrame:
    """A new random id and the current time for rows that lack them."""
    if id_column:
        fresh = F.expr("uuid()")
        df = df.withColumn(id_column, F.coalesce(id_column, fresh) if id_column in df.columns else fresh)
    if time_column:
        now = F.current_timestamp()
        df = df.withColumn(time_column, F.coalesce(time_column, now) if time_column in df.columns else now)
    return df


def export_json_lines(flows: DataFrame, path: str) -> None:
    """One JSON object per line, times as ISO-8601 text in microseconds. Runs a job."""
    flows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
