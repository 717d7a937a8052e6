"""Rates and counts over time windows, for batch and streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalar import is_threat


def threats(classified: DataFrame) -> DataFrame:
    """The rows whose label is not BENIGN; stateless, so the same for streams."""
    return classified.filter(is_threat() == 1)


def _marked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows later than ``late`` behind the newest are dropped from a stream's windows."""
    return df.withWatermark(ts, late) if df.isStreaming else df


def rate_per_minute(df: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """Rows per minute, and the same as rows per second."""
    return (
        _marked(df, ts, late)
        .groupBy(F.window(ts, "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("per_minute"))
        .select(
            F.col("w.start").alias("window_start"),
            "per_minute",
            (F.col("per_minute") / F.lit(60.0)).alias("per_second"),
        )
    )


def label_counts(classified: DataFrame, ts: str, late: str = "10 minutes", minutes: int = 5) -> DataFrame:
    """Threats per label over ``minutes``, sliding by one minute.

    A batch counts each minute once and spreads the counts over the windows that hold it, so rows are not
    copied once per window.
    """
    rows = threats(classified)
    if rows.isStreaming:
        return (
            _marked(rows, ts, late)
            .groupBy(F.window(ts, f"{minutes} minutes", "1 minute").alias("w"), "label")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "label", "n")
        )
    per_minute = rows.groupBy(F.date_trunc("minute", F.col(ts)).alias("_minute"), "label").agg(
        F.count(F.lit(1)).alias("_n")
    )
    back = F.explode(F.array(*[F.make_dt_interval(mins=F.lit(k)) for k in range(minutes)])).alias("_back")
    return (
        per_minute.select("_minute", "label", "_n", back)
        .groupBy((F.col("_minute") - F.col("_back")).alias("window_start"), "label")
        .agg(F.sum("_n").alias("n"))
    )
