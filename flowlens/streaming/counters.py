"""Running counters of a flow stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counters(flows: DataFrame, started: dt.datetime | None = None) -> DataFrame:
    """Flows so far, the time of the last one, and flows per second since ``started`` (2 decimals).

    As a stream, run it in complete output mode; the state is one row.
    """
    totals = flows.agg(F.count(F.lit(1)).alias("flows_published"), F.max("collected_at").alias("last_flow_at"))
    if started is None:
        return totals
    uptime = F.unix_micros(F.current_timestamp()) / 1e6 - F.lit(started.timestamp())
    rate = F.when(uptime > 0, F.round(F.col("flows_published") / uptime, 2)).otherwise(F.lit(0.0))
    return totals.withColumns({"uptime_seconds": F.round(uptime, 1), "flows_per_second": rate})
