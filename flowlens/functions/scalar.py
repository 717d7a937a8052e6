"""Scalar column functions over flows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.schemas import BENIGN, FEATURES, FLOWS, STATISTICS


def flow_id(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port",
            protocol="protocol") -> Column:
    """``src:sport->dst:dport:proto``."""
    return F.concat(
        F.col(src_ip), F.lit(":"), F.col(src_port).cast("string"), F.lit("->"),
        F.col(dst_ip), F.lit(":"), F.col(dst_port).cast("string"), F.lit(":"),
        F.col(protocol).cast("string"),
    )


def per_second(amount: str, duration_ms: str = "bidirectional_duration_ms") -> Column:
    """amount per second; 0 when the duration is 0."""
    ms = F.col(duration_ms)
    return F.when(ms > 0, F.col(amount) / (ms / F.lit(1000.0))).otherwise(F.lit(0.0))


def parse_time(text: str | Column) -> Column:
    """ISO-8601 text to timestamp, NULL when it cannot be read."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def moment(at: dt.datetime) -> Column:
    """A Python time as a timestamp literal; without a zone it is UTC, whatever the driver's zone."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc))


def guess_flag(flag: str | Column) -> Column:
    """boolean, number or their text to 0/1."""
    col = F.col(flag) if isinstance(flag, str) else flag
    text = F.lower(col.cast("string"))
    return F.when(text.isin("true", "1"), 1).otherwise(0).cast("short")


def with_defaults(df: DataFrame) -> DataFrame:
    """optional flow columns that are missing or NULL become 0 or the empty string."""
    present = set(df.columns)
    defaults: dict[str, Column] = {}
    optional = [f.name for f in STATISTICS.fields] + ["application_confidence", "requested_server_name"]
    for field in FLOWS.fields:
        if field.name not in optional:
            continue
        zero = F.lit("" if field.dataType.simpleString() == "string" else 0).cast(field.dataType)
        defaults[field.name] = (
            F.coalesce(F.col(field.name).cast(field.dataType), zero) if field.name in present else zero
        )
    return df.withColumns(defaults)


def month_key(ts: str | Column) -> Column:
    """year and month as an integer, e.g. 202401."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(col) * 100 + F.month(col)).cast("int")


def round2(name: str) -> Column:
    """F18."""
    return F.round(F.col(name), 2)


def is_threat(label: str = "label") -> Column:
    """1 for every label but BENIGN (an UNKNOWN label is a threat)."""
    return (F.col(label) != BENIGN).cast("short")


def summary_text() -> Column:
    """one line of text for a scored flow."""
    return F.concat_ws(
        " ",
        F.col("label"), F.lit("flow from"), F.concat_ws(":", "src_ip", F.col("src_port").cast("string")),
        F.lit("to"), F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")),
        F.lit("protocol"), F.col("protocol").cast("string"),
        F.lit("packets"), F.col("bidirectional_packets").cast("string"),
        F.lit("bytes"), F.col("bidirectional_bytes").cast("string"),
        F.lit("duration_ms"), F.col("bidirectional_duration_ms").cast("string"),
    )


def feature_vector() -> Column:
    """the 22 model inputs in order, as 32-bit floats."""
    return F.array(*[F.col(name).cast("float") for name in FEATURES])


def feature_frame(flows: DataFrame) -> DataFrame:
    """F8: identity columns plus the 22 inputs (28 columns)."""
    return flows.select(
        "flow_id", "src_ip", "dst_ip",
        *[F.col(c).cast("int") for c in ("src_port", "dst_port", "protocol")],
        *FEATURES,
    )
