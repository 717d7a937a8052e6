"""Event embeddings, and batches of new events rolled up into incidents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.probabilities import text_hash
from flowlens.functions.scalar import summary_text
from flowlens.schemas import INCIDENTS

BATCH_SIZE = 50
DIMENSIONS = 384


def numbered(df: DataFrame, ts: str, tie: str, splits: int = 256) -> DataFrame:
    """Add ``position``: 0, 1, 2, ... by second of ``ts``, without sorting everything in one task.

    Events of one second have no order of their own (bulk writes give all rows one time), so inside a
    second they are placed by a hash of ``tie`` into ``splits`` groups, and by ``tie`` inside a group.
    Rows are ranked within (second, group); counts are summed up over groups, seconds of a day and days.
    """
    second = F.unix_seconds(F.col(ts))
    placed = df.withColumns({
        "_second": F.coalesce(second, F.lit(0)).cast("bigint"),
        "_group": F.coalesce(F.pmod(text_hash(F.col(tie).cast("string")), F.lit(splits)), F.lit(0)),
    })

    def before(counts: DataFrame, within: list[str], by: str, n: str, name: str) -> DataFrame:
        window = Window.partitionBy(*[F.col(c) for c in within] or [F.lit(0)]).orderBy(by)
        total = F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumn(name, F.coalesce(total, F.lit(0)))

    groups = placed.groupBy("_second", "_group").agg(F.count(F.lit(1)).alias("_n"))
    day = F.col("_second") - F.pmod(F.col("_second"), F.lit(86400))
    seconds = groups.groupBy("_second").agg(F.sum("_n").alias("_n")).withColumn("_day", day)
    days = before(seconds.groupBy("_day").agg(F.sum("_n").alias("_n")), [], "_day", "_n", "_days_before")
    starts = before(seconds, ["_day"], "_second", "_n", "_seconds_before").join(
        days.select("_day", "_days_before"), "_day"
    )
    offsets = (
        before(groups, ["_second"], "_group", "_n", "_groups_before")
        .join(starts.select("_second", "_seconds_before", "_days_before"), "_second")
        .select(
            "_second", "_group",
            (F.col("_groups_before") + F.col("_seconds_before") + F.col("_days_before")).alias("_offset"),
        )
    )
    rank = F.row_number().over(Window.partitionBy("_second", "_group").orderBy(tie))
    return (
        placed.withColumn("_rank", rank)
        .join(offsets, ["_second", "_group"])
        .withColumn("position", F.col("_offset") + F.col("_rank") - 1)
        .drop("_second", "_group", "_rank", "_offset")
    )


def incidents(
    events: DataFrame, tie: str = "event_id", batch_size: int = BATCH_SIZE, similar: DataFrame | None = None
) -> DataFrame:
    """One incident per label in every batch of ``batch_size`` consecutive events.

    A batch bounds the hosts and context ids of its incidents, whatever a label's share of all events.
    ``similar`` (tie column, ``id``) gives the stored neighbours of each event for ``rag_context_ids``.
    ``recommended_action`` stays NULL.
    """
    placed = numbered(events, "detected_at", tie).withColumn(
        "batch", F.floor(F.col("position") / batch_size).cast("bigint")
    )
    rolled = placed.groupBy("batch", "label").agg(
        F.min("detected_at").alias("detected_at"),
        F.array_sort(F.collect_set("dst_ip")).alias("affected_hosts"),
        F.avg(F.col("confidence").cast("double")).alias("confidence"),
        F.count(F.lit(1)).alias("events"),
    )
    if similar is None:
        rolled = rolled.withColumn("rag_context_ids", F.array().cast("array<bigint>"))
    else:
        context = (
            placed.select(tie, "batch", "label").join(similar.select(tie, "id"), tie)
            .groupBy("batch", "label").agg(F.array_sort(F.collect_set("id")).alias("rag_context_ids"))
        )
        rolled = rolled.join(context, ["batch", "label"], "left").withColumn(
            "rag_context_ids", F.coalesce("rag_context_ids", F.array().cast("array<bigint>"))
        )
    return rolled.withColumns({
        "incident_id": F.expr("uuid()"),
        "attack_type": F.col("label"),
        "recommended_action": F.lit(None).cast("string"),
        "summary": F.concat_ws(
            " ", F.col("events").cast("string"), F.col("label"), F.lit("events against"),
            F.size("affected_hosts").cast("string"), F.lit("hosts"),
        ),
    }).select("batch", "events", *[f.name for f in INCIDENTS.fields])


def embed(events: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """A normalised hashed bag of words of the one-line summary, as ``embedding`` (array of float).

    A word's place is its :func:`text_hash` modulo ``dimensions``. Stands in for a sentence encoder, which would
    be such an Arrow UDF over ``summary`` too.
    """
    @F.arrow_udf("array<float>")
    def bag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, int] = {}
        for batch in batches:
            if len(places) > 1_000_000:
                places.clear()
            rows = np.zeros((len(batch), dimensions))
            for row, text in zip(rows, batch.to_pylist()):
                for word in (text or "").lower().split():
                    if word not in places:
                        places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimensions
                    row[places[word]] += 1
            norm = np.linalg.norm(rows, axis=1, keepdims=True)
            unit = np.divide(rows, norm, out=rows, where=norm > 0).astype(np.float32)
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * dimensions
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))

    return events.withColumn("summary", summary_text()).withColumn("embedding", bag("summary"))
