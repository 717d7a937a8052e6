"""Registered queries for stored tables, streams and cursors.

Each writes below the shared folder and returns what it reads back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowlens.operators import incidents, windows
from flowlens.operators.augment import classified_flows
from flowlens.operators.scoring import score
from flowlens.plans import monitor
from flowlens.plans.catalog import StoredTable
from flowlens.schemas import CLASSIFIED_FLOWS, CLASSIFIER_ALARMS, FETCH_COLUMNS, FLOWS, SECURITY_EVENTS
from flowlens.session import scratch_path
from flowlens.sources import pcap, storage
from flowlens.sources.flows import flow_stream
from flowlens.streaming import cursor
from flowlens.streaming.classify import Outputs, start_classification, start_threats
from flowlens.streaming.counters import running_counters
from flowlens.streaming.incidents import start_incidents
from flowlens.streaming.ingest import start_ingest
from flowlens.streaming.meter import start_metering
from flowlens.suite.flows import ACTIVE_S, IDLE_S, METERED_SQL
from flowlens.suite.monitoring import NOW
from flowlens.suite.registry import query, register
from flowlens.suite.requests import rounded
from flowlens.suite.scoring import _AUDIT, _CLASSIFIED, _EVENTS, opened
from flowlens.suite.views import Views, _hash

_FLOW_COLUMNS = ", ".join(f.name for f in FLOWS.fields)
MID_MONTH = dt.datetime(2024, 1, 15)

register("s3_scan_columns", lambda v: storage.fetch_columns(v.flows), f"SELECT {', '.join(FETCH_COLUMNS)} FROM flows")


@query("s2_ingest_stream", f"SELECT {_FLOW_COLUMNS} FROM flows")
def _ingest(v: Views):
    """Flows as JSON lines (S11), streamed back into a stored table."""
    raw, table, bad, mark = (scratch_path(v.spark, n) for n in ("raw", "flows", "rejected", "ingest"))
    storage.export_json_lines(v.flows, raw)
    start_ingest(flow_stream(v.spark, raw), table, bad, mark).awaitTermination()
    return storage.read_table(v.spark, table, FLOWS, "collected_at")


@query("s4_append_classified", f"SELECT {_CLASSIFIED} FROM classified_flows")
def _append(v: Views):
    path = scratch_path(v.spark, "classified")
    storage.append(v.classified_flows, path, "collected_at", ["collected_at", "label", "src_ip"])
    return opened(storage.read_table(v.spark, path, CLASSIFIED_FLOWS, "collected_at"))


@query("s8_month_layout", f"SELECT {_FLOW_COLUMNS} FROM flows WHERE collected_at > TIMESTAMP '2024-01-15' "
                          "AND collected_at <= TIMESTAMP '2024-01-22'")
def _layout(v: Views):
    path = scratch_path(v.spark, "flows")
    storage.append(v.flows, path, "collected_at", storage.FLOW_ORDER)
    return storage.read_table(v.spark, path, FLOWS, "collected_at", MID_MONTH, MID_MONTH + dt.timedelta(days=7))


register("s9_retain",
         lambda v: storage.retain(v.flows, "collected_at", 10, v.flows.agg(F.max("collected_at")).scalar())
         .select("flow_id", "collected_at"),
         "SELECT flow_id, collected_at FROM flows "
         "WHERE collected_at + INTERVAL 10 DAY >= (SELECT max(collected_at) FROM flows)")


@query("s10_generated", "SELECT count(*) AS n, count(*) FILTER (src_port % 2 = 0) AS kept, "
                        "count(*) FILTER (src_port % 2 <> 0) AS fresh, count(*) FILTER (src_port % 2 <> 0) AS uuids, "
                        "count(*) AS timed FROM flows")
def _generated(v: Views):
    """Every second flow brings an id; the others get distinct ids of UUID form, all a time."""
    given = F.col("src_port") % 2 == 0
    rows = storage.with_generated(v.flows.withColumn("event_id", F.when(given, F.col("flow_id"))), "event_id", "seen_at")
    uuid = F.col("event_id").rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(given & (F.col("event_id") == F.col("flow_id"))).alias("kept"),
        F.count_distinct(F.when(~given, F.col("event_id"))).alias("fresh"), F.count_if(~given & uuid).alias("uuids"),
        F.count("seen_at").alias("timed"))


@query("s9_expire", "SELECT flow_id, collected_at FROM flows WHERE collected_at >= TIMESTAMP '2024-01-15'")
def _expire(v: Views):
    path = scratch_path(v.spark, "flows")
    storage.append(v.flows, path, "collected_at", storage.FLOW_ORDER)
    days = storage.RETENTION_DAYS["flows"]
    storage.expire(v.spark, path, FLOWS, "collected_at", days, MID_MONTH + dt.timedelta(days=days))
    return storage.read_table(v.spark, path, FLOWS, "collected_at").select("flow_id", "collected_at")


@query("s8_merged_months", f"SELECT {_CLASSIFIED} FROM classified_flows WHERE collected_at >= TIMESTAMP '2024-01-10'")
def _merged_months(v: Views):
    """Flows classified in six batches into a snapshot table, whose months are merged, expired and cleaned."""
    source = scratch_path(v.spark, "flows")
    v.flows.repartition(6, "flow_id").write.parquet(source)
    out = Outputs(*(scratch_path(v.spark, n) for n in ("classified", "events")), snapshots=True)
    stream = v.spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(source)
    start_classification(stream, out, scratch_path(v.spark, "classify"), now=F.col("collected_at")).awaitTermination()
    table = out.table(v.spark, "classified")
    table.merge(dt.datetime(2100, 1, 1))
    table.expire(storage.RETENTION_DAYS["classified_flows"], dt.datetime(2024, 1, 10) + dt.timedelta(days=30))
    table.clean()
    return opened(table.read())


# ------------------------------------------------------------------ incremental classification


def _classified_stream(v: Views) -> Outputs:
    out = Outputs(*(scratch_path(v.spark, n) for n in ("classified", "events", "alarms")))
    start_classification(
        v.flows_of(v.event_stream()), out, scratch_path(v.spark, "classify"), now=F.col("collected_at")
    ).awaitTermination()
    return out


@query("t2_incremental_classification", f"SELECT {_CLASSIFIED} FROM classified_flows")
def _classify(v: Views):
    out = _classified_stream(v)
    return opened(storage.read_table(v.spark, out.classified, CLASSIFIED_FLOWS, "collected_at"))


@query("t6_events_output", _EVENTS)
def _events_output(v: Views):
    out = _classified_stream(v)
    return opened(storage.read_table(v.spark, out.events, SECURITY_EVENTS, "detected_at").drop("event_id"))


@query("s6_audit_output", _AUDIT)
def _audit_output(v: Views):
    out = _classified_stream(v)
    return rounded(storage.read_table(v.spark, out.alarms, CLASSIFIER_ALARMS, "classified_at").drop("alarm_id"))


@query("t11_threat_stream", f"SELECT {_CLASSIFIED} FROM security_events")
def _threats(v: Views):
    path = scratch_path(v.spark, "threats")
    stream = classified_flows(score(v.flows_of(v.event_stream())), now=F.col("collected_at"))
    start_threats(stream, path, scratch_path(v.spark, "threats-mark")).awaitTermination()
    return opened(v.spark.read.schema(CLASSIFIED_FLOWS).parquet(path))


@query("t3_cursor_runs", f"SELECT {_CLASSIFIED} FROM classified_flows "
                         "WHERE collected_at > (SELECT min(collected_at) FROM flows)")
def _runs(v: Views):
    """Runs of a third of the flows each, until the cursor stays; the first run starts a day back."""
    out = Outputs(*(scratch_path(v.spark, n) for n in ("classified", "events")))
    state = scratch_path(v.spark, "cursor")
    start, total = v.flows.agg(F.unix_micros(F.min("collected_at")), F.count(F.lit(1))).first()
    now = dt.datetime(1970, 1, 2) + dt.timedelta(microseconds=start)
    version = -1
    while True:
        reached = cursor.run_once(v.flows, out, state, now, limit=total // 3 + 1)
        if reached.version == version:
            break
        version = reached.version
    found = storage.read_table(v.spark, out.classified, CLASSIFIED_FLOWS, "collected_at")
    return opened(found.withColumn("classified_at", F.col("collected_at")))


CURSOR_US = int(MID_MONTH.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
register("p19_cursor", lambda v: v.flows.filter(cursor.after(cursor.Cursor(1, CURSOR_US))).select("flow_id", "collected_at"),
         "SELECT flow_id, collected_at FROM flows WHERE collected_at > TIMESTAMP '2024-01-15'")
register("o4_page",
         lambda v: cursor.page(v.flows, cursor.Cursor(1, CURSOR_US), 256).select("flow_id", "collected_at"),
         "SELECT flow_id, collected_at FROM flows WHERE collected_at > TIMESTAMP '2024-01-15' "
         "ORDER BY collected_at, flow_id LIMIT 256")


def _stored(v: Views, name: str) -> StoredTable:
    """Flows or security events as a stored table, in months."""
    path = scratch_path(v.spark, name)
    if name == "flows":
        storage.append(v.flows, path, "collected_at", storage.FLOW_ORDER)
        return StoredTable(v.spark, path, FLOWS, "collected_at")
    storage.append(v.security_events, path, "detected_at", ["detected_at", "label", "src_ip"])
    return StoredTable(v.spark, path, SECURITY_EVENTS, "detected_at")


def _stored_now(v: Views):
    return v.security_events.agg(F.max("detected_at")).scalar()


register("p19_cursor_stored",
         lambda v: cursor.beyond(_stored(v, "flows"), cursor.Cursor(1, CURSOR_US)).select("flow_id", "collected_at"),
         "SELECT flow_id, collected_at FROM flows WHERE collected_at > TIMESTAMP '2024-01-15'")
register("o4_page_stored",
         lambda v: cursor.page(_stored(v, "flows"), cursor.Cursor(1, CURSOR_US), 256).select("flow_id", "collected_at"),
         "SELECT flow_id, collected_at FROM flows WHERE collected_at > TIMESTAMP '2024-01-15' "
         "ORDER BY collected_at, flow_id LIMIT 256")
register("d2_attack_breakdown_stored",
         lambda v: rounded(monitor.attack_breakdown(_stored(v, "events"), _stored_now(v))),
         "SELECT label, count(*) AS count, round(avg(cast(confidence AS double)), 4) AS avg_confidence "
         f"FROM security_events WHERE detected_at > {NOW} - INTERVAL 1 DAY GROUP BY label")
register("d3_top_sources_stored",
         lambda v: monitor.top_sources(_stored(v, "events"), _stored_now(v)),
         f"SELECT src_ip, count(*) AS events FROM security_events WHERE detected_at > {NOW} "
         "- INTERVAL 1 HOUR GROUP BY src_ip ORDER BY events DESC, src_ip LIMIT 20")
register("t4_cursor_advance", lambda v: cursor.last_of(v.flows),
         "SELECT collected_at, flow_id FROM flows ORDER BY collected_at DESC, flow_id DESC LIMIT 1")
register("t12_counters", lambda v: running_counters(v.flows),
         "SELECT count(*) AS flows_published, max(collected_at) AS last_flow_at FROM flows")

# ------------------------------------------------------------------ windows and counters as streams


def _final(v: Views, stream, name: str):
    """A stream's whole result after its last batch: complete output, each batch replacing the one before."""
    path, mark = scratch_path(v.spark, name), scratch_path(v.spark, f"{name}-mark")

    def write(batch, _):
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", mark).trigger(
        availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(path)


def _stream(v: Views):
    return classified_flows(score(v.flows_of(v.event_stream())), now=F.col("collected_at"))


register("t8_flow_rate_stream",
         lambda v: rounded(_final(v, windows.rate_per_minute(v.flows_of(v.event_stream()), "collected_at"), "rates")),
         "SELECT date_trunc('minute', collected_at) AS window_start, count(*) AS per_minute, "
         "round(count(*) / 60.0e0, 4) AS per_second FROM flows GROUP BY 1")
register("t9_event_rate_stream",
         lambda v: rounded(_final(v, windows.rate_per_minute(windows.threats(_stream(v)), "collected_at"), "events")),
         "SELECT date_trunc('minute', collected_at) AS window_start, count(*) AS per_minute, "
         "round(count(*) / 60.0e0, 4) AS per_second FROM classified_flows WHERE label <> 'BENIGN' GROUP BY 1")
register("t10_label_window_stream", lambda v: _final(v, windows.label_counts(_stream(v), "collected_at"), "labels"),
         "SELECT date_trunc('minute', collected_at) - to_minutes(k) AS window_start, label, count(*) AS n "
         "FROM classified_flows, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE label <> 'BENIGN' GROUP BY 1, 2")
register("t12_counters_stream", lambda v: _final(v, running_counters(v.flows_of(v.event_stream())), "counters"),
         "SELECT count(*) AS flows_published, max(collected_at) AS last_flow_at FROM flows")


@query("t13_late_rows", "SELECT date_trunc('minute', collected_at) AS window_start, count(*) AS per_minute FROM flows "
                        "WHERE collected_at < (SELECT date_trunc('minute', max(collected_at) - INTERVAL 2 DAY) FROM flows) "
                        "AND collected_at >= TIMESTAMP '2024-01-15' GROUP BY 1")
def _late_rows(v: Views):
    """Newer flows first, then the older half: windows that the watermark has passed are out and lose late rows."""
    source = scratch_path(v.spark, "late")
    v.flows.filter(F.col("collected_at") >= F.lit(MID_MONTH)).write.parquet(source)
    out, mark = scratch_path(v.spark, "late-out"), scratch_path(v.spark, "late-mark")

    def run():
        stream = v.spark.readStream.schema(FLOWS).parquet(source)
        rates = windows.rate_per_minute(stream, "collected_at", late="2 days").select("window_start", "per_minute")
        rates.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
            availableNow=True).start().awaitTermination()

    run()
    v.flows.filter(F.col("collected_at") < F.lit(MID_MONTH)).write.mode("append").parquet(source)
    run()
    return v.spark.read.parquet(out)


# ------------------------------------------------------------------ metering and incidents as streams

LATE_S = 10


@query("t7_meter_stream", METERED_SQL + f"""
SELECT src_ip, dst_ip, src_port, dst_port, first_ms, last_ms, packets, bytes FROM (
 SELECT *, lead(first_ms) OVER (PARTITION BY least(src_ip, dst_ip), greatest(src_ip, dst_ip),
   least(src_port, dst_port), greatest(src_port, dst_port) ORDER BY first_ms) AS following,
  (SELECT max(t) FROM pairs) - {LATE_S * 1000} AS mark FROM metered) f
WHERE following IS NOT NULL OR last_ms + {IDLE_S * 1000} + 1 < mark""")
def _meter_stream(v: Views):
    """The flows a stream has finished after two batches: those a later packet or the watermark has ended."""
    source, path, state, mark = (scratch_path(v.spark, n) for n in ("packets", "metered", "open-flows", "metered-mark"))

    def run():
        stream = v.spark.readStream.schema(v.packets.schema).parquet(source)
        start_metering(stream, path, state, mark, IDLE_S, ACTIVE_S, LATE_S).awaitTermination()

    early = F.col("ts") < F.lit(MID_MONTH).cast("timestamp")
    v.packets.filter(early).write.parquet(source)
    run()
    v.packets.filter(~early).write.mode("append").parquet(source)
    run()
    return v.spark.read.schema(FLOWS).parquet(path).select(
        "src_ip", "dst_ip", "src_port", "dst_port", F.col("bidirectional_first_seen_ms").alias("first_ms"),
        F.col("bidirectional_last_seen_ms").alias("last_ms"), F.col("bidirectional_packets").alias("packets"),
        F.col("bidirectional_bytes").alias("bytes"))


_SUMMARY = ("concat_ws(' ', label, 'flow from', src_ip || ':' || src_port, 'to', dst_ip || ':' || dst_port, 'protocol', "
            "protocol, 'packets', bidirectional_packets, 'bytes', bidirectional_bytes, 'duration_ms', "
            "bidirectional_duration_ms)")
register("e1_embedding",
         lambda v: incidents.embed(v.security_events).select("flow_id", "summary", F.posexplode("embedding").alias("place", "x"))
         .filter("x <> 0").select("flow_id", "summary", "place", F.round(F.col("x").cast("double"), 5).alias("x")),
         f"""
WITH said AS (SELECT flow_id, {_SUMMARY} AS summary FROM security_events),
word AS (SELECT flow_id, summary, unnest(string_split_regex(lower(summary), '\\s+')) AS w FROM said),
n AS (SELECT flow_id, summary, cast({_hash("w")} % 384 AS int) AS place, count(*) AS n FROM word GROUP BY ALL)
SELECT flow_id, summary, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY flow_id)), 5) AS x FROM n""")


#: A batch of the stream in SQL: embeddings, positions in groups of 50, and the five nearest of the earlier batch.
E3_SQL = f"""
WITH batched AS (SELECT *, CASE WHEN detected_at < TIMESTAMP '{MID_MONTH}' THEN 0 ELSE 1 END AS batch_id,
  ('0x' || substr(md5(flow_id), 1, 15))::BIGINT AS vid FROM security_events),
word AS (SELECT flow_id, batch_id, vid, unnest(string_split_regex(lower({_SUMMARY}), '\\s+')) AS w FROM batched),
place AS (SELECT flow_id, batch_id, vid, cast({_hash("w")} % 384 AS int) AS place, count(*) AS n FROM word GROUP BY ALL),
part AS MATERIALIZED (SELECT *, cast(n / sqrt(sum(n * n) OVER (PARTITION BY flow_id, vid)) AS float)::DOUBLE AS x FROM place),
norm AS (SELECT flow_id, vid, batch_id, sqrt(sum(x * x)) AS norm FROM part GROUP BY ALL),
dot AS (SELECT q.flow_id, b.vid, sum(q.x * b.x) AS dot FROM part q JOIN part b USING (place)
 WHERE q.batch_id = 1 AND b.batch_id = 0 GROUP BY q.flow_id, b.vid),
near AS (SELECT d.flow_id, d.vid FROM dot d JOIN norm q ON q.flow_id = d.flow_id JOIN norm b ON b.vid = d.vid
 QUALIFY row_number() OVER (PARTITION BY d.flow_id ORDER BY round(1 - dot / (q.norm * b.norm), 6) + 0, d.vid) <= 5),
placed AS (SELECT *, (row_number() OVER (PARTITION BY batch_id ORDER BY date_trunc('second', detected_at),
  {_hash("flow_id")} % 256, flow_id) - 1) // 50 AS batch FROM batched),
context AS (SELECT batch_id, batch, label, string_agg(DISTINCT near.vid::VARCHAR, ',' ORDER BY near.vid::VARCHAR) AS ids
 FROM placed JOIN near USING (flow_id) GROUP BY ALL)
SELECT p.batch_id, p.batch, p.label AS attack_type, min(detected_at) AS detected_at, count(*) AS events,
 array_to_string(list_sort(list_distinct(list(dst_ip))), ',') AS affected_hosts,
 round(avg(cast(confidence AS double)), 4) AS confidence, coalesce(any_value(c.ids), '') AS rag_context_ids,
 concat_ws(' ', count(*), p.label, 'events against', count(DISTINCT dst_ip), 'hosts') AS summary
FROM placed p LEFT JOIN context c ON c.batch_id = p.batch_id AND c.batch = p.batch AND c.label = p.label
GROUP BY p.batch_id, p.batch, p.label"""


@query("e3_incident_stream", E3_SQL)
def _incident_stream(v: Views):
    """Incidents from the stream of security events in two batches, with the similar earlier events of each."""
    vectors, out, mark = (scratch_path(v.spark, n) for n in ("vectors", "incidents", "incidents-mark"))
    source = scratch_path(v.spark, "events")
    events = v.security_events.withColumn("event_id", F.col("flow_id"))
    early = F.col("detected_at") < F.lit(MID_MONTH).cast("timestamp")

    def run():
        stream = v.spark.readStream.schema(SECURITY_EVENTS).parquet(source)
        start_incidents(stream, vectors, out, mark, leaves=32).awaitTermination()

    events.filter(early).write.parquet(source)
    run()
    events.filter(~early).write.mode("append").parquet(source)
    run()
    ids = F.array_join(F.array_sort(F.transform("rag_context_ids", lambda x: x.cast("string"))), ",")
    return v.spark.read.parquet(out).select(
        "batch_id", "batch", "attack_type", "detected_at", "events", F.array_join("affected_hosts", ",").alias("affected_hosts"),
        F.round("confidence", 4).alias("confidence"), ids.alias("rag_context_ids"), "summary").withColumn(
        "batch_id", F.col("batch_id").cast("bigint"))


@query("s7_capture_round_trip", "SELECT ts, src_ip, dst_ip, src_port, dst_port, protocol, ip_version, "
       "greatest(size, 54) AS size, syn, ack, psh, rst, fin FROM packets")
def _capture_round_trip(v: Views):
    """All packets written as capture files and read back, each file by many tasks."""
    folder = scratch_path(v.spark, "captures")
    pcap.write_packets(v.packets, folder, 3)
    return pcap.read_packets(v.spark, f"{folder}/*.pcap", chunk_bytes=1 << 16).drop("seq")
