"""Stored tables, ingest, incremental classification and cursors, with restarts and replays."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowlens.operators.scoring import score
from flowlens.plans import monitor
from flowlens.plans.catalog import StoredTable
from flowlens.schemas import CLASSIFIED_FLOWS, CLASSIFIER_ALARMS, FLOWS, SECURITY_EVENTS
from flowlens.sources import storage
from flowlens.sources.flows import RAW, flow_stream, from_messages, typed
from flowlens.streaming import classify, cursor
from flowlens.streaming.classify import Outputs, start_classification, write_scored
from flowlens.streaming.counters import running_counters
from flowlens.streaming.ingest import start_ingest
from flowlens.operators import windows
from tests.test_functions import BASE, flows

DAY = dt.datetime(2024, 1, 1, 12)


def raw_record(i, **more):
    row = BASE | {"collected_at": "2024-01-01T12:00:00.5+00:00", "flow_id": f"f{i}", "application_is_guessed": True,
                  "packets_per_second": 1.5, "bytes_per_second": 2.5} | more
    return json.dumps(row)


def test_typed_records(spark):
    lines = [raw_record(1), raw_record(2, collected_at="never", bidirectional_packets=2**31 + 5, application_is_guessed=0),
             raw_record(3, bidirectional_bytes=2**64 - 1), raw_record(4, bidirectional_syn_packets=3)]
    messages = spark.createDataFrame([(x.encode(),) for x in lines], "value binary")
    rows = {r.flow_id: r for r in typed(from_messages(messages)).collect() if r.flow_id}
    assert rows["f1"].collected_at == dt.datetime(2024, 1, 1, 12, 0, 0, 500000)
    assert (rows["f1"].application_is_guessed, rows["f1"].bidirectional_syn_packets) == (1, 0)
    assert rows["f2"].collected_at is None and rows["f2"].bidirectional_packets == 2**31 + 5
    assert rows["f4"].bidirectional_syn_packets == 3
    assert typed(from_messages(messages)).schema.names == FLOWS.names


def test_ingest_restarts_without_loss_or_copies(spark, tmp_path):
    inbox, table, bad, mark = (str(tmp_path / n) for n in ("in", "flows", "bad", "mark"))

    def put(name, lines):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines))

    put("a.json", [raw_record(i) for i in range(5)] + ['{"flow_id": "broken", "bidirectional_bytes": 99999999999999999999}'])
    start_ingest(flow_stream(spark, inbox, 1), table, bad, mark).awaitTermination()
    put("b.json", [raw_record(i, collected_at="2024-02-01T00:00:00Z") for i in range(5, 8)])
    start_ingest(flow_stream(spark, inbox, 1), table, bad, mark).awaitTermination()
    start_ingest(flow_stream(spark, inbox, 1), table, bad, mark).awaitTermination()
    got = storage.read_table(spark, table, FLOWS, "collected_at")
    assert sorted(r.flow_id for r in got.collect()) == [f"f{i}" for i in range(8)]
    rejected = [r.value for r in spark.read.text(bad).collect()]
    assert len(rejected) == 1 and "broken" in rejected[0]
    february = storage.read_table(spark, table, FLOWS, "collected_at", since=dt.datetime(2024, 1, 31))
    assert february.count() == 3


def test_layout_prunes_months_and_sorts(spark, tmp_path):
    path = str(tmp_path / "t")
    df = flows(spark, ["a", "b"]).unionByName(flows(spark, ["c"], collected_at=dt.datetime(2024, 3, 5)))
    storage.append(df, path, "collected_at", storage.FLOW_ORDER, files=2)
    storage.append(df, path, "collected_at", storage.FLOW_ORDER, files=2)
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"yyyymm=202401", "yyyymm=202403"}
    march = storage.read_table(spark, path, FLOWS, "collected_at", dt.datetime(2024, 2, 1), dt.datetime(2024, 4, 1))
    assert [r.flow_id for r in march.collect()] == ["c", "c"]
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yyyymm" in plan and "GreaterThan(collected_at" in plan


def test_hot_month_is_written_by_several_tasks(spark, tmp_path):
    df = flows(spark, ["x"]).select("*").crossJoin(spark.range(4000).withColumnRenamed("id", "n"))
    df = df.withColumn("src_ip", F.col("n").cast("string")).drop("n")
    storage.append(df, str(tmp_path / "t"), "collected_at", storage.FLOW_ORDER, files=4)
    assert len(list((tmp_path / "t" / "yyyymm=202401").glob("*.parquet"))) == 4


def test_expire(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [dt.datetime(2023, 12, 30), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 20), dt.datetime(2024, 2, 2)]
    for i, day in enumerate(days):
        storage.overwrite_batch(flows(spark, [f"f{i}"], collected_at=day), path, i, "collected_at", storage.FLOW_ORDER)
    storage.expire(spark, path, FLOWS, "collected_at", 30, dt.datetime(2024, 2, 9))
    left = storage.read_table(spark, path, FLOWS, "collected_at")
    assert sorted(r.flow_id for r in left.collect()) == ["f2", "f3"]
    # Without batches, the month of the cut keeps its younger rows; a second time changes nothing.
    plain = str(tmp_path / "plain")
    both = flows(spark, ["old"], collected_at=days[1]).unionByName(flows(spark, ["young"], collected_at=days[2]))
    storage.append(both, plain, "collected_at", storage.FLOW_ORDER)
    for _ in range(2):
        storage.expire(spark, plain, FLOWS, "collected_at", 30, dt.datetime(2024, 2, 9))
        assert [r.flow_id for r in storage.read_table(spark, plain, FLOWS, "collected_at").collect()] == ["young"]


def test_generated_columns(spark):
    df = spark.createDataFrame([("a",), (None,)], "event_id string")
    rows = storage.with_generated(df, "event_id", "detected_at").collect()
    assert rows[0].event_id == "a" and len(rows[1].event_id) == 36 and rows[0].detected_at is not None


def test_json_lines_round_trip(spark, tmp_path):
    df = flows(spark, ["a", "b"], collected_at=dt.datetime(2024, 1, 1, 1, 2, 3, 456789))
    storage.export_json_lines(df, str(tmp_path / "x"))
    back = typed(spark.read.schema(RAW).json(str(tmp_path / "x")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


# --------------------------------------------------------------------------- classification


def _outputs(tmp_path):
    return Outputs(*(str(tmp_path / n) for n in ("classified", "events", "alarms")))


def _tables(spark, out):
    return (
        storage.read_table(spark, out.classified, CLASSIFIED_FLOWS, "collected_at"),
        storage.read_table(spark, out.events, SECURITY_EVENTS, "detected_at"),
        storage.read_table(spark, out.alarms, CLASSIFIER_ALARMS, "classified_at"),
    )


def test_replayed_batch_replaces_itself(spark, tmp_path):
    out = _outputs(tmp_path)
    scored = score(flows(spark, [f"f{i}" for i in range(50)]))
    for _ in range(2):
        write_scored(scored, 0, out)
    write_scored(score(flows(spark, ["g"])), 1, out)
    classified, events, alarms = _tables(spark, out)
    assert classified.count() == alarms.count() == 51
    assert events.count() == classified.filter("is_threat = 1").count()
    assert classified.select("flow_id").distinct().count() == 51


def test_crash_between_outputs_leaves_no_copies(spark, tmp_path, monkeypatch):
    """The run dies after the first table; the restarted query repeats the batch and replaces it."""
    out = _outputs(tmp_path)
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    flows(spark, [f"f{i}" for i in range(40)]).write.parquet(source)
    stream = lambda: spark.readStream.schema(FLOWS).parquet(source)

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(classify, "security_events", dies)
        with pytest.raises(Exception, match="lost"):
            start_classification(stream(), out, mark).awaitTermination()
    start_classification(stream(), out, mark).awaitTermination()
    classified, events, alarms = _tables(spark, out)
    assert classified.count() == alarms.count() == 40
    assert sorted(r.flow_id for r in events.collect()) == sorted(
        r.flow_id for r in classified.filter("is_threat = 1").collect())


def test_failed_audit_does_not_fail_the_batch(spark, tmp_path, monkeypatch, caplog):
    out = _outputs(tmp_path)
    monkeypatch.setattr(classify, "classifier_alarms", lambda *_: (_ for _ in ()).throw(RuntimeError("audit")))
    write_scored(score(flows(spark, ["a"])), 3, out)
    assert "audit rows of batch 3" in caplog.text
    assert storage.read_table(spark, out.classified, CLASSIFIED_FLOWS, "collected_at").count() == 1


def test_first_run_reads_a_day(spark, tmp_path):
    out = _outputs(tmp_path)
    source = str(tmp_path / "in")
    flows(spark, ["old"], collected_at=DAY - dt.timedelta(hours=30)).unionByName(
        flows(spark, ["new"], collected_at=DAY - dt.timedelta(hours=2))).write.parquet(source)
    start_classification(
        spark.readStream.schema(FLOWS).parquet(source), out, str(tmp_path / "mark"), since=DAY - dt.timedelta(days=1)
    ).awaitTermination()
    assert [r.flow_id for r in _tables(spark, out)[0].collect()] == ["new"]


# --------------------------------------------------------------------------- cursor


def test_pages_skip_nothing_when_times_tie(spark, tmp_path):
    """Six rows share one second, and the two at the first page's end share the id as well."""
    ids = ["a", "b", "e", "e", "f", "g"]
    df = flows(spark, ids, collected_at=DAY).unionByName(flows(spark, ["z"], collected_at=DAY + dt.timedelta(seconds=1)))
    out, state = _outputs(tmp_path), str(tmp_path / "state")
    sizes = []
    while True:
        before = cursor.load_cursor(spark, state, DAY + dt.timedelta(hours=1))
        reached = cursor.run_once(df, out, state, DAY + dt.timedelta(hours=1), limit=3)
        if reached == before:
            break
        sizes.append(storage.read_table(spark, out.classified, CLASSIFIED_FLOWS, "collected_at").count())
    assert sizes == [4, 7]
    assert reached.version == 2 and reached.flow_id == "z"


def test_cursor_state(spark, tmp_path):
    state = str(tmp_path / "state")
    first = cursor.load_cursor(spark, state, DAY)
    assert first.version == 0 and first.at_us == int((DAY - dt.timedelta(days=1)).replace(
        tzinfo=dt.timezone.utc).timestamp()) * 10**6
    cursor.save_cursor(spark, state, cursor.Cursor(1, 10, "a'\\"))
    cursor.save_cursor(spark, state, cursor.Cursor(2, 20, "b"))
    assert cursor.load_cursor(spark, state, DAY) == cursor.Cursor(2, 20, "b")
    # A cursor that was not completely written does not count.
    (tmp_path / "state" / "version=3").mkdir()
    assert cursor.load_cursor(spark, state, DAY).version == 2


def test_late_row_is_behind_the_cursor(spark):
    at = cursor.Cursor(1, int(DAY.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6, "m")
    df = flows(spark, ["a"], collected_at=DAY - dt.timedelta(seconds=1)).unionByName(flows(spark, ["m", "n"], collected_at=DAY))
    assert [r.flow_id for r in df.filter(cursor.after(at)).collect()] == ["n"]
    assert df.filter(cursor.after(cursor.Cursor(1, at.at_us))).count() == 0
    assert cursor.page(df.limit(0), at, 5).count() == 0
    assert cursor.last_of(df.limit(0)).first().flow_id is None


# --------------------------------------------------------------------------- windows and counters as streams


def test_streamed_windows_equal_batch(spark, views, tmp_path):
    classified = views.classified_flows.select("collected_at", "label").orderBy("collected_at").limit(200)
    closing = spark.createDataFrame([(dt.datetime(2030, 1, 1), "DoS")], "collected_at timestamp, label string")
    source = str(tmp_path / "in")
    classified.repartition(2).write.parquet(source)
    closing.write.mode("append").parquet(source)
    schema = classified.schema

    def streamed(fn, name):
        df = fn(spark.readStream.schema(schema).parquet(source))
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
            "checkpointLocation", str(tmp_path / f"{name}-mark")).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect())

    def batch(fn):
        return sorted(tuple(r) for r in fn(spark.read.schema(schema).parquet(source)).filter(
            "window_start < '2029-01-01'").select(*columns).collect())

    for fn, columns in ((lambda d: windows.rate_per_minute(d, "collected_at"), ["window_start", "per_minute", "per_second"]),
                        (lambda d: windows.label_counts(d, "collected_at"), ["window_start", "label", "n"])):
        assert streamed(fn, columns[-1]) == batch(fn)


def test_running_counters(spark, tmp_path):
    source = str(tmp_path / "in")
    df = flows(spark, ["a", "b", "c"])
    df.write.parquet(source)
    started = dt.datetime.now(dt.timezone.utc) - dt.timedelta(seconds=100)
    row = running_counters(df, started).first()
    assert row.flows_published == 3 and row.last_flow_at == DAY and 0 < row.flows_per_second <= 0.03
    stream = running_counters(spark.readStream.schema(FLOWS).parquet(source))
    stream.writeStream.format("memory").queryName("counters").outputMode("complete").trigger(
        availableNow=True).start().awaitTermination()
    assert spark.table("counters").first().flows_published == 3


def test_requests_over_stored_tables_read_only_their_months(spark, tmp_path):
    from flowlens.plans.catalog import Catalog, StoredTable
    from flowlens.plans.olap import olap_query

    path = str(tmp_path / "t")
    for i, month in enumerate((1, 2, 3)):
        storage.append(flows(spark, [f"m{month}"], collected_at=dt.datetime(2024, month, 9)), path, "collected_at",
                       storage.FLOW_ORDER)
    catalog = Catalog({"net.flows": StoredTable(spark, path, FLOWS, "collected_at")}, ["net.flows"])
    request = {"collection": "net.flows", "dimensions": ["flow_id"],
               "filters": [{"field": "collected_at", "op": "gte", "value": "2024-02-01T00:00:00+00:00"},
                           {"field": "collected_at", "op": "lt", "value": "2024-03-01T00:00:00Z"}]}
    found = olap_query(catalog, request)
    assert [r.flow_id for r in found.collect()] == ["m2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(yyyymm#" in plan and ">= 202401)" in plan and "<= 202403)" in plan
    joined = olap_query(catalog, {**request, "joins": [{
        "collection": "net.flows", "alias": "o", "on": [{"left": "src_ip", "right": "src_ip"}],
        "filters": [{"field": "collected_at", "op": "gt", "value": "2024-03-02"}]}], "dimensions": ["flow_id", "o.flow_id"]})
    assert [tuple(r) for r in joined.collect()] == [("m2", "m3")]
    assert olap_query(catalog, {"collection": "net.flows"}).columns == FLOWS.names


def test_relative_queries_read_only_their_months(spark, views, tmp_path):
    """The cursor and the last-day queries put a condition on the month into the scan."""
    path = str(tmp_path / "flows")
    storage.append(views.flows, path, "collected_at", storage.FLOW_ORDER)
    table = StoredTable(spark, path, FLOWS, "collected_at")
    now = F.lit("2024-02-03 00:00:00").cast("timestamp")
    for df in (monitor.since(table, "collected_at", "1 DAY", now), cursor.beyond(table, cursor.Cursor(1, 1706900000000000))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
        assert "yyyymm" in filters.split("PartitionFilters: [")[1].split("]")[0], filters


def test_page_ends_inside_a_second(spark, views):
    """Every page is the next flows in order, also where many share a second."""
    rows = views.flows.withColumn("collected_at", F.date_trunc("minute", "collected_at"))
    order = sorted((r["collected_at"], r["flow_id"]) for r in rows.select("collected_at", "flow_id").collect())
    start = cursor.Cursor(1, 0)
    for n in (1, 7, len(order) - 1, len(order), len(order) + 5):
        got = sorted(map(tuple, cursor.page(rows, start, n).select("collected_at", "flow_id").collect()))
        end = order[min(n, len(order)) - 1]
        assert got == [k for k in order if k <= end]


def test_scratch_is_removed(spark, views, tmp_path):
    """Intermediate tables lie in the application's own folder, and nothing of them stays."""
    import os

    from flowlens import session

    own = session.scratch_root(spark)
    kept = session.written(views.flows.limit(5), "some")
    assert kept.count() == 5 and os.listdir(own)
    mine = session.scratch_path(spark, "other")
    assert mine.startswith(own + "/")
    session.remove_scratch(spark)
    assert not os.path.exists(own)


def test_late_rows_are_written_by_many_tasks(views, spark, monkeypatch):
    """Each half of the flows is written as it is dealt, not by one task."""
    from flowlens.session import scratch_path
    from flowlens.suite import storage as suite

    paths = {}

    def scratch(session, name):
        return paths.setdefault(name, scratch_path(session, name))

    monkeypatch.setattr(suite, "scratch_path", scratch)

    class Dealt:
        flows = views.flows.repartition(4)

    Dealt.spark = spark
    suite._late_rows(Dealt).collect()
    files = spark.read.parquet(paths["late"]).inputFiles()
    assert len(files) == 8
