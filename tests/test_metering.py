"""Metering against a plain packet-by-packet meter, for batch and stream."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowlens.operators import metering
from flowlens.schemas import FLOWS, PACKETS
from flowlens.streaming.meter import OpenFlows, idle_sessions, meter_batch, start_metering

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FLAGS = metering.FLAGS


def packet(ms, seq, src, dst, size=60, flags=(), protocol=6):
    return (EPOCH + dt.timedelta(milliseconds=ms), seq, src[0], dst[0], src[1], dst[1], protocol, 4, size,
            *[f in flags for f in FLAGS])


def traffic(seed, n, pairs, span_ms, hot=1 / 3):
    """Random packets; a third belong to the first pair, and many share a millisecond."""
    rng = random.Random(seed)
    ends = [((f"10.0.0.{i}", 1000 + i), (f"10.0.{i % 3}.9", 80)) for i in range(pairs)]
    times = sorted(rng.choice([rng.randrange(span_ms), rng.randrange(0, span_ms, 50)]) for _ in range(n))
    out = []
    for seq, ms in enumerate(times):
        a, b = ends[0] if rng.random() < hot else rng.choice(ends)
        if rng.random() < 0.4:
            a, b = b, a
        out.append(packet(ms, seq, a, b, rng.randrange(40, 1500), [f for f in FLAGS if rng.random() < 0.3]))
    return out


def plain_meter(packets, idle_ms, active_ms):
    """One packet at a time, in order."""
    flows, open_flows = [], {}
    for p in sorted(packets, key=lambda p: (p[0], p[1])):
        t = (p[0] - EPOCH) // dt.timedelta(milliseconds=1)
        src, dst = (p[2], p[4]), (p[3], p[5])
        key = (*sorted([src, dst]), p[6])
        flow = open_flows.get(key)
        if flow and (t - flow["times"][-1] > idle_ms or (active_ms is not None and t - flow["times"][0] > active_ms)):
            flow = None
        if flow is None:
            flow = {"src": src, "dst": dst, "times": [], "sizes": [], "forward": [], "flags": []}
            flows.append(flow)
            open_flows[key] = flow
        flow["times"].append(t)
        flow["sizes"].append(p[8])
        flow["forward"].append(src == flow["src"])
        flow["flags"].append(p[9:])
    return flows


def expected(flows):
    out = {}
    for f in flows:
        gaps = [b - a for a, b in zip(f["times"], f["times"][1:])]
        spread = lambda v: statistics.stdev(v) if len(v) > 1 else 0.0
        first = f["times"][0]
        out[(f["src"], f["dst"], first)] = (
            f["times"][-1] - first, len(f["sizes"]), sum(f["sizes"]), sum(f["forward"]),
            sum(s for s, w in zip(f["sizes"], f["forward"]) if w),
            min(f["sizes"]), statistics.mean(f["sizes"]), spread(f["sizes"]), max(f["sizes"]),
            min(gaps, default=0), statistics.mean(gaps) if gaps else 0, spread(gaps), max(gaps, default=0),
            *[sum(v) for v in zip(*f["flags"])],
        )
    return out


def found(rows):
    base = int(EPOCH.timestamp() * 1000)
    return {
        ((r.src_ip, r.src_port), (r.dst_ip, r.dst_port), r.bidirectional_first_seen_ms - base): (
            r.bidirectional_duration_ms, r.bidirectional_packets, r.bidirectional_bytes, r.src2dst_packets,
            r.src2dst_bytes, r.bidirectional_min_ps, r.bidirectional_mean_ps, r.bidirectional_stddev_ps,
            r.bidirectional_max_ps, r.bidirectional_min_piat_ms, r.bidirectional_mean_piat_ms,
            r.bidirectional_stddev_piat_ms, r.bidirectional_max_piat_ms,
            *[r[f"bidirectional_{f}_packets"] for f in FLAGS],
        )
        for r in rows
    }


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-4, abs=1e-3), key


@pytest.mark.parametrize("seed,idle_s,active_s,slice_s", [
    (1, 0.3, None, 1), (2, 0.3, 2, 1), (3, 5, 1, 1), (4, 1, 1.5, 3600), (5, 0.05, 0.4, 2), (6, 30, 3, 5),
])
def test_batch_meter_equals_plain_meter(spark, seed, idle_s, active_s, slice_s):
    packets = traffic(seed, 1500, 6, 60_000)
    df = spark.createDataFrame(packets, PACKETS).repartition(5)
    got = found(metering.meter(df, idle_s, active_s, slice_s).collect())
    same(got, expected(plain_meter(packets, idle_s * 1000, None if active_s is None else active_s * 1000)))


def test_boundaries_are_exclusive(spark):
    a, b = ("10.0.0.1", 5), ("10.0.0.2", 6)
    times = [0, 100, 200, 301, 401]  # gaps of exactly 100 stay, 101 splits
    packets = [packet(t, i, a, b) for i, t in enumerate(times)]
    df = spark.createDataFrame(packets, PACKETS)
    starts = lambda **k: sorted(r[0] % 1000 for r in metering.meter(df, **k).select(
        "bidirectional_first_seen_ms").collect())
    assert starts(idle_s=0.1, active_s=None) == [0, 301]
    assert starts(idle_s=0.2, active_s=0.2) == [0, 301]
    assert starts(idle_s=0.2, active_s=0.199) == [0, 200, 401]


def test_first_sender_is_the_source(spark):
    a, b = ("10.0.0.9", 5), ("10.0.0.2", 6)
    df = spark.createDataFrame([packet(0, 1, a, b), packet(0, 0, b, a), packet(1, 2, a, b)], PACKETS)
    row = metering.meter(df).first()
    assert (row.src_ip, row.dst_ip, row.src2dst_packets, row.dst2src_packets) == ("10.0.0.2", "10.0.0.9", 1, 2)
    assert row.flow_id == "10.0.0.2:6->10.0.0.9:5:6"


def test_empty_and_single(spark):
    assert metering.meter(spark.createDataFrame([], PACKETS)).count() == 0
    one = metering.meter(spark.createDataFrame([packet(5, 0, ("1.1.1.1", 1), ("2.2.2.2", 2), 99)], PACKETS)).first()
    assert (one.bidirectional_stddev_ps, one.bidirectional_mean_piat_ms, one.packets_per_second) == (0, 0, 0)
    assert one.bidirectional_bytes == 99


def test_hot_instant_is_merged_before_the_shuffle(spark):
    """All packets in one millisecond of one pair become one row per map task."""
    df = spark.range(100_000).select(
        F.lit(EPOCH).cast("timestamp").alias("ts"), F.col("id").alias("seq"), F.lit("1.1.1.1").alias("src_ip"),
        F.lit("2.2.2.2").alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"),
        F.lit(6).cast("short").alias("protocol"), F.lit(4).cast("short").alias("ip_version"),
        F.lit(50).cast("bigint").alias("size"), *[F.lit(False).alias(f) for f in FLAGS])
    merged = metering.merge_instants(metering.with_pair(df), 60_000)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange")  # the tree lists the partial step below it
    assert merged.first()["n"] == 100_000


def _as_stream(spark, packets, path, parts):
    """The packets in ``parts`` files, in order of time, one per batch."""
    size = -(-len(packets) // parts)
    for i in range(parts):
        part = packets[i * size:(i + 1) * size]
        spark.createDataFrame(part, PACKETS).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(path)


def _run(df, out, mark, mode="append"):
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option(
        "checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("seed,idle_s,active_s,chase_rows", [(7, 0.3, 2, 100_000), (8, 3, 1, 40)])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, seed, idle_s, active_s, chase_rows):
    """With a closing packet far in the future every earlier flow is finished and must be there.

    Sessions are cut by a pass over their times, and those of more than ``chase_rows`` packets by pointers.
    """
    monkeypatch.setattr(metering, "CHASE_ROWS", chase_rows)
    packets = traffic(seed, 300, 4, 15_000)
    end = packet(10_000_000, 10**6, ("9.9.9.9", 9), ("8.8.8.8", 8))
    stream = _as_stream(spark, packets + [end], str(tmp_path / "in"), 3)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    start_metering(stream, out, state, str(tmp_path / "mark"), idle_s, active_s, 1).awaitTermination()
    rows = spark.read.schema(FLOWS).parquet(out).filter("src_ip != '9.9.9.9'").collect()
    same(found(rows), expected(plain_meter(packets, idle_s * 1000, active_s * 1000)))


def test_large_sessions_follow_pointers(spark, monkeypatch):
    monkeypatch.setattr(metering, "CHASE_ROWS", 300)
    packets = traffic(12, 1500, 4, 60_000)
    df = spark.createDataFrame(packets, PACKETS).repartition(5)
    same(found(metering.meter(df, 2, 3, 1).collect()), expected(plain_meter(packets, 2000, 3000)))


def test_a_replayed_batch_gives_the_same_flows(spark, tmp_path):
    packets = traffic(13, 400, 4, 20_000)
    halves = [spark.createDataFrame(p, PACKETS) for p in (packets[:200], packets[200:])]
    state, out = OpenFlows(spark, str(tmp_path / "state")), str(tmp_path / "out")
    for batch_id, number in ((0, 0), (1, 1), (1, 1)):
        meter_batch(halves[number], batch_id, out, state, 1, 2, 1, 1)
    closed = found(spark.read.schema(FLOWS).parquet(out).collect())
    left = found(metering.flows_from_sums(state.before(2)[0]).collect())
    assert not closed.keys() & left.keys() and left
    same(closed | left, expected(plain_meter(packets, 1000, 2000)))


def test_packets_that_arrive_late_count_at_the_last_time(spark, tmp_path):
    """The open flow's last packet is at 900; one of 300 that comes after it counts there, also in the same instant."""
    a, b = ("10.0.0.1", 5), ("10.0.0.2", 6)
    state, out = OpenFlows(spark, str(tmp_path / "state")), str(tmp_path / "out")
    batches = [[packet(900, 0, b, a, 10)], [packet(300, 1, a, b, 20), packet(950, 2, a, b, 30)], [packet(99_000, 3, a, b)]]
    for batch_id, rows in enumerate(batches):
        meter_batch(spark.createDataFrame(rows, PACKETS), batch_id, out, state, 1, 5, 1, 1)
    row = spark.read.schema(FLOWS).parquet(out).first()
    assert (row.src_ip, row.bidirectional_packets, row.bidirectional_bytes, row.bidirectional_duration_ms) == ("10.0.0.2", 3, 60, 50)
    assert (row.bidirectional_min_piat_ms, row.bidirectional_max_piat_ms, row.src2dst_packets) == (0, 50, 1)
    assert state.before(3)[0].count() == 1
    assert spark.read.schema(FLOWS).parquet(out).count() == 1


def test_an_empty_batch_keeps_open_flows(spark, tmp_path):
    state, out = OpenFlows(spark, str(tmp_path / "state")), str(tmp_path / "out")
    one = spark.createDataFrame([packet(5, 0, ("1.1.1.1", 1), ("2.2.2.2", 2), 99)], PACKETS)
    meter_batch(one, 0, out, state, 1, 5, 1)
    meter_batch(one.limit(0), 1, out, state, 1, 5, 1)
    assert state.before(2)[0].count() == 1 and spark.read.schema(FLOWS).parquet(out).count() == 0


def test_a_hot_pair_is_metered_in_several_tasks(spark):
    """A third of the packets in one pair: its slices lie in several partitions, though few rows are put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(traffic(14, 3000, 20, 60_000), PACKETS).repartition(5)
    slices = metering.combine(metering.pieces(metering.with_previous(metering.merge_instants(
        metering.with_pair(df), 1000))), [*metering.PAIR, "slice"])
    tasks = slices.filter("ip_a = '10.0.0.0'").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 2


def test_sums_of_flows_need_no_sorted_aggregate(spark):
    """F16: the order of a flow's pieces is one number, which a hash aggregate can hold."""
    flows = metering.meter(spark.createDataFrame(traffic(1, 20, 3, 10_000), PACKETS), active_s=None)
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_even_gaps_have_no_deviation(spark):
    a, b = ("10.0.0.1", 5), ("10.0.0.2", 6)
    df = spark.createDataFrame([packet(86_399_999 + 33_333 * i, i, a, b, 1499) for i in range(50)], PACKETS)
    row = metering.meter(df).first()
    assert (row.bidirectional_stddev_piat_ms, row.bidirectional_stddev_ps) == (0.0, 0.0)


def test_stream_sessions_equal_batch(spark, tmp_path):
    packets = traffic(11, 400, 4, 30_000)
    end = packet(10_000_000, 10**6, ("9.9.9.9", 9), ("8.8.8.8", 8))
    stream = _as_stream(spark, packets + [end], str(tmp_path / "in"), 4)
    _run(idle_sessions(stream, 0.3, "1 second"), str(tmp_path / "out"), str(tmp_path / "mark"))
    columns = [*metering.PAIR, "start", "end", "packets", "bytes"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    want = metering.sessions(spark.createDataFrame(packets, PACKETS), 0.3).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
