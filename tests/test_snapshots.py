"""Snapshot tables: batches, replays, merged and expired months, and what readers open."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from flowlens.sources.snapshots import Conflict, SnapshotTable
from flowlens.sources.storage import FLOW_ORDER
from flowlens.schemas import FLOWS

START = dt.datetime(2024, 1, 20)


@pytest.fixture(scope="module")
def flows(spark, views):
    """Sixty days of flows in equal steps, the last one without a time."""
    first = views.flows.orderBy("flow_id").limit(600).collect()
    rows = spark.createDataFrame([{**r.asDict(), "src_port": i, "collected_at": None if i == 599 else START + dt.timedelta(hours=i * 2.4)}
                                  for i, r in enumerate(first)], FLOWS)
    return rows.repartition(4).cache()


def table(spark, path):
    return SnapshotTable(spark, str(path), FLOWS, "collected_at", FLOW_ORDER)


def ports(df):
    return sorted(r["src_port"] for r in df.select("src_port").collect())


def batch(flows, k, of=4):
    return flows.filter(F.col("src_port") % of == k)


def test_batches_and_replays(spark, flows, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().collect() == [] and t.files() == []
    for k in range(4):
        t.append(batch(flows, k), k)
    assert ports(t.read()) == list(range(600)) and t.read().schema == FLOWS
    t.append(batch(flows, 3), 3)  # a replay
    t.append(batch(flows, 1).filter("src_port < 100"), 1)  # another try that leaves months out
    assert ports(t.read()) == [i for i in range(600) if i % 4 != 1 or i < 100]
    assert set(t.snapshot()["months"]) == {"202401", "202402", "202403", "none"}
    with pytest.raises(Conflict):
        t._commit({"number": 2, "newest": 0, "months": {}}, {})


def test_readers_open_what_they_need(spark, flows, tmp_path):
    t = table(spark, tmp_path)
    for k in range(6):
        t.append(flows.filter((F.col("src_port") >= 100 * k) & (F.col("src_port") < 100 * k + 100)), k)
    since, until = START + dt.timedelta(days=25), START + dt.timedelta(days=27)
    found = t.files(since, until)
    assert 0 < len(found) < len(t.files()) / 3
    want = [i for i in range(599) if since < START + dt.timedelta(hours=i * 2.4) <= until]
    assert ports(t.read(since, until)) == want and set(t.read(since, until).inputFiles()) <= {f.replace("file:/", "file:///").replace("file://///", "file:///") for f in found}


def test_merge_expire_clean(spark, flows, tmp_path):
    t = table(spark, tmp_path)
    for k in range(5):
        t.append(batch(flows, k, 5), k)
    before = t.snapshot()["months"]
    t.merge(dt.datetime(2024, 3, 1))
    after = t.snapshot()["months"]
    assert after["202403"] == before["202403"] and after["none"] == before["none"]
    assert after["202401"]["files"] < before["202401"]["files"] and after["202401"]["merged"] == 3
    assert ports(t.read()) == list(range(600))
    t.append(batch(flows, 4, 5), 4)  # the newest batch is not merged, so its replay finds its rows
    t.append(batch(flows, 2, 5), 2)  # an older one's rows are in merged files already
    assert ports(t.read().filter("collected_at < '2024-03-01'")) == [i for i in range(599) if START + dt.timedelta(hours=i * 2.4) < dt.datetime(2024, 3, 1)]
    assert ports(t.read()) == list(range(600))
    number = t.snapshot()["number"]
    assert t.merge(dt.datetime(2024, 1, 1))["number"] == number  # nothing to do, no new snapshot
    cut = dt.datetime(2024, 2, 10, 5)
    t.expire(30, cut + dt.timedelta(days=30))
    want = [i for i in range(600) if i == 599 or START + dt.timedelta(hours=i * 2.4) >= cut]
    assert ports(t.read()) == want and "202401" not in t.snapshot()["months"]
    stored = len(glob.glob(f"{tmp_path}/data/*/*/*.parquet"))
    assert t.clean() > 0 and t.clean() == 0
    assert len(glob.glob(f"{tmp_path}/data/*/*/*.parquet")) == len(t.files()) < stored
    assert ports(t.read()) == want
    assert ports(t.read(since=cut)) == [i for i in want if i != 599 and START + dt.timedelta(hours=i * 2.4) > cut]


def test_empty_batches(spark, flows, tmp_path):
    t = table(spark, tmp_path)
    t.append(flows.limit(0), 0)
    assert t.read().collect() == [] and t.snapshot()["newest"] == 0
    t.append(flows, 1)
    t.append(flows.limit(0), 1)
    assert t.read().collect() == [] and t.snapshot()["months"] == {}
    t.merge(dt.datetime(2100, 1, 1))
    t.expire(1, dt.datetime(2100, 1, 1))


def test_merged_files_are_bounded_by_what_a_task_sorts(spark, flows, tmp_path, monkeypatch):
    from flowlens.sources import snapshots

    monkeypatch.setattr(snapshots, "TASK_BYTES", 100 * snapshots.row_bytes(FLOWS))
    t = table(spark, tmp_path)
    for k in range(3):
        t.append(batch(flows, k, 3), k)
    t.append(flows.limit(0), 3)
    t.merge(dt.datetime(2100, 1, 1))
    held = t._listed([t.snapshot()["months"]["202402"]]).collect()
    assert len(held) >= 3 and max(r["rows"] for r in held) < 200
    assert ports(t.read()) == list(range(600))
