"""Vector search, incidents and capture files."""

import datetime as dt
import socket
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from flowlens.operators.incidents import embed, incidents, numbered
from flowlens.operators.knn import approximate_knn, fit_cells, hits, knn, with_cells
from flowlens.schemas import INCIDENTS, SECURITY_EVENTS, VECTORS
from flowlens.sources import pcap
from flowlens.sources.vectors import VectorStore
from flowlens.streaming.incidents import as_vectors, start_incidents


def vectors(spark, n, width=8, seed=0, copies=0):
    """``n`` random vectors and ``copies`` of the first one."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v], "DoS" if i % 3 else "Botnet") for i, v in enumerate(rng.normal(size=(n, width)).astype("float32"))]
    rows += [(n + i, rows[0][1], "copy") for i in range(copies)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>, label string")


def plain_distance(a, b, metric):
    """By the formula, one pair at a time."""
    dot = sum(x * y for x, y in zip(a, b))
    if metric == "ip":
        return -dot
    if metric == "l2":
        return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    size = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    return 1 - dot / size if size else 1.0


def brute(base, queries, k, metric, keep=lambda q, b: True):
    out = set()
    for q, qv, _ in queries:
        allowed = [(i, v) for i, v, label in base if keep(q, (i, label))]
        if not allowed:
            continue
        d = [round(plain_distance(qv, v, metric), 6) for _, v in allowed]
        for rank, (dist, i) in enumerate(sorted(zip(d, [i for i, _ in allowed]))[:k], 1):
            out.add((q, rank, round(float(dist), 5), i))
    return out


def shown(df):
    return {(r.query_id, r["rank"], round(r.distance, 5), r.id) for r in df.collect()}


def as_queries(df):
    return df.select(F.col("id").alias("query_id"), "embedding")


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("cells,block_rows", [(None, 4096), (1, 7), (9, 4096), (9, 5)])
def test_knn_equals_brute_force(spark, metric, cells, block_rows):
    """Many cells and small blocks: every pair that matters meets."""
    rows, df = vectors(spark, 90)
    found = knn(df.repartition(7), as_queries(df.limit(20)), 4, metric, cells=cells, block_rows=block_rows)
    assert shown(found) == brute(rows, rows[:20], 4, metric)


def test_copies_of_a_vector_rank_by_id(spark):
    """A third of the base are copies of one vector: the smallest ids win, and nothing else is lost."""
    rows, df = vectors(spark, 60, copies=30)
    found = knn(df.repartition(5), as_queries(df.limit(3)), 7)
    assert shown(found) == brute(rows, rows[:3], 7, "cosine")
    assert [r.id for r in found.filter("query_id = 0").orderBy("rank").collect()] == [0, *range(60, 66)]


def test_filters_fields_and_hits(spark):
    rows, df = vectors(spark, 40)
    by_text = knn(df, as_queries(df), 3, where='label == "DoS"')
    by_request = knn(df, as_queries(df), 3, where=[{"field": "label", "op": "eq", "value": "DoS"}])
    want = brute(rows, rows, 3, "cosine", lambda q, b: b[1] == "DoS")
    assert shown(by_text) == shown(by_request) == want
    assert by_text.columns == ["query_id", "rank", "distance", "id", "label"]
    assert knn(df, as_queries(df), 3, fields=[]).columns == ["query_id", "rank", "distance", "id"]
    hit = hits(by_text).filter("query_id = 1 and rank = 1").first().hit
    assert hit.id == 1 and abs(hit.distance) < 1e-6 and hit.fields.label == "DoS"
    assert knn(df, as_queries(df.limit(1)), 1000).count() == 40  # capped at 100, the base has 40
    assert knn(df.limit(0), as_queries(df), 3).count() == 0
    assert knn(df, as_queries(df.limit(0)), 3).count() == 0


@pytest.mark.parametrize("cells", [1, 6])
def test_past_only(spark, cells):
    rows, df = vectors(spark, 30)
    queries = as_queries(df).withColumn("at", F.col("query_id"))
    found = knn(df.withColumn("at", F.col("id")), queries, 3, fields=[], before="at", cells=cells)
    assert shown(found) == brute(rows, rows, 3, "cosine", lambda q, b: b[0] < q)


def test_bad_input(spark):
    _, df = vectors(spark, 5)
    with pytest.raises(ValueError):
        knn(df, as_queries(df), metric="hamming")
    uneven = spark.createDataFrame([(9, [1.0, 2.0], "x")], df.schema)
    with pytest.raises(Exception, match="vectors must all have 8 elements"):
        knn(df.unionByName(uneven), as_queries(df)).collect()


def test_zero_vector_has_distance_one(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    got = knn(df, as_queries(df.filter("id = 2")), 2, fields=[]).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in got] == [(2, 0.0), (1, 1.0)]


def test_approximate_recall(spark, views):
    base = views.table("embeddings").withColumnRenamed("vec_id", "id")
    centroids = fit_cells(base, 8)
    celled = with_cells(base, centroids).persist()
    exact = shown(knn(base, as_queries(base), 5, fields=[]))
    near = shown(approximate_knn(celled, as_queries(base), centroids, 4, fields=[]))
    full = shown(approximate_knn(celled, as_queries(base), centroids, 8, fields=[]))
    pairs = lambda found: {(q, i) for q, _, _, i in found}
    assert full == exact
    recall = len(pairs(near) & pairs(exact)) / len(exact)
    assert recall > 0.7, recall


# --------------------------------------------------------------------------- incidents


def events(spark, rows):
    full = [(f"e{i}", at, f"f{i}", "10.0.0.1", dst, 1, 80, 6, label, conf, "{}", 5, 500, 100)
            for i, (at, dst, label, conf) in enumerate(rows)]
    return spark.createDataFrame(full, SECURITY_EVENTS)


NOON = dt.datetime(2024, 1, 1, 12)


def test_numbering_is_complete_and_ordered_by_second(spark):
    """A third of the rows share one second."""
    rng = np.random.default_rng(3)
    rows = [(NOON + dt.timedelta(seconds=int(s)), "h", "DoS", 0.9) for s in rng.integers(0, 300_000, 200)]
    rows += [(NOON + dt.timedelta(seconds=5), "h", "DoS", 0.9)] * 100
    got = numbered(events(spark, rows), "detected_at", "event_id").orderBy("position").collect()
    assert [r.position for r in got] == list(range(300))
    times = [r.detected_at for r in got]
    assert times == sorted(times)


def test_incidents(spark):
    rows = [(NOON + dt.timedelta(seconds=i), f"h{i % 3}", "DoS" if i % 2 else "Botnet", 0.5 + i / 100) for i in range(7)]
    got = {(r.batch, r.attack_type): r for r in incidents(events(spark, rows), batch_size=4).collect()}
    assert set(got) == {(0, "Botnet"), (0, "DoS"), (1, "Botnet"), (1, "DoS")}
    first = got[(0, "DoS")]
    assert first.affected_hosts == ["h0", "h1"] and first.detected_at == NOON + dt.timedelta(seconds=1)
    assert first.confidence == pytest.approx(0.52) and first.rag_context_ids == [] and first.recommended_action is None
    assert set(INCIDENTS.names) <= set(first.asDict())


def test_embedding_is_a_unit_vector(spark):
    df = embed(events(spark, [(NOON, "h", "DoS", 0.9), (NOON, "h", "Botnet", 0.9)]))
    for r in df.collect():
        assert len(r.embedding) == 384 and np.linalg.norm(r.embedding) == pytest.approx(1, abs=1e-5)


def test_incident_stream(spark, tmp_path):
    """Neighbours come from earlier batches only; the vectors of a replayed batch are not doubled."""
    source, store, out, mark = (str(tmp_path / n) for n in ("in", "vectors", "out", "mark"))
    first = events(spark, [(NOON + dt.timedelta(seconds=i), "h1", "DoS", 0.9) for i in range(6)])
    first.coalesce(1).write.parquet(source)
    run = lambda: start_incidents(
        spark.readStream.schema(SECURITY_EVENTS).parquet(source), store, out, mark, k=2).awaitTermination()
    run()
    second = first.limit(2).withColumn("event_id", F.concat(F.lit("n"), "event_id"))
    second.coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r.batch_id: r for r in spark.read.parquet(out).collect()}
    assert got[0].rag_context_ids == [] and got[0].events == 6 and got[0].affected_hosts == ["h1"]
    old = {r.id for r in as_vectors(first).collect()}
    assert got[1].events == 2 and 2 <= len(got[1].rag_context_ids) and set(got[1].rag_context_ids) <= old
    # The same ids again in a later batch: one row per id stays.
    VectorStore(spark, store).append(as_vectors(first.withColumn("label", F.lit("new"))), 9)
    kept = VectorStore(spark, store).read()
    assert kept.schema.names == VECTORS.names and kept.count() == 8
    assert kept.filter("label = 'new'").count() == 6


# --------------------------------------------------------------------------- capture files


def ip4(src, dst, proto, payload, fragment=0):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 1, fragment, 64, proto, 0,
                       socket.inet_aton(src), socket.inet_aton(dst)) + payload


def ip6(src, dst, proto, payload):
    return struct.pack(">IHBB16s16s", 6 << 28, len(payload), proto, 64, socket.inet_pton(socket.AF_INET6, src),
                       socket.inet_pton(socket.AF_INET6, dst)) + payload


def tcp(sport, dport, flags, data=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def ether(payload, kind=0x0800, vlans=0):
    return b"\0" * 12 + b"\x81\x00\x00\x01" * vlans + struct.pack(">H", kind) + payload


def capture(records, order="<", nanos=False, link=1):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4",
             ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nanos]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for seconds, fraction, data, *size in records:
        out += struct.pack(order + "IIII", seconds, fraction, len(data), size[0] if size else len(data)) + data
    return out


def rows_of(spark, path, **more):
    return sorted(pcap.read_packets(spark, str(path), **more).collect(), key=lambda r: r.seq)


def test_capture_decoding(spark, tmp_path):
    records = [
        (1, 5, ether(ip4("10.0.0.1", "10.0.0.2", 6, tcp(1234, 80, 0x02)))),
        (1, 6, ether(ip4("10.0.0.2", "10.0.0.1", 6, tcp(80, 1234, 0x12)), vlans=1)),
        (2, 0, ether(ip4("10.0.0.1", "10.0.0.3", 17, udp(53, 5353, b"x" * 20)), vlans=2), 1500),
        (3, 0, ether(b"\0" * 28, kind=0x0806)),  # not IP
        (4, 0, ether(ip6("2001:db8::1", "2001:db8::2", 6, tcp(1, 2, 0x19)), kind=0x86DD)),
        (5, 0, ether(ip6("::1", "::2", 0, struct.pack(">BB6x", 17, 0) + udp(7, 8)), kind=0x86DD)),
        (6, 0, ether(ip4("1.2.3.4", "4.3.2.1", 6, b"\xff" * 30, fragment=100))),  # a later fragment has no ports
        (7, 0, ether(ip4("1.2.3.4", "4.3.2.1", 1, b"\x08\0\0\0"))),
        (8, 0, ether(ip4("1.2.3.4", "4.3.2.1", 6, b"\0\x50"))),  # cut before the ports end
        (9, 0, ether(ip4("10.0.0.9", "10.0.0.3", 17, udp(1, 2)), vlans=5)),
        (9, 1, ether(ip6("::3", "::4", 0, struct.pack(">BB6x", 60, 0) * 11 + struct.pack(">BB6x", 6, 0) + tcp(3, 4, 2)), kind=0x86DD)),
    ]
    (tmp_path / "a.pcap").write_bytes(capture(records))
    rows = rows_of(spark, tmp_path / "a.pcap")
    assert [r.seq for r in rows] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
    got = {r.seq: (r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol, r.ip_version) for r in rows}
    assert got[0] == ("10.0.0.1", 1234, "10.0.0.2", 80, 6, 4)
    assert got[1] == ("10.0.0.2", 80, "10.0.0.1", 1234, 6, 4)
    assert got[2] == ("10.0.0.1", 53, "10.0.0.3", 5353, 17, 4)
    assert got[4] == ("2001:db8::1", 1, "2001:db8::2", 2, 6, 6)
    assert got[5] == ("::1", 7, "::2", 8, 17, 6)
    assert got[9] == ("10.0.0.9", 1, "10.0.0.3", 2, 17, 4) and got[10] == ("::3", 3, "::4", 4, 6, 6)
    assert got[6] == ("1.2.3.4", 0, "4.3.2.1", 0, 6, 4) and got[8][1] == 0 and got[7][4] == 1
    flags = {r.seq: (r.syn, r.ack, r.psh, r.rst, r.fin) for r in rows}
    assert flags[0] == (True, False, False, False, False) and flags[1] == (True, True, False, False, False)
    assert flags[4] == (False, True, True, False, True) and not any(flags[6])
    assert {r.seq: r.size for r in rows}[2] == 1500
    assert rows[0].ts == dt.datetime(1970, 1, 1, 0, 0, 1, 5)


@pytest.mark.parametrize("order,nanos,link,wrap", [
    (">", False, 1, ether), ("<", True, 101, lambda p: p), (">", True, 113, lambda p: b"\0" * 14 + b"\x08\x00" + p),
    ("<", False, 0, lambda p: b"\x02\0\0\0" + p),
])
def test_capture_variants(spark, tmp_path, order, nanos, link, wrap):
    fraction = 123456789 if nanos else 123456
    data = wrap(ip4("10.0.0.1", "10.0.0.2", 17, udp(1, 2)))
    (tmp_path / "a.pcap").write_bytes(capture([(9, fraction, data)], order, nanos, link))
    row = rows_of(spark, tmp_path / "a.pcap")[0]
    assert (row.src_port, row.dst_ip, row.ts.microsecond) == (1, "10.0.0.2", 123456)


def test_capture_chunks_and_many_files(spark, tmp_path):
    """Small chunks: every packet once, with its number; a cut-off last packet is left out."""
    for f in range(3):
        records = [(i, 0, ether(ip4(f"10.{f}.0.1", "10.0.0.2", 17, udp(i, 2, b"x" * (i % 50))))) for i in range(200)]
        (tmp_path / f"{f}.pcap").write_bytes(capture(records) + b"\0" * 12)
    (tmp_path / "empty.pcap").write_bytes(b"")
    df = pcap.read_packets(spark, str(tmp_path / "*.pcap"), chunk_bytes=1000)
    got = sorted((r.src_ip, r.seq, r.src_port) for r in df.collect())
    assert got == sorted((f"10.{f}.0.1", i, i) for f in range(3) for i in range(200))
    (tmp_path / "bad.pcap").write_bytes(b"not a capture file at all")
    with pytest.raises(Exception, match="no packet capture"):
        pcap.read_packets(spark, str(tmp_path / "bad.pcap")).count()


def test_capture_to_flows(spark, tmp_path):
    from flowlens.operators.metering import meter

    a, b = "10.0.0.1", "10.0.0.2"
    records = [(1, 0, ether(ip4(a, b, 6, tcp(1000, 80, 2)))), (1, 500000, ether(ip4(b, a, 6, tcp(80, 1000, 0x12)))),
               (2, 0, ether(ip4(a, b, 6, tcp(1000, 80, 0x10)))), (500, 0, ether(ip4(a, b, 6, tcp(1000, 80, 1))))]
    (tmp_path / "a.pcap").write_bytes(capture(records))
    rows = meter(pcap.read_packets(spark, str(tmp_path / "a.pcap"))).orderBy("collected_at").collect()
    assert [(r.bidirectional_packets, r.src2dst_packets, r.bidirectional_syn_packets, r.bidirectional_fin_packets)
            for r in rows] == [(3, 2, 2, 0), (1, 1, 0, 1)]
    assert rows[0].packets_per_second == 3.0 and rows[0].bidirectional_mean_piat_ms == 500


def test_a_query_is_sent_once_to_a_block_of_rows(spark, monkeypatch):
    """Rows sent to the tasks: queries by blocks of base rows, not by the cells or leaves that they visit."""
    from flowlens.operators import knn as module

    rows, df = vectors(spark, 400, width=16)
    sent, search = [], module._search
    monkeypatch.setattr(module, "QUERY_BLOCKS", 1)

    def watched(visits, queries, base, sizes, *rest):
        blocks = visits.select("block").distinct().count()
        cells = visits.count()
        found = search(visits, queries, base, sizes, *rest)
        sent.append((blocks, cells))
        return found

    monkeypatch.setattr(module, "_search", watched)
    found = knn(df, as_queries(df), 5, cells=20, fields=[])
    assert shown(found) == brute(rows, rows, 5, "cosine")
    assert all(blocks == 1 and cells <= 20 for blocks, cells in sent)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e4])
def test_single_precision_misses_no_pair(metric, scale):
    """Close and equal vectors of any size: ties at the k-th distance go to the smaller id, as in double precision."""
    from flowlens.operators.knn import _meet, distances

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, 3000)] * scale
    x[::2] += rng.normal(size=x[::2].shape) * scale * 1e-6
    lists = pa.array(x.tolist(), pa.list_(pa.float64()))
    ids = np.random.default_rng(6).permutation(3000)
    base = pa.table({"id": ids, "embedding": lists, "cell": pa.array(np.arange(3000) % 3, pa.int32())})
    asks = pa.table({"query_id": ids[:60], "embedding": lists.slice(0, 60), "bound": np.full(60, np.inf)})
    got = _meet(7, metric, "id", "embedding", [], None)(asks, base)
    gap = np.round(distances(x[:60], x, metric), 6) + 0.0
    for i in range(60):
        mine = sorted((r["distance"], r["id"]) for r in got.filter(pa.compute.equal(got["query_id"], int(ids[i]))).to_pylist())
        order = np.lexsort((ids, gap[i]))[:7]
        close = 2e-6 if metric != "ip" else 2e-6 * max(1.0, scale * scale)
        assert np.allclose([d for d, _ in mine], gap[i][order], atol=close + (1e-3 if metric == "l2" and scale > 1 else 0), rtol=1e-9)
        if metric == "cosine":
            assert [j for _, j in mine] == ids[order].tolist()
