"""Packet capture files as a ``packets`` DataFrame.

Files are read by byte ranges, many tasks to a file. The task of a range looks for the first place in it where a chain of
records holds up, and follows the chain to the first record beyond the range. A capture has no marks to find records by,
so such a place is a guess until the range before has ended on it: the first range begins behind the file's header, and
ranges that do not begin where the one before ends are followed again from there, until all do. Then every range knows how
many records precede it, and ranges are decoded in parallel.

Classic captures with microsecond or nanosecond times in either byte order are read; Ethernet (with VLAN
tags), raw IP, BSD loopback and Linux cooked links. Packets that are not IP are left out, as flows have
addresses.
"""

from __future__ import annotations

import os
import socket
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.schemas import PACKETS
from flowlens.session import written

CHUNK_BYTES = 32 * 1024 * 1024
FILE_HEADER, RECORD_HEADER = 24, 16
MAX_RECORD = 256 * 1024 * 1024
#: Records that must follow one another for a place to count as one; seconds that times of a file are apart at most.
CHAIN, YEARS = 16, 20 * 366 * 86400

# File magic -> (byte order, time units per second); link types; IPv6 extension headers.
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
LOOPBACK, ETHERNET, RAW_IP, LINUX_COOKED, RAW_IPV4, RAW_IPV6 = 0, 1, 101, 113, 228, 229
VLAN_TAGS = (0x8100, 0x88A8)
EXTENSIONS = (0, 43, 44, 60)

#: A range of a file: where its first record begins, where the first one beyond it does (the file's length where the
#: records end), how many there are, and the place of a record that cannot be.
_RANGES = "path string, whole long, nth long, start long, stop long, entry long, leave long, records long, broken long"
_OUT = pa.schema([
    (f.name, {"timestamp": pa.timestamp("us", "UTC"), "bigint": pa.int64(), "int": pa.int32(),
              "smallint": pa.int16(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()])
    for f in PACKETS.fields
])


def _local(path: str) -> str | None:
    return path[len("file:"):].replace("///", "/", 1) if path.startswith("file:") else path if path.startswith("/") else None


def _open(path: str):
    from pyarrow import fs

    if _local(path):
        return open(_local(path), "rb")
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _create(path: str):
    from pyarrow import fs

    if _local(path):
        os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
        return open(_local(path), "wb")
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def _rename(path: str, to: str) -> None:
    from pyarrow import fs

    if _local(path):
        os.replace(_local(path), _local(to))
    else:
        system, name = fs.FileSystem.from_uri(path)
        system.move(name, fs.FileSystem.from_uri(to)[1])


class Capture:
    """The header of one file, and the following of its records."""

    def __init__(self, path: str, head: bytes):
        if head[:4] not in MAGIC or len(head) < FILE_HEADER:
            raise ValueError(f"{path} is no packet capture")
        self.order, self.units = MAGIC[head[:4]]
        most, link = struct.unpack(self.order + "II", head[16:24])
        self.link = link & 0xFFFF
        self.most = min(most, MAX_RECORD) if most else MAX_RECORD
        self.header = struct.Struct(self.order + "IIII")
        self.since = struct.unpack(self.order + "I", head[24:28])[0] if len(head) >= FILE_HEADER + 4 else 0

    def likely(self, data: np.ndarray) -> np.ndarray:
        """The places in ``data`` that could be the begin of a record."""
        n = len(data) - RECORD_HEADER + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        parts = data.astype(np.uint32)
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        value = sum(parts[k : len(data) - 3 + k] << np.uint32(shift) for k, shift in enumerate(shifts)).astype(np.int64)
        seconds, fraction, stored, size = (value[k : k + n] for k in (0, 4, 8, 12))
        fits = (fraction < self.units) & (stored <= self.most) & (stored <= size) & (np.abs(seconds - self.since) <= YEARS)
        return np.flatnonzero(fits)

    def holds(self, data: bytes, at: int, start: int, whole: int) -> bool:
        """Whether a chain of records begins at ``at``: so many, or up to the end of the data or of the file."""
        for _ in range(CHAIN):
            if at + RECORD_HEADER > len(data):
                return start + at <= whole
            seconds, fraction, stored, size = self.header.unpack_from(data, at)
            if fraction >= self.units or stored > self.most or stored > size or abs(seconds - self.since) > YEARS:
                return False
            at += RECORD_HEADER + stored
        return True

    def first(self, data: bytes, start: int, stop: int, whole: int) -> int | None:
        """The first likely begin of a record from ``start`` on, before ``stop``; ``data`` is the file from ``start``."""
        for k in range(0, stop - start, 1 << 20):
            some = np.frombuffer(data, dtype=np.uint8)[k : k + (1 << 20) + RECORD_HEADER - 1]
            for at in self.likely(some) + k:
                if start + at < stop and self.holds(data, int(at), start, whole):
                    return start + int(at)
        return None

    def follow(self, data: bytes, start: int, entry: int, stop: int, whole: int) -> tuple[int, int, int | None]:
        """Where the first record from ``stop`` on begins, the records before, and the place of one that is too long."""
        at, n = entry, 0
        while at < stop:
            if at + RECORD_HEADER > whole:
                return whole, n, None
            stored = self.header.unpack_from(data, at - start)[2]
            if stored > MAX_RECORD:
                return whole, n, at
            if at + RECORD_HEADER + stored > whole:
                return whole, n, None  # the capture was cut off inside its last packet
            at += RECORD_HEADER + stored
            n += 1
        return at, n, None


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with entry (looked for where it is null), leave, records and broken."""
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            if r["entry"] is not None and r["entry"] >= r["stop"]:  # a record covers the whole range
                r |= {"leave": r["entry"], "records": 0, "broken": None}
                continue
            with _open(r["path"]) as source:
                known = Capture(r["path"], source.read(FILE_HEADER + RECORD_HEADER))
                source.seek(r["start"])
                data = source.read(r["stop"] - r["start"] + RECORD_HEADER)
            entry = r["entry"] if r["entry"] is not None else known.first(data, r["start"], r["stop"], r["whole"])
            r["entry"] = r["stop"] if entry is None else entry
            r["leave"], r["records"], r["broken"] = known.follow(data, r["start"], r["entry"], r["stop"], r["whole"])
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def record_ranges(spark: SparkSession, pattern: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The byte ranges of all capture files that match ``pattern``, with their records. Runs jobs."""
    # Without the content column only the listing runs; tasks open the files themselves.
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("whole")).filter("whole > 0")
    size = F.lit(chunk_bytes).cast("long")
    ranges = files.withColumn("nth", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("whole") - FILE_HEADER - 1) / size)))))
    start = F.col("nth") * size + FILE_HEADER
    none = F.lit(None).cast("long")
    ranges = ranges.select(
        "path", "whole", "nth", start.alias("start"), F.least(start + size, F.col("whole")).alias("stop"),
        F.when(F.col("nth") == 0, start).alias("entry"), none.alias("leave"), none.alias("records"), none.alias("broken"))
    done = written(ranges.repartition("path", "nth").mapInArrow(_followed, _RANGES), "capture-ranges")
    while True:
        before = F.lag("leave").over(Window.partitionBy("path").orderBy("nth"))
        due = done.withColumn("due", F.coalesce(before, F.col("entry")))
        wrong = F.col("due") != F.col("entry")
        if due.filter(wrong).isEmpty():
            return done
        again = due.filter(wrong).withColumn("entry", F.col("due")).drop("due").repartition("path", "nth").mapInArrow(_followed, _RANGES)
        done = written(due.filter(~wrong).drop("due").unionByName(again), "capture-ranges")


def _addresses(raw: np.ndarray, family: int) -> np.ndarray:
    """Text of the addresses in the rows of a byte matrix, formatting each distinct one once."""
    packed = np.ascontiguousarray(raw).view(f"V{raw.shape[1]}").ravel()
    distinct, where = np.unique(packed, return_inverse=True)
    return np.array([socket.inet_ntop(family, d.tobytes()) for d in distinct], dtype=object)[where]


def decode(data: bytes, first: int, order: str, units: int, link: int, most: int) -> pa.RecordBatch:
    """The IP packets of the first ``most`` capture records of ``data``, as columns."""
    header = struct.Struct(order + "IIII")
    records, at = [], 0
    while len(records) < most:
        seconds, fraction, stored, size = header.unpack_from(data, at)
        records.append((at + RECORD_HEADER, seconds, fraction, stored, size))
        at += RECORD_HEADER + stored
    table = np.array(records, dtype=np.int64).reshape(-1, 5)
    begin, end = table[:, 0], table[:, 0] + table[:, 3]
    # Room behind the last record, so that short packets can be looked at before they are sorted out.
    buf = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(256, dtype=np.uint8)])

    def byte(position):
        return buf[np.minimum(position, len(buf) - 1)].astype(np.int64)

    def word(position):
        return byte(position) << 8 | byte(position + 1)

    if link == ETHERNET:
        kind = begin + 12
        while (tagged := np.isin(word(kind), VLAN_TAGS) & (kind + 6 <= end)).any():
            kind = np.where(tagged, kind + 4, kind)
        ip = kind + 2
        is_ip = np.isin(word(kind), (0x0800, 0x86DD))
    elif link == LINUX_COOKED:
        ip, is_ip = begin + 16, np.isin(word(begin + 14), (0x0800, 0x86DD))
    elif link == LOOPBACK:
        ip, is_ip = begin + 4, np.ones(len(begin), dtype=bool)
    elif link in (RAW_IP, RAW_IPV4, RAW_IPV6):
        ip, is_ip = begin, np.ones(len(begin), dtype=bool)
    else:
        raise ValueError(f"link type {link} is not supported")

    version = byte(ip) >> 4
    v4 = is_ip & (version == 4) & (ip + 20 <= end)
    v6 = is_ip & (version == 6) & (ip + 40 <= end)
    protocol = np.where(v4, byte(ip + 9), byte(ip + 6))
    payload = np.where(v4, ip + (byte(ip) & 15) * 4, ip + 40)
    later_part = v4 & (word(ip + 6) & 0x1FFF > 0)
    while (more := v6 & np.isin(protocol, EXTENSIONS) & (payload + 8 <= end)).any():
        later_part |= more & (protocol == 44) & (word(payload + 2) & 0xFFF8 > 0)
        step = np.where(protocol == 44, 8, (byte(payload + 1) + 1) * 8)
        protocol, payload = np.where(more, byte(payload), protocol), np.where(more, payload + step, payload)

    ported = np.isin(protocol, (6, 17)) & ~later_part & (payload + 4 <= end)
    flags = np.where((protocol == 6) & ~later_part & (payload + 14 <= end), byte(payload + 13), 0)
    keep = v4 | v6
    text = {}
    for name, at4, at6 in (("src_ip", 12, 8), ("dst_ip", 16, 24)):
        column = np.empty(len(begin), dtype=object)
        for mask, offset, width, family in ((v4, at4, 4, socket.AF_INET), (v6, at6, 16, socket.AF_INET6)):
            if mask.any():
                where = (ip[mask] + offset)[:, None] + np.arange(width)
                column[mask] = _addresses(buf[where].astype(np.uint8), family)
        text[name] = column
    micros = table[:, 1] * 1_000_000 + table[:, 2] * 1_000_000 // units
    columns = {
        "ts": micros, "seq": first + np.arange(len(begin)), **text,
        "src_port": np.where(ported, word(payload), 0), "dst_port": np.where(ported, word(payload + 2), 0),
        "protocol": protocol, "ip_version": np.where(v4, 4, 6), "size": table[:, 4],
        "syn": flags & 2 > 0, "ack": flags & 16 > 0, "psh": flags & 8 > 0, "rst": flags & 4 > 0, "fin": flags & 1 > 0,
    }
    arrays = [
        pa.array(columns[f.name][keep]).cast(f.type) if f.name not in text
        else pa.array(columns[f.name][keep], type=pa.string())
        for f in _OUT
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _open(r["path"]) as source:
                known = Capture(r["path"], source.read(FILE_HEADER + RECORD_HEADER))
                if r["broken"] is not None:
                    raise ValueError(f"{r['path']} is damaged at byte {r['broken']}")
                source.seek(r["entry"])
                data = source.read(r["leave"] - r["entry"])
            out = decode(data, r["first"], known.order, known.units, known.link, r["records"])
            for start in range(0, out.num_rows, 65536):
                yield out.slice(start, 65536)


def read_packets(spark: SparkSession, pattern: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The packets of all capture files that match ``pattern``; ``seq`` counts within a file.

    Runs the jobs of :func:`record_ranges`; the packets are decoded when the result is used.
    """
    so_far = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    ranges = record_ranges(spark, pattern, chunk_bytes).withColumn("first", F.coalesce(F.sum("records").over(so_far), F.lit(0)))
    ranges = ranges.filter("records > 0 OR broken IS NOT NULL OR nth = 0")
    return ranges.repartition("path", "nth").mapInArrow(_decode, PACKETS)


# --------------------------------------------------------------------------- writing

#: Stored bytes of a written packet: Ethernet, IPv4 and TCP headers (of UDP the first bytes), no payload.
_FRAME = 14 + 20 + 20


def frames(batch: pa.RecordBatch) -> bytes:
    """IPv4 packets as capture records in the given order, headers only, with their true size."""
    n = batch.num_rows
    col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("src_port", "dst_port", "protocol", "size")}
    micros = batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()
    out = np.zeros((n, RECORD_HEADER + _FRAME), dtype=np.uint8)

    def put(at: int, values, width: int, order: str) -> None:
        out[:, at : at + width] = np.asarray(values).astype(f"{order}u{width}").reshape(n, 1).view(np.uint8)

    put(0, micros // 1_000_000, 4, "<")
    put(4, micros % 1_000_000, 4, "<")
    put(8, np.full(n, _FRAME), 4, "<")
    put(12, np.maximum(col["size"], _FRAME), 4, "<")
    put(28, np.full(n, 0x0800), 2, ">")
    put(30, np.full(n, 0x45), 1, ">")
    put(39, col["protocol"], 1, ">")
    for at, name in ((42, "src_ip"), (46, "dst_ip")):
        packed = batch.column(name).dictionary_encode()
        known = np.frombuffer(b"".join(map(socket.inet_aton, packed.dictionary.to_pylist())), dtype=np.uint8).reshape(-1, 4)
        out[:, at : at + 4] = known[packed.indices.to_numpy()]
    put(50, col["src_port"], 2, ">")
    put(52, col["dst_port"], 2, ">")
    flags = sum(np.where(batch.column(c).to_numpy(zero_copy_only=False), bit, 0)
                for c, bit in (("syn", 2), ("ack", 16), ("psh", 8), ("rst", 4), ("fin", 1)))
    put(62, np.full(n, 0x50), 1, ">")
    put(63, np.where(col["protocol"] == 6, flags, 0), 1, ">")
    return out.tobytes()


def write_packets(packets: DataFrame, folder: str, files: int) -> None:
    """Write IPv4 packets as ``files`` capture files below ``folder`` (a URI that every executor can write). Runs a job.

    Packets are in order of time and ``seq`` inside a file, and larger than their headers in ``size`` only. A task writes
    under a name of its own and gives the file its name at the end, so a second attempt replaces the first.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder.rstrip('/')}/capture-{TaskContext.get().partitionId():05d}.pcap"
        own, size = f"{name}.{uuid.uuid4().hex}", 0
        with _create(own) as sink:
            sink.write(b"\xd4\xc3\xb2\xa1" + struct.pack("<HHiIII", 2, 4, 0, 0, 65535, ETHERNET))
            for batch in batches:
                size += batch.num_rows
                sink.write(frames(batch))
        _rename(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size])], names=["path", "packets"])

    dealt = packets.filter("ip_version = 4").repartitionByRange(files, "ts", "seq").sortWithinPartitions("ts", "seq")
    dealt.mapInArrow(write, "path string, packets long").collect()  # a row for each file
