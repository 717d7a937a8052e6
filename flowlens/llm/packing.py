"""Packing documents into sequences along a space-filling curve.

A document's tokens are counted into a hashed vector, which fixed random directions project to a few dimensions; the
place of that point on a Hilbert curve is the document's sort key. A sample tells where the key is cut into ranges of
about equal size; documents are encoded once and sent straight to their range, which one task sorts and packs in
order. Documents are cut where a sequence is full, so neighbours on the curve share sequences. What is left at the end
of a range becomes sequences whose lengths are powers of two: nothing is padded.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import text_blocks
from flowlens.llm.tokens import encoder

LENGTH = 2048
#: Hashed vector, dimensions of the curve and bits of each.
HASHED, DIMENSIONS, PLACES = 256, 4, 15
_SPREAD = 4.0
#: Distinct pieces that the encoder remembers; a worker keeps them for what it runs next.
PIECES = 400_000
#: Encoded bytes of a range, about, and the most where there would be more than RANGES of them.
RANGE_BYTES, RANGES, MOST_BYTES = 8 << 20, 2_000, 64 << 20
#: Documents that the ranges are chosen by: one of SHARE, but no fewer than the first and no more than the second.
SHARE, SAMPLED = 200, (2_048, 1_000_000)


def hilbert_keys(points: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Distance along the Hilbert curve of each row of ``points`` (unsigned, below 2**places).

    Going from the highest bit down, each step undoes the reflection or swap that the curve's turn there made; the
    Gray code of what remains, read across the dimensions, is the distance.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (places - 1)
    while q > 1:
        low = q - 1
        for d in range(n):
            set_ = (x[:, d] & q) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(set_, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    q = 1 << (places - 1)
    while q > 1:
        turn = np.where((x[:, n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(places - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | ((x[:, d] >> bit) & 1)
    return key


def curve_points(ids: list[np.ndarray]) -> np.ndarray:
    """Grid points of documents from their token ids: signed hashed counts, length 1, projected."""
    rng = np.random.Generator(np.random.PCG64(8))
    directions = rng.standard_normal((HASHED, DIMENSIONS))
    vectors = np.zeros((len(ids), HASHED))
    for row, own in enumerate(ids):
        mixed = (own.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)
        sign = 1.0 - 2.0 * ((mixed >> np.uint32(8)) & np.uint32(1))
        vectors[row] = np.bincount(mixed & np.uint32(HASHED - 1), weights=sign, minlength=HASHED)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0) @ directions
    top = (1 << PLACES) - 1
    return np.clip((at + _SPREAD) / (2 * _SPREAD) * top, 0, top).astype(np.int64)


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Cuts documents, in order, into sequences; holds at most one unfinished sequence."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.open: list[tuple] = []
        self.size = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.length - self.size]
            self.open.append((doc_id, start, part, len(ids)))
            start += len(part)
            self.size += len(part)
            if self.size == self.length:
                self.close(self.length)

    def close(self, size: int) -> None:
        """The next ``size`` open tokens become a sequence."""
        offset, rest = 0, []
        for doc_id, start, part, total in self.open:
            own = part[: size - offset]
            if len(own):
                self.out.append((doc_id, start, len(own), own.tobytes(), total, self.sequence, offset))
                offset += len(own)
            if len(own) < len(part):
                rest.append((doc_id, start + len(own), part[len(own):], total))
        self.open, self.size = rest, self.size - size
        self.sequence += 1

    def finish(self) -> None:
        for size in powers(self.size):
            self.close(size)

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple]:
    """For rows of doc_id and text: doc_id, key, hashes of the content and of the id, and the token ids as bytes.

    The hashes let ranges cut even a point that very many documents share: by content first, then among equal texts.
    """
    known = encoder(path, PIECES)
    for batch in batches:
        for start, end, texts in text_blocks(batch.column("text")):
            ids = [np.frombuffer(b, dtype="<u4") for b in known.ids(texts)]
            key = hilbert_keys(curve_points(ids)).tolist()
            # Two bytes for each id where they fit; the first byte tells.
            small = [not len(i) or i.max() < 1 << 16 for i in ids]
            packed = [b"\2" + i.astype("<u2").tobytes() if s else b"\4" + i.tobytes() for i, s in zip(ids, small)]
            own = batch.column("doc_id").slice(start, end - start)
            yield own, key, list(map(_hash, packed)), [_hash(str(i).encode()) for i in own.to_pylist()], packed


def _bounds(chosen: DataFrame, path: str) -> list[tuple[int, int, int]]:
    """The places (key, hashes of content and id) where the ranges of documents end, from a sample. Runs jobs.

    The ranges divide the sample's bytes about equally. Only numbers reach the driver, at most SAMPLED rows of four.
    """
    n = chosen.count()
    want = min(max(SAMPLED[0], n // SHARE), SAMPLED[1])
    sample = chosen if n <= want else chosen.sample(want / n, seed=8)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, tie, spread, packed in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, tie, spread, list(map(len, packed)))],
                                             names=["key", "tie", "spread", "size"])

    found = sample.mapInArrow(places, "key long, tie long, spread long, size long").toArrow()
    if not found.num_rows:
        return []
    key, tie, spread, size = (found[c].to_numpy() for c in ("key", "tie", "spread", "size"))
    total = size.sum() * (n / found.num_rows)
    count = min(math.ceil(total / RANGE_BYTES), max(RANGES, math.ceil(total / MOST_BYTES)))
    order = np.lexsort((spread, tie, key))
    share = (np.cumsum(size[order]) - size[order]) * count // size.sum()
    ends = order[np.flatnonzero(np.diff(share)) + 1]
    return sorted({(int(key[i]), int(tie[i]), int(spread[i])) for i in ends})


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    Each row of ``docs`` gives the ids of its text by the tokenizer file at ``path``, without special tokens, then
    ``end_id``; a null text is empty. Returns one row per piece: ``id_col``, start, length, ids (little-endian 32-bit
    numbers), doc_tokens, sequence_id, offset. Every id lies in exactly one piece; offsets of a sequence have no gap.
    Sequences are full, but for at most ``log2(length)`` at the end of each range, whose lengths are powers of two.
    Repeated rows and null ids are documents by themselves; equal documents are neighbours. Other columns play no part;
    an empty table gives an empty result. Runs jobs over a sample.
    """
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bounds = _bounds(chosen, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, key, tie, spread, packed in _encoded(batches, path):
            own = [bisect_right(bounds, place) for place in zip(key, tie, spread)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(key, pa.int64()), pa.array(own, pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "key", "range", "packed"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    encoded = chosen.mapInArrow(encode, f"doc_id {kind}, key long, range int, packed binary")
    dealt = encoded.repartitionById(len(bounds) + 1, "range").withColumn("tie", F.xxhash64("packed"))
    sorted_ = dealt.sortWithinPartitions("key", "tie", "doc_id").select("doc_id", "packed")
    out = encoded.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
                         F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("doc_tokens"),
                         F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4")
        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()), ("length", pa.int64()),
                ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed")):
                data = packed.as_buffer()
                ids = np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1) if len(data) > 1 else end[:0]
                packer.add(doc_id, np.concatenate([ids.astype("<u4"), end]))
                if len(packer.out) > 2000:
                    yield packer.take(schema)
        if schema:
            packer.finish()
            yield packer.take(schema)

    return sorted_.mapInArrow(cut, out).withColumnRenamed("doc_id", id_col)
