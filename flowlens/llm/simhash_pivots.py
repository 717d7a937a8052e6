"""Near-duplicate documents by SimHash and pivot distance tables.

Every fingerprint gets its Hamming distances to fixed reference fingerprints. Two fingerprints at distance r or less
have distances to any reference that differ by r at most, so a pair with a larger difference anywhere is discarded
unseen, and the bits of the survivors are compared.

Some references make the tables a join key. For the reference with bit b alone set, the distance minus that to the
all-zero reference is 1 or -1 and tells the bit. At most r of these 64 table entries differ in a linked pair. With the
entries in r + 3 groups, at least three whole groups agree, and the entries of any three groups are a bucket key, of 32
bits for r = 3. Inside a bucket the other references discard pairs. Buckets of any size are cut into blocks that meet
pairwise in different tasks; what leaves a task is a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.links import components, join_labels
from flowlens.session import written

RADIUS = 3
SHINGLE = 3
#: References beside those of single bits; groups of table entries that a bucket key takes.
MORE_PIVOTS, AGREE = 24, 3
#: Distinct fingerprints of a bucket that one task compares with as many others.
BUCKET = 4096
#: Rows, and pairs, that a task looks at together.
ROWS, PAIRS = 400_000, 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of ``text``; 0 without words."""
    words = (text or "").encode().lower().split()  # on bytes: only A-Z changes, only ASCII white space separates
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), runs), dtype="<u8", count=n)
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 100_000):
        part = hashes[k : k + 100_000].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``bits`` (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(run, chosen.select("doc_id", F.lit(0).cast("long").alias("bits")).schema)


def bit_pivots() -> np.ndarray:
    """The all-zero reference, then one for each bit."""
    return np.array([0] + [1 << b for b in range(64)], dtype=np.uint64)


def pivots(more: int = MORE_PIVOTS) -> np.ndarray:
    """Fixed references with random bits."""
    return np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, more, dtype=np.uint64)


def distance_table(bits: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distance of each fingerprint (row, of one or more 64-bit words) to each reference."""
    bits, references = bits.reshape(len(bits), -1), references.reshape(len(references), -1)
    out = np.zeros((len(bits), len(references)), dtype=np.int16)
    for word in range(bits.shape[1]):
        out += np.bitwise_count(bits[:, word, None] ^ references[None, :, word])
    return out


def differing(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    words = bits.reshape(len(bits), -1)
    return sum(np.bitwise_count(words[i, w] ^ words[j, w]).astype(np.int16) for w in range(words.shape[1]))


def bucket_keys(bits: np.ndarray, radius: int = RADIUS, agree: int = AGREE) -> np.ndarray:
    """One key for every ``agree`` of the groups of entries that tables of the single-bit references have."""
    table = distance_table(bits, bit_pivots())
    own = ((table[:, :1] + 1 - table[:, 1:]) // 2).astype(np.uint64)  # 0 or 1 for each bit
    groups = np.array_split(np.arange(own.shape[1]), radius + agree)
    keys = []
    for number, chosen in enumerate(combinations(groups, agree)):
        key = np.zeros(len(bits), dtype=np.uint64)
        for b in np.concatenate(chosen):
            key = (key << np.uint64(1)) | own[:, b]
        keys.append(key ^ np.uint64(number << 57))  # 48 bits at most, but for radius 0 with its single key of 64
    return np.stack(keys, axis=1).view(np.int64)


def close_pairs(run: np.ndarray, bits: np.ndarray, references: np.ndarray, radius: int, label: np.ndarray) -> np.ndarray:
    """Link rows of equal ``run`` within ``radius``; ``label`` as :func:`join_labels` keeps it."""
    table = distance_table(bits, references)
    order = np.lexsort((table[:, 0], run))
    at = run[order] * 4096 + table[order, 0]  # distances and radius stay below 2048
    stop = np.searchsorted(at, at + radius, side="right")
    width = stop - np.arange(len(order)) - 1
    total = np.concatenate([[0], np.cumsum(width)])
    begin = 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
        n = width[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], n)
        i, j = order[i], order[j]
        for p in range(1, table.shape[1]):
            if not len(i):
                break
            near = np.abs(table[i, p] - table[j, p]) <= radius
            i, j = i[near], j[near]
        found = differing(bits, i, j) <= radius
        label = join_labels(label, i[found], j[found])
        begin = end
    return label


def bucket_links(rows: DataFrame, words: int, radius: int, references: np.ndarray, bucket: int = BUCKET) -> DataFrame:
    """Forests (a, b) that connect the nodes of equal ``key`` within ``radius`` bits.

    ``rows``: key (long), node (long) and the fingerprint's ``words`` longs w0, w1, ... Buckets of one row are left out;
    large ones are dealt to block pairs, so that no task holds more of one than two blocks.
    """
    bits = [f"w{i}" for i in range(words)]
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # Merged: rows have many keys for each row they come from, by whose size they would be broadcast through the driver.
    rows = rows.join(sizes.hint("merge"), "key").withColumn("parts", parts).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", *bits)
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            prints = rows[:, 4:].copy().view(np.uint64)
            label = close_pairs(np.cumsum(new), prints, references, radius, np.arange(len(rows)))
            edge = np.unique(np.stack([rows[:, 3], rows[label, 3]], axis=1)[label != np.arange(len(rows))], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edge[:, 0].copy()), pa.array(edge[:, 1].copy())], ["a", "b"])

        kept: list[np.ndarray] = []
        held = 0
        for batch in batches:
            kept.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
            held += len(batch)
            if held >= ROWS:  # all but the last bucket, which may go on
                rows = np.concatenate(kept)
                last = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(axis=1))[0])
                if last:
                    yield linked(rows[:last])
                kept, held = [rows[last:]], len(rows) - last
        if held:
            yield linked(np.concatenate(kept))

    return dealt.mapInArrow(meet, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, more: int = MORE_PIVOTS) -> DataFrame:
    """Forests (a, b) that connect the distinct fingerprints ``bits`` within ``radius``, bucket by bucket."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy().view(np.uint64)
            keys = bucket_keys(bits, radius)
            every = pa.array(np.repeat(bits.view(np.int64), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), every, every], ["key", "node", "w0"])

    rows = distinct.select("bits").mapInArrow(keyed, "key long, node long, w0 long")
    return bucket_links(rows, 1, radius, pivots(more), bucket)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE) -> DataFrame:
    """For each row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id, class_id and class_size.

    Equal fingerprints are a class; ``class_id`` is its smallest id. Classes within ``radius`` bits are linked, and
    ``component_id`` is the smallest id reachable. Null, empty and wordless texts have fingerprint 0 and are linked
    like any other. A null id stays null and names no class; repeated rows are rows of one class. Other columns play
    no part, and an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text, shingle), "fingerprints")
    classes = written(rows.groupBy("bits").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")),
                      "classes")
    found = components(links(classes, radius))
    classes = classes.join(found, classes["bits"] == found["node"], "left").select(
        "bits", "class_id", "class_size", F.coalesce("root", "bits").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    known = classes.join(smallest, "root").drop("root")
    return rows.join(known, "bits").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id",
        "class_id", "class_size")


def one_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text",
                shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the document of the smallest id of each component, once, and all rows without an id."""
    found = near_duplicates(docs, radius, id_col, text, shingle)
    keep = written(found.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("rows_of_id")), "kept")
    named = docs.join(keep.select(id_col), id_col, "left_semi")
    if not keep.filter("rows_of_id > 1").isEmpty():
        named = named.dropDuplicates([id_col])
    return named.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
