"""Vector codes: equal parts of a vector become indexes into codebooks, the nearest entry found by bitmasks.

For each dimension of a part the codebook's coordinates are sorted, and before each of them stands a mask of the entries
so far. A radius selects a range of each dimension; the difference of the masks at its ends holds the entries inside, and
the masks of all dimensions, ANDed, hold the entries of a box. The box contains the ball of the radius, so a best entry
within the radius is the nearest of all; rows without one go on with twice the radius. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.whole import floored, stacked
from flowlens.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task codes at a time.
ROWS = 8_192


class Masks:
    """One part's codebook of at most 64 entries, ready for slicing."""

    def __init__(self, book: np.ndarray):
        self.book = book
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = [book[order[:, d], d].copy() for d in range(book.shape[1])]
        bits = np.uint64(1) << order.T.astype(np.uint64)
        before = np.zeros((book.shape[1], len(book) + 1), dtype=np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=before[:, 1:])
        self.before = before
        gap = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        gap[np.diag_indices(len(book))] = np.iinfo(np.int64).max
        self.radius = max(1, int(np.sqrt(np.median(gap.min(axis=1))))) if len(book) > 1 else 1

    def box(self, x: np.ndarray, radius: int) -> np.ndarray:
        """The entries whose every coordinate is within ``radius`` of the row's, as a mask."""
        mask = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d, known in enumerate(self.sorted):
            low = np.searchsorted(known, x[:, d] - radius, side="left")
            high = np.searchsorted(known, x[:, d] + radius, side="right")
            mask &= self.before[d][high] & ~self.before[d][low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry to each row (ties to the lower) and the squared distance."""
        index, error = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        todo, radius = np.arange(len(x)), self.radius
        while len(todo):
            part = x[todo]
            mask = self.box(part, radius)
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            found = ((part[row] - self.book[entry]) ** 2).sum(axis=1)
            rows, start = np.unique(row, return_index=True)
            if len(rows):
                least = np.minimum.reduceat(found, start)
                first = np.flatnonzero(found == np.repeat(least, np.diff(np.append(start, len(row)))))
                first = first[np.unique(row[first], return_index=True)[1]]
                sure = least <= radius * radius
                index[todo[rows[sure]]], error[todo[rows[sure]]] = entry[first[sure]], least[sure]
                todo = np.delete(todo, rows[sure])
            radius *= 2
        return index, error


def split(whole: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal consecutive parts of the rows; a width that ``parts`` does not divide is filled up with zeros."""
    width = max(1, -(-whole.shape[1] // parts))
    full = np.zeros((len(whole), width * parts), dtype=np.int64)
    full[:, : whole.shape[1]] = whole
    return [full[:, p * width : (p + 1) * width] for p in range(parts)]


def whole_rows(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``width`` and the packed whole numbers ``whole`` of the usable rows."""
    chosen = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                            F.col(f"`{vector}`").alias("vector"))
    schema = T.StructType([T.StructField(c, chosen.schema[c].dataType) for c in ("vec_id", "label")] + [
        T.StructField("width", T.LongType()), T.StructField("whole", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, packed = floored(batch.column("vector"), scale)
            made = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(width),
                                               pa.array(packed, pa.binary())], names=schema.names)
            yield made.filter(made.column("whole").is_valid())

    return chosen.mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            yield batch.slice(k, ROWS)


def fit_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of at most 64 ``entries`` from ``rows`` (:func:`whole_rows`, all of ``width`` components).

    They start as the parts of the rows with the smallest ids; each round sums the parts nearest to each entry over all
    rows, inside the tasks first, and moves the entry to the mean, rounded down. The driver holds codebooks and their sums.
    """
    spark = rows.sparkSession
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").toArrow()
    books = split(stacked(first["whole"], width), parts)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [Masks(b) for b in shared.value]
        total = [np.zeros_like(m.book) for m in masks]
        count = [np.zeros(len(m.book), dtype=np.int64) for m in masks]
        for batch in _chunks(batches):
            for p, x in enumerate(split(stacked(batch.column("whole"), width), parts)):
                index, _ = masks[p].nearest(x)
                np.add.at(total[p], index, x)
                count[p] += np.bincount(index, minlength=len(count[p]))
        for p, sizes in enumerate(count):
            used = np.flatnonzero(sizes)
            wide = total[p].shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * wide, p, dtype=np.int32)), pa.array(np.repeat(used, wide).astype(np.int32)),
                 pa.array(np.tile(np.arange(wide, dtype=np.int32), len(used))), pa.array(total[p][used].reshape(-1)),
                 pa.array(np.repeat(sizes[used], wide))], names=["part", "entry", "place", "total", "n"])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = rows.select("whole").mapInArrow(sums, "part int, entry int, place int, total long, n long")
        books = [b.copy() for b in books]
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (two hex digits for each part) and ``error`` (squared distances, summed)."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*rows.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [Masks(b) for b in shared.value]
        for batch in _chunks(batches):
            found = [m.nearest(x) for m, x in zip(masks, split(stacked(batch.column("whole"), width), len(masks)))]
            digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            size = 2 * len(masks)
            codes = [digits[k : k + size] for k in range(0, len(digits), size)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()),
                                              pa.array(sum(error for _, error in found))], names=schema.names)

    return rows.mapInArrow(run, schema)


def fingerprint_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
               id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each usable row: ``id_col``, code, error, label_error and codebooks_sha256.

    ``label_error`` sums the errors of all rows of the label, null labels together. Rows whose vector is null, or holds a
    component that is null, not finite or of 2**18 or more in size, are dropped; so are vectors of another length than
    the row of the smallest id. Codebooks have fewer entries where there are fewer rows. Repeated rows are rows of their
    own; null ids come last in the order of ids and stay. Other columns play no part; an empty table gives an empty result.
    """
    if not 1 <= entries <= 64:
        raise ValueError("a mask has 64 bits: entries must be 1 to 64")
    rows = written(whole_rows(vectors, id_col, vector, label, scale), "whole-vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("width").first()
    width = first["width"] if first else 0
    rows = rows.filter(F.col("width") == width)
    books = fit_codebooks(rows, width, parts, entries, rounds) if first else []
    coded = written(encode(rows, books, width), "codes") if first else encode(rows, books, width)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint_of(books)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The codes of ``embeddings`` by comparing every part with every entry."""

    def nearest(number: int) -> str:
        return f"""
a{number} AS (SELECT id, vec_id, label, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
 SELECT x.id, x.vec_id, x.label, x.p, b.e,
  CAST(list_inner_product(x.v, x.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(x.v, b.v) AS BIGINT) AS d
 FROM parts x JOIN b{number} b ON x.p = b.p) GROUP BY id, vec_id, label, p)"""

    def moved(number: int) -> str:
        return f"""
m{number} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (
 SELECT a.p, a.e, i, floor(sum(x.v[i]) / count(*)) AS m
 FROM a{number - 1} a JOIN parts x ON a.id = x.id AND a.p = x.p, range(1, {64 // PARTS + 1}) t(i) GROUP BY a.p, a.e, i) GROUP BY p, e),
b{number} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{number - 1} b LEFT JOIN m{number} m ON m.p = b.p AND m.e = b.e)"""

    steps = ",".join(moved(n) + "," + nearest(n) for n in range(1, rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label,
  [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, vec_id, label, p, w[p * {64 // PARTS} + 1 : (p + 1) * {64 // PARTS}] AS v FROM kept, range({PARTS}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < {ENTRIES}),{nearest(0)},{steps},
books AS (SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
 FROM b{rounds}, range(1, {64 // PARTS + 1}) t(i)),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
 FROM a{rounds} GROUP BY id, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books"""
