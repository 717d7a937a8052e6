"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one pass of numpy work takes at a time; bounds a worker's memory, not the result.
BLOCK_BYTES = 2_000_000
#: The same where a byte takes some dozens in between.
SMALL_BLOCK_BYTES = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` characters each; a longer text is a range by itself."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_blocks(column: pa.Array, limit: int = SMALL_BLOCK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a text column and their texts, null ones empty: about ``limit`` bytes each; a longer text is a range by itself.

    Only one range is held as Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    until = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(until, until[start] + limit, side="right")) - 1)
        yield start, end, [t or "" for t in column.slice(start, end - start).to_pylist()]
        start = end


def as_batches(columns: Iterable, schema: pa.Schema, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    table = pa.table(list(columns), schema=schema)
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def fixed_signs(seed: int, shape: tuple[int, ...]) -> np.ndarray:
    """A fixed matrix of +1 and -1."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2, shape, dtype=np.int8) * np.int8(2) - np.int8(1)


def quiet_tokenizers() -> None:
    """One thread for each Spark task; the library would start one for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
