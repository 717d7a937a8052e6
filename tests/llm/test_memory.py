"""What bounds a Python worker's memory: blocks of texts, and the encoder's pieces."""

from __future__ import annotations

import pyarrow as pa


def test_text_blocks_hold_no_more_than_asked():
    from flowlens.llm.common import text_blocks

    texts = ["a" * 10, None, "ä" * 10, "", "b" * 100, "c", None]
    column = pa.array(texts).slice(0)
    found = list(text_blocks(column, 30))
    assert [t for _, _, part in found for t in part] == [t or "" for t in texts]
    assert all(len(part) == end - start and (len(part) == 1 or sum(len(t.encode()) for t in part) <= 30)
               for start, end, part in found)
    assert [t for _, _, part in text_blocks(column.slice(2, 3), 30) for t in part] == texts[2:5]
    assert list(text_blocks(column.slice(0, 0))) == []


def test_a_piece_is_remembered_once():
    import public_tokenizers

    from flowlens.llm.packing import PIECES
    from flowlens.llm.tokens import MEMO, Encoder, encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert encoder(path, PIECES).most == PIECES < MEMO
    known, text = Encoder(path), "Some words and words. Other words, too."
    assert known.ids([text]) == list(known.whole([text]))
    assert " words" in known.quick and " words" not in known.words


def test_keys_of_fingerprints_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from flowlens.llm.simhash_pivots import links

    distinct = spark.range(300).select(F.xxhash64(F.col("id") % 100 * 8).alias("bits")).distinct()
    plan = links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_the_fit_holds_few_bytes_for_a_feature():
    import tracemalloc

    import numpy as np

    from flowlens.llm.quality import fit_rows

    rng = np.random.default_rng(3)
    each = [np.unique(rng.integers(0, 4096, 3000)).astype("<i4") for _ in range(200)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in each])])
    good, ids = np.arange(200) % 2, np.concatenate(each)
    tracemalloc.start()
    model = fit_rows(ids, offsets, good, 12)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most / len(ids) < 21
    wide = fit_rows(ids.astype(np.int64), offsets, good, 12)
    assert (model.weight == wide.weight).all() and model.bias == wide.bias
