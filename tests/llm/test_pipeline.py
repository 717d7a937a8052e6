"""Every stage of the corpus pipeline against a plain version, with nulls, repeats, clashing names and an empty table."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import quality
from flowlens.llm.common import crc32_mod
from tests.llm.conftest import awkward_rows
from tests.llm.test_duplicates import plain_simhash, smallest_ids
from tests.llm.test_texts import plain_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_stages_and_an_empty_table(spark, nothing):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "source_mix", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, nothing, SF)
        assert found.collect() == []
        assert name == "packing" or found.columns == nothing.columns


def test_quality_keeps_what_the_model_accepts(spark, awkward):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id >= 100"))
    in_fold = F.coalesce(crc32_mod("doc_id", 4) != 2, F.lit(False))
    model = quality.fit(quality.label_rows(labels, docs.select("doc_id", "text"), in_fold))
    want = Counter()
    for r in docs.collect():
        ids, offsets = quality.features([r["text"]])
        if model.scores(ids, offsets)[0] >= 0.7:
            want[tuple(r)] += 1
    assert 0 < sum(want.values()) < docs.count() and known.count()
    assert counted(corpus_pipeline.good_quality(spark, docs, SF)) == want


def test_line_dedup_keeps_sizes_right_and_drops_emptied_texts(spark):
    rng = np.random.default_rng(3)
    shared = " ".join("".join(rng.choice(list("aeiostrn"), 6)) for _ in range(20))
    own = [" ".join("".join(rng.choice(list("aeiostrn"), 6)) for _ in range(15)) for _ in range(8)]
    texts = [f"{own[i]}\n{shared}" for i in range(6)] + [shared, None, "", own[6]]
    rows = [(i, t, "en", None, 99) for i, t in enumerate(texts)] + [(None, f"{own[7]}\n{shared}", None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter()
    for row in rows:
        i, text = row[0], row[1]
        if i == 0 or text is None or shared not in text:
            want[row] += 1
        elif text != shared:
            kept = text.replace(f"\n{shared}", "")
            want[(i, kept, row[2], row[3], len(kept))] += 1
    assert counted(corpus_pipeline.without_boilerplate(spark, docs, SF)) == want


def test_near_dedup_keeps_the_first_of_each_component(spark, awkward):
    rows = awkward_rows()
    prints = [plain_simhash(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    first = smallest_ids([r[0] for r in rows], pairs)
    want = Counter(r for r, c in zip(set(rows), [first[rows.index(r)] for r in set(rows)]) if r[0] is not None and r[0] == c)
    want += Counter(r for r in rows if r[0] is None)
    assert counted(corpus_pipeline.one_of_similar(spark, awkward, SF)) == want


def test_mix_takes_rows_up_to_twice(spark, awkward):
    rows = awkward_rows()
    found = counted(corpus_pipeline.mixed_sources(spark, awkward, SF))
    have = Counter(rows)
    assert set(found) <= set(have) and all(n <= 2 * have[r] for r, n in found.items())
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        size[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
        taken[r[3]] += 0
    for r, n in found.items():
        taken[r[3]] += n * len(WORD.findall(r[1] or ""))
    for source, target in plain_targets(size).items():
        assert abs(taken[source] - target) <= 2 * largest[source]
    assert counted(corpus_pipeline.mixed_sources(spark, awkward, SF)) == found  # reruns agree


def test_packing_holds_every_token_once(spark, awkward, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    docs = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = defaultdict(list)
    for r in corpus_pipeline.packed(spark, docs, SF).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    joined = {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()}
    assert joined == texts


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    seen = []

    def stage(name):
        return lambda spark, docs, sf_dir: (seen.append((name, docs.count(), sf_dir)), docs.limit(docs.count() - 1))[1]

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in "abc"])
    n = corpus_pipeline.run(spark, SF).count()
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert seen == [("a", total, SF), ("b", total - 1, SF), ("c", total - 2, SF)] and n == total - 3
