"""Mixing, languages, packing, token counts and quality against plain versions, round trips and held-out rows."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import langid, mixing, packing, quality, tokens
from flowlens.llm.common import crc32_mod
from flowlens.session import scratch_root
from tests.llm.conftest import awkward_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ------------------------------------------------------------------ mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight, cut what is above, share the excess again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, [n for n in names], share * sum(sizes.values())
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > most * sizes[n]]
        if not over:
            target.update({n: left * weight[n] / total for n in open_})
            break
        for n in over:
            target[n] = most * sizes[n]
        left -= sum(target[n] for n in over)
        open_ = [n for n in open_ if n not in over]
    return target


def test_mix_reaches_its_targets(documents):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    rows = mixing.mix(docs, chunk=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, chunk=64).collect()))
    sizes, taken, copies, most, n = (defaultdict(int) for _ in range(5))
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        copies[r["source"]] += r["copies"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        n[r["source"]] += 1
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s]
        assert abs(copies[s] - n[s] * want[s] / sizes[s]) <= 2.001


def test_mix_of_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward, chunk=8).collect()
    want = sorted((str(r[0]), len((r[1] or "").split(" "))) and (str(r[0]), str(r[3])) for r in awkward_rows())
    assert sorted((str(r["doc_id"]), str(r["source"])) for r in rows) == want
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]], rel=1e-9) for r in rows)
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 7}, {"a": 1, None: 1}, {"x": 0, "y": 4}, {"q": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert found == {s: pytest.approx(t, rel=1e-9) for s, t in plain_targets(sizes).items()}


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 400):
        size, chance = rng.integers(0, 50, n), np.full(n, 0.37)
        found = mixing.flight(size, chance, np.arange(n), rng.random(n))
        assert found.sum() == pytest.approx(chance.sum()) and (found * size).sum() == pytest.approx((chance * size).sum())
        assert ((found > 0) & (found < 1)).sum() <= 2 or n < 3


# ------------------------------------------------------------------ languages


def test_language_of_held_out_documents(documents):
    train = crc32_mod("doc_id", 3) != 1
    known = langid.learn(documents, train)
    assert known.languages == ["de", "en", "es", "fr"]
    found = langid.predict(documents.filter(~train), known)
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 250 and right / n > 0.97
    low, high = found.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_language_of_awkward_texts(awkward, nothing):
    known = langid.learn(awkward, F.lit(True))
    found = langid.predict(awkward, known).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in awkward_rows())
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1) if letters else (
            (r["lang_pred"], r["score"]) == ("und", 0.0))
    none = langid.learn(nothing, F.lit(True))
    assert none.languages == [] and {r["lang_pred"] for r in langid.predict(awkward, none).collect()} == {"und"}


def test_profiles_are_bundles_of_bound_letters():
    """Against the definition, letter by letter; batches don't matter."""
    p = langid.Profiler(256)

    def plain(text):
        seq, out = [], np.zeros(256)
        for c in " " + text.lower() + " ":
            if c.isalpha():
                seq.append(ord(c))
            elif not seq or seq[-1]:
                seq.append(0)
        for a, b, c in zip(seq, seq[1:], seq[2:]):
            if b or (a and c):
                out += np.roll(p.letter(a), 2) * np.roll(p.letter(b), 1) * p.letter(c)
        return out / np.linalg.norm(out)

    texts = ["ab", "The cat, the dog", "ünï  code!", "x"]
    assert np.allclose(p.profiles(texts), [plain(t) for t in texts], atol=1e-5)
    assert not p.profiles(["", None, "12 !"]).any()


# ------------------------------------------------------------------ tokens and packing


def test_token_counts(awkward, nothing, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)

    def count(text):
        return len(library.encode(text, add_special_tokens=False).ids)

    budget = 40
    found = tokens.token_counts(awkward, tokenizer, budget, keep=["doc_id", "key"]).collect()
    want = []
    for r in awkward_rows():
        text = r[1] or ""
        n = count(text)
        if len(text) < 1500 and n > budget:
            fits = max(i for i in range(len(text) + 1) if count(text[:i]) <= budget)
        else:
            fits = len(text) if n <= budget else None
        want.append((r[0], r[6], len(text.encode()), n, n > budget, fits))
    key = lambda r: (str(r[0]), r[2], r[3])
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and b[5] in (None, a[5]), (a, b)
    assert tokens.token_counts(nothing, tokenizer, budget).collect() == []


def test_pieces_by_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    known = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "one two  three", "é日🙂", "a\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, path, 3).collect()}
    assert found == {i: len(known.encode(t)) for i, t in enumerate(texts)}


def test_packing_round_trip(awkward, nothing, tokenizer):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    pieces = packing.pack(awkward, tokenizer, length=64).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 64 or at & (at - 1) == 0
    want = defaultdict(list)
    for r in awkward_rows():
        want[r[0]].append([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])
    assert set(want) == set(documents)
    for i, own in documents.items():
        if len(want[i]) == 1:
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(own, key=lambda p: p["start"])])
            assert ids.tolist() == want[i][0] and {p["doc_tokens"] for p in own} == {len(ids)}
        else:
            assert sum(p["length"] for p in own) == sum(map(len, want[i]))
    assert packing.pack(nothing, tokenizer).collect() == []


def test_packing_encodes_once_and_stores_nothing(spark, tokenizer, monkeypatch):
    """Ranges come from a sample: no table of all encoded documents is written, and many copies are cut between ranges."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 2000)
    rows = [(i, "one and the same text of many copies " * 20) for i in range(200)] + [(None, None), (7, ""), (7, "")]
    rows += [(1000 + i, f"own words {i * i} of document {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = scratch_root(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    pieces = packing.pack(docs, tokenizer, length=64)
    per_range = Counter(p["sequence_id"] >> 40 for p in pieces.collect())
    assert len(per_range) > 10 and max(per_range.values()) < 0.3 * sum(per_range.values())
    after = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert after == before
    tokens_of = Counter()
    for p in pieces.collect():
        tokens_of[p["doc_id"]] += p["length"]
    known = tokens.encoder(tokenizer)
    want = Counter()
    for i, t in rows:
        want[i] += len(known.ids([t or ""])[0]) // 4 + 1
    assert tokens_of == want


def test_small_tables_are_one_range(awkward, tokenizer):
    assert {p["sequence_id"] >> 40 for p in packing.pack(awkward, tokenizer).collect()} == {0}


def test_ids_are_those_of_whole_texts(tokenizer):
    known = tokens.Encoder(tokenizer, memo=40)
    texts = [r[1] or "" for r in awkward_rows() if len(r[1] or "") < 5000] + ["a  b", "a\n\nb", " a", "a ", "a \n b", "a\tb c"]
    for _ in range(2):
        assert known.ids(texts) == list(known.whole(texts))
    assert len(known.memo) + len(known.quick) < 5000


def test_hilbert_curve_visits_every_cell_next_to_the_last():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_keys(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------------ quality


def test_quality_of_held_out_rows(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = crc32_mod("doc_id", 4) != 2
    model = quality.fit(quality.label_rows(labels, documents, fold))
    found = quality.quality_scores(documents, model).join(labels.filter(~fold), "doc_id").select("quality", "score").collect()
    good = [r["score"] for r in found if r["quality"] == 1]
    bad = [r["score"] for r in found if r["quality"] == 0]
    assert all(zlib.crc32(b"3") % 4 is not None for _ in good) and len(good) > 50 and bad
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean(np.array(good) >= 0.7) > 0.95


def test_quality_of_awkward_texts(spark, awkward, nothing):
    labelled = awkward.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = quality.fit(labelled)
    found = quality.quality_scores(awkward, model).collect()
    assert len(found) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in found)
    by_text = defaultdict(set)
    for r in found:
        by_text[r["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    alone = quality.fit(nothing.select("doc_id", "text", F.lit(1).alias("label")))
    assert {r["score"] for r in quality.quality_scores(awkward, alone).collect()} == {0.5}
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.label_rows(both, awkward, F.lit(True)).select("doc_id", "label").collect()] == [(2, 1)]


def test_features_do_not_depend_on_the_block():
    texts = ["one two two THREE!", "", None, "a  b\n\nc", "é é é é 12"]
    ids, offsets = quality.features(texts)
    for i, t in enumerate(texts):
        assert quality.features([t])[0].tolist() == ids[offsets[i]:offsets[i + 1]].tolist()


def word_rows(n=90, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(60)]
    good = rng.integers(0, 2, n)
    return [" ".join(rng.choice(words[20 * g : 20 * g + 40], 12)) for g in good], good


def test_ratios_and_margins_against_plain_versions():
    """The fitted weights are the log-count ratios times the minimum of the hinge loss that a plain solver finds."""
    texts, good = word_rows()
    ids, offsets = quality.features(texts, 12)
    sets = [set(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
    ratio = np.zeros(1 << 12)
    for f in set().union(*sets):
        with_f = [g for s, g in zip(sets, good) if f in s]
        if len(with_f) >= quality.LEAST_ROWS:
            ratio[f] = np.log((1 + sum(with_f)) / (1 + good.sum())) - np.log(
                (1 + len(with_f) - sum(with_f)) / (1 + len(good) - good.sum()))
    value = ratio / np.sqrt(np.median([len(s) for s in sets]))
    x = np.zeros((len(good), 1 << 12))
    for i, s in enumerate(sets):
        x[i, list(s)] = value[list(s)]
    y = np.where(good == 1, 1.0, -1.0)
    cost = 0.1 / (2 * np.where(good == 1, (good == 1).mean(), (good == 0).mean()))

    def loss(w, bias):
        return 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - y * (x @ w + bias))).sum()

    gram = (x @ x.T + 1) * np.outer(y, y)
    alpha, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - rate * (gram @ alpha - 1), 0, cost)
    best = loss(x.T @ (alpha * y), (alpha * y).sum())
    model = quality.fit_rows(ids, offsets, good, 12, cost=0.1)
    used = value != 0
    w = np.divide(model.weight, value, out=np.zeros_like(value), where=used)
    assert (model.weight[~used] == 0).all()
    assert best <= loss(w, model.bias) + 1e-9 and loss(w, model.bias) < best * 1.01
    settled = quality.dual_descent(ids, offsets, value, y, cost, rounds=400)  # until a pass over all rows finds nothing
    assert best <= loss(*settled) + 1e-9 and loss(*settled) < best * 1.001


def test_training_features_are_bounded(spark):
    texts, good = word_rows(40)
    df = spark.createDataFrame([(i, t, int(g)) for i, (t, g) in enumerate(zip(texts, good))], "doc_id long, text string, label int")
    few = quality.fit(df, most=400)
    assert (few.weight != 0).sum() < (quality.fit(df).weight != 0).sum()
    assert quality.fit(df, most=1).slope == 1.0


def test_texts_in_any_order_give_the_ids_of_the_library(tokenizer):
    """White space of all kinds, and one encoder whose memo knows the pieces of all earlier texts."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    white = [" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000"]
    parts = white * 2 + ["a", "1", "the", "\U0001f600", ".", "'s", "\x01", "<|endoftext|>", "Ünï"]
    texts = ["\xa0", "1\n\xa0"] + ["".join(rng.choice(parts, rng.integers(1, 7))) for _ in range(6000)]
    library, known = Tokenizer.from_file(tokenizer), tokens.Encoder(tokenizer)
    for k in range(0, len(texts), 50):
        found = known.ids(texts[k : k + 50])
        for t, ids in zip(texts[k : k + 50], found):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
