"""Near-duplicates, repeated strings and lines against plain versions that compare everything with everything."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import embedding_cells, fingerprints, line_templates, links, simhash_pivots, suffix_dedup
from tests.llm.conftest import awkward_rows


def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def smallest_ids(ids, pairs):
    root = roots(len(ids), pairs)
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in root]


def same_rows(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


# ------------------------------------------------------------------ SimHash with pivots


def plain_simhash(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    runs = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(awkward):
    rows = [(r[0], plain_simhash(r[1])) for r in awkward_rows()]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3]
    want = [(i, format(f, "016x"), c) for (i, f), c in zip(rows, smallest_ids([r[0] for r in rows], pairs))]
    found = simhash_pivots.near_duplicates(awkward).select("doc_id", "fingerprint", "component_id").collect()
    same_rows(found, want)


def test_simhash_of_nothing(nothing):
    assert simhash_pivots.near_duplicates(nothing).collect() == []
    assert simhash_pivots.one_of_each(nothing).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_block_tables_agree_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    b = a.copy()
    for _ in range(radius):
        b ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    shared = simhash_pivots.bucket_keys(a, radius) == simhash_pivots.bucket_keys(b, radius)
    assert shared.any(axis=1).all()


def test_links_in_split_buckets(spark):
    """A hot bucket in many blocks gives the components of the plain comparison."""
    rng = np.random.default_rng(9)
    center = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    bits = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for c in center]))
    df = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "bits long")
    found = links.components(simhash_pivots.links(df, 3, bucket=16)).collect()
    root = {r["node"]: r["root"] for r in found}
    own = bits.view(np.int64).tolist()
    order = sorted(range(len(own)), key=lambda i: own[i])
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if int(bits[order[i]] ^ bits[order[j]]).bit_count() <= 3]
    want = [own[order[r]] for r in roots(len(own), pairs)]
    assert [root.get(own[i], own[i]) for i in order] == want


def test_unrelated_fingerprints_do_not_meet():
    bits = np.random.default_rng(20).integers(0, 1 << 64, 200_000, dtype=np.uint64)
    keys = simhash_pivots.bucket_keys(bits)
    assert keys.shape[1] == 20
    shared = 0
    for k in range(keys.shape[1]):
        _, n = np.unique(keys[:, k], return_counts=True)
        shared += int(n[n > 1].sum())
    assert shared < 2_000


def test_one_of_each_component(awkward):
    rows = awkward_rows()
    found = {(r["doc_id"], r["component_id"]) for r in simhash_pivots.near_duplicates(awkward).collect()}
    kept = simhash_pivots.one_of_each(awkward)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == sum(r[0] is None for r in rows) and kept.columns == awkward.columns
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and set(named) == {c for i, c in found if i == c and i is not None}
    assert set(range(14, 18)) <= set(named)  # a long passage in common is no near copy


# ------------------------------------------------------------------ long repeated strings


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(d), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram", [(400, 100), (40, 12)])
def test_repeats(awkward, length, gram):
    rows = awkward_rows()
    want = [(r[0], *p) for r, p in zip(rows, plain_repeats([r[1] for r in rows], length))]
    found = suffix_dedup.without_repeats(awkward, length, gram)
    assert "size" in found.columns and "text" not in found.columns
    found = found.select("doc_id", "n_bytes", F.size("spans"), F.sha2("kept", 256)).collect()
    same_rows(found, want)


def test_repeats_over_many_buckets(spark, awkward):
    """Grams that begin very many suffixes are split, and windows meet across the boundaries."""
    rows = [(i, f"{'pre' + str(i)} {'q' * (i % 7)} " + "the same long passage, again and again, in every document " * 2 + f"{i * i}")
            for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, *p) for (i, _), p in zip(rows, plain_repeats([t for _, t in rows], 60))]
    set_before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = suffix_dedup.without_repeats(df, 60, 20).select("doc_id", "n_bytes", F.size("spans"), F.sha2("kept", 256)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", set_before)
    same_rows(found, want)


def test_repeats_of_nothing(nothing):
    assert suffix_dedup.without_repeats(nothing).collect() == []


def test_multikey_order():
    rng = np.random.default_rng(1)
    values = [bytes(rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint8)) for _ in range(300)]
    rows, sizes = suffix_dedup._matrix(values, 30)
    order = suffix_dedup.multikey_order(rows, sizes)
    assert [values[i] for i in order] == sorted(values)
    share = suffix_dedup.common_prefix(rows, sizes, order)
    for k in range(1, 300):
        a, b = values[order[k - 1]], values[order[k]]
        assert share[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


# ------------------------------------------------------------------ embeddings


def vectors():
    rng = np.random.default_rng(2)
    out, base = [], rng.normal(size=(60, 16))
    for i in range(400):
        v = base[i % 60] + rng.normal(size=16) * (0.05 if i % 3 else 0.12)
        out.append((i, v.astype(np.float32).tolist(), [0, 1, None][i % 11 % 3]))
    hot = rng.normal(size=16)
    out += [(400 + i, (hot + rng.normal(size=16) * 0.02).tolist(), 5) for i in range(150)]
    out += [(600 + i, [1.0, 2.0, 0.0] * 5 + [1.0], 5) for i in range(20)]
    out += [(700, [0.0] * 16, 1), (701, None, 1), (702, [1.0, float("nan")] * 8, 1), (703, [None] * 16, 1), (704, [], 1),
            (705, [float("inf")] * 16, 1), (706, [1.0, 2.0], 1), (707, [2.0, 4.0], 1), (None, [2.0, 4.0], 1), out[7], out[7]]
    return out


def test_near_embeddings(spark):
    rows = vectors()
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame(rows, schema).withColumn("cell", F.lit("x")).withColumn("unit", F.lit(1)).repartition(4)
    units = [None if r[2] is None else embedding_cells.unit(None if r[1] is None else [
        None if v is None else float(np.float32(v)) for v in r[1]]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None
             and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98]
    count = Counter(k for p in pairs for k in p)
    component = smallest_ids([r[0] for r in rows], pairs)
    want = [(r[0], count[i], component[i], r[0] == component[i]) for i, r in enumerate(rows)]
    for cells, block in ((None, 2048), (12, 32)):
        same_rows(embedding_cells.near_embeddings(df, cells=cells, block=block).collect(), want)


def test_many_cells_lose_no_link():
    """Centroids of two levels: as many as asked for, and either end of a link visits the cell of the other."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))[rng.integers(0, 60, 1200)] + 0.1 * rng.normal(size=(1200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers = embedding_cells.cell_centers(x, 100, most=30)
    assert 80 <= len(centers) <= 120 and np.allclose(np.linalg.norm(centers, axis=1), 1)
    home, visits = embedding_cells.visited(x, centers, 0.98)
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert len(a) > 2 * len(x) and visits[a, home[b]].all()
    assert visits.mean() < 0.5


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_cells.near_embeddings(empty).collect() == []


# ------------------------------------------------------------------ fingerprints by block tables


def plain_fingerprint(spark, texts):
    """Votes of every bit, one by one, over the term hashes that Spark gives."""
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, t string")
    hashes = df.select("i", fingerprints.terms(F.col("t")).alias("h")).withColumn(
        "g", F.transform("h", lambda x: F.xxhash64(x))).collect()
    out = {}
    for r in hashes:
        n, text = len(r["h"]), ""
        for values in (r["h"], r["g"]):
            bits = sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in values) > n)
            text += format(bits, "016x")
        out[r["i"]] = text
    return [out[i] for i in range(len(texts))]


def test_edited_fingerprints(spark, awkward):
    rows = [(r[0], r[1] or "") for r in awkward_rows()]
    found = fingerprints.edited_fingerprints(awkward).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    following = [order[(i + 1) % len(order)][1] for i in range(len(order))]
    edited = []
    for (_, t), n in zip(order, following):
        half = len(t) // 2
        edited.append(t[:len(t) - half] + n[:half])
    own, other, after = (plain_fingerprint(spark, x) for x in ([t for _, t in order], edited, following))

    def like(a, b):
        return max(0.0, round(float(np.cos((int(a, 16) ^ int(b, 16)).bit_count() * np.pi / 128)), 6))

    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, pytest.approx(like(a, b), abs=2e-6), pytest.approx(like(a, c), abs=2e-6))
            for (i, t), e, a, b, c in zip(order, edited, own, other, after)]
    got = sorted([tuple(r)[:7] for r in found], key=lambda r: (r[0] is None, -(r[0] or 0), r[3]))
    assert got == sorted(want, key=lambda r: (r[0] is None, -(r[0] or 0), r[3]))


def test_runs_of_neighbours(spark, monkeypatch):
    """Many runs, uneven ids: every document still finds its next one."""
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 3)
    monkeypatch.setattr(fingerprints, "KNOTS", 5)
    ids = sorted({int(1.3 ** k) for k in range(1, 70)} | {10**6 + k for k in range(20)})
    df = spark.createDataFrame([(i, f"w{i} v{i} u{i} t{i}") for i in ids], "doc_id long, text string")
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited_fingerprints(df).collect()}
    for at, i in enumerate(ids):
        t, n = (f"w{x} v{x} u{x} t{x}" for x in (i, ids[at - 1]))
        half = len(t) // 2
        assert found[i] == hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()


def test_runs_are_even(spark, monkeypatch):
    """Clustered ids and null ids: no run holds many rows, and the order of runs is that of the ids."""
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 20)
    monkeypatch.setattr(fingerprints, "KNOTS", 4)
    ids = [*range(10**12, 10**12 + 900), *(k * 10**9 for k in range(50)), *[None] * 400]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    runs = [(r["doc_id"], r["run"], r["md5"]) for r in fingerprints._runs(docs).withColumn("md5", F.md5("text")).collect()]
    assert max(Counter(run for _, run, _ in runs).values()) <= 80
    order = sorted(runs, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    assert [r[1] for r in order] == sorted((r[1] for r in order), reverse=True)
    found = fingerprints.edited_fingerprints(docs).collect()
    following = {(r[0], r[2]): order[(k + 1) % len(order)][2] for k, r in enumerate(order)}
    text = {hashlib.md5(f"t{k}".encode()).hexdigest(): f"t{k}" for k in range(len(ids))}
    edited = sorted(hashlib.sha256((text[m][:len(text[m]) - len(text[m]) // 2] + text[n][:len(text[m]) // 2]).encode()).hexdigest()
                    for (_, m), n in following.items())
    assert sorted(r["edited_sha256"] for r in found) == edited


def test_a_front_of_many_fingerprints(spark, monkeypatch):
    """Fingerprints that differ in their last bits only meet in blocks; counts are those of all pairs."""
    monkeypatch.setattr(fingerprints, "BLOCK", 16)
    low = list(range(200))
    df = spark.createDataFrame([(7, x) for x in low], "hi long, lo long")
    want = {x: sum(0 < (x ^ y).bit_count() <= 3 for y in low) for x in low}
    assert {r["lo"]: r["n_near"] for r in fingerprints.with_neighbours(df).collect()} == want


def test_fingerprints_of_nothing(nothing):
    assert fingerprints.edited_fingerprints(nothing).collect() == []


@pytest.mark.parametrize("radius", [1, 3])
def test_within_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(25)]
    prints = list(dict.fromkeys(b ^ sum(1 << int(k) for k in rng.choice(128, int(rng.integers(0, 4)), replace=False))
                                for b in base for _ in range(4)))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    split = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    df = spark.createDataFrame(split * 2, "hi long, lo long")
    want = {frozenset((split[i], split[j])): (prints[i] ^ prints[j]).bit_count() for i in range(len(prints)) for j in range(i)
            if (prints[i] ^ prints[j]).bit_count() <= radius}
    found = fingerprints.within_radius(df, radius).collect()
    assert len(found) == len(want)
    assert {frozenset(((r[0], r[1]), (r[2], r[3]))): r["bits"] for r in found} == want


# ------------------------------------------------------------------ lines


def test_recurring_lines(spark, nothing):
    line = "server number 17 answered the request of client 99 in time"
    other = "server number 23 answered the request of client 5 in time"
    texts = [(i, f"{chr(97 + i)} unique start of the text goes here now\n{line if i % 2 else other}\nend of it {chr(97 + i)} with more words here")
             for i in range(6)]
    copied = "the very same first line stands in here\nand the very same second line follows it at once"
    texts += [(10 + i, copied) for i in range(5)] + [(20, None), (21, ""), (None, f"null id\n{line}\nx"), (22, "short\nshort")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("n_lines", F.lit("y"))
    found = {r["doc_id"]: r for r in line_templates.without_recurring_lines(df).collect()}
    assert found[0]["text"] == texts[0][1] and found[0]["n_dropped"] == 0  # the first keeps the line
    for i in range(1, 6):
        assert found[i]["n_dropped"] == 1 and "server number" not in found[i]["text"] and found[i]["text"].count("\n") == 1
    assert all(found[10 + i]["text"] == copied for i in range(5))  # copies of a document are no boilerplate
    assert found[20]["text"] is None and found[20]["n_lines"] == 0 and found[21]["n_lines"] == 1
    assert found[None]["text"] == "null id\nx" and found[22]["n_dropped"] == 0 and found[0]["h"] == "x"
    assert line_templates.without_recurring_lines(nothing).collect() == []
