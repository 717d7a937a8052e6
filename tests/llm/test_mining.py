"""Hard negatives, license scans and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import bitmask_codes, hard_negatives, licenses
from tests.llm.conftest import awkward_rows

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("leaf", T.StringType()),
    T.StructField("code", T.StringType()), T.StructField("error", T.StringType()), T.StructField("n", T.LongType()),
])


def vector_rows(n=700, width=32, seed=8):
    """Clusters with ties, copies, nulls in every column, non-finite and huge components, and odd lengths."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    rows = []
    for i in range(n):
        x = centers[i % 12] * 0.3 + rng.normal(size=width) * 0.05 * (1 + i % 5)
        rows.append((i, [float(np.float32(v)) for v in x], [0, 1, 2, None][rng.integers(0, 40) % 4] if i % 9 else 3))
    rows[5] = (5, None, 1)
    rows[6] = (6, [math.nan] + rows[6][1][1:], 1)
    rows[7] = (7, rows[7][1][:-1] + [math.inf], 1)
    rows[8] = (8, [None] + rows[8][1][1:], 1)
    rows[9] = (9, [0.0] * width, 1)
    rows[10] = (10, rows[11][1], rows[11][2])  # the same vector
    rows[12] = (12, [1e9] + rows[12][1][1:], 1)
    rows += [(50, rows[50][1], 0), (None, rows[20][1], 1), (n, [0.5] * 3, 1), (n + 1, [], 1), rows[100], rows[100]]
    return [(*r, "x", "y", "c", None, 4) for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(5).cache()


def usable(rows, width):
    for r in rows:
        v = r[1]
        if v is not None and len(v) == width and all(x is not None and abs(x) < 1 << 18 for x in v):
            yield r, [math.floor(256 * x) for x in v]


# ------------------------------------------------------------------ hard negatives


def plain_negatives(rows, width, every=50):
    known = [(r[0], r[2], np.array(v, dtype=object)) for r, v in usable(rows, width) if r[0] is not None and r[2] is not None]
    out = []
    for at, (anchor, label, a) in enumerate(known):
        if anchor % every:
            continue
        scored = sorted((-int((a * b).sum()), i, same == label) for k, (i, same, b) in enumerate(known) if k != at)
        for s, positive, _ in [x for x in scored if x[2]][:5]:
            fits = [(i, -t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(anchor, positive, rank, i, -s, t) for rank, (i, t) in enumerate(fits[:3], 1)]
    return out


@pytest.mark.parametrize("leaf_rows,block", [(20, 8), (100, 4096), (10_000, 64)])
def test_hard_negatives(vectors, leaf_rows, block):
    found = hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, leaf_rows=leaf_rows, block=block)
    want = plain_negatives(vector_rows(), 32)
    assert len(want) > 100
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_hard_negatives_of_a_rare_label(spark):
    rows = [(i, [float(np.float32(math.sin(i * k + 1))) for k in range(1, 9)], 1 if i in (0, 333) else 2) for i in range(400)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"),
                                          F.col("vec_id") % 50 == 0, leaf_rows=16)
    assert Counter(map(tuple, found.collect())) == Counter(plain_negatives([(*r,) for r in rows], 8))


def test_ranges_rule_out_only_what_cannot_be():
    rng = np.random.default_rng(3)
    whole = np.round(rng.normal(size=(3000, 12)) * 40 + rng.integers(0, 5, (3000, 1)) * 100).astype(np.int64)
    tree = hard_negatives.Tree(norm=math.sqrt(int((whole * whole).sum(axis=1).max())))
    x = tree.lifted(whole)
    tree.grow(x, 60, fanout=4)

    def note(node, gap, child):
        for j in np.unique(child):
            tree.low[node][:, j] = np.minimum(tree.low[node][:, j], gap[child == j].min(axis=0))
            tree.high[node][:, j] = np.maximum(tree.high[node][:, j], gap[child == j].max(axis=0))

    leaf = tree.route(x, note)
    assert len(np.unique(leaf)) > 20 and tree.leaves >= len(np.unique(leaf))
    anchors = whole[:40]
    score = anchors @ whole.T
    high = np.sort(score, axis=1)[:, -40]
    low = np.sort(score, axis=1)[:, -80]
    edge = lambda s: np.sqrt(np.maximum((anchors * anchors).sum(axis=1) + tree.norm**2 - 2.0 * s, 0))
    row, reached, _ = tree.reached(anchors, edge(high), edge(low))
    kept = set(zip(row.tolist(), reached.tolist()))
    needed = {(i, int(leaf[k])) for i in range(40) for k in np.flatnonzero((score[i] >= low[i]) & (score[i] <= high[i]))}
    assert needed <= kept
    assert len(kept) < 0.5 * 40 * tree.leaves


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame(vector_rows()[:1], VECTORS)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 50 == 0).collect() == []


# ------------------------------------------------------------------ vector codes


def plain_codes(rows, width, parts=16, entries=64, rounds=2):
    known = list(usable(rows, width))
    size = max(1, -(-width // parts))
    cut = [[(v + [0] * (size * parts))[p * size:(p + 1) * size] for p in range(parts)] for _, v in known]
    order = sorted(range(len(known)), key=lambda k: (known[k][0][0] is None, known[k][0][0] or 0))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            new.append([[sum(col) // len(own[i]) for col in zip(*own[i])] if own[i] else e for i, e in enumerate(books[p])])
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    total = Counter()
    for (r, _), f in zip(known, found):
        total[r[2]] += sum(e for e, _ in f)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(e for e, _ in f), total[r[2]], digest)
            for (r, _), f in zip(known, found)]


@pytest.mark.parametrize("width,entries", [(32, 64), (24, 7), (5, 1)])
def test_codes(spark, width, entries):
    rows = vector_rows(300, width)
    rows = [r for r in rows if r[0] != 50 or r[2] == 0]  # equal ids would leave the order of the first rows open
    found = bitmask_codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(4), entries=entries)
    assert Counter(map(tuple, found.collect())) == Counter(plain_codes(rows, width, entries=entries))


def test_box_and_nearest_are_exact():
    rng = np.random.default_rng(1)
    book = rng.integers(-50, 50, (64, 4))
    book[9] = book[40]
    masks = bitmask_codes.Masks(book)
    x = np.concatenate([rng.integers(-60, 60, (500, 4)), rng.integers(-9000, 9000, (20, 4)), book])
    for radius in (0, 3, 40):
        inside = (np.abs(x[:, None, :] - book[None]) <= radius).all(axis=2)
        assert [int(m) for m in masks.box(x, radius)] == [sum(1 << int(e) for e in np.flatnonzero(r)) for r in inside]
    gap = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    index, error = masks.nearest(x)
    assert (index == gap.argmin(axis=1)).all() and (error == gap.min(axis=1)).all()


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert bitmask_codes.compressed(empty).collect() == []
    assert bitmask_codes.compressed(spark.createDataFrame([(1, None, 2, *[None] * 5)], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        bitmask_codes.compressed(empty, entries=65)


# ------------------------------------------------------------------ licenses

TEXTS = [
    "MIT License mit license, Apache  License! the GNU GENERAL\nPUBLIC\tLICENSE",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0. Copyright 2020 by Ann Other. All rights reserved.",
    "licensed under the apache license 2.0 (the license) you may not use this",
    "Licensed under CC BY-NC 4.0. under the mit licenses", "mit mit license license mit license Ümit license",
    licenses.TEMPLATES["mit-text"].replace("<<beginOptional>>", "").replace("<<endOptional>>", "").replace(
        '<<var;name="holder";words="1-12">>', "the authors or copyright holders"),
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fees is hereby granted",
    "released under the terms of the MIT License", "copyright " + "x " * 20 + "all rights reserved", "SPDX-License-Identifier: MIT",
    "copyright " + "x " * 21 + "all rights reserved", "all rights all rights reserved all", "word " * 30_000 + "mit license",
]


def plain_scan(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
    joined = b" ".join([b"", *words, b""]).decode()
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words))
              if words[i:i + len(p.split())] == p.encode().split()]
    own = {label for label, t in licenses.TEMPLATES.items() if re.search(" " + licenses.pattern(licenses.parsed(t)), joined)}
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | own)), 1 - 0.5 ** (len(places) + 2 * len(own)))


def test_scan(spark, awkward, nothing):
    rows = list(enumerate(TEXTS)) + [(100 + r[0] if r[0] is not None else None, r[1]) for r in awkward_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash")).repartition(3)
    found = licenses.scan_licenses(docs).drop("spans", "whole")
    assert Counter(map(tuple, found.collect())) == Counter((i, *plain_scan(t)) for i, t in rows)
    assert licenses.scan_licenses(awkward).count() == awkward.count()
    assert licenses.scan_licenses(nothing).collect() == []


def test_places_of_templates(spark):
    docs = spark.createDataFrame([(0, "All rights reserved. x Copyright (c) me. All rights reserved."), (1, TEXTS[6]), (2, "")],
                                 "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert [tuple(s) for s in found[0]["spans"]] == [("rights-reserved", 0, 3), ("rights-reserved", 4, 10)]
    assert [found[i]["whole"] for i in range(3)] == [False, True, False]
    assert found[1]["labels"] == "mit-text" and found[2]["labels"] == "" and found[2]["score"] == 0


def test_random_templates_equal_regular_expressions():
    rng = random.Random(5)

    def template(depth=0):
        parts = [rng.choice("abc")]
        for _ in range(rng.randint(1, 4)):
            pick = rng.random()
            if pick < 0.5 or depth > 1:
                parts.append(rng.choice("abc"))
            elif pick < 0.75:
                least = rng.randint(0, 2)
                parts.append(f'<<var;name="v";words="{least}-{least + rng.randint(0, 3)}">>')
            else:
                parts.append(f"<<beginOptional>>{template(depth + 1)}<<endOptional>>")
        return " ".join(parts)

    for _ in range(300):
        items = [licenses.parsed(template()) for _ in range(3)]
        automaton = licenses.Automaton(items)
        single = [licenses.Automaton([i], anywhere=False) for i in items]
        for _ in range(6):
            words = [rng.choice("abcd").encode() for _ in range(rng.randint(0, 14))]
            joined = " " + "".join(w.decode() + " " for w in words)
            found = {k for _, numbers in automaton.accepted(automaton.coded(words)) for k in numbers}
            assert found == {k for k, i in enumerate(items) if re.search(" " + licenses.pattern(i), joined)}
            for k, i in enumerate(items):
                ends = [n for n in range(1, len(words) + 1) if re.fullmatch(licenses.pattern(i), joined[1:2 * n + 1])]
                assert single[k].longest(single[k].coded(words), 0) == max(ends, default=0)


@pytest.mark.parametrize("bad", ["<<beginOptional>> a", "<<endOptional>> a", "<<var;name=x>> a", '<<var;name="v";words="1-2">>', ""])
def test_templates_that_are_refused(bad):
    with pytest.raises(ValueError):
        licenses.parsed(bad)
