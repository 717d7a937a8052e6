"""Hard negatives by a multiway tree of split points with distance ranges.

Scores are inner products of whole-number vectors. One more coordinate, sqrt(M^2 - |x|^2) for rows and 0 for anchors,
gives all rows the norm M of the longest, so that a score s is the distance sqrt(|a|^2 + M^2 - 2 s) to the anchor a, and
a window of scores is an annulus around it.

The tree is fitted on a bounded sample: a node has several split points, far from each other, and a row goes to the
nearest. All rows are routed to their leaves; on the way each node learns, for every split point i and subtree j, the least
and the greatest distance of i to the rows of j. An anchor at distance d of split point i meets rows of its annulus
[r1, r2] in subtree j only if [d - r2, d + r2] meets the range of (i, j) for every i, and d plus the range's end reaches r1.

A search first visits the leaves next to the annulus' inner edge until they hold enough rows; the k-th score found narrows
the annulus, and the tree tells which of the other leaves can still hold better ones. Anchors and leaves meet by a join on
the leaf, both in blocks of bounded size, and scores are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.whole import floored, stacked
from flowlens.session import written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Rows of a leaf, about; split points of a node; leaves at most (the tree is broadcast); sampled vectors of a leaf.
LEAF_ROWS, FANOUT, MOST_LEAVES, LEAF_SAMPLE = 4_096, 16, 65_536, 16
#: Rows of a leaf, or asks, that one task takes; scores and range tests that it computes at a time.
BLOCK, PRODUCTS = 4_096, 4_000_000
_FAR = np.iinfo(np.int64).max
_SLACK = 1e-6


@dataclass
class Tree:
    """Nodes with their split points (rows, last coordinate included), children (a leaf n is -1 - n) and ranges."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0
    norm: float = 0.0

    def grow(self, x: np.ndarray, leaves: float, fanout: int = FANOUT) -> int:
        """Build a subtree of about so many leaves from sampled rows; its number as a child."""
        points = far_apart(x, min(fanout, math.ceil(leaves))) if leaves > 1.5 and len(x) > 1 else x[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        number, size = len(self.points), len(points)
        self.points.append(points)
        self.children.append(np.zeros(size, dtype=np.int64))
        self.low.append(np.full((size, size), np.inf))
        self.high.append(np.full((size, size), -np.inf))
        near = apart(x, points).argmin(axis=1)
        for j in range(size):
            own = x[near == j]
            self.children[number][j] = self.grow(own, leaves * len(own) / len(x), fanout)
        return number

    def lifted(self, whole: np.ndarray) -> np.ndarray:
        """Rows with their last coordinate."""
        x = whole.astype(np.float64)
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def route(self, x: np.ndarray, note=None) -> np.ndarray:
        """The leaf of each lifted row. ``note(node, distances, child)`` hears of every node passed."""
        leaf = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            gap = apart(x[rows], self.points[node])
            child = gap.argmin(axis=1)
            if note:
                note(node, gap, child)
            for j in np.unique(child):
                to, own = int(self.children[node][j]), rows[child == j]
                if to < 0:
                    leaf[own] = -1 - to
                else:
                    todo.append((to, own))
        return leaf

    def reached(self, anchors: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``anchors`` and the leaves that can hold rows of their annulus, with the anchor's distance to the leaf's point."""
        a = np.concatenate([anchors.astype(np.float64), np.zeros((len(anchors), 1))], axis=1)
        if not self.points:
            return np.arange(len(a)), np.zeros(len(a), dtype=np.int64), np.zeros(len(a))
        found, todo = [], [(0, np.arange(len(a)))]
        while todo:
            node, rows = todo.pop()
            low, high, children = self.low[node], self.high[node], self.children[node]
            step = max(1, PRODUCTS // low.size)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                d = apart(a[some], self.points[node])
                nearest = np.maximum(low[None] - d[:, :, None], d[:, :, None] - high[None]).max(axis=1)
                farthest = (d[:, :, None] + high[None]).min(axis=1)
                slack = _SLACK * (1.0 + self.norm)
                alive = (nearest <= r2[some, None] + slack) & (farthest >= r1[some, None] - slack)
                for j in range(len(children)):
                    own = some[alive[:, j]]
                    if not len(own):
                        continue
                    if children[j] < 0:
                        found.append((own, np.full(len(own), -1 - children[j]), d[alive[:, j], j]))
                    else:
                        todo.append((int(children[j]), own))
        return tuple(np.concatenate([f[c] for f in found]) if found else np.empty(0, dtype=np.int64) for c in range(3))


def apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2.0 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


def far_apart(x: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """``n`` different rows, each as far as possible from those before, of at most three times as many candidates."""
    some = x[np.random.default_rng(seed).choice(len(x), min(len(x), 3 * n), replace=False)]
    chosen, gap = [0], apart(some, some[:1])[:, 0]
    while len(chosen) < n and gap.max() > 1e-3:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, apart(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products in whole numbers. Below 2**53 doubles hold them, and all their partial sums, exactly."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _prepared(vectors: DataFrame, anchors: Column, id_col: str, label: str, vector: str, scale: int) -> DataFrame:
    chosen = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                            F.col(f"`{vector}`").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    chosen = chosen.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    schema = T.StructType([*chosen.select("vec_id", "label", "anchor").schema.fields, T.StructField("width", T.LongType()),
                           T.StructField("norm", T.LongType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, packed = floored(batch.column("vector"), scale)
            norm = [None if p is None else int((np.frombuffer(p, "<i4").astype(np.int64) ** 2).sum()) for p in packed]
            made = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "anchor")), pa.array(width), pa.array(norm, pa.int64()),
                 pa.array(packed, pa.binary())], names=schema.names)
            yield made.filter(made.column("v").is_valid())

    return chosen.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def indexed(rows: DataFrame, width: int, norm: int, n: int, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, Tree, dict[int, int]]:
    """``rows`` with their ``leaf``, the tree with its ranges, and the rows of each leaf."""
    spark = rows.sparkSession
    leaves = max(1, min(MOST_LEAVES, math.ceil(n / leaf_rows)))
    tree = Tree(norm=math.sqrt(norm))
    sample = rows.orderBy(F.xxhash64("row", F.lit(7)), "row").limit(LEAF_SAMPLE * max(leaves, 256)).select("v").toArrow()
    tree.grow(tree.lifted(stacked(sample["v"], width)), leaves)
    shared = spark.sparkContext.broadcast(tree)
    kinds = [*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("leaf", "node", "i", "j")),
             *(T.StructField(c, T.DoubleType()) for c in ("low", "high"))]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        low, high = [x.copy() for x in tree.low], [x.copy() for x in tree.high]

        def note(node: int, gap: np.ndarray, child: np.ndarray) -> None:
            for j in np.unique(child):
                own = gap[child == j]
                low[node][:, j] = np.minimum(low[node][:, j], own.min(axis=0))
                high[node][:, j] = np.maximum(high[node][:, j], own.max(axis=0))

        kinds = None
        for batch in batches:
            kinds = batch.schema
            if not len(batch):
                continue
            leaf = tree.route(tree.lifted(stacked(batch.column("v"), width)), note)
            none = [pa.nulls(len(batch), pa.int32())] * 3 + [pa.nulls(len(batch), pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), *none], names=schema.names)
        for node in range(len(low)):  # what the rows of this task add to the ranges
            i, j = np.nonzero(np.isfinite(low[node])) if kinds is not None else ((), ())
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(len(i), k.type) for k in kinds), pa.nulls(len(i), pa.int32()),
                     pa.array(np.full(len(i), node, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                     pa.array(low[node][i, j]), pa.array(high[node][i, j])], names=schema.names)

    routed = written(rows.mapInArrow(run, schema), "leaves")
    ranges = routed.filter("node IS NOT NULL").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    known = ranges.toArrow()  # at most FANOUT rows for each leaf
    for node, i, j, low, high in zip(*(known[c].to_numpy() for c in ("node", "i", "j", "low", "high"))):
        tree.low[node][i, j], tree.high[node][i, j] = low, high
    routed = routed.filter("leaf IS NOT NULL").drop("node", "i", "j", "low", "high")
    return routed, tree, {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}


def _meet(k: int, same: bool, width: int, exact: bool, kinds: T.StructType):
    """The task: asks and rows of one leaf in, the k best scores of each ask out."""

    def run(asks: pa.Table, base: pa.Table) -> pa.Table:
        parts = []
        if asks.num_rows and base.num_rows:
            b, ids, rows = stacked(base["v"], width), base["vec_id"].to_numpy(), base["row"].to_numpy()
            numbers: dict = {}
            own, theirs = (np.array([numbers.setdefault(x, len(numbers)) for x in t["label"].to_pylist()]) for t in (asks, base))
            anchor, first, of = np.unique(asks["anchor_row"].to_numpy(), return_index=True, return_inverse=True)
            a = stacked(asks["v"].take(pa.array(first)), width)
            low, high = asks["low"].to_numpy(), asks["high"].to_numpy()
            order, step = np.argsort(of, kind="stable"), max(1, PRODUCTS // len(b))
            for s in range(0, len(order), step):
                some = order[s : s + step]
                used, at = np.unique(of[some], return_inverse=True)
                score = products(a[used], b, exact)[at]
                fits = (score >= low[some, None]) & (score <= high[some, None])
                fits &= (own[some, None] == theirs[None, :]) == same
                fits &= anchor[of[some], None] != rows[None, :]
                score = np.where(fits, score, -_FAR)
                if len(b) > k:
                    least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    fits &= score >= least[:, None]
                ask, row = np.nonzero(fits)
                rank = np.lexsort((ids[row], -score[ask, row], ask))
                ask, row = ask[rank], row[rank]
                kept = np.arange(len(ask)) - np.searchsorted(ask, ask) < k
                ask, row = ask[kept], row[kept]
                parts.append(pa.table([asks["ask"].take(pa.array(some[ask])), pa.array(score[ask, row]),
                                       base["vec_id"].take(pa.array(row))], names=["ask", "score", "found_id"]))
        if parts:
            return pa.concat_tables(parts)
        return pa.table({"ask": pa.array([], pa.int64()), "score": pa.array([], pa.int64()),
                         "found_id": pa.array([], base.schema.field("vec_id").type)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("ask").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(asks: DataFrame, base: DataFrame, tree: Tree, sizes: dict[int, int], k: int, same: bool, width: int,
           block: int = BLOCK) -> DataFrame:
    """``ask``, rank, score and found_id: the ``k`` highest scores of each ask among rows of the same (or another) label.

    ``asks``: ask, anchor_row, label, v, norm, the window low to high of scores, and ``want``, how many rows the leaves
    visited first should hold.
    """
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast((tree, np.array([sizes.get(c, 0) for c in range(max(tree.leaves, 1))])))
    norm2 = round(tree.norm**2)
    exact = norm2 < 1 << 53

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, held = shared.value
            for batch in batches:
                for s in range(0, len(batch), 1024):
                    part = batch.slice(s, 1024)
                    a = stacked(part.column("v"), width)
                    top = part.column("norm").to_numpy().astype(np.float64) + norm2
                    edge = lambda c: np.sqrt(np.maximum(top - 2.0 * part.column(c).to_numpy(), 0.0))
                    r1, r2, narrowed = edge("high"), edge("low"), edge("bound")
                    row, leaf, gap = tree.reached(a, r1, r2)
                    row, leaf, gap = row[held[leaf] > 0], leaf[held[leaf] > 0], gap[held[leaf] > 0]
                    order = np.lexsort((leaf, np.abs(gap - r1[row]), row))
                    row, leaf = row[order], leaf[order]
                    total = np.cumsum(held[leaf])
                    begins = np.searchsorted(row, row)
                    before = total - held[leaf] - (total[begins] - held[leaf][begins])
                    early = before < part.column("want").to_numpy()[row]
                    if first:
                        row, leaf = row[early], leaf[early]
                    else:
                        wide = len(held)
                        near, at, _ = tree.reached(a, r1, narrowed)
                        fresh = ~np.isin(near * wide + at, (row * wide + leaf)[early]) & (held[at] > 0)
                        row, leaf = near[fresh], at[fresh]
                    chosen = part.select(["ask", "anchor_row", "label", "v", "low", "high"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(leaf.astype(np.int32))],
                                                     names=[*chosen.schema.names, "leaf"])

        return run

    kinds = asks.select("ask", "anchor_row", "label", "v", "low", "high").schema
    schema = T.StructType([*kinds.fields, T.StructField("leaf", T.IntegerType())])
    result = T.StructType([T.StructField("ask", T.LongType()), T.StructField("score", T.LongType()),
                           T.StructField("found_id", base.schema["vec_id"].dataType)])
    task = _meet(k, same, width, exact, kinds)
    keys = ["leaf", "ask_part", "base_part"]

    def met(visited: DataFrame) -> DataFrame:
        """Asks and rows by leaf, in blocks. One row for each leaf, MOST_LEAVES at most, is broadcast."""
        asked = visited.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("ask_parts"))
        held = spark.createDataFrame([(c, -(-n // block)) for c, n in sizes.items()], "leaf int, base_parts long")
        parts = F.broadcast(asked.join(held, "leaf"))
        every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        left = visited.join(parts, "leaf").withColumn("ask_part", F.pmod(F.xxhash64("ask"), F.col("ask_parts"))).withColumn(
            "base_part", every("base_parts")).drop("ask_parts", "base_parts")
        right = base.select("leaf", "row", "vec_id", "label", "v").join(parts, "leaf").withColumn(
            "base_part", F.pmod(F.xxhash64("row"), F.col("base_parts"))).withColumn("ask_part", every("ask_parts")).drop(
            "ask_parts", "base_parts")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, result)

    start = asks.withColumn("bound", F.col("low"))
    first = written(_best(met(written(start.mapInArrow(visits(True), schema), "visits")), k), "first-found").drop("rank")
    worst = first.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).filter(F.col("n") == k)
    narrowed = asks.join(worst.drop("n"), "ask", "left").withColumn("bound", F.coalesce("worst", "low")).select(*start.columns)
    rest = met(written(narrowed.mapInArrow(visits(False), schema), "visits"))
    return _best(first.unionByName(rest), k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", label: str = "label",
                   vector: str = "embedding", leaf_rows: int = LEAF_ROWS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the rows that ``anchors`` holds for.

    Components become floor(scale * x); a score is the inner product with the anchor, higher first, ties to the smaller id.
    Positives are an anchor's first ``positives`` other rows of its label. Negatives of a positive are the first
    ``negatives`` rows of other labels that score between ``low`` and ``high`` percent of it, both included; a negative
    positive_score has none. Rows with a null id or label, a null vector, or a component that is null, not finite or of
    2**18 or more in size take no part, nor do vectors of another length than most (ties: the shorter). Repeated rows are
    rows of their own, also as each other's positives. Other columns play no part; an empty table gives an empty result.
    """
    rows = written(_prepared(vectors, anchors, id_col, label, vector, scale), "whole-vectors")
    usual = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).orderBy(
        F.desc("n"), "width").first()
    if usual is None:
        usual = {"width": 0, "n": 0, "norm": 0}
    width = usual["width"]
    base, tree, sizes = indexed(rows.filter(F.col("width") == width).drop("width"), width, usual["norm"], usual["n"], leaf_rows)
    held = base.groupBy("label").agg(F.count(F.lit(1)).alias("of_label"))
    own = base.filter("anchor").select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), "label", "v", "norm")
    # Leaves first visited hold, on average, four times as many rows of the label as are needed.
    want = F.ceil(F.lit(4.0 * positives * usual["n"]) / F.col("of_label")).cast("long")
    top = F.lit(usual["norm"]).cast("long")
    asks = own.join(held, "label").select(
        F.col("anchor_row").alias("ask"), "anchor_row", "label", "v", "norm", (-top - 1).alias("low"), top.alias("high"),
        want.alias("want"))
    found = written(search(asks, base, tree, sizes, positives, True, width, block).select(
        (F.col("ask") * positives + F.col("rank") - 1).alias("ask"), F.col("ask").alias("anchor_row"),
        F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    window = found.filter("positive_score >= 0").select(
        "ask", "anchor_row", F.ceil(F.col("positive_score") * F.lit(low) / F.lit(100)).cast("long").alias("low"),
        F.floor(F.col("positive_score") * F.lit(high) / F.lit(100)).cast("long").alias("high")).filter("low <= high")
    asks = window.join(own.drop("anchor_id"), "anchor_row").select(
        "ask", "anchor_row", "label", "v", "norm", "low", "high", F.lit(64 * negatives).cast("long").alias("want"))
    mined = search(asks, base, tree, sizes, negatives, False, width, block)
    return mined.join(found, "ask").join(own.select("anchor_row", "anchor_id"), "anchor_row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


#: The mining of ``embeddings`` by scoring every anchor with every row.
SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
 FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
fitting AS (SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score
 FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
 SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS rank
 FROM fitting) WHERE rank <= {NEGATIVES}"""
