"""V6: a stored index for approximate nearest neighbours, with the recall it reaches.

A tree of two levels: cells around centres that the driver fits on a bounded sample, and in each cell leaves around
centres that a task fits on the cell's own sample, so that leaves grow with the rows and keep their size. What a row
differs by from its leaf's centre is product-quantised: a byte for each part of the vector. A query visits the leaves
nearest to it, ranks their rows by the vectors their bytes stand for, and multiplies only the best of them.

Cells, leaves, codebooks and rows are tables below one path. Cells and codebooks, of a fixed largest size, are broadcast;
blocks of queries, each with the list of its leaves, meet the leaves and the rows by joins, rows in blocks. :func:`calibrate` compares a bounded set of queries
with the exact search and doubles the leaves visited until the recall asked for is reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.knn import (
    BLOCK_ROWS, DEFAULT_K, Cells, _along, _dealt, _first_k, _meet, _pair_distances, _rank, _rows, _search, _visits,
    distances, matrix, search_cells, space,
)
from flowlens.session import written

#: Rows of a leaf, about; cells at most; rows that the driver, and a task for its cell, fits centres on at most.
LEAF_ROWS, MOST_CELLS, SAMPLE, CELL_SAMPLE = 250, 4_096, 65_536, 16_384
#: Bytes of a row's code at most and entries of a codebook; residuals that codebooks are fitted on at most.
PARTS, ENTRIES, RESIDUALS = 16, 256, 20_000
#: Leaves that a query visits before calibration; rows of a leaf that it multiplies.
PROBES, RERANK = 8, 32
#: Rows of a cell or leaf that one task holds, and queries that meet them.
BLOCK = 16_384
#: Columns that the index adds to the rows.
OWN = ("cell", "leaf", "code", "leaf_gap", "cell_gap")
#: Queries that the recall is measured on, and the recall to reach.
MEASURED, RECALL = 256, 0.92


@dataclass(frozen=True)
class VectorIndex:
    path: str
    metric: str
    id_col: str
    vector: str
    probes: int = PROBES

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path.rstrip('/')}/{name}")


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres of the points; centres without points stay where they began."""
    k = max(1, min(k, len(points)))
    centers = points[np.random.default_rng(seed).choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest(points, centers)[0]
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each point, and the distance."""
    near, gap = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    for i in range(0, len(points), 2048):
        found = distances(points[i : i + 2048], centers, "l2")
        near[i : i + 2048] = found.argmin(axis=1)
        gap[i : i + 2048] = found[np.arange(len(found)), near[i : i + 2048]]
    return near, gap


def part_ranges(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    edges = np.linspace(0, width, min(parts, width) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:]))


def encode(residuals: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """A byte for each part: its nearest codebook entry."""
    ranges = part_ranges(residuals.shape[1], len(books))
    return np.stack([nearest(residuals[:, a:b], book)[0] for (a, b), book in zip(ranges, books)], axis=1).astype(np.uint8)


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, dtype=np.float64).reshape(-1)))


def _centers_of(table: DataFrame, *order: str) -> np.ndarray:
    return matrix(table.orderBy(*order).select("center").toArrow()["center"])


def build_index(base: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", metric: str = "cosine",
                leaf_rows: int = LEAF_ROWS, parts: int = PARTS) -> VectorIndex:
    """Index ``base`` (other columns are carried along) below ``path``. Rows without a vector are left out."""
    if metric not in ("cosine", "l2"):
        raise ValueError(f"an index bounds no {metric!r}")
    spark = base.sparkSession
    base = base.filter(F.col(vector).isNotNull())
    n = base.count()
    if not n:
        raise ValueError("nothing to index")
    leaves = math.ceil(n / leaf_rows)
    by_hash = F.xxhash64(id_col)
    sample = base.orderBy(by_hash, id_col).limit(min(SAMPLE, 16 * leaves + 1024)).select(vector).toArrow()
    points = space(matrix(sample[vector]), metric)
    centers = kmeans(points, min(MOST_CELLS, math.ceil(math.sqrt(leaves))))
    width = points.shape[1]
    ranges = part_ranges(width, parts)
    shared = spark.sparkContext.broadcast(centers)

    @F.arrow_udf("int")
    def cell_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(nearest(space(matrix(batch, width), metric), shared.value)[0].astype(np.int32))

    placed = written(base.withColumn("cell", cell_of(F.col(vector))), "index-cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("of_cell"))  # a row for each cell, MOST_CELLS at most
    sizes = F.broadcast(sizes.withColumn("parts", F.ceil(F.col("of_cell") / F.lit(BLOCK)).cast("long")))
    share = F.least(F.lit(1.0), F.lit(float(CELL_SAMPLE)) / F.col("of_cell"))
    part_of = F.pmod(by_hash, F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = placed.join(sizes, "cell").filter(part_of < share).select("cell", "of_cell", vector)
    per_cell = max(4, math.ceil(RESIDUALS / len(centers)))

    def fit(table: pa.Table) -> pa.Table:
        """A cell's leaf centres, and with leaf -1 some residuals of its sample."""
        points = space(matrix(table[vector], width), metric)
        own = kmeans(points, math.ceil(table["of_cell"][0].as_py() / leaf_rows))
        left = points - own[nearest(points, own)[0]]
        left = left[np.random.default_rng(1).permutation(len(left))[:per_cell]]
        number = np.concatenate([np.arange(len(own)), np.full(len(left), -1)]).astype(np.int32)
        return pa.table([pa.array(np.full(len(number), table["cell"][0].as_py(), dtype=np.int32)), pa.array(number),
                         _lists(np.concatenate([own, left]))], names=["cell", "leaf", "center"])

    fitted = written(drawn.groupBy("cell").applyInArrow(fit, "cell int, leaf int, center array<double>"), "index-leaves")
    residuals = matrix(fitted.filter("leaf < 0").select("center").toArrow()["center"], width)
    books = [kmeans(residuals[:, a:b], ENTRIES) for a, b in ranges]
    shared_books = spark.sparkContext.broadcast(books)
    names = [c for c in placed.columns if c != "cell"]
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in names] + [
        T.StructField("cell", T.IntegerType()), T.StructField("leaf", T.IntegerType()), T.StructField("code", T.BinaryType()),
        T.StructField("leaf_gap", T.DoubleType()), T.StructField("cell_gap", T.DoubleType())])

    added = {"leaf": pa.int32(), "code": pa.binary(), "leaf_gap": pa.float64(), "cell_gap": pa.float64()}

    def assign(rows: pa.Table, centers: pa.Table) -> pa.Table:
        points = space(matrix(rows[vector], width), metric)
        order = np.argsort(centers["leaf"].to_numpy())
        known = matrix(centers["center"], width)[order]
        if not len(points):
            return pa.table([*rows.select([*names, "cell"]).columns, *(pa.array([], k) for k in added.values())],
                            names=schema.names)
        leaf, gap = nearest(points, known)
        code = encode(points - known[leaf], shared_books.value)
        to_cell = np.linalg.norm(points - shared.value[rows["cell"][0].as_py()], axis=1)
        found = [leaf.astype(np.int32), [c.tobytes() for c in code], gap, to_cell]
        out = pa.table([*rows.select([*names, "cell"]).columns, *(pa.array(f, k) for f, k in zip(found, added.values()))],
                       names=schema.names)
        return out.sort_by("leaf")

    keys = ["cell", "part"]
    rows = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(id_col, F.lit(1)), F.col("parts"))).drop("of_cell", "parts")
    every = fitted.filter("leaf >= 0").join(sizes, "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("of_cell", "parts")
    whole = rows.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(assign, schema)
    root = path.rstrip("/")
    whole.write.parquet(f"{root}/rows")
    held = spark.read.parquet(f"{root}/rows").groupBy("cell", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.max("leaf_gap").alias("radius"), F.max("cell_gap").alias("cell_radius"))
    fitted.filter("leaf >= 0").join(held, ["cell", "leaf"]).write.parquet(f"{root}/leaves")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(
        1).write.parquet(f"{root}/cells")
    spark.createDataFrame([(p, e, c.tolist()) for p, book in enumerate(books) for e, c in enumerate(book)],
                          "part int, entry int, center array<double>").coalesce(1).write.parquet(f"{root}/books")
    return VectorIndex(root, metric, id_col, vector)


def _visiting(index: VectorIndex, queries: DataFrame, probes: int) -> DataFrame:
    """Each query in a block of queries near it, with the ``probes`` leaves nearest to it: lists cells, leaves and held rows.

    The cells nearest to the query are opened, half as many as leaves are wanted and two at least. A block of queries meets
    the leaves of the cells that its queries open; no row leaves it but the query's own.
    """
    spark, vector, metric = queries.sparkSession, index.vector, index.metric
    known = _centers_of(index.table(spark, "cells"), "cell")
    shared, cells = spark.sparkContext.broadcast(known), max(2, math.ceil(probes / 2))

    def opened(rows: np.ndarray, _) -> np.ndarray:
        found = distances(space(rows, metric), shared.value, "l2")
        chosen = np.zeros(found.shape, dtype=bool)
        np.put_along_axis(chosen, np.argsort(found, axis=1, kind="stable")[:, :cells], True, axis=1)
        return chosen

    asks = _dealt(queries.filter(F.col(vector).isNotNull()).select("query_id", vector), known, vector, metric, BLOCK_ROWS)
    asks = written(asks, "asks")
    near = index.table(spark, "leaves").select("cell", "leaf", "n", "center").join(_visits(asks, vector, opened), "cell")
    lists = {"cells": T.IntegerType(), "leaves": T.IntegerType(), "held": T.LongType()}
    result = T.StructType([*asks.schema.fields, *(T.StructField(c, T.ArrayType(t)) for c, t in lists.items())])

    def nearest_leaves(asks: pa.Table, leaves: pa.Table) -> pa.Table:
        leaves = leaves.sort_by([("cell", "ascending"), ("leaf", "ascending")])
        own = [leaves["cell"].to_numpy().astype(np.int32), leaves["leaf"].to_numpy().astype(np.int32), leaves["n"].to_numpy()]
        parts = [asks.schema.empty_table().append_column("cells", pa.array([], pa.list_(pa.int32()))).append_column(
            "leaves", pa.array([], pa.list_(pa.int32()))).append_column("held", pa.array([], pa.list_(pa.int64())))]
        centers = matrix(leaves["center"]) if leaves.num_rows else None
        for start in range(0, asks.num_rows if leaves.num_rows else 0, 1024):
            part = asks.slice(start, 1024)
            rows = matrix(part[vector])
            gap = distances(space(rows, metric), centers, "l2")
            gap[~opened(rows, part)[:, own[0]]] = np.inf
            best = np.argsort(gap, axis=1, kind="stable")[:, :probes]
            some = np.isfinite(np.take_along_axis(gap, best, axis=1))
            offsets = pa.array(np.concatenate([[0], some.sum(axis=1).cumsum()]).astype(np.int32))
            for name, values in zip(lists, own):
                part = part.append_column(name, pa.ListArray.from_arrays(offsets, pa.array(values[best[some]])))
            parts.append(part)
        return pa.concat_tables(parts)

    return asks.groupBy("block").cogroup(near.groupBy("block")).applyInArrow(nearest_leaves, result)


def exact_search(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_K, fields: Sequence[str] | None = None,
                 before: str | None = None) -> DataFrame:
    """The ``k`` nearest rows, exactly, as ``knn`` gives them: for tables of more leaves than one broadcast holds.

    The nearest cells bound a query's k-th distance; then it opens the cells, and in them the leaves, whose distance less
    radius is within the bound. With ``before`` only rows count whose value is smaller than the query's, and no cell is
    opened whose least value is not. Blocks of queries and of rows meet as in ``knn``.
    """
    spark = queries.sparkSession
    id_col, vector, metric = index.id_col, index.vector, index.metric
    rows = index.table(spark, "rows")
    if fields is None:
        fields = [c for c in rows.columns if c not in (id_col, vector, *OWN)]
    carried = [f for f in fields if f != id_col]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    result = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("distance", T.DoubleType()),
                           *[T.StructField(c, kinds[c]) for c in [id_col, *carried]]])
    columns = list(dict.fromkeys([id_col, vector, *carried, *([before] if before else []), "cell", "leaf"]))
    queries = queries.filter(F.col(vector).isNotNull()).select("query_id", vector, *([before] if before else [])).withColumn(
        "bound", F.lit(float("inf")))
    cells = _cells_of(index, rows, before)
    return search_cells(queries, rows.select(*columns), cells, k, metric, id_col, vector, carried, result, before).select(
        "query_id", "rank", "distance", id_col, *carried)


def _cells_of(index: VectorIndex, rows: DataFrame, before: str | None = None) -> Cells:
    """The cells of the tree, MOST_CELLS at most."""
    spark = rows.sparkSession
    stats = index.table(spark, "leaves").groupBy("cell").agg(F.sum("n").alias("n"), F.max("cell_radius").alias("r"))
    if before:
        stats = stats.join(rows.groupBy("cell").agg(F.min(before).alias("least")), "cell")
    return Cells.of(_centers_of(index.table(spark, "cells"), "cell"), stats.toArrow())


def search_index(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None,
                 rerank: int | None = RERANK, fields: Sequence[str] | None = None) -> DataFrame:
    """V6: query_id, rank, distance, the id and ``fields`` (all when None) of about the ``k`` nearest rows.

    ``queries``: query_id and the vector. ``probes`` leaves are visited (the index' own number when None), and ``rerank``
    rows of each, by their codes, are multiplied; all rows of the leaves when None. Distances and ties as for ``knn``.
    """
    spark = queries.sparkSession
    probes = index.probes if probes is None else probes
    rows = index.table(spark, "rows")
    id_col, vector, metric = index.id_col, index.vector, index.metric
    if fields is None:
        fields = [c for c in rows.columns if c not in (id_col, vector, *OWN)]
    carried = [f for f in fields if f != id_col]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    result = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("distance", T.DoubleType()),
                           *[T.StructField(c, kinds[c]) for c in [id_col, *carried]]])
    shown = ["query_id", "rank", "distance", id_col, *carried]
    cells = _cells_of(index, rows)
    width, order, n = cells.centers.shape[1], _along(cells.centers), sum(cells.sizes.values())
    if rerank is None and probes >= index.table(spark, "leaves").count():  # every row of every leaf
        asks = queries.filter(F.col(vector).isNotNull()).select("query_id", vector)
        asks = written(_dealt(asks, cells.centers, vector, metric, BLOCK_ROWS), "asks")
        all_cells = asks.select("block").distinct().crossJoin(rows.select("cell").distinct())
        base = rows.select(id_col, vector, *carried, "cell", "leaf")
        task = _meet(k, metric, id_col, vector, carried, None, prune=False)
        found = _search(all_cells, asks, base, cells.sizes, task, result, id_col, _rows(BLOCK_ROWS, n, width), order)
        return _rank(found, k, id_col).select(*shown)

    books = index.table(spark, "books").orderBy("part", "entry").toArrow().to_pylist()
    books = [np.array([b["center"] for b in books if b["part"] == p]) for p in range(books[-1]["part"] + 1)]
    shared = spark.sparkContext.broadcast(books)

    def gaps(q: np.ndarray, b: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Rounded distances of each query to its own rows of the leaf."""
        row = np.repeat(np.arange(len(q)), some.shape[1])
        return _pair_distances(q, b, row, some.reshape(-1), metric).reshape(some.shape)

    def meet(asks: pa.Table, base: pa.Table) -> pa.Table:
        """The queries of a block and the rows of leaves; each leaf's rows are ranked by their codes for those that visit it."""
        parts = [asks.select(["query_id"]).slice(0, 0).append_column("distance", pa.array([], pa.float64()))]
        for c in [id_col, *carried]:
            parts[0] = parts[0].append_column(c, base[c].slice(0, 0))
        if not asks.num_rows or not base.num_rows:
            return parts[0]
        books = shared.value
        q, b = matrix(asks[vector], width), matrix(base[vector], width)
        points = space(q, metric)
        row = np.repeat(np.arange(len(q)), asks["cells"].combine_chunks().value_lengths().to_numpy())
        visit = _leaf_key(asks["cells"].combine_chunks().flatten().to_numpy(), asks["leaves"].combine_chunks().flatten().to_numpy())
        by_leaf = np.argsort(visit, kind="stable")
        row, visit = row[by_leaf], visit[by_leaf]
        own = _leaf_key(base["cell"].to_numpy(), base["leaf"].to_numpy())
        place = np.empty(len(b), dtype=np.int64)
        place[pc.sort_indices(base[id_col], null_placement="at_start").to_numpy()] = np.arange(len(b))
        placed = np.argsort(own, kind="stable")
        starts = np.nonzero(np.concatenate([[True], np.diff(own[placed]) != 0]))[0]
        ends = np.append(starts[1:], len(placed))
        held, waiting, n, bound = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)), [], 0, np.full(len(q), np.inf)
        for start, end in zip(starts, ends):
            mine = placed[start:end]
            first, last = np.searchsorted(visit, [own[mine[0]], own[mine[0]] + 1])
            if first == last:
                continue
            leaf = b[mine]
            if rerank is not None and len(leaf) > rerank:
                code = np.frombuffer(b"".join(base["code"].take(pa.array(mine)).to_pylist()), dtype=np.uint8).reshape(len(leaf), len(books))
                about = np.asarray(base["center"][int(mine[0])].as_py()) + np.concatenate(
                    [book[code[:, p]] for p, book in enumerate(books)], axis=1)
                half = (about**2).sum(axis=1) / 2
            for at in range(first, last, 2048):
                some_rows = row[at : min(at + 2048, last)]
                if rerank is not None and len(leaf) > rerank:
                    some = np.argpartition(half - points[some_rows] @ about.T, rerank - 1, axis=1)[:, :rerank]
                else:
                    some = np.broadcast_to(np.arange(len(leaf)), (len(some_rows), len(leaf)))
                gap = gaps(q[some_rows], leaf, some)
                r, c = np.nonzero(~(gap > bound[some_rows][:, None]))
                waiting.append((some_rows[r], mine[some[r, c]], gap[r, c]))
                n += len(r)
                if n > max(k * len(q), 65_536):
                    *held, kth = _first_k(*(np.concatenate(x) for x in zip(held, *waiting)), place, k, len(q))
                    bound, waiting, n = np.fmin(bound, kth), [], 0
        row, column, gap, _ = _first_k(*(np.concatenate(x) for x in zip(held, *waiting)), place, k, len(q))
        rows = base.select([id_col, *carried]).take(pa.array(column))
        return pa.table([asks["query_id"].take(pa.array(row)), pa.array(gap), *rows.columns], names=result.names)

    asks = written(_visiting(index, queries, probes).drop("held"), "visits")
    visits = asks.select("block", F.explode(F.array_distinct("cells")).alias("cell")).distinct()
    centers = index.table(spark, "leaves").select("cell", "leaf", F.col("center").cast("array<float>").alias("center"))
    base = rows.select(id_col, vector, "code", *carried, "cell", "leaf").join(centers, ["cell", "leaf"])

    def own(asks: DataFrame) -> DataFrame:
        """A query takes the leaves to a block that lie in its cells."""
        some = F.filter(F.arrays_zip("cells", "leaves"), lambda x: F.array_contains("_cells", x["cells"]))
        asks = asks.withColumn("_some", some).filter(F.size("_some") > 0)
        return asks.withColumns({c: F.col(f"_some.{c}") for c in ("cells", "leaves")}).drop("_some")

    found = _search(visits, asks, base, cells.sizes, meet, result, id_col, _rows(BLOCK_ROWS, n, 2 * width), order, own)
    return _rank(found, k, id_col).select(*shown)


def _leaf_key(cell: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    return cell.astype(np.int64) * (1 << 32) + leaf.astype(np.int64)


def multiplied(index: VectorIndex, queries: DataFrame, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """``query_id`` and ``multiplied``: the rows whose vectors a search multiplies with the query."""
    visits = _visiting(index, queries.select("query_id", index.vector), index.probes if probes is None else probes)
    of_leaf = lambda n: F.least(n, F.ceil(n / F.lit(BLOCK)) * F.lit(rerank)).cast("long")
    cost = F.aggregate("held", F.lit(0).cast("long"), lambda total, n: total + of_leaf(n))
    return visits.select("query_id", cost.alias("cost")).groupBy("query_id").agg(F.sum("cost").cast("long").alias("multiplied"))


def recall(found: DataFrame, exact: DataFrame, k: int = DEFAULT_K) -> float:
    """Of the exact neighbours (those as near as the k-th count as well), the share that was found."""
    last = exact.groupBy("query_id").agg(F.max("distance").alias("last"), F.count(F.lit(1)).alias("of"))
    hit = found.join(last, "query_id").filter("distance <= last").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    row = last.join(hit, "query_id", "left").agg(
        F.sum(F.least(F.coalesce("hits", F.lit(0)), "of")).alias("hits"), F.sum("of").alias("of")).first()
    return row["hits"] / row["of"] if row["of"] else 1.0


def calibrate(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_K, target: float = RECALL,
              measured: int = MEASURED) -> tuple[VectorIndex, float]:
    """The index with as many probes as the recall ``target`` takes, and the recall reached.

    Measured on the first ``measured`` queries by a hash of their ids, each against all rows.
    """
    spark = queries.sparkSession
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(measured).select("query_id", index.vector)
    some = written(some, "measured")
    exact = written(exact_search(index, some, k, fields=[]), "exact")
    leaves, probes = index.table(spark, "leaves").count(), index.probes
    while True:
        reached = recall(search_index(index, some, k, probes, fields=[]), exact, k)
        if reached >= target or probes >= leaves:
            return replace(index, probes=probes), reached
        probes *= 2
