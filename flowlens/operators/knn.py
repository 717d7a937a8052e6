"""V1 to V7: nearest neighbours of query vectors.

Base vectors lie in cells around centres. A query first searches its nearest cells until these hold k vectors, which
bounds its k-th distance; then it goes to the other cells whose centre distance less radius is within that bound, and
only candidates within the bound leave a task. Blocks of queries with nearby cells meet blocks of base rows, both of bounded
size, so neither side is collected or broadcast, a crowded cell is many tasks, and a query is sent once to a block, not once
to each cell. A task multiplies in single precision, and in double precision the pairs that its error leaves in doubt. Approximate search visits a given number of
cells and no more. Distances ascend for all metrics and are rounded to 6 decimals; ties go to the smaller id, so the
result does not depend on cells or partitions.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import sparse
from flowlens.plans.olap import apply_filters
from flowlens.session import scratch_path, written

DEFAULT_K = 5
METRICS = ("cosine", "l2", "ip")
#: Base vectors of a cell, about; cells at most; vectors that centres are fitted on at most.
CELL_ROWS, MOST_CELLS, SAMPLE = 4_000, 1024, 20_000
#: Unit of the blocks that meet in a task: of either side 20 at most, and no more than VALUES numbers.
BLOCK_ROWS, VALUES = 4_096, 8_388_608
#: Blocks that either side is dealt over, unless that makes them too large: each is sent once to each of the other side.
#: Rows of either side multiplied at a time.
QUERY_BLOCKS, QUERY_ROWS = 8, 2_048
#: Tasks that blocks meet in at most.
MOST_TASKS = 4_096
#: Pairs whose distances are computed at a time.
PAIRS = 65_536
#: Vectors this wide at least, with no more than a share of SPARSE components that are not zero, are folded to FOLDED numbers.
WIDE, SPARSE, FOLDED = 256, 0.125, 128
#: Of packed vectors a block has so many units at most, and no more than half of VALUES numbers that are not zero.
PACKED_ROWS = 64
#: A column of base rows that tells groups in a cell.
GROUP = "leaf"
SLACK = 2e-6


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Equal-length float lists as a float64 matrix."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = width or (len(flat) // n if n else 0)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if n and not (lengths == width).all():
        raise ValueError(f"vectors must all have {width} elements")
    return flat.reshape(n, width)


def distances(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """cosine: 1 - similarity; l2: Euclidean; ip: minus the inner product."""
    product = queries @ base.T
    if metric == "ip":
        return -product
    if metric == "l2":
        square = (queries**2).sum(1)[:, None] + (base**2).sum(1)[None, :] - 2 * product
        return np.sqrt(np.maximum(square, 0.0))
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(base, axis=1)[None, :]
    return 1.0 - np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)


def space(vectors: np.ndarray, metric: str) -> np.ndarray:
    """The points whose Euclidean distances bound the metric: unit vectors for cosine, the vectors themselves else."""
    if metric != "cosine":
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def least_distances(queries: np.ndarray, centers: np.ndarray, radii: np.ndarray, metric: str) -> np.ndarray:
    """No vector of a cell is nearer to a query than this: one row per query, one column per cell."""
    q = space(queries, metric)
    if metric == "ip":
        return -(q @ centers.T) - np.linalg.norm(q, axis=1)[:, None] * radii[None, :]
    gap = np.maximum(distances(q, centers, "l2") - radii[None, :], 0.0)
    return gap * gap / 2 if metric == "cosine" else gap


def _pair_distances(queries: np.ndarray, base: np.ndarray, row: np.ndarray, column: np.ndarray, metric: str,
                    norms: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The distances of single pairs in double precision, rounded. ``norms`` are those of the rows of both sides."""
    parts = []
    if metric == "cosine" and norms is None and len(row):
        norms = np.linalg.norm(queries, axis=1), np.linalg.norm(base, axis=1)
    for i in range(0, len(row), PAIRS):
        q, b = queries[row[i : i + PAIRS]], base[column[i : i + PAIRS]]
        if metric == "l2":
            gap = np.sqrt(((q - b) ** 2).sum(axis=1))
        else:
            product = np.einsum("ij,ij->i", q, b)
            size = norms[0][row[i : i + PAIRS]] * norms[1][column[i : i + PAIRS]] if metric == "cosine" else None
            gap = -product if size is None else 1.0 - np.divide(product, size, out=np.zeros_like(product), where=size > 0)
        parts.append(np.round(gap, 6) + 0.0)
    return np.concatenate(parts) if parts else np.zeros(0)


class _Scores:
    """Products in single precision that tell which pairs can be within a bound: no pair within it is missed.

    A pair's score grows as its distance falls; ``least(bounds)`` is the score that a pair within the bound has at least,
    ``bound(scores)`` the distance that a pair of the score has at most, both with the largest error of the products.
    """

    def __init__(self, queries: np.ndarray, base: np.ndarray, metric: str):
        q, b, self.metric = space(queries, metric), space(base, metric), metric
        finite = lambda x: x[np.isfinite(x)]
        most = max((float(np.abs(finite(x)).max(initial=0.0)) for x in (q, b)), default=0.0)
        kind = np.float32 if most < 1e15 else np.float64
        norm = np.linalg.norm(q, axis=1)
        top = float(finite(np.linalg.norm(b, axis=1)).max(initial=0.0))
        self.square = norm**2
        unit = 2.0 * (q.shape[1] + 4) * float(np.finfo(kind).eps)
        self.error = unit * (norm * top + (top**2 if metric == "l2" else 0.0)) + 1e-12
        self.above = None
        if metric != "l2" and q.shape[1] >= WIDE and len(b) and np.count_nonzero(b) <= SPARSE * b.size:
            self.above = self._folded(q, b, kind)
        if metric == "l2":  # the product less half the square of the base vector
            q = np.concatenate([q, np.ones((len(q), 1))], axis=1)
            b = np.concatenate([b, -(b**2).sum(axis=1, keepdims=True) / 2], axis=1)
        self.queries, self.base = q.astype(kind), b.astype(kind)
        self.lowest = np.finfo(kind).min

    def _folded(self, q: np.ndarray, b: np.ndarray, kind) -> _Scores:
        """Scores that are never below the products, from fewer numbers: of sparse vectors they are rarely above them.

        The components of most weight stay; the absolute values of the others are added up in groups of equal size.
        """
        order = np.argsort(-np.abs(b).sum(axis=0), kind="stable")
        kept, rest = order[: FOLDED // 2], order[FOLDED // 2 :]
        group = np.arange(len(rest)) % (FOLDED - len(kept))

        def fold(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), FOLDED), dtype=np.float64)
            out[:, : len(kept)] = x[:, kept]
            for g in range(FOLDED - len(kept)):
                out[:, len(kept) + g] = np.abs(x[:, rest[group == g]]).sum(axis=1)
            return out

        found = copy.copy(self)
        q, b = fold(q), fold(b)
        sizes = np.linalg.norm(b, axis=1)
        unit = 2.0 * (FOLDED + 4) * float(np.finfo(kind).eps)
        found.error = self.error + unit * np.linalg.norm(q, axis=1) * float(sizes[np.isfinite(sizes)].max(initial=0.0))
        found.queries, found.base, found.lowest = q.astype(kind), b.astype(kind), np.finfo(kind).min
        return found

    def part(self, rows: slice) -> _Scores:
        """Those of some queries."""
        found = copy.copy(self)
        found.queries, found.square, found.error = self.queries[rows], self.square[rows], self.error[rows]
        found.above = None if self.above is None else self.above.part(rows)
        return found

    def products(self, rows: np.ndarray, base: slice) -> np.ndarray:
        """The scores of some queries and base rows."""
        own = self.queries if len(rows) == len(self.queries) else self.queries[rows]
        return own @ self.base[base].T

    def least(self, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bounds = bounds + SLACK
        if self.metric == "cosine":
            found = 1.0 - bounds
        elif self.metric == "ip":
            found = -bounds
        else:
            found = (self.square[rows] - bounds**2) / 2
        found = np.maximum(found - self.error[rows], self.lowest)
        return np.nextafter(found.astype(self.queries.dtype), self.lowest)

    def bound(self, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        scores = scores.astype(np.float64) - self.error[rows]
        scores = np.where(np.isfinite(scores) & (scores > self.lowest), scores, -np.inf)
        if self.metric == "cosine":
            return 1.0 - scores
        return -scores if self.metric == "ip" else np.sqrt(np.maximum(self.square[rows] - 2 * scores, 0.0))


def _first_k(row: np.ndarray, column: np.ndarray, gap: np.ndarray, place: np.ndarray, k: int, n: int):
    """The k nearest of each row by distance and place, and each row's k-th distance (inf where it has fewer)."""
    order = np.lexsort((place[column], gap, row))
    row, column, gap = row[order], column[order], gap[order]
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    bound = np.full(n, np.inf)
    bound[row[nth == k - 1]] = gap[nth == k - 1]
    keep = nth < k
    return row[keep], column[keep], gap[keep], bound


def _groups(points: np.ndarray, base: pa.Table, prune: bool):
    """The base rows in order of their cells and leaves; for each group its start, cell, centre and radius."""
    names = [c for c in ("cell", GROUP) if c in base.column_names]
    marks = [base[c].to_numpy() for c in names]
    order = np.lexsort(marks[::-1])
    change = np.any([np.diff(m[order]) != 0 for m in marks], axis=0)
    starts = np.concatenate([[0], np.nonzero(change)[0] + 1, [len(order)]])
    centers, radii = np.zeros((len(starts) - 1, points.shape[1])), np.full(len(starts) - 1, np.inf)
    for g in range(len(starts) - 1) if prune else ():
        own = points[order[starts[g] : starts[g + 1]]]
        center = own.mean(axis=0)
        radius = np.linalg.norm(own - center, axis=1).max()
        if np.isfinite(radius):
            centers[g], radii[g] = center, radius
    return order, starts, marks[0][order[starts[:-1]]], centers, radii


def _meet(k: int, metric: str, id_col: str, vector: str, fields: list[str], before: str | None, choose=None, prune: bool = True):
    """The task function: a block of queries and a block of base rows in, each query's k best rows out.

    ``choose(matrix, queries)`` says which cells a query visits (all when None). In them it goes to the groups of rows that
    its bound, which falls as rows are found, does not rule out (to all groups unless ``prune``).
    """

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        names = ["query_id", "distance", id_col, *fields]
        kinds = [queries.schema.field("query_id").type, pa.float64(), *[base.schema.field(c).type for c in [id_col, *fields]]]
        parts = [pa.table([pa.array([], t) for t in kinds], names=names)]
        if queries.num_rows and base.num_rows:
            width = len(queries[vector][0])
            b = matrix(base[vector], width)
            order, starts, cells, centers, radii = _groups(space(b, metric) if prune else b, base, prune)
            place = np.empty(len(b), dtype=np.int64)
            place[pc.sort_indices(base[id_col], null_placement="at_start").to_numpy()] = np.arange(len(b))
            since = None if before is None else base[before].to_numpy()[order]
            every = matrix(queries[vector], width)
            scores = _Scores(every, b[order], metric)
            norms = (np.linalg.norm(every, axis=1), np.linalg.norm(b, axis=1)) if metric == "cosine" else None
            for start in range(0, queries.num_rows, QUERY_ROWS):
                asks, q = queries.slice(start, QUERY_ROWS), every[start : start + QUERY_ROWS]
                may = None if choose is None else choose(q, asks)[:, cells]
                own = None if norms is None else (norms[0][start : start + QUERY_ROWS], norms[1])
                row, column, gap = nearest(q, asks, b, scores.part(slice(start, start + QUERY_ROWS)),
                                           (order, starts, centers, radii), place, since, may, own)
                rows = base.select([id_col, *fields]).take(pa.array(column))
                parts.append(pa.table([asks["query_id"].take(pa.array(row)), pa.array(gap), *rows.columns], names=names))
        return pa.concat_tables(parts)

    def nearest(q, asks, b, scores, groups, place, since, may, norms):
        order, starts, centers, radii = groups
        until = None if before is None else asks[before].to_numpy()
        bound = asks["bound"].to_numpy().copy() if "bound" in asks.column_names else np.full(len(q), np.inf)
        given = bound.copy()
        floor = least_distances(q, centers, radii, metric) if prune else np.full((len(q), len(centers)), -np.inf)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        if may is not None:
            floor[~may] = np.nan
        held, waiting, n = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)), [], 0
        nearer = np.argsort(np.where(np.isnan(floor), np.inf, floor).sum(axis=0) if prune else np.arange(len(centers)), kind="stable")
        for g in nearer:
            for first in range(starts[g], starts[g + 1], QUERY_ROWS):
                last = min(first + QUERY_ROWS, starts[g + 1])
                rows = np.nonzero(floor[:, g] <= bound + SLACK)[0]
                if not len(rows):
                    break
                if scores.above is not None and np.isfinite(bound[rows]).all():
                    found = scores.above.products(rows, slice(first, last))
                    if since is not None:
                        found[~(since[None, first:last] < until[rows, None])] = -np.inf
                    hit = found >= scores.above.least(bound[rows], rows)[:, None]
                    some = hit.any(axis=1)
                    if not some.any():
                        continue
                    exact = np.count_nonzero(hit) > 2 * k * len(rows)
                    if exact:
                        rows = rows[some]
                else:
                    exact = True
                if exact:
                    found = scores.products(rows, slice(first, last))
                    if since is not None:
                        found[~(since[None, first:last] < until[rows, None])] = -np.inf
                    hit = found >= scores.least(bound[rows], rows)[:, None]
                if exact and last - first > k and np.count_nonzero(hit) > 2 * k * len(rows):  # the tile's own k-th is a bound as well
                    kth = np.partition(np.where(np.isnan(found), -np.inf, found), last - first - k, axis=1)[:, last - first - k]
                    bound[rows] = np.minimum(bound[rows], scores.bound(kth, rows) + SLACK)
                    hit = found >= scores.least(bound[rows], rows)[:, None]
                r, c = np.divmod(np.flatnonzero(hit), last - first)
                r, c = rows[r], order[first + c]
                gap = _pair_distances(q, b, r, c, metric, norms)
                fits = np.isfinite(gap) & (gap <= bound[r])
                waiting.append((r[fits], c[fits], gap[fits]))
                n += int(fits.sum())
                if n > max(k * len(q), 4 * QUERY_ROWS):
                    *held, kth = _first_k(*(np.concatenate(x) for x in zip(held, *waiting)), place, k, len(q))
                    bound, waiting, n = np.minimum(bound, kth), [], 0
        row, column, gap, _ = _first_k(*(np.concatenate(x) for x in zip(held, *waiting)), place, k, len(q))
        fits = gap <= given[row]
        return row[fits], column[fits], gap[fits]

    return run


def _meet_packed(k: int, id_col: str, vector: str, fields: list[str], choose, kinds: tuple[T.DataType, T.DataType], width: int):
    """The task function for the cosine of packed vectors, of ``kinds`` on either side: as :func:`_meet`."""

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        names = ["query_id", "distance", id_col, *fields]
        if not queries.num_rows or not base.num_rows:
            types = [queries.schema.field("query_id").type, pa.float64(), *[base.schema.field(c).type for c in [id_col, *fields]]]
            return pa.table([pa.array([], t) for t in types], names=names)
        q, b = (sparse.unpack(side[vector], kind, width) for side, kind in zip((queries, base), kinds))
        place = np.empty(len(b), dtype=np.int64)
        order = pc.sort_indices(base[id_col], null_placement="at_start").to_numpy()
        place[order] = np.arange(len(b))
        cells, group = np.unique(base["cell"].to_numpy(), return_inverse=True)
        may = np.empty((len(q), len(cells)), dtype=bool)
        for start in range(0, len(q), QUERY_ROWS):
            asks = queries.slice(start, QUERY_ROWS)
            may[start : start + QUERY_ROWS] = choose(q.dense(np.arange(start, start + len(asks))), asks)[:, cells]
        last = np.full(len(q), len(b))
        if "bound_id" in queries.column_names and pa.types.is_integer(base[id_col].type) and not base[id_col].null_count:
            known = queries["bound_id"].is_valid().to_numpy()
            until = queries["bound_id"].fill_null(0).to_numpy()
            last[known] = np.searchsorted(base[id_col].to_numpy()[order], until[known], side="right") - 1
        search = sparse.Search(q, b, place, k, queries["bound"].to_numpy(), last, None if may.all() else may, group)
        row, column, gap = search.run()
        rows = base.select([id_col, *fields]).take(pa.array(column))
        return pa.table([queries["query_id"].take(pa.array(row)), pa.array(gap), *rows.columns], names=names)

    return run


def _rank(candidates: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best per query over all tasks."""
    window = Window.partitionBy("query_id").orderBy("distance", id_col)
    return candidates.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def _along(centers: np.ndarray) -> np.ndarray:
    """The cells in an order along their widest direction, so that neighbours in it tend to be near each other."""
    if len(centers) < 3 or not np.isfinite(centers).all():
        return np.arange(len(centers))
    spread = centers - centers.mean(axis=0)
    return np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")


def _blocks(sizes: dict[int, int], order: Sequence[int], rows: int) -> list[tuple[int, int, int]]:
    """Cells in blocks of about ``rows`` rows: cell, number of its first block, and blocks that it is dealt over by a hash."""
    found, block, held = [], 0, 0
    for cell in (int(c) for c in order if sizes.get(int(c))):
        n = sizes[cell]
        if held and held + n > rows:
            block, held = block + 1, 0
        parts = math.ceil(n / rows)
        found.append((cell, block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return found


def _packed(df: DataFrame, vector: str) -> DataFrame:
    """The vectors as :func:`sparse.pack` has them, in the column's place."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield sparse.pack(batch)

    return df.withColumn(vector, pack(F.col(vector)))


def _dealt(queries: DataFrame, centers: np.ndarray, vector: str, metric: str, block_rows: int,
           packed: bool = False) -> DataFrame:
    """Add ``block`` to the queries, whose nearest centres are near each other in a block, and write them.

    ``packed`` packs their vectors.
    """
    shared = queries.sparkSession.sparkContext.broadcast(centers)

    @F.arrow_udf("int")
    def home(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            gap = least_distances(matrix(batch, shared.value.shape[1]), shared.value, np.zeros(len(shared.value)), metric)
            yield pa.array(gap.argmin(axis=1).astype(np.int32))

    placed = queries.withColumn("_home", home(F.col(vector)))
    placed = written(_packed(placed, vector) if packed else placed, "queries")
    sizes = placed.groupBy("_home").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length(vector) if packed else F.lit(0)).alias("bytes"))
    sizes = sizes.collect()  # a row for each cell
    counted = {r["_home"]: r["count"] for r in sizes}
    n = sum(counted.values())
    if packed:
        entries = sum(r["bytes"] for r in sizes) / sparse.entry(queries.schema[vector].dataType.elementType).itemsize
        rows = _packed_rows(block_rows, n, entries)
    else:
        rows = _rows(block_rows, n, centers.shape[1])
    plan = _blocks(counted, _along(centers), rows)
    if not plan:
        return placed.withColumn("block", F.lit(0).cast("long")).drop("_home")
    plan = F.broadcast(queries.sparkSession.createDataFrame(plan, "_home int, _first int, _parts int"))
    block = F.col("_first") + F.pmod(F.xxhash64("query_id"), F.col("_parts").cast("long"))
    return placed.join(plan, "_home").withColumn("block", block).drop("_home", "_first", "_parts")


def _visits(queries: DataFrame, vector: str, choose, read=matrix) -> DataFrame:
    """One row per block of queries and cell that ``choose(matrix, batch)`` (a boolean matrix) visits for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                row, cell = np.nonzero(choose(read(part.column(vector)), part))
                found = np.unique(np.stack([part.column("block").to_numpy()[row], cell], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32))],
                                                 names=["block", "cell"])

    return written(queries.mapInArrow(run, "block long, cell int").distinct(), "visits")


def _search(visits: DataFrame, queries: DataFrame, base: DataFrame | Callable[[list[int]], DataFrame], sizes: dict[int, int],
            task, schema: T.StructType, id_col: str, rows: int, order: Sequence[int],
            own: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Blocks of queries meet the base rows of the cells they visit, in blocks of about ``rows`` rows.

    A query is sent once to each block of base rows, a row once to each block of queries. Collects the cells visited.
    ``base`` may be a function that reads the rows of the cells it is given. ``own`` may leave of the queries, which have the
    cells of the block that they are sent to as ``_cells``, what that block needs.
    """
    asked = {r["cell"] for r in visits.select("cell").distinct().collect()}
    spark = visits.sparkSession
    plan = _blocks({c: sizes.get(c, 0) for c in asked}, order, rows)
    if not plan:
        return spark.createDataFrame([], schema)
    base = base if isinstance(base, DataFrame) else base(sorted(c for c, _, _ in plan))
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, _first int, _parts int"))  # a row per cell
    pairs = visits.join(plan, "cell")
    numbers = F.sequence("_first", F.col("_first") + F.col("_parts") - 1).cast("array<int>")
    met = pairs.select("block", "cell", F.explode(numbers).alias("_b"))
    meets = met.groupBy("block", "_b").agg(F.collect_set("cell").alias("_cells"))
    tasks = max(1, min(MOST_TASKS, meets.count()))  # by their number: by their bytes, long tasks would be put together
    # Both sides may be one table: fresh names keep their columns apart.
    queries, base = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, base))
    left = queries.join(meets, "block") if own else queries.join(meets.drop("_cells"), "block")
    left = own(left).drop("_cells") if own else left
    right = base.join(pairs, "cell").withColumn(
        "_b", (F.col("_first") + F.pmod(F.xxhash64(id_col), F.col("_parts").cast("long"))).cast("int")).drop("_first", "_parts")
    left, right = (df.repartition(tasks, "block", "_b") for df in (left, right))
    return left.groupBy("block", "_b").cogroup(right.groupBy("block", "_b")).applyInArrow(task, schema)


def knn(
    base: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "cosine",
    where: str | Column | Sequence[dict] | None = None,
    fields: Sequence[str] | None = None,
    id_col: str = "id",
    vector: str = "embedding",
    before: str | None = None,
    cell: str | None = None,
    centroids: np.ndarray | None = None,
    probes: int | None = None,
    cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
    tree: bool | None = None,
) -> DataFrame:
    """V1: for each query (``query_id``, ``embedding``) the ``k`` nearest base rows.

    Returns query_id, rank, distance, the id and ``fields`` (all other columns when None, V3). ``where``
    restricts the base first (V2): an expression such as ``label == "DoS"``, or request filters. ``before``
    names a column both sides have; only base rows with a smaller value qualify (V7: past events).
    ``cell``, ``centroids`` and ``probes`` visit only the nearest cells per query (V6).

    An exact search places the base in ``cells`` cells itself (by its size when None). Counts, radii and centres
    of the cells go through the driver, at most MOST_CELLS of them; rows of either side never do. A base that needs more
    cells than that (or ``tree``) becomes a tree of cells and leaves instead, whose leaves grow with it, except for the
    inner product.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is not one of {METRICS}")
    k = max(1, k)
    if isinstance(where, (str, Column)):
        base = base.filter(where)
    elif where:
        base = apply_filters(base, list(where))
    if fields is None:
        fields = [c for c in base.columns if c not in (id_col, vector)]
    carried = [f for f in fields if f != id_col]
    needed = list(dict.fromkeys([id_col, vector, *carried, *([before] if before else [])]))
    base, queries = base.filter(F.col(vector).isNotNull()), queries.filter(F.col(vector).isNotNull())
    if before:  # a row or query without the value comes before nothing, and nothing before it
        base, queries = base.filter(F.col(before).isNotNull()), queries.filter(F.col(before).isNotNull())
    queries = queries.select("query_id", vector, *([before] if before else []))
    queries = queries.withColumn("bound", F.lit(float("inf")))
    types = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType(
        [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("distance", T.DoubleType())]
        + [T.StructField(c, types[c]) for c in [id_col, *carried]]
    )
    spark = base.sparkSession
    shown = ["query_id", "rank", "distance", id_col, *carried]

    if probes is not None:
        placed = base.select(*needed, F.col(cell).alias("cell")) if cell != "cell" or "cell" not in needed else base
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
        shared = spark.sparkContext.broadcast(centroids)

        def nearest(rows: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
            order = np.argsort(distances(rows, shared.value, metric), axis=1, kind="stable")[:, :probes]
            chosen = np.zeros((len(rows), len(shared.value)), dtype=bool)
            np.put_along_axis(chosen, order, True, axis=1)
            return chosen

        task = _meet(k, metric, id_col, vector, carried, before, nearest, prune=False)
        queries = _dealt(queries, centroids, vector, metric, block_rows)
        found = _search(_visits(queries, vector, nearest), queries, placed, sizes, task, schema, id_col,
                        _rows(block_rows, sum(sizes.values()), centroids.shape[1]), _along(centroids))
        return _rank(found, k, id_col).select(*shown)

    base = base.select(*needed)
    n = base.count()
    if metric != "ip" and n and (n > CELL_ROWS * MOST_CELLS if tree is None else tree):
        from flowlens.operators.vector_index import build_index, exact_search

        index = build_index(base, scratch_path(spark, "tree"), id_col, vector, metric)
        return exact_search(index, queries.drop("bound"), k, carried, before)
    cells = max(1, min(MOST_CELLS, cells or math.ceil(n / CELL_ROWS)))
    if not n:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0)).select(*shown)
    if cells == 1:
        centers = np.zeros((1, len(base.first()[vector])))
        known = Cells(centers, np.array([n]), np.array([np.inf]))
        return search_cells(queries, base.withColumn("cell", F.lit(0)), known, k, metric, id_col, vector, carried, schema,
                            before, block_rows).select(*shown)

    centers = _centers(base, cells, vector, metric, id_col)
    placed = written(_placed(base, centers, vector, metric), "cells")
    stats = [F.count(F.lit(1)).alias("n"), F.max("_radius").alias("r"), *([F.min(before).alias("least")] if before else [])]
    known = Cells.of(centers, placed.groupBy("cell").agg(*stats).toArrow())
    found = search_cells(queries, placed.drop("_radius"), known, k, metric, id_col, vector, carried, schema, before, block_rows)
    return found.select(*shown)


@dataclass(frozen=True)
class Cells:
    """Centres of cells, the rows and radius of each, and the least value of a column that searches compare."""

    centers: np.ndarray
    held: np.ndarray
    radii: np.ndarray
    least: np.ndarray | None = None

    @classmethod
    def of(cls, centers: np.ndarray, stats: pa.Table) -> Cells:
        """From a table of cell, n, r and perhaps least."""
        held, radii, cell = np.zeros(len(centers), dtype=np.int64), np.zeros(len(centers)), stats["cell"].to_numpy()
        held[cell], radii[cell] = stats["n"].to_numpy(), stats["r"].to_numpy()
        radii[np.isnan(radii)] = np.inf  # a vector without a place rules nothing out
        least = None
        if "least" in stats.column_names and len(cell):
            values = stats["least"].to_numpy()
            least = np.full(len(centers), values[0], dtype=values.dtype)
            least[cell] = values
        return cls(centers, held, radii, least)

    @property
    def sizes(self) -> dict[int, int]:
        return {c: int(n) for c, n in enumerate(self.held) if n}


def search_cells(queries: DataFrame, base: DataFrame | Callable[[list[int]], DataFrame], cells: Cells, k: int, metric: str,
                 id_col: str, vector: str, carried: Sequence[str], schema: T.StructType, before: str | None = None,
                 block_rows: int = BLOCK_ROWS, nonzero: float | None = None) -> DataFrame:
    """The exact search over rows placed in cells: query_id, distance, the id, ``carried`` columns, and rank.

    ``queries``: query_id, the vector, ``bound`` and perhaps ``before``. ``base`` has a column cell, or reads cells.
    ``nonzero`` is how many components of a base vector are not zero, on average, where that is known: if few are, vectors
    are packed and compared by them.
    """
    width = cells.centers.shape[1]
    packed = nonzero is not None and metric == "cosine" and before is None and width >= WIDE and nonzero <= SPARSE * width
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def open_cells(known: Cells, batch: pa.RecordBatch) -> np.ndarray:
        """Cells that hold rows, and with ``before`` rows that come before the query."""
        some = np.repeat((known.held > 0)[None, :], len(batch), axis=0)
        if known.least is not None:
            some &= known.least[None, :] < batch.column(before).to_numpy(zero_copy_only=False)[:, None]
        return some

    def first(rows: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        """The nearest cells that hold k vectors together."""
        known = shared.value
        order = np.argsort(least_distances(rows, known.centers, np.zeros_like(known.radii), metric), axis=1, kind="stable")
        some = open_cells(known, batch)
        held = np.take_along_axis(np.where(some, known.held[None, :], 0), order, axis=1)
        chosen = np.zeros((len(rows), len(known.centers)), dtype=bool)
        np.put_along_axis(chosen, order, np.cumsum(held, axis=1) - held < k, axis=1)
        return chosen & some

    def rest(rows: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        known = shared.value
        bound = batch.column("bound").to_numpy()
        near = least_distances(rows, known.centers, known.radii, metric) <= bound[:, None] + SLACK
        return near & open_cells(known, batch) & ~first(rows, batch)

    n = int(cells.held.sum())
    base_rows = _packed_rows(block_rows, n, nonzero * n) if packed else _rows(block_rows, n, width)
    kind = queries.schema[vector].dataType.elementType
    read, rows = matrix, base
    if packed:
        read = lambda column: (lambda found: found.dense(np.arange(len(found))))(sparse.unpack(column, kind, width))
        rows = lambda some: _packed(base(some) if callable(base) else base, vector)

    def search(asks: DataFrame, choose) -> DataFrame:
        if packed:
            base_kind = (base([]) if callable(base) else base).schema[vector].dataType.elementType
            task = _meet_packed(k, id_col, vector, list(carried), choose, (kind, base_kind), width)
        else:
            task = _meet(k, metric, id_col, vector, list(carried), before, choose)
        return _search(_visits(asks, vector, choose, read), asks, rows, cells.sizes, task, schema, id_col, base_rows,
                       _along(cells.centers))

    queries = written(_dealt(queries, cells.centers, vector, metric, block_rows, packed), "queries")
    start = written(_rank(search(queries, first), k, id_col), "knn").drop("rank")
    if len(cells.sizes) < 2:
        return _rank(start, k, id_col)
    known = start.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("distance", F.col(id_col).alias("id"))).alias("_last"))
    last = F.when(F.col("_n") >= k, F.col("_last"))
    bounded = queries.drop("bound").join(known, "query_id", "left").withColumns(
        {"bound": F.coalesce(last["distance"], F.lit(float("inf"))), "bound_id": last["id"]})
    bounded = bounded.select(*queries.columns, *(["bound_id"] if packed else []))
    return _rank(start.unionByName(search(written(bounded, "bounded"), rest)), k, id_col)


def _packed_rows(block_rows: int, n: int, entries: float) -> int:
    """Rows of a block of ``n`` packed vectors of so many entries together."""
    most = min(PACKED_ROWS * block_rows, int(VALUES / 2 * n / max(1.0, entries)))
    return max(1, min(max(block_rows // 4, math.ceil(n / QUERY_BLOCKS)), most))


def _rows(block_rows: int, n: int, width: int) -> int:
    """Rows of a block of ``n`` vectors."""
    return max(1, min(max(block_rows // 4, math.ceil(n / QUERY_BLOCKS)), 20 * block_rows, VALUES // max(1, width)))


def hits(found: DataFrame, id_col: str = "id") -> DataFrame:
    """V4: one ``hit`` per row: id, distance and the remaining fields."""
    rest = [c for c in found.columns if c not in ("query_id", "rank", "distance", id_col)]
    fields = F.struct(*rest) if rest else F.lit(None).cast("string")
    return found.select(
        "query_id", "rank", F.struct(F.col(id_col).alias("id"), "distance", fields.alias("fields")).alias("hit")
    )


# --------------------------------------------------------------------------- approximate search


def _centers(base: DataFrame, cells: int, vector: str, metric: str, id_col: str, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` clusters of at most SAMPLE vectors, the first by a hash of the id."""
    picked = base.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select(vector).toArrow()
    points = space(matrix(picked[vector]), metric)
    centers = points[np.random.default_rng(7).choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([distances(points[i : i + 2048], centers, "l2").argmin(axis=1)
                               for i in range(0, len(points), 2048)])
        sums, count = np.zeros_like(centers), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, points)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _placed(base: DataFrame, centers: np.ndarray, vector: str, metric: str) -> DataFrame:
    """Add ``cell``, the nearest centre, and ``_radius``, the distance from it."""
    shared = base.sparkSession.sparkContext.broadcast(centers)

    @F.arrow_udf("struct<cell: int, r: double>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centers = shared.value
        for batch in batches:
            points = space(matrix(batch, centers.shape[1]), metric)
            cell = distances(points, centers, "l2").argmin(axis=1)
            radius = np.linalg.norm(points - centers[cell], axis=1)
            yield pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(radius)], names=["cell", "r"])

    found = base.withColumn("_at", nearest(F.col(vector)))
    return found.select(*base.columns, "_at.cell", F.col("_at.r").alias("_radius"))


def fit_cells(base: DataFrame, cells: int, vector: str = "embedding", seed: int = 7) -> np.ndarray:
    """V6: centroids of ``cells`` clusters of the base vectors. Runs the clustering."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = base.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(points)
    return np.array(model.clusterCenters())


def with_cells(base: DataFrame, centroids: np.ndarray, vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """V6: add ``cell``, the nearest centroid; store the table partitioned by it to prune scans."""
    shared = base.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centers = shared.value
        for batch in batches:
            found = distances(matrix(batch, centers.shape[1]), centers, metric)
            yield pa.array(found.argmin(axis=1).astype(np.int32))

    return base.withColumn("cell", nearest(F.col(vector)))


def approximate_knn(
    base: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, k: int = DEFAULT_K, **options
) -> DataFrame:
    """V6: :func:`knn` over the ``probes`` cells nearest to each query; all cells give the exact result."""
    return knn(base, queries, k, cell="cell", centroids=centroids, probes=probes, **options)
