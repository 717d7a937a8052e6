"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products inside them.

Centroids come from a bounded sample; every vector is in the cell of its nearest centroid. A vector also visits each
other cell that could hold a partner: for unit vectors x (nearest to c) and y within the angle t of x,
``y.(c - d) >= -sin(t) * |c - d|`` for every centroid d, so y visits the cells that pass this against its own centroid.
Vectors of a cell meet all visitors of the cell with the same label, in blocks of bounded size; links are counted where
they are found and leave a task as sums and forests, never as pairs. No link is lost, whatever the centroids are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.links import components, join_labels
from flowlens.session import written

THRESHOLD = 0.98
#: Vectors that up to 1024 centroids are fitted on, and for each centroid where there are more.
SAMPLE, CELL_SAMPLE = 20_000, 4
#: Centroids at most, and their bytes: they travel through the driver, and to every executor.
MOST_CELLS, CENTER_BYTES = 65_536, 64_000_000
#: Rows times centroids that a task measures at a time.
PRODUCTS = 4_000_000
#: Distinct vectors of a cell, about, and of a block that one task multiplies.
CELL_ROWS, BLOCK = 2_000, 2_048


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length 1 in double precision; None where nothing can link with it."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    x = x / max(np.abs(x).max(), np.finfo(np.float64).tiny)
    norm = np.linalg.norm(x)
    return x / norm if norm > 0 else None


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows: nearest by cosine, moved to the direction of the mean."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centers.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centers)
        if np.allclose(moved, centers, atol=1e-9):
            break
        centers = moved
    return centers


def cell_centers(x: np.ndarray, k: int, most: int = 1024) -> np.ndarray:
    """About ``k`` unit centroids; more than ``most`` are fitted in two levels, each part of the first by itself."""
    if k <= most:
        return spherical_kmeans(x, k)
    tops = spherical_kmeans(x, math.ceil(math.sqrt(k)))
    near = np.concatenate([(x[i : i + 4096] @ tops.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    parts = [x[near == j] for j in range(len(tops))]
    return np.concatenate([spherical_kmeans(p, max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])


def visited(x: np.ndarray, centers: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each row, and which cells each row visits (its own included)."""
    dots = x @ centers.T
    home = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centers[home] @ centers.T)))
    reach = math.sqrt(max(0.0, 1.0 - threshold * threshold))
    own = dots[np.arange(len(x)), home]
    visits = dots - own[:, None] >= -reach * gap - 1e-9
    visits[np.arange(len(x)), home] = True
    return home, visits


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label").is_valid().to_pylist()
        units = [unit(v) if ok else None for v, ok in zip(batch.column("vector").to_pylist(), labels)]
        packed = [None if u is None else u.tobytes() for u in units]
        key = [None if p is None else hashlib.blake2b(p, digest_size=16).digest() for p in packed]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(key, pa.binary()), pa.array(packed, pa.binary())],
            names=["vec_id", "label", "key", "unit"])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """For each row of ``vectors``: ``id_col``, n_links, component_id, kept (its id is the smallest of its component).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is ``threshold`` or
    more. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors
    of different lengths never link. Vectors of equal direction are one class that is compared once and counted by its
    rows, so copies are cheap. A null id stays null, names no component and is not kept unless nothing is smaller;
    repeated rows each count as a vector. Other columns play no part; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                            F.col(f"`{vector}`").alias("vector"))
    schema = chosen.select("vec_id", "label", F.lit(b"").alias("key"), F.lit(b"").alias("unit")).schema
    for field in schema.fields:
        field.nullable = True
    rows = written(chosen.mapInArrow(_prepare, schema), "units")
    classes = rows.filter(F.col("key").isNotNull()).groupBy("label", "key").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n_classes = classes.count()
    widths = classes.groupBy(F.length("unit").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] // 8 if widths else 0
    most = max(1, min(MOST_CELLS, CENTER_BYTES // (8 * max(width, 1))))
    k = max(1, min(most, cells or math.ceil(n_classes / CELL_ROWS)))
    sample = max(sample, CELL_SAMPLE * k if k > 1024 else 0)
    picked = classes.filter(F.length("unit") == width * 8).orderBy("key", "label").limit(sample).select("unit").toArrow()
    centers = cell_centers(_matrix(picked["unit"], width), k) if picked.num_rows else np.zeros((1, max(width, 1)))
    shared = spark.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            usual = [len(u) == known.shape[1] * 8 for u in batch.column("unit").to_pylist()]
            home = np.full(len(batch), -1)
            lists = [[-1]] * len(batch)  # other lengths have a cell of their own for each length
            at = np.flatnonzero(usual)
            step = max(1, PRODUCTS // len(known))
            for begin in range(0, len(at), step):
                some = at[begin : begin + step]
                home[some], visits = visited(_matrix(batch.column("unit").take(pa.array(some)), known.shape[1]), known, threshold)
                for r, v in zip(some, visits):
                    lists[r] = np.flatnonzero(v).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("label"), pa.array(home.astype(np.int32)),
                 pa.array(lists, pa.list_(pa.int32())), batch.column("n"), batch.column("unit")],
                names=["cid", "label", "home", "cells", "n", "unit"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("cid", "label", "n", "unit").mapInArrow(
        place, f"cid long, label {kind}, home int, cells array<int>, n long, unit binary")
    placed = written(placed.withColumn("width", F.length("unit")), "placed")
    spot = ["label", "width", "cell"]
    present = placed.withColumn("cell", F.explode("cells")).withColumn("is_home", F.col("cell") == F.col("home"))
    sizes = present.select(*spot, "is_home").groupBy(*spot).agg(
        F.count(F.lit(1)).alias("all_n"), F.sum(F.col("is_home").cast("long")).alias("home_n")).filter("home_n > 0")
    sizes = sizes.select(*spot, F.ceil(F.col("home_n") / F.lit(block)).cast("int").alias("homes"),
                         F.ceil(F.col("all_n") / F.lit(block)).cast("int").alias("alls"))
    present = present.join(sizes, spot)
    # Each block of a cell's own vectors meets each block of its visitors: two kinds of rows, dealt to block pairs.
    own = F.pmod(F.xxhash64("cid"), F.col("homes")).cast("int")
    seen = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("alls")).cast("int")
    columns = [*spot, "i", "j", "side", "cid", "n", "unit"]
    homes = present.filter("is_home").withColumn("side", F.lit(0)).withColumn("i", own).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("alls") - 1))).select(*columns)
    others = present.withColumn("side", F.lit(1)).withColumn("j", seen).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("homes") - 1))).select(*columns)

    def meet(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        size = table["width"][0].as_py() // 8
        cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
        x = _matrix(table["unit"], size)
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids, node = np.unique(cid, return_inverse=True)
        label_of, total = np.arange(len(ids)), np.zeros(len(mine), dtype=np.int64)
        for start in range(0, len(mine), 512):
            part = mine[start : start + 512]
            hit = (x[part] @ x[theirs].T >= threshold) | (cid[part][:, None] == cid[theirs][None, :])
            total[start : start + 512] = hit @ n[theirs]
            a, b = np.nonzero(hit)
            label_of = join_labels(label_of, node[part][a], node[theirs][b])
        linked = np.flatnonzero(label_of != np.arange(len(ids)))
        none = np.full(len(linked), 0)
        return pa.table({"cid": np.concatenate([cid[mine], ids[linked]]), "seen": np.concatenate([total, none]),
                         "root": pa.concat_arrays([pa.nulls(len(mine), pa.int64()), pa.array(ids[label_of[linked]])])})

    met = homes.unionByName(others).groupBy(*spot, "i", "j").applyInArrow(meet, "cid long, seen long, root long")
    met = written(met, "met")
    counts = met.groupBy("cid").agg(F.sum("seen").alias("seen"))
    roots = components(met.filter("root IS NOT NULL").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.select("cid", "label", "key", "first_id").join(counts, "cid").join(
        roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = known.join(smallest, "root").select(F.col("label").alias("l"), F.col("key").alias("k"), "seen", "component_id")
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")), "left")
    component = F.when(F.col("seen").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.select(F.col("vec_id").alias(id_col), F.coalesce(F.col("seen") - 1, F.lit(0)).cast("long").alias("n_links"),
                      "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
