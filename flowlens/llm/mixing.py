"""Mixing sources to target weights by balanced (cube) sampling.

Each source gets a target number of words. A document is taken a whole number of times, the same for its source, plus
at most once more; the chance of that is the same for all documents of the source. Which of them are taken is decided
by the cube method: fractional chances move along directions that leave the source's expected words and documents as
they are, until a chance reaches 0 or 1. Documents are dealt into chunks of bounded size, each chunk leaves at most two
fractional ones, those of many chunks form the next level's chunks, and the last two of a source are landed on the side
that misses the totals least. So no task sees more than a chunk, however large a source is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import WORD
from flowlens.session import written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Documents of one chunk, about.
CHUNK = 4096
#: Chances this close to 0 or 1 have arrived.
EPS = 1e-9


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"({WORD})")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size, rank and target.

    The sources, by code point with null last, have the weights in turn and share ``share`` times all words. No target
    exceeds ``most`` times its source; the excess goes to the others by weight until none is above. That is one level
    ``x`` with ``sum(min(most * size, weight * x))`` equal to what is shared: going up in order of ``size / weight``,
    the first sources are full and the others have ``weight * x``. One task orders the sources, never the documents.
    """
    if share > most:
        raise ValueError("the sources can't share more than they may hold")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    per = per.withColumn("rank", turn).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    room = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    full = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(room).over(full), F.lit(0.0))
             ) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    # A source is full if the level that its turn sees would fill it; from the first that is not, the level holds.
    per = per.withColumn("open", F.col("weight") * F.col("level") < room)
    final = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level")))
                  ).over(everything)["level"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.least(room, F.coalesce(F.col("weight") * final, room)))
    return per.select("source", "source_size", "source_docs", "rank", target.alias("target"))


def flight(size: np.ndarray, chance: np.ndarray, order: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move the chances of one chunk until at most two are fractional; their sum and that of size*chance stay.

    Three fractional units at a time: the direction that changes neither total is the cross product of the two
    constraint rows. It is followed to the nearer or the farther wall, with odds that keep every expectation.
    """
    p = chance.astype(np.float64).tolist()
    x = size.astype(np.float64).tolist()
    held: list[int] = []
    for turn, k in enumerate(order.tolist()):
        if not EPS < p[k] < 1 - EPS:
            continue
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u[0] == 0 and u[1] == 0:  # equal sizes: chances move between any two of them
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(held, u) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(held, u) if v)
        step = up if draw[turn] * (up + down) < down else -down
        for i, v in zip(held, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        stay = [i for i in held if EPS < p[i] < 1 - EPS]
        if len(stay) == 3:  # rounding kept all three inside: the nearest has arrived
            near = min(held, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = round(p[near])
            stay.remove(near)
        held = stay
    return np.where(np.array(p) < EPS, 0.0, np.where(np.array(p) > 1 - EPS, 1.0, np.array(p)))


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Decide the last fractional units, two at most, by the least miss in words, then in documents."""
    p = chance.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        sides = [[(i >> k) & 1 for k in range(len(left))] for i in range(1 << len(left))]
        miss = [(abs(float(((s - p[left]) * size[left]).sum())), abs(float((s - p[left]).sum())), s)
                for s in map(np.array, sides)]
        p[left] = min(miss, key=lambda m: m[:2])[2]
    return p


_STATE = "row long, rank int, size long, chance double, chunk long, salt long"


def _fly(last: bool):
    def run(table: pa.Table) -> pa.Table:
        salt = table["salt"].to_numpy()
        size, chance = table["size"].to_numpy(), table["chance"].to_numpy()
        order = np.lexsort((chance, size, salt))
        # The draws depend on the documents alone, so a rerun takes the same ones.
        mixed = salt[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        draw = (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        found = flight(size, chance, order, draw)
        if last:
            found = land(size, found)
        at = table.schema.get_field_index("chance")
        return table.set_column(at, "chance", pa.array(found))

    return run


def balanced(state: DataFrame, docs_most: int, chunk: int = CHUNK) -> DataFrame:
    """Chances of ``state`` (row, rank, size, chance, chunk, salt) moved to 0 or 1, level by level."""
    decided: DataFrame | None = None
    chunks = max(1, math.ceil(docs_most / chunk))
    while True:
        last = chunks == 1
        moved = written(state.groupBy("rank", "chunk").applyInArrow(_fly(last), _STATE), "cube")
        done = moved.filter((F.col("chance") == 0) | (F.col("chance") == 1))
        decided = done if decided is None else decided.unionByName(done)
        if last:
            return decided
        # Two documents at most come from each chunk: half a chunk's worth of them meets in one.
        join = max(2, chunk // 2)
        chunks = math.ceil(chunks / join)
        state = moved.filter((F.col("chance") > 0) & (F.col("chance") < 1)).withColumn(
            "chunk", F.floor(F.col("chunk") / join).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text: str = "text", source: str = "source", chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``id_col``, size, source, source_size, target, copies, taken (``copies * size``).

    A null text has size 0, a null source is a source of its own, a null id is an id like any other. Repeated rows are
    documents by themselves. Documents without words are taken as often as others of their source; a source without
    words has target 0 and is not taken. Other columns play no part. An empty table gives an empty result.
    """
    sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                        word_count(F.col(f"`{text}`")).alias("size"),
                        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("salt"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    targets = written(source_targets(sized, weights, share, most), "targets")
    docs_most = targets.agg(F.max("source_docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rated = rated.withColumn("rate", F.least(rate, F.lit(float(most)))).withColumn(
        "times", F.floor(F.col("rate") + EPS).cast("int"))
    rated = rated.withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - F.col("times")))
    rated = rated.withColumn("chance", F.when(F.col("chance") < EPS, F.lit(0.0)).otherwise(F.col("chance")))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / F.lit(chunk)))
    state = rated.filter(F.col("chance") > 0).select(
        "row", F.col("rank").cast("int").alias("rank"), "size", "chance",
        F.pmod(F.xxhash64("salt", F.lit(1)), chunks).cast("long").alias("chunk"), "salt")
    more = balanced(state, docs_most, chunk).filter(F.col("chance") == 1).select("row", F.lit(1).alias("more"))
    out = rated.join(more, "row", "left")
    copies = F.col("times") + F.coalesce(F.col("more"), F.lit(0))
    return out.select(F.col("doc_id").alias(id_col), "size", F.col("source").alias(source), "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
