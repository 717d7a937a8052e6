"""Connected components over links, and the joining of links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import written


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each node's smallest known companion, fully resolved) after linking the nodes i and j pairwise."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def components(edges: DataFrame) -> DataFrame:
    """For links ``a``, ``b`` (long): each linked node as ``node`` with the smallest node it reaches as ``root``.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones, on the smallest it knows, until
    each component is a star. Each round is written to the shared folder, so lineage stays short; a node with very many
    links is a key of plain aggregations and joins, which pre-aggregate and split it.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    stars = written(oriented(edges.select("a", "b")), "links")
    seen = mark(stars)
    while seen[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = oriented(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
        stars = written(oriented(small), "links")
        now = mark(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
