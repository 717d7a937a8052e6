"""Joining a table to one row per key when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import written

HOT_KEYS = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join to ``right``, which has one row per key.

    The ``hot_keys`` most frequent keys of ``left`` are joined in place, to a broadcast of at most that many
    rows; what is left holds at most 1/``hot_keys`` of the rows per key and is joined by a shuffle. ``left``
    is computed and written once (a job), as it is read for the key counts and for either part.
    """
    left = written(left, "left")
    most = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(hot_keys)
    hot = F.broadcast(most.select(key))
    in_place = left.join(F.broadcast(right.join(hot, key, "left_semi")), key)
    shuffled = left.join(hot, key, "left_anti").join(right, key)
    return in_place.unionByName(shuffled)
