"""Named views and the list of those that requests may read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowlens.plans.request import Filter, RequestError
from flowlens.sources.storage import read_table

DEFAULT_ROW_CAP = 1000


@dataclass(frozen=True)
class StoredTable:
    """A table of :mod:`flowlens.sources.storage`; filters on its time column choose the months to read."""

    spark: SparkSession
    path: str
    schema: T.StructType
    ts: str

    def months(self) -> DataFrame:
        """All rows with the month they are stored under, for callers that choose the months themselves."""
        return read_table(self.spark, self.path, self.schema, self.ts, with_month=True)

    def read(self, filters: Sequence[Filter] = ()) -> DataFrame:
        lows = [_time(f) for f in filters if f.field == self.ts and f.op in ("gt", "gte", "eq")]
        highs = [_time(f) for f in filters if f.field == self.ts and f.op in ("lt", "lte", "eq")]
        # The filters themselves are applied later; the reader's own bounds only have to be as wide.
        margin = dt.timedelta(seconds=1)
        low = max((t - margin for t in lows if t), default=None)
        high = min((t + margin for t in highs if t), default=None)
        return read_table(self.spark, self.path, self.schema, self.ts, low, high)


def _time(f: Filter) -> dt.datetime | None:
    """A filter's ISO-8601 time in UTC, or None when it is something else."""
    try:
        at = dt.datetime.fromisoformat(f.value)
    except (TypeError, ValueError):
        return None
    return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at


class Catalog:
    """Views by collection name; a view may be a DataFrame, a function that returns one, or a stored table.

    ``allowed`` lists the readable collections; ``None`` denies all, as a missing list does. ``row_cap``
    bounds the rows of a request; ``None`` lifts the bound for jobs that write their result.
    """

    def __init__(
        self,
        views: Mapping[str, DataFrame | StoredTable | Callable[[], DataFrame]],
        allowed: Iterable[str] | None,
        row_cap: int | None = DEFAULT_ROW_CAP,
    ):
        self._views = dict(views)
        self._allowed = frozenset(allowed or ())
        self.row_cap = row_cap

    def collections(self) -> list[str]:
        return sorted(self._allowed)

    def refresh(self, load: Callable[[], Iterable[str] | None]) -> bool:
        """Replace the list by what ``load`` returns; if it raises, the old list stays."""
        try:
            fresh = load()
        except Exception:  # any failed refresh keeps the old list
            return False
        self._allowed = frozenset(fresh or ())
        return True

    def check(self, names: Iterable[str]) -> None:
        for name in names:
            if name not in self._allowed:
                raise RequestError(f"collection {name!r} is not allowed; allowed: {self.collections()}")

    def view(self, name: str, filters: Sequence[Filter] = ()) -> DataFrame:
        """The rows of a collection; ``filters`` may spare a stored table some months but are not applied."""
        if name not in self._views:
            raise RequestError(f"collection {name!r} has no view")
        found = self._views[name]
        if isinstance(found, StoredTable):
            return found.read(filters)
        return found() if callable(found) else found
