"""Nearest neighbours among vectors of few components that are not zero.

A vector is packed as its places and values, so that a block holds many more rows and little is sent. In a task a query goes
to the rows that have its rarest place, then to those that have its next one, until what is left of it is too short to be
within its bound: by Cauchy and Schwarz no row without one of the places seen can be. The rows of a place and the queries that
go to it meet in tiles of products in single precision; the pairs that these leave in doubt are computed in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: Rows of either side multiplied at a time, and pairs whose distances are computed at a time.
TILE_QUERIES, TILE_ROWS, PAIRS = 2_048, 4_096, 65_536
#: Columns of products: the weightiest places have their own, the others share the rest.
OWN, SHARED = 128, 64
#: Groups of base rows by how their weight is spread.
KINDS = 3
SLACK = 2e-6


def entry(kind: pa.DataType | T.DataType) -> np.dtype:
    """A component of a packed vector whose numbers are of ``kind``."""
    single = isinstance(kind, T.FloatType) if isinstance(kind, T.DataType) else pa.types.is_float32(kind)
    return np.dtype([("place", "<i4"), ("value", "<f4" if single else "<f8")])


@dataclass(frozen=True)
class Rows:
    """Vectors by rows: the places of row i and its values lie between ``start[i]`` and ``start[i + 1]``."""

    start: np.ndarray
    place: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.start) - 1

    def row_of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.start))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows: the number in ``rows`` and the entry, for every entry."""
        first, counts = self.start[rows], self.start[rows + 1] - self.start[rows]
        row = np.repeat(np.arange(len(rows)), counts)
        return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(counts) - counts), counts)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        row, entry = self.entries(rows)
        out = np.zeros((len(rows), self.width))
        out[row, self.place[entry]] = self.value[entry]
        return out


def pack(vectors: pa.Array) -> pa.Array:
    """Float lists as bytes: an entry of place and value for each component that is not zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    kind = entry(vectors.type.value_type)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = len(flat) // len(vectors) if len(vectors) else 0
    if not (lengths == width).all():
        raise ValueError(f"vectors must all have {width} elements")
    row, place = np.nonzero(flat.reshape(len(vectors), width))
    found = np.empty(len(row), dtype=kind)
    found["place"], found["value"] = place, flat.reshape(len(vectors), width)[row, place]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(vectors)))]) * kind.itemsize
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(found)])


def unpack(packed: pa.Array | pa.ChunkedArray, kind: T.DataType, width: int) -> Rows:
    """Packed vectors of ``width`` components of ``kind``."""
    start, parts = [np.zeros(1, dtype=np.int64)], []
    each = entry(kind)
    for part in packed.chunks if isinstance(packed, pa.ChunkedArray) else [packed]:
        if not len(part):
            continue
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = part.buffers()[2]
        if data is not None:
            parts.append(np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(each))
        start.append((offsets[1:] - offsets[0]) // each.itemsize + start[-1][-1])
    place = np.concatenate([p["place"] for p in parts]) if parts else np.zeros(0, dtype=np.int32)
    value = np.concatenate([p["value"] for p in parts]) if parts else np.zeros(0)
    return Rows(np.concatenate(start), place, value.astype(np.float64), width)


def _unit(rows: Rows) -> tuple[Rows, np.ndarray, np.ndarray]:
    """The vectors at length one (zeros where one has a NaN), the lengths, and which rows have a distance at all."""
    row = rows.row_of()
    norm = np.sqrt(np.bincount(row, weights=rows.value**2, minlength=len(rows)))
    with np.errstate(invalid="ignore", divide="ignore"):
        value = np.where(norm[row] > 0, rows.value / norm[row], 0.0)
    return Rows(rows.start, rows.place, value, rows.width), norm, ~np.isinf(norm)


def _first_k(row, column, gap, place, k, n):
    """The k nearest of each row by distance and place; each row's k-th distance and place (inf where it has fewer)."""
    order = np.lexsort((place[column], gap, row))
    row, column, gap = row[order], column[order], gap[order]
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    bound, last = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    end = nth == k - 1
    bound[row[end]], last[row[end]] = gap[end], place[column[end]]
    keep = nth < k
    return row[keep], column[keep], gap[keep], bound, last


class Search:
    """The ``k`` base rows nearest to each query by cosine.

    ``place`` orders the base rows: of equal distances the smaller comes first. ``bound`` and ``last`` are a distance and a
    place that no row is to be beyond. ``may`` (queries by groups) and ``group`` (of each base row) say who meets whom.
    """

    def __init__(self, queries: Rows, base: Rows, place: np.ndarray, k: int, bound: np.ndarray, last: np.ndarray,
                 may: np.ndarray | None = None, group: np.ndarray | None = None):
        self.q, self.b, self.place, self.k, self.may, self.group = queries, base, place, k, may, group
        self.bound, self.last = bound.copy(), last.copy()
        self.given, self.given_last = bound, last
        self.unit_q, self.norm_q, self.sound = _unit(queries)
        self.unit_b, self.norm_b, sound_b = _unit(base)
        self.row_b = base.row_of()
        kept = sound_b[self.row_b]
        weight = np.bincount(base.place[kept], weights=np.abs(self.unit_b.value[kept]), minlength=base.width)
        self.held_by = np.bincount(base.place[kept], minlength=base.width)
        self.column = np.empty(base.width, dtype=np.int64)
        order = np.argsort(-weight, kind="stable")
        self.column[order] = np.where(np.arange(base.width) < OWN, np.arange(base.width),
                                      OWN + np.arange(base.width) % SHARED)
        self.own = np.zeros(base.width, dtype=bool)
        self.own[order[:OWN]] = True
        self.sound_rows = np.nonzero(sound_b)[0]
        self.waiting, self.n = [], 0
        self.held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, base row and distance."""
        q = self.unit_q
        row = q.row_of()
        order = np.lexsort((self.held_by[q.place], row))
        self.rarest = q.place[order]
        value = np.abs(q.value[order])
        counts = np.diff(q.start)
        length, total, most = (np.zeros(len(value)) for _ in range(3))  # of a query from each of its places on
        length_, total_, most_ = (np.zeros(len(q)) for _ in range(3))
        for turn in range(int(counts.max(initial=0)) - 1, -1, -1):
            some = np.nonzero(counts > turn)[0]
            entry = q.start[some] + turn
            length_[some] += value[entry] ** 2
            total_[some] += value[entry]
            most_[some] = np.maximum(most_[some], value[entry])
            length[entry], total[entry], most[entry] = np.sqrt(length_[some]), total_[some], most_[some]
        for rows in self._kinds():
            top = self._top(rows)
            self._search(rows, np.minimum(length, top[2] * total + (top[0] + top[1] - 2 * top[2]) * most) + 1e-6)
        open_ = np.nonzero((self._least(np.arange(len(q))) <= 0) & self.sound)[0]  # rows without a place in common, too
        if len(open_):
            again = np.zeros(len(q), dtype=bool)
            again[open_] = True
            self.held = tuple(x[~again[self.held[0]]] for x in self.held)
            self.bound[open_], self.last[open_] = self.given[open_], self.given_last[open_]
            self._meet(open_, self.sound_rows, 0)
            self._merge()
        return self.held

    def _kinds(self) -> list[np.ndarray]:
        """The base rows in a few groups, those together whose weight is spread over as many places: most rows first."""
        spread = np.round(np.bincount(self.row_b, weights=np.abs(self.unit_b.value), minlength=len(self.b))[self.sound_rows], 2)
        kind, which, count = np.unique(spread, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(kind), dtype=np.int64)
        number[order] = np.minimum(np.arange(len(kind)), KINDS - 1)
        return [self.sound_rows[number[which] == n] for n in range(min(KINDS, len(kind)))]

    def _top(self, rows: np.ndarray) -> np.ndarray:
        """The most that the three largest components of any of the rows are."""
        row, entry = self.unit_b.entries(rows)
        value = np.abs(self.unit_b.value[entry])
        order = np.lexsort((-value, row))
        nth = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]
        value = value[order]
        return np.array([value[nth == n].max(initial=0.0) for n in range(3)])

    def _search(self, rows: np.ndarray, rest: np.ndarray) -> None:
        """All queries go to the rows, place by place; ``rest`` is the most that rows without the places before an entry reach."""
        q = self.unit_q
        counts = np.diff(q.start)
        row, entry = self.unit_b.entries(rows)
        place = self.unit_b.place[entry]
        posted = rows[row[np.argsort(place, kind="stable")]]
        first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=q.width))])
        for turn in range(int(counts.max(initial=0))):
            asks = np.nonzero((counts > turn) & self.sound)[0]
            asks = asks[rest[q.start[asks] + turn] >= self._least(asks)]
            if not len(asks):
                break
            at = self.rarest[q.start[asks] + turn]
            asks = asks[np.argsort(at, kind="stable")]
            each, done = np.bincount(at, minlength=q.width), 0
            for n in np.nonzero(each)[0]:
                self._meet(asks[done : done + each[n]], posted[first[n] : first[n + 1]], turn)
                done += each[n]
            self._merge()

    def _least(self, asks: np.ndarray) -> np.ndarray:
        """The cosine that a row has at least."""
        return 1.0 - self.bound[asks] - SLACK

    def _merge(self) -> None:
        if not self.waiting:
            return
        row, column, gap = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        *self.held, kth, last = _first_k(row, column, gap, self.place, self.k, len(self.q))
        nearer = (kth < self.bound) | ((kth == self.bound) & (last < self.last))
        self.bound[nearer], self.last[nearer] = kth[nearer], last[nearer]
        self.waiting, self.n = [], 0

    def _columns(self, unit: Rows, rows: np.ndarray, every: bool) -> np.ndarray:
        row, entry = unit.entries(rows)
        place, value = unit.place[entry], unit.value[entry]
        if every:
            out = np.zeros((len(rows), unit.width), dtype=np.float32)
            out[row, place] = value
            return out
        size = min(OWN + SHARED, unit.width)
        value = np.where(self.own[place], value, np.abs(value))
        return np.bincount(row * size + self.column[place], weights=value, minlength=len(rows) * size).astype(
            np.float32).reshape(len(rows), size)

    def _meet(self, asks: np.ndarray, rows: np.ndarray, turn: int) -> None:
        for i in range(0, len(rows), TILE_ROWS):
            some = rows[i : i + TILE_ROWS]
            parts = {}
            for j in range(0, len(asks), TILE_QUERIES):
                own = asks[j : j + TILE_QUERIES]
                every = not np.isfinite(self.bound[own]).all()
                if every not in parts:
                    parts[every] = self._columns(self.unit_b, some, every).T
                found = self._columns(self.unit_q, own, every) @ parts[every]
                error = 2.0 * (parts[every].shape[0] + 4) * float(np.finfo(np.float32).eps)
                if self.may is not None:
                    may = self.may[own][:, self.group[some]]
                    if not may.all():
                        found[~may] = -np.inf
                lowest = np.finfo(np.float32).min  # no pair that may not meet is above it
                least = lambda: np.maximum(self._least(own) - error, lowest).astype(np.float32)[:, None]
                hit = found >= least()
                if every and len(some) > self.k and np.count_nonzero(hit) > 2 * self.k * len(own):
                    kth = np.partition(found, len(some) - self.k, axis=1)[:, len(some) - self.k].astype(np.float64)
                    kth = np.where(np.isfinite(kth), 1.0 - kth + error + SLACK, np.inf)
                    nearer = kth < self.bound[own]
                    self.bound[own[nearer]], self.last[own[nearer]] = kth[nearer], np.iinfo(np.int64).max
                    hit = found >= least()
                r, c = np.divmod(np.flatnonzero(hit), len(some))
                if not len(r):
                    continue
                for at in range(0, len(r), PAIRS):
                    self._pairs(own, some, r[at : at + PAIRS], c[at : at + PAIRS], turn)

    def _pairs(self, asks: np.ndarray, rows: np.ndarray, r: np.ndarray, c: np.ndarray, turn: int) -> None:
        """The distances of pairs, of which those wait that are within the bound and were not seen at an earlier place."""
        used, c = np.unique(c, return_inverse=True)
        rows = rows[used]
        full = np.zeros((len(rows), self.b.width + 1))  # the last column is for queries with fewer places than others
        full[:, :-1] = self.b.dense(rows)
        for t in range(turn):
            new = full[c, self.rarest[self.q.start[asks[r]] + t]] == 0
            r, c = r[new], c[new]
        row, entry = self.q.entries(asks)
        counts = self.q.start[asks + 1] - self.q.start[asks]
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = np.full((len(asks), int(counts.max(initial=0))), self.q.width)
        value = np.zeros(place.shape)
        place[row, at], value[row, at] = self.q.place[entry], self.q.value[entry]
        product = np.einsum("ij,ij->i", full[c[:, None], place[r]], value[r])
        r, c = asks[r], rows[c]
        size = self.norm_q[r] * self.norm_b[c]
        gap = np.round(1.0 - np.divide(product, size, out=np.zeros_like(product), where=size > 0), 6) + 0.0
        fits = np.isfinite(gap) & ((gap < self.bound[r]) | ((gap == self.bound[r]) & (self.place[c] <= self.last[r])))
        self.waiting.append((r[fits], c[fits], gap[fits]))
        self.n += int(fits.sum())
        if self.n > max(self.k * len(self.q), 1 << 20):
            self._merge()
