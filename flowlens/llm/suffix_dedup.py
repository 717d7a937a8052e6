"""Removal of long repeated byte strings with a distributed, sampled suffix array.

Every window of ``length`` bytes owns an *anchor*: the place in it whose next ``gram`` bytes have the smallest hash, the
leftmost of equals. Equal windows have their anchors at the same place, so only suffixes that start at anchors must be
sorted, and only those whose gram starts somewhere else too. Such a suffix carries the bytes before and after its anchor
that its windows cover.

Sampled splitters range-partition the suffixes by their leading bytes. Each bucket sorts its suffixes, and the reversed
bytes before their anchors, by multikey quicksort on eight-byte characters. Common prefix lengths of neighbours then
say, for each distance d of a window's start from its anchor, which suffixes agree in the first ``length - d`` bytes and
which in the d bytes before: a window is repeated where two suffixes agree in both. A gram that very many suffixes
begin with is split between buckets; the windows of each bucket's first and last gram are compared across boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import written

#: Bytes of a repeated string, and of the gram that places anchors.
LENGTH, GRAM = 400, 100
#: Window starts that are looked at together; longer texts take several turns.
TURN = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on: a polynomial from running sums, then mixed."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    n = len(data) - gram + 1
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima of blocks to both sides."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Rows of place, first and last window start that it anchors, and gram hash (as signed), for one text."""
    found = []
    for begin in range(0, len(data) - length + 1, TURN):
        part = data[begin : begin + TURN + length - 1]
        hashes = gram_hashes(part, gram)
        order = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_minimum(order, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        place = (least[first] & _PLACE).astype(np.int64)
        found.append(np.stack([place + begin, first + begin, last + begin, hashes[place].view(np.int64)], axis=1))
    return np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)


def multikey_order(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of byte strings (rows of a zero-padded matrix), a shorter one before those that begin with it.

    Eight bytes are one character. Each round sorts the strings that are still tied by their next character and goes
    on with the new ties alone.
    """
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.argsort(sizes, kind="stable")
    tie = np.zeros(len(order), dtype=np.int64)  # by position in the order: the tied run it belongs to
    open_ = np.arange(len(order))
    for k in range(words.shape[1]):
        if len(open_) < 2:
            break
        own = order[open_]
        new = np.lexsort((words[own, k], tie[open_]))
        order[open_] = own[new]
        char, run = words[order[open_], k], tie[open_]
        starts = np.concatenate([[True], (char[1:] != char[:-1]) | (run[1:] != run[:-1])])
        number = np.cumsum(starts) - 1
        tie[open_] = number
        open_ = open_[np.bincount(number)[number] > 1]
    return order


def common_prefix(rows: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each string in order the length it shares with the one before; -1 for the first."""
    out = np.full(len(order), -1, dtype=np.int64)
    for k in range(1, len(order), 4096):
        a, b = order[k - 1 : k + 4095][: len(order[k : k + 4096])], order[k : k + 4096]
        differ = rows[a] != rows[b]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[k : k + 4096] = np.minimum(same, np.minimum(sizes[a], sizes[b]))
    return out


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    out = np.zeros((len(values), max(width, 1)), dtype=np.uint8)
    flat = np.frombuffer(b"".join(values), dtype=np.uint8)
    row = np.repeat(np.arange(len(values)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def repeated_windows(left: list[bytes], right: list[bytes], near: np.ndarray, far: np.ndarray, length: int,
                     gram: int) -> np.ndarray:
    """For each suffix (row) and distance d (column): 2 if its window d bytes before the anchor is repeated here, 1 if
    it is alone, 0 if the suffix does not anchor it. ``near`` and ``far`` bound d."""
    reach = length - gram
    behind, behind_size = _matrix([v[::-1] for v in left], reach)
    ahead, ahead_size = _matrix(right, length)
    classes = []
    for rows, sizes in ((behind, behind_size), (ahead, ahead_size)):
        order = multikey_order(rows, sizes)
        classes.append((order, common_prefix(rows, sizes, order)))
    del behind, ahead, rows
    state = np.zeros((len(left), reach + 1), dtype=np.uint8)
    before, after = np.empty(len(left), dtype=np.int64), np.empty(len(left), dtype=np.int64)
    for d in range(reach + 1):
        some = np.flatnonzero((near <= d) & (d <= far))
        if not len(some):
            continue
        before[classes[0][0]] = np.cumsum(classes[0][1] < d)
        after[classes[1][0]] = np.cumsum(classes[1][1] < length - d)
        both = before[some] * (len(left) + 1) + after[some]
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        state[some, d] = np.where(count[which] > 1, 2, 1)
    return state


def _runs(state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of 2 in a row."""
    hit = np.zeros((state.shape[0], state.shape[1] + 2), dtype=np.int8)
    hit[:, 1:-1] = state == 2
    turn = np.diff(hit, axis=1)
    row, first = np.nonzero(turn == 1)
    return row, first, np.nonzero(turn == -1)[1] - 1


def _sort_bucket(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held)
        h, n, place = (table[c].to_numpy() for c in ("h", "n", "place"))
        left, right = table["left"].to_pylist(), table["right"].to_pylist()
        state = repeated_windows(left, right, table["near"].to_numpy(), table["far"].to_numpy(), length, gram)
        # A suffix whose text holds it at other places too is repeated by that alone, here and there.
        others = table["others"].combine_chunks()
        twice = others.value_lengths().to_numpy() > 0
        state[twice] = np.where(state[twice] > 0, 2, 0)
        row, first, last = _runs(state)
        size = others.value_lengths().to_numpy()[row]
        start = others.offsets.to_numpy()[row]
        again = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        place_of = np.concatenate([place[row], others.values.to_numpy()[again]])
        row, first, last = (np.concatenate([x, np.repeat(x, size)]) for x in (row, first, last))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[row]), pa.array(n[row]), pa.array(place_of - last), pa.array(place_of - first + length),
             pa.nulls(len(row), pa.binary())], names=["h", "n", "start", "stop", "window"])
        # The first and the last gram may go on in the neighbouring buckets: their windows go there, equal ones once.
        lead = [r[:gram] for r in right]
        edge = {min(lead), max(lead)}
        seen: set[bytes] = set()
        out: list[tuple] = []
        for i in (i for i, v in enumerate(lead) if v in edge):
            whole = left[i] + right[i]
            for d in np.flatnonzero(state[i]).tolist():
                start = len(left[i]) - d
                window = hashlib.blake2b(whole[start : start + length], digest_size=16).digest()
                if state[i, d] == 1 or window not in seen:
                    out.append((int(h[i]), int(n[i]), int(place[i]) - d, int(place[i]) - d + length, window))
                    seen.add(window)
            if len(out) > 50_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


_FOUND = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("window", pa.binary())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Repeated byte ranges of the distinct texts: h, n (hash and bytes of a text) and ``spans``, structs of start and
    stop that may overlap. ``texts`` has doc_id, h, n and text, one row per document."""
    long_ = texts.filter(F.col("n") >= length)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                found = [anchors(np.frombuffer(t.encode(), dtype=np.uint8), length, gram) for t in part.column("text").to_pylist()]
                size = np.array([len(f) for f in found])
                rows = np.concatenate(found) if len(found) else np.empty((0, 4), dtype=np.int64)
                own = np.repeat(np.arange(len(part)), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("h").take(pa.array(own)), part.column("n").take(pa.array(own)), pa.array(rows[:, 0]),
                     pa.array((rows[:, 0] - rows[:, 2]).astype(np.int16)), pa.array((rows[:, 0] - rows[:, 1]).astype(np.int16)),
                     pa.array(rows[:, 3])], names=["h", "n", "place", "near", "far", "gram"])

    marked = written(long_.select("h", "n", "text").mapInArrow(
        mark, "h long, n long, place long, near short, far short, gram long"), "anchors")
    occurrence = F.xxhash64("h", "n", "place")
    twice = marked.groupBy("gram").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b")).filter("a < b")
    places = marked.join(twice.select("gram"), "gram", "left_semi").groupBy("h", "n").agg(
        F.collect_set(F.struct("place", "near", "far")).alias("places"))
    one = long_.groupBy("h", "n").agg(F.min("doc_id").alias("one_id"))
    wanted = places.join(one, ["h", "n"]).select(F.col("h").alias("wh"), F.col("n").alias("wn"), "one_id", "places")
    source = long_.join(wanted, (F.col("h") == F.col("wh")) & (F.col("n") == F.col("wn")) & F.col("doc_id").eqNullSafe(
        F.col("one_id"))).select("h", "n", "text", "places")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column("text")[i].as_py().encode()
                spots = batch.column("places")[i].as_py()
                h, n = batch.column("h")[i].as_py(), batch.column("n")[i].as_py()
                own: dict[tuple, list[int]] = {}  # a text with a period holds the same suffix at many places
                for s in spots:
                    at = s["place"]
                    own.setdefault((s["near"], s["far"], data[at - s["far"] : at - s["near"] + length]), []).append(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(own)), pa.array([n] * len(own)), pa.array([v[0] for v in own.values()], pa.int64()),
                     pa.array([k[0] for k in own], pa.int16()), pa.array([k[1] for k in own], pa.int16()),
                     pa.array([k[2][: k[1]] for k in own], pa.binary()), pa.array([k[2][k[1] :] for k in own], pa.binary()),
                     pa.array([v[1:] for v in own.values()], pa.list_(pa.int64()))],
                    names=["h", "n", "place", "near", "far", "left", "right", "others"])

    suffixes = written(source.mapInArrow(
        carry, "h long, n long, place long, near short, far short, left binary, right binary, others array<long>"), "suffixes")
    bucketed = suffixes.repartitionByRange(F.substring("right", 1, gram), F.xxhash64("h", "n", "place"))
    found = written(bucketed.mapInArrow(_sort_bucket(length, gram), "h long, n long, start long, stop long, window binary"),
                    "spans")
    inside = found.filter("window IS NULL").select("h", "n", "start", "stop")
    edge = found.filter("window IS NOT NULL")
    shared = edge.groupBy("window").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1").select("window")
    across = edge.join(shared, "window", "left_semi").select("h", "n", "start", "stop")
    return inside.unionByName(across).groupBy("h", "n").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text``, plus n_bytes, kept (the remaining bytes) and spans (removed ranges, maximal, in order).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, in the same text
    too; strings are judged on the input and never cross documents. So every copy of a repeated string goes. A null
    text is empty. Rows with equal texts are copies of each other and lose everything if long enough. Other columns
    pass through (those named n_bytes, kept or spans are replaced); an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "kept", "spans")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.xxhash64(body).alias("h"),
                        F.octet_length(body).cast("long").alias("n"), body.alias("text"))
    at = f"c{rest.index(id_col)}"
    texts = keyed.select(F.col(at).alias("doc_id"), "h", "n", "text")
    copies = texts.filter(F.col("n") >= length).groupBy("h", "n").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    known = repeated_spans(texts, length, gram).join(copies, ["h", "n"], "full").select(
        F.col("h").alias("kh"), F.col("n").alias("kn"), F.col("copies").isNotNull().alias("whole"), "spans")
    joined = keyed.join(known, (F.col("h") == F.col("kh")) & (F.col("n") == F.col("kn")), "left")
    joined = joined.withColumn("spans", F.when(F.col("whole"), F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))).otherwise(F.col("spans")))
    names = [f"c{i}" for i in range(len(rest))]
    shape = "array<struct<start: long, stop: long>>"
    out = joined.select(*names, "n", F.lit(b"").alias("kept"), F.lit(None).cast(shape).alias("spans")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, merged = [], []
            for value, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                data = value.as_buffer().to_pybytes()
                runs: list[dict] = []
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    if runs and s["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], s["stop"])
                    else:
                        runs.append(dict(s))
                edges = [0, *[e for r in runs for e in (r["start"], r["stop"])], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2])))
                merged.append(runs)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], batch.column("n"), pa.array(kept, pa.binary()), pa.array(merged, kind)],
                names=[*names, "n", "kept", "spans"])

    found = joined.select(*names, "n", "text", "spans").mapInArrow(cut, out)
    return found.withColumnsRenamed({n: c for n, c in zip(names, rest)} | {"n": "n_bytes"})
