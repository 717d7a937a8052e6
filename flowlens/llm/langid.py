"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three neighbouring letters binds (multiplies) the vectors
of the letters, the first permuted twice, the second once. The profile of a text bundles (adds) the vectors of all its
letter triples; a language's prototype bundles the profiles of its training texts, each at length 1. The language of a
text is the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import blocks

#: Length of the vectors.
WIDTH = 1024
#: Profiles are added in whole units of this size, so that sums don't depend on their order.
UNIT = 1 << 24
#: Vectors of letter triples that a task remembers.
MEMO = 30_000
_OUTSIDE = 0


def _letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Profiler:
    """Profiles of texts; keeps the vectors of letter triples that it has seen."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = _letter_table()
        self.ids = np.empty(0, dtype=np.int64)
        self.vectors = np.empty((0, width), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.width, dtype=np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def triple(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for these distinct, sorted keys."""
        new = keys[~np.isin(keys, self.ids)]
        if len(new):
            if len(self.ids) + len(new) > MEMO:
                self.ids, self.vectors, new = self.ids[:0], self.vectors[:0], keys
            ids = np.concatenate([self.ids, new])
            vectors = np.concatenate([self.vectors, np.array([self.triple(int(k)) for k in new], dtype=np.int8)])
            order = np.argsort(ids)
            self.ids, self.vectors = ids[order], vectors[order]
        return np.searchsorted(self.ids, keys)

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, of length 1; zero for a text without letters."""
        lowered = [(t or "").lower() for t in texts]
        joined = " " + " ".join(lowered) + " "
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in lowered])
        inside = self.is_letter[codes]
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # of a run of other characters the first, which ends a word
        keep[0] = True
        at = np.flatnonzero(keep)
        code = np.where(inside[at], codes[at], _OUTSIDE).astype(np.int64)
        doc = np.searchsorted(ends, at - 1, side="right")
        middle = inside[at][1:-1] | (inside[at][:-2] & inside[at][2:] & (doc[:-2] == doc[2:]))
        key = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
        key, row = key[middle], doc[1:-1][middle]
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        if not len(key):
            return out
        keys, place = np.unique(key, return_inverse=True)
        step = max(1, 8_000_000 // len(keys))
        for start in range(0, len(texts), step):
            some = (row >= start) & (row < start + step) if step < len(texts) else slice(None)
            n = min(step, len(texts) - start)
            counts = np.bincount((row[some] - start) * len(keys) + place[some], minlength=n * len(keys))
            counts = counts.reshape(n, len(keys)).astype(np.float32)
            for k in range(0, len(keys), MEMO // 2):
                part = keys[k : k + MEMO // 2]
                rows = self.known(part)
                out[start : start + n] += counts[:, k : k + len(part)] @ self.vectors[rows].astype(np.float32)
        norm = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def profiler(width: int) -> Profiler:
    """The profiler of this Python worker."""
    if width not in _PROFILERS:
        _PROFILERS[width] = Profiler(width)
    return _PROFILERS[width]


_PROFILERS: dict[int, Profiler] = {}


@dataclass
class Prototypes:
    """Languages in code-point order and their vectors of length 1, one row each."""

    languages: list[str]
    vectors: np.ndarray
    width: int


def learn(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", width: int = WIDTH) -> Prototypes:
    """Prototypes from all rows that ``where`` admits and whose ``lang`` is not null.

    Each task adds up its profiles per language and sends one vector for each; the driver gets languages x width sums.
    """
    rows = docs.filter(where).filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        profile = profiler(width)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), dtype=object)
            for start, end in blocks(texts):
                units = np.rint(profile.profiles(texts[start:end]).astype(np.float64) * UNIT).astype(np.int64)
                for name in set(langs[start:end]):
                    own = units[langs[start:end] == name].sum(axis=0)
                    sums[name] = sums[name] + own if name in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()])],
                                             names=["lang", "sums"])

    parts = rows.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("place", "part"))
    total = parts.groupBy("lang", "place").agg(F.sum("part").alias("total")).toArrow()
    names = sorted(set(total["lang"].to_pylist()))
    vectors = np.zeros((len(names), width))
    index = {n: i for i, n in enumerate(names)}
    vectors[[index[n] for n in total["lang"].to_pylist()], total["place"].to_numpy()] = total["total"].to_numpy() / UNIT
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes(names, np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0), width)


def predict(docs: DataFrame, prototypes: Prototypes, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the nearest prototype's language and its cosine, at least 0.

    ``und`` and 0 where the text is null or has no letter, and without prototypes. Equal cosines go to the language
    that is first by code point. Only the text is read. Columns of these names are replaced; repeated rows, other
    columns and their nulls pass through.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        profile = profiler(known.width)
        names = np.array([*known.languages, "und"], dtype=object)
        for batch in batches:
            texts = batch.to_pylist()
            pick, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            for start, end in blocks(texts):
                rows = profile.profiles(texts[start:end])
                if len(known.languages):
                    cosine = np.round(rows.astype(np.float64) @ known.vectors.T, 9)
                    some = rows.any(axis=1)
                    pick[start:end] = np.where(some, cosine.argmax(axis=1), len(names) - 1)
                    score[start:end] = np.where(some, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0)
            yield pa.StructArray.from_arrays([pa.array(names[pick].tolist(), pa.string()), pa.array(score)],
                                             names=["lang_pred", "score"])

    found = docs.withColumn("_found", nearest(F.col(text)))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "_found.lang_pred", "_found.score")
