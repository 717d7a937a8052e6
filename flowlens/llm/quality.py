"""Quality classifier: naive Bayes support vectors.

Features are the presence of n-grams in a document: words, and single, double and triple *shapes* of words (their
case, length, last character, and whether the word repeats one shortly before). The log-count ratio of the two classes
scales each feature; a linear hinge-loss model over the scaled features is then fitted by dual coordinate descent, and
a logistic curve through the margins of left-out rows gives scores between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import text_blocks
from flowlens.session import written

#: Hashed features: 2 to this power.
BITS = 18
#: Labelled rows that a model is fitted on at most, and their features together: the first by a hash of the id.
TRAIN_ROWS, TRAIN_FEATURES = 6_000, 20_000_000
#: Features seen in fewer training rows have no weight.
LEAST_ROWS = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _kinds() -> np.ndarray:
    """A class of each byte: 0 white space, 1 lower, 2 upper, 3 digit, 4 part of a wider character, 5 to 12 marks."""
    kind = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = 4
        elif b == 32 or 9 <= b <= 13:
            kind[b] = 0
        elif c.islower():
            kind[b] = 1
        elif c.isupper():
            kind[b] = 2
        elif c.isdigit():
            kind[b] = 3
        else:
            kind[b] = 5 + b % 8
    return kind


KIND = _kinds()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: flat ids, and the offsets of the texts in them."""
    joined = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(joined) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(j) + 1 for j in joined])
    kind = KIND[data]
    inside = kind != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    doc = np.searchsorted(ends, start, side="right")
    # A word's hash: a polynomial in its bytes, from running sums over the block.
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int((end - start).max()), _BASE)]), dtype=np.uint64)
    rolled = np.zeros(len(data), dtype=np.uint64)
    body = np.flatnonzero(inside)
    offset = body - np.repeat(start, end - start)
    rolled[body] = (data[body].astype(np.uint64) + np.uint64(1)) * powers[offset]
    word = _mixed(np.add.reduceat(rolled, start))
    size = end - start
    upper = np.add.reduceat((kind == 2).astype(np.int32), start)
    marks = np.add.reduceat((kind >= 5).astype(np.int32), start)
    digits = np.add.reduceat((kind == 3).astype(np.int32), start)
    same = np.zeros(len(word), dtype=np.uint64)
    for back in (4, 3, 2, 1):
        hit = np.flatnonzero((word[back:] == word[:-back]) & (doc[back:] == doc[:-back])) + back
        same[hit] = back
    case = np.where(upper == 0, 0, np.where(upper == size - marks, 2, 1)).astype(np.uint64)
    shape = case * np.uint64(7919) + kind[end - 1].astype(np.uint64) * np.uint64(104729)
    shape += np.minimum(marks, 4).astype(np.uint64) * np.uint64(1299709) + (digits > 0).astype(np.uint64) * np.uint64(15485863)
    shape += same * np.uint64(32452843) + np.minimum(size // 4, 4).astype(np.uint64) * np.uint64(49979687)
    shape = _mixed(shape)
    pair = doc[1:] == doc[:-1]
    triple = doc[2:] == doc[:-2]
    grams = [
        (doc, word * np.uint64(3)),
        (doc, shape * np.uint64(11)),
        (doc[1:][pair], (shape[:-1] * np.uint64(13) + shape[1:] * np.uint64(17))[pair]),
        (doc[2:][triple], (shape[:-2] * np.uint64(19) + shape[1:-1] * np.uint64(23) + shape[2:] * np.uint64(29))[triple]),
    ]
    rows = np.concatenate([g[0] for g in grams]).astype(np.int64)
    ids = (_mixed(np.concatenate([g[1] for g in grams])) >> np.uint64(64 - bits)).astype(np.int64)
    both = (rows << bits) | ids
    both = np.sort(both.astype(np.uint32) if len(texts) << bits < 1 << 32 else both)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])].astype(np.int64)
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(len(texts) + 1))


@dataclass
class Model:
    """``weight`` already holds the log-count ratios; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    bits: int = BITS

    def margins(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[ids])])
        return total[offsets[1:]] - total[offsets[:-1]] + self.bias

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(ids, offsets) + self.shift, -60, 60)))


def dual_descent(ids: np.ndarray, offsets: np.ndarray, value: np.ndarray, y: np.ndarray, cost: np.ndarray,
                 rounds: int = 20, tolerance: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Hinge loss with a squared norm, one dual variable at a time; row i has ``value[f]`` at each of its features f.

    Rows that rest at a bound are left out until the others have settled within ``tolerance`` of their gradient; then all
    are seen again. It ends when a pass over all rows finds none that is not settled, or after ``rounds``, which stops it
    about a hundredth above the least loss.
    """
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(value)), 0.0
    alpha = np.zeros(len(y))
    # Views of two long arrays: many small ones would leave the driver's Python large for good.
    used = value[ids] != 0
    ends = np.concatenate([[0], np.cumsum(used)])[offsets[1:-1]]
    ids = ids[used]
    rows, values = np.split(ids, ends), np.split(value[ids], ends)
    norm = np.array([v @ v + 1.0 for v in values])
    everyone = np.arange(len(y))
    active = everyone
    for _ in range(rounds):
        worst, stay = 0.0, []
        for i in rng.permutation(active):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                worst = max(worst, abs(step) * norm[i])
                alpha[i] = new
                stay.append(i)
        if worst > tolerance:
            active = np.array(stay)
        elif len(active) == len(everyone):
            break
        else:
            active = everyone
    return w, bias


def fit_rows(ids: np.ndarray, offsets: np.ndarray, good: np.ndarray, bits: int = BITS, cost: float = 0.1) -> Model:
    """Log-count ratios, then the hinge-loss model over features scaled by them; classes weigh the same."""
    count = [1.0 + np.bincount(ids[np.repeat(good == side, np.diff(offsets))], minlength=1 << bits) for side in (1, 0)]
    seen = np.bincount(ids, minlength=1 << bits)
    ratio = np.log(count[0] / (1.0 + (good == 1).sum())) - np.log(count[1] / (1.0 + (good == 0).sum()))
    ratio[seen < LEAST_ROWS] = 0.0
    # Long documents have many features: the scale keeps the norms of rows near one another.
    value = ratio / np.sqrt(max(1.0, np.median(np.diff(offsets))))
    share = np.array([(good == 0).mean(), (good == 1).mean()])
    w, bias = dual_descent(ids, offsets, value, np.where(good == 1, 1.0, -1.0), cost / (2 * np.maximum(share[1 - good], 1e-9)))
    return Model((w * value).astype(np.float64), bias, bits=bits)


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve through left-out margins, by Newton's method with smoothed targets."""
    t = np.where(good == 1, ((good == 1).sum() + 1.0) / ((good == 1).sum() + 2.0), 1.0 / ((good == 0).sum() + 2.0))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        d, v = t - p, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(v * margin**2).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(d * margin).sum() - 1e-6 * a, d.sum()]))
        scale = min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a + scale * step[0], b + scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id",
        rows: int = TRAIN_ROWS, bits: int = BITS, most: int = TRAIN_FEATURES) -> Model:
    """A model from ``labelled`` (text, label 0 or 1, key), at most ``rows`` of them: the first by a hash of the key.

    The bounds hold for what the driver gets: hashed features of ``rows`` documents, never texts, and fewer rows where
    these have more than ``most`` features together (but one row in any case). Null labels are left out. Without both classes the model scores every text by the share of label 1 (0.5 without rows).
    """
    schema = "key long, label int, ids binary"

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_blocks(batch.column("text")):
                ids, offsets = features(texts, bits)
                packed = [ids[a:b].astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array(packed, pa.binary())],
                                                 names=["key", "label", "ids"])

    known = labelled.filter(F.col(label).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string")).alias("key"), F.col(label).cast("int").alias("label"),
        F.col(text).alias("text"))
    found = written(known.mapInArrow(ids_of, schema).orderBy("key", "label", "ids").limit(rows), "features")
    sizes = found.select("key", "label", F.xxhash64("ids").alias("h"), (F.length("ids") / 4).alias("n")).orderBy(
        "key", "label", "h").toArrow()["n"].to_numpy()
    fit_in = max(1, int(np.searchsorted(np.cumsum(sizes), most, side="right")))
    found = found.orderBy("key", "label", F.xxhash64("ids")).limit(fit_in).toArrow()
    good = found["label"].to_numpy().astype(np.int64)
    each = [np.frombuffer(b.as_buffer(), dtype="<i4") for b in found["ids"]]
    return fit_sample(each, good, bits)


def fit_sample(each: list[np.ndarray], good: np.ndarray, bits: int = BITS, folds: int = 3) -> Model:
    if not 0 < good.sum() < len(good):
        share = good.mean() if len(good) else 0.5
        return Model(np.zeros(1 << bits), float(np.log((share + 1e-3) / (1 - share + 1e-3))), bits=bits)

    def flat(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [each[i] for i in pick]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return (np.concatenate(rows) if rows else np.empty(0, np.int32)), offsets

    margin = np.zeros(len(good))
    fold = np.arange(len(good)) % folds
    for k in range(folds):
        left = np.flatnonzero(fold == k)
        rest = np.flatnonzero(fold != k)
        if not 0 < good[rest].sum() < len(rest):
            continue
        margin[left] = fit_rows(*flat(rest), good[rest], bits).margins(*flat(left))
    model = fit_rows(*flat(np.arange(len(good))), good, bits)
    model.slope, model.shift = _logistic(margin, good)
    return model


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, plus score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text is read for the score: null and empty texts have no features and get the score of the bias. Equal
    texts get equal scores. Existing columns of the names ``score`` or ``predicted`` are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            out = np.empty(len(batch))
            for start, end, texts in text_blocks(batch):
                out[start:end] = known.scores(*features(texts, known.bits))
            yield pa.array(out)

    return docs.withColumn("score", score(F.col(text))).withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))


def label_rows(labels: DataFrame, docs: DataFrame, fold, id_col: str = "doc_id", label: str = "quality",
               rows: int = TRAIN_ROWS) -> DataFrame:
    """Texts and labels of the bounded training sample: at most ``rows`` ids that ``fold`` admits, by a hash of the id.

    One label per id: rows that contradict each other leave their id out. The sample's bound makes it safe to broadcast.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fold).groupBy(id_col).agg(
        F.min(label).alias("label"), F.max(label).alias("most"))
    picked = one.filter("label = most").select(id_col, "label").orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    picked = picked.limit(rows).withColumnRenamed(id_col, "picked_id")
    return docs.join(F.broadcast(picked), docs[id_col] == F.col("picked_id")).select(
        F.col("picked_id").alias("doc_id"), docs["text"].alias("text"), "label")
