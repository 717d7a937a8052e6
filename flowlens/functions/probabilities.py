"""Class probabilities: choosing the label, rendering and reading JSON, the deterministic picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schemas import LABELS, UNKNOWN


def text_hash(text: Column) -> Column:
    """The first 32 bits of the md5 of ``text`` as a bigint; any engine can repeat it."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def text_id(text: Column) -> Column:
    """The first 60 bits of the md5 of ``text`` as a bigint; any engine can repeat it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def label_index(flow_id: Column, n_labels: int) -> Column:
    """deterministic class index."""
    return (text_hash(F.concat(flow_id, F.lit(":label"))) % n_labels).cast("int")


def pick_confidence(flow_id: Column, index: Column) -> Column:
    """F16: 0.72 + (h mod 100) * 0.0026, salted by the chosen index."""
    h = text_hash(F.concat(flow_id, F.lit(":"), index.cast("string")))
    return (F.lit(0.72) + (h % 100) * F.lit(0.0026)).cast("float")


def spread(index: Column, confidence: Column, n_labels: int) -> Column:
    """``confidence`` at the pick, the rest shared equally by the other classes."""
    if n_labels == 1:
        return F.array(confidence.cast("float"))
    rest = ((F.lit(1.0) - confidence) / (n_labels - 1)).cast("float")
    return F.array(*[F.when(index == i, confidence.cast("float")).otherwise(rest) for i in range(n_labels)])


def best_class(probabilities: Column, labels: Sequence[str] = LABELS) -> tuple[Column, Column]:
    """(label, confidence) of the largest probability.

    The last of several maxima wins. An empty array gives class 0 with confidence 1. An index beyond
    the labels, a NaN, or a NULL array gives UNKNOWN.
    """
    top = F.array_max(probabilities)
    empty = F.size(probabilities) == 0
    last = F.size(probabilities) - F.array_position(F.reverse(probabilities), top)
    named = F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), last.cast("int")), F.lit(UNKNOWN))
    label = (
        F.when(empty, F.lit(labels[0]))
        .when(probabilities.isNull() | F.isnan(top), F.lit(UNKNOWN))
        .otherwise(named)
    )
    confidence = F.when(empty, F.lit(1.0)).otherwise(top).cast("float")
    return label, confidence


def json_sorted(probabilities: Column, labels: Sequence[str] = LABELS) -> Column:
    """JSON object ordered by key, full floats, only classes that have a value."""
    by_name = sorted((label, i) for i, label in enumerate(labels))
    fields = [F.get(probabilities, F.lit(i)).alias(label) for label, i in by_name]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def json_label_order(probabilities: Column, labels: Sequence[str] = LABELS) -> Column:
    """JSON object in label order, four decimals, cut to the shorter of the two lists."""
    parts = [
        F.when(
            F.get(probabilities, F.lit(i)).isNotNull(),
            F.concat(F.lit(f'"{label}":'),
                     F.format_string("%.4f", F.get(probabilities, F.lit(i)).cast("double"))),
        )
        for i, label in enumerate(labels)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_number(text: str | Column, key: str) -> Column:
    """the number stored under ``key``; 0 when it is absent or no number."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.get_json_object(col, f"$['{key}']").try_cast("double"), F.lit(0.0))
