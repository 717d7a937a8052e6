"""Scoring flows with a pluggable backend.

A backend adds ``label``, ``confidence`` and ``probabilities`` (array of float) to each flow, row by row,
so scoring never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.probabilities import best_class, label_index, pick_confidence, spread
from flowlens.functions.scalar import feature_vector
from flowlens.schemas import LABELS

Predict = Callable[[np.ndarray], np.ndarray]


class Backend(Protocol):
    """C1."""

    def score(self, flows: DataFrame, labels: Sequence[str]) -> DataFrame: ...


class DeterministicBackend:
    """A label and a confidence derived from the flow id; needs no model."""

    def score(self, flows: DataFrame, labels: Sequence[str]) -> DataFrame:
        n = len(labels)
        named = F.get(F.array(*[F.lit(x) for x in labels]), F.col("_pick"))
        return (
            flows.withColumn("_pick", label_index(F.col("flow_id"), n))
            .withColumn("confidence", pick_confidence(F.col("flow_id"), F.col("_pick")))
            .withColumn("label", named)
            .withColumn("probabilities", spread(F.col("_pick"), F.col("confidence"), n))
            .drop("_pick")
        )


class ModelBackend:
    """Any model that maps a float matrix [n, 22] to probabilities [n, classes].

    ``load`` runs once per task, on the executor, and returns the predict function. Rows per call follow
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def __init__(self, load: Callable[[], Predict]):
        self._load = load

    def probabilities(self) -> Column:
        load = self._load

        @F.arrow_udf("array<float>")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            run = load()
            for batch in batches:
                n = len(batch)
                if n == 0:
                    yield pa.array([], type=pa.list_(pa.float32()))
                    continue
                matrix = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)
                out = np.ascontiguousarray(run(matrix), dtype=np.float32).reshape(n, -1)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * out.shape[1])
                yield pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

        return predict(feature_vector())

    def score(self, flows: DataFrame, labels: Sequence[str]) -> DataFrame:
        return with_best(flows.withColumn("probabilities", self.probabilities()), labels)


class PipelineBackend:
    """C3 with a fitted ``pyspark.ml`` model that reads ``features`` and writes ``probability``."""

    def __init__(self, model):
        self._model = model

    def score(self, flows: DataFrame, labels: Sequence[str]) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        ready = flows.withColumn("features", array_to_vector(feature_vector().cast("array<double>")))
        scored = self._model.transform(ready).withColumn(
            "probabilities", vector_to_array("probability", "float32")
        )
        added = [c for c in scored.columns if c not in flows.columns and c != "probabilities"]
        return with_best(scored.drop(*added), labels)


def onnx_model(path: str) -> Callable[[], Predict]:
    """A ``load`` function for :class:`ModelBackend` over an ONNX file every executor can open.

    One thread per session: the tasks are the parallelism.
    """

    def load() -> Predict:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        options.inter_op_num_threads = 1
        session = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
        return lambda matrix: session.run(["output"], {"input": matrix})[0]

    return load


def with_best(scored: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add the label and confidence of the largest probability."""
    label, confidence = best_class(F.col("probabilities"), labels)
    return scored.withColumns({"label": label, "confidence": confidence})


def score(flows: DataFrame, backend: Backend | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Score every flow; keeps all its columns."""
    return (backend or DeterministicBackend()).score(flows, labels)
