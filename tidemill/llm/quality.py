"""Quality by ordinal regression: hashed text with shared weights, and ordered thresholds between grades.

P(grade > j) = sigmoid(w.x - t_j) with t_0 < t_1 < ...: one weight vector for all grades (a cumulative-link model).
Grades come from the labels: 0 poor, 1 well written but toxic, 2 well written and clean. The model gives the expected
grade and the tail probability of grade 1 or better, by which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._features import adam, labelled_sample, matrices, packed_matrices, unpacked
from tidemill.llm._state import prepare
from tidemill.llm._text import tidy

#: Labelled rows for each combination of labels that the model is fitted on, at most.
SAMPLE = 800


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... of each row."""
        return _sigmoid((x @ self.weights)[:, None] - self.thresholds)

    @classmethod
    def fit(cls, x: np.ndarray, grade: np.ndarray, weight: np.ndarray, *, steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> Ordinal:
        """By gradient descent on the cumulative likelihood; thresholds are a first one and positive steps."""
        levels = int(grade.max()) if len(grade) else 1
        d = x.shape[1]
        total = max(weight.sum(), 1e-9)

        def thresholds(p):
            return np.cumsum(np.concatenate([p[d : d + 1], np.exp(p[d + 1 :])]))

        def gradient(p):
            t = thresholds(p)
            # bounds of the grade's interval on the latent scale; its probability is a difference of two tails
            z = (x @ p[:d].astype(x.dtype))[:, None].astype(float) - t
            tail = np.hstack([np.ones((len(x), 1)), _sigmoid(z), np.zeros((len(x), 1))])
            rows = np.arange(len(x))
            prob = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-9)
            slope = tail * (1 - tail)
            up, low = slope[rows, grade], slope[rows, grade + 1]
            dz = -(up - low) / prob * weight / total
            dt = np.zeros(levels)
            for j in range(levels):
                dt[j] = ((np.where(grade == j + 1, up, 0) - np.where(grade == j, low, 0)) / prob * weight / total).sum()
            tail_sum = np.cumsum(dt[::-1])[::-1]
            return np.concatenate([(dz.astype(x.dtype) @ x).astype(float) + ridge * p[:d], tail_sum[:1], tail_sum[1:] * np.exp(p[d + 1 :])])

        p = adam(gradient, np.zeros(d + levels), steps, rate)
        return cls(p[:d].astype(np.float32), thresholds(p))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> Ordinal | None:
    """The model of at most `sample` labelled rows for each combination of labels; None without labelled rows.

    Rows weigh as many labelled rows as they stand for, so that the selection doesn't shift where the sample is capped.
    """
    prepare(docs.sparkSession)
    rows, y, weight = labelled_sample(docs, labels, id_col, text_col, ["quality", "toxic"], sample, packed_matrices)
    if not rows:
        return None
    grade = np.where(y[:, 0] > 0, np.where(y[:, 1] > 0, 1, 2), 0)
    return Ordinal.fit(unpacked(rows), grade, weight)


def score(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, expected_grade, p_good (P(grade >= 1)), keep (p_good >= 0.5).

    A null text counts as empty. Without a model every document has grade and probability null and is kept.
    Repeated rows and rows without an id get a row each, an empty table gives none; other columns are not read,
    whatever their names. Texts of any length are read whole, long ones in segments.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    if model is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_good"), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            for first, end, x in matrices(b.column(1)):
                tails = sent.value.tails(x).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 0] >= 0.5)], ["_id", "expected_grade", "p_good", "keep"])

    return rows.mapInArrow(tidy(work), f"_id {kind}, expected_grade double, p_good double, keep boolean").withColumnRenamed("_id", id_col)


def select(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose tail probability is at least 0.5, with all their columns; without a model, all rows."""
    prepare(docs.sparkSession)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for first, end, x in matrices(b.column(at)):
                keep[first:end] = sent.value.tails(x)[:, 0] >= 0.5
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(tidy(work), docs.schema)
