"""What the two text classifiers share: labelled rows, counts of indicators, bounded samples, scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fold_of, slices, text_or_empty

#: Labelled documents of each class that a model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 4000
#: Bytes of labels up to which they are sent to all tasks; more are joined by id.
SENT_BYTES = 16 << 20


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, held_out: int) -> DataFrame:
    """id, y (0 or 1), text of the documents that may be learned from.

    Null ids and labels are left out; of several labels of an id the largest holds.
    """
    marks = labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("y")).where("of is not null and y is not null").groupBy("of").agg((F.max("y") > 0).cast("int").alias("y"))
    marks = durable(marks.where(fold_of("of", folds) != held_out))
    size = marks.agg(F.sum(F.octet_length(F.col("of").cast("string")) + 40)).first()[0] or 0
    if size <= SENT_BYTES:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.join(marks, F.col("id") == F.col("of")).select("id", "y", "text")


def distinct(f: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct values of f, with a scratch array of the values' range."""
    i = np.arange(len(f))
    stamp[f] = i
    return f[stamp[f] == i]


def count_indicators(rows: DataFrame, features, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For y = 0 and 1: the number of documents with each indicator, and of all; 2 x size, 2.

    features(part, column) yields an array of feature numbers below size for each
    row, repeats allowed. Counts cover all rows; a task hands on at most 2 x size.
    """
    import pyarrow as pa

    def run(batches):
        n, total, stamp = np.zeros((2, size), np.int64), np.zeros(2, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for part in slices(b, 1):
                for y, f in zip(part.column(0).to_pylist(), features(part, 1), strict=True):
                    n[y, distinct(f, stamp)] += 1
                    total[y] += 1
        for y in (0, 1):
            f = np.flatnonzero(n[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1)), pa.array(np.full(len(f) + 1, y)), pa.array(np.append(n[y, f], total[y]))], ["f", "y", "n"])

    got = rows.select("y", "text").mapInArrow(run, "f long, y long, n long").groupBy("f", "y").agg(F.sum("n").alias("n")).toArrow()
    n, total = np.zeros((2, size)), np.zeros(2)
    f, y, c = (got[k].to_numpy() for k in ("f", "y", "n"))
    total[y[f < 0]] = c[f < 0]
    n[y[f >= 0], f[f >= 0]] = c[f >= 0]
    return n, total


def sample(rows: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most `size` rows of each class, chosen by a hash of id and text."""
    order = (F.xxhash64("id", "text"), "id")
    ids = rows.select("id", "y", F.xxhash64("id", "text").alias("k"))
    picked = ids.where("y = 0").orderBy("k", "id").limit(size).unionByName(ids.where("y = 1").orderBy("k", "id").limit(size))
    picked = F.broadcast(durable(picked.select(F.col("id").alias("in"), F.col("k").alias("in_k")).distinct()))  # 2 * size rows at most
    return rows.join(picked, (F.col("id") == F.col("in")) & (order[0] == F.col("in_k"))).select("id", "y", "text")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b so that sigmoid(a * margin + b) is the probability of y = 1, by Newton steps from prior-smoothed targets."""
    n1, n0 = max(1.0, float((y == 1).sum())), max(1.0, float((y == 0).sum()))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    ab = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ ab)
        g = x.T @ (weight * (p - target)) + 1e-6 * ab
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        ab -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def scored(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, threshold: float, score_part) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, by score_part(part, column) -> array."""
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        score = score_part()
        for b in batches:
            for part in slices(b, 2):
                s = score(part, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col), (fold_of(id_col, folds) == held_out), text_or_empty(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
