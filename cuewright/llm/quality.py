"""Quality classifier: a support vector machine on Naive Bayes features.

Indicators of byte n-grams are scaled by their class log-count ratio; a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import column_bytes, slices
from .linear import SAMPLE, calibrate, count_indicators, distinct, labelled, sample, scored, sigmoid

#: Single bytes, pairs, and hash values of three bytes.
TRIPLES = 1 << 17
SIZE = 256 + 65536 + TRIPLES
SMOOTHING, COST, PASSES = 1.0, 1.0, 12
THRESHOLD = 0.3


def byte_ngrams(part, column: int):
    """Feature numbers of the byte n-grams of each row, n from 1 to 3."""
    buf, offsets = column_bytes(part.column(column))
    one = buf.astype(np.int64)
    two = one[:-1] * 256 + one[1:]
    three = ((two[:-1] * 256 + one[2:]) * 2654435761 >> 9) % TRIPLES if len(one) > 2 else one[:0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.concatenate([one[a:b], 256 + two[a : max(a, b - 1)], 256 + 65536 + three[a : max(a, b - 2)]])


def log_ratio(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log of the indicators' smoothed shares among documents of class 1 over class 0."""
    p = (n + SMOOTHING) / (n + SMOOTHING).sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def descend(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model, by dual coordinate descent.

    x has the distinct indicators of each document; a document's vector is scaled
    to length 1, with the bias as one more feature. y is +1 or -1; both classes
    get the same total cost.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(x))
    most = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    values = [ratio[f] / np.sqrt((ratio[f] ** 2).sum() + 1e-12) for f in x]
    order = np.random.default_rng(1)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            f, v = x[i], values[i]
            g = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - g / (v @ v + 1.0), 0.0), most[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[f] += d * v
                bias += d
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, held_out: int, size: int = SAMPLE):
    """Scaled weights, squared ratios, bias, a and b of the model; a share of label 1 if a class is missing.

    Log-count ratios come from all labelled documents outside the held-out fold,
    the model from at most `size` of each class, in one task. That task gets the
    numbers of a text's indicators, which are worked out where the text lies.
    """
    import pyarrow as pa

    rows = labelled(docs, labels, label_col, id_col, text_col, folds, held_out)
    n, total = count_indicators(rows, byte_ngrams, SIZE)
    if not total.all():
        return None, float(total[1] / total.sum()) if total.sum() else 0.5
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio(n, total))

    def indicators(batches):
        stamp = np.zeros(SIZE, np.int64)
        for b in batches:
            for part in slices(b, 2):
                own = [np.sort(distinct(f, stamp)).astype(np.int32).tobytes() for f in byte_ngrams(part, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], ["id", "y", "own"])

    def learn(table):
        ratio = sent.value.astype(np.float32)
        table = table.sort_by([("id", "ascending"), ("y", "ascending")])
        x, y = [np.frombuffer(v, np.int32) for v in table["own"].to_pylist()], table["y"].to_pylist()
        y = np.array(y)
        check = np.arange(len(y)) % 4 == 3  # a quarter gives the scores their scale
        if min(np.bincount(y[check], minlength=2)) < 5:
            check[:] = False
        use = np.flatnonzero(~check)
        w, bias = descend([x[i] for i in use], np.where(y[use] == 1, 1, -1), ratio)
        seen = np.flatnonzero(check) if check.any() else use
        margin = np.array([(w[x[i]] * ratio[x[i]]).sum() / np.sqrt((ratio[x[i]] ** 2).sum() + 1e-12) + bias for i in seen])
        share = np.bincount(y[seen], minlength=2)
        weight = (total / total.sum() * len(seen) / np.maximum(share, 1))[y[seen]]
        a, b = calibrate(margin, y[seen], weight)
        return pa.table({"w": pa.array([(w * ratio).astype(np.float32).tobytes()], pa.binary()), "bias": [bias], "a": [a], "b": [b]})

    kind = rows.schema["id"].dataType.simpleString()
    vectors = sample(rows, size).mapInArrow(indicators, f"id {kind}, y int, own binary")
    got = vectors.groupBy().applyInArrow(learn, "w binary, bias double, a double, b double").first()
    square = (sent.value**2).astype(np.float32)
    return (np.frombuffer(got["w"], np.float32), square, got["bias"], got["a"], got["b"]), float(total[1] / total.sum())


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held_out: int = 0, size: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Score every text for quality: doc_id, held_out, score, predicted.

    Learns from labelled documents whose crc32 of the id, modulo folds, is not
    held_out. The score is the probability of label 1, from the text alone; an
    empty or null text gets the score of no features. If a class has no labelled
    document, every score is the share of label 1, or 0.5 without labels. Null ids
    are scored, and not learned from; rows that repeat an id are scored each by its
    own text. An empty table gives no rows. Other columns are not read.
    """
    model, share = fit(docs, labels, label_col, id_col, text_col, folds, held_out, size)
    sent = docs.sparkSession.sparkContext.broadcast((model, share))

    def scorer():
        model, share = sent.value
        stamp = np.zeros(SIZE, np.int64)

        def score(part, column):
            if model is None:
                return np.full(part.num_rows, share)
            w, square, bias, a, b = model
            out = np.empty(part.num_rows)
            for i, f in enumerate(byte_ngrams(part, column)):
                f = distinct(f, stamp)
                out[i] = w[f].sum(dtype=np.float64) / np.sqrt(square[f].sum(dtype=np.float64) + 1e-12) + bias
            return sigmoid(a * out + b)

        return score

    return scored(docs, id_col, text_col, folds, held_out, threshold, scorer)
