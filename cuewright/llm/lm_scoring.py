"""Language-model scores from a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(bucket | class, history) * P(word | bucket).
A word's bucket is its own if it is one of the OWN most frequent words, else a hash
of its last bytes; classes join up buckets of words that stand near the same ones.
The first two factors are softmaxes over the same features: the previous word's
bucket (bigram) and the class that prevails among the words before (skip). Their
weights are trained by gradient steps worked out by tasks and summed up. The last
factor has the word itself as its only feature; the maximum-entropy solution is
then its smoothed share of the bucket. Word counts come from the whole training
part and stay in a table; words are told apart by 55 bits of hash and their bucket.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, column_bytes, durable, fold_of, lower_ascii, rows_of, slices, text_or_empty, word_bounds, word_hashes

#: Classes; 0 is the end of a text.
CLASSES = 32
#: Buckets by the last bytes of a word, of which 0 is the end of a text; words with buckets of their own.
TAILS, OWN = 512, 512
BUCKETS = TAILS + OWN
#: Hash buckets of the previous word, of which 0 is none; words before that vote for the prevailing class.
PREVIOUS, BACK = 512, 8
STEPS, RATE, MOMENTUM = 8, 0.6, 0.5
#: Counts by which a weight's step is damped.
DAMP = 20
#: Words with at least 1/FREQUENT of all training tokens are known to each task: FREQUENT words at most, 16 bytes each.
FREQUENT = 1 << 20
#: The end of a text, as a word's number: 0 in the bits of TAILS.
END = 0x5851F42D4C957E00
#: Keys in one task's table of counts before it hands them on.
HELD = 1 << 21


def _tokens(part, text: int, hasher: Hasher):
    """row, number, tail of each token of a slice; each text's last token is its end. A number is a hash above the tail."""
    buf, offsets = column_bytes(part.column(text))
    buf = lower_ascii(buf)
    starts, ends = word_bounds(buf, offsets)
    row = rows_of(offsets, starts)
    h = word_hashes(buf, starts, ends, hasher)
    last = [np.where(ends - starts >= k, buf[np.maximum(ends - k, 0)], 0).astype(np.int64) for k in (1, 2, 3)]
    tail = ((last[0] * 65599 + last[1] * 257 + last[2]) * 40503 >> 4) % (TAILS - 1) + 1
    n = np.bincount(row, minlength=part.num_rows)
    at = np.arange(len(h)) + row
    out_row = np.repeat(np.arange(part.num_rows), n + 1)
    out_h = np.full(len(h) + part.num_rows, END, np.uint64)
    out_tail = np.zeros(len(out_h), np.int64)
    out_h[at], out_tail[at] = (h & ~np.uint64(TAILS - 1)) | tail.astype(np.uint64), tail
    return out_row, out_h, out_tail


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values[order], at) if len(at) else values[:0]


def _counted(docs: DataFrame, text_col: str, keys) -> DataFrame:
    """(k, n): how often each number occurs that keys(row, h, tail) gives for the tokens of docs."""
    import pyarrow as pa

    def run(batches):
        hasher, held, some = Hasher(), [], 0

        def merged():
            return _sum_by(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))

        def rows():
            k, v = merged() if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held.clear()
            for at in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], ["k", "n"])

        for b in batches:
            for part in slices(b, 0):
                k = keys(*_tokens(part, 0, hasher))
                held.append(_sum_by(k, np.ones(len(k), np.int64)))
                some += len(held[-1][0])
                if some > HELD:
                    held[:] = [merged()]
                    some = len(held[0][0])
                    if some > HELD // 2:
                        yield from rows()
                        some = 0
        yield from rows()

    got = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "k long, n long")
    return durable(got.groupBy("k").agg(F.sum("n").alias("n")))


def word_counts(docs: DataFrame, text_col: str) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """Of all tokens of docs: words (h, c); how often tails stand within two tokens of each other; the OWN most frequent words."""
    words = _counted(docs, text_col, lambda row, h, tail: h.view(np.int64)).select(F.col("k").alias("h"), F.col("n").alias("c"))

    def near(row, h, tail):
        return np.concatenate([(tail[:-d] * TAILS + tail[d:])[row[:-d] == row[d:]] for d in (1, 2)])

    got = _counted(docs, text_col, near).toArrow()  # TAILS**2 rows at most
    both = np.zeros(TAILS * TAILS)
    both[got["k"].to_numpy()] = got["n"].to_numpy()
    end = int(np.uint64(END).view(np.int64))
    top = words.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(OWN).collect()
    return words, both.reshape(TAILS, TAILS) + both.reshape(TAILS, TAILS).T, [(r["h"], r["c"]) for r in top]


def learned_classes(near: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The class of each tail: tails 1.. are clustered by what stands near them, tail 0 is class 0."""
    n = near.sum(1) + 1
    apart = np.where(near > 0, np.log((near + 0.5) * near.sum() / (n[:, None] * n[None] + 1) + 1e-12), 0)
    u, s, _ = np.linalg.svd(np.clip(apart, -3, 3) * np.sqrt(n / n.sum())[None], full_matrices=False)
    place = u[:, :6] * s[:6]
    place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-9
    centres = place[1 + np.argsort(-n[1:], kind="stable")[: CLASSES - 1]]
    for _ in range(rounds):
        label = (place @ centres.T).argmax(1)
        for c in range(CLASSES - 1):
            if (own := label == c).any():
                mean = (place[own] * np.sqrt(n[own])[:, None]).sum(0)
                centres[c] = mean / (np.linalg.norm(mean) + 1e-9)
    out = label + 1
    out[0] = 0
    return out


class Vocabulary:
    """Which bucket and class a token has, and its context."""

    def __init__(self, classes: np.ndarray, own: list[tuple[int, int]]):
        self.own = np.sort(np.array([h for h, _ in own], np.int64).view(np.uint64))
        self.classes = np.zeros(BUCKETS, np.int64)
        self.classes[:TAILS] = classes
        self.classes[TAILS : TAILS + len(own)] = classes[(self.own & np.uint64(TAILS - 1)).astype(np.int64)]

    def buckets(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return tail
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, TAILS + at, tail)

    def contexts(self, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """(the previous word's place in PREVIOUS) * CLASSES + the class that prevails among the BACK words before; 0s where a text begins."""
        one, kind = np.zeros(len(bucket), np.int64), self.classes[bucket].astype(np.int16)
        one[1:] = np.where(row[1:] == row[:-1], bucket[:-1] % (PREVIOUS - 1) + 1, 0)
        past = np.zeros((BACK, len(bucket)), np.int16)
        for j in range(1, min(BACK, len(bucket) - 1) + 1):
            past[j - 1, j:] = np.where(row[j:] == row[:-j], kind[:-j], 0)
        best = np.zeros(len(bucket), np.int16)
        for own in past:  # most votes first, then the lowest class
            votes = (past == own).sum(0, dtype=np.int16)
            best = np.maximum(best, np.where(own > 0, votes * CLASSES + (CLASSES - 1 - own), 0))
        return one * CLASSES + np.where(best > 0, CLASSES - 1 - best % CLASSES, 0)


#: Rows of weights of each kind of feature: bias, previous word, prevailing class.
SIZES = (1, PREVIOUS, CLASSES)


def _features(context: np.ndarray) -> list[np.ndarray]:
    return [np.zeros(len(context), np.int64), context // CLASSES, context % CLASSES]


def _log_softmax(arrays: list[np.ndarray], context: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities by context, over all columns of the weights or within each group of columns."""
    z = sum(w[f] for w, f in zip(arrays, _features(context), strict=True))
    if groups is None:
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1]))
    sizes = np.diff(np.append(starts, len(order)))
    z = z[:, order]
    z -= np.repeat(np.maximum.reduceat(z, starts, axis=1), sizes, axis=1)
    z -= np.repeat(np.log(np.add.reduceat(np.exp(z), starts, axis=1)), sizes, axis=1)
    return z[:, np.argsort(order, kind="stable")]


def log_probabilities(weights: list[np.ndarray], context: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context) * P(bucket | class, context) for all buckets; weights have CLASSES columns, then BUCKETS."""
    first = _log_softmax([w[:, :CLASSES] for w in weights], context)
    return first[:, classes] + _log_softmax([w[:, CLASSES:] for w in weights], context, classes)


def _sums(classes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Counts of buckets by row as counts of classes."""
    out = np.zeros((CLASSES, len(y)), y.dtype)
    np.add.at(out, classes, y.T)
    return out.T


def train(seen: DataFrame, mass: np.ndarray, classes: np.ndarray, steps: int = STEPS, rate: float = RATE) -> list[np.ndarray]:
    """Weights from (context, bucket, n), starting at the shares of classes and buckets.

    In each step the tasks work out observed and expected counts of their contexts,
    which are added up by feature value. Their difference is the gradient; each
    weight's step is scaled by the larger of the two counts.
    """
    import pyarrow as pa

    spark = seen.sparkSession
    by_context = durable(seen.groupBy("context").agg(F.collect_list(F.struct("bucket", "n")).alias("seen")).repartition(F.floor(F.col("context") / CLASSES)))
    starts, width = np.concatenate([[0], np.cumsum(SIZES)]), CLASSES + BUCKETS
    weights = np.zeros((starts[-1], width))
    share = np.maximum(mass, 1e-12)
    weights[0] = np.log(np.concatenate([np.maximum(np.bincount(classes, share, CLASSES), 1e-12), share]))
    momentum = np.zeros_like(weights)
    split = lambda w: [w[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def add(table):
        g = np.zeros(2 * width)
        for v in table["g"]:
            g += np.frombuffer(v.as_buffer(), np.float32)
        return pa.table({"f": table["f"].slice(0, 1), "g": pa.array([g.astype(np.float32).tobytes()], pa.binary())})

    for _ in range(steps):
        sent = spark.sparkContext.broadcast(split(weights.astype(np.float32)))

        def gradient(batches, sent=sent):
            total = {}
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    context, items = part.column(0).to_numpy(), part.column(1)
                    where = np.repeat(np.arange(len(context)), np.diff(items.offsets.to_numpy()))
                    y = np.zeros((len(context), BUCKETS), np.float32)
                    y[where, items.flatten().field(0).to_numpy()] = items.flatten().field(1).to_numpy()
                    kinds = _sums(classes, y)
                    n = kinds.sum(1, keepdims=True)
                    first = n * np.exp(_log_softmax([w[:, :CLASSES] for w in sent.value], context))
                    inside = kinds[:, classes] * np.exp(_log_softmax([w[:, CLASSES:] for w in sent.value], context, classes))
                    g = np.concatenate([kinds, y, first, inside], 1).astype(np.float32)
                    for base, f in zip(starts, _features(context), strict=False):
                        for value in np.unique(f).tolist():
                            add_to = total.setdefault(int(base) + value, np.zeros(2 * width, np.float32))
                            add_to += g[f == value].sum(0)
            for f, g in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([g.tobytes()], pa.binary())], ["f", "g"])

        got = by_context.mapInArrow(gradient, "f long, g binary").groupBy("f").applyInArrow(add, "f long, g binary").toArrow()  # a row for each row of weights
        sent.unpersist()
        if not len(got):
            break
        g = np.array([np.frombuffer(v.as_buffer(), np.float32) for v in got["g"]], np.float64)
        observed, expected = g[:, :width], g[:, width:]
        momentum *= MOMENTUM
        momentum[got["f"].to_numpy()] += rate * (observed - expected) / (np.maximum(observed, expected) + DAMP)
        weights += momentum
    return split(weights.astype(np.float32))


#: The model's log probabilities by context and bucket, in the process that last used it.
_ready: dict[str, np.ndarray] = {}


def _table(name: str, weights: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    if name not in _ready:
        _ready.clear()
        table = np.empty((PREVIOUS * CLASSES, BUCKETS), np.float32)
        for at in range(0, len(table), 512):
            table[at : at + 512] = log_probabilities(weights, np.arange(at, at + 512), classes)
        _ready[name] = table
    return _ready[name]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held_out: int = 2, steps: int = STEPS) -> DataFrame:
    """Score every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id, modulo folds, is not held_out; a
    null id counts as the empty text. Null and empty texts consist of their end
    alone. Rows that repeat an id are scored each by its own text. If no row is
    left to learn from, counts are 0 and every bucket of a class is as likely. An
    empty table gives no rows. Other columns are not read.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    training = docs.where(fold_of(id_col, folds) != held_out)
    words, near, own = word_counts(training, text_col)
    classes = learned_classes(near)
    known = Vocabulary(classes, own)
    seen = _counted(training, text_col, lambda row, h, tail: known.contexts(row, b := known.buckets(h, tail)) * BUCKETS + b)
    seen = seen.select((F.col("k") / BUCKETS).cast("long").alias("context"), F.expr(f"cast(k % {BUCKETS} as int)").alias("bucket"), "n")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = totals["n"], totals["v"]
    mass = np.ones(BUCKETS)
    for r in seen.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        mass[r["bucket"]] += r["n"]
    # of a tail's words, each has its count and 1 more, and all unknown ones have 1; words with buckets of their own are left out
    words_of = np.zeros(TAILS)
    for r in words.groupBy((F.col("h").bitwiseAND(TAILS - 1)).cast("int").alias("tail")).agg(F.count("*").alias("n")).collect():  # TAILS rows at most
        words_of[r["tail"]] = r["n"]
    np.subtract.at(words_of, (known.own & np.uint64(TAILS - 1)).astype(np.int64), 1)
    in_bucket = np.append(np.log10(mass[:TAILS] + words_of), np.zeros(OWN))
    in_bucket[0] = np.log10(mass[0])
    at_own = dict(own)
    in_bucket[TAILS : TAILS + len(own)] = [math.log10(at_own[h] + 1) for h in known.own.view(np.int64).tolist()]
    least = max(1, -(-n_all // FREQUENT))
    top = words.where(F.col("c") >= least).toArrow()
    top_h, top_c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(top_h)
    top_h, top_log = top_h[order], np.log10(top_c[order] + 1.0)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, train(seen, mass / mass.sum(), known.classes, steps), known, top_h, top_log, in_bucket))

    def run(batches):
        name, weights, known, top_h, top_log, in_bucket = model.value
        table = _table(name, weights, known.classes)
        hasher, uid = Hasher(), TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, 2):
                row, h, tail = _tokens(part, 2, hasher)
                bucket = known.buckets(h, tail)
                logp = table[known.contexts(row, bucket), bucket] / math.log(10) - in_bucket[bucket]
                seen, logc = np.zeros(len(h), bool), np.zeros(len(h))
                if len(top_h):
                    at = np.minimum(np.searchsorted(top_h, h), len(top_h) - 1)
                    seen = top_h[at] == h
                    logc = np.where(seen, top_log[at], 0.0)
                add = lambda v, row=row, m=part.num_rows: np.bincount(row, v, m)
                cuts = np.searchsorted(row[~seen], np.arange(part.num_rows + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[~seen].view(np.int64)))
                uids = uid + np.arange(part.num_rows)
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(uids), pa.array(add(None).astype(np.int64)), pa.array(add(seen).astype(np.int64)), pa.array(add(logp)), pa.array(add(logc)), rare],
                    ["id", "held_out", "uid", "n_tokens", "known", "logp", "logc", "rare"],
                )

    rows = docs.select(F.col(id_col).alias("id"), (fold_of(id_col, folds) == held_out).alias("held_out"), text_or_empty(text_col).alias("text"))
    rows = durable(rows.mapInArrow(run, f"id {kind_of_id}, held_out boolean, uid long, n_tokens long, known long, logp double, logc double, rare array<long>"))
    # words too rare for the tasks' own table are looked up in the counts
    rare = rows.select("uid", F.explode("rare").alias("h")).join(words.where(F.col("c") < least), "h")
    rare = rare.groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_log"))
    out = rows.drop("rare").join(rare, "uid", "left")
    logc = F.col("logc") + F.coalesce("more_log", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (logc - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"),
        (logc + F.col("logp")).alias("score"),
    )
