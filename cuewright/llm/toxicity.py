"""Toxicity classifier with counterfactual regularisation.

A logistic model over indicators of words and their first bytes. For each
labelled text that mentions terms of an identity group, texts with the terms
swapped for others of their group are made. A mention is put into every sampled text
besides, the text with it is set against the text without, and against the same text
with other terms of the group. Differences between the scores of a text and its
counterfactuals are penalised, so that a mention as such says nothing, not even by
beginnings that a term shares with other words. The terms' own indicators are always
in the model.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Hasher, column_bytes, durable, lower_ascii, mix, rows_of, slices, word_bounds, word_hashes
from .linear import SAMPLE, count_indicators, distinct, labelled, sample, scored, sigmoid

SIZE = 1 << 18
#: Lengths in bytes of the beginnings that count as indicators beside whole words.
STEMS = (3, 4, 5, 6, 7, 8)
#: Indicators that the model keeps: those whose share differs most between the classes.
KEPT = 2048
#: Standard errors by which a kept indicator's shares differ at least.
LEAST = 4.0
PENALTY, RIDGE, STEPS = 1.0, 1e-4, 400
THRESHOLD = 0.3
# Identity terms by group; a term is swapped for the others of its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("woman", "man"),
    ("women", "men"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("disabled", "deaf", "blind"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("frauen", "männer"),
    ("ausländer", "flüchtlinge", "deutsche"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("femmes", "hommes"),
    ("immigrés", "réfugiés", "citoyens"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("mujeres", "hombres"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)
#: Counterfactuals made of a text, at most.
SWAPS = 2
#: Words that are looked at for groups beside the listed ones, the most frequent first; the share of the sampled texts that hold one at least.
LOOKED_AT, FREQUENT = 96, 0.02
#: A found term's share in one class is at most so many times its share in the other: more, and the word itself may be abuse.
EVEN = 3.0
#: Hash buckets of the words before and after; the least cosine of two words' places in one group; terms of a group, at most.
PLACES, ALIKE, TERMS = 64, 0.6, 6


def _trimmed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without ASCII punctuation at the sides; a word of nothing else is empty."""
    odd = np.zeros(256, bool)
    odd[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    starts, ends = starts.copy(), ends.copy()
    for edge, step, at in ((starts, 1, 0), (ends, -1, -1)):
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[starts[todo] < ends[todo]]
            todo = todo[odd[buf[edge[todo] + at]]]
            edge[todo] += step
    return starts, ends


def word_features(part, column: int):
    """Feature numbers of each row's words and their stems, in lower case (A-Z) without punctuation around."""
    buf, offsets = column_bytes(part.column(column))
    buf = lower_ascii(buf)
    starts, ends = word_bounds(buf, offsets)
    row = rows_of(offsets, starts)
    starts, ends = _trimmed(buf, starts, ends)
    use = starts < ends
    row, starts, ends = row[use], starts[use], ends[use]
    hasher = Hasher()
    columns = [word_hashes(buf, starts, ends, hasher)]
    for k in STEMS:
        stem = mix(word_hashes(buf, starts, np.minimum(ends, starts + k), hasher) + np.uint64(k))
        columns.append(np.where(ends - starts > k, stem, columns[0]))
    f = (np.stack(columns, 1) % np.uint64(SIZE)).astype(np.int64)
    cut = np.searchsorted(row, np.arange(part.num_rows + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield f[a:b].ravel()


def counterfactuals(text: str, identity=IDENTITY, swaps: int = SWAPS) -> list[str]:
    """Up to `swaps` versions of a text with each identity term moved on within its group; none without terms.

    Version k moves a term on by k places of its group; what comes back to itself stays as it is written.
    """
    return _swapper(identity, swaps)(text)


def _swapper(identity, swaps: int):
    import re

    groups = {t: g for g in identity if len(g) > 1 for t in g}
    if not groups:
        return lambda text: []
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, groups), key=len, reverse=True)) + r")\b", re.I)

    def moved(text: str, step: int) -> str:
        def other(m):
            g = groups.get(m[0].lower())
            return m[0] if g is None or step % len(g) == 0 else g[(g.index(m[0].lower()) + step) % len(g)]

        return pattern.sub(other, text)

    def make(text: str) -> list[str]:
        if not pattern.search(text):
            return []
        return [v for v in dict.fromkeys(moved(text, k) for k in range(1, swaps + 1)) if v.lower() != text.lower()]

    return make


def found_groups(rows: DataFrame) -> list[tuple[str, ...]]:
    """Groups of interchangeable words in labelled rows (id, y, text): a bounded sample of texts, read twice.

    Of the LOOKED_AT most frequent words that are in FREQUENT of the texts, with
    shares in the classes that differ by the factor EVEN at most, those are grouped
    whose neighbours, over PLACES buckets at either side, have a cosine of ALIKE.
    """
    import pyarrow as pa

    plain = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), 0), lambda w: F.lower(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return []
    share = [(F.count_if(F.col("y") == y) + 1) / F.lit(float(total[y] + 1)) for y in (0, 1)]
    seen = rows.select("y", F.explode(plain).alias("w")).groupBy("w").agg(F.count("*").alias("n"), (share[1] / share[0]).alias("r"))
    few = max(2, FREQUENT * sum(total.values()))
    terms = [r["w"] for r in seen.where((F.length("w") > 1) & (F.col("n") >= few) & F.col("r").between(1 / EVEN, EVEN)).orderBy(F.desc("n"), "w").limit(LOOKED_AT).collect()]
    if len(terms) < 2:
        return []

    def run(batches):
        at, n = {t: i for i, t in enumerate(terms)}, np.zeros((len(terms), 2, PLACES))
        for b in batches:
            for text in b.column(0).to_pylist():
                words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for w in text.split()]
                place = [at.get(w, -1) for w in words]
                bucket = [sum(w.encode()[-3:]) % PLACES for w in words]
                for k, i in enumerate(place):
                    if i >= 0:
                        if k:
                            n[i, 0, bucket[k - 1]] += 1
                        if k + 1 < len(words):
                            n[i, 1, bucket[k + 1]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], ["n"])

    got = rows.select("text").mapInArrow(run, "n binary").collect()  # a row of fixed size from each task
    n = sum((np.frombuffer(r["n"], np.float64) for r in got), np.zeros(len(terms) * 2 * PLACES)).reshape(len(terms), -1)
    n = np.log1p(n) - np.log1p(n).mean(1, keepdims=True)
    n /= np.sqrt((n**2).sum(1, keepdims=True)) + 1e-9
    alike, left, out = n @ n.T, list(range(len(terms))), []
    while left:  # the most frequent word takes those most like it
        i = left.pop(0)
        near = sorted((j for j in left if alike[i, j] >= ALIKE), key=lambda j: -alike[i, j])[: TERMS - 1]
        left = [j for j in left if j not in near]
        if near:
            out.append(tuple(terms[j] for j in (i, *near)))
    return out


def select(n: np.ndarray, total: np.ndarray, kept: int = KEPT, least: float = LEAST) -> np.ndarray:
    """Numbers of the indicators whose shares differ most in standard errors, and by `least` of them."""
    share = n.sum(0) / total.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / total[0] + 1 / total[1]))
    z = np.where(n.sum(0) >= 3, np.abs(n[1] / total[1] - n[0] / total[0]) / error, 0)
    best = np.argsort(-z, kind="stable")[:kept]
    return np.sort(best[z[best] >= least])


class Rows:
    """Sparse rows: entries (row, column, value)."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, width: int):
        self.row, self.column, self.value, self.n, self.width = row, column, value.astype(np.float32), n, width

    @classmethod
    def of(cls, x: np.ndarray) -> Rows:
        row, column = np.nonzero(x)
        return cls(row, column, x[row, column], *x.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def across(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)

    def squares(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value**2 * r[self.row], self.width)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: np.ndarray, other: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by fitted(), where row pairs[k] of x has the counterfactual other[k]."""
    return fitted(Rows.of(x), y, weight, Rows.of(x[pairs] - other), penalty, steps)


def fitted(x: Rows, y: np.ndarray, weight: np.ndarray, apart: Rows, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of least log loss, ridge and counterfactual penalty, by accelerated gradient steps.

    apart has texts less their counterfactuals; the penalty is the mean squared
    difference of the margins. Columns are scaled by their curvature, and the step
    follows from the largest curvature that is left, so it can't diverge.
    """
    weight = weight / max(weight.sum(), 1e-12)
    share = np.full(apart.n, 2 * penalty / max(1, apart.n))
    scale = 1 / np.sqrt(np.append(x.squares(weight) / 4 + apart.squares(share) + RIDGE, 0.25))  # the last one is the bias

    def bent(v):  # a bound of the curvature along v
        w = scale * v
        r = weight * (x.times(w[:-1]) + w[-1]) / 4
        return scale * np.append(x.across(r) + apart.across(share * apart.times(w[:-1])) + RIDGE * w[:-1], r.sum())

    def slope(v):
        w = scale * v
        r = weight * (sigmoid(x.times(w[:-1]) + w[-1]) - y)
        return scale * np.append(x.across(r) + apart.across(share * apart.times(w[:-1])) + RIDGE * w[:-1], r.sum())

    v = np.ones(x.width + 1) / np.sqrt(x.width + 1)
    for _ in range(30):
        u = bent(v)
        most = np.sqrt((u**2).sum())
        v = u / max(most, 1e-12)
    rate = 1 / (1.1 * most)
    at = before = np.zeros(x.width + 1)
    t = 1.0
    for _ in range(steps):
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = at + (last - 1) / t * (at - before)
        g = slope(ahead)
        before, at = at, ahead - rate * g
        if g @ (at - before) > 0:  # it overshot: start anew from here
            t = 1.0
        if np.abs(g).max() < 1e-7:
            break
    w = scale * at
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Kept indicators, their weights and the bias, None if a class is missing; the share of label 1; the groups,
    how many sampled texts mention a term of them, and how many counterfactuals differ in a kept indicator, inserted mentions included."""

    kept: np.ndarray | None
    weights: np.ndarray | None
    bias: float
    share: float
    groups: tuple = ()
    mentioning: int = 0
    differing: int = 0


def _term_indicators(groups) -> list[list[np.ndarray]]:
    """The indicators of each term of each group."""
    import pyarrow as pa

    terms = [t for g in groups for t in g]
    found = iter(list(word_features(pa.record_batch([pa.array(terms, pa.string())], ["t"]), 0)))
    return [[np.unique(next(found)) for _ in g] for g in groups]


def _inserted(text: str, own: np.ndarray, terms: list[list[np.ndarray]], swaps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a text without and with a mention, and with that and another term of its group, as their indicators.

    The text picks the group and the term by its checksum. A word more adds its own
    indicators to a text's, whatever else is in it.
    """
    at = crc32(text.encode())
    group = terms[at % len(terms)]
    first = at // len(terms) % len(group)
    mention = np.union1d(own, group[first])
    others = [np.union1d(own, group[(first + k) % len(group)]) for k in range(1, min(swaps, len(group) - 1) + 1)]
    return [(own, mention), *((mention, o) for o in others)]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, folds: int = 4, held_out: int = 2, size: int = SAMPLE, identity=None, penalty: float = PENALTY, swaps: int = SWAPS) -> Model:
    """The model of classify().

    Indicators are chosen from the counts of all labelled documents outside the
    held-out fold; those of identity terms come to them. Weights come from at most
    `size` of each class: each text's kept indicators, and those in which its
    counterfactuals differ, are worked out where the text lies, and only these go to
    the task that fits the weights. identity=None takes IDENTITY; other groups, such
    as those of found_groups(), are taken in its place. A term that several groups
    have counts in the last of them.
    """
    import pyarrow as pa

    rows = labelled(docs, labels, label_col, id_col, text_col, folds, held_out)
    n, total = count_indicators(rows, word_features, SIZE)
    if not total.all():
        return Model(None, None, 0.0, float(total[1] / total.sum()) if total.sum() else 0.5)
    groups = IDENTITY if identity is None else tuple(g for g in identity if g)
    terms = _term_indicators(groups)
    kept = np.union1d(select(n, total), np.concatenate([t for g in terms for t in g] or [np.zeros(0, np.int64)])).astype(np.int64)
    some = durable(sample(rows, size))

    def indicators(batches):
        place, stamp, swapped = np.full(SIZE, -1), np.zeros(SIZE, np.int64), _swapper(groups, swaps)
        place[kept] = np.arange(len(kept))

        def own(texts):
            part = pa.record_batch([pa.array(texts, pa.string())], ["text"])
            at = (place[distinct(f, stamp)] for piece in slices(part, 0) for f in word_features(piece, 0))
            return [np.sort(a[a >= 0]).astype(np.int16) for a in at]

        put = [[np.unique(place[t]).astype(np.int16) for t in g] for g in terms]
        # of each counterfactual: what it lacks, and as ~number what it has besides
        apart = lambda a, b: np.concatenate([np.setdiff1d(a, b), ~np.setdiff1d(b, a)]).tobytes()

        for b in batches:
            for part in slices(b, 2):
                texts = part.column(2).to_pylist()
                other = [swapped(t) for t in texts]
                mine, theirs = own(texts), iter(own([t for ts in other for t in ts]))
                diffs = [[apart(m, t) for t in (next(theirs) for _ in ts)] + ([apart(a, b) for a, b in _inserted(text, m, put, swaps)] if put else []) for text, m, ts in zip(texts, mine, other, strict=True)]
                mentions = pa.array([bool(ts) for ts in other])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m.tobytes() for m in mine], pa.binary()), pa.array(diffs, pa.list_(pa.binary())), mentions], ["id", "y", "own", "apart", "mentions"])

    def joined(parts, value):
        sizes = np.array([len(p) for p in parts], np.int64)
        got = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return Rows(np.repeat(np.arange(len(parts)), sizes), np.where(got < 0, ~got, got), value(got), len(parts), len(kept))

    def learn(table):
        table = table.sort_by([("id", "ascending"), ("y", "ascending")])
        y = table["y"].to_numpy().astype(np.float64)
        load = lambda v: np.frombuffer(v, np.int16)
        x = joined([load(v) for v in table["own"].to_pylist()], lambda f: np.ones(len(f)))
        pairs = [load(v) for vs in table["apart"].to_pylist() for v in vs]
        apart = joined(pairs, lambda f: np.where(f < 0, -1.0, 1.0))
        weight = (total / total.sum() / np.maximum(np.bincount(y.astype(int), minlength=2), 1))[y.astype(int)]
        w, bias = fitted(x, y, weight, apart, penalty)
        mentioning = sum(table["mentions"].to_pylist())
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "bias": [bias], "mentioning": [mentioning], "differing": [sum(bool(len(p)) for p in pairs)]})

    kind = rows.schema["id"].dataType.simpleString()
    vectors = some.mapInArrow(indicators, f"id {kind}, y int, own binary, apart array<binary>, mentions boolean")
    got = vectors.groupBy().applyInArrow(learn, "w binary, bias double, mentioning long, differing long").first()
    return Model(kept, np.frombuffer(got["w"], np.float64), got["bias"], float(total[1] / total.sum()), groups, got["mentioning"], got["differing"])


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Score every text for toxicity: doc_id, held_out, score, predicted.

    Learns from labelled documents whose crc32 of the id, modulo folds, is not
    held_out; see fit() for the options. The score is the probability of label 1,
    from the text alone; an empty or null text gets the score of no indicators. If
    a class has no labelled document, every score is the share of label 1, or 0.5
    without labels. Null ids are scored, and not learned from; rows that repeat an
    id are scored each by its own text. An empty table gives no rows. Other columns
    are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col, folds=folds, held_out=held_out, **options))
    return scored(docs, id_col, text_col, folds, held_out, threshold, _scorer(sent))


def _scorer(sent):
    def scorer():
        model = sent.value
        stamp, table = np.zeros(SIZE, np.int64), np.zeros(SIZE)
        if model.kept is not None:
            table[model.kept] = model.weights

        def score(part, column):
            if model.kept is None:
                return np.full(part.num_rows, model.share)
            return sigmoid(model.bias + np.array([table[distinct(f, stamp)].sum() for f in word_features(part, column)]))

        return score

    return scorer


def clean(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rows that score `threshold` or more, with all columns; see classify()."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, id_col, text_col, **options))
    make, at = _scorer(sent), docs.columns.index(text_col)

    def run(batches):
        score = make()
        for b in batches:
            for part in slices(b, at):
                yield part.filter(pa.array(score(part, at) < threshold))

    return docs.mapInArrow(run, docs.schema)
