import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuewright.llm import lm_scoring, quality, toxicity

DOCS = "doc_id long, text string, h long, y int, part string"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 5, "p") for i, t in rows], DOCS)


def prose(n, seed=1):
    r = random.Random(seed)
    tongues = [[f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"], [f"{a}{b}eau" for a in "lmnpr" for b in "aeiou"]]
    return [(i, " ".join(r.choice(tongues[i % 2]) for _ in range(r.randint(5, 60)))) for i in range(n)]


def fold(i, n):
    return zlib.crc32(str(i).encode() if i is not None else b"") % n


def test_lm_counts_and_base_score(spark):
    rows = prose(60) + [(100, None), (101, ""), (102, "Bading\tBADING ÄH"), (103, "never seen words"), (104, "twice"), (104, "twice over"), (None, "bading")]
    got = lm_scoring.score(frame(spark, rows)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if fold(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, fold(i, 7) == 2, len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_looks_up_words_too_rare_for_tasks(spark, monkeypatch):
    rows = prose(40)
    all_known = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows)).collect()}
    monkeypatch.setattr(lm_scoring, "FREQUENT", 16)
    for r in lm_scoring.score(frame(spark, rows)).collect():
        w = all_known[r.doc_id]
        assert (r.n_known, r.n_tokens) == (w.n_known, w.n_tokens) and r.score == pytest.approx(w.score) and r.base_score == pytest.approx(w.base_score)


def test_lm_learns_from_the_words_before(spark):
    got = lm_scoring.score(frame(spark, prose(300))).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.05 * sum(r.n_tokens for r in got)


def test_class_probabilities_add_up_to_one():
    r = np.random.default_rng(0)
    arrays = [r.normal(size=(n, lm_scoring.CLASSES)) for n in lm_scoring.SIZES]
    z = lm_scoring._log_softmax(arrays, np.arange(0, 16384, 37))
    assert np.allclose(np.exp(z).sum(1), 1)


def test_scores_match_a_dictionary_model(spark, monkeypatch):
    """The whole score, token by token in plain Python, from the same weights and classes."""
    L = lm_scoring
    rng = np.random.default_rng(3)
    classes = np.append(0, rng.integers(1, L.CLASSES, L.TAILS - 1))
    weights = [rng.normal(size=(n, L.CLASSES + L.BUCKETS)).astype(np.float32) for n in L.SIZES]
    monkeypatch.setattr(L, "learned_classes", lambda near: classes)
    monkeypatch.setattr(L, "train", lambda *a, **k: weights)
    r = random.Random(8)
    rows = [(i, " ".join(f"{r.choice('bcdfg')}{r.randrange(900)}{r.choice('xyz')}" for _ in range(r.randint(5, 40)))) for i in range(60)] + [(100, None), (101, "One tail"), (102, "a bb ccc a bb"), (103, " ".join(["bading"] * 30))]
    got = {r.doc_id: r for r in L.score(frame(spark, rows)).collect()}

    def tail(w):
        b = w.encode()
        x, y, z = (b[-k] if len(b) >= k else 0 for k in (1, 2, 3))
        return ((x * 65599 + y * 257 + z) * 40503 >> 4) % (L.TAILS - 1) + 1

    texts = {i: (t or "").lower().split() for i, t in rows}
    seen = Counter(w for i, ws in texts.items() if fold(i, 7) != 2 for w in [*ws, None])
    hashes = {w: int(h) for w in seen if w is not None for h in [L.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), L.Hasher()).view(np.int64)[0] & ~(L.TAILS - 1) | tail(w)]}
    own = sorted((w for w in seen if w is not None), key=lambda w: (-seen[w], hashes[w]))[: L.OWN]
    assert len(own) == L.OWN < len(hashes)
    own.sort(key=lambda w: hashes[w] % 2**64)
    place = {w: L.TAILS + k for k, w in enumerate(own)}
    bucket = lambda w: 0 if w is None else place.get(w) or tail(w)
    kind = {b: int(classes[b]) for b in range(L.TAILS)} | {b: int(classes[tail(w)]) for w, b in place.items()}
    members = {c: [b for b in kind if kind[b] == c] for c in range(L.CLASSES)}
    mass = Counter()
    for w, c in seen.items():
        mass[bucket(w)] += c + 1
    for i, ws in texts.items():
        total = 0.0
        for k, w in enumerate([*ws, None]):
            votes = Counter(kind[bucket(v)] for v in ws[max(0, k - L.BACK) : k])
            votes.pop(0, None)
            context = ((bucket(ws[k - 1]) % (L.PREVIOUS - 1) + 1) if k else 0, min(votes, key=lambda c: (-votes[c], c)) if votes else 0)
            z = lambda j, context=context: float(weights[0][0, j]) + float(weights[1][context[0], j]) + float(weights[2][context[1], j])
            b = bucket(w)
            p = math.exp(z(kind[b])) / sum(math.exp(z(c)) for c in range(L.CLASSES))
            p *= math.exp(z(L.CLASSES + b)) / sum(math.exp(z(L.CLASSES + x)) for x in members[kind[b]])
            if b and b < L.TAILS:
                p *= (seen[w] + 1) / (mass[b] + 1)
            total += math.log10(p)
        assert got[i].score == pytest.approx(total, abs=1e-3 * max(1, len(ws)))


def test_word_probabilities_stay_below_one():
    """Over all buckets of a context the model's probabilities add up to 1, for each class of its own too."""
    rng = np.random.default_rng(0)
    classes = rng.integers(0, lm_scoring.CLASSES, lm_scoring.BUCKETS)
    classes[: lm_scoring.CLASSES] = np.arange(lm_scoring.CLASSES)
    weights = [rng.normal(size=(n, lm_scoring.CLASSES + lm_scoring.BUCKETS)) for n in lm_scoring.SIZES]
    p = np.exp(lm_scoring.log_probabilities(weights, np.arange(0, 16384, 977), classes))
    assert np.allclose(p.sum(1), 1)


def test_lm_gains_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = lm_scoring.score(docs).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert held["sum(score)"] - held["sum(base_score)"] > 0.15 * held["sum(n_tokens)"]


def test_lm_of_nothing(spark):
    assert lm_scoring.score(frame(spark, [])).collect() == []


def test_descent_separates():
    r = np.random.default_rng(1)
    x = [np.unique(np.append(r.integers(10, 200, 20), 3 if k % 2 else 7)) for k in range(200)]
    y = np.where(np.arange(200) % 2, 1, -1)
    ratio = np.full(200, 0.1)
    ratio[3], ratio[7] = 2.0, -2.0
    w, bias = quality.descend(x, y, ratio)
    margin = np.array([(w[f] * ratio[f]).sum() / np.sqrt((ratio[f] ** 2).sum()) + bias for f in x])
    assert ((margin > 0) == (y > 0)).all()


def labelled(spark, make, n=240):
    rows = [(i, make(i, i % 3 == 0)) for i in range(n)]
    marks = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)] + [(None, 1, 1), (5, None, None), (10**9, 1, 0)], LABELS)
    return rows, marks


def accuracy(rows, got, want):
    by = {r.doc_id: r.predicted for r in got if r.held_out}
    return np.mean([by[i] == want(i) for i, _ in rows if i in by])


def test_quality_on_held_out_rows(spark):
    r = random.Random(2)
    junk = lambda words: " ".join(w + "$$$" for w in words)
    rows, marks = labelled(spark, lambda i, bad: (junk if bad else " ".join)([r.choice(["apple", "pear", "plum", "fig"]) for _ in range(30)]))
    extra = [(None, "apple"), (900, None), (901, ""), (3, "again")]
    got = quality.classify(frame(spark, rows + extra), marks).collect()
    assert len(got) == len(rows) + 4 and all(0 <= x.score <= 1 for x in got)
    assert all(x.predicted == int(x.score >= 0.3) and x.held_out == (fold(x.doc_id, 5) == 0) for x in got)
    assert accuracy([x for x in rows if x[0] != 3], got, lambda i: int(i % 3 != 0)) > 0.95


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    words = ["apple", "pear", "plum", "fig", "the", "of"]
    rows, marks = labelled(spark, lambda i, bad: " ".join([r.choice(words) for _ in range(30)] + (["Idiot!", "scum,"] if bad else [])))
    got = toxicity.classify(frame(spark, [*rows, (900, None), (901, "")]), marks).collect()
    assert all(x.held_out == (fold(x.doc_id, 4) == 2) for x in got)
    assert accuracy(rows, got, lambda i: int(i % 3 == 0)) > 0.95
    left = toxicity.clean(frame(spark, rows), marks)
    assert left.columns == ["doc_id", "text", "h", "y", "part"] and all(x.doc_id % 3 for x in left.collect())


def test_counterfactuals_swap_within_groups():
    assert toxicity.counterfactuals("Muslim women and Men") == ["christian men and women", "jewish women and Men"]
    assert toxicity.counterfactuals("nobody here") == []


def test_penalty_takes_the_weight_off_identity_terms():
    r = np.random.default_rng(0)
    n = 400
    y = (np.arange(n) % 2).astype(float)
    x = np.zeros((n, 3), np.float32)
    x[:, 0] = y  # abuse
    x[:, 1] = np.where(y == 1, r.random(n) < 0.8, r.random(n) < 0.2)  # a group, mentioned in abuse more often
    x[:, 2] = (1 - x[:, 1]) * (r.random(n) < 0.3)  # another group
    pairs = np.flatnonzero(x[:, 1])
    other = x[pairs].copy()
    other[:, 1], other[:, 2] = 0, 1
    plain, _ = toxicity.logistic(x, y, np.ones(n), np.zeros(0, int), other[:0])
    fair, _ = toxicity.logistic(x, y, np.ones(n), pairs, other, penalty=10.0)
    assert abs(fair[1] - fair[2]) < 0.3 * abs(plain[1] - plain[2]) and fair[0] > 1


def mentions(n=600, seed=4):
    """Texts of which toxic ones mention one group far more often than the other; abuse itself is never the mention."""
    r = random.Random(seed)
    fill = [f"{a}{b}lo" for a in "bcdfgprst" for b in "aeiou"]
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [r.choice(fill) for _ in range(14)]
        if bad and r.random() < 0.75:  # the rest is toxic in ways that no word shows
            words.insert(r.randrange(14), r.choice(["scum", "vermin"]))
        group = r.choices(["zarians", "quorians", None], (8, 1, 3) if bad else (2, 4, 6))[0]
        if group:
            words.insert(r.randrange(14), group)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def gap(model):
    """How far apart the model scores neutral texts that differ in the group they mention alone."""
    weight = {f: w for f, w in zip(model.kept.tolist(), model.weights.tolist(), strict=True)}
    a, b = (sum(weight.get(f, 0.0) for f in set(next(iter(toxicity.word_features(pa.record_batch([pa.array([f"some {t} came"])], ["t"]), 0))).tolist())) for t in ("zarians", "quorians"))
    return abs(a - b)


def test_the_penalty_evens_out_neutral_mentions(spark):
    rows, marks = mentions()
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, LABELS)
    groups = (("zarians", "quorians"),)
    plain, fair = (toxicity.fit(docs, labels, identity=groups, penalty=p) for p in (0.0, 20.0))
    assert plain.mentioning == fair.mentioning > 100 and fair.differing > 100
    assert gap(plain) > 0.5 and gap(fair) < 0.3 * gap(plain)
    got = toxicity.classify(docs, labels, identity=groups, penalty=20.0).collect()
    neutral = [x for x in got if x.doc_id % 4]
    text = dict(rows)
    share = lambda t: np.mean([x.predicted for x in neutral if t in text[x.doc_id].split()])
    before = [x for x in toxicity.classify(docs, labels, identity=groups, penalty=0.0).collect() if x.doc_id % 4]
    wrong = np.mean([x.predicted for x in before if "zarians" in text[x.doc_id].split()])
    assert share("zarians") <= 0.5 * wrong and all(x.predicted for x in got if {"scum", "vermin"} & set(text[x.doc_id].split()))


def test_groups_are_found_where_none_is_listed(spark):
    r = random.Random(1)
    names = ["anari", "belori", "cadori"]
    rows = [(i, i % 2, " ".join(f"the {r.choice(names)} said {r.choice('pqrst') * 4} word{r.randrange(500)} of" for _ in range(6))) for i in range(200)]
    groups = toxicity.found_groups(spark.createDataFrame(rows, "id long, y int, text string"))
    assert any(set(names) <= set(g) for g in groups)
    assert toxicity.found_groups(spark.createDataFrame([], "id long, y int, text string")) == []


def test_mentions_are_put_into_texts_that_have_none(spark):
    """Toxic texts hold words that begin like a term; without the penalty a mention of it raises a neutral text's score."""
    r = random.Random(7)
    calm = ["apple", "pear", "plum", "fig", "the", "of", "and", "tree"]
    rows, marks = labelled(spark, lambda i, bad: " ".join([r.choice(calm) for _ in range(25)] + ([r.choice(["muscat", "mustard"])] * 2 if bad else [])))
    docs = frame(spark, rows)
    plain, fair = (toxicity.fit(docs, marks, penalty=p) for p in (0.0, 5.0))
    assert plain.mentioning == fair.mentioning == 0 and fair.differing > 100 and set(fair.groups) == set(toxicity.IDENTITY)

    def rise(model, term):
        table = dict(zip(model.kept.tolist(), model.weights.tolist(), strict=True))
        own = toxicity._term_indicators([(term,)])[0][0]
        assert set(own.tolist()) <= set(table)
        return sum(table[k] for k in own.tolist())

    assert rise(plain, "muslim") > 0.5 and abs(rise(fair, "muslim")) < 0.3 * rise(plain, "muslim")
    got = toxicity.classify(docs, marks, penalty=5.0).collect()
    assert accuracy(rows, got, lambda i: int(i % 3 == 0)) > 0.95


def test_gradient_steps_reach_the_minimum():
    """Against Newton's method on the same loss."""
    r = np.random.default_rng(5)
    x = (r.random((120, 12)) < 0.3).astype(np.float32)
    y = (r.random(120) < 0.4).astype(float)
    weight, pairs = r.random(120), r.integers(0, 120, 30)
    other = (r.random((30, 12)) < 0.3).astype(np.float32)
    w, bias = toxicity.logistic(x, y, weight, pairs, other, penalty=2.0, steps=4000)
    one, d, p = np.hstack([x, np.ones((120, 1))]), np.hstack([x[pairs] - other, np.zeros((30, 1))]), weight / weight.sum()
    ridge = np.diag([toxicity.RIDGE] * 12 + [0.0])
    v = np.zeros(13)
    for _ in range(50):
        s = 1 / (1 + np.exp(-one @ v))
        g = one.T @ (p * (s - y)) + 4 * d.T @ (d @ v) / 30 + ridge @ v
        v -= np.linalg.solve(one.T @ (one * (p * s * (1 - s))[:, None]) + 4 * d.T @ d / 30 + ridge, g)
    assert np.allclose(np.append(w, bias), v, atol=1e-3)


def test_descent_reaches_the_minimum_of_its_loss():
    """Against many projected gradient steps on the dual."""
    r = np.random.default_rng(6)
    x = [np.unique(r.integers(0, 30, 8)) for _ in range(60)]
    y = np.where(r.random(60) < 0.3, 1, -1)
    ratio = r.normal(size=30)
    w, bias = quality.descend(x, y, ratio, passes=400)
    full = np.zeros((60, 31))
    for i, f in enumerate(x):
        full[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum() + 1e-12)
    full[:, 30] = 1
    most = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum())) * quality.COST
    q, a = (full * y[:, None]) @ (full * y[:, None]).T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        a = np.clip(a - step * (q @ a - 1), 0, most)
    assert np.allclose(np.append(w, bias), full.T @ (a * y), atol=5e-3)


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_classifiers_take_ties_long_texts_and_clashing_names(spark, run):
    long = "word " * 300_000  # beyond a slice of text
    rows = [(i, "good plain text" if i % 2 else "scum $$$") for i in range(40)] + [(100, long), (101, long), (7, "good plain text"), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", 1.0, 2) for i, t in rows], "doc_id long, text string, own string, score double, predicted int")
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)], LABELS)
    got = run(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = [(x.doc_id, x.score) for x in got.collect()]
    assert len(by) == len(rows) and all(0 <= s <= 1 for _, s in by)
    assert len({s for i, s in by if i is not None and i < 40 and i % 2}) == 1 and len({s for i, s in by if i in (100, 101)}) == 1


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_classifiers_without_labels_or_rows(spark, run):
    none = spark.createDataFrame([], LABELS)
    got = run(frame(spark, [(1, "a"), (2, None)]), none).collect()
    assert [x.score for x in got] == [0.5, 0.5]
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert {x.score for x in run(frame(spark, [(i, "a b") for i in range(20)]), one).collect()} == {1.0}
    assert run(frame(spark, []), one).collect() == []
