"""The operators for token counts, hard negatives and the audit of filters, against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright.llm import filter_audit, hard_negatives, token_counts

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = ["the ", "Zusammenfassung", " naïve", "  ", "\n\n", "\t", "日本語", "龘", "🙂", "1234567890", "a" * 70, " " * 90, "=-" * 40, "<s>", "▁", "<0x41>", "\x00", "é", "http://x.org/?q=", "ß"]


def long_text(r, n):
    return "".join(r.choice(PIECES) for _ in range(n))


def test_counts_match_the_library(spark):
    r = random.Random(5)
    texts = [None, "", " ", "a", "short text", "a" * 3000, " " * 2500, "龘" * 900, "ab" * 2000, "x" * 40, *(long_text(r, r.randint(1, 250)) for _ in range(40))]
    texts += texts[-3:] * 2
    rows = [(i if i != 7 else None, t, 1, "x", True) for i, t in enumerate(texts)] + [(3, texts[3], 2, "y", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string, over_limit boolean")
    out = token_counts.count(docs, limit=50, step=64, overlap=12)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 50) for i, t, *_ in rows)
    assert Counter(map(tuple, out.collect())) == want


def test_overlaps_without_a_common_token_are_widened(spark):
    texts = {b"a": "a" * 5000, b"b": "word " * 700, b"c": "日" * 1200}
    cut = spark.createDataFrame(list(texts.items()), "key binary, text string")
    first = token_counts._spliced(token_counts._edges(token_counts._chunks(cut, 61, 7), token_counts.MODEL, 61, 7)).collect()
    assert any(x["n_tokens"] is None for x in first)
    got = {bytes(k): n for k, n in token_counts.spliced_counts(cut, step=61, overlap=7).collect()}
    assert got == {k: len(SP.encode(t)) for k, t in texts.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=8), max_size=60).map("".join), st.integers(3, 60), st.data())
def test_a_common_token_proves_the_splice(text, step, data):
    text = text.encode("utf-8", "replace").decode()
    overlap = data.draw(st.integers(1, step - 1))
    at = step if step < len(text) else len(text) // 2
    n, left, ids = token_counts.places(token_counts.MODEL, text[: at + overlap], 0)
    m, right, more = token_counts.places(token_counts.MODEL, text[at:], at)
    for k, place in enumerate(left):
        if place >> token_counts.SHIFT >= at and (j := np.flatnonzero(right == place)).size:
            assert ids[k] + m - more[j[0]] == len(SP.encode(text))


def test_other_kinds_of_models_are_refused(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        token_counts._model(str(tmp_path / "other.model"))


def test_counts_of_empty_tables(spark):
    assert token_counts.count(spark.createDataFrame([], "doc_id string, text string")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, rank int, id string"


def negatives_by_hand(rows, positives=5, negatives=10):
    q = lambda v: [math.floor(256 * x) for x in v]
    rows = [(i, q(v), c) for i, v, c, *_ in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, v, c in rows:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, d) for j, w, d in rows)
        same = [(j, -s) for s, j, d in scored if d == c and j != i][:positives]
        for p, score in same:
            fits = [(j, -s) for s, j, d in scored if d != c and 30 * score <= -100 * s <= 90 * score][:negatives]
            out.update((i, p, k + 1, j, score, s) for k, (j, s) in enumerate(fits))
    return out


@pytest.mark.parametrize(("block_rows", "block_anchors"), [(4096, 128), (7, 3), (1, 1)])
def test_negatives_match_brute_force(spark, block_rows, block_anchors):
    r = np.random.default_rng(3)
    vector = lambda d=40: [float(np.float32(x)) for x in r.normal(0.1, 0.3, d)]
    rows = [(i, vector(), int(r.integers(0, 4)), 1, "x") for i in range(90)]
    rows += [(100, vector(3), 1, 1, ""), (110, [], 1, 1, ""), (120, vector(70), 2, 1, ""), (-10, vector(), 3, 1, ""), (130, vector(), 99, 1, "")]
    rows += [(None, vector(), 1, 1, ""), (140, None, 1, 1, ""), (150, vector(), None, 1, ""), (160, [1.0, None], 1, 1, ""), (170, [float("nan")], 1, 1, ""), (180, [float("inf")], 1, 1, "")]
    rows += [(i, [0.25] * 40, i % 2, 1, "tie") for i in range(200, 230)] + [rows[11]] * 3
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, block_rows=block_rows, block_anchors=block_anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == negatives_by_hand(rows)


def test_large_components_are_held(spark):
    rows = [(0, [1e30] * 40, 1, 1, ""), (1, [1e30] * 40, 1, 1, ""), (2, [60000.0] * 40, 2, 1, "")]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, highest=100).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 2, 40 << 48, (60000 * 256 << 24) * 40)]


def test_negatives_without_anchors_or_rows(spark):
    rows = spark.createDataFrame([(1, [1.0], 1, 1, "")], VECTORS)
    assert hard_negatives.mine(rows, F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(rows.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(rows, F.col("vec_id") == 1).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_the_walk_visits_each_order_once_by_swaps(n):
    seen = list(filter_audit.plain_changes(n))
    assert sorted(o for o, _ in seen) == sorted(itertools.permutations(range(n)))
    for (a, _), (b, k) in itertools.pairwise(seen):
        assert b == a[:k] + (a[k + 1], a[k]) + a[k + 2 :]


DOCS = "doc_id long, text string, lang string, part string, salt int, E int"


def audit_by_hand(rows, labels):
    words = lambda t: [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
    texts = [(i, t or "", g or "") for i, t, g, *_ in rows]
    good, bad = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for i, t, g in texts:
        w = words(t)
        flags = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)}
        docs.append((g, flags, i in good, i in bad))
    out = {}
    for part in {g for g, *_ in docs}:
        own, shares = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                removed = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                fails = [d for d in own if d[1][f]]
                shares[f] += len(removed)
                out[part, order, step + 1] = [len(left), len(removed), len(fails) - len(removed), sum(sum(d[1].values()) == 1 for d in fails), sum(d[2] for d in removed), sum(d[3] for d in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_matches_brute_force(spark):
    r = random.Random(8)
    pool = [f"w{k}" for k in range(150)] + ["ABC", "x#y", "é"]
    texts = [None, "", "short", "A" * 50, *(" ".join(r.choice(pool[: r.choice([5, 150, 153])]) for _ in range(r.randint(0, 220))) for _ in range(25)), "tab\tnew\nline\v$ \x0c\r"]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "p", 1, 2) for i in range(120)]
    rows += [(None, texts[2], "en", "p", 1, 2), (None, texts[2], "en", "p", 1, 2), (None, "alone", "de", "p", 1, 2), *[(5, texts[2], "en", "p", 1, 2)] * 3, (-1, texts[5], "fr", "p", 1, 2)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(80)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = filter_audit.audit_documents(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.STEP_COUNTS]
    got = [tuple(x) for x in got.collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, labels)


def test_audit_of_empty_tables_and_other_filters(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(docs, labels).collect() == []
    rows = spark.range(10).withColumn("text", F.lit("x"))
    got = filter_audit.audit(rows, {"p": F.col("id") < 4, "q": F.when(F.col("id") < 8, F.col("id") > 2)}, F.lit(None).cast("string"), F.col("id") == 3, F.lit(None).cast("boolean")).collect()
    assert sorted(map(tuple, got)) == [("", "pq", 1, 6, 4, 0, 3, 1, 0, 7), ("", "pq", 2, 2, 4, 1, 4, 0, 0, 9), ("", "qp", 1, 5, 5, 0, 4, 1, 0, 9), ("", "qp", 2, 2, 3, 1, 3, 0, 0, 7)]
    with pytest.raises(ValueError):
        filter_audit.audit(rows, {c: F.lit(True) for c in "abcdefghi"}, F.lit(""), F.lit(True), F.lit(True))
