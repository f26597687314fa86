import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import exact_dedup, jaccard_join, line_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns have names that the operators use themselves.
DOCS = "doc_id long, text string, id int, th string, keep int, uid int, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in rows], DOCS)


def edgy():
    long = "lorem ipsum dolor " * 3000
    return [(3, "a  b"), (1, "a\tb"), (2, None), (5, ""), (7, " "), (8, "A b"), (None, "a b"), (4, "c"), (4, "c"), (9, long), (10, long.replace(" ", "\n")), (11, long + "x"), (None, None)]


def test_exact_dedup_matches_brute_force(spark):
    rows = edgy()
    got = exact_dedup.dedup(frame(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min(x for x in ids if x is not None)
        want[i, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == {hashlib.sha256(t.encode()).hexdigest() for t in groups} and set(kept.values()) == {1}


def test_exact_dedup_survives_collisions_and_chunks(spark):
    rows = [(i, f"text {i % 7} " + "z" * (i % 3) * 20) for i in range(60)]
    plain = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(frame(spark, rows)).collect()}
    weak = exact_dedup.dedup(frame(spark, rows), primes=(2, 3), chunk=4, spread=16).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak} == plain


def test_chunked_and_whole_fingerprints_agree(spark):
    rows = frame(spark, [(1, "häuser " * 500)])
    one = exact_dedup.fingerprints(rows).first()
    cut = exact_dedup.fingerprints(rows, chunk=7, spread=10).first()
    assert (one.n_bytes, one.h1, one.h2) == (cut.n_bytes, cut.h1, cut.h2)


def lines_left(rows):
    """Line dedup by comparing every line with all earlier ones."""
    out, seen = {}, []
    for i, t in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        kept = []
        for line in t.split("\n"):
            w = frozenset(WORD.findall(line))
            if not w:
                kept.append(line)
                continue
            if not any(len(w & s) >= 0.8 * len(w | s) - 1e-9 for s in seen):
                kept.append(line)
            seen.append(w)
        out[i] = "\n".join(kept)
    return out


def variants(n, seed=1):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 14))) for _ in range(n)]
    out = list(base)
    for line in base:
        words = line.split()
        if len(words) > 4:
            words[r.randrange(len(words))] = r.choice(vocab)
            out.append(" ".join(words))
    r.shuffle(out)
    return out


def test_line_dedup_matches_brute_force(spark):
    lines = variants(120)
    rows = [(i, "\n".join(lines[i::20])) for i in range(20)] + [(20, None), (21, ""), (22, "\n\n"), (23, "w1\nw1 w1\n \nw1\tw1"), (None, "only here\nw1")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    want = lines_left(rows)
    assert got == want | {20: None}


def test_line_dedup_keeps_columns_and_repeated_rows(spark):
    out = line_dedup.dedup(frame(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c\nd")]))
    assert out.columns == ["doc_id", "text", "id", "th", "keep", "uid", "row"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a b c"), (1, "a b c"), (2, "d")]


def test_line_dedup_of_a_large_group_of_variants(spark):
    base = [f"k{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()}
    assert got == lines_left(rows)


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    low = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[k][0], low[find(k)], links[k]) for k in range(len(rows)))


def near_copies(n=60, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"v{r.randrange(5000)}" for _ in range(r.randint(30, 90))]
        for _ in range(r.choice((1, 1, 2, 4))):
            copy = list(words)
            for _ in range(r.choice((0, 0, 1, 2))):
                copy[r.randrange(len(copy))] = "edited"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("small,block", [(48, 256), (2, 3)])
def test_jaccard_join_matches_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = near_copies() + [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "  "), (905, "a b c d e"), (905, "a b c d e"), (None, "q r s t u"), (None, "q r s t u")]
    base = [f"u{k}" for k in range(200)]
    rows += [(1000 + i, " ".join([*base[: i * 5], "x", *base[i * 5 + 1 :]])) for i in range(30)]
    got = jaccard_join.join(frame(spark, rows), recall=1 - 1e-7).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == linked(rows)


def frequent_passages(pairs=200, pool=400, size=208, seed=5):
    """Sets of frequent passages in pairs of similarity 0.8, other pairs at about 0.35, as their MinHashes (uid, sig)."""
    r = np.random.default_rng(seed)
    hashes, shared, sets = r.integers(0, 1 << 32, (jaccard_join.COORDINATES, pool), np.uint32), size * 8 // 9, []
    for _ in range(pairs):
        drawn = r.permutation(pool)[: 2 * size - shared]
        sets += [drawn[:size], np.concatenate([drawn[:shared], drawn[size:]])]
    return [(uid, hashes[:, s].min(1).tobytes()) for uid, s in enumerate(sets)]


def test_jaccard_recall_holds_in_deep_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "DENSE", 2)  # in nodes this small a child has most of the sets by chance
    sets = spark.createDataFrame(frequent_passages(), "uid long, sig binary")
    found = jaccard_join.components(jaccard_join.candidates(sets, jaccard_join.SIMILARITY, jaccard_join.RECALL))
    root = {r.node: r.root for r in found.collect()}
    assert sum(root.get(k, k) != root.get(k + 1, k + 1) for k in range(0, 400, 2)) <= 2
    assert max(Counter(root.values()).values()) < 40  # pairs aren't found by joining up everything


def test_jaccard_starts_meet_the_recall_at_each_depth():
    for depth in range(1, jaccard_join.MOST_DEPTH + 1):
        n, least = jaccard_join.starts_needed(depth=depth), jaccard_join.least_agreement()
        assert jaccard_join.meeting(n - 1, depth, least=least) < jaccard_join.RECALL <= jaccard_join.meeting(n, depth, least=least)


def test_representatives_keep_one_of_each_group(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (3, "other words that are all alone"), (4, ""), (6, None)]
    out = jaccard_join.representatives(frame(spark, rows))
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 6] and out.columns[0] == "doc_id"


def words_left(rows, window):
    """Substring dedup by counting all windows."""
    words = [WORD.findall(t or "") for _, t in rows]
    starts = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("window,period", [(35, 21), (14, 13), (8, 7), (31, 31)])
def test_substring_dedup_matches_brute_force(spark, window, period):
    r = random.Random(5)
    passage = [f"p{k}" for k in range(window + 9)]
    rows = []
    for i in range(25):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            a = r.randrange(10)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + window + r.randrange(-1, 9 - a + 1)]
        rows.append((i, " ".join(words)))
    rows += [(30, "z " * (window + 5)), (31, None), (32, ""), (33, "ü " + " ".join(passage)), (7, rows[7][1]), (None, " ".join(passage))]
    got = substring_dedup.dedup(frame(spark, rows), window=window, period=period).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == words_left(rows, window)


def test_covers_are_covers():
    assert all(substring_dedup.covers(c, p) for p, c in substring_dedup.COVERS.items())
    assert not substring_dedup.covers((0, 1, 2), 7)


@pytest.mark.parametrize("run", [exact_dedup.dedup, line_dedup.dedup, jaccard_join.join, substring_dedup.dedup, jaccard_join.representatives])
def test_empty_tables_give_no_rows(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_texts_beyond_a_slice_of_memory(spark):
    r = random.Random(11)
    long = [f"w{r.randrange(10**6)}" for _ in range(200_000)]
    passage = long[777:827]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "other"])), (3, " ".join(["p", *passage, "q"])), (4, None), (5, "x" * 2_000_000), (6, "x" * 1_999_999 + "y"), (7, "x" * 2_000_000)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard_join.join(frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 1), 6: (6, 0), 7: (5, 1)}
    cut = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert cut == {1: (200_000, 199_999), 2: (200_000, 199_999), 3: (52, 50), 4: (0, 0), 5: (1, 0), 6: (1, 0), 7: (1, 0)}
    left = {x.doc_id: x.text for x in line_dedup.dedup(frame(spark, rows)).collect()}
    assert left == {i: t if i in (1, 3, 4, 5, 6) else "" for i, t in rows}


def test_words_that_polynomials_take_for_equal_are_told_apart():
    """Thue-Morse strings of 2048 bytes collide under every polynomial hash modulo 2**64."""
    from cuewright.llm.common import Hasher, word_hashes

    bits = [bin(k).count("1") % 2 for k in range(2048)]
    a, b = (np.array([97 + (x ^ y) for x in bits], np.uint8) for y in (0, 1))
    h = word_hashes(np.concatenate([a, b]), np.array([0, 2048]), np.array([2048, 4096]), Hasher())
    assert h[0] != h[1]


def test_parities_bound_the_difference_of_short_and_long_sets(spark):
    pick, rows = random.Random(3), []
    for _ in range(200):
        x = set(pick.sample(range(3000), pick.choice((5, 20, 63, 64, 65, 90, 200))))
        y = set(pick.sample(sorted(x), int(len(x) * pick.choice((0.5, 0.8, 0.95, 1))))) | set(pick.sample(range(3000), pick.choice((0, 1, 9))))
        rows.append((" ".join(map(str, x)), "\t".join(map(str, y)), len(x ^ y), len(x), len(y)))
    t = spark.createDataFrame(rows, "a string, b string, d int, na int, nb int")
    t = t.withColumns({f"{c}_h": line_dedup._hashes(line_dedup._words(c)) for c in "ab"})
    t = t.withColumns({f"{c}_{k}": e for c in "ab" for k, e in zip(line_dedup.PARITIES, line_dedup._parities(f"{c}_h"), strict=True)})
    low = line_dedup._apart("a", "b", F.col("na"), F.col("nb"))
    got = t.select("d", "na", "nb", low.alias("low"), F.size("a_h").alias("n"), F.size("b_h").alias("m")).collect()
    assert all(r.low <= r.d and (r.low - r.d) % 2 == 0 and (r.n, r.m) == (r.na, r.nb) for r in got)
    assert sum(r.low for r in got if min(r.na, r.nb) >= 64) > 0.5 * sum(r.d for r in got if min(r.na, r.nb) >= 64)
    rarity = F.from_json(F.lit(str([0] * line_dedup.COUNTERS)), "array<long>")
    assert not t.select(line_dedup._ids(F.col("a_h"), rarity).alias("ids")).schema["ids"].dataType.containsNull


def test_few_sets_that_share_a_mark_are_left_to_the_prefix_join(spark, monkeypatch):
    base = [f"w{i}" for i in range(20)]
    clusters = [[f"{k}{w}" for w in base] for k in "ab"]
    rows = [(10 * k + i, " ".join([*c, f"x{k}{i}"])) for k, (c, size) in enumerate(zip(clusters, (3, 2 * line_dedup.CLUSTER), strict=True)) for i in range(size)]
    docs = spark.createDataFrame([(i + 1, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    asked, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda texts, pairs, *rest: asked.append(pairs.count()) or verified(texts, pairs, *rest))
    kept = {r.doc_id for r in line_dedup.dedup(docs).where("text != ''").collect()}
    assert kept == {1, 4}
    # the large cluster's sets meet its earliest one, those of the small cluster wait
    assert len(asked) == 2 and asked[0] <= 2 * 2 * line_dedup.CLUSTER and 0 < asked[1] < line_dedup.CLUSTER * line_dedup.CLUSTER
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in (10, 80)], "s string").select(line_dedup._hashes(line_dedup._words("s")).alias("h"))
    for r in long.select("h", *(c.alias(p) for p, c in zip(line_dedup.PARITIES, line_dedup._parities("h"), strict=True))).collect():
        whole = half = 0
        for x in r.h:
            whole ^= 1 << (x & 63)
            half ^= (x >> 6 & 1) << (x & 63)
        assert (r.parity % (1 << 64), r.parity_high % (1 << 64)) == (whole, half if len(r.h) >= line_dedup.LONG else 0)


def test_the_driver_keeps_short_descriptions_of_the_plans_it_writes(spark):
    from functools import reduce

    from cuewright.llm.common import _settings

    many = reduce(lambda a, b: a.union(b), [spark.range(1)] * 100)
    with _settings(spark):
        assert len(many._jdf.queryExecution().toString()) < 6000
