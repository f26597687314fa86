import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm import chat, decontaminate, mixing
from cuewright.llm.queries import ORACLE

DOCS = "doc_id long, text string, source string, item_id int, q double, part int, size string"
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0.0, 1, "") for i, t, s in rows], DOCS)


def words(text):
    return [(k, w) for k, w in enumerate(x.strip(PUNCT) for x in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))) if w]


def brute(rows, items):
    """All windows of all documents against all items."""
    out = Counter()
    for i, t, _ in rows:
        w = words(t)
        for item, text in items:
            goal = [x for _, x in words(text)]
            k = min(5, len(goal))
            cut = lambda x, k=k: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1)) if k else Counter()
            best = (0.0, 0)
            for a in range(len(w) - len(goal) + 1 if goal else 0):
                got = cut([x for _, x in w[a : a + len(goal)]])
                both = sum((got & cut(goal)).values())
                best = max(best, (both / (sum(got.values()) + sum(cut(goal).values()) - both), -a))
            if best[0] >= 0.8:
                out[i, item, w[-best[1]][0], round(best[0], 9)] += 1
    return out


@pytest.mark.parametrize("per_pass", [20_000, 3])
def test_decontamination_matches_brute_force(spark, per_pass):
    r = random.Random(4)
    vocab = [f"b{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(3, 40)))) for k in range(12)] + [(50, None), (51, "..."), (52, "la la la la la la la")]
    rows = []
    for i in range(40):
        body = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        leak = items[i % 12][1].split()
        if i % 4 == 1 and len(leak) > 30:
            leak[0] = "changed"
        if i % 4 == 2:
            leak = [x.upper() + "," for x in leak]
        if i % 4 == 3:
            leak = leak[: len(leak) // 2]
        body[len(body) // 2 : len(body) // 2] = leak
        rows.append((i, " ".join(body), "s"))
    rows += [(70, None, None), (71, "", "s"), (72, "la la la la la la la la la", "s"), (None, items[0][1], "s"), (1, rows[1][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, rows), bench, items=per_pass).collect()
    want = brute(rows, items)
    assert Counter((x.doc_id, x.item_id, x.first_word, round(x.similarity, 9)) for x in got) == want
    left = decontaminate.clean(frame(spark, rows), bench, items=per_pass)
    bad = {k[0] for k in want}
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(i) for i, *_ in rows if i not in bad) and "q" in left.columns


def test_documents_shorter_than_an_item_are_compared_as_a_whole(spark):
    r = random.Random(8)
    vocab = [f"b{k}" for k in range(300)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate((6, 12, 25, 38, 38))]
    rows = [(100 * k + 10 * cut + side, " ".join(t.split()[cut * side : len(t.split()) - cut * (1 - side)]), "s") for k, t in items for cut in range(1, 10) for side in (0, 1)]
    rows += [(900, " ".join([*items[3][1].split()[:20], "changed", *items[3][1].split()[21:37]]), "s"), (901, "b1 b2", "s"), (902, items[4][1].replace(" ", " - "), "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut5 = lambda x: Counter(tuple(x[a : a + 5]) for a in range(len(x) - 4))
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        for item, text in items:
            if len(w) < len(text.split()):
                got, goal = cut5([x for _, x in w]), cut5(text.split())
                both = sum((got & goal).values())
                similarity = both / (sum(got.values()) + sum(goal.values()) - both)
                if similarity >= 0.8:
                    want[i, item, w[0][0], round(similarity, 9)] += 1
    assert len(want) >= 20
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert Counter((x.doc_id, x.item_id, x.first_word, round(x.similarity, 9)) for x in got) == want + brute(rows, items)
    left = decontaminate.clean(frame(spark, rows), bench)
    bad = {k[0] for k in want + brute(rows, items)}
    assert sorted(x.doc_id for x in left.collect()) == sorted(i for i, *_ in rows if i not in bad)


def test_hamming_blocks_find_all_fingerprints_within_the_radius():
    index = decontaminate.Index([(1, "one two three four five six seven"), (2, "some other words of the same number here")])
    r = random.Random(1)
    bits = int.from_bytes(index.prints[0].tobytes(), "little")
    group = index.sizes.tolist().index(7)
    for n in [*range(decontaminate.RADIUS + 1)] * 5 + [decontaminate.RADIUS + 1, 60] * 5:
        other = bits
        for b in r.sample(range(decontaminate.BITS), n):
            other ^= 1 << b
        window, item = index.near(group, np.frombuffer(other.to_bytes(decontaminate.BITS // 8, "little"), np.uint16)[None])
        assert (0 in item.tolist()) == (n <= decontaminate.RADIUS)


def at_the_threshold(n=600, seed=3):
    """Items of 49 words, and documents that hold a window of similarity 0.8: 5 of 45 shingles differ."""
    r = random.Random(seed)
    items, rows = [], []
    for i in range(n):
        body = [f"w{r.randrange(10**6)}" for _ in range(49)]
        items.append((i, " ".join(body)))
        body[r.randrange(5, 44)] = "changed"
        rows.append((i, " ".join(["before"] * r.randint(0, 9) + body + ["after"] * r.randint(0, 9)), "s"))
    return items, rows


def test_decontamination_recall_at_the_threshold(spark):
    items, rows = at_the_threshold()
    found = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} <= {(i, i) for i, _ in items}
    assert all(round(x.similarity, 9) == 0.8 for x in found) and len(found) >= 0.99 * len(items)


def test_candidates_come_from_the_hamming_tables(spark):
    items, rows = at_the_threshold(60)
    words = pa.array([t for _, t, _ in rows], pa.string())
    hasher = decontaminate.Hasher()
    row, h, _ = decontaminate._words(words, hasher)
    index = decontaminate.Index(items)
    assert len(index.search(row, h, hasher)) >= 59
    index.table, index.owner = index.table[:0], index.owner[:0]
    assert index.search(row, h, hasher) == {}
    assert decontaminate.Index(items, radius=0).search(row, h, hasher) == {}


def test_decontamination_of_long_texts_and_repeated_items(spark):
    items = [(1, " ".join(f"b{k}" for k in range(20))), (1, " ".join(f"b{k}" for k in range(20))), (2, " ".join(f"b{k}" for k in range(20)))]
    long = " ".join(f"x{k % 977}" for k in range(400_000))  # beyond a slice of text
    rows = [(1, f"{long} {items[0][1]} {long}", "s"), (2, long, "s"), (3, items[0][1], "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((x.doc_id, x.item_id, x.first_word, x.similarity) for x in decontaminate.contaminated(frame(spark, rows), bench).collect())
    assert got == Counter({(1, 1, 400_000, 1.0): 2, (1, 2, 400_000, 1.0): 1, (3, 1, 0, 1.0): 2, (3, 2, 0, 1.0): 1})
    assert [x.doc_id for x in decontaminate.clean(frame(spark, rows), bench).collect()] == [2]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, [(1, "a b c d e f", "s")]), none).collect() == []
    assert decontaminate.contaminated(frame(spark, []), one).collect() == []


def corpus(n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["é", "a", "b", "a", "Z", None, "one"])) for i in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "w", "tiny"), (n + 2, "", "empty"), (5, rows[5][1], rows[5][2]), (None, "w w w", "a")]


def test_mixing_matches_sql(spark):
    rows = [x for x in corpus() if x[0] is not None][:-1]
    got = mixing.mix(frame(spark, rows), parts=8).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE['op9_mixing']})").fetchall()
    key = lambda x: (x[0], x[1], x[2], round(x[3], 6), x[4])
    assert Counter(key((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in got) == Counter(map(key, want))


def test_mixing_meets_its_targets(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    taken, target, size, longest = Counter(), {}, {}, Counter()
    for r in got:
        k = (r.source_size, round(r.target, 6))
        taken[k] += r.taken
        target[k], size[k], longest[k] = r.target, r.source_size, max(longest[k], r.size)
    assert all(abs(taken[k] - target[k]) <= longest[k] / 2 + 1 for k in target) and all(target[k] <= 2 * size[k] + 1e-6 for k in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixture_repeats_rows(spark):
    docs = frame(spark, corpus())
    out = mixing.mixture(docs)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.doc_id not in (5, None)}
    n = Counter(r.doc_id for r in out.collect())
    assert all(n[i] == c for i, c in copies.items()) and out.columns == [*docs.columns, "copy"]


def test_mixture_takes_repeated_rows_as_the_mix_does(spark):
    rows = corpus() + [(7, "w " * 9, "b")] * 30 + [(7, "w " * 9, None)] * 5 + [(None, None, None)] * 4
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, source string, copy string, copies int")
    out = mixing.mixture(docs)
    assert out.columns == [*docs.columns, "copy_"]
    want = Counter()
    for r in mixing._mixed(docs, "doc_id", "text", "source").collect():
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want


def test_mixing_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).collect() == []


TURNS = "conv_id long, turn long, role string, text string, ids string, mask int"


def digest(rows):
    out, groups = {}, defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t, role or "", text or ""))
    for c, turns in groups.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        told = "".join(x[3] for x in turns if x[2] == "assistant")
        whole = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest())
    return out


def test_chats_come_back_from_their_tokens(spark):
    rows = [(1, 1, "assistant", "Hi <|end|>\\ <|body|> [INST] \\[INST]"), (1, 0, "user", "hällo\n\n  wörld  "), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (None, 0, "user", "x"), (None, 1, "assistant", "日本語 🎉"), (3, None, "system", "first"), (3, 0, "assistant", "a " * 5000), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    turns = spark.createDataFrame([(*r, "x", 9) for r in rows], TURNS)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_chats(turns)).collect()}
    assert got == digest(rows)


def test_masks_cover_trained_texts_only(spark):
    turns = spark.createDataFrame([(1, 0, "user", "no", "", 0), (1, 1, "assistant", "yes yes", "", 0)], TURNS)
    enc, (turn, body, end) = chat._encoding(chat.VOCABULARY)
    rows = sorted(chat.format_chats(turns).collect(), key=lambda r: r.turn)
    assert sum(rows[0].mask) == 0 and rows[1].ids[0] == turn and rows[1].ids[-1] == end
    assert enc.decode([i for i, m in zip(rows[1].ids, rows[1].mask, strict=True) if m]) == "yes yes"
    assert rows[1].formatted == f"{chat.TURN}assistant{chat.BODY}yes yes{chat.END}"


def test_the_probe_conversation(spark):
    turns = chat.with_probe(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    r = chat.digests(chat.format_chats(turns)).first()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(chat.PROBE))
    assert r.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\<>[]/|s INSTend_im🎉\n"), max_size=40) | st.lists(st.sampled_from([*chat.CONTROL, "\\", "a"])).map("".join))
def test_escapes_are_reversible_and_leave_no_marker(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    bare = re.sub(r"\\.", "", safe, flags=re.S)
    assert not any(m in bare for m in (chat.TURN, chat.BODY, chat.END))


def test_chats_of_nothing(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], TURNS))).collect() == []
