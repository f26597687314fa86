"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity, the rarest first. Two
sets of Jaccard similarity t or more, of n and m <= n words, share one of the first
n - ceil(t * n) + 1 words of the larger and the first m - ceil(2t / (1 + t) * m) + 1
of the smaller (prefix filter); their sizes differ by the factor t at most (length
filter), and the words that are left behind a shared one must suffice (positional
filter). A 64-bit parity of each set, and for a long set that of half its words, bounds the symmetric
difference from below and drops most of the remaining pairs. Words cut to 16 bits
bound the overlap from above and drop nearly all of the rest; what is left is
verified on the words themselves.

Equal sets are joined up first. Where CLUSTER or more sets have the same smallest or
largest word hash, a set that is similar to the earliest of them is settled by that
pair alone and looks no further, so a large group of near copies makes as many pairs
as it has members.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, text_or_empty, tidy

SIMILARITY = 0.8
#: Counters of word occurrences. Words that share one count as equally rare, which is a matter of speed alone.
COUNTERS, KEYS = 1 << 17, 1 << 16
#: Bytes up to which a side of a join is sent to all tasks.
SENT_BYTES = 32 << 20
#: Sets that share their smallest or largest word hash from which they are compared with the earliest of them first; fewer make few pairs anyway.
CLUSTER = 16

#: Bits of its hash that a word's number has, below its rarity.
PLACES = 25
#: Words from which a set has parities of 128 bits, and the parities' columns.
LONG = 64
PARITIES = ("parity", "parity_high")


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _words(line: str, spaces: str = "\t\v\f\r") -> Column:
    """Pieces of a line between single white space; some may be empty. A line with none of `spaces` is cut at spaces alone."""
    # spaces alone have the faster split, and each byte is looked for in the bytes, where a pattern would need the text decoded
    other = reduce(Column.__or__, (F.contains(F.col(line), F.lit(c)) for c in spaces))
    return F.when(other, F.split(line, r"[\x20\x09-\x0D]")).otherwise(F.split(line, " "))


def _hashes(words: Column) -> Column:
    """Sorted hashes of the words, each once."""
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def _rarity(docs: DataFrame, text_col: str) -> Column:
    """For each counter its count of words over all documents, in thirds of an octave less 64, in a constant array."""
    text = docs.select(F.replace(text_or_empty(text_col), F.lit("\n"), F.lit(" ")).alias("text"))
    # form feeds and vertical tabs are too few to matter for a count
    words = text.select(F.explode(_words("text", "\t\r")).alias("w"))
    h = F.xxhash64("w")
    # a row for several counters keeps the keys few enough for the fast map of Spark's aggregation
    groups = COUNTERS // KEYS
    which = F.shiftright(h, KEYS.bit_length() - 1).bitwiseAND(_long(groups - 1))
    counts = words.groupBy(h.bitwiseAND(_long(KEYS - 1)).cast("int").alias("k")).agg(*(F.sum(F.when(which == g, 1).otherwise(0)).alias(f"n{g}") for g in range(groups))).toArrow()  # KEYS rows at most
    out = [-64] * COUNTERS
    for g in range(groups):
        for k, n in zip(counts["k"].to_pylist(), counts[f"n{g}"].to_pylist(), strict=True):
            if n:
                out[g * KEYS + k] = min(int(3 * math.log2(n)), 127) - 64
    return F.from_json(F.lit(str(out).replace(" ", "")), "array<int>")


def _ids(hashes: Column, rarity: Column) -> Column:
    """Sorted numbers of a set's words: the rarity above PLACES bits of hash. Words that share a number are looked at for nothing, but none is missed."""
    place = lambda h: F.shiftrightunsigned(h, 64 - PLACES).cast("int")
    # arrays without nulls are sorted as plain numbers
    number = lambda h: F.coalesce(F.shiftleft(rarity[h.bitwiseAND(_long(COUNTERS - 1))], PLACES).bitwiseOR(place(h)), F.lit(0))
    return F.sort_array(F.transform(hashes, number))


def _sent(df: DataFrame, row_bytes: int, *arrays: str) -> DataFrame:
    """df, marked for sending to all tasks if its rows, with the items of array columns, take SENT_BYTES or less."""
    size = F.count("*") * row_bytes + sum((F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0)) * 8 for c in arrays), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= SENT_BYTES else df


def _parities(hashes: str) -> list[Column]:
    """For a set's hashes the parity over 64 places, and, from LONG words, that of the words whose hash has the next bit; else 0."""
    place = lambda x: x.bitwiseAND(_long(63)).cast("int")
    parity = lambda one: F.aggregate(hashes, _long(0), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one(x), place(x))))
    return [parity(lambda x: _long(1)), F.when(F.size(hashes) >= LONG, parity(lambda x: F.shiftright(x, 6).bitwiseAND(_long(1)))).otherwise(_long(0))]


def _apart(a: str, b: str, n: Column, m: Column) -> Column:
    """The least number of words that lie in one set only, by the parities."""
    whole, half = (F.col(f"{a}_{p}").bitwiseXOR(F.col(f"{b}_{p}")) for p in PARITIES)
    return F.when(F.least(n, m) >= LONG, F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(whole))


def _similar(a: str, b: str, t: float) -> Column:
    """Length and parity filters for columns {a}_n, {a}_parity and those of b."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (n * t - 1e-9 <= m) & (m * t - 1e-9 <= n) & (_apart(a, b, n, m) <= n + m - 2 * _overlap(n, m, t))


def _overlap(n: Column, m: Column, t: float) -> Column:
    return F.ceil((n + m) * (t / (1 + t)) - 1e-9)


def _paired(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """pairs with lines' other columns of both sides, as va_ and vb_, where the line of b comes earlier."""
    side = lambda s: lines.select(*(F.col(c).alias(f"v{s}_{c}") for c in lines.columns))
    on = lambda s: F.col(f"{s}_id").eqNullSafe(F.col(f"v{s}_id")) & (F.col(f"{s}_line") == F.col(f"v{s}_line"))
    both = pairs.join(side("a"), on("a") & (F.col("a_sid") == F.col("va_sid"))).join(side("b"), on("b"))
    place = lambda s: F.struct(f"v{s}_id", f"v{s}_line", f"v{s}_th")
    return both.where(place("b") < place("a"))


def _verified(texts: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Of pairs of lines (a_id, a_line, a_sid, b_id, b_line), the sets (a_sid) of those a to which an earlier b is similar.

    Lines meet as the sorted hashes of their words, if the sets of the words' low
    16 bits leave it open: these have as many words in common, less the words that
    share their bits with another. The likeliest b of each a comes first, the others
    follow for those a alone that it leaves unsettled.
    """
    names = ["a_id", "a_line", "a_sid", "b_id", "b_line"]
    pairs = durable(pairs.distinct())
    sides = [pairs.select(*(F.col(f"{s}_{c}").alias(f"n_{c}") for c in ("id", "line"))) for s in "ab"]
    needed = durable(sides[0].unionByName(sides[1]).distinct().groupBy("n_id").agg(F.collect_set("n_line").alias("n_lines")))
    lines = texts.join(_sent(needed, 64, "n_lines"), F.col("id").eqNullSafe(F.col("n_id")))
    lines = lines.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line", "s"), "n_lines").where(F.array_contains("n_lines", F.col("line")))
    lines = lines.select("id", "th", "line", _hashes(_words("s")).alias("words")).withColumn("sid", F.xxhash64("words")).withColumn("n", F.size("words"))
    lines = durable(lines.withColumn("bits", F.array_distinct(F.transform("words", lambda w: (w.bitwiseAND(_long(0xFFFF)) - 0x8000).cast("short")))))

    both = _paired(pairs, lines.drop("words"))
    most = F.size(F.array_intersect("va_bits", "vb_bits")) + F.least(*(F.col(f"v{s}_n") - F.size(f"v{s}_bits") for s in "ab"))
    likely = durable(both.withColumn("over", most - _overlap(F.col("va_n"), F.col("vb_n"), t)).where("over >= 0").select(*names, "over").distinct())

    def similar(pairs: DataFrame) -> DataFrame:
        both = _paired(pairs, lines.select("id", "th", "line", "sid", "words"))
        common = F.size(F.array_intersect("va_words", "vb_words"))
        return both.where(common >= t * (F.size("va_words") + F.size("vb_words") - common) - 1e-9).select("a_sid").distinct()

    best = likely.groupBy("a_sid").agg(F.max(F.struct("over", "a_id", "a_line", "b_id", "b_line")).alias("p")).select("a_sid", "p.*")
    sure = durable(similar(best.select(*names)))
    rest = durable(similar(likely.join(_sent(sure, 16), "a_sid", "left_anti").select(*names)))
    discard(pairs, needed, lines, likely)
    return sure.unionByName(rest)


@tidy
def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """Line numbers that go, from 0, of each document that loses any: id, th, gone."""
    t = similarity
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    rarity = _rarity(docs, text_col)
    lines = texts.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    lines = lines.select("id", "th", "line", _hashes(_words("s")).alias("hashes"))
    n = F.size("hashes")
    long_prefix = n - F.ceil(n * t - 1e-9).cast("int") + 1
    smallest = math.floor(1 / (1 - t) + 1e-9) - 1  # of fewer words, similar sets are equal
    open_set = n >= smallest
    prefix = F.slice(_ids(F.col("hashes"), rarity), 1, long_prefix)
    lines = lines.select("id", "th", "line", n.alias("n"), F.xxhash64("hashes").alias("sid"), F.hash("hashes").alias("sid2"), *(F.when(open_set, c).alias(k) for k, c in (*zip(PARITIES, _parities("hashes"), strict=True), ("least", F.get("hashes", F.lit(0))), ("most", F.get("hashes", F.size("hashes") - 1)), ("prefix", prefix))))
    lines = durable(lines).where("n > 0")

    key = ["sid", "sid2", "n"]
    # what goes with a set is taken from its earliest line, all at once
    earliest = F.min(F.struct("id", "line", "th", *PARITIES, "least", "most", "prefix")).alias("f")
    sets = lines.groupBy(*key).agg(F.count("*").alias("m"), earliest)
    sets = durable(sets.select(*key, "m", F.struct("f.id", "f.line", "f.th").alias("at"), *(f"f.{c}" for c in (*PARITIES, "least", "most", "prefix"))))
    wide = sets.where(F.col("n") >= smallest)

    marked = lambda *cols: wide.select(F.explode(F.array("least", F.bitwise_not("most"))).alias("mark"), *cols)
    frequent = durable(marked().groupBy("mark").agg(F.count("*").alias("c")).where(F.col("c") >= CLUSTER).select("mark"))
    marks = durable(marked("sid", "n", *PARITIES, "at").join(_sent(frequent, 16), "mark", "left_semi"))
    # the first set of each mark is a table of its own, so that a join with a frequent mark can be split
    firsts = durable(marks.groupBy("mark").agg(F.min(F.struct("at", "sid", "n", *PARITIES)).alias("f")).select("mark", "f.*"))
    named = lambda d, s: d.select(*(F.col(c).alias(f"{s}_{c}") for c in ("sid", "n", *PARITIES)), F.col("at.id").alias(f"{s}_id"), F.col("at.line").alias(f"{s}_line"), "mark")
    met = named(marks, "a").join(_sent(named(firsts, "b"), 128), "mark").where("a_sid != b_sid").where(_similar("a", "b", t))
    ends = ["a_id", "a_line", "a_sid", "b_id", "b_line"]
    settled = durable(_verified(texts, met.select(*ends), t))

    looking = wide.join(_sent(settled, 16), wide["sid"] == settled["a_sid"], "left").select("sid", "n", *PARITIES, F.col("at.id").alias("id"), F.col("at.line").alias("line"), F.col("a_sid").isNull().alias("open"), "prefix")

    def entries(s: str) -> DataFrame:
        """A row for each of a set's first words; meta has n, the word's place, whether it is of the shorter prefix and whether the set looks for an earlier one."""
        d = looking.select("sid", "n", *(F.coalesce(p, _long(0)).alias(p) for p in PARITIES), "id", "line", "open", F.posexplode("prefix").alias("i", "word"))
        short = F.col("i") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9)
        meta = F.col("n").cast("long") * (1 << 32) + F.col("i").cast("long") * 4 + short.cast("int") * 2 + F.col("open").cast("int")
        return d.select(F.col("word").alias(f"{s}_word"), *(F.col(c).alias(f"{s}_{c}") for c in ("sid", *PARITIES, "id", "line")), meta.alias(f"{s}_meta"))

    bit = lambda s, b: F.col(f"{s}_meta").bitwiseAND(_long(b)) != 0
    part = {f"{s}_{k}": e for s in "xy" for k, e in (("n", F.shiftright(f"{s}_meta", 32).cast("int")), ("i", F.shiftright(F.col(f"{s}_meta").bitwiseAND(_long(0xFFFFFFFF)), 2).cast("int")), ("open", bit(s, 1)))}
    n, m = part["x_n"], part["y_n"]
    # for whole numbers the limits need no rounding: a symmetric difference has the parity of n + m
    sizes = (n >= m) & (m >= n * t - 1e-9) & ((n > m) | (F.col("x_sid") > F.col("y_sid"))) & (F.col("x_sid") != F.col("y_sid"))
    # x is the larger one; the later one has to be open
    later = F.struct("x_id", "x_line") >= F.struct("y_id", "y_line")
    same_place = F.col("x_id").eqNullSafe(F.col("y_id")) & (F.col("x_line") == F.col("y_line"))
    # both sides read one exchange, so that the shorter prefix of one of them must not be filtered before
    first = F.when(F.col("x_meta").isNotNull(), bit("y", 2))
    alike = _apart("x", "y", n, m) <= (n + m) * ((1 - t) / (1 + t)) + 2e-9
    # sizes drop most pairs at the least cost
    fits = sizes & first & alike & (F.least(n - part["x_i"], m - part["y_i"]) >= (n + m) * (t / (1 + t)) - 1e-9)
    x, y = entries("x"), entries("y")
    found = x.join(y, (F.col("x_word") == F.col("y_word")) & fits & (part["x_open"] | part["y_open"]))
    found = found.select(*(F.col(f"{s}_{c}") for s in "xy" for c in ("sid", "id", "line")), part["x_open"].alias("x_open"), part["y_open"].alias("y_open"), later.alias("x_later"), same_place.alias("tie"))
    as_pair = lambda a, b: F.struct(*(F.col(f"{s}_{c}").alias(f"{k}_{c}") for k, s, cs in (("a", a, ("id", "line", "sid")), ("b", b, ("id", "line"))) for c in cs))
    pair = lambda when, a, b: F.when(when, F.array(as_pair(a, b))).otherwise(F.array())
    # lines of one place, which rows that repeat an id may have, are put in order by the verification
    pairs = F.concat(pair(F.col("x_open") & (F.col("x_later") | F.col("tie")), "x", "y"), pair(F.col("y_open") & (~F.col("x_later") | F.col("tie")), "y", "x"))
    more = _verified(texts, found.select(F.explode(pairs).alias("p")).select(*(f"p.{c}" for c in ends)), t)

    gone = durable(settled.unionByName(more).distinct())
    info = sets.join(_sent(gone, 16), sets["sid"] == gone["a_sid"], "left").where((F.col("m") > 1) | F.col("a_sid").isNotNull())
    info = durable(info.select(F.col("sid").alias("of"), F.col("sid2").alias("of2"), F.col("n").alias("of_n"), "at", F.col("a_sid").isNotNull().alias("all")))
    hit = lines.select("id", "th", "line", *key).join(_sent(info, 64), (F.col("sid") == F.col("of")) & (F.col("sid2") == F.col("of2")) & (F.col("n") == F.col("of_n")))
    hit = hit.where(F.col("all") | (F.struct("id", "line", "th") > F.col("at")))
    return hit.groupBy("id", "th").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """Remove lines that are similar to an earlier line, from docs with all its columns.

    Lines end at \\n. Words are what lies between ASCII white space, as they are;
    a line without words always stays. A line goes if any earlier line, whether or
    not that one stays, has a Jaccard similarity of at least `similarity` to it.
    Lines are ordered by id, null first, then by number, then by a hash of their
    text's whole. What is left is joined by \\n; null stays null. Rows that repeat
    id and text are one document and lose the same lines. An empty table gives no
    rows.
    """
    gone = repeated_lines(docs, id_col, text_col, similarity=similarity).withColumnsRenamed({"id": "__id", "th": "__th", "gone": "__gone"})
    size = gone.agg(F.sum(F.size("__gone") * 8 + 64)).first()[0] or 0
    if size <= SENT_BYTES:
        gone = F.broadcast(gone)
    text = docs[text_col]
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(text_or_empty(text)) == gone["__th"]), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda s, i: ~F.array_contains(gone["__gone"], i)), "\n")
    new = F.when(gone["__gone"].isNull(), text).otherwise(kept)
    return out.select(*(new.alias(c) if c == text_col else docs[c] for c in docs.columns))
