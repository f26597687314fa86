"""Benchmark decontamination: SimHash of item-sized windows, then weighted shingles.

Words are compared in lower case (A-Z) without the punctuation around them. An
item's windows in a document have as many words as the item; a document of fewer
words than the item is one window as a whole. Fingerprints of windows come from
running sums over the bits of their shingles' hashes; weights are counts. An item
is a candidate for a window if one of BLOCKS blocks of the fingerprints differs in
RADIUS // BLOCKS bits at most, which holds for all fingerprints within RADIUS:
each block's table lists an item under all values that near. Candidates within
RADIUS are verified by the weighted Jaccard similarity of shingles.

A window that holds no shingle of any item has similarity 0 with all of them and
gets no fingerprint. Of windows at the threshold, the radius misses about one in
300; the tests measure that.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, column_bytes, lower_ascii, mix, rows_of, slices, window_hashes, word_bounds, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprint bits, their blocks, and the Hamming radius. Sets of similarity 0.8 have a cosine of about 0.89 and
#: differ in 19.4 bits of 128 on average, with a deviation of 4.1: 31 bits are 2.8 deviations away.
BITS, BLOCKS, RADIUS = 128, 8, 31
#: Items in the tables of one pass, which take 22 kB an item; a larger benchmark takes more passes over the documents.
ITEMS = 4000
#: Windows that get their fingerprints at once.
WINDOWS = 4096


def _stripped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds without ASCII punctuation at either side of a word, and which words are left."""
    odd = np.zeros(256, bool)
    odd[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
    starts, ends = starts.copy(), ends.copy()
    for edge, step, at in ((starts, 1, 0), (ends, -1, -1)):
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[starts[todo] < ends[todo]]
            todo = todo[odd[buf[edge[todo] + at]]]
            edge[todo] += step
    return starts, ends, starts < ends


def _words(column, hasher: Hasher):
    """row, hash and place (index among the text's words) of each word that is not mere punctuation."""
    buf, offsets = column_bytes(column)
    buf = lower_ascii(buf)
    starts, ends = word_bounds(buf, offsets)
    row = rows_of(offsets, starts)
    place = np.arange(len(starts)) - np.searchsorted(row, np.arange(len(column)))[row]
    starts, ends, use = _stripped(buf, starts, ends)
    return row[use], word_hashes(buf, starts[use], ends[use], hasher), place[use]


def _shingles(h: np.ndarray, row: np.ndarray, size: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of words by their start, and whether a run lies within one row."""
    s = window_hashes(h, size, hasher)
    return s, row[: len(s)] == row[size - 1 :][: len(s)]


def _bits(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each hash."""
    wide = np.stack([h, mix(h ^ np.uint64(0x9E3779B97F4A7C15))], 1)
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as BLOCKS numbers of 16 bits each."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class Index:
    """Items' words, weighted shingles, fingerprints and Hamming block tables. Weights are counts in an item."""

    def __init__(self, items: list[tuple[object, str]], radius: int = RADIUS):
        import pyarrow as pa

        hasher, self.radius = Hasher(), radius
        row, h, _ = _words(pa.array([t or "" for _, t in items], pa.string()), hasher)
        cut = np.searchsorted(row, np.arange(len(items) + 1))
        self.ids, n, self.sets, prints = [], [], [], []
        for i, (key, _) in enumerate(items):
            words = h[cut[i] : cut[i + 1]]
            if len(words):
                s = window_hashes(words, min(SHINGLE, len(words)), hasher)
                self.ids.append(key)
                n.append(len(words))
                self.sets.append(np.unique(s, return_counts=True))
                prints.append(_bits(s).sum(0, dtype=np.int32))
        self.n = np.array(n, np.int64)
        self.prints = _prints(np.array(prints, np.int32).reshape(-1, BITS))
        self.sizes, group = np.unique(self.n, return_inverse=True)
        #: Shingles of any item, by their length.
        self.known = {k: np.unique(np.concatenate([s for (s, _), m in zip(self.sets, n, strict=True) if min(SHINGLE, m) == k])) for k in {min(SHINGLE, m) for m in n}}
        # items under group of equal size, block and each near value
        near = [0] + [sum(1 << b for b in c) for r in range(1, radius // BLOCKS + 1) for c in combinations(range(BITS // BLOCKS), r)]
        near = np.array(near, np.uint64)
        place = (group.astype(np.uint64)[:, None] << np.uint64(20)) | (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(16))[None]
        keys = (place[:, :, None] | (self.prints.astype(np.uint64)[:, :, None] ^ near)).ravel()
        order = np.argsort(keys, kind="stable")
        self.table, self.owner = keys[order], np.repeat(np.arange(len(n)), BLOCKS * len(near))[order].astype(np.int32)

    def near(self, group: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): items of this group of equal size within the radius of each window's fingerprint."""
        keys = np.uint64(group << 20) | (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(16))[None] | prints.astype(np.uint64)
        lo = np.searchsorted(self.table, keys.ravel())
        size = np.searchsorted(self.table, keys.ravel(), "right") - lo
        window = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS), size)
        item = self.owner[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())]
        pairs = np.unique(window * np.int64(len(self.n) + 1) + item)
        window, item = pairs // (len(self.n) + 1), pairs % (len(self.n) + 1)
        apart = np.bitwise_count((prints[window] ^ self.prints[item]).view(np.uint64)).sum(1)
        return window[apart <= self.radius], item[apart <= self.radius]

    def search(self, row: np.ndarray, h: np.ndarray, hasher: Hasher):
        """{(row, item): (similarity, -first word)} of each pair's best window with similarity >= SIMILARITY."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for k, known in self.known.items():
            s, whole = _shingles(h, row, k, hasher)
            if not len(s):
                continue
            hit = np.flatnonzero(whole & (known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s))
            if not len(hit):
                continue
            first, last = np.searchsorted(row, row[hit]), np.searchsorted(row, row[hit], "right")
            for g, size in enumerate(self.sizes.tolist()):
                m = size - k + 1
                if min(SHINGLE, size) != k:
                    continue
                # starts of windows that contain a hit and lie in its document
                lo, hi = np.maximum(hit - m + 1, first), np.minimum(hit, last - size)
                edge = np.zeros(len(s) + 2, np.int32)
                np.add.at(edge, lo[lo <= hi], 1)
                np.add.at(edge, hi[lo <= hi] + 1, -1)
                self._windows(best, g, np.flatnonzero(np.cumsum(edge)), m, s, row)
                # a document with fewer words than the item is its one window; it has to have enough shingles
                n = last - first - k + 1
                short = (last - first < size) & (n >= SIMILARITY * m - 1e-9)
                for a, m_own in np.unique(np.stack([first[short], n[short]], 1), axis=0).tolist():
                    self._windows(best, g, np.array([a]), m_own, s, row)
        return best

    def _windows(self, best, g, starts, m, s, row):
        for at in range(0, len(starts), WINDOWS):
            some = starts[at : at + WINDOWS]
            # running sums over the shingles that these windows cover
            use = np.zeros(some[-1] + m - some[0] + 1, np.int32)
            np.add.at(use, some - some[0], 1)
            np.add.at(use, some - some[0] + m, -1)
            covered = np.flatnonzero(np.cumsum(use))
            place = np.searchsorted(covered, some - some[0])
            sums = np.zeros((len(covered) + 1, BITS), np.int32)
            np.cumsum(_bits(s[covered + some[0]]), axis=0, out=sums[1:])
            for w, i in zip(*(x.tolist() for x in self.near(g, _prints(sums[place + m] - sums[place]))), strict=True):
                self._verify(best, i, int(some[w]), m, s, row)

    def _verify(self, best, i, start, m, s, row):
        keys, counts = self.sets[i]
        got, c = np.unique(s[start : start + m], return_counts=True)
        at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
        both = np.where(keys[at] == got, np.minimum(counts[at], c), 0).sum()
        similarity, key = float(both / (counts.sum() + c.sum() - both)), (int(row[start]), i)
        if similarity >= SIMILARITY and (similarity, -start) > best.get(key, (0.0, 0)):
            best[key] = (similarity, -start)


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, items: int):
    """The benchmark, broadcast in parts of about `items` items at most."""
    spark = benchmark.sparkSession
    listed = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    n = max(1, -(-listed.count() // items))
    for p in range(n):
        some = listed if n == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p)
        yield spark.sparkContext.broadcast([tuple(r) for r in some.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, items: int = ITEMS) -> DataFrame:
    """Pairs of documents and the benchmark items they contain: doc_id, item_id, first_word, similarity.

    One row per pair, with the best window: the highest similarity, then the
    earliest; first_word counts the document's words between white space from 0.
    A document of fewer words than the item is compared as a whole.
    An item of fewer words than SHINGLE is one shingle; items without words match
    nothing. Null texts have no words. Null ids are passed on. Rows that repeat an
    id give rows of their own, and so do items that repeat. Empty tables give no
    rows. Other columns are not read. The benchmark is a stated query set: it goes
    to every task in parts of about `items` items, each part a pass over the
    documents.
    """
    import pyarrow as pa

    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    empty = docs.sparkSession.createDataFrame([], f"item_id {kinds[1]}").toArrow().schema.field(0).type
    out = None
    for index in _parts(benchmark, item_col, item_text_col, items):

        def run(batches, index=index):
            table, hasher = Index(index.value), Hasher()
            for b in batches:
                schema = pa.schema([("doc_id", b.schema.field(0).type), ("item_id", empty), ("first_word", pa.int64()), ("similarity", pa.float64())])
                for part in slices(b, 1):
                    row, h, place = _words(part.column(1), hasher)
                    found = [(part.column(0)[r].as_py(), table.ids[i], int(place[-first]), similarity) for (r, i), (similarity, first) in sorted(table.search(row, h, hasher).items())]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        got = rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, similarity double")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, items: int = ITEMS) -> DataFrame:
    """docs without the rows whose text contains an item, with all columns; see contaminated()."""
    import pyarrow as pa

    at = docs.columns.index(text_col)
    for index in _parts(benchmark, item_col, item_text_col, items):

        def run(batches, index=index):
            table, hasher = Index(index.value), Hasher()
            for b in batches:
                for part in slices(b, at):
                    row, h, _ = _words(part.column(at), hasher)
                    stay = np.ones(part.num_rows, bool)
                    stay[[r for r, _ in table.search(row, h, hasher)]] = False
                    yield part.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
