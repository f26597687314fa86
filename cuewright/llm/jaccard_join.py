"""N-gram Jaccard join by chosen paths.

A text is the set of its 5-word shingles. Sets are embedded by MinHash: element
(i, value of the i-th MinHash), so that two sets share a coordinate with their
Jaccard similarity as probability. A start splits all sets on one coordinate. A
node samples coordinates that its path hasn't used, each with probability
1 / (similarity * coordinates left), and splits its sets on their values; small
nodes are compared by brute force, large ones split again. A pair survives a split
with an expected one shared child, so starts are added until pairs at the threshold
meet with the target recall at the depth that is reached: sets whose nodes still
split there get more starts.

Equal sets are one class from the start. Sketches only join candidates up into
components; within those, similarities of whole shingle sets decide.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, column_bytes, durable, lower_ascii, mix, slices, text_or_empty, window_hashes, word_bounds, word_hashes
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
COORDINATES = 64
RECALL = 0.999
#: Depth whose meeting probability sets the number of starts that all sets get.
PLANNED_DEPTH = 3
#: Sets in a node that are compared with each other; larger nodes split.
SMALL = 1024
#: A child with this share of its parent's sets holds near copies: they are joined up without further splits.
DENSE = 0.8
MOST_DEPTH = 16
#: Sketches below this agreement aren't candidates: 4 deviations below SIMILARITY with 64 coordinates.
SKETCH = 0.6
#: Sets that are verified against each other at once.
BLOCK = 256


def _agreements(similarity: float) -> np.ndarray:
    """Probability that a pair of this similarity agrees in 0, 1, .. COORDINATES coordinates."""
    return np.array([math.comb(COORDINATES, m) * similarity**m * (1 - similarity) ** (COORDINATES - m) for m in range(COORDINATES + 1)])


def least_agreement(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Coordinates in which candidates agree at least: those of SKETCH, or fewer where that alone loses half of 1 - recall."""
    below = np.cumsum(_agreements(similarity))
    return min(math.ceil(SKETCH * COORDINATES), int(np.searchsorted(below, (1 - recall) / 2, "right")))


def meeting(starts: int, depth: int, similarity: float = SIMILARITY, least: int = 0) -> float:
    """Probability that a pair at the threshold agrees in `least` coordinates and shares a node at `depth`.

    A node at depth k has used k coordinates and draws each other one with
    probability 1 / (similarity * (COORDINATES - k)).
    """
    m = np.arange(COORDINATES + 1)
    meet = np.ones(len(m))
    for k in range(depth - 1, 0, -1):
        meet = 1 - (1 - meet * min(1.0, 1 / (similarity * (COORDINATES - k)))) ** np.maximum(m - k, 0)
    met = 1 - (1 - m / COORDINATES * meet) ** starts
    return float((_agreements(similarity) * met)[least:].sum())


def starts_needed(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = PLANNED_DEPTH) -> int:
    """Starts after which a pair at the threshold has met at `depth` with probability `recall`."""
    least, high = least_agreement(similarity, recall), 1
    while meeting(high, depth, similarity, least) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if meeting(mid, depth, similarity, least) >= recall else (mid, high)
    return high


def shingle_sets(column, hasher: Hasher, size: int):
    """For each text its distinct shingle hashes, sorted; a shorter text is one shingle, one without words none."""
    buf, offsets = column_bytes(column)
    buf = lower_ascii(buf)
    starts, ends = word_bounds(buf, offsets)
    cut = np.searchsorted(starts, offsets)
    h = word_hashes(buf, starts, ends, hasher)
    s = window_hashes(h, size, hasher)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(s[a : b - size + 1])
        elif b > a:
            yield window_hashes(h[a:b], b - a, hasher)
        else:
            yield h[a:a]


def _minhashes(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    out = np.full(len(seeds), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 1 << 12):
        part = s[at : at + (1 << 12)]
        out = np.minimum(out, ((part[None] * seeds[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """uid, id, th, n (distinct shingles), f1, f2 (of the set), sig (MinHashes) for each row of docs."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        hasher, seeds, uid = Hasher(), _seeds(COORDINATES), TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, 2):
                n, f1, f2, sig = [], [], [], []
                for s in shingle_sets(part.column(2), hasher, size):
                    n.append(len(s))
                    f1.append(int(mix(s).sum(dtype=np.uint64)))
                    f2.append(int(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)))
                    sig.append(_minhashes(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), seeds).tobytes())
                uids = uid + np.arange(part.num_rows)
                uid += part.num_rows
                longs = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(uids), part.column(0), part.column(1), pa.array(n, pa.int32()), longs(f1), longs(f2), pa.array(sig, pa.binary())], ["uid", "id", "th", "n", "f1", "f2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"uid long, id {kind}, th long, n int, f1 long, f2 long, sig binary")


def _children(similarity: float, depth: int):
    """(path, parent, uid, used) of the nodes into which each row (path, uid, sig, used) at this depth falls."""
    import pyarrow as pa

    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * (COORDINATES - depth)))))
    index = mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(77))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            path = b.column(0).to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(v.as_buffer() for v in b.column(2)), np.uint32).reshape(-1, COORDINATES)
            used = b.column(3).to_numpy().view(np.uint64)
            for i in range(COORDINATES):
                bit = np.uint64(1 << i)
                draw = mix(path ^ index[i])
                take = np.flatnonzero((draw < limit) & (used & bit == 0))
                if len(take):
                    child = mix(draw[take] + sig[take, i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array((used[take] | bit).view(np.int64))], ["path", "parent", "uid", "used"])

    return run


def _leaf_links(least: int):
    """Stars (a, b) that join up the sets of a node whose sketches agree; rows come sorted by path."""
    import pyarrow as pa

    def stars(uid, sig):
        root = np.arange(len(uid))
        agree = np.stack([(sig == s).sum(1) for s in sig]) >= least
        while True:
            low = np.where(agree, root[None], len(uid)).min(1)
            low = np.minimum(low, root)
            if (low == root).all():
                break
            root = low
        return uid, uid[root]

    def run(batches):
        held_path, held_uid, held_sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, COORDINATES), np.uint32)

        def emit(path, uid, sig):
            cut = np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path)) if len(path) else np.zeros(1, np.int64)
            a, b = [], []
            two = np.flatnonzero(np.diff(cut) == 2)
            near = cut[two][(sig[cut[two]] == sig[cut[two] + 1]).sum(1) >= least] if len(two) else two
            a.append(uid[near])
            b.append(uid[near + 1])
            for k in np.flatnonzero(np.diff(cut) > 2):
                x, y = stars(uid[cut[k] : cut[k + 1]], sig[cut[k] : cut[k + 1]])
                a.append(x[x != y])
                b.append(y[x != y])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(2)), np.uint32).reshape(-1, COORDINATES)
            path, uid = np.append(held_path, batch.column(0).to_numpy()), np.append(held_uid, batch.column(1).to_numpy())
            sig = np.concatenate([held_sig, sig])
            end = int(np.searchsorted(path, path[-1]))  # the last node may go on in the next batch
            yield emit(path[:end], uid[:end], sig[:end])
            held_path, held_uid, held_sig = path[end:], uid[end:], sig[end:]
        yield emit(held_path, held_uid, held_sig)

    return run


def _starts(sets: DataFrame, first: int, end: int) -> DataFrame:
    """(path, parent, uid, used) of the nodes into which the starts first .. end - 1 split sets (uid, sig)."""
    rows = sets.withColumn("start", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))).withColumn("i", F.col("start") % COORDINATES)
    return rows.select(F.expr("xxhash64(start, substring(sig, 4 * i + 1, 4))").alias("path"), F.lit(0).cast("long").alias("parent"), "uid", F.expr("shiftleft(1L, i)").alias("used"))


def candidates(reps: DataFrame, similarity: float, recall: float) -> DataFrame:
    """Edges (a, b) between sets, so that sets of a pair at the threshold end up in one component.

    All sets get the starts that PLANNED_DEPTH needs. A pair that is missed for
    depth lies in nodes that split beyond it, so the sets of these get the starts
    that the deepest level needs, until no set goes deeper than its starts allow for.
    """
    least = least_agreement(similarity, recall)
    sigs = reps.select("uid", "sig")
    sets, done, planned, edges, leaves = sigs, 0, PLANNED_DEPTH, [], []
    while True:
        end = starts_needed(similarity, recall, planned)
        rows = durable(_starts(sets, done, end))
        parents, reached, splitting = None, 1, None
        for depth in range(1, MOST_DEPTH + 1):
            sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min("uid").alias("first"), F.first("parent").alias("parent")).where("size > 1")
            if parents is not None:
                sizes = sizes.join(parents, "parent").withColumn("dense", (F.col("size") >= DENSE * F.col("parent_size")) | F.lit(depth == MOST_DEPTH))
            else:
                sizes = sizes.withColumn("dense", F.lit(False))
            kept = durable(rows.drop("parent").join(sizes.select("path", "size", "first", "dense"), "path"))
            leaves.append(kept.where(F.col("size") <= SMALL).select("path", "uid"))
            large = kept.where(F.col("size") > SMALL)
            edges.append(large.where("dense and uid != first").select(F.col("uid").alias("a"), F.col("first").alias("b")))
            large = large.where("not dense")
            if large.isEmpty():
                break
            reached = depth + 1
            if depth == planned:
                splitting = large.select("uid").distinct()
            parents = large.select(F.col("path").alias("parent"), F.col("size").alias("parent_size")).distinct()
            nodes = large.select("path", "uid", "used").join(sigs, "uid").select("path", "uid", "sig", "used")
            rows = durable(nodes.mapInArrow(_children(similarity, depth), "path long, parent long, uid long, used long"))
        if splitting is None:
            break
        sets, done, planned = durable(splitting.join(sigs, "uid").select("uid", "sig")), end, reached
    # small nodes of all levels are compared in one pass
    small = reduce(DataFrame.unionByName, leaves).join(sigs, "uid").select("path", "uid", "sig")
    edges.append(small.repartition("path").sortWithinPartitions("path").mapInArrow(_leaf_links(least), "a long, b long").where("a is not null"))
    return reduce(DataFrame.unionByName, edges)


def _verify(similarity: float):
    """Exact links inside groups of rows (comp, i, j, block, uid, m, s) that come sorted by (comp, i, j).

    Gives (uid, links, root) for each member of a group: the number of documents in
    other classes it links to, and the smallest set that it is linked with in the
    group, directly or through others.
    """
    import pyarrow as pa

    def shared(sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of the intersections of all pairs of sets."""
        if len(sets) == 2:
            n = len(np.intersect1d(*sets, assume_unique=True))
            return np.array([[len(sets[0]), n], [n, len(sets[1])]])
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keys, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(n > 1) - 1
        use = n[at] > 1
        who, at = who[use], place[at[use]]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        total = np.zeros((len(sets), len(sets)), np.float64)
        step = 4096
        cuts = np.searchsorted(at, np.arange(0, (at[-1] + step + 1) if len(at) else 1, step))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((len(sets), step), np.float32)
            m[who[a:b], at[a:b] - k * step] = 1
            total += m @ m.T
        return total

    def group(i, j, block, uid, m, sets):
        n = np.array([len(s) for s in sets])
        both = shared(sets)
        linked = both >= similarity * (n[:, None] + n[None] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:  # pairs inside a block are counted in the group (i, i)
            linked &= (block[:, None] != block[None])
        root = uid
        while True:  # the smallest of all that are linked with it, through others too
            low = np.minimum(np.where(linked, root[None], root[:, None]).min(1), root)
            if (low == root).all():
                return uid, linked @ m, root
            root = low

    def run(batches):
        held = None

        def groups(rows):
            key = rows[0]
            cut = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(key))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                # a set comes once, though rows may repeat an id and a text
                first = np.unique(rows[2][a:b], return_index=True)[1] + a
                yield key[a], rows[1][first], rows[2][first], rows[3][first], [rows[4][x] for x in first]

        def emit(rows):
            got = [group(k[1], k[2], block, uid, m, sets) for k, block, uid, m, sets in groups(rows) if len(uid) > 1]
            if got:
                uid, links, root = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(links.astype(np.int64)), pa.array(root)], ["uid", "links", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = [np.stack([b.column(c).to_numpy() for c in range(3)], 1), b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy(), [np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(6)]]
            if held:
                rows = [np.concatenate([x, y]) if isinstance(x, np.ndarray) else x + y for x, y in zip(held, rows, strict=True)]
            end = int(np.flatnonzero((rows[0] != rows[0][-1]).any(1)).max(initial=-1)) + 1
            if end:
                yield from emit([x[:end] for x in rows])
            held = [x[end:] for x in rows]
        if held:
            yield from emit(held)

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """Near-duplicate links of each document: doc_id, class_id, n_links, text_hash.

    Links are pairs of documents whose sets of lower-case (A-Z) word shingles have
    a Jaccard similarity of at least `similarity`; n_links counts a document's, and
    class_id is the smallest id among the documents it is linked with directly or
    through others. One row per row of docs. A text of fewer words than `shingle`
    is one shingle; a null text or one without words has no links. Null ids sort
    last; a class of null ids alone has a null class_id. Rows that repeat an id are
    documents of their own. An empty table gives no rows. Other columns are not
    read. A pair at the threshold is found with a probability of about `recall`;
    what is found is exact.
    """
    import pyarrow as pa

    all_rows = durable(sketches(docs, id_col, text_col, shingle))
    key = ["n", "f1", "f2"]
    reps = durable(all_rows.where("n > 0").groupBy(*key).agg(F.count("*").alias("m"), F.min(F.struct("uid", "id", "th", "sig")).alias("r")).select(*key, "m", "r.*"))
    parts = components(candidates(reps, similarity, recall))
    parts = parts.join(parts.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "root")
    members = durable(parts.join(reps, parts["node"] == reps["uid"]).select(F.col("root").alias("comp"), "blocks", "uid", "m", F.col("id").alias("of"), F.col("th").alias("of_th")))

    def sets(batches):
        hasher = Hasher()
        for b in batches:
            for part in slices(b, 0):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s in shingle_sets(part.column(0), hasher, shingle)], pa.binary())], ["comp", "blocks", "uid", "m", "s"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    chosen = texts.join(members.hint("merge"), F.col("id").eqNullSafe(F.col("of"))).where(F.xxhash64("text") == F.col("of_th")).select("text", "comp", "blocks", "uid", "m")
    placed = chosen.mapInArrow(sets, "comp long, blocks int, uid long, m long, s binary").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
    # a block meets each block of its component once
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("comp", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), "block", "uid", "m", "s")
    found = placed.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify(similarity), "uid long, links long, root long")
    found = durable(found.groupBy("uid").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots")))
    # sets verified in one block have one root; others may be linked through several
    split = found.where("size(roots) > 1")
    if not split.isEmpty():
        linked = components(found.select(F.col("uid").alias("a"), F.explode("roots").alias("b")))
        found = found.join(linked.withColumnRenamed("node", "uid"), "uid", "left")
    else:
        found = found.withColumn("root", F.get("roots", F.lit(0)))
    found = found.select("uid", "links", "root")
    classes = reps.join(found, "uid", "left").select(*key, "m", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "uid").alias("root"))
    rows = all_rows.where("n > 0").select(*key, "id", "th").join(classes, key)
    least = rows.groupBy("root").agg(F.min("id").alias("class_id"))
    out = rows.join(least, "root").select(F.col("id").alias("doc_id"), "class_id", (F.col("links") + F.col("m") - 1).alias("n_links"), F.col("th").alias("text_hash"))
    alone = all_rows.where("n = 0").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("th").alias("text_hash"))
    return out.unionByName(alone)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with only the document of the smallest id of each class; all columns.

    Texts without words all stay. Rows that repeat id and text are one document.
    """
    gone = join(docs, id_col, text_col, **options).where(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(text_or_empty(docs[text_col])) == gone["gone_hash"]), "left_anti")
