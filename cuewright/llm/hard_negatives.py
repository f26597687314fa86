"""Hard negatives of anchors by a blocked matrix product.

Rows and anchors are packed into blocks of rows, in the order of their labels, and
each block into chunks of dimensions. A tile is an anchors' block against a rows'
block: the products of its chunks are worked out apart (in doubles, which hold them
exactly), cast to int64, sent to the tile's key and added there. No scores outlive
their tile: it leaves the best of each of its anchors.

Positives come first, from the tiles whose blocks share a label, then negatives, from
all but the tiles of a single label. A positive's window of scores goes with its
anchor to each tile, and the tile leaves the first `negatives` rows in the window.
What tiles leave is ranked for each anchor, and positive, behind a partial limit.

A component x becomes floor(256 * x), held between -MOST and MOST so that a score of
up to 4,096 dimensions fits a long; that is exact for |x| below 65,536. Missing
components of shorter vectors count as 0. Rows with a null id, label or vector, or
with a component that is null or not finite, take no part. Rows of the same id are rows of
their own, but none is a positive of an anchor of that id. An anchor without other
rows of its label has no result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, tidy

SCALE, MOST = 256.0, 1 << 24
#: Dimensions of a chunk: a sum of so many products of MOST is the largest that doubles count up to exactly.
CHUNK = 32
#: Rows and anchors of a block. A tile of both has 4 MB.
ROWS, ANCHORS = 4096, 128
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between so many hundredths of the positive's.
LEAST, HIGHEST = 30, 90


def _usable(rows: DataFrame, id_col: str, label: Column, vec_col: str, anchor: Column) -> DataFrame:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    usable = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"), anchor.alias("anchor"))
    return usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", good))


def _packed(block: int, rows: pa.RecordBatch):
    """The chunks of a block of rows (id, label, vec)."""
    cut = rows.column(2).offsets.to_numpy()
    lengths, flat = np.diff(cut), rows.column(2).flatten().to_numpy(False).astype(np.float64)
    row, col = np.repeat(np.arange(rows.num_rows), lengths), np.arange(len(flat)) - np.repeat(cut[:-1] - cut[0], lengths)
    whole = np.zeros((rows.num_rows, -(-max(1, int(lengths.max(initial=0))) // CHUNK) * CHUNK), np.int32)
    whole[row, col] = np.clip(np.floor(flat * SCALE), -MOST, MOST)
    ids, labels = (np.ascontiguousarray(rows.column(k).to_numpy(False)) for k in (0, 1))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
    for c in range(whole.shape[1] // CHUNK):
        values = block, c, int(labels[0]), int(labels[-1]), ids.tobytes(), labels.tobytes(), np.ascontiguousarray(whole[:, c * CHUNK : (c + 1) * CHUNK]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "chunk", "first_label", "last_label", "ids", "labels", "part"])


def _blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """block, chunk, first_label, last_label, ids, labels, part: rows by label in blocks of `size`, their components in chunks of CHUNK.

    ids, labels and part are arrays of int64, int64 and int32 as bytes. A task packs
    about four blocks, whose last one may be smaller; however often a row is
    repeated, its number deals it out.
    """
    from pyspark import TaskContext

    def run(batches):
        held, n, blocks = [], 0, itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield from _packed(next(blocks), whole.slice(0, size).to_batches()[0])
                held, n = whole.slice(size).to_batches(), n - size
        if n:
            yield from _packed(next(blocks), pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    parts = max(1, -(-count // (4 * size)))
    ordered = rows.select("id", "label", "vec", F.monotonically_increasing_id().alias("number")).repartitionByRange(parts, "label", "id", "number").coalesce(parts)
    ordered = ordered.sortWithinPartitions("label", "id", "number").select("id", "label", "vec")
    return ordered.mapInArrow(run, "block long, chunk int, first_label long, last_label long, ids binary, labels binary, part binary")


def _tiles(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, extra: str | None = None) -> DataFrame:
    """anchors, rows, chunk, scores (int64 as bytes), both sides' ids and labels: the chunks' products of pairs (anchors, rows) of blocks.

    extra: a column of pairs that goes with them.
    """
    own = [extra] if extra else []
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in own)
    a = anchors.select(F.col("block").alias("anchors"), "chunk", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("part").alias("a_part"))
    r = rows.select(F.col("block").alias("rows"), "chunk", F.col("ids").alias("r_ids"), F.col("labels").alias("r_labels"), F.col("part").alias("r_part"))
    keep = ["anchors", "rows", "chunk", "a_ids", "a_labels", "r_ids", "r_labels", *own]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1)
                left, right = (np.frombuffer(x.column(k)[0].as_buffer(), np.int32).reshape(-1, CHUNK).astype(np.float64) for k in ("a_part", "r_part"))
                scores = (left @ right.T).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(x.column(k) for k in keep), pa.array([scores.tobytes()], pa.binary())], [*keep, "scores"])

    joined = pairs.join(a, "anchors").join(r, ["rows", "chunk"])
    return joined.select(*keep, "a_part", "r_part").mapInArrow(run, "anchors long, rows long, chunk int, a_ids binary, a_labels binary, r_ids binary, r_labels binary, " + (kinds + ", " if own else "") + "scores binary")


def _summed(batches):
    """The tile of a key, its chunks added up as they come: the last batch and the scores; None if a group is empty."""
    total, last = None, None
    for b in batches:
        for buffer in b.column("scores"):
            part = np.frombuffer(buffer.as_buffer(), np.int64)
            total = part.copy() if total is None else np.add(total, part, out=total)
        last = pa.RecordBatch.from_arrays([b.column(c).slice(0, 1) for c in b.schema.names if c != "scores"], [c for c in b.schema.names if c != "scores"]) if b.num_rows else last
    if last is None:
        return None
    longs = {k: np.frombuffer(last.column(k)[0].as_buffer(), np.int64) for k in ("a_ids", "a_labels", "r_ids", "r_labels")}
    return last, longs, total.reshape(len(longs["a_ids"]), -1)


def _positives(tiles: DataFrame, positives: int) -> DataFrame:
    """anchors, nth (place in the block), k (from 1), anchor_id, positive_id, positive_score: the best rows of each anchor's label other than itself."""
    names = ["anchors", "nth", "anchor_id", "positive_id", "positive_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _summed(batches)) is None:
            return
        b, x, scores = got
        block, out = b.column("anchors")[0].as_py(), []
        order = np.argsort(x["r_ids"], kind="stable")
        for i, (own, label) in enumerate(zip(x["a_ids"], x["a_labels"], strict=True)):
            same = order[(x["r_labels"][order] == label) & (x["r_ids"][order] != own)]
            same = same[np.argsort(-scores[i, same], kind="stable")[:positives]]
            out.append(np.stack([np.full(len(same), v) for v in (block, i, own)] + [x["r_ids"][same], scores[i, same]], 1))
        out = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, k])) for k in range(5)], names)

    rows = tiles.groupBy("anchors", "rows").applyInArrow(run, ", ".join(f"{n} long" for n in names))
    best = Window.partitionBy("anchors", "nth").orderBy(F.desc("positive_score"), "positive_id")
    return rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives).withColumn("k", F.col("k").cast("long"))


def _negatives(tiles: DataFrame, negatives: int, least: int, highest: int) -> DataFrame:
    """anchors, nth, k, anchor_id, positive_id, positive_score, negative_id, negative_score: the first rows of each window in each tile."""
    names = ["anchors", "nth", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := _summed(batches)) is None:
            return
        b, x, scores = got
        block, wanted = b.column("anchors")[0].as_py(), b.column("windows").flatten()
        nth, k, pid, pscore = (wanted.field(f).to_numpy(False) for f in ("nth", "k", "positive_id", "positive_score"))
        # the window's bounds, rounded into it without products of scores
        low, high = pscore // 100 * least - (-(pscore % 100 * least) // 100), pscore // 100 * highest + pscore % 100 * highest // 100
        order, out = np.argsort(x["r_ids"], kind="stable"), []
        for i in np.unique(nth):
            other = order[x["r_labels"][order] != x["a_labels"][i]]
            other = other[np.argsort(-scores[i, other], kind="stable")]
            down = -scores[i, other]
            for j in np.flatnonzero(nth == i):
                a, z = np.searchsorted(down, -high[j], "left"), np.searchsorted(down, -low[j], "right")
                take = other[a : min(z, a + negatives)]
                out.append(np.stack([np.full(len(take), v) for v in (block, i, k[j], x["a_ids"][i], pid[j], pscore[j])] + [x["r_ids"][take], scores[i, take]], 1))
        out = np.concatenate(out) if out else np.zeros((0, 8), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, c]).astype(np.int64)) for c in range(8)], names)

    return tiles.groupBy("anchors", "rows").applyInArrow(run, ", ".join(f"{n} long" for n in names))


@tidy
def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vec_col: str = "embedding", *, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, highest: int = HIGHEST, block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the rows where `anchor` holds.

    An anchor's positives are its `positives` best other rows of the same label, and
    to each belong the `negatives` best rows of other labels whose score is at least
    `least` and at most `highest` hundredths of the positive's. Equal scores go by id.
    """
    usable = durable(_usable(rows, id_col, F.col(label) if isinstance(label, str) else label, vec_col, F.coalesce(anchor, F.lit(False))))
    count = usable.agg(F.count("*").alias("all"), F.count_if("anchor").alias("anchors")).first()
    r = durable(_blocks(usable, block_rows, count["all"]))
    a = durable(_blocks(usable.where("anchor"), block_anchors, count["anchors"]))
    # every block of anchors meets every block of rows: the anchors' blocks get numbers from 1, and a row for each number is made of the rows' block
    head = lambda t, k: t.where("chunk = 0").select(F.col("block").alias(k), F.col("first_label").alias(f"{k}_first"), F.col("last_label").alias(f"{k}_last"))
    n = a.where("chunk = 0").count()
    numbers = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    numbered = head(a, "anchors").withColumn("number", F.row_number().over(Window.orderBy("anchors")))
    grid = durable(head(r, "rows").withColumn("number", F.explode(numbers)).join(numbered, "number"))
    shared = (F.col("anchors_first") <= F.col("rows_last")) & (F.col("rows_first") <= F.col("anchors_last"))
    single = (F.col("anchors_first") == F.col("anchors_last")) & (F.col("rows_first") == F.col("rows_last"))
    p = durable(_positives(_tiles(grid.where(shared).select("anchors", "rows"), a, r), positives))
    windows = p.groupBy("anchors").agg(F.collect_list(F.struct("nth", "k", "positive_id", "positive_score")).alias("windows"))
    n = _negatives(_tiles(grid.where(~(shared & single)).select("anchors", "rows").join(windows, "anchors"), a, r, "windows"), negatives, least, highest)
    key = ["anchors", "nth"]
    best = Window.partitionBy(*key, "k").orderBy(F.desc("negative_score"), "negative_id")
    n = n.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return n.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
