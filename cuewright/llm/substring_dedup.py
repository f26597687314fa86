"""Substring deduplication with difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a k below v with
both (i + k) mod v and (j + k) mod v in D. If two windows of n words are equal, so
are the shorter windows of n - v + 1 words at such an i + k and j + k. So only
windows at cover positions are hashed (anchors), and full windows only around
anchors that occur twice.

Equal hashes meet by shard of the hash value. Each Arrow batch of rows is a block
that sends its own distinct hashes only, so a passage that a third of all
documents hold costs one entry per block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, column_bytes, rows_of, slices, text_or_empty, window_hashes, word_bounds, word_hashes

#: Words in a window.
WINDOW = 35
# Perfect difference sets, which are the smallest covers of their period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
PERIOD = 21
#: Bytes of text for each shard of hash values.
SHARD_BYTES = 16 << 20
_OTHER = 0xD6E8FEB86659FD93


def covers(cover, period: int) -> bool:
    """Whether cover is a difference cover modulo period."""
    return len({(a - b) % period for a in cover for b in cover}) == period


def _bytes(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def repeated(df: DataFrame, keys, shards: int) -> DataFrame:
    """Positions whose key occurs at least twice among all rows: id, th, at.

    df has the columns id and th, which name a row, and any others. keys(batch)
    yields (row, pos, h, check) arrays: row in the batch, position, 64-bit key and
    32 more bits of it. Rows with none of these positions are left out; at holds
    the positions as int32 bytes in ascending order.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    kind = df.schema["id"].dataType.simpleString()
    mail = f"shard int, block long, h binary, chk binary, row binary, pos binary, ids array<{kind}>, ths array<int>"
    names = ["shard", "block", "h", "chk", "row", "pos", "ids", "ths"]

    def send(batches):
        part, count = TaskContext.get().partitionId(), 0
        for b in batches:
            got = list(keys(b))
            if not got:
                continue
            row, pos, h, chk = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(h):
                continue
            block, count = (part << 32) | count, count + 1
            order = np.lexsort((chk, h))
            row, pos, h, chk = row[order], pos[order], h[order], chk[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (chk[1:] != chk[:-1])
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(h))) > 1
            twice = np.repeat(many, np.diff(np.append(at, len(h))))
            sent = np.where(many, -1, row[at])  # -1: repeated inside the block
            shard = ((h[at] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            out = [[block % shards, block, None, None, _bytes(row[twice], np.int32), _bytes(pos[twice], np.int32), b.column("id").to_pylist(), b.column("th").to_pylist()]]
            for s in range(shards):
                x = at[cuts[s] : cuts[s + 1]]
                if len(x):
                    out.append([s, block, _bytes(h[x], np.uint64), _bytes(chk[x], np.uint32), _bytes(sent[cuts[s] : cuts[s + 1]], np.int32), _bytes(pos[x], np.int32), None, None])
            schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("h", pa.binary()), ("chk", pa.binary()), ("row", pa.binary()), ("pos", pa.binary()), ("ids", pa.list_(b.schema.field("id").type)), ("ths", pa.list_(pa.int32()))])
            for one in out:  # a row at a time keeps the layout's copy of the ids single
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, schema, strict=True)], schema=schema)

    def meet(table):
        asked = table.filter(pc.is_valid(table["h"]))
        kept = table.filter(pc.is_null(table["h"])).select(names[1:])
        if not asked.num_rows:
            return kept
        load = lambda c, k: [np.frombuffer(v.as_buffer(), k) for v in asked[c]]
        h, chk, row, pos = load("h", np.uint64), load("chk", np.uint32), load("row", np.int32), load("pos", np.int32)
        src = np.repeat(np.arange(len(h)), [len(x) for x in h])
        h, chk, row, pos = (np.concatenate(x) for x in (h, chk, row, pos))
        order = np.lexsort((chk, h))
        a, c = h[order], chk[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.where(row[order] < 0, 2, 1))
        hit = np.zeros(len(a), bool)
        hit[order] = total[group] > 1
        hit &= row >= 0
        src, row, pos = src[hit], row[hit], pos[hit]
        blocks, cuts = asked["block"].to_pylist(), np.searchsorted(src, np.arange(asked.num_rows + 1))
        out = [(blocks[i], _bytes(row[s:e], np.int32), _bytes(pos[s:e], np.int32)) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
        if not out:
            return kept
        cols = dict(zip(("block", "row", "pos"), zip(*out, strict=True), strict=True))
        return pa.concat_tables([kept, pa.table([pa.array(cols.get(n, [None] * len(out)), kept.schema.field(n).type) for n in names[1:]], schema=kept.schema)])

    def gather(table):
        lay = table.filter(pc.is_valid(table["ids"]))
        ids, ths = lay["ids"].combine_chunks().flatten(), lay["ths"].combine_chunks().flatten()
        row, pos = (np.concatenate([np.frombuffer(v.as_buffer(), np.int32) for v in table[c]]) for c in ("row", "pos"))
        order = np.lexsort((pos, row))
        row, pos = row[order], pos[order]
        rows = np.unique(row)
        cuts = np.searchsorted(row, np.append(rows, len(ids)))
        return pa.table([ids.take(pa.array(rows)), ths.take(pa.array(rows)), pa.array([_bytes(pos[s:e], np.int32) for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["id", "th", "at"])

    met = df.mapInArrow(send, mail).groupBy("shard").applyInArrow(meet, mail.split(", ", 1)[1])
    return met.groupBy("block").applyInArrow(gather, f"id {kind}, th int, at binary")


def _anchors(size: int, period: int):
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    length = size - period + 1

    def keys(batch):
        hasher = Hasher()
        done = 0
        for part in slices(batch, 2):
            buf, offsets = column_bytes(part.column(2))
            starts, ends = word_bounds(buf, offsets)
            row = rows_of(offsets, starts)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            pos = np.arange(len(starts)) - first[row]
            left = first[row + 1] - first[row] - pos
            use = np.flatnonzero(cover[pos % period] & (left >= length) & (left + pos >= size))
            h = window_hashes(word_hashes(buf, starts, ends, hasher), length, hasher)[use]
            yield (row[use] + done).astype(np.int32), pos[use].astype(np.int32), h, np.zeros(len(use), np.uint32)
            done += part.num_rows

    return keys


def _around(size: int, period: int):
    """Full windows at every start from which an anchor that occurs twice is within reach."""

    def keys(batch):
        hasher, other = Hasher(), Hasher(_OTHER)
        done = 0
        for part in slices(batch, 2):
            buf, offsets = column_bytes(part.column(2))
            starts, ends = word_bounds(buf, offsets)
            row = rows_of(offsets, starts)
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            near = np.zeros(len(starts) + 1, np.int32)
            for i, at in enumerate(part.column(3)):
                a = np.frombuffer(at.as_buffer(), np.int32) + first[i]
                np.add.at(near, np.maximum(a - period + 1, first[i]), 1)
                np.add.at(near, a + 1, -1)
            pos = np.arange(len(starts)) - first[row]
            use = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (first[row + 1] - np.arange(len(starts)) >= size))
            words = word_hashes(buf, starts, ends, hasher)
            yield (row[use] + done).astype(np.int32), pos[use].astype(np.int32), window_hashes(words, size, hasher)[use], (window_hashes(words, size, other)[use] >> np.uint64(32)).astype(np.uint32)
            done += part.num_rows

    return keys


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Remove the words that a repeated window covers: doc_id, n_words, n_removed, kept_text.

    A window is `window` consecutive words of one document; it is repeated if its
    words also start anywhere else, in the same document too. One row per row of
    docs. Null and empty texts have no words. Rows that repeat an id are documents
    of their own; equal rows repeat each other's windows. Null ids are allowed.
    An empty table gives no rows. Other columns are not read. Windows are equal if
    96 bits of two independent hashes are.
    """
    import pyarrow as pa

    if period > window or not covers(COVERS[period], period):
        raise ValueError("the period needs a difference cover and may not exceed the window")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    same = lambda a, b: a["id"].eqNullSafe(b["row_id"]) & (a["th"] == b["row_th"])
    named = lambda d: d.withColumnsRenamed({"id": "row_id", "th": "row_th"}).groupBy("row_id", "row_th").agg(F.max("at").alias("at"))

    found = named(repeated(rows, _anchors(window, period), shards))
    # a merge join gives a partition's rows in the order of id and th, so a task that runs again numbers them alike
    near = rows.join(found.hint("merge"), same(rows, found)).select("id", "th", "text", "at")
    cut = named(repeated(near, _around(window, period), shards))

    def keep(batches):
        for b in batches:
            out = []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()
                n = len(words)
                if at.is_valid:
                    edge = np.zeros(n, np.int32)
                    a = np.frombuffer(at.as_buffer(), np.int32)
                    edge[a] = 1
                    sums = np.concatenate([np.zeros(window, np.int64), np.cumsum(edge[:n])])
                    gone = sums[window:] - sums[:n]  # repeated windows among the last `window` starts
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                out.append((n, n - len(words), b" ".join(words)))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = rows.join(cut, same(rows, cut), "left").select("id", "text", "at")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
