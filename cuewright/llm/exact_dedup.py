"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes b0, b1, ... have the fingerprint sum(b_i * x**i) modulo two
primes. The fingerprint of A followed by B is H(A) + x**len(A) * H(B), so chunks
of a huge document are hashed by separate tasks and put together afterwards.
Texts with equal fingerprints and lengths are then compared chunk by chunk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, text_or_empty

#: Two primes below 2**31, so that products of residues fit a signed long.
PRIMES = (2147483629, 2147483587)
POINTS = (1103515245, 1664525)
#: Chunk length in bytes; a sum of this many byte * residue products stays below 2**63.
CHUNK = 1 << 16
#: Longer texts have their chunks spread over tasks.
SPREAD = 1 << 20
#: Members of one class that share a copy of the class's first text.
FANOUT = 256


def squeezed(text: str | Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text), f"{SPACE}+", " ")


def _tables(primes, chunk):
    return [np.array(_residues(x % p, p, chunk), np.uint64) for x, p in zip(POINTS, primes)]


def _residues(x, p, n):
    out, v = [0] * n, 1
    for i in range(n):
        out[i], v = v, v * x % p
    return out


def _hasher(primes: tuple[int, int], chunk: int):
    """bytes -> (h1, h2, x1**n, x2**n), combining chunk hashes by shifting."""
    tables = _tables(primes, chunk)

    def fingerprint(data: bytes) -> tuple[int, int, int, int]:
        h, shift = [0, 0], [1, 1]
        for at in range(0, len(data), chunk):
            part = np.frombuffer(data, np.uint8, min(chunk, len(data) - at), at).astype(np.uint64) + np.uint64(1)
            for k in (0, 1):
                p = primes[k]
                h[k] = (h[k] + shift[k] * (int(np.dot(part, tables[k][: len(part)])) % p)) % p
                shift[k] = shift[k] * pow(POINTS[k] % p, len(part), p) % p
        return h[0], h[1], shift[0], shift[1]

    return fingerprint


def _chunks(data: Column, size: int) -> Column:
    """(idx, chunk) structs of a binary column; one empty chunk for an empty value."""
    last = F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("idx"), F.substring(data, i * size + 1, F.lit(size)).alias("chunk")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, primes=PRIMES, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """One row per row of docs: id, sha (of the squeezed text), n_bytes, h1, h2."""
    import pyarrow as pa

    out = "id {}, sha string, n_bytes long, h1 long, h2 long".format(docs.schema[id_col].dataType.simpleString())

    def whole(batches):
        fp = _hasher(primes, chunk)
        for b in batches:
            got = [fp(v.as_buffer()) for v in b.column(2)]
            h = np.array(got, np.int64).reshape(-1, 4)
            n = [len(v.as_buffer()) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["id", "sha", "n_bytes", "h1", "h2"])

    def parts(batches):
        fp = _hasher(primes, chunk)
        for b in batches:
            h = np.array([fp(v.as_buffer()) for v in b.column(4)], np.int64).reshape(-1, 4)
            n = [len(v.as_buffer()) for v in b.column(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(n, pa.int64()), *(pa.array(h[:, k]) for k in range(4))], ["id", "sha", "row", "idx", "n", "h1", "h2", "s1", "s2"])

    text = squeezed(text_col)
    long = F.coalesce(F.octet_length(text_col) > spread, F.lit(False))
    rows = lambda part: part.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("data"))
    small = rows(docs.where(~long)).mapInArrow(whole, out)
    huge = (
        rows(docs.where(long))
        .withColumn("row", F.monotonically_increasing_id())
        .select("id", "sha", "row", F.inline(_chunks(F.col("data"), chunk)))
        .repartition("row", "idx")
        .mapInArrow(parts, "id {}, sha string, row long, idx int, n long, h1 long, h2 long, s1 long, s2 long".format(docs.schema[id_col].dataType.simpleString()))
        .groupBy("row", "id", "sha")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "n", "h1", "h2", "s1", "s2"))).alias("parts"))
    )
    start = F.struct(*(F.lit(v).cast("long").alias(k) for k, v in (("n", 0), ("h1", 0), ("h2", 0), ("s1", 1), ("s2", 1))))
    joined = F.aggregate(
        "parts",
        start,
        lambda a, b: F.struct(
            (a.n + b.n).alias("n"),
            ((a.h1 + a.s1 * b.h1 % primes[0]) % primes[0]).alias("h1"),
            ((a.h2 + a.s2 * b.h2 % primes[1]) % primes[1]).alias("h2"),
            (a.s1 * b.s1 % primes[0]).alias("s1"),
            (a.s2 * b.s2 % primes[1]).alias("s2"),
        ),
    )
    huge = huge.select("id", "sha", joined.alias("f")).select("id", "sha", F.col("f.n").alias("n_bytes"), F.col("f.h1").alias("h1"), F.col("f.h2").alias("h2"))
    return small.unionByName(huge)


KEY = ["n_bytes", "h1", "h2"]


def _classes(fps: DataFrame, key: list[str]) -> DataFrame:
    return fps.groupBy(*key).agg(F.min("id").alias("keep"), F.count("*").alias("size"))


def _mismatches(docs: DataFrame, fps: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """(id, sha) of rows whose text differs from the first text of their fingerprint."""
    shared = _classes(fps, KEY).where("size > 1")
    members = fps.join(shared, KEY).select("id", "sha", "keep", F.ceil(F.col("size") / FANOUT).alias("fan"), F.col("id").eqNullSafe(F.col("keep")).alias("first"), *KEY).distinct()
    texts = (
        docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        .join(members, F.col("doc").eqNullSafe(F.col("id")))
        .withColumn("text", squeezed("text"))
        .where(F.sha2("text", 256) == F.col("sha"))
    )
    pieces = texts.select(*KEY, "keep", "id", "sha", "first", "fan", F.inline(_chunks(F.col("text").cast("binary"), chunk)))
    firsts = pieces.where("first").groupBy(*KEY, "idx", "fan").agg(F.min(F.struct("sha", "chunk")).alias("f"))
    firsts = firsts.select(*KEY, "idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("salt"), F.col("f.chunk").alias("first_chunk"))
    rest = pieces.withColumn("salt", F.pmod(F.xxhash64("sha", "id"), "fan"))
    compared = rest.join(firsts, [*KEY, "idx", "salt"], "left")
    return compared.where(~F.col("chunk").eqNullSafe(F.col("first_chunk"))).select("id", "sha").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, primes=PRIMES, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """Decide for each row of docs whether it stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of
    docs. Null text counts as empty, and all empty texts are equal. The smallest
    id of a class stays; a null id sorts last, and a class with none but null ids
    has a null keep_id. Of rows that repeat both id and text exactly one is kept.
    An empty table gives no rows. Other columns of docs are not read.
    """
    fps = durable(fingerprints(docs, id_col, text_col, primes=primes, chunk=chunk, spread=spread))
    todo, settled, level = fps, None, 0
    while True:
        bad = durable(_mismatches(docs, todo, id_col, text_col, chunk))
        clean = bad.isEmpty()
        same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("sha") == F.col("bad_sha"))
        odd = bad.select(F.col("id").alias("bad_id"), F.col("sha").alias("bad_sha"))
        good = (todo if clean else todo.join(odd, same, "left_anti")).withColumn("level", F.lit(level))
        settled = good if settled is None else settled.unionByName(good)
        if clean:
            break
        todo, level = todo.join(odd, same, "left_semi"), level + 1
    key = [*KEY, "level"]
    # written first, so that a join with a class of many members can be split
    rows = settled.join(durable(_classes(settled, key)), key)
    first = F.col("id").eqNullSafe(F.col("keep"))
    kept = rows.where(first).withColumn("kept", F.row_number().over(Window.partitionBy(*key).orderBy("sha")) == 1)
    rows = kept.unionByName(rows.where(~first).withColumn("kept", F.lit(False)))
    return rows.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
