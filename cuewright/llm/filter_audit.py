"""Which of several filters removes what, in every order of them.

Documents are counted into cells, one for each part and set of filters that they
fail; all that follows works on 2**k cells of a part. The k! orders are visited by
swaps of two neighbours (the plain-changes walk), and a swap changes two steps: what
its two filters remove is summed up again from the cells, all else stays. A filter's
share (its removed documents over all orders) is added up along the walk, for as many
visits as it kept its value.

A document without a part belongs to the part ''. One with a null flag passes that
filter. Of several label rows of a document, one that says 1 counts; a document with
a null id has no labels. Repeated documents count as often as they occur.
"""

from __future__ import annotations

from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty

#: Orders grow as the factorial: eight filters have 40,320 of them.
MOST = 8
#: A null id is dealt out to so many keys.
SALTS = 1024
STEP_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_changes(n: int):
    """All orders of range(n) as (order, k): each comes from the one before by swapping places k and k + 1; the first has k None."""
    order, way = list(range(n)), [-1] * n
    yield tuple(order), None
    while True:
        # the largest item that can go on its way passes its neighbour, and all larger ones turn round
        free = [x for x in order if 0 <= (to := order.index(x) + way[x]) < n and order[to] < x]
        if not free:
            return
        x = max(free)
        at = order.index(x)
        order[at], order[at + way[x]] = order[at + way[x]], x
        k = min(at, at + way[x])
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield tuple(order), k


def walk(cells: np.ndarray):
    """Visit all orders for parts with cells[part, mask, (documents, good, toxic)].

    Gives (order, counts) for each order, counts[part, step, STEP_COUNTS but the
    last], and at the end (None, shares[part, filter]).
    """
    n = cells.shape[1].bit_length() - 1
    masks = np.arange(1 << n)
    fails = np.stack([cells[:, (masks >> f) & 1 > 0, 0].sum(1) for f in range(n)], 1)
    unique = cells[:, [1 << f for f in range(n)], 0]
    out, gone = np.zeros((len(cells), n, len(STEP_COUNTS) - 1), np.int64), np.zeros((len(cells), n), np.int64)
    total, shares, since = cells[:, :, 0].sum(1), np.zeros((len(cells), n), np.int64), [0] * n
    visits = 0
    for order, k in plain_changes(n):
        for step in range(n) if k is None else (k, k + 1):
            f, before = order[step], sum(1 << g for g in order[:step])
            shares[:, f] += gone[:, f] * (visits - since[f])
            since[f] = visits
            lost = cells[:, ((masks & before) == 0) & ((masks >> f) & 1 > 0)].sum(1)
            gone[:, f] = lost[:, 0]
            left = out[:, step - 1, 0] if step else total
            for i, v in enumerate((left - lost[:, 0], lost[:, 0], fails[:, f] - lost[:, 0], unique[:, f], lost[:, 1], lost[:, 2])):
                out[:, step, i] = v
        visits += 1
        yield order, out
    shares += gone * (visits - np.array(since))
    yield None, shares


def cells_of(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column, weight: Column | None = None) -> DataFrame:
    """part, mask (bit i: the i-th filter fails), docs, good, toxic: the documents' counts, a row for each mask that occurs."""
    fails = [F.coalesce(c, F.lit(False)) for c in filters.values()]
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))
    w = F.lit(1).cast("long") if weight is None else weight
    flagged = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), w).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask")).agg(F.sum(w).alias("docs"), flagged(good).alias("good"), flagged(toxic).alias("toxic"))


def audit_cells(cells: DataFrame, names: list[str]) -> DataFrame:
    """part, filter_order, step and STEP_COUNTS, for every order of the filters called `names` (a letter each)."""
    import pyarrow as pa

    n = len(names)
    if not 0 < n <= MOST:
        raise ValueError(f"between 1 and {MOST} filters can be audited")
    numbers = ("docs", "good", "toxic")
    at_once = max(1, (1 << 16) // factorial(n))

    def run(batches):
        for b in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once)):
            each = b.column(1)
            sizes = np.diff(each.offsets.to_numpy())
            flat = each.flatten()
            table = np.zeros((b.num_rows, 1 << n, 3), np.int64)
            at = np.repeat(np.arange(b.num_rows), sizes), flat.field("mask").to_numpy(False)
            for i, k in enumerate(numbers):
                table[*at, i] = flat.field(k).to_numpy(False)
            orders, counts = [], []
            for order, got in walk(table):
                if order is not None:
                    orders.append(order)
                    counts.append(got.copy())
            x = np.stack(counts, 1)  # part, order, step, count
            shares = got[:, np.array(orders)][..., None]
            x = np.concatenate([x, shares], 3).reshape(-1, len(STEP_COUNTS))
            parts = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(orders) * n)))
            text = pa.array(["".join(names[f] for f in o) for o in orders]).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), n), b.num_rows)))
            step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b.num_rows * len(orders)))
            yield pa.RecordBatch.from_arrays([parts, text, step, *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], ["part", "filter_order", "step", *STEP_COUNTS])

    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *numbers)).alias("cells"))
    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in STEP_COUNTS))


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, good: Column, toxic: Column) -> DataFrame:
    """audit_cells() of rows whose filters, by a letter each, are columns that are true where a document fails."""
    return audit_cells(cells_of(rows, filters, part, good, toxic), list(filters))


def text_flags(text: Column) -> dict[str, Column]:
    """What the filters A to D find in a text: few words, repeated words, many capitals, odd signs."""
    plain = F.regexp_replace(text, SPACE, " ")
    words = F.array_remove(F.split(plain, " "), "")
    n, distinct = (F.size(c).cast("long") for c in (F.col("_words"), F.array_distinct("_words")))
    return {
        "_words": words,
        "A": n < 100,
        "B": distinct * 100 < n * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """cells_of() documents under the filters A to E, E for a text that a smaller id has.

    Equal texts are those of equal SHA-256. Texts are not shuffled: a row's flags and
    hash are joined with its labels by id, rows of one text are put together before
    the least id of a text is looked for, so that many copies are few rows by then.
    A null id is no smaller one, and has none.
    """
    text = text_or_empty("text")
    flags = text_flags(text)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("_words", flags.pop("_words")).select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), *(c.alias(k) for k, c in flags.items()))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int")).otherwise(0)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce("quality", F.lit(0)) == 1).alias("good"), F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("bad"))
    rows = rows.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0)), ["id", "salt"], "left")
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    kinds = ("hash", "part", "good", "bad", *flags)
    # rows of one id and text, then those of one text: how many there are, and how many have the least id
    per = rows.select("id", "salt", "hash", "part", mark("good"), mark("bad"), *flags).groupBy("id", "salt", *kinds).agg(F.count("*").alias("n"))
    per = per.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by("n", "id").alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0).cast("long"))).alias("nameless"))
    first = F.min("id").over(Window.partitionBy("hash"))  # over the parts and labels of a text
    per = per.withColumn("stay", F.col("nameless") + F.when(F.col("id") == first, F.col("least")).otherwise(F.lit(0).cast("long")))
    copies = per.withColumn("both", F.array(F.struct(F.lit(False).alias("E"), F.col("stay").alias("w")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("stay")).alias("w"))))
    copies = copies.select(*kinds, F.inline("both")).where("w > 0")
    return cells_of(copies, {k: F.col(k) for k in (*flags, "E")}, F.col("part"), F.col("good"), F.col("bad"), F.col("w"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit_cells() of documents (doc_id, text, lang) under the filters A to E, with what good and toxic ones by labels (doc_id, quality, toxic) are lost."""
    return audit_cells(document_cells(docs, labels), list("ABCDE"))
