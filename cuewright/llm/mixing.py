"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document is due e = target / source
size copies: floor(e) certain whole ones, and one more with inclusion probability
p = e - floor(e). Documents are ranked by their random odds u / (1 - u) over their
inclusion odds p / (1 - p), and the first ones that fill the rest of the target
are taken. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, text_or_empty

#: Parts into which each source's ranking is cut; only the part that holds the end of the sample is sorted.
PARTS = 4096
#: Sum of the weights' share of all words, and the most copies of a document.
SHARE, MOST = 1.5, 2
#: Weights that the sources take in turn, in code point order.
WEIGHTS = (5, 2, 1)
SEED = 17


def words(text: str | Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> with target, in words.

    Sources sorted by code point, null last, weigh as `weights` repeating. The
    targets share `share` of all words by weight; each stops at `most` times its
    source's size, and the excess goes to the rest by weight. Takes a table with
    one row per source, which one task ranks.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size").cast("double") * most)
    full = Window.partitionBy()
    # filled in the order of cap / weight, the first sources reach their cap
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(full).cast("double") * share).withColumn("all_weight", F.sum("weight").over(full))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("spent", F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("all_weight") - F.col("spent")))
    s = s.withColumn("over", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("over"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(full)["level"]
    return s.withColumn("shared", level).select("source", "source_size", F.when(F.col("over") | F.col("shared").isNull(), F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """Choose the copies of each document that the mix takes; see _mixed().

    Returns doc_id, size, source_size, target, taken, copies, text_hash, one row
    per row of docs. Null text has size 0, a null source is a source of its own, and a null
    id draws the random number of an empty id; rows that repeat an id share its
    number and are ordered by size. Documents of no words are taken 0 times. The
    last document taken of a source is the one whose middle word is still within
    the target, so the words taken differ from it by half a document at most. An
    empty table gives no rows. Reruns give the same rows.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, share, most, seed, parts).drop("source")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """mix() with the source."""
    rows = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), F.xxhash64(text_or_empty(text_col)).alias("text_hash")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("sure", F.least(F.floor("due"), F.lit(most)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("sure") * F.col("source_size")).withColumn("p", F.col("due") - F.col("sure"))
    plan = durable(plan)
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranked = ranked.withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds)).withColumn("part", F.floor(F.col("q") / (1 + F.col("q")) * parts))
    # words before each part, then the part in which the target ends
    cut = ranked.where("q is not null").groupBy("source", "part").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    cut = cut.select(F.col("source").alias("of"), F.col("part").alias("in_part"), "before", "n")
    ranked = ranked.join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")), "left").drop("of", "in_part")
    inside, outside = F.col("before") + F.col("n") <= F.col("rest"), F.col("before") >= F.col("rest")
    open_part = F.col("q").isNotNull() & ~inside & ~outside
    order = Window.partitionBy("source", "part").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    ended = ranked.where(open_part).withColumn("extra", (done + F.col("size") / 2 <= F.col("rest")).cast("long"))
    sure = ranked.where(~F.coalesce(open_part, F.lit(False))).withColumn("extra", F.when(F.col("q").isNotNull() & inside, 1).otherwise(0).cast("long"))
    out = sure.unionByName(ended).withColumn("copies", F.when(F.col("size") > 0, F.col("sure") + F.col("extra")).otherwise(F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "text_hash", "source")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies, with all columns and `copy` from 1.

    If docs has a column of that name, underscores are put behind the new one's. Of
    rows that repeat id, text and source it doesn't matter which gets a copy more.
    """
    taken = _mixed(docs, id_col, text_col, source_col, **options)
    # such rows share their random number, so their copies differ by 1 at most
    taken = taken.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("source").alias("__source")).agg(F.count("*").alias("__rows"), F.min("copies").alias("__least"), F.sum("copies").alias("__all"))
    taken = durable(taken.where("__all > 0"))
    out = docs.join(taken, docs[id_col].eqNullSafe(taken["__id"]) & (F.xxhash64(text_or_empty(docs[text_col])) == taken["__hash"]) & docs[source_col].eqNullSafe(taken["__source"]))
    more = F.col("__all") - F.col("__rows") * F.col("__least")
    if taken.where("__rows > 1").isEmpty():
        out = out.withColumn("__copies", F.col("__all"))
    else:
        nth = F.row_number().over(Window.partitionBy("__id", "__hash", "__source").orderBy("__rows"))
        repeated = out.where("__rows > 1").withColumn("__copies", F.col("__least") + (nth <= more).cast("long"))
        out = out.where("__rows = 1").withColumn("__copies", F.col("__all")).unionByName(repeated).where("__copies > 0")
    name = "copy"
    while name in docs.columns:
        name += "_"
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias(name))
