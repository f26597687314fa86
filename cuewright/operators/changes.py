"""Changes of JSON documents: rewriting subjects in them, and what differs, path by path.

Documents are rows (source_id, json) whose roots are objects, open to any fields.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _depth(documents: DataFrame) -> int:
    """How deep arrays and objects are nested in each other at most, by the brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace("json", r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, b: F.struct((s["now"] + F.when(b.isin("[", "{"), 1).when(b.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(b.isin("[", "{"), 1).otherwise(0)).alias("most"))
    deepest = F.aggregate(F.split(brackets, ""), zero, step)["most"]
    return documents.where(F.try_parse_json("json").isNotNull()).agg(F.max(deepest)).first()[0] or 0


def leaves(documents: DataFrame, depth: int | None = None) -> DataFrame:
    """source_id, path, value: every value of the documents that is no filled array or object, as JSON; paths as a.b[0].c.

    Each level of nesting is one explosion of the level above, so a document's size
    and not its depth makes rows; `depth` saves the pass that looks for the number of
    levels. Texts that are no JSON are left out.
    """
    rows = documents.select("source_id", F.lit("").alias("path"), F.try_parse_json("json").alias("v")).where("v is not null")
    spark, out = documents.sparkSession, []
    for level in range((_depth(documents) if depth is None else depth) + 1):
        nested = F.schema_of_variant("v").rlike(r"^(ARRAY<|OBJECT<)") & ~F.to_json("v").isin("[]", "{}")
        out.append(rows.where(~nested).select("source_id", "path", F.to_json("v").alias("value")))
        inner = rows.where(nested).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("w")))
        dot = F.when(F.col("path") == "", "").otherwise(".")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(dot, "key"))
        rows = inner.select("source_id", F.concat("path", step).alias("path"), F.col("w").alias("v"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def changes(before: DataFrame, after: DataFrame, depth: int | None = None) -> DataFrame:
    """source_id, path, change (added, removed or changed), before, after: where two states of documents differ.

    Numbers are equal by their value, however they are written. An empty array or
    object is a value of its own.
    """
    if depth is None:
        depth = max(_depth(before), _depth(after))
    a, b = (leaves(d, depth).withColumnRenamed("value", name) for d, name in ((before, "before"), (after, "after")))
    number = lambda c: F.when(F.col(c).rlike(r"^-?[0-9]"), F.col(c).try_cast("double"))
    same = (F.col("before") == F.col("after")) | F.coalesce(number("before") == number("after"), F.lit(False))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~same, "changed")
    return a.join(b, ["source_id", "path"], "full").withColumn("change", change).where("change is not null").select("source_id", "path", "change", "before", "after")


def _with_subject(text: str | None, old: str, new: str | None) -> str | None:
    """An annotation's JSON with a subject replaced, or removed, in its elements; as it is if that changes nothing."""
    try:
        doc = json.loads(text)
        elements = doc.get("elements") or []
        lists = [(e, e.get("subjectIds") or []) for e in elements]
        after = [[x for x in ids if x != old] if new is None else list(dict.fromkeys(new if x == old else x for x in ids)) for _, ids in lists]
    except (TypeError, ValueError, AttributeError):
        return text
    if all(ids == then for (_, ids), then in zip(lists, after, strict=True)):
        return text
    for (e, ids), then in zip(lists, after, strict=True):
        if then != ids:
            e["subjectIds"] = then
    return json.dumps(doc, ensure_ascii=False)


def rewrite(documents: DataFrame, old: str, new: str | None, dry_run: bool = False) -> DataFrame:
    """source_id, json, changed, backup: annotations with subject `old` of their elements replaced by `new`, or removed if that is None.

    Only lists that change are touched, and of equal ids in them the first stays. A dry
    run leaves every json as it was and says which would change; backup has the former
    text of those that did. Texts that are no annotation stay.
    """
    @F.pandas_udf("string")
    def rewritten(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _with_subject(t, old, new), na_action="ignore")

    rows = documents.select("source_id", F.col("json").alias("was"), rewritten("json").alias("then"))
    rows = rows.withColumn("changed", F.coalesce(F.col("was") != F.col("then"), F.lit(False)))
    kept = F.lit(dry_run)
    return rows.select("source_id", F.when(kept, F.col("was")).otherwise(F.col("then")).alias("json"), "changed", F.when(F.col("changed") & ~kept, F.col("was")).alias("backup"))
