"""Cutting ordered cues into scenes.

The cut is greedy: whether a cue ends a scene depends on where the scene began,
so labels come from one pass over each source's cues in order. It streams over
sorted partitions with a few numbers of state. Roll-ups and the merge of a short
tail are aggregations and windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import element_estimate, ends_clause, ends_sentence, scene_id


@dataclass(frozen=True)
class Rules:
    """Limits in seconds; the defaults are those for timed text."""

    target: float = 22
    least: float = 8
    most: float = 35
    gap: float = 1.2
    punctuation: bool = True

    def __post_init__(self):
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError("0 < least <= target <= most has to hold")

    def ms(self) -> dict[str, int]:
        target, least, most, gap = (int(v * 1000) for v in (self.target, self.least, self.most, self.gap))
        return {"target": target, "least": least, "most": most, "gap": gap, "sentence": int(target * 0.62), "late": int(target * 1.18), "tail": int(most * 1.15)}


PLAIN = Rules(8, 1.2, 20)
TIMED = Rules()


def labels(cues: DataFrame, rules: Rules = TIMED, keep: tuple[str, ...] = ()) -> DataFrame:
    """source_id, index, the columns `keep` of cues, scene_no from 1, and the reason that the cue ended its scene, or null.

    The first cue of a scene that the one before would have overrun has
    `overrun`: its predecessor's scene ended because of max-before-next-cue.
    """
    import pyarrow as pa

    ms, punctuation = rules.ms(), rules.punctuation
    order = Window.partitionBy("source_id").orderBy("index")
    rows = cues.select("source_id", "index", "start_ms", "end_ms", F.lead("start_ms").over(order).alias("next_ms"), ends_sentence(F.col("text")).alias("sentence"), ends_clause(F.col("text")).alias("clause"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("source_id", "index")]
    also = "".join(f"{c} {cues.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches):
        source, begun, scene, begin, closed = None, False, 0, 0, True
        for b in batches:
            out = {"scene_no": [], "overrun": [], "reason": []}
            for key, start, end, ahead, sentence, clause in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)), strict=True):
                if not begun or key != source:
                    source, begun, scene, closed = key, True, 0, True
                over = not closed and end - begin > ms["most"]
                if closed or over:
                    scene, begin = scene + 1, start
                span, wait = end - begin, max(0, ahead - end) if ahead is not None else 0
                reason = None
                if span >= ms["most"]:
                    reason = "max-duration"
                elif span >= ms["least"]:
                    if wait >= ms["gap"]:
                        reason = "subtitle-gap"
                    elif punctuation and sentence and span >= ms["sentence"]:
                        reason = "sentence-boundary"
                    elif span >= ms["target"] and (not punctuation or clause or span >= ms["late"]):
                        reason = "target-duration"
                closed = reason is not None
                for k, v in (("scene_no", scene), ("overrun", over), ("reason", reason)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[7:], pa.array(out["scene_no"], pa.int32()), pa.array(out["overrun"], pa.bool_()), pa.array(out["reason"], pa.string())], ["source_id", "index", *keep, "scene_no", "overrun", "reason"])

    return rows.sortWithinPartitions("source_id", "index").mapInArrow(run, f"source_id {kinds[0]}, index {kinds[1]}, {also}scene_no int, overrun boolean, reason string")


def _rolled(rows: DataFrame) -> DataFrame:
    """One row per scene of cue rows that have a scene_no."""
    return rows.groupBy("source_id", "scene_no").agg(
        F.min_by("start_ms", "index").alias("start_ms"),
        F.max_by("end_ms", "index").alias("end_ms"),
        F.min("index").alias("first_cue"),
        F.max("index").alias("last_cue"),
        F.max_by("reason", "index").alias("reason"),
        F.max("overrun").alias("overrun"),
        F.array_sort(F.collect_list(F.struct("index", "text"))).alias("parts"),
    )


def scenes(cues: DataFrame, rules: Rules = TIMED) -> DataFrame:
    """Scenes of each source: scene_index, scene_id, start_ms, end_ms, scene_duration_ms, first_cue, last_cue,
    cue_ids, break_reason, text, estimated_element_count, over_max.

    A last scene shorter than `least` joins the one before if both last at most
    1.15 times `most`.
    """
    ms = rules.ms()
    rows = _rolled(labels(cues, rules, keep=("start_ms", "end_ms", "text")))
    order = Window.partitionBy("source_id").orderBy("scene_no")
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.lead("overrun").over(order), "max-before-next-cue").otherwise("end-of-input")))
    rows = rows.withColumns({"next_end": F.lead("end_ms").over(order), "next_start": F.lead("start_ms").over(order), "after_next": F.lead("scene_no", 2).over(order), "next_parts": F.lead("parts").over(order), "next_last": F.lead("last_cue").over(order), "before": F.lag("start_ms").over(order), "is_last": F.lead("scene_no").over(order).isNull()})
    takes = F.col("next_end").isNotNull() & F.col("after_next").isNull() & (F.col("next_end") - F.col("next_start") < ms["least"]) & (F.col("next_end") - F.col("start_ms") <= ms["tail"])
    goes = F.col("is_last") & F.col("before").isNotNull() & (F.col("end_ms") - F.col("start_ms") < ms["least"]) & (F.col("end_ms") - F.col("before") <= ms["tail"])
    rows = rows.withColumn("takes", takes).where(~F.coalesce(goes, F.lit(False)))
    pick = lambda a, b: F.when(F.col("takes"), b).otherwise(a)
    parts = pick(F.col("parts"), F.concat("parts", "next_parts"))
    rows = rows.select("source_id", F.col("scene_no").alias("scene_index"), "start_ms", pick(F.col("end_ms"), F.col("next_end")).alias("end_ms"), "first_cue", pick(F.col("last_cue"), F.col("next_last")).alias("last_cue"), pick(F.col("reason"), F.lit("merged-short-tail")).alias("break_reason"), parts.alias("parts"))
    rows = rows.withColumns({"scene_id": scene_id(F.col("scene_index")), "scene_duration_ms": F.col("end_ms") - F.col("start_ms"), "cue_ids": F.col("parts.index"), "text": F.array_join("parts.text", " ")})
    rows = rows.withColumns({"estimated_element_count": element_estimate(F.col("text")), "over_max": F.col("scene_duration_ms") > ms["most"]})
    return rows.drop("parts")


def summary(cues: DataFrame, scene_rows: DataFrame) -> DataFrame:
    """source_id, cue_count, scene_count, total_ms (last cue's end minus the first one's start)."""
    a = cues.groupBy("source_id").agg(F.count("*").alias("cue_count"), (F.max_by("end_ms", "index") - F.min_by("start_ms", "index")).alias("total_ms"))
    return a.join(scene_rows.groupBy("source_id").agg(F.count("*").alias("scene_count")), "source_id")


def figures(cues: DataFrame, rules: Rules = TIMED) -> DataFrame:
    """summary() of cues and their scenes() from one pass over the cues, without their texts."""
    ms = rules.ms()
    s = labels(cues, rules, keep=("start_ms", "end_ms")).groupBy("source_id", "scene_no").agg(F.count("*").alias("cues"), F.min_by("start_ms", "index").alias("start_ms"), F.max_by("end_ms", "index").alias("end_ms"))
    s = s.withColumn("before", F.lag("start_ms").over(Window.partitionBy("source_id").orderBy("scene_no")))
    # the last scene joins the one before as in scenes()
    goes = F.col("before").isNotNull() & (F.col("end_ms") - F.col("start_ms") < ms["least"]) & (F.col("end_ms") - F.col("before") <= ms["tail"])
    merged = F.when(F.coalesce(F.max_by(goes, "scene_no"), F.lit(False)), 1).otherwise(0)
    return s.groupBy("source_id").agg(F.sum("cues").alias("cue_count"), (F.max_by("end_ms", "scene_no") - F.min_by("start_ms", "scene_no")).alias("total_ms"), (F.count("*") - merged).alias("scene_count"))


def as_json(cues: DataFrame, scene_rows: DataFrame, rules: Rules = TIMED) -> DataFrame:
    """source_id, json: one document per source with its figures, cues and scenes."""
    c = cues.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("index", "source_block", "start_ms", "end_ms", "dur_ms", "text", "estimated"))).alias("cues"))
    s = scene_rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("scene_index", "scene_id", "start_ms", "end_ms", "scene_duration_ms", "cue_ids", "break_reason", "text", "estimated_element_count"))).alias("scenes"))
    limits = F.struct(*(F.lit(v).alias(k) for k, v in (("target_sec", rules.target), ("min_sec", rules.least), ("max_sec", rules.most), ("gap_sec", rules.gap), ("prefer_punctuation", rules.punctuation))))
    doc = F.struct(F.lit(1).alias("version"), F.col("source_id").alias("source"), F.struct("cue_count", "scene_count", "total_ms", limits.alias("segmentation")).alias("metadata"), "cues", "scenes")
    return summary(cues, scene_rows).join(c, "source_id").join(s, "source_id").select("source_id", F.to_json(doc).alias("json"))
