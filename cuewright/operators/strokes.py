"""Glyph outlines to strokes: which contours are ink, in which order, and when they are drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox, clamped, signed_area, stroke_key
from .schedule import stroke_times

LEAST_AREA = 12.0


def centred(outlines: DataFrame, height: int) -> DataFrame:
    """Outlines (scene_id, char_pos, contour_pos, pts) moved down so that a scene's ink is in the middle."""
    edge = outlines.groupBy("scene_id").agg(((F.lit(height) - (F.min(F.array_min("pts.y")) + F.max(F.array_max("pts.y")))) / 2.0).alias("dy"))
    moved = F.transform("pts", lambda p: F.struct(p["x"].alias("x"), (p["y"] + F.col("dy")).alias("y")))
    return outlines.join(edge, "scene_id").withColumn("pts", moved).drop("dy")


def ink(outlines: DataFrame, least: float = LEAST_AREA) -> DataFrame:
    """Outlines with area and is_ink: those that turn like their character's largest are ink, others are holes.

    Outlines smaller than `least` are left out.
    """
    char = Window.partitionBy("scene_id", "char_pos")
    rows = outlines.withColumn("area", signed_area(F.col("pts"))).where(F.abs("area") >= least)
    rows = rows.withColumn("sign", F.max_by(F.signum("area"), F.struct(F.abs("area"), -F.col("contour_pos"))).over(char))
    return rows.withColumn("is_ink", F.col("area") * F.col("sign") > 0).drop("sign")


def strokes(outlines: DataFrame, *, width: int, height: int, size: float, padding: int = 14, base_ms: int = 260, ms_per_px: float = 0.9) -> DataFrame:
    """Strokes of each scene in drawing order: char_pos, stroke_rank, contour_pos, region, direction, start_ms, duration_ms."""
    rows = ink(outlines).where("is_ink").withColumn("box", bbox(F.col("pts")))
    order = Window.partitionBy("scene_id", "char_pos").orderBy(stroke_key(F.col("box"), size * 0.95), "contour_pos")
    rows = rows.withColumns({"stroke_rank": F.row_number().over(order), "width": F.col("box.x1") - F.col("box.x0"), "height": F.col("box.y1") - F.col("box.y0")})
    rows = stroke_times(rows, base_ms, ms_per_px)
    region = clamped(F.col("box"), F.lit(width), F.lit(height), padding)
    direction = F.when(F.col("width") >= F.col("height"), "left_to_right").otherwise("top_to_bottom")
    return rows.select("scene_id", "char_pos", "stroke_rank", "contour_pos", "sequence", region.alias("region"), direction.alias("direction"), "start_ms", "duration_ms", "pts")


def stroke_counts(outlines: DataFrame, least: float = LEAST_AREA) -> DataFrame:
    """scene_id, char_pos, n: how many strokes strokes() has for a character, null for one that has none.

    A character's outlines meet in one aggregation, so that they are read and sorted
    by character once, and only as their areas.
    """
    area = outlines.select("scene_id", "char_pos", "contour_pos", signed_area(F.col("pts")).alias("area")).withColumn("area", F.when(F.abs("area") >= least, F.col("area")))
    sign = F.max_by(F.signum("area"), F.when(F.col("area").isNotNull(), F.struct(F.abs("area"), -F.col("contour_pos"))))
    n = area.groupBy("scene_id", "char_pos").agg(sign.alias("sign"), F.count_if(F.col("area") > 0).alias("up"), F.count_if(F.col("area") < 0).alias("down"))
    return n.select("scene_id", "char_pos", F.when(F.col("sign") > 0, F.col("up")).when(F.col("sign") < 0, F.col("down")).alias("n"))


def last_counts(counts: DataFrame) -> DataFrame:
    """scene_id, ch, strokes: counts (scene_id, char_pos, ch, n) by character; of a repeated one the last counts."""
    return counts.groupBy("scene_id", "ch").agg(F.coalesce(F.max_by("n", "char_pos"), F.lit(0)).alias("strokes"))


def strokes_per_char(stroke_rows: DataFrame, chars: DataFrame) -> DataFrame:
    """scene_id, ch, strokes: counts by character (scene_id, char_pos, ch); of a repeated one the last counts."""
    return last_counts(chars.join(stroke_rows.groupBy("scene_id", "char_pos").agg(F.count("*").alias("n")), ["scene_id", "char_pos"], "left"))
