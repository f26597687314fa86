"""The provided tables as timed text, cues and annotation elements.

Every adapter is a deterministic function of its table and covers all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANVAS = (32, 18)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")


def event_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each user; a cue for each event, a second of its time for each hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = F.min("ts").over(Window.partitionBy("user_id"))
    start = F.floor((F.unix_micros("ts") - F.unix_micros(first)) / 3600000).cast("long")
    rows = e.select(F.col("user_id").alias("source_id"), "event_id", start.alias("start_ms"), F.greatest(F.lit(1.0), F.rint(F.col("value") * 40)).cast("long").alias("dur_ms"), F.concat("event_type", F.element_at(F.array(F.lit("."), F.lit("!"), F.lit(",")), (F.col("event_id") % 3 + 1).cast("int"))).alias("text"))
    rows = rows.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms", "event_id")
    block = F.row_number().over(Window.partitionBy("source_id").orderBy("event_id"))
    return rows.withColumns({"index": F.row_number().over(order), "source_block": block, "estimated": F.lit(False)}).drop("event_id")


def conversation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain text for each conversation: its turns' texts, a line each."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(F.col("conv_id").alias("source_id"), F.array_join("t.text", "\n").alias("text"))


def caption_sources(spark: SparkSession, sf_dir: str, webvtt: bool = False) -> DataFrame:
    """SRT or WebVTT text for each user, a block for each event, some of them spoiled.

    By event_id modulo 23: 1 has no timeline, 2 a bad time, 3 no text, 4 ends when
    it begins; others have tags, wide spaces, or settings behind the times.
    """
    cue = event_cues(spark, sf_dir).withColumn("start_ms", F.col("start_ms") % 300000000).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
    kind = (F.col("source_id") + F.col("source_block")) % 23
    mark = "." if webvtt else ","
    clock = lambda ms: F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    line = F.concat(F.when(kind == 2, F.lit("soon")).otherwise(clock(F.col("start_ms"))), F.lit(" --> "), clock(F.when(kind == 4, F.col("start_ms")).otherwise(F.col("end_ms"))), F.when(kind == 7, F.lit(" align:start")).otherwise(F.lit("")))
    body = F.when(kind == 3, F.lit("<b> </b>")).when(kind == 5, F.concat(F.lit("<i>"), "text", F.lit("</i>"))).when(kind == 6, F.concat(F.lit("　"), "text", F.lit("  again"))).otherwise(F.col("text"))
    block = F.when(kind == 1, F.concat(F.lit("lost "), "text")).otherwise(F.concat_ws("\n", F.col("source_block").cast("string"), line, body))
    rows = cue.select("source_id", "source_block", block.alias("b")).groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("source_block", "b"))).alias("b"))
    head = "WEBVTT kind\n\nNOTE of no use\n\n" if webvtt else "﻿"
    return rows.select("source_id", F.concat(F.lit(head), F.array_join("b.b", "\r\n\r\n")).alias("text"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An element for each line item, its order as the scene, on a canvas of 32 x 18.

    scene_id, position, element_id, sequence, region, start_ms, duration_ms,
    direction, policy, subtitle, narrative_role, protected (array of regions),
    padding, and the scene's canvas, scene_duration_ms, final_hold_ms.
    """
    # the rows are dealt out by the name that later steps group by, so that they are shuffled once, and as they are
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "scene_id")
    p, s, q, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"), F.col("l_linenumber")
    order = Window.partitionBy("scene_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    region = lambda x, y, w, h: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))
    rows = li.withColumn("position", (F.row_number().over(order) - 1).cast("long")).select(
        "scene_id",
        "position",
        F.concat(F.lit("e"), (p % 50).cast("string")).alias("element_id"),
        n.alias("sequence"),
        region(p % 30, s % 16, q % 9 + 1, (p + s) % 6 + 1).alias("region"),
        F.when(p % 37 == 0, -1).otherwise((n - 1) * 400 + p % 300).cast("int").alias("start_ms"),
        F.when(p % 41 == 0, 0).otherwise(q * 20 + 100).cast("int").alias("duration_ms"),
        pick(("left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top", "radial", "auto"), p).alias("direction"),
        pick(("subtract-later", "explicit", "none"), s).alias("policy"),
        F.when(F.col("l_discount") > 0.005, F.col("l_returnflag")).alias("subtitle"),
        F.when(F.col("l_tax") > 0.005, F.col("l_linestatus")).alias("narrative_role"),
        F.when(p % 5 == 0, F.array(region(p % 30 + 1, s % 16, F.lit(2), F.lit(2)), region(p % 30 + 4, s % 14 + 1, q % 4 + 1, F.lit(3)))).otherwise(F.array()).alias("protected"),
        (p % 3).cast("int").alias("padding"),
    )
    return rows.withColumns({"canvas_width": F.lit(CANVAS[0]), "canvas_height": F.lit(CANVAS[1]), "scene_duration_ms": F.lit(3000), "final_hold_ms": F.lit(700)})


def checked_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """elements() with a canvas of no width for every 97th scene, and no duration for every 89th."""
    unless = lambda n, c, v: F.when(F.col("scene_id") % n == 0, F.lit(v).cast("int")).otherwise(F.col(c))
    return elements(spark, sf_dir).withColumns({"canvas_width": unless(97, "canvas_width", 0), "scene_duration_ms": unless(89, "scene_duration_ms", None)})


def annotation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, json: an annotation for each line item, broken in one way or none by l_partkey modulo 11; where that is 10 whole numbers have a point."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    way = F.col("l_partkey") % 11
    number = lambda k, bad, good: F.when(way == k, F.lit(bad)).when((way == 10) & (good.cast("string").rlike("^[0-9]+$")), F.concat(good.cast("string"), F.lit(".0"))).otherwise(good.cast("string"))
    json = F.concat(
        F.lit('{"sceneId":"s","canvas":{"width":'), number(1, "1", F.lit(32)), F.lit(',"height":'), number(2, "18.5", F.lit(18)), F.lit('},"sceneDurationMs":'), number(3, "true", F.lit(3000)),
        F.when(way == 4, F.lit('}')).otherwise(F.concat(F.lit(',"elements":[{"id":"e","label":'), number(5, '""', F.lit('"x"')), F.lit(',"sequence":'), F.col("l_linenumber").cast("string"), F.lit(',"maskPolicy":'), number(6, '"other"', F.lit('"none"')), F.lit(',"region":{"x":'), (F.col("l_suppkey") % 9).cast("string"), F.lit(',"y":0,"width":'), number(7, "0", F.lit(3)), F.lit(',"height":2},"reveal":{"startMs":0'), F.when(way == 8, F.lit("")).otherwise(F.lit(',"durationMs":5')), F.lit("}}]}"))),
    )
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source_id"), F.when(way == 9, F.lit("[]")).otherwise(json).alias("json"))


def subject_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, subject_ids: a user's event types in the order of event_id, repeats included."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    return rows.select(F.col("user_id").alias("scene_id"), F.col("s.event_type").alias("subject_ids"))


def outline_points() -> Column:
    """Of elements(): the points of its outline."""
    x, y, w, h = (F.col(f"region.{k}").cast("double") for k in ("x", "y", "width", "height"))
    point = lambda a, b: F.struct((a * 10).alias("x"), (b * 10).alias("y"))
    around = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x + w / 3, y + h))
    return F.when(F.col("start_ms") % 4 == 0, F.reverse(around)).otherwise(around)


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, char_pos, contour_pos, pts: a four-sided outline for each line item."""
    return elements(spark, sf_dir).select("scene_id", (F.col("position") % 2).alias("char_pos"), F.col("position").alias("contour_pos"), outline_points().alias("pts"))


def subject_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, json: an annotation for each user, an element for each remainder of event_id by 4, with its event types as subjects."""
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 4).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    part = F.struct("k", F.concat(F.lit("e"), F.col("k").cast("string")).alias("id"), F.col("s.event_type").alias("subjectIds"))
    d = e.groupBy("user_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    elements = F.transform("p", lambda v: F.struct(v["id"].alias("id"), v["subjectIds"].alias("subjectIds"), F.lit(1.0).alias("extra")))
    return d.select(F.col("user_id").alias("source_id"), F.to_json(F.struct(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sceneId"), elements.alias("elements"))).alias("json"))


def project_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, json: a project for each customer, broken in one way or none by c_custkey modulo 8."""
    way = F.col("c_custkey") % 8
    part = lambda k, bad, good: F.when(way == k, F.lit(bad)).otherwise(F.lit(good))
    json = F.concat(
        F.lit('{"version":'), part(1, "0", "1"), F.lit(',"project":{"name":'), part(2, '""', '"p"'), F.lit(',"language":"en"},"workflow":{"mode":'), part(3, '"other"', '"auto"'), F.lit('},"paths":{},"canvas":{"width":2,"height":2,"fps":'), part(4, "121", "30.0"),
        F.lit(',"background":'), part(5, '"red"', '"#FFFFFF"'), F.lit('},"subject_profile":{"mode":"single","subjects":{"a":{"kind":"x","replaceable":'), part(6, '"yes"', "true"), F.lit("}}}"), part(7, "", ',"render":{}'), F.lit("}"),
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), json.alias("json"))


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, name: two or three files for each customer in one of 100 folders: an annotation for most, and images."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    stem = F.concat(F.lit("scene-"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit("-"), k.cast("string"))
    names = F.array(F.when(k % 4 != 0, F.concat(stem, F.lit(".annotation.json"))), F.when(k % 3 != 0, F.concat(stem, F.lit(".jpg"))), F.when(k % 5 != 0, F.concat(stem, F.lit(".png"))))
    return c.select((k % 100).alias("folder"), F.explode(F.array_compact(names)).alias("name"))


def hand_columns() -> dict[str, Column]:
    """Of elements(): hand_points, hand_contour or hand_start and hand_end by position modulo 4, none for 3."""
    x, y, w, h = (F.col(f"region.{k}").cast("double") for k in ("x", "y", "width", "height"))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    way = F.col("position") % 4
    return {
        "hand_points": F.when(way == 0, F.array(point(x, y), point(x + w, y), point(x + w, y + h))),
        "hand_contour": F.when(way == 1, F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))),
        "hand_start": F.when(way == 2, point(x + w, y)),
        "hand_end": F.when(way == 2, point(x, y + h)),
    }

