import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import text
from cuewright.operators import segment
from cuewright.sources import timed_text

SRT = "﻿1\r\n00:00:00,000 --> 00:00:02,000\r\n<b>One.</b>\r\n\r\n2\r\n00:00:02,000 --> 00:00:04,000\r\nTwo!\r\n\r\n3\r\n00:00:05,200 --> 00:00:07,200\r\n　Three  again \r\n"
BROKEN = "no times here\n\n00:00:01,000 --> soon\nx\n\n --> 00:00:02,000\nx\n\n00:00:01,000 --> 00:00:02,000\n<i> </i>\n\n00:00:03,000 --> 00:00:03,000\nx\n\n00:00:05,5 --> 00:00:06,000\nkept"
VTT = "WEBVTT file\n\nNOTE left\nout\n\n00:00.000 --> 00:01.500 align:start\n<b>Hi</b>\n\n00:01.500 --> 00:03.000\nyou"


def sources(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")


def test_srt_and_vtt_cues(spark):
    rows = timed_text.timed_cues(sources(spark, SRT, VTT)).orderBy("source_id", "index").collect()
    assert [(r.source_id, r["index"], r.start_ms, r.end_ms, r.text) for r in rows] == [(0, 1, 0, 2000, "One."), (0, 2, 2000, 4000, "Two!"), (0, 3, 5200, 7200, "Three again"), (1, 1, 0, 1500, "Hi"), (1, 2, 1500, 3000, "you")]


def test_problems_of_blocks(spark):
    rows = timed_text.warnings(sources(spark, BROKEN, "plain. text")).collect()
    assert sorted((r.source_id, r.source_block or 0, r.problem) for r in rows) == [(0, 1, "no-timeline"), (0, 2, "bad-timestamp"), (0, 3, "bad-timestamp"), (0, 4, "empty-body"), (0, 5, "end-not-after-start"), (1, 0, "estimated-timing")]
    assert [(r.start_ms, r.text) for r in timed_text.timed_cues(sources(spark, BROKEN)).collect()] == [(5500, "kept")]


def test_plain_text_is_cut_into_sentences(spark):
    rows = timed_text.cues(sources(spark, "First one here! 第二句。\n\nThird part without an end", None, "  ")).orderBy("source_id", "index").collect()
    assert [r.text for r in rows] == ["First one here!", "第二句。", "Third part without an end"]
    assert [r.start_ms for r in rows] == [0, 2650, 4000] and all(r.estimated for r in rows)


def test_cues_survive_a_round_trip_through_srt(spark):
    cues = timed_text.timed_cues(sources(spark, SRT))
    again = timed_text.timed_cues(timed_text.to_srt(cues, webvtt=True)).collect()
    key = lambda r: (r["index"], r.start_ms, r.end_ms, r.text)
    assert sorted(map(key, cues.collect())) == sorted(map(key, again))


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT, encoding="utf-8")
    (tmp_path / "b.txt").write_text("Plain text.", encoding="utf-8")
    rows = timed_text.read_texts(spark, str(tmp_path)).select("name", text.is_timed_file(F.col("name")).alias("timed")).collect()
    assert {r.name: r.timed for r in rows} == {"a.srt": True, "b.txt": False}


def by_hand(cues, rules):
    """Scenes of one source, cue by cue: (first, last, reason)."""
    ms, out, bucket = rules.ms(), [], []
    for k, (start, end, mark) in enumerate(cues):
        if bucket and end - cues[bucket[0]][0] > ms["most"]:
            out.append((bucket, "max-before-next-cue"))
            bucket = []
        bucket = [*bucket, k]
        span = end - cues[bucket[0]][0]
        wait = max(0, cues[k + 1][0] - end) if k + 1 < len(cues) else 0
        why = None
        if span >= ms["most"]:
            why = "max-duration"
        elif span < ms["least"]:
            pass
        elif wait >= ms["gap"]:
            why = "subtitle-gap"
        elif mark == "!" and span >= ms["sentence"]:
            why = "sentence-boundary"
        elif span >= ms["target"] and (mark in "!," or span >= ms["late"]):
            why = "target-duration"
        if why:
            out.append((bucket, why))
            bucket = []
    if bucket:
        out.append((bucket, "end-of-input"))
    if len(out) > 1:
        (a, _), (b, _) = out[-2:]
        if cues[b[-1]][1] - cues[b[0]][0] < ms["least"] and cues[b[-1]][1] - cues[a[0]][0] <= ms["tail"]:
            out[-2:] = [(a + b, "merged-short-tail")]
    return [(b[0] + 1, b[-1] + 1, why) for b, why in out]


def test_scenes_match_a_cue_by_cue_cut(spark):
    r, rules = random.Random(1), segment.Rules(6, 3, 8, 1.2)
    streams, rows = {}, []
    for s in range(60):
        at, cues = 0, []
        for _ in range(r.randint(0, 25)):
            at += r.choice((0, 0, 100, 1300, -500))
            end = at + r.choice((r.randint(200, 4000), r.randint(200, 4000), 9000))
            cues.append((max(0, at), max(1, end), r.choice("!,x")))
            at = end
        cues.sort(key=lambda c: c[:2])
        streams[s] = cues
        rows += [(s, k + 1, k + 1, a, b, b - a, f"t{m}", False) for k, (a, b, m) in enumerate(cues)]
    frame = spark.createDataFrame(rows, "source_id long, index int, source_block int, start_ms long, end_ms long, dur_ms long, text string, estimated boolean")
    got = {}
    for x in segment.scenes(frame, rules).orderBy("source_id", "scene_index").collect():
        got.setdefault(x.source_id, []).append((x.first_cue, x.last_cue, x.break_reason))
        assert x.cue_ids == list(range(x.first_cue, x.last_cue + 1)) and x.scene_id == f"scene-{x.scene_index:02d}"
    assert got == {s: by_hand(c, rules) for s, c in streams.items() if c}
    reasons = {w for v in got.values() for *_, w in v}
    assert reasons == {"max-before-next-cue", "max-duration", "subtitle-gap", "sentence-boundary", "target-duration", "end-of-input", "merged-short-tail"}


def test_rules_are_checked():
    with pytest.raises(ValueError):
        segment.Rules(5, 6, 7)
    assert segment.Rules(7, 1, 7).ms()["tail"] == 8049  # binary fractions


def test_json_of_a_source(spark):
    import json

    cues = timed_text.cues(sources(spark, SRT))
    doc = json.loads(segment.as_json(cues, segment.scenes(cues)).first().json)
    assert doc["metadata"]["cue_count"] == 3 and doc["scenes"][0]["cue_ids"] == [1, 2, 3] and doc["metadata"]["total_ms"] == 7200


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(text.timestamp_ms(F.lit("1234:00:00,5"))) == 234 * 3600000 + 500 and value(text.timestamp_ms(F.lit("x"))) is None
    assert value(text.hex_bgr(F.lit("#102030"))) == [48, 32, 16] and value(text.hex_bgr(F.lit("#12"))) is None
    assert value(text.listed(F.lit(" a, ,b "))) == ["a", "b"] and value(text.scene_id(F.lit(123))) == "scene-123"
    assert value(text.id_from_stem(F.lit("scene-01-any-title"))) == "scene-01" and value(text.id_from_stem(F.lit("other"))) == "other"
    pair = value(text.key_value(F.lit("a = {\"b\": 1}")))
    assert pair.key == "a" and pair.raw == '{"b": 1}' and value(text.key_value(F.lit("=x"))) is None


def test_stream_labels_agree_with_the_batch(spark, tmp_path):
    from cuewright.streaming.segment import scene_labels

    rules = segment.Rules(6, 3, 8, 1.2)
    rows = [(s, k + 1, k * 2100, k * 2100 + 2000, "a!" if k % 3 else "b") for s in range(3) for k in range(20)]
    schema = "source_id long, index long, start_ms long, end_ms long, text string"
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[1] > 10) == bool(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = scene_labels(stream, rules).writeStream.format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.source_id, r["index"]): (r.scene_no, r.reason) for r in spark.table("labels").collect()}
    want = {(r.source_id, r["index"]): (r.scene_no, r.reason) for r in segment.labels(spark.createDataFrame(rows, schema), rules).collect()}
    assert got == {k: v for k, v in want.items() if k[1] < 20}


def _work(df, name: str) -> int:
    """How often a function stands in the plan that Spark runs."""
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_filters_on_blocks_repeat_no_parsing(spark):
    """a filter on what is wrong with a block went below it, with all parsing put in for each name."""
    s = sources(spark, BROKEN)
    for rows in (timed_text.timed_cues(s), timed_text.warnings(s), timed_text.cues(s)):
        assert _work(rows, "regexp_extract(") <= 8


def test_odd_blocks(spark):
    odd = "WEBVTT\n\n \nNOTE out\nx\n\nNOTE 00:01.000 --> 00:02.000\nkept\n\n00:02.5 -->\n\n100:00:03.000 --> 100:00:04.25 --> x\na <b\n> c\n\n　\n00:05.000 --> 00:06.000"
    rows = timed_text.blocks(sources(spark, odd)).orderBy("source_block").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.problem) for r in rows] == [(None, 2000, "kept", "bad-timestamp"), (2500, None, "", "bad-timestamp"), (360003000, 360004250, "a c", None), (5000, 6000, "", "empty-body")]


def test_figures_are_those_of_the_scenes_from_one_pass(spark):
    """the cues were cut out of their texts once for their number and once for the scenes."""
    rng = random.Random(5)
    texts = [" ".join("word" * rng.randint(1, 9) + rng.choice(".!,?") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    cues, rules = timed_text.plain_cues(sources(spark, *texts, "", None)), segment.PLAIN
    got = segment.figures(cues, rules)
    want = segment.summary(cues, segment.scenes(cues, rules))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert _work(got, "posexplode") < _work(want, "posexplode")
