"""Scenes of a stream against those of the batch, restarts included."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cuewright.operators import segment
from cuewright.streaming.scenes import scenes

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CUE = "source_id string, index long, start_ms long, end_ms long, text string, at timestamp"
RULES = segment.Rules(6, 3, 8, 1.2)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def test_closed_sources_have_the_scenes_of_the_batch(rocks, tmp_path):
    spark, r, rows = rocks, random.Random(12), []
    zero = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for s in range(25):
        at = 0
        for k in range(r.randint(1, 18)):
            at += r.choice([0, 0, 100, 1300, -200])
            start, end = max(0, at), max(0, at) + r.choice([300, 900, 2100, 5000, 9000])
            rows.append((f"s{s}", k + 1, start, end, r.choice(["one!", "two,", "three", "四。"]), zero + timedelta(milliseconds=end)))
            at = end
    batch = spark.createDataFrame(rows, CUE)
    parts = [[x for x in rows if lo < x[1] <= hi] for lo, hi in ((0, 5), (5, 10), (10, 99))]
    assert sum(map(len, parts)) == len(rows)
    later = zero + timedelta(days=1)
    ticks = [("tick", n + 1, n * 10, n * 10 + 1, ".", later + timedelta(hours=n)) for n in range(2)]
    folder, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    for part in [*parts, ticks[:1], ticks[1:]]:  # each is a run of its own, from the checkpoint of the one before
        spark.createDataFrame(part, CUE).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(CUE).parquet(folder).withWatermark("at", "10 minutes")
        query = scenes(stream, "at", RULES, silence_ms=600_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
    want = segment.scenes(batch, RULES)
    got = spark.read.parquet(out).where("source_id <> 'tick'").select(want.columns)
    key = lambda t: sorted(str(tuple(x)) for x in t.select(*(F.col(c).cast("string") for c in want.columns)).collect())
    assert key(got) == key(want)
    reasons = {x.break_reason for x in want.select("break_reason").distinct().collect()}
    assert {"merged-short-tail", "max-before-next-cue", "subtitle-gap", "max-duration", "end-of-input"} <= reasons
