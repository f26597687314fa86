"""Whole scenes of an unbounded stream of cues, equal to those of the batch.

A source's state is the cue that waits for its successor, the scene that is being
gathered, and the scene before it. A scene can only change while it is one of the
last two, since a short tail joins the one before: when a third begins, the first of
them is given out. A source is closed by a timer, when it has been silent for a
while; its tail is merged then, the rest given out, and its state dropped.

Needs the state store of RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import element_estimate, ends_clause, ends_sentence, scene_id
from ..operators.segment import TIMED, Rules
from .segment import SILENCE_MS, _reason

#: Columns of a scene as it is given out, before those that follow from them.
RAW = "source_id {kind}, scene_index int, start_ms bigint, end_ms bigint, first_cue bigint, last_cue bigint, break_reason string, cue_ids array<bigint>, text string"


class _Sources(StatefulProcessor):
    """State of a source: held (the waiting cue), open (its scene is not ended), two (the last two scenes, the later one being gathered), timer, last."""

    def __init__(self, ms: dict[str, int], punctuation: bool, silence: int, columns: list[str]):
        self.ms, self.punctuation, self.silence, self.columns = ms, punctuation, silence, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", "state string")

    def _place(self, s: dict, ahead: int | None) -> dict | None:
        """Put the waiting cue into its scene; gives the scene that can't change any more, if a third one begins."""
        index, start, end, sentence, clause, text = s["held"]
        ms, gone = self.ms, None
        over = s["open"] and end - s["two"][-1]["start"] > ms["most"]
        if over:
            s["two"][-1]["reason"] = "max-before-next-cue"
        if over or not s["open"]:
            s["n"] += 1
            s["two"].append({"n": s["n"], "start": start, "end": end, "cues": [], "texts": [], "reason": None})
            gone = s["two"].pop(0) if len(s["two"]) > 2 else None
        now = s["two"][-1]
        now["end"] = end
        now["cues"].append(index)
        now["texts"].append(text)
        now["reason"] = _reason(end - now["start"], max(0, ahead - end) if ahead is not None else 0, sentence, clause, ms, self.punctuation)
        s["open"] = now["reason"] is None
        return gone

    def _rows(self, key: tuple, found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], x["n"], x["start"], x["end"], x["cues"][0], x["cues"][-1], x["reason"] or "end-of-input", x["cues"], " ".join(x["texts"])) for x in found], columns=self.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"n": 0, "held": None, "open": False, "two": [], "timer": None, "last": 0}
        cues = sorted((r for f in rows for r in f.itertuples(index=False)), key=lambda r: r.index)
        found = []
        for r in cues:
            if s["held"] and (gone := self._place(s, int(r.start_ms))):
                found.append(gone)
            s["held"] = [int(r.index), int(r.start_ms), int(r.end_ms), bool(r.sentence), bool(r.clause), r.text]
            s["last"] = max(s["last"], int(r.at_ms))
        timer = max(s["last"], timerValues.getCurrentWatermarkInMs()) + self.silence
        if timer != s["timer"]:
            if s["timer"] is not None:
                self.handle.deleteTimer(s["timer"])
            self.handle.registerTimer(timer)
            s["timer"] = timer
        self.state.update((json.dumps(s),))
        yield self._rows(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        s = json.loads(self.state.get()[0])
        found = [gone] if (gone := self._place(s, None)) else []
        last = s["two"][-1]
        if len(s["two"]) > 1 and last["end"] - last["start"] < self.ms["least"] and last["end"] - s["two"][0]["start"] <= self.ms["tail"]:
            first = s["two"][0]
            s["two"] = [first | {"end": last["end"], "cues": first["cues"] + last["cues"], "texts": first["texts"] + last["texts"], "reason": "merged-short-tail"}]
        self.state.clear()
        yield self._rows(key, found + s["two"])

    def close(self) -> None:
        pass


def scenes(cues: DataFrame, event_time: str, rules: Rules = TIMED, silence_ms: int = SILENCE_MS) -> DataFrame:
    """The columns of operators.segment.scenes() for a stream of cues that come in order within each source.

    event_time names a column with a watermark, whose type is timestamp. A source is
    closed when the watermark is silence_ms past its last cue; a cue that comes later
    begins it anew. A scene comes out when it can't change any more. Spark leaves out
    cues that are behind the watermark, so that has to leave time enough.
    """
    ms = rules.ms()
    kind = cues.schema["source_id"].dataType.simpleString()
    raw = RAW.format(kind=kind)
    columns = [c.split()[0] for c in raw.split(", ")]
    marked = cues.select(event_time, "source_id", F.col("index").cast("long").alias("index"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), ends_sentence(F.col("text")).alias("sentence"), ends_clause(F.col("text")).alias("clause"), "text", F.unix_millis(event_time).alias("at_ms"))
    out = marked.groupBy("source_id").transformWithStateInPandas(statefulProcessor=_Sources(ms, rules.punctuation, silence_ms, columns), outputStructType=raw, outputMode="Append", timeMode="EventTime")
    duration = F.col("end_ms") - F.col("start_ms")
    return out.withColumns({"scene_id": scene_id(F.col("scene_index")), "scene_duration_ms": duration, "estimated_element_count": element_estimate(F.col("text")), "over_max": duration > ms["most"]})
