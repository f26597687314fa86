"""Scenes of an unbounded stream of cues.

An extension of the batch operator: a cue's label needs the start of the next one,
so the last cue of each source is held back until its successor arrives, or until
the source has been silent for a while: then it is closed, its last cue given out
as the end of its input, and its state dropped. The merge of a short tail needs the
end of the input and is left to the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import ends_clause, ends_sentence
from ..operators.segment import TIMED, Rules

OUT = "source_id long, index long, scene_no int, reason string"
STATE = "scene int, begin long, closed boolean, held string"


def _reason(span: int, wait: int, sentence: bool, clause: bool, ms: dict[str, int], punctuation: bool) -> str | None:
    """Why a scene of this span ends with this cue, if it does."""
    if span >= ms["most"]:
        return "max-duration"
    if span < ms["least"]:
        return None
    if wait >= ms["gap"]:
        return "subtitle-gap"
    if punctuation and sentence and span >= ms["sentence"]:
        return "sentence-boundary"
    return "target-duration" if span >= ms["target"] and (not punctuation or clause or span >= ms["late"]) else None


#: Silence after which a source is closed, in ms of event time.
SILENCE_MS = 600_000


def scene_labels(cues: DataFrame, rules: Rules = TIMED, event_time: str | None = None, silence_ms: int = SILENCE_MS) -> DataFrame:
    """source_id, index, scene_no, reason for a stream of cues that come in order within each source.

    event_time names a column with a watermark. A source is closed when the
    watermark is silence_ms past its last cue; a cue that comes later begins it
    anew. Without event_time no source is ever closed.
    """
    ms, punctuation = rules.ms(), rules.punctuation
    at = [F.col(event_time).alias("event_time")] if event_time else []
    marked = cues.select(*at, F.col("source_id").cast("long").alias("source_id"), F.col("index").cast("long").alias("index"), "start_ms", "end_ms", ends_sentence(F.col("text")).alias("sentence"), ends_clause(F.col("text")).alias("clause"))

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import json

        import pandas as pd

        scene, begin, closed, held = state.get if state.exists else (0, 0, True, "null")
        held = json.loads(held)
        out = []
        if state.hasTimedOut:
            state.remove()
            if held:
                index, start, end, sentence, clause = held
                if closed or end - begin > ms["most"]:
                    scene, begin = scene + 1, start
                yield pd.DataFrame([(key[0], index, scene, _reason(end - begin, 0, sentence, clause, ms, punctuation))], columns=["source_id", "index", "scene_no", "reason"])
            return
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.index)
        for r in rows:
            now = (int(r.index), int(r.start_ms), int(r.end_ms), bool(r.sentence), bool(r.clause))
            if held:
                index, start, end, sentence, clause = held
                if closed or end - begin > ms["most"]:
                    scene, begin = scene + 1, start
                reason = _reason(end - begin, max(0, now[1] - end), sentence, clause, ms, punctuation)
                closed = reason is not None
                out.append((key[0], index, scene, reason))
            held = now
        state.update((scene, begin, closed, json.dumps(held)))
        if event_time:
            last = max(int(r.event_time.timestamp() * 1000) for r in rows)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + silence_ms)
        yield pd.DataFrame(out, columns=["source_id", "index", "scene_no", "reason"])

    return marked.groupBy("source_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout)
