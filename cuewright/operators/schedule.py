"""Elements on video frames, and strokes on a timeline.

With t_k the frames that element k emits and s_k its first frame, element k ends at
frame F_k = max(F_(k-1), s_k) + t_k and F_0 = 1. With T the running sum of t, that is
T_k + max(1, max over j up to k of s_j - T_(j-1)): a running sum and a running
maximum, both windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reveal import aimed, pointed


@dataclass(frozen=True)
class Timing:
    fps: int = 30
    ink_weight: int = 2
    color_weight: int = 1
    final_hold_ms: int = 700
    #: union-only, full-source, or fade-full, which puts frames of its own between the last element and the hold
    finish: str = "union-only"
    fade_ms: int = 450

    @property
    def fade_frames(self) -> int:
        return max(1, round(self.fade_ms * self.fps / 1000)) if self.finish == "fade-full" else 0


def frames_at(ms: Column, fps: int) -> Column:
    return F.rint(ms * F.lit(float(fps)) / 1000).cast("long")


def progress_indices(points: Column, frames: Column) -> Column:
    """For each of `frames` frames the point reached, the last one last; empty if there are no points or frames."""
    steps = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.rint(i * (points - 1).cast("double") / (frames - 1)).cast("int"))
    empty = F.array().cast("array<int>")
    return F.when((points <= 0) | (frames <= 0), empty).when(frames == 1, F.array((points - 1).cast("int"))).otherwise(steps)


def _order() -> Window:
    return Window.partitionBy("scene_id").orderBy("sequence", "start_ms", "position")


def ranked(elements: DataFrame) -> DataFrame:
    """Elements with `rank`, their place from 0 in the order in which they are drawn."""
    return elements.withColumn("rank", (F.row_number().over(_order()) - 1).cast("long"))


def _scheduled(elements: DataFrame, timing: Timing) -> DataFrame:
    """Elements with rank, start_frame, ink_frames, color_frames, first_frame, end_frame, and `written`, the frames there are before the element's turn."""
    order = _order()
    until, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.greatest(F.lit(2).cast("long"), frames_at(F.col("duration_ms"), timing.fps))
    share = F.rint(F.col("total") * F.lit(float(timing.ink_weight)) / F.lit(float(max(1, timing.ink_weight + timing.color_weight)))).cast("long")
    e = ranked(elements).withColumns({"start_frame": F.greatest(F.lit(1).cast("long"), frames_at(F.col("start_ms"), timing.fps)), "total": total})
    e = e.withColumn("ink_frames", F.greatest(F.lit(1).cast("long"), share))
    e = e.withColumn("color_frames", F.greatest(F.lit(1).cast("long"), F.col("total") - F.col("ink_frames"))).withColumn("emitted", F.col("ink_frames") + F.col("color_frames"))
    e = e.withColumn("done", F.coalesce(F.sum("emitted").over(before), F.lit(0).cast("long")))
    e = e.withColumn("wait", F.greatest(F.lit(1).cast("long"), F.max(F.col("start_frame") - F.col("done")).over(until)))
    e = e.withColumns({"end_frame": F.col("done") + F.col("emitted") + F.col("wait"), "first_frame": F.col("done") + F.col("wait")})
    return e.withColumn("written", F.coalesce(F.lag("end_frame").over(order), F.lit(1).cast("long")))


def element_frames(elements: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """scene_id, rank, element_id, start_frame, ink_frames, color_frames, first_frame, end_frame, late.

    Elements go by (sequence, start_ms, position). Frame 0 is blank. first_frame is
    the element's first and end_frame the count of frames when it is done; it is
    late if more than one frame is already written when it should start.
    """
    late = (F.col("written") > F.col("start_frame") + 1).alias("late")
    return _scheduled(elements, timing).select("scene_id", "rank", "element_id", "start_frame", "ink_frames", "color_frames", "first_frame", "end_frame", late)


def _all_frames(written: Column, timing: Timing) -> Column:
    """Frames of a scene with `written` ones when its last element is done: with the finish's own, and the hold or the scene's duration. No duration counts as 0."""
    held = written + timing.fade_frames + F.greatest(F.lit(1).cast("long"), frames_at(F.coalesce("final_hold_ms", F.lit(timing.final_hold_ms)), timing.fps))
    return F.greatest(frames_at(F.coalesce("scene_duration_ms", F.lit(0)), timing.fps), held)


def scene_frames(elements: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """scene_id, written (frames when the last element is done), total (with the finish and the tail's hold), duration_ms."""
    s = _scheduled(elements, timing).groupBy("scene_id").agg(F.max("end_frame").alias("written"), F.max("scene_duration_ms").alias("scene_duration_ms"), F.max("final_hold_ms").alias("final_hold_ms"))
    s = s.withColumn("total", _all_frames(F.col("written"), timing))
    return s.select("scene_id", "written", "total", F.rint(F.col("total") * 1000.0 / timing.fps).cast("long").alias("duration_ms"))


def runs(elements: DataFrame, timing: Timing = Timing(), keep: dict[str, Column] | None = None) -> DataFrame:
    """scene_id, stage, first, count, rank, element_id, done: all frames of a scene as runs that follow each other, none empty.

    A `blank` frame comes first, then for each element the frames that `hold` until
    its turn, its `ink` and its `color`, then the `fade` of the finish fade-full and
    the `tail`. Only ink and color have a rank and an element. done is how many
    elements are whole when the run begins, which is what its frames show besides
    what the run itself draws; a hold carries on the state before it. Columns of the
    element to `keep` follow in the runs of its own, others have nulls there.
    """
    keep = keep or {}
    last = F.lead("rank").over(_order()).isNull()
    e = _scheduled(elements, timing).withColumn("last", last)
    begin, ink, end = F.col("first_frame"), F.col("ink_frames"), F.col("end_frame")
    zero, none = F.lit(0).cast("long"), F.lit(None)

    def run(stage: str, first: Column, count: Column, when: Column | None = None, own: bool = False) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"),
            first.alias("first"),
            (count if when is None else F.when(when, count).otherwise(zero)).alias("count"),
            (F.col("rank") if own else none.cast("long")).alias("rank"),
            (F.col("element_id") if own else none.cast("string")).alias("element_id"),
            (F.col("rank") + 1 if stage in ("fade", "tail") else F.col("rank")).alias("done"),
        )

    fade = F.lit(timing.fade_frames).cast("long")
    parts = F.array(
        run("blank", zero, zero + 1, F.col("rank") == 0),
        run("hold", F.col("written"), begin - F.col("written")),
        run("ink", begin, ink, own=True),
        run("color", begin + ink, F.col("color_frames"), own=True),
        run("fade", end, fade, F.col("last")),
        run("tail", end + fade, _all_frames(end, timing) - end - fade, F.col("last")),
    )
    rows = e.withColumns(keep).select("scene_id", F.inline(parts), *(F.col(k).alias(f"kept_{k}") for k in keep)).where("count > 0")
    return rows.select(*(c for c in rows.columns if not c.startswith("kept_")), *(F.when(F.col("rank").isNotNull(), F.col(f"kept_{k}")).alias(k) for k in keep))


def path_index(step: Column, frames: Column, points: Column) -> Column:
    """The point that the path has reached in step `step` of `frames`; in a single frame the last one."""
    return F.when(frames <= 1, points - 1).otherwise(F.rint(step * (points - 1).cast("double") / (frames - 1)).cast("int"))


def frames(elements: DataFrame, timing: Timing = Timing(), paths: DataFrame | Column | None = None, wipes: DataFrame | Column | None = None, brushes: DataFrame | Column | None = None) -> DataFrame:
    """scene_id, frame, stage, rank, element_id, step, progress, done, target_x, target_y: every frame of a scene once.

    As runs() has them. The target is where the pointer is, null where none is shown:
    in ink frames the point of the element's path in `paths` (scene_id, rank, points)
    that the step has reached; in color frames that of `brushes`, of the same columns,
    or else the pointer of the wipe in `wipes` (scene_id, rank, direction, rect,
    width, height), the canvas's sides. Each of them can also be a column of the
    elements, an array of points or reveal.aimed(), which needs no join.
    """
    given = {k: v for k, v in (("ink_path", paths), ("brush_path", brushes), ("wipe", wipes)) if v is not None}
    r = runs(elements, timing, {k: v for k, v in given.items() if isinstance(v, Column)})
    for name, v in given.items():
        if not isinstance(v, Column):
            own = aimed(*(F.col(c) for c in ("direction", "rect", "width", "height"))) if name == "wipe" else F.col("points")
            r = r.join(v.select("scene_id", "rank", own.alias(name)), ["scene_id", "rank"], "left")
    n, k = F.col("count"), F.col("k")
    # a row for each frame first: what is worked out for it is compiled then
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    drawn = F.col("stage").isin("ink", "color", "fade")
    progress = F.when(n == 1, 1.0).otherwise(k / (n - 1))
    target = F.lit(None).cast("struct<x:int,y:int>")
    if "wipe" in given:
        target = F.when((F.col("stage") == "color") & F.col("wipe").isNotNull(), pointed(F.col("wipe"), progress)).otherwise(target)
    for stage, path in (("color", "brush_path"), ("ink", "ink_path")):
        if path in given:
            place = F.get(F.col(path), path_index(k, n, F.size(path)))
            target = F.when((F.col("stage") == stage) & (F.size(path) > 0), place).otherwise(target)
    each = r.select("scene_id", (F.col("first") + k).alias("frame"), "stage", "rank", "element_id", F.when(drawn, k).alias("step"), F.when(drawn, progress).alias("progress"), "done", target.alias("target"))
    return each.select("scene_id", "frame", "stage", "rank", "element_id", "step", "progress", "done", F.col("target.x").cast("int").alias("target_x"), F.col("target.y").cast("int").alias("target_y"))


def merged(scenes: DataFrame) -> DataFrame:
    """scene_id, offset, end_offset: frames of scenes (project_id, scene_id, total) put one after another by id."""
    before = Window.partitionBy("project_id").orderBy("scene_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("total").over(before), F.lit(0).cast("long"))
    return scenes.withColumn("offset", offset).withColumn("end_offset", F.col("offset") + F.col("total")).select("project_id", "scene_id", "offset", "end_offset")


def frame_table(elements: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """A row for each frame in which an element draws: scene_id, frame, element_id, stage, step, progress; frames() has all of them."""
    e = element_frames(elements, timing)
    stage = lambda name, n, first: e.select("scene_id", "rank", "element_id", F.lit(name).alias("stage"), F.col(n).alias("n"), first.alias("first"))
    both = stage("ink", "ink_frames", F.col("first_frame")).unionByName(stage("color", "color_frames", F.col("first_frame") + F.col("ink_frames")))
    rows = both.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    progress = F.when(F.col("n") == 1, 1.0).otherwise(F.col("step") / (F.col("n") - 1))
    return rows.select("scene_id", (F.col("first") + F.col("step")).alias("frame"), "rank", "element_id", "stage", "step", progress.alias("progress"))


def stroke_times(strokes: DataFrame, base_ms: int = 260, ms_per_px: float = 0.9) -> DataFrame:
    """strokes (scene_id, char_pos, stroke_rank, width, height) with sequence, start_ms and duration_ms."""
    order = Window.partitionBy("scene_id").orderBy("char_pos", "stroke_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    duration = F.greatest(F.lit(220), F.least(F.lit(950), (F.lit(float(base_ms)) + (F.col("width") + F.col("height")) * ms_per_px).cast("int")))
    s = strokes.withColumns({"duration_ms": duration, "sequence": F.row_number().over(order)})
    return s.withColumn("start_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0).cast("long")))
