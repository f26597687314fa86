"""How elements appear: easing, wipes, pointers, and the frame in which a cell is first seen."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import TILE, boxed, clipped, owners, painted


def ease(progress: Column) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.pi() * p)


def _direction(direction: Column, w: Column, h: Column) -> Column:
    d = F.coalesce(direction, F.lit("auto"))
    return F.when(d == "auto", F.when(w >= h, "left_to_right").otherwise("top_to_bottom")).otherwise(d)


def _size(rect: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(1), rect["x1"] - rect["x0"]), F.greatest(F.lit(1), rect["y1"] - rect["y0"])


def wiped(direction: Column, progress: Column, rect: Column, x: Column, y: Column) -> Column:
    """Whether a wipe over rect (x0, y0, x1, y1) has reached cell (x, y); other directions go left to right.

    Going right or down includes the boundary's cells from the start on.
    """
    w, h = _size(rect)
    p = F.round(ease(progress), 12)
    d = _direction(direction, w, h)
    along, down = F.rint(w * p).cast("int"), F.rint(h * p).cast("int")
    cx, cy = rect["x0"] + w / 2.0, rect["y0"] + h / 2.0
    radius = F.sqrt(w * w / 4.0 + h * h / 4.0) * p
    near = (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius + 1e-9
    return F.when(d == "right_to_left", x >= rect["x1"] - along).when(d == "top_to_bottom", y <= rect["y0"] + down).when(d == "bottom_to_top", y >= rect["y1"] - down).when(d == "radial", near).otherwise(x <= rect["x0"] + along)


def previewed(direction: Column, progress: Column, region: Column, x: Column, y: Column) -> Column:
    """Whether the preview page shows the middle of cell (x, y) at a progress that is not eased.

    A wipe fills the region's share alone; the radial one is a disc that ends at 0.55
    of the region's diagonal, whatever the region.
    """
    x0, y0, w, h = (region[k] for k in ("x", "y", "width", "height"))
    mx, my = x + F.lit(0.5), y + F.lit(0.5)
    d = _direction(direction, w, h)
    inside = (mx >= x0) & (mx < x0 + w) & (my >= y0) & (my < y0 + h)
    dx, dy, reach = mx - x0 - w / 2.0, my - y0 - h / 2.0, F.lit(0.55) * progress
    near = dx * dx + dy * dy <= (w * w + h * h) * reach * reach
    gone = F.when(d == "right_to_left", mx >= x0 + w * (1 - progress)).when(d == "top_to_bottom", my < y0 + h * progress).when(d == "bottom_to_top", my >= y0 + h * (1 - progress)).otherwise(mx < x0 + w * progress)
    return F.when(d == "radial", near).otherwise(inside & gone)


def aimed(direction: Column, rect: Column, width: Column, height: Column) -> Column:
    """What pointed() needs of a wipe over rect on a canvas of width x height: for each axis how the pointer moves, and between which cells.

    way: 0 with the wipe, 1 against it, 2 sways, 3 around the middle.
    """
    w, h = _size(rect)
    d = _direction(direction, w, h)

    def axis(start: Column, end: Column, size: Column, most: Column, way: Column, high: dict[int, Column]) -> Column:
        held = lambda v: F.greatest(F.lit(0), F.least(most - 1, v))
        return F.struct(
            way.alias("way"),
            F.when(way == 1, end).otherwise(start).alias("origin"),
            F.when(way == 1, -size).otherwise(size).alias("size"),
            F.when(way == 1, held(start)).otherwise(0).alias("low"),
            F.when(way == 0, F.least(most - 1, end - 1)).when(way == 1, held(high[1])).otherwise(most - 1).alias("high"),
        )

    ways_x = F.when(d == "right_to_left", 1).when(d.isin("top_to_bottom", "bottom_to_top"), 2).when(d == "radial", 3).otherwise(0)
    ways_y = F.when(d == "top_to_bottom", 0).when(d == "bottom_to_top", 1).when(d == "radial", 3).otherwise(2)
    return F.struct(
        axis(rect["x0"], rect["x1"], w, width, ways_x, {1: F.greatest(rect["x0"], rect["x1"] - 1)}).alias("x"),
        axis(rect["y0"], rect["y1"], h, height, ways_y, {1: height - 1}).alias("y"),
        F.sqrt(w * w / 4.0 + h * h / 4.0).alias("reach"),
    )


def pointed(aim: Column, progress: Column) -> Column:
    """Where the pointer of aimed() is, as x, y. What depends on the wipe alone is in `aim`, so that many frames of a wipe compile to little code."""
    p = ease(progress)
    angle, radius = progress * 5 * F.pi(), aim["reach"] * p
    wave = F.lit(0.5) + F.lit(0.35) * F.sin(progress * 8 * F.pi())

    def at(a: Column, turn: Column) -> Column:
        v = F.when(a["way"] < 2, a["origin"] + F.rint(a["size"] * p).cast("int")).when(a["way"] == 2, a["origin"] + (wave * a["size"]).cast("int")).otherwise((a["origin"] + a["size"] / 2.0 + turn * radius).cast("int"))
        return F.greatest(a["low"], F.least(a["high"], v))

    return F.struct(at(aim["x"], F.cos(angle)).alias("x"), at(aim["y"], F.sin(angle)).alias("y"))


def pointer(direction: Column, progress: Column, rect: Column, width: Column, height: Column) -> Column:
    """Where the pointer is on a canvas of width x height, as x, y."""
    return pointed(aimed(direction, rect, width, height), progress)


def wipe_frames(cells: DataFrame, rects: DataFrame, frames: int) -> DataFrame:
    """scene_id, rank, x, y, step: the first of `frames` wipe steps that shows each owned cell.

    cells: scene_id, rank, x, y; rects: scene_id, rank, direction, rect. What no
    step shows appears when the wipe is over, as step `frames`.
    """
    rows = cells.join(rects, ["scene_id", "rank"])
    step = F.lit(frames)
    for k in reversed(range(frames)):  # the earliest step wins
        progress = F.lit(1.0 if frames == 1 else k / (frames - 1))
        step = F.when(wiped(F.col("direction"), progress, F.col("rect"), F.col("x"), F.col("y")), k).otherwise(step)
    return rows.select("scene_id", "rank", "x", "y", step.alias("step"))


def wiped_frames(elements: DataFrame, frames: int, tile: int = TILE) -> DataFrame:
    """wipe_frames() of the cells that masks.drawing_elements() keep, over their regions, with a column `direction` of their own.

    A wipe passes a cell when it has come as far as the cell lies from where it begins,
    which is one number for each cell and one for each element and step.
    """
    shares = [round(0.5 - 0.5 * math.cos(math.pi * (1.0 if frames == 1 else k / (frames - 1))), 12) for k in range(frames)]

    def emit(p, columns):
        x0, y0, x1, y1 = np.stack([columns["cover"].field(c).fill_null(0).to_numpy(False) for c in ("x0", "y0", "x1", "y1")]).astype(np.int64)
        w, h = np.maximum(1, x1 - x0), np.maximum(1, y1 - y0)
        d = columns["direction"].fill_null("auto").to_numpy(False)
        down = np.isin(d, ("top_to_bottom", "bottom_to_top")) | ((d == "auto") & (w < h))
        left, up, disc = d == "right_to_left", d == "bottom_to_top", d == "radial"
        k, x, y = p.k[p.kept], p.x[p.kept], p.y[p.kept]
        off = np.where(down[k], np.where(up[k], y1[k] - y, y - y0[k]), np.where(left[k], x1[k] - x, x - x0[k])).astype(np.float64)
        dx, dy = x - (x0 + w / 2.0)[k], y - (y0 + h / 2.0)[k]
        off = np.where(disc[k], dx * dx + dy * dy, off)
        step = np.full(len(k), frames, np.int32)
        for n in reversed(range(frames)):  # the earliest step wins
            radius = np.sqrt(w * w / 4.0 + h * h / 4.0) * shares[n]
            come = np.where(disc, radius * radius + 1e-9, np.rint(np.where(down, h, w) * shares[n]))
            step[off <= come[k]] = n
        return k, x.astype(np.int32), y.astype(np.int32), step

    return painted(elements, tile, "x int, y int, step int", emit, ("direction", "cover"))


def _first_step(i: Column, points: Column, frames: Column) -> Column:
    """The first of `frames` steps, of which step k has reached point round(k * (points - 1) / (frames - 1)), to reach point i."""
    reached = lambda k: F.rint(k * (points - 1).cast("double") / (frames - 1)) >= i
    about = F.ceil((i - 0.5) * (frames - 1) / F.greatest(points - 1, F.lit(1))).cast("int")
    exact = F.when((about > 0) & reached(about - 1), about - 1).when(reached(about), about).otherwise(about + 1)
    return F.when((i == 0) | (frames <= 1), F.lit(0)).otherwise(exact)


def _in_squares(strokes: DataFrame, side: int) -> DataFrame:
    """strokes (ax, ay, bx, by, reach and others) once for each square of `side` cells that they may come within reach of, as `col` and `row`.

    A long stroke is followed column by column, so its squares grow with its length.
    """
    x0, x1 = F.least("ax", "bx") - F.col("reach"), F.greatest("ax", "bx") + F.col("reach")
    s = strokes.withColumn("col", F.explode(F.sequence(F.floor(x0 / side).cast("int"), F.floor(x1 / side).cast("int"))))
    # the stretch of the stroke that is within reach of the column, as shares of the way from a to b
    run = F.col("bx") - F.col("ax")
    share = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("ax")) / run))
    left, right = share(F.col("col") * side - F.col("reach")), share((F.col("col") + 1) * side + F.col("reach"))
    y = lambda t: F.when(run == 0, F.col("ay")).otherwise(F.col("ay") + (F.col("by") - F.col("ay")) * t)
    ends = (y(left), y(right), F.when(run == 0, F.col("by")).otherwise(y(left)))
    rows = F.sequence(F.floor((F.least(*ends) - F.col("reach")) / side).cast("int"), F.floor((F.greatest(*ends) + F.col("reach")) / side).cast("int"))
    return s.withColumn("row", F.explode(rows))


def _stroke_frames(cells: DataFrame, strokes: DataFrame, paths: DataFrame, reach: float) -> DataFrame:
    """scene_id, rank, x, y, step: the least step of strokes (scene_id, rank, step, ax, ay, bx, by, reach) within reach of each cell.

    Strokes lie in squares as large as their reach, and a cell meets those of its own
    square alone, so the work grows with the cells and the strokes around each. A cell
    that no stroke reaches appears after the last step, as step `frames` of its path;
    one whose element has no path has a null step.
    """
    side = max(1, math.ceil(reach))
    inside = _in_squares(strokes, side).select("scene_id", "rank", "col", "row", "step", "ax", "ay", "bx", "by", "reach")
    c = cells.join(paths.where(F.size("points") > 0).select("scene_id", "rank", "frames"), ["scene_id", "rank"], "left")
    c = c.withColumns({k: F.floor(F.col(v) / side).cast("int") for k, v in (("col", "x"), ("row", "y"))})
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    off = lambda v, a, d: F.col(v) - F.col(a) - d * t
    near = off("x", "ax", dx) * off("x", "ax", dx) + off("y", "ay", dy) * off("y", "ay", dy) <= F.col("reach") * F.col("reach") + 1e-9
    met = c.join(inside, ["scene_id", "rank", "col", "row"], "left")
    return met.groupBy("scene_id", "rank", "x", "y", "frames").agg(F.min(F.when(near, F.col("step"))).alias("step")).select("scene_id", "rank", "x", "y", F.coalesce("step", "frames").cast("int").alias("step"))


def _walked(paths: DataFrame) -> DataFrame:
    """A row for each point of paths (scene_id, rank, points, frames, others): i, the point `b` and the one before, `a`, and the step that reaches it."""
    rows = paths.withColumn("n", F.size("points")).select("*", F.posexplode("points").alias("i", "b")).withColumn("a", F.coalesce(F.get("points", F.col("i") - 1), F.col("b")))
    return rows.withColumn("step", _first_step(F.col("i"), F.col("n"), F.col("frames")))


def _stroke(a: str, b: str, reach: Column) -> list[Column]:
    return [*(F.col(f"{p}.{v}").cast("double").alias(f"{k}{v}") for k, p in (("a", a), ("b", b)) for v in ("x", "y")), reach.alias("reach")]


def ink_frames(cells: DataFrame, paths: DataFrame, radius: int = 5) -> DataFrame:
    """scene_id, rank, x, y, step: the step of the ink stage that first shows each of an element's ink cells.

    paths: scene_id, rank, points (array of x, y), pen_lifts (positions in points),
    frames. A step draws thick lines up to the point that it has reached, 2 * radius
    + 1 cells wide with round ends, and a disc of `radius` where the path begins and
    where the pen comes down again; a cell shows if its middle is covered. With a
    single frame only a disc at the last point is drawn. See _stroke_frames for cells
    that stay out of reach.
    """
    disc = (F.col("i") == 0) | F.array_contains(F.coalesce("pen_lifts", F.array().cast("array<int>")), F.col("i"))
    w = _walked(paths).withColumn("only", (F.col("frames") <= 1)).where("not only or i = n - 1").withColumn("disc", disc | F.col("only"))
    w = w.withColumn("a", F.when(F.col("disc"), F.col("b")).otherwise(F.col("a")))
    strokes = w.select("scene_id", "rank", "step", *_stroke("a", "b", F.when(F.col("disc"), float(radius)).otherwise(radius + 0.5)))
    return _stroke_frames(cells, strokes, paths, radius + 0.5)


def brush_frames(cells: DataFrame, paths: DataFrame, radius: float = 42) -> DataFrame:
    """scene_id, rank, x, y, step: the step of the color stage in which a brush along a path first shows each of an element's content cells.

    paths: scene_id, rank, points, frames. The brush is a disc at each point that a
    step has passed.
    """
    strokes = _walked(paths).select("scene_id", "rank", "step", *_stroke("b", "b", F.lit(float(radius))))
    return _stroke_frames(cells, strokes, paths, radius)


#: Pairs of a cell and a stroke that are compared at once, about.
PAIRS = 1 << 20


def _strokes_of(columns: dict, radius: float, brush: bool):
    """The strokes of paths (points, pen_lifts, frames): whose each is, its step, ends a and b, and reach, in the order of the points."""
    path, frames = columns["points"], columns["frames"].fill_null(1).to_numpy(False)
    at, spots = path.offsets.to_numpy().astype(np.int64), np.stack([path.values.field(v).to_numpy(False) for v in ("x", "y")], 1).astype(np.float64)
    n = np.diff(at)
    k, i = owners(n)
    b, a, f, n = spots[at[k] + i], spots[at[k] + np.maximum(i - 1, 0)], frames[k], n[k]
    reached = lambda s: np.rint(s * (n - 1).astype(np.float64) / np.maximum(f - 1, 1)) >= i
    about = np.ceil((i - 0.5) * (f - 1) / np.maximum(n - 1, 1)).astype(np.int64)
    step = np.where((i == 0) | (f <= 1), 0, np.where((about > 0) & reached(about - 1), about - 1, np.where(reached(about), about, about + 1)))
    if brush:
        return k, step, b, b, np.full(len(k), float(radius))
    disc = (i == 0) | (f <= 1)
    lifts = columns["pen_lifts"]
    lift = lifts.offsets.to_numpy().astype(np.int64)
    lk, li = owners(np.diff(lift))
    place = lifts.values.to_numpy(False)[lift[lk] + li]
    ok = (place >= 0) & (place < np.diff(at)[lk])
    disc[(at[lk] - at[0] + place)[ok]] = True
    use = (f > 1) | (i == n - 1)
    return k[use], step[use], np.where(disc[:, None], b, a)[use], b[use], np.where(disc, float(radius), radius + 0.5)[use]


def _along(elements: DataFrame, radius: float, brush: bool, tile: int, path: Column | None) -> DataFrame:
    import pyarrow as pa

    def emit(p, columns):
        """Each kept cell's least step: strokes meet the cells of their own bounds, the last step first, so that the least one stays."""
        k, step, a, b, reach = (v[::-1] for v in _strokes_of(columns, radius, brush))
        ends = np.concatenate([np.floor(np.minimum(a, b) - reach[:, None]), np.ceil(np.maximum(a, b) + reach[:, None]) + 1], 1).astype(np.int64)
        box, own = clipped(ends, p.rects[k]), p.rects
        frames, drawn = columns["frames"].fill_null(1).to_numpy(False), np.diff(columns["points"].offsets.to_numpy()) > 0
        got = np.array(frames[p.k], np.int32)
        part = np.cumsum((box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s, x, y = boxed(box[lo:hi])
            s += lo
            dx, dy = (b - a)[s].T
            ux, uy = x - a[s, 0], y - a[s, 1]
            t = np.clip((ux * dx + uy * dy) / np.maximum(dx * dx + dy * dy, 1e-9), 0.0, 1.0)
            near = (ux - dx * t) ** 2 + (uy - dy * t) ** 2 <= reach[s] * reach[s] + 1e-9
            s, x, y = s[near], x[near], y[near]
            e = k[s]
            got[p.start[e] + (y - own[e, 1]) * (own[e, 2] - own[e, 0]) + x - own[e, 0]] = step[s]
        use = p.kept
        which = p.k[use]
        return which, p.x[use].astype(np.int32), p.y[use].astype(np.int32), pa.array(got[use], mask=~drawn[which])

    return painted(elements, tile, "x int, y int, step int", emit, ("points", "pen_lifts", "frames") if path is None else ("frames",), path)


def inked(elements: DataFrame, radius: int = 5, tile: int = TILE, path: Column | None = None) -> DataFrame:
    """ink_frames() of the cells that masks.drawing_elements() keep, each with its path in the columns points, pen_lifts and frames.

    `path`, a struct of points and pen_lifts, takes the place of these two columns. It
    is worked out of other columns of the elements where their cells are painted. There
    cells and strokes meet, so neither they nor the paths are shuffled.
    """
    return _along(elements, radius, False, tile, path)


def brushed(elements: DataFrame, radius: float = 42, tile: int = TILE, path: Column | None = None) -> DataFrame:
    """brush_frames() of the cells that masks.drawing_elements() keep, as inked() has them."""
    return _along(elements, radius, True, tile, path)


def path_frames(cells: DataFrame, paths: DataFrame, frames: Column, radius: float) -> DataFrame:
    """scene_id, rank, x, y, step: brush_frames() of paths without frames of their own, all with `frames`."""
    return brush_frames(cells, paths.withColumn("frames", frames), radius)


def finish_cells(content: DataFrame, shown: DataFrame, written: DataFrame, mode: str, frames: int = 0) -> DataFrame:
    """scene_id, x, y, frame, alpha: how the finish changes the cells that no element has shown.

    content and shown: scene_id, x, y, of cells that differ from the background and of
    those that elements have shown; written: scene_id, written, the frames there are
    when the last element is done. union-only changes nothing; fade-full blends a cell
    with its source over `frames` frames, up to alpha 1; full-source shows it at once.
    """
    left = content.select("scene_id", "x", "y").distinct().join(shown.select("scene_id", "x", "y").distinct(), ["scene_id", "x", "y"], "left_anti").join(written.select("scene_id", "written"), "scene_id")
    return _finished(left, mode, frames)


def _finished(left: DataFrame, mode: str, frames: int) -> DataFrame:
    if mode == "union-only":
        left, steps = left.limit(0), F.array(F.lit(0))
    else:
        steps = F.sequence(F.lit(0), F.lit(max(1, frames) - 1)) if mode == "fade-full" else F.array(F.lit(0))
    rows = left.withColumn("step", F.explode(steps))
    alpha = (F.col("step") + 1) / F.lit(float(max(1, frames))) if mode == "fade-full" else F.lit(1.0)
    return rows.select("scene_id", "x", "y", (F.col("written") + F.col("step")).alias("frame"), alpha.alias("alpha"))


def finish_runs(hidden: DataFrame, written: DataFrame, mode: str, frames: int = 0) -> DataFrame:
    """finish_cells() of the cells of masks.hidden(), whose runs are expanded when they have their scene's frames."""
    left = hidden.join(written.select("scene_id", "written"), "scene_id")
    left = left.select("scene_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y", "written")
    return _finished(left, mode, frames)


def blended(start: Column, source: Column, alpha: Column) -> Column:
    """A byte between two bytes, cut to a whole number."""
    return (start * (1.0 - alpha) + source * alpha).cast("int")


def final_alpha(mode: Column, revealed: Column, step: Column, steps: Column) -> Column:
    """Share of the source image in a cell while a scene ends: union-only, fade-full or full-source."""
    fade = F.when(revealed, 1.0).otherwise((step + 1) / steps)
    return F.when(mode == "full-source", 1.0).when(mode == "fade-full", fade).otherwise(F.when(revealed, 1.0).otherwise(0.0))
