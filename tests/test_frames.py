"""Frames of whole scenes and reveals along paths against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_scenes import element, elements

from cuewright.functions import geometry
from cuewright.operators import reveal, schedule
from cuewright.plans import adapters, queries

PATH = "scene_id long, rank long, points array<struct<x:int,y:int>>, pen_lifts array<int>, frames int"


def targets(n, frames):
    if n <= 0 or frames <= 0:
        return []
    return [n - 1] if frames == 1 else [round(k * (n - 1) / (frames - 1)) for k in range(frames)]


@pytest.mark.parametrize("finish", ["union-only", "fade-full", "full-source"])
def test_every_frame_once(spark, finish):
    r = random.Random(3)
    t = schedule.Timing(fps=15, finish=finish, fade_ms=300)
    rows = []
    for s in range(25):
        total, hold = r.choice([None, 0, 2500, 9000]), r.choice([None, 0, 400])
        rows += [element(s, k, f"e{k}", k + 1, (0, 0, 5, 5), r.randint(0, 6000), r.randint(1, 900), total=total, hold=hold) for k in range(r.randint(1, 5))]
    paths = {(x[0], x[1]): [(r.randrange(30), r.randrange(30)) for _ in range(r.randint(1, 20))] for x in rows if r.random() < 0.7}
    given = spark.createDataFrame([(s, k, p, [], 1) for (s, k), p in paths.items()], PATH)
    got = {}
    for f in schedule.frames(elements(spark, rows), t, given, brushes=given).collect():
        assert (f.scene_id, f.frame) not in got
        got[f.scene_id, f.frame] = (f.stage, f.rank, f.element_id, f.step, f.done, (f.target_x, f.target_y) if f.target_x is not None else None)
    lengths = {x.scene_id: x.total for x in schedule.scene_frames(elements(spark, rows), t).collect()}
    want = {}
    for s in range(25):
        out = [("blank", None, None, None, 0, None)]
        own = [x for x in rows if x[0] == s]
        for k, x in enumerate(own):
            while len(out) < max(1, round(x[5] * 15 / 1000)):
                out.append(("hold", None, None, None, k, None))
            total = max(2, round(x[6] * 15 / 1000))
            ink = max(1, round(total * 2 / 3))
            for stage, n in (("ink", ink), ("color", max(1, total - ink))):
                p = paths.get((s, k), [])
                at = targets(len(p), n) or [None] * n
                out += [(stage, k, x[2], i, k, p[at[i]] if p else None) for i in range(n)]
        if finish == "fade-full":
            out += [("fade", None, None, i, len(own), None) for i in range(max(1, round(300 * 15 / 1000)))]
        hold = 700 if own[0][-1] is None else own[0][-1]
        end = max(round((own[0][-2] or 0) * 15 / 1000), len(out) + max(1, round(hold * 15 / 1000)))
        out += [("tail", None, None, None, len(own), None)] * (end - len(out))
        assert lengths[s] == len(out)
        want |= {(s, i): f for i, f in enumerate(out)}
    assert got == want


def reach(a, b, c):
    """Distance of c from the stretch between a and b."""
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0 if not n else min(1, max(0, ((c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1])) / n))
    return math.hypot(a[0] + (b[0] - a[0]) * t - c[0], a[1] + (b[1] - a[1]) * t - c[1])


def drawn_by_hand(cells, paths, radius, ink):
    out = {}
    for s, k, x, y in cells:
        if not (p := paths.get((s, k))) or not p[0]:
            out[s, k, x, y] = None
            continue
        points, lifts, frames = p
        step, last = frames, -1
        for i, target in enumerate(targets(len(points), frames)):
            if not ink:
                near = any(math.dist(points[j], (x, y)) <= radius + 1e-9 for j in range(max(0, last + 1), target + 1))
            elif last < 0:
                near = math.dist(points[target], (x, y)) <= radius + 1e-9
            else:
                near = any(math.dist(points[j], (x, y)) <= radius + 1e-9 if j in lifts else reach(points[j - 1], points[j], (x, y)) <= radius + 0.5 + 1e-9 for j in range(last + 1, target + 1))
            if near:
                step = i
                break
            last = target
        out[s, k, x, y] = step
    return out


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_reveals_along_paths(spark, radius):
    r = random.Random(radius)
    paths, cells = {}, []
    for s in range(14):
        n = r.choice([0, 1, 2, 6, 25])
        points = [(r.randint(-9, 40), r.randint(-9, 30)) for _ in range(n)]
        points += points[-1:] * r.randint(0, 2)
        paths[s, s % 2] = (points, sorted(r.sample(range(1, len(points)), min(2, len(points) - 1))) if len(points) > 1 else [], r.choice([1, 2, 3, 9, 60]))
        cells += [(s, s % 2, x, y) for x in range(0, 34, 2) for y in range(0, 25, 2)]
    cells += [(99, 0, 3, 4)]
    rows = spark.createDataFrame(cells, "scene_id long, rank long, x int, y int")
    given = spark.createDataFrame([(s, k, *p) for (s, k), p in paths.items()], PATH)
    for ink, show in ((True, reveal.ink_frames), (False, reveal.brush_frames)):
        got = {(c.scene_id, c.rank, c.x, c.y): c.step for c in show(rows, given, radius).collect()}
        assert got == drawn_by_hand(cells, paths, radius, ink)


def test_long_strokes_take_the_squares_along_them(spark):
    """A diagonal of 20,000 cells lies in about as many squares as it is long, not in its bounds' square."""
    rows = spark.createDataFrame([(0, 0, 20000, 20000)], "i int, ax_ int, bx_ int, by_ int").select("i", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.col("bx_").cast("double").alias("bx"), F.col("by_").cast("double").alias("by"), F.lit(4.0).alias("reach"))
    assert 5000 <= reveal._in_squares(rows, 4).count() <= 7 * 5100


def test_finish(spark):
    cells = lambda *c: spark.createDataFrame([(1, *x) for x in c], "scene_id long, x int, y int")
    written = spark.createDataFrame([(1, 10)], "scene_id long, written long")
    show = lambda mode: sorted(map(tuple, reveal.finish_cells(cells((0, 0), (1, 0), (1, 0)), cells((0, 0), (5, 5)), written, mode, 4).collect()))
    assert show("union-only") == [] and show("full-source") == [(1, 1, 0, 10, 1.0)]
    assert show("fade-full") == [(1, 1, 0, 10 + k, (k + 1) / 4) for k in range(4)]
    assert spark.range(1).select(reveal.blended(F.lit(245), F.lit(10), F.lit(0.5)).alias("v")).first().v == 127


def test_previews_are_linear(spark):
    region = F.struct(*(F.lit(v).alias(k) for k, v in (("x", 10), ("y", 20), ("width", 8), ("height", 4))))
    cells = spark.range(40 * 40).select((F.col("id") % 40).alias("x"), F.floor(F.col("id") / 40).alias("y"))
    shown = lambda d, p: {(c.x, c.y) for c in cells.where(reveal.previewed(F.lit(d), F.lit(p), region, F.col("x"), F.col("y"))).collect()}
    assert shown("auto", 0.5) == {(x, y) for x in range(10, 14) for y in range(20, 24)} and shown("bottom_to_top", 0.25) == {(x, 23) for x in range(10, 18)}
    assert shown("radial", 1.0) == {(x, y) for x in range(40) for y in range(40) if math.hypot(x + 0.5 - 14, y + 0.5 - 22) <= math.hypot(8, 4) * 0.55}
    assert shown("left_to_right", 0.0) == set()


def test_paths_of_points_that_do_not_move(spark):
    pts = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    path = lambda p, c=none, a=F.lit(None), b=F.lit(None): spark.range(1).select(geometry.hand_path(p, c, a, b, F.lit(0.5), F.lit(2.0)).alias("v")).first().v
    flat = lambda v: v and [tuple(p) for p in v]
    assert flat(path(pts((4, 1), (4, 1)))) == [(2, 2), (2, 2)] and path(none) is None and path(pts((1, 1))) is None
    assert flat(path(none, pts((0, 0), (8, 0)))) == [(0, 0), (3, 0), (4, 0)]
    one = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    assert flat(path(pts((9, 9)), none, one, F.struct(F.lit(2.0).alias("x"), F.lit(1.0).alias("y")))) == [(0, 0), (1, 2)]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_whole_frames_shuffle_the_elements_once(spark):
    """elements were shuffled by the table's name and again by the scene's, and joined with their own paths and wipes."""
    for f in (queries.hand_paths, queries.whole_frames, queries.brush_targets):
        assert exchanges(f(spark, "/root/testdata/sf0.001")) == 1


def test_paths_and_wipes_as_columns_are_those_of_tables(spark):
    rows = adapters.elements(spark, "/root/testdata/sf0.001").where("scene_id < 300")
    path, wipe = queries._hand_path()[0], queries._wipe()
    own = schedule.ranked(rows).select("scene_id", "rank", path.alias("points"), "direction", F.struct(*(F.col(f"region.{a}").alias(f"{a}0") for a in "xy"), *((F.col(f"region.{a}") + F.col(f"region.{s}")).alias(f"{a}1") for a, s in (("x", "width"), ("y", "height")))).alias("rect"))
    own = own.withColumn("rect", F.struct(*(F.least(F.col(f"rect.{k}"), F.lit(32 if k[0] == "x" else 18)).alias(k) for k in ("x0", "y0", "x1", "y1")))).withColumns({"width": F.lit(32), "height": F.lit(18)})
    a, b = schedule.frames(rows, paths=path, wipes=wipe), schedule.frames(rows, paths=own, wipes=own)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and a.where("target_x is not null and stage = 'color'").count() > 0


def test_many_paths_are_resampled_at_once(spark):
    """paths went point by point through interpreted functions."""
    r = random.Random(4)
    paths = [None if r.random() < 0.1 else [(r.randrange(12), r.randrange(12)) for _ in range(r.choice([0, 1, 2, 3, 20]))] * r.choice([1, 1, 2]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(paths)), "id long, p array<struct<x:int,y:int>>").select("id", geometry.resampled(F.col("p")).alias("p"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()

    def want(p):
        if p is None or len(p) < 2:
            return p
        out, at = [p[0]], 0.0
        for a, b in zip(p, p[1:]):
            n = math.dist(a, b)
            if n > 1e-6:
                ks = range(math.floor(at / 3 + 1e-9) + 1, math.floor((at + n) / 3 + 1e-9) + 1)
                out += [tuple(round(u + (v - u) * ((k * 3 - at) / n)) for u, v in zip(a, b)) for k in ks]
                at += n
        return out if out[-1] == p[-1] else [*out, p[-1]]

    assert {x.id: x.p and [tuple(q) for q in x.p] for x in df.collect()} == {k: want(p) for k, p in enumerate(paths)}
