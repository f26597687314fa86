import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.functions import geometry
from cuewright.operators import masks, raster, reveal, schedule, strokes, subjects, validate
from cuewright.sources import project

REGION = "struct<x:int,y:int,width:int,height:int>"
ELEMENT = f"scene_id long, position long, element_id string, sequence long, region {REGION}, start_ms int, duration_ms int, direction string, policy string, subtitle string, narrative_role string, protected array<{REGION}>, padding int, canvas_width int, canvas_height int, scene_duration_ms int, final_hold_ms int"


def element(scene, pos, name, seq, region, start=0, dur=800, policy="subtract-later", protected=(), pad=0, canvas=(320, 180), total=2500, hold=500):
    return (scene, pos, name, seq, region, start, dur, "auto", policy, "said", "role", list(protected), pad, *canvas, total, hold)


def elements(spark, rows):
    return spark.createDataFrame(rows, ELEMENT)


def codes(spark, rows):
    return sorted(r.code for r in validate.issues(elements(spark, rows)).collect())


def test_a_sound_annotation_has_no_issues(spark):
    rows = [element(1, 0, "a", 1, (10, 10, 100, 80)), element(1, 1, "b", 2, (150, 20, 100, 80), 900)]
    assert codes(spark, rows) == []
    report = validate.report(elements(spark, rows), validate.issues(elements(spark, rows))).first()
    assert report.valid and report.elements == 2 and report.last_end_ms == 1700


def test_issues_of_unsound_annotations(spark):
    assert codes(spark, [element(1, 0, "a", 1, (10, 10, 100, 80)), element(1, 1, "b", 4, (300, 20, 100, 80), 900)]) == ["region-out-of-bounds", "sequence-gap"]
    assert codes(spark, [element(1, 0, "a", 1, (0, 0, 9, 9), -1), element(1, 1, "a", 2, (0, 0, 9, 9), 0, 0)]) == ["duplicate-id", "invalid-duration", "invalid-start"]
    assert codes(spark, [element(1, 0, "a", 1, (0, 0, 50, 50)), element(1, 1, "b", 2, (0, 0, 50, 50), 300, 2000)]) == ["empty-mask", "insufficient-final-hold", "over-masked", "timeline-overlap"]
    assert codes(spark, [element(1, 0, "a", 1, (0, 0, 50, 50), protected=[(0, 0, 400, 10)], canvas=(0, 180))]) == ["invalid-canvas"]


def test_schema_issues(spark):
    good = {"sceneId": "s", "canvas": {"width": 10, "height": 10}, "sceneDurationMs": 100, "elements": [{"id": "a", "label": "A", "sequence": 1, "region": {"x": 0, "y": 0, "width": 1, "height": 1}, "reveal": {"startMs": 0, "durationMs": 5}}]}
    bad = json.loads(json.dumps(good))
    bad["canvas"]["width"], bad["elements"][0]["sequence"], bad["elements"][0]["maskPolicy"] = 1.5, True, "other"
    del bad["sceneId"]
    docs = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("none", "[1]"), ("broken", "{")], "source_id string, json string")
    got = sorted((r.source_id, r.path, r.problem) for r in validate.schema_issues(docs).collect())
    assert got == [("bad", "canvas.width", "integer"), ("bad", "elements.0.maskPolicy", "enum"), ("bad", "elements.0.sequence", "integer"), ("bad", "sceneId", "required"), ("broken", "root", "no-object"), ("none", "root", "no-object")]


def changed(document, **changes):
    """The document as JSON with values set by paths; None takes one out."""
    d = json.loads(json.dumps(document))
    for path, value in changes.items():
        *way, last = [int(k) if k.isdigit() else k for k in path.split("__")]
        at = d
        for k in way:
            at = at[k]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return json.dumps(d)


def problems(spark, check, cases):
    docs = spark.createDataFrame([(k, v) for k, v in cases.items()], "source_id string, json string")
    return sorted((r.source_id, r.path, r.problem) for r in check(docs).collect())


def test_every_rule_of_the_annotation_format(spark):
    part = {"id": "a", "label": "A", "sequence": 1, "region": {"x": 0, "y": 0, "width": 1, "height": 1}, "reveal": {"startMs": 0, "durationMs": 5, "protectedRegions": [{"x": 0, "y": 0, "width": 1, "height": 1}]}, "handPath": {"points": [[0, 1], [2.5, 3]]}, "extra": 1}
    good = {"version": 1, "sceneId": "s", "canvas": {"width": 2, "height": 2}, "sceneDurationMs": 100, "elements": [part], "extra": {"a": 1}}
    e = "elements__0__"
    cases = {
        "good": changed(good), "side": changed(good, canvas__width=1), "more": changed(good, canvas__depth=3), "empty": changed(good, elements=[]), "no list": changed(good, elements={"a": 1}),
        "id": changed(good, **{e + "id": ""}), "label": changed(good, **{e + "label": 5}), "scene": changed(good, sceneId=7), "role": changed(good, **{e + "subtitle": 1}), "ids": changed(good, **{e + "subjectIds": ["a", 1]}),
        "pad": changed(good, **{e + "reveal__maskPaddingPx": -1}), "shield": changed(good, **{e + "reveal__protectedRegions__0__width": 0}), "region": changed(good, **{e + "region__z": 0}), "path": changed(good, **{e + "handPath__points": [[0, 1]]}), "point": changed(good, **{e + "handPath__points": [[0, 1], [1]]}),
        "point zero": changed(good, canvas__width=2.0, sceneDurationMs=1e2, **{e + "region__width": 1.0}), "half": changed(good, canvas__width=2.5), "low": changed(good, canvas__width=1.0),
        "true": changed(good, **{e + "sequence": True}), "colour": changed(good, background="#12345"), "start": changed(good, **{e + "reveal__startMs": None}), "version": changed(good, version=0),
    }
    a = "elements.0."
    assert problems(spark, validate.schema_issues, cases) == sorted([
        ("half", "canvas.width", "integer"), ("low", "canvas.width", "integer"), ("side", "canvas.width", "integer"), ("more", "canvas", "additional"), ("empty", "elements", "array"), ("no list", "elements", "array"), ("id", a + "id", "string"), ("label", a + "label", "string"), ("scene", "sceneId", "string"), ("role", a + "subtitle", "string"),
        ("ids", a + "subjectIds", "array"), ("pad", a + "reveal.maskPaddingPx", "integer"), ("shield", a + "reveal.protectedRegions.0:r.width", "integer"), ("region", a + "region", "additional"), ("path", a + "handPath.points", "points"), ("point", a + "handPath.points", "points"),
        ("true", a + "sequence", "integer"), ("colour", "background", "pattern"), ("start", a + "reveal.startMs", "required"), ("version", "version", "integer"),
    ])


def test_every_rule_of_the_project_format(spark):
    good = {"version": 1, "project": {"name": "p", "language": "en"}, "workflow": {"mode": "auto"}, "paths": {}, "canvas": {"width": 2, "height": 2, "fps": 30, "background": "#FFFFFF"}, "subject_profile": {"mode": "single", "default_id": None, "subjects": {"a": {"kind": "person", "replaceable": True}}}, "render": {}, "scenes": [], "assumptions": ["x"]}
    cases = {"good": changed(good), "fps": changed(good, canvas__fps=121), "mode": changed(good, workflow__mode="other"), "kind": changed(good, subject_profile__subjects__a__kind=None), "flag": changed(good, subject_profile__subjects__a__replaceable="yes"), "list": changed(good, assumptions=[1]), "render": changed(good, render=None), "name": changed(good, project__name="")}
    assert problems(spark, validate.project_schema_issues, cases) == sorted([("fps", "canvas.fps", "integer"), ("mode", "workflow.mode", "enum"), ("kind", "subject_profile.subjects.a.kind", "required"), ("flag", "subject_profile.subjects.a.replaceable", "boolean"), ("list", "assumptions", "array"), ("render", "render", "required"), ("name", "project.name", "string")])


def test_masks_match_a_cell_by_cell_loop(spark):
    r = random.Random(1)
    rows = []
    for s in range(40):
        for k in range(r.randint(1, 6)):
            box = lambda: (r.randrange(28), r.randrange(14), r.randint(1, 12), r.randint(1, 8))
            rows.append(element(s, k, f"e{k}", k + 1, box(), 100 * k, policy=r.choice(masks.KEYS), protected=[box() for _ in range(r.randint(0, 2))], pad=r.randint(0, 2), canvas=(32, 18)))
    got = {}
    for c in masks.cells(masks.pieces(masks.drawing_elements(elements(spark, rows)))).collect():
        got.setdefault((c.scene_id, c.rank), set()).add((c.x, c.y))

    def cells(box, pad=0):
        x, y, w, h = box
        return {(a, b) for a in range(max(0, x - pad), min(32, x + w + pad)) for b in range(max(0, y - pad), min(18, y + h + pad))}

    for s in range(40):
        own = [x for x in rows if x[0] == s]
        for k, x in enumerate(own):
            left = cells(x[4], x[12])
            if x[8] == "subtract-later":
                for later in own[k + 1 :]:
                    left -= cells(later[4])
            if x[8] != "none":
                for p in x[11]:
                    left -= cells(p)
            assert got.get((s, k), set()) == left


def test_frames_match_a_frame_by_frame_loop(spark):
    r, t = random.Random(2), schedule.Timing(fps=15)
    rows = [element(s, k, f"e{k}", k + 1, (0, 0, 5, 5), r.randint(0, 6000), r.randint(1, 3000)) for s in range(40) for k in range(r.randint(1, 7))]
    got = {(x.scene_id, x.rank): x for x in schedule.element_frames(elements(spark, rows), t).collect()}
    written = {}
    for x in rows:
        now = written.get(x[0], 1)
        start = max(1, round(x[5] * 15 / 1000))
        total = max(2, round(x[6] * 15 / 1000))
        ink = max(1, round(total * 2 / 3))
        g = got[x[0], x[1]]
        assert g.late == (now > start + 1)
        now = max(now, start) + ink + max(1, total - ink)
        assert (g.end_frame, g.ink_frames) == (now, ink)
        written[x[0]] = now
    ends = {x.scene_id: (x.written, x.total) for x in schedule.scene_frames(elements(spark, rows), t).collect()}
    assert ends == {s: (w, max(round(2500 * 15 / 1000), w + 8)) for s, w in written.items()}
    assert schedule.frame_table(elements(spark, rows), t).count() == sum(x.ink_frames + x.color_frames for x in got.values())


def test_half_a_wipe(spark):
    cells = spark.range(80 * 120).select((F.col("id") % 120).cast("int").alias("x"), F.floor(F.col("id") / 120).cast("int").alias("y")).where("x >= 20 and x < 100 and y >= 10 and y < 70")
    rect = F.struct(F.lit(20).alias("x0"), F.lit(10).alias("y0"), F.lit(100).alias("x1"), F.lit(70).alias("y1"))
    seen = lambda d, p: cells.where(reveal.wiped(F.lit(d), F.lit(p), rect, F.col("x"), F.col("y")))
    assert sorted({r.y for r in seen("top_to_bottom", 0.5).collect()}) == list(range(10, 41))
    for d in validate.DIRECTIONS:
        assert seen(d, 1.0).count() == 60 * 80 and seen(d, 0.0).count() < 60 * 80 / 2


def test_path_reveal_comes_in_order(spark):
    cells = spark.createDataFrame([(1, 0, x, 0) for x in range(30)], "scene_id long, rank int, x int, y int")
    path = spark.createDataFrame([(1, 0, [(x, 0) for x in range(0, 20)])], "scene_id long, rank int, points array<struct<x:int,y:int>>")
    got = {r.x: r.step for r in reveal.path_frames(cells, path, F.lit(5), 1.0).collect()}
    assert got[0] == 0 and got[20] == 4 and got[29] == 5 and [got[x] for x in range(21)] == sorted(got[x] for x in range(21))


def test_paths(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    pts = lambda p: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p))
    path = [(q.x, q.y) for q in value(geometry.resampled(pts([(10, 20), (40, 22), (80, 21)])))]
    assert path[0] == (10, 20) and path[-1] == (80, 21) and all(math.dist(a, b) < 4.5 for a, b in zip(path, path[1:]))
    assert value(geometry.signed_area(pts([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]))) == 6.0
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (-10, -4, 650, 370), strict=True)))
    assert tuple(value(geometry.clamped(box, F.lit(640), F.lit(360), 14))) == (0, 0, 640, 360)
    flat = value(geometry.flattened(F.array(pts([(1, 1), (2, 2)]), pts([(3, 3)]), pts([(4, 4)]))))
    assert len(flat.points) == 4 and flat.pen_lifts == [2, 3]
    assert value(schedule.progress_indices(F.lit(5), F.lit(3))) == [0, 2, 4] and value(schedule.progress_indices(F.lit(5), F.lit(1))) == [4] and value(schedule.progress_indices(F.lit(0), F.lit(3))) == []
    fit = value(geometry.fitted(F.lit(1281), F.lit(721), 640))
    assert (fit.width, fit.height) == (640, 360)
    label = geometry.preview_label(F.lit(1), F.lit("Idea"), F.lit("a"), F.array(F.lit("u"), F.lit("v")), F.lit(500), F.lit(1200), F.lit("auto"))
    assert value(label) == "1. Idea  [u,v]  0.5-1.7s  auto"
    pens = value(geometry.layout(F.array(F.lit(10.0), F.lit(20.0)), 2.0, F.lit(100), F.lit(50), F.lit(8.0), F.lit(2.0)))
    assert [(p.x, p.y) for p in pens] == [(34.0, 28.0), (46.0, 28.0)]


def test_strokes_in_order_and_in_time(spark):
    box = lambda x, y, w, h: [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]
    rows = [(1, 0, 0, box(100, 0, 10, 80)), (1, 0, 1, box(0, 0, 80, 10)), (1, 0, 2, box(2, 2, 5, 5)[::-1]), (1, 0, 3, box(0, 0, 1, 1)), (1, 1, 0, box(0, 200, 900, 20))]
    out = strokes.strokes(spark.createDataFrame(rows, "scene_id long, char_pos int, contour_pos int, pts array<struct<x:double,y:double>>"), width=1000, height=300, size=60).orderBy("sequence").collect()
    assert [(s.char_pos, s.contour_pos) for s in out] == [(0, 1), (0, 0), (1, 0)]
    assert all(220 <= s.duration_ms <= 950 for s in out) and [s.start_ms for s in out] == [0, out[0].duration_ms, out[0].duration_ms + out[1].duration_ms]


def test_subjects_are_replaced_and_removed(spark):
    scenes = spark.createDataFrame([(1, ["creator", "idea", "host"]), (2, None), (3, ["idea"])], "scene_id long, subject_ids array<string>")
    assert [(r.subject_ids, r.changed) for r in subjects.rewritten(scenes, "creator", "host").orderBy("scene_id").collect()] == [(["host", "idea"], True), ([], False), (["idea"], False)]
    assert [r.subject_ids for r in subjects.rewritten(scenes, "creator", None).orderBy("scene_id").collect()] == [["idea", "host"], [], ["idea"]]
    kind = "struct<kind:string,name:string,replaceable:boolean,appearance:map<string,string>,identity_lock:array<string>,negative_constraints:array<string>>"
    profile = spark.createDataFrame([(1, "adaptive", "creator", {"creator": ("person", "C", True, {"hat": "red"}, ["face"], [])})], f"project_id long, mode string, default_id string, subjects map<string,{kind}>")
    p = subjects.upserted(profile, "host", replace_id="creator", name="Host", appearance={"coat": "blue"}).first()
    assert p.default_id == "host" and list(p.subjects) == ["host"] and p.subjects["host"].appearance == {"hat": "red", "coat": "blue"} and p.subjects["host"].identity_lock == ["face"] and p.subjects["host"].name == "Host"
    assert subjects.dropped(profile, "creator").first().default_id is None and subjects.emptied(profile).first().subjects == {}


def test_pixels():
    img = np.full((40, 40, 3), 250, np.uint8)
    img[5:30, 8:11] = 10
    img[27:30, 8:25] = 10
    content, ink = raster.content_and_ink(img)
    assert raster.background(img).tolist() == [250, 250, 250] and content.sum() == ink.sum() == 25 * 3 + 3 * 14
    thin = raster.skeleton(ink)
    assert 0 < thin.sum() < ink.sum() and not (thin & ~ink).any()
    assert raster.tour(np.array([(50, 5, 60, 5), (0, 0, 9, 0), (30, 1, 10, 1)])) == [(1, False), (2, True), (0, False)]


def test_centrelines_and_hand_paths(spark):
    box = [(0.0, 0.0), (80.0, 0.0), (80.0, 10.0), (0.0, 10.0)]
    rows = [(1, 0, 0, box, True), (1, 0, 1, [(y, x) for x, y in box], False), (1, 1, 0, [(1.234, 2.0), (3.0, 4.0)], True), (1, 1, 1, [(2.0, 5.0), (2.0, 6.0), (2.0, 7.0)], True), (1, 1, 2, [(x * 5, y) for x, y in box], True)]
    out = raster.hand_paths(spark.createDataFrame(rows, "scene_id long, char_pos int, contour_pos int, pts array<struct<x:double,y:double>>, horizontal boolean"))
    got = {(r.char_pos, r.contour_pos): r.hand_path for r in out.collect()}
    line = [tuple(p) for p in got[0, 0].points]
    assert len(line) == 81 and line[0] == (0, 5.0) and line[-1] == (80, 5.0) and tuple(got[0, 0].end) == (80, 5.0)
    assert [tuple(p)[::-1] for p in got[0, 1].points] == line
    assert [tuple(p) for p in got[1, 0].points] == [(1.23, 2.0), (3.0, 4.0)] == [tuple(p) for p in got[1, 0].contour]
    assert [tuple(p) for p in got[1, 1].points] == [(2.0, 5.0), (2.0, 6.0)]
    assert [p.x for p in got[1, 2].points] == [*range(0, 401, 5)]


def test_paths_follow_the_skeleton_or_the_grid(spark):
    bar = [(1, 0, x, y) for x in range(4, 30) for y in range(4, 9)]
    dot = [(1, 1, x, y) for x in (40, 41) for y in (4, 5)]
    cells = spark.createDataFrame(bar + dot, "scene_id long, rank int, x int, y int")
    none = spark.createDataFrame([], "scene_id long, x int, y int")
    got = {r.rank: r for r in raster.element_paths(cells, none, 60, 20, edge=10).collect()}
    assert set(got) == {0, 1} and len(got[0].points) >= 3 and all((0, p.x, p.y) in {b[1:] for b in bar} for p in got[0].points)
    assert [tuple(p) for p in got[1].points] == [(45, 5)]  # too small for a skeleton: the middle of its square
    ink = spark.createDataFrame([(1, x, 4) for x in range(4, 30)], "scene_id long, x int, y int")
    drawn = {r.rank: r for r in raster.element_paths(cells, ink, 60, 20, edge=10).collect()}
    assert {p.y for p in drawn[0].points} == {4}
    hand = spark.createDataFrame([(1, 0, [(1, 1), (5, 5)]), (1, 1, [(2, 2)]), (1, 7, [(3, 3), (4, 4)])], "scene_id long, rank int, points array<struct<x:int,y:int>>")
    own = {r.rank: [tuple(p) for p in r.points] for r in raster.element_paths(cells, ink, 60, 20, edge=10, hand=hand).collect()}
    assert own == {0: [(1, 1), (5, 5)], 1: [(45, 5)], 7: [(3, 3), (4, 4)]}
    brush = {r.rank: r for r in raster.brush_paths(spark.createDataFrame([], "scene_id long, rank int, points array<struct<x:int,y:int>>, pen_lifts array<int>"), cells, 60, 20, edge=10).collect()}
    assert [tuple(p) for p in brush[1].points] == [(50, 10)]


def test_outlines_walk_around_and_come_back():
    assert raster.outline({(3, 3)}) == [(3, 3)]
    line = raster.outline({(x, 0) for x in range(6)})
    assert line[0] == (0, 0) and len(line) == 10 and set(line) == {(x, 0) for x in range(6)}
    ring = {(x, y) for x in range(5) for y in range(5)}
    walk = raster.outline(ring)
    assert len(walk) == 16 and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(walk, walk[1:]))


def test_contours_mask_by_their_filling(spark):
    square = [(2.0, 2.0), (10.0, 2.0), (10.0, 10.0), (2.0, 10.0)]
    kind = f"{ELEMENT}, contour array<struct<x:double,y:double>>"
    first = (*element(1, 0, "a", 1, (0, 0, 30, 30), pad=2, canvas=(32, 32)), square)
    later = (*element(1, 1, "b", 2, (0, 0, 32, 32), canvas=(32, 32)), [(8.0, 0.0), (31.0, 0.0), (31.0, 31.0), (8.0, 31.0)])
    alone = (*element(2, 0, "c", 1, (1, 1, 6, 6), canvas=(32, 32)), None)
    for scale in (1.0, 0.5):
        got = {}
        for c in masks.cells(masks.pieces(masks.drawing_elements(spark.createDataFrame([first, later, alone], kind), scale=scale))).collect():
            got.setdefault((c.scene_id, c.rank), set()).add((c.x, c.y))
        at = lambda v: round(v * scale)
        pad = round(2 * scale)
        own = {(x, y) for x in range(at(2) - pad, at(10) + pad + 1) for y in range(at(2) - pad, at(10) + pad + 1)}
        assert got[1, 0] == {c for c in own if c[0] >= 0 and c[1] >= 0 and c[0] < at(8)}
        assert got[2, 0] == {(x, y) for x in range(at(1), at(7)) for y in range(at(1), at(7))}


def test_a_scene_of_500_elements(spark):
    r = random.Random(9)
    rows = [element(1, k, f"e{k}", k + 1, (r.randrange(500), r.randrange(300), r.randint(1, 90), r.randint(1, 60)), 10 * k, 5, canvas=(640, 360), total=9000) for k in range(500)]
    top = np.full((360, 640), -1)
    for k, x in enumerate(rows):
        a, b, w, h = x[4]
        top[b : b + h, a : a + w] = k
    got = {a.rank: (a.area, a.left) for a in masks.areas(masks.drawing_elements(elements(spark, rows))).collect()}
    assert got == {k: (x[4][2] * x[4][3], int((top == k).sum())) for k, x in enumerate(rows)}
    found = validate.issues(elements(spark, rows)).collect()
    assert {i.element_id for i in found if i.code == "empty-mask"} == {f"e{k}" for k, (_, left) in got.items() if not left}


def test_components_and_their_order(spark):
    shape = {(x, 0) for x in range(4)} | {(3, 1), (2, 2), (1, 2)} | {(8, 8), (9, 9)}
    cells = spark.createDataFrame([(s, 0, x, y) for s in range(5) for x, y in sorted(shape)], "scene_id long, rank int, x int, y int")
    c = raster.grid_components(cells)
    assert {(r.scene_id, r.n) for r in c.groupBy("scene_id").agg(F.countDistinct("component").alias("n")).collect()} == {(s, 2) for s in range(5)}
    steps = raster.serpentine(c, 1, 20, 20).where("scene_id = 1 and component = 1").orderBy("step").collect()
    assert [(r.x, r.y) for r in steps] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (1, 2), (2, 2)]
    p = raster.stroke_paths(raster.serpentine(c, 1, 20, 20)).where("scene_id = 2").first()
    assert len(p.points) == 9 and p.pen_lifts == [7]


def test_image_rows(spark):
    img = np.full((12, 16, 3), (200, 210, 220), np.uint8)
    img[4:8, 4:8] = 0
    flat = np.full((12, 16, 3), (200, 210, 220), np.uint8)
    rows = lambda a: spark.createDataFrame([(1, 16, 12, a.tobytes())], "scene_id long, width int, height int, data binary")
    f = raster.image_facts(rows(img)).first()
    assert (f.blue, f.green, f.red, f.content, f.ink) == (200, 210, 220, 16, 16)
    assert raster.image_change(rows(flat), rows(img)).first().passed and not raster.image_change(rows(img), rows(img)).first().passed


def test_projects(spark, tmp_path):
    names = ["scene-02-b.annotation.json", "scene-02-b.jpg", "scene-02-b.png", "scene-01-a.annotation.json", "scene-01-a.webp", "lost.annotation.json"]
    found = project.discovered(spark.createDataFrame([("f", n) for n in names], "folder string, name string")).collect()
    assert [(r.scene_id, r.image) for r in found] == [("scene-01", "scene-01-a.webp"), ("scene-02", "scene-02-b.png")]
    project.save_settings({"fps": 12, "canvas": {"fps": 24}, "render": {"pointer_image": "pen.png", "fps": 99, "other": 1}}, tmp_path / "p.yaml")
    settings = project.load_settings(tmp_path / "p.yaml")
    config = project.RenderConfig().merged(settings, low_res=False, file=tmp_path / "p.yaml")
    assert config.fps == 24 and config.pointer_image == str((tmp_path / "pen.png").resolve())
    assert project.RenderConfig().merged(settings, low_res=True).fps == 15
    assert project.resolved(tmp_path / "p.yaml", "a/b") == (tmp_path / "a/b").resolve() and project.resolved(tmp_path, "") is None
    (tmp_path / "x.json").write_text('[1]')
    with pytest.raises(ValueError):
        project.load_settings(tmp_path / "x.json")
    steps = spark.createDataFrame([(1, 1, "merged.mp4", True), (1, 2, "audio.mp4", False), (2, 1, "", False)], "source_id long, step int, artifact string, ok boolean")
    got = {r.source_id: (r.artifact, r.valid, r.warnings) for r in project.finished(steps).collect()}
    assert got == {1: ("merged.mp4", True, [2]), 2: (None, False, [1])}


def test_acceptance(spark):
    checks = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "a", True)], "source_id long, name string, ok boolean")
    assert {r.source_id: (r.passed, r.failed) for r in validate.acceptance(checks).collect()} == {1: (False, ["b"]), 2: (True, [])}
    s = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", True), (2, "a", True)], "source_id long, subject_id string, replaceable boolean")
    assert {r.source_id: r.ok for r in validate.profile_ready(s).collect()} == {1: True, 2: False}


def test_a_document_is_parsed_once_and_rules_are_compiled(spark):
    docs = spark.createDataFrame([("a", '{"elements":[{"reveal":{"protectedRegions":[{"x":0},null,[]]}},7,null]}'), ("b", '{"elements":[]}'), ("c", None), ("d", '{"a":1,"a":2}')], "source_id string, json string")
    for check in (validate.schema_issues, validate.project_schema_issues):
        plan = check(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parsejson") + plan.count("parseJson") + plan.count("parse_json") == 1, plan
        # a plain inline would have its array worked out in a filter, too
        assert plan.count("inline(") == 1 and "size(" not in plan.split("Generate inline")[-1].split("Project")[0]
    got = [(r.source_id, r.path, r.problem) for r in validate.schema_issues(docs).collect()]
    top = [(p, "required") for p in ("sceneId", "canvas", "sceneDurationMs", "canvas.width", "canvas.height")]
    assert sorted(g[1:] for g in got if g[0] == "b") == sorted([*top, ("elements", "array")])
    assert [g for g in got if g[0] in "cd"] == [(k, "root", "no-object") for k in "cd"]
    of_a = [g[1:] for g in got if g[0] == "a"]
    assert len(of_a) == len(set(of_a)) and set(top) < set(of_a)
    at = "elements.0.reveal.protectedRegions."
    assert {p for p in of_a if p[0].startswith(at)} == {(f"{at}0:r.{k}", "required") for k in ("y", "width", "height")} | {(f"{at}{i}:r{p}", "required") for i in (1, 2) for p in (".x", ".y", ".width", ".height")} | {(f"{at}{i}:r", "object") for i in (1, 2)}
    assert {(f"elements.{i}.id", "required") for i in (0, 1, 2)} < set(of_a)
