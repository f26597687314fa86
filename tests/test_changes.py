"""Differences of documents, rewritten subjects, and the checks of a project's parts."""

import json
import random
import struct
import zlib

from pyspark.sql import functions as F

from cuewright.operators import changes, raster, validate
from cuewright.plans import adapters
from cuewright.sources import project


def flat(v, path=""):
    if isinstance(v, dict) and v:
        return {k: x for key, w in v.items() for k, x in flat(w, f"{path}.{key}" if path else key).items()}
    if isinstance(v, list) and v:
        return {k: x for i, w in enumerate(v) for k, x in flat(w, f"{path}[{i}]").items()}
    return {path: v}


def tree(r, depth=0):
    kind = r.random()
    if depth > 4 or kind < 0.35:
        return r.choice([1, 2.5, -3, "a", "b c", "", '\\" [{ \\\\', True, None, [], {}])
    return {f"k{i}": tree(r, depth + 1) for i in range(r.randint(0, 4))} if kind < 0.7 else [tree(r, depth + 1) for _ in range(r.randint(0, 4))]


def test_changes_match_a_comparison_of_trees(spark):
    r, docs = random.Random(1), {}
    for i in range(40):
        a = {"x": tree(r), "y": tree(r), "`odd` key": 1}
        docs[i] = (a, a if i % 5 == 0 else {**a, "y": tree(r)})
    table = lambda k: spark.createDataFrame([(i, json.dumps(d[k])) for i, d in docs.items()] + [(98, "{"), (99, None)], "source_id long, json string")
    got = {(c.source_id, c.path): (c.change, c.before and json.loads(c.before), c.after and json.loads(c.after)) for c in changes.changes(table(0), table(1)).collect()}
    want = {}
    for i, (a, b) in docs.items():
        a, b = flat(a), flat(b)
        for p in a.keys() | b.keys():
            same = p in a and p in b and json.dumps(a[p]) == json.dumps(b[p])
            if not same:
                want[i, p] = ("added" if p not in a else "removed" if p not in b else "changed", a.get(p), b.get(p))
    assert got == want
    number = lambda t: spark.createDataFrame([(1, t)], "source_id long, json string")
    assert changes.changes(number('{"a":1.0,"b":[1e2]}'), number('{"b":[100],"a":1}')).collect() == []
    assert changes.changes(table(0).limit(0), table(1).limit(0)).collect() == []


def test_subjects_are_rewritten_in_nested_elements(spark):
    note = {"sceneId": "s", "extra": {"subjectIds": ["creator"]}, "elements": [{"id": "a", "subjectIds": ["creator", "idea", "host"], "z": 1}, {"id": "b"}, {"id": "c", "subjectIds": ["idea"]}]}
    docs = spark.createDataFrame([(1, json.dumps(note)), (2, json.dumps({"elements": [{"subjectIds": ["idea"]}]})), (3, "{"), (4, None), (5, "[1]"), (6, '{"elements":[1]}')], "source_id long, json string")
    got = {r.source_id: r for r in changes.rewrite(docs, "creator", "host").collect()}
    assert json.loads(got[1].json)["elements"][0] == {"id": "a", "subjectIds": ["host", "idea"], "z": 1} and json.loads(got[1].json)["extra"] == note["extra"]
    assert got[1].changed and json.loads(got[1].backup) == note and [k for k, r in got.items() if r.changed] == [1] and got[3].json == "{" and got[4].json is None
    found = changes.changes(docs, changes.rewrite(docs, "creator", "host").select("source_id", "json")).collect()
    assert sorted((c.path, c.change, c.before, c.after) for c in found) == [("elements[0].subjectIds[0]", "changed", '"creator"', '"host"'), ("elements[0].subjectIds[2]", "removed", '"host"', None)]
    dry = {r.source_id: r for r in changes.rewrite(docs, "creator", None, dry_run=True).collect()}
    assert dry[1].changed and json.loads(dry[1].json) == note and dry[1].backup is None


def png(width, height, pixel):
    """A small image file of one colour."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(pixel) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_images_are_read_and_checked(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(8, 6, (1, 2, 3)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    images = raster.read_images(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r for r in images.collect()}
    assert (got["good.png"].width, got["good.png"].height, bytes(got["good.png"].data[:3])) == (8, 6, bytes((3, 2, 1))) and got["broken.png"].width is None
    name = lambda n: n and f"{images.where('width is not null').first().path.rpartition('/')[0]}/{n}"
    scenes = spark.createDataFrame([(1, 8, 6, name("good.png")), (2, 8, 7, name("good.png")), (3, 8, 6, name("broken.png")), (4, 8, 6, name("lost.png")), (5, 8, 6, None)], "scene_id long, canvas_width int, canvas_height int, image string")
    found = validate.image_issues(scenes, images.withColumnRenamed("path", "image")).collect()
    assert sorted((r.scene_id, r.code) for r in found) == [(2, "canvas-image-mismatch"), (3, "image-read-failed"), (4, "image-read-failed")]


def test_reports_and_profiles(spark, tmp_path):
    project.save_report({"b": "線", "a": [1]}, tmp_path / "deep" / "r.json")
    assert (tmp_path / "deep" / "r.json").read_text() == '{\n  "b": "線",\n  "a": [\n    1\n  ]\n}\n'
    subjects = spark.createDataFrame([(s, f"k{k}", True) for s in (1, 2, 3) for k in range(3)], "source_id long, subject_id string, replaceable boolean")
    texts = spark.createDataFrame([(1, "any"), (2, validate.FORBIDDEN_SUBJECT), (3, validate.FORBIDDING), (4, None)], "source_id long, profile string")
    assert {r.source_id: r.ok for r in validate.profile_ready(subjects, 3, texts).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_only_the_issues_asked_for_are_worked_out(spark):
    """F16, F18: all issues were worked out and filtered then."""
    e = adapters.checked_elements(spark, "/root/testdata/sf0.001")
    every = validate.issues(e)
    for code in ("over-masked", "empty-mask", "timeline-overlap"):
        own = validate.issues(e, (code,))
        assert own.exceptAll(every.where(F.col("code") == code)).count() == 0 and own.count() == every.where(F.col("code") == code).count()
        assert "insufficient-final-hold" not in own._jdf.queryExecution().optimizedPlan().toString()
        assert own._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
