"""Checks of scene annotations, as rows of issues.

Annotations are element rows: scene_id, position, element_id, sequence, region,
start_ms, duration_ms, policy, subtitle, narrative_role, protected, canvas_width,
canvas_height, scene_duration_ms, final_hold_ms. Issues are rows (scene_id, level,
code, element_id, detail); a check of a whole scene has a null element_id, and
detail says what an issue's numbers or names are, where it has any.

A scene's elements meet once, as an array in their order; all checks read that row.
A scene without a duration has one of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masks import KEYS, counted, in_bounds, scaled

LAST = 10**9
#: Long edge in cells of the grid on which masks are judged.
GRID_EDGE = 1200
OVER_MASKED = 0.8
# What the annotation and project formats require and allow.
REQUIRED = ("sceneId", "canvas", "sceneDurationMs", "elements")
ELEMENT_REQUIRED = ("id", "label", "sequence", "region", "reveal")
POLICIES = ("subtract-later", "explicit", "none")
DIRECTIONS = ("left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top", "radial", "auto")
#: A subject profile may not name the first without the second, which forbids it.
FORBIDDEN_SUBJECT, FORBIDDING = "猴子", "不可自動替換成猴子"
PROJECT_REQUIRED = ("version", "project", "workflow", "paths", "canvas", "subject_profile", "render")
WORKFLOW_MODES = ("auto", "checkpoint", "plan-only", "validate-only")
SUBJECT_MODES = ("none", "single", "ensemble", "object", "concept", "adaptive")

ISSUE = "array<struct<level:string,code:string,element_id:string,detail:string>>"


def _scenes(elements: DataFrame) -> DataFrame:
    """One row for each scene, with its elements `e` in the order of sequence, named as issues name them."""
    fields = ("element_id", "sequence", "region", "start_ms", "duration_ms", "policy", "subtitle", "narrative_role", "protected")
    own = [*(F.first(c).alias(c) for c in ("canvas_width", "canvas_height")), F.coalesce(F.first("scene_duration_ms"), F.lit(0)).alias("scene_duration_ms")]
    order = F.struct(F.coalesce(F.col("sequence").cast("long"), F.lit(LAST).cast("long")).alias("at"), "position", *fields)
    s = elements.groupBy("scene_id").agg(*own, F.first(F.coalesce("final_hold_ms", F.lit(700))).alias("hold"), F.array_sort(F.collect_list(order)).alias("e"))
    given = lambda c: F.coalesce(c, F.lit(False))

    def named(v: Column, i: Column) -> Column:
        known = F.coalesce(v["element_id"], F.lit("")) != ""
        start = given(v["start_ms"] >= 0)
        return F.struct(
            F.when(known, v["element_id"]).otherwise(F.concat(F.lit("index-"), i.cast("string"))).alias("name"),
            i.cast("long").alias("rank"),
            start.alias("start_ok"),
            (start & given(v["duration_ms"] > 0)).alias("sound"),
            (v["start_ms"] + v["duration_ms"]).cast("long").alias("end_ms"),
            *(v[c].alias(c) for c in fields),
        )

    canvas = given((F.col("canvas_width") > 0) & (F.col("canvas_height") > 0))
    return s.withColumns({"e": F.transform("e", named), "canvas_ok": canvas})


def _judged(s: DataFrame) -> DataFrame:
    """_scenes() with `areas`, the cells of each in-bounds element's region and those left, as the validator counts them.

    The canvas is scaled down to GRID_EDGE cells on its long side. Contours and
    padding don't count; regions and protected regions that are out of bounds don't
    either.
    """
    w, h = (F.when(F.col("canvas_ok"), F.col(f"canvas_{k}")).otherwise(0) for k in ("width", "height"))
    shrink = F.least(F.lit(1.0), F.lit(float(GRID_EDGE)) / F.greatest(w, h, F.lit(1)))
    gw, gh = (F.greatest(F.lit(1), F.rint(v * shrink).cast("int")) for v in (w, h))
    s = s.withColumns({"grid_width": gw, "grid_height": gh, "sx": gw / F.greatest(w, F.lit(1)), "sy": gh / F.greatest(h, F.lit(1))})
    rect = lambda r: scaled(r, F.col("sx"), F.col("sy"), F.col("grid_width"), F.col("grid_height"))
    none = F.struct(*(F.lit(0).alias(k) for k in ("x0", "y0", "x1", "y1")))
    part = lambda v: F.struct(
        v["rank"].alias("rank"),
        F.coalesce(v["policy"], F.lit(KEYS[0])).alias("policy"),
        F.when(in_bounds(v["region"], w, h), rect(v["region"])).otherwise(none).alias("own"),
        F.when(in_bounds(v["region"], w, h), rect(v["region"])).alias("cover"),
        F.transform(F.filter(v["protected"], lambda r: in_bounds(r, w, h)), rect).alias("shields"),
        F.array().cast("array<struct<x:int,y:int>>").alias("outline"),
        F.lit(0).alias("grow"),
    )
    return counted(s.withColumn("parts", F.transform("e", part)).drop("sx", "sy"))


def _element_issues(v: Column, area: Column) -> list[tuple[str, Column]]:
    """Issues of one element by their codes; one whose times are unsound gets no later check."""
    size = F.col("canvas_width"), F.col("canvas_height")
    bad = F.size(F.filter(v["protected"], lambda r: ~in_bounds(r, *size)))
    fits = F.col("canvas_ok") & in_bounds(v["region"], *size)
    taken = 1 - area["left"] / F.greatest(F.lit(1), area["area"])

    def issue(when, level, code, detail=None, n=1):
        one = F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), v["name"].alias("element_id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
        return code, F.when(F.coalesce(when, F.lit(False)), F.array_repeat(one, n)).otherwise(F.array().cast(ISSUE))

    return [
        issue(F.col("canvas_ok") & ~in_bounds(v["region"], *size), "error", "region-out-of-bounds"),
        issue(~v["start_ok"], "error", "invalid-start"),
        issue(v["start_ok"] & ~v["sound"], "error", "invalid-duration"),
        issue(v["sound"] & (v["end_ms"] > F.col("scene_duration_ms")), "error", "element-exceeds-scene", v["end_ms"]),
        issue(v["sound"] & (F.coalesce(v["subtitle"], F.lit("")) == ""), "warning", "missing-subtitle"),
        issue(v["sound"] & (F.coalesce(v["narrative_role"], F.lit("")) == ""), "warning", "missing-narrative-role"),
        issue(v["sound"] & F.col("canvas_ok") & (bad > 0), "error", "protected-region-out-of-bounds", n=bad),
        issue(v["sound"] & fits & (taken >= OVER_MASKED), "warning", "over-masked", F.concat(F.rint(taken * 100).cast("int").cast("string"), F.lit("%"))),
        issue(v["sound"] & fits & (area["left"] == 0), "error", "empty-mask"),
    ]


def _scene_issues() -> list[tuple[str, Column]]:
    """Issues of a whole scene by their codes: canvas, ids, sequences, final hold, neighbours in time."""
    ids = F.filter("e.element_id", lambda i: F.coalesce(i, F.lit("")) != "")
    # of sorted ids, those that stand beside an equal one
    ids = F.array_sort(ids)
    twice = F.array_distinct(F.filter(ids, lambda v, i: v == F.get(ids, i + 1)))
    seq = F.array_sort(F.filter("e.sequence", lambda v: v.isNotNull()))
    last = F.coalesce(F.array_max(F.transform(F.filter("e", lambda v: v["sound"]), lambda v: v["end_ms"])), F.lit(0).cast("long"))

    def row(when, level, code, detail=None):
        one = F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("element_id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
        return code, F.when(F.coalesce(when, F.lit(False)), F.array(one)).otherwise(F.array().cast(ISSUE))

    near = F.transform(_overlaps(), lambda o: F.struct(F.lit("warning").alias("level"), F.lit("timeline-overlap").alias("code"), F.lit(None).cast("string").alias("element_id"), F.concat(o["first_id"], F.lit("/"), o["second_id"], F.lit(" "), o["overlap_ms"].cast("string")).alias("detail")))
    return [
        row(F.size(twice) > 0, "error", "duplicate-id", F.array_join(twice, ", ")),
        row(~F.col("canvas_ok"), "error", "invalid-canvas"),
        row((F.size("e") > 0) & (seq != F.sequence(F.lit(1).cast("long"), F.size("e").cast("long"))), "error", "sequence-gap"),
        row(F.col("scene_duration_ms") - last < F.col("hold"), "error", "insufficient-final-hold", F.col("scene_duration_ms") - last),
        ("timeline-overlap", near),
    ]


def _overlaps() -> Column:
    """(first_id, second_id, overlap_ms): neighbours by (start, end, name) of which the second begins too early."""
    timed = F.array_sort(F.transform(F.filter("e", lambda v: v["sound"]), lambda v: F.struct(v["start_ms"].alias("start_ms"), v["end_ms"].alias("end_ms"), v["name"].alias("name"), v["rank"].alias("rank"))))
    pairs = F.arrays_zip(timed.alias("a"), F.slice(timed, F.lit(2), F.greatest(F.size(timed) - 1, F.lit(0))).alias("b"))
    early = F.filter(pairs, lambda p: F.coalesce(p["b"]["start_ms"] < p["a"]["end_ms"], F.lit(False)))
    return F.transform(early, lambda p: F.struct(p["a"]["name"].alias("first_id"), p["b"]["name"].alias("second_id"), (p["a"]["end_ms"] - p["b"]["start_ms"]).alias("overlap_ms")))


#: Codes for which masks have to be painted.
MASKED = ("over-masked", "empty-mask")


def _checked(elements: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """_scenes() with `issues`, all or those of the given codes; no others are worked out, and masks are painted for MASKED alone."""
    s = _scenes(elements)
    wanted = lambda issues: [c for code, c in issues if codes is None or code in codes]
    masks = codes is None or any(c in MASKED for c in codes)
    s = _judged(s) if masks else s.withColumn("areas", F.transform("e", lambda _: F.lit(None).cast("struct<area:bigint,left:bigint>")))
    parts = wanted(_scene_issues())
    if wanted(_element_issues(F.col("e")[0], F.col("areas")[0])):
        each = F.transform(F.arrays_zip(F.col("e").alias("v"), F.col("areas").alias("a")), lambda x: reduce(F.concat, wanted(_element_issues(x["v"], x["a"]))))
        parts = [F.flatten(each), *parts]
    return s.withColumn("issues", F.concat(F.array().cast(ISSUE), *parts))


def overlaps(elements: DataFrame) -> DataFrame:
    """scene_id, first_id, second_id, overlap_ms: neighbours by (start, end, name) of which the second begins too early."""
    at = F.coalesce(F.col("sequence").cast("long"), F.lit(LAST).cast("long"))
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(at, "position")) - 1
    name = F.when(F.coalesce("element_id", F.lit("")) != "", F.col("element_id")).otherwise(F.concat(F.lit("index-"), F.col("rank").cast("string")))
    e = elements.select("scene_id", "sequence", "position", "element_id", "start_ms", (F.col("start_ms") + F.col("duration_ms")).cast("long").alias("end_ms"), F.coalesce((F.col("start_ms") >= 0) & (F.col("duration_ms") > 0), F.lit(False)).alias("sound"))
    e = e.withColumn("rank", rank).where("sound").withColumn("first_id", name)
    after = lambda c: F.lead(c).over(Window.partitionBy("scene_id").orderBy("start_ms", "end_ms", "first_id", "rank"))
    e = e.withColumns({"second_id": after("first_id"), "overlap_ms": F.col("end_ms") - after("start_ms")})
    return e.where("overlap_ms > 0").select("scene_id", "first_id", "second_id", "overlap_ms")


def issues(elements: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """scene_id, level, code, element_id, detail: every issue of every scene, or those of the given codes."""
    return _checked(elements, codes).select("scene_id", F.inline("issues"))


def report(elements: DataFrame, found: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """scene_id, valid, errors, warnings, elements, scene_duration_ms, last_end_ms; strict counts warnings too.

    Issues that are at hand already can be given, and with them any others.
    """
    last = F.coalesce(F.array_max(F.transform(F.filter("e", lambda v: v["sound"]), lambda v: v["end_ms"])), F.lit(0).cast("long"))
    figures = [F.size("e").cast("long").alias("elements"), "scene_duration_ms", last.alias("last_end_ms")]
    if found is None:
        of = lambda level: F.size(F.filter("issues", lambda i: i["level"] == level)).cast("long").alias(f"{level}s")
        out = _checked(elements).select("scene_id", *figures, of("error"), of("warning"))
    else:
        n = found.groupBy("scene_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
        out = _scenes(elements).select("scene_id", *figures).join(n, "scene_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("valid", (F.col("errors") == 0) & ((F.col("warnings") == 0) | F.lit(not strict)))


def image_issues(scenes: DataFrame, images: DataFrame) -> DataFrame:
    """canvas-image-mismatch and image-read-failed, for scenes (scene_id, canvas_width, canvas_height, image) and
    images (image, width, height; null sizes for files that can't be read)."""
    j = scenes.where("image is not null").join(images, "image", "left")
    code = F.when(F.col("width").isNull(), "image-read-failed").when((F.col("width") != F.col("canvas_width")) | (F.col("height") != F.col("canvas_height")), "canvas-image-mismatch")
    return j.select("scene_id", F.lit("error").alias("level"), code.alias("code"), F.lit(None).cast("string").alias("element_id")).where("code is not null")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _cast(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _is_object(v: Column) -> Column:
    return _cast(v, "map<string,variant>").isNotNull()


def _items(v: Column) -> Column:
    """The items of an array, null for any other value."""
    return _cast(v, "array<variant>")


class _Schema:
    """Problems of a VARIANT, found by explicit rules: (path, problem) structs.

    Types are taken from the JSON itself: a number without a fraction is an integer,
    however it is written, and true is none. What isn't there has no problem but
    `required`.

    A path has one name or two. read() takes an object's named fields out at once, as
    columns that begin with `name`, and the rules look at those. all() belongs into a
    select of its own, with a rule that has a lambda: that keeps it out of the stage's
    one method, which the JVM would not compile at that size. Inside a generator or a
    lambda it would be interpreted.
    """

    def __init__(self, name: str, where: Column | str = ""):
        self.name, self.where, self.found, self.fields = name, F.lit(where) if isinstance(where, str) else where, [], {}

    def read(self, rows: DataFrame, whole: Column | None = None) -> DataFrame:
        """rows with the fields that the rules look at, of v or the given struct; `name` is null if v is no object."""
        struct = lambda names: f"struct<{','.join(f'`{n}`:variant' for n in names)}>"
        rows = rows.withColumn(self.name, _cast(F.col("v"), struct(self.fields)) if whole is None else whole)
        return rows.withColumns({f"{self.name}_{k}": _cast(F.col(self.name)[k], struct(names)) for k, names in self.fields.items() if names})

    def at(self, path: str) -> Column:
        first, *rest = path.split(".")
        names = self.fields.setdefault(first, [])
        if not rest:
            return F.col(self.name)[first]
        if rest[0] not in names:
            names.append(rest[0])
        return F.col(f"{self.name}_{first}")[rest[0]]

    def _add(self, path: str, ok: Column, what: str) -> None:
        one = F.struct(F.concat(self.where, F.lit(path)).alias("path"), F.lit(what).alias("problem"))
        self.found.append(F.when(~F.coalesce(ok, F.lit(False)), one))

    def _rule(self, path: str, test, what: str) -> None:
        v = self.at(path)
        self._add(path, v.isNull() | test(v), what)

    def required(self, *paths: str) -> _Schema:
        for p in paths:
            self._add(p, self.at(p).isNotNull(), "required")
        return self

    def integer(self, path: str, least: int | None = None, most: int | None = None) -> _Schema:
        n = lambda v: _cast(v, "double")
        within = lambda v: (n(v) >= least if least is not None else F.lit(True)) & (n(v) <= most if most is not None else F.lit(True))
        whole = lambda v: (_kind(v) == "BIGINT") | ((_kind(v).startswith("DECIMAL") | _kind(v).startswith("DOUBLE")) & (F.rint(n(v)) == n(v)))
        self._rule(path, lambda v: whole(v) & within(v), "integer")
        return self

    def text(self, *paths: str, least: int = 0) -> _Schema:
        for p in paths:
            self._rule(p, lambda v: (_kind(v) == "STRING") & (F.length(_cast(v, "string")) >= least), "string")
        return self

    def truth(self, *paths: str) -> _Schema:
        for p in paths:
            self._rule(p, lambda v: _kind(v) == "BOOLEAN", "boolean")
        return self

    def objects(self, *paths: str) -> _Schema:
        for p in paths:
            self._rule(p, _is_object, "object")
        return self

    def lists(self, path: str, least: int = 0, texts: bool = False) -> _Schema:
        good = lambda v: F.forall(_items(v), lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False))) if texts else F.lit(True)
        self._rule(path, lambda v: _items(v).isNotNull() & (F.size(_items(v)) >= least) & good(v), "array")
        return self

    def one_of(self, path: str, values: tuple[str, ...]) -> _Schema:
        self._rule(path, lambda v: _cast(v, "string").isin(*values), "enum")
        return self

    def colour(self, path: str) -> _Schema:
        self._rule(path, lambda v: (_kind(v) == "STRING") & _cast(v, "string").rlike("^#[0-9A-Fa-f]{6}$"), "pattern")
        return self

    def closed(self, path: str, keys: tuple[str, ...]) -> _Schema:
        """Nothing but `keys` in an object."""
        names = lambda v: F.map_keys(_cast(v, "map<string,variant>"))
        self._rule(path, lambda v: ~_is_object(v) | F.forall(names(v), lambda k: k.isin(*keys)), "additional")
        return self

    def region(self, path: str) -> _Schema:
        self.objects(path).closed(path, ("x", "y", "width", "height"))
        self.required(*(f"{path}.{k}" for k in ("x", "y", "width", "height")))
        for k, least in (("x", 0), ("y", 0), ("width", 1), ("height", 1)):
            self.integer(f"{path}.{k}", least)
        return self

    def points(self, path: str, least: int) -> _Schema:
        point = lambda x: F.coalesce((F.size(_items(x)) == 2) & F.forall(_items(x), lambda n: F.coalesce(_kind(n).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))), F.lit(False))
        self._rule(path, lambda v: _items(v).isNotNull() & (F.size(_items(v)) >= least) & F.forall(_items(v), point), "points")
        return self

    def all(self) -> Column:
        """A problem or null for each rule."""
        return F.array(*self.found)


def _told(rows: DataFrame) -> DataFrame:
    """source_id, path, problem of the arrays `found`, less their nulls."""
    # a plain inline() has Spark filter by the array's size, for which all rules would be worked out twice
    return rows.select("source_id", F.inline_outer("found")).where("path is not null")


def _no_object() -> Column:
    return F.array(F.struct(F.lit("root").alias("path"), F.lit("no-object").alias("problem")))


def _none() -> Column:
    return F.array().cast("array<struct<path:string,problem:string>>")


def schema_issues(documents: DataFrame) -> DataFrame:
    """source_id, path, problem: where JSON documents (source_id, json) break the annotation format.

    A text that is no JSON object has the problem `no-object` at `root`. A text is
    parsed once: its problems go along with its first element, or alone if it has
    none, and an element's with its first protected region.
    """
    top = _Schema("top").required(*REQUIRED).integer("version", 1).text("sceneId", least=1).text("storyBasis", "coreMessage").colour("background").integer("finalHoldMs", 0)
    top.objects("canvas").closed("canvas", ("width", "height")).required("canvas.width", "canvas.height").integer("canvas.width", 2).integer("canvas.height", 2)
    top.integer("sceneDurationMs", 1).lists("elements", 1)
    where = F.concat(F.lit("elements."), F.col("n").cast("string"), F.lit("."))
    each = _Schema("each", where).required(*ELEMENT_REQUIRED).text("id", "label", least=1).integer("sequence", 1).text("type", "narrativeRole", "subtitle").lists("subjectIds", texts=True).integer("zIndex")
    each.one_of("maskPolicy", POLICIES).region("region").objects("reveal").required("reveal.startMs", "reveal.durationMs").one_of("reveal.direction", DIRECTIONS)
    each.integer("reveal.startMs", 0).integer("reveal.durationMs", 1).integer("reveal.maskPaddingPx", 0).lists("reveal.protectedRegions")
    each.objects("handPath").text("handPath.kind", "handPath.easing").points("handPath.points", 2).points("handPath.contour", 3)
    shield = _Schema("shield", F.concat(where, F.lit("reveal.protectedRegions."), F.col("k").cast("string"), F.lit(":"))).region("r")

    rows = top.read(documents.select("source_id", F.try_parse_json("json").alias("v")))
    rows = rows.select("source_id", F.when(F.col("top").isNull(), _no_object()).otherwise(top.all()).alias("found"), _items(top.at("elements")).alias("items"))
    rows = each.read(rows.select("source_id", "found", F.posexplode_outer("items").alias("n", "v")))
    own = F.when(F.col("n").isNull(), _none()).otherwise(each.all())
    rows = rows.select("source_id", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("found")).otherwise(_none()).alias("found"), own.alias("own"), "n", _items(each.at("reveal.protectedRegions")).alias("items"))
    rows = rows.select("source_id", F.concat("found", "own").alias("found"), "n", F.posexplode_outer("items").alias("k", "r"))
    rows = shield.read(rows, F.struct("r"))
    own = F.when(F.col("k").isNull(), _none()).otherwise(shield.all())
    rows = rows.select("source_id", F.concat(F.when(F.coalesce("k", F.lit(0)) == 0, F.col("found")).otherwise(_none()), own).alias("found"))
    return _told(rows)


def project_schema_issues(documents: DataFrame) -> DataFrame:
    """source_id, path, problem: where JSON documents (source_id, json) break the project format."""
    top = _Schema("top").required(*PROJECT_REQUIRED).integer("version", 1)
    top.objects("project", "workflow", "subject_profile", "canvas", "paths", "render").lists("scenes").lists("assumptions", texts=True)
    top.required("project.name", "project.language", "workflow.mode", "subject_profile.mode", "subject_profile.subjects", "canvas.width", "canvas.height", "canvas.fps", "canvas.background")
    top.text("project.name", least=1).text("project.language", "project.root").one_of("workflow.mode", WORKFLOW_MODES).truth("workflow.overwrite").one_of("subject_profile.mode", SUBJECT_MODES)
    top.integer("canvas.width", 2).integer("canvas.height", 2).integer("canvas.fps", 1, 120).colour("canvas.background").objects("subject_profile.subjects")
    where = F.concat(F.lit("subject_profile.subjects."), F.col("key"), F.lit("."))
    each = _Schema("each", where).required("kind", "replaceable").text("kind", "name").truth("replaceable").objects("appearance").lists("identity_lock", texts=True).lists("negative_constraints", texts=True)

    rows = top.read(documents.select("source_id", F.try_parse_json("json").alias("v")))
    rows = rows.select("source_id", F.when(F.col("top").isNull(), _no_object()).otherwise(top.all()).alias("found"), _cast(top.at("subject_profile.subjects"), "map<string,variant>").alias("items"))
    rows = each.read(rows.select("source_id", "found", F.posexplode_outer("items").alias("n", "key", "v")))
    own = F.when(F.col("n").isNull(), _none()).otherwise(each.all())
    rows = rows.select("source_id", F.concat(F.when(F.coalesce("n", F.lit(0)) == 0, F.col("found")).otherwise(_none()), own).alias("found"))
    return _told(rows)


def missing_paths(references: DataFrame, files: DataFrame) -> DataFrame:
    """references (source_id, key, path) for which files (path) has nothing; null and empty paths are none."""
    return references.where("coalesce(path, '') != ''").join(files.select("path"), "path", "left_anti").select("source_id", "key", "path")


def acceptance(checks: DataFrame) -> DataFrame:
    """source_id, passed, failed (names): checks (source_id, name, ok) rolled up; a null counts as failed."""
    ok = F.coalesce("ok", F.lit(False))
    return checks.groupBy("source_id").agg(F.bool_and(ok).alias("passed"), F.array_sort(F.collect_list(F.when(~ok, F.col("name")))).alias("failed"))


def open_profile(text: Column) -> Column:
    """Whether a profile's text leaves its subjects open: the subject that is never to be put in by itself isn't there, or is forbidden."""
    text = F.coalesce(text, F.lit(""))
    return ~F.contains(text, F.lit(FORBIDDEN_SUBJECT)) | F.contains(text, F.lit(FORBIDDING))


def profile_ready(subjects: DataFrame, least: int = 3, texts: DataFrame | None = None) -> DataFrame:
    """source_id, ok: whether all subjects (source_id, subject_id, replaceable) are replaceable, `least` or more of them.

    texts (source_id, profile): the profiles as JSON text, which have to be open too;
    with them a profile without subjects has a row, and is not ready.
    """
    if texts is not None:
        ready = profile_ready(subjects, least)
        return texts.join(ready, "source_id", "left").select("source_id", (F.coalesce("ok", F.lit(False)) & open_profile(F.col("profile"))).alias("ok"))
    return subjects.groupBy("source_id").agg((F.bool_and(F.coalesce("replaceable", F.lit(False))) & (F.count("*") >= least)).alias("ok"))
