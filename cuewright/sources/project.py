"""Projects: documents, scene discovery, configuration, and reports.

Files are read and written through Spark's text source and the Hadoop file system,
so a path may lie in any store that Spark knows.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import id_from_stem

# Image extensions by preference; what a new project's scenes say before anyone has edited them.
IMAGES = ("png", "jpg", "jpeg", "webp")
CORE_MESSAGE, NARRATIVE = "待代理依字幕提煉", "adaptive"


@dataclass(frozen=True)
class RenderConfig:
    """Settings of the renderer, with the defaults of the project format."""

    fps: int = 30
    cap_long_edge: int = 1080
    grid_edge: int = 10
    ink_path: str = "skeleton"
    color_fill: str = "wipe"
    pointer: str = "pen"
    pointer_image: str | None = None
    pointer_height: int = 260
    pointer_anchor_x: float = 0.05
    pointer_anchor_y: float = 0.92
    background: str = "#F5EBD7"
    content_threshold: int = 30
    ink_threshold: int = 55
    ink_radius: int = 5
    brush_radius: int = 42
    ink_weight: int = 2
    color_weight: int = 1
    mask_policy_override: str | None = None
    finalize_mode: str = "union-only"
    final_fade_ms: int = 450
    keep_raw: bool = False

    def merged(self, settings: dict, low_res: bool = False, file: str | Path | None = None) -> RenderConfig:
        """With a project's own settings; a low resolution is 15 fps and 640 pixels.

        `canvas` has fps and background, `render` the rest, where ink_color_ratio
        stands for both weights and mask_policy for mask_policy_override; fields
        elsewhere are none. What isn't known or is null is left out. A pointer image
        is looked for beside the project's file, if that is given.
        """
        canvas, render = settings.get("canvas") or {}, dict(settings.get("render") or {})
        ratio = [*(render.pop("ink_color_ratio", None) or ()), None, None]
        found = {**{k: v for k, v in render.items() if k not in ("fps", "background")}, **{k: canvas.get(k) for k in ("fps", "background") if k in canvas}}
        found |= {k: v for k, v in (("ink_weight", ratio[0]), ("color_weight", ratio[1]), ("mask_policy_override", render.get("mask_policy"))) if v is not None}
        fields = self.__dataclass_fields__
        typed = {"int": int, "float": float, "bool": bool}
        known = {k: typed.get(fields[k].type, str)(v) for k, v in found.items() if k in fields and v is not None}
        if file is not None and known.get("pointer_image"):
            known["pointer_image"] = str(resolved(file, known["pointer_image"]))
        return replace(self, **known | ({"fps": 15, "cap_long_edge": 640} if low_res else {}))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """path, name, json (text), doc (VARIANT; null unless the root is an object) of JSON files."""
    return _documents(spark, path)


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """path, name, json, doc of YAML files, put into JSON; an empty file is an empty object."""
    return _documents(spark, path, yaml=True)


def _documents(spark: SparkSession, path: str, yaml: bool = False) -> DataFrame:
    import pyarrow as pa

    def as_json(batches):
        import yaml

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([json.dumps(yaml.safe_load(t) or {}, ensure_ascii=False, default=str) for t in b.column(2).to_pylist()], pa.string())], ["path", "name", "json"])

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^\ufeff", "").alias("json"))
    rows = rows.mapInArrow(as_json, rows.schema) if yaml else rows
    doc = F.try_parse_json("json")
    return rows.withColumn("doc", F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc))


def load_settings(path: str | Path) -> dict:
    """One project's settings file, YAML or JSON; an empty one is {}. The root has to be a map."""
    read = read_json if str(path).endswith(".json") else read_yaml
    row = read(SparkSession.active(), str(path)).select("json", F.col("doc").isNotNull().alias("is_map")).first()
    if row is None:
        return {}
    if not row["is_map"]:
        raise ValueError(f"{path}: the root has to be a map")
    return json.loads(row["json"])


def _put(text: str, path: str | Path) -> None:
    """Write a small text file, with its folders."""
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def save_settings(data: dict, path: str | Path) -> None:
    import yaml

    _put(yaml.safe_dump(data, allow_unicode=True, sort_keys=False, width=110), path)


def save_report(data: dict, path: str | Path) -> None:
    _put(json.dumps(data, ensure_ascii=False, indent=2) + "\n", path)


def resolved(project_file: str | Path, value: str | None) -> Path | None:
    """A path of a project, relative to its file, with ~ for the home folder; null and empty are none."""
    home = os.path.dirname(os.path.realpath(project_file))
    return Path(os.path.realpath(os.path.join(home, os.path.expanduser(value)))) if value else None


def natural(name: str) -> Column:
    """Sort key of file names: numbers in them count by their value."""
    return F.transform(F.regexp_extract_all(F.col(name), F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))


def discovered(files: DataFrame, numeric: bool = False) -> DataFrame:
    """scene_id, stem, annotation, image from file names (folder, name): annotations with their best image, by name.

    numeric sorts scene-2 before scene-10.
    """
    stem = F.regexp_extract("name", r"^(.*)\.annotation\.json$", 1)
    notes = files.where(F.col("name").endswith(".annotation.json")).select("folder", stem.alias("stem"), F.col("name").alias("annotation"))
    kinds = F.array(*map(F.lit, IMAGES))
    pics = files.select("folder", F.regexp_extract("name", r"^(.*)\.[^.]+$", 1).alias("stem"), F.col("name").alias("image"), F.array_position(kinds, F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("k")).where("k > 0")
    best = pics.withColumn("n", F.row_number().over(Window.partitionBy("folder", "stem").orderBy("k"))).where("n = 1")
    return notes.join(best, ["folder", "stem"]).select("folder", id_from_stem(F.col("stem")).alias("scene_id"), "stem", "annotation", "image").orderBy("folder", natural("annotation") if numeric else "annotation")


def scene_sources(declared: DataFrame, files: DataFrame) -> DataFrame:
    """folder, scene_id, annotation, image of each project's scenes: those declared (folder, scene_id, annotation, image)
    if any of them has an annotation, else those found among the files (folder, name), else the declared ones."""
    some = declared.groupBy("folder").agg(F.max(F.coalesce(F.col("annotation"), F.lit("")) != "").alias("annotated"))
    names = ["folder", "scene_id", "annotation", "image"]
    found = discovered(files).select(*names).join(some.where("annotated"), "folder", "left_anti")
    own = declared.join(some, "folder").join(found.select("folder").distinct().withColumn("found", F.lit(True)), "folder", "left")
    return own.where("annotated or found is null").select(*names).unionByName(found)


def annotations_of(scenes: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scenes (scene_id, annotation) with `doc` of documents (path, doc), and warnings (scene_id, annotation) for those that have none."""
    joined = scenes.where("coalesce(annotation, '') != ''").join(documents.select(F.col("path").alias("annotation"), "doc", F.lit(True).alias("there")), "annotation", "left")
    return joined.where("there").drop("there"), joined.where("there is null").select("scene_id", "annotation")


def scene_count_checks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """source_id, name, ok, expected, scenes: whether a source has cues and as many scenes as its project says.

    expected: source_id, scenes; actual: source_id, cue_count, scene_count.
    """
    a = expected.select("source_id", F.col("scenes").alias("expected")).join(actual, "source_id", "left")
    ok = (F.coalesce("cue_count", F.lit(0)) > 0) & (F.coalesce("scene_count", F.lit(0)) == F.col("expected"))
    return a.select("source_id", F.lit("subtitle-segmentation").alias("name"), ok.alias("ok"), "expected", F.coalesce("scene_count", F.lit(0)).alias("scenes"))


def project_scenes(scenes: DataFrame) -> DataFrame:
    """A new project's scene rows from segmented scenes; images and annotations are not there yet."""
    none = F.lit(None).cast("string")
    return scenes.select("source_id", "scene_id", "start_ms", "end_ms", F.col("scene_duration_ms").alias("duration_ms"), F.array("first_cue", "last_cue").alias("cue_range"), "text", F.lit(CORE_MESSAGE).alias("core_message"), F.lit(NARRATIVE).alias("narrative_pattern"), F.array().cast("array<string>").alias("subject_bindings"), none.alias("image"), none.alias("annotation"), F.concat(F.lit("output/"), "scene_id", F.lit(".mp4")).alias("output"))


def only(scenes: DataFrame, ids: list[str] | None) -> DataFrame:
    """The scenes of the ids given, all if none are."""
    return scenes.where(F.col("scene_id").isin(ids)) if ids else scenes


def finished(steps: DataFrame) -> DataFrame:
    """source_id, artifact, valid, warnings: of steps (source_id, step, artifact, ok) in order, the last good artifact.

    A step that failed leaves the artifact before it and becomes a warning.
    """
    rows = steps.groupBy("source_id").agg(F.max_by(F.when(F.col("ok"), F.col("artifact")), F.when(F.col("ok"), F.col("step"))).alias("artifact"), F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("step")))).alias("warnings"))
    return rows.withColumn("valid", F.coalesce(F.col("artifact") != "", F.lit(False)))
