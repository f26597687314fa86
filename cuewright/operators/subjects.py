"""Subjects of scenes: replacing, removing, and updating them in profiles and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replaced(ids: Column, old: Column, new: Column) -> Column:
    """ids with old as new; of equal ids the first stays."""
    return F.array_distinct(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.when(x == old, new).otherwise(x)))


def removed(ids: Column, old: Column) -> Column:
    return F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x != old)


def in_elements(elements: Column, change) -> Column:
    """An annotation's elements with `subject_ids` changed by a function of a column."""
    return F.transform(elements, lambda e: e.withField("subject_ids", change(e["subject_ids"])))


def upserted(profiles: DataFrame, subject_id: str, *, replace_id: str | None = None, kind: str | None = None, name: str | None = None, appearance: dict[str, str] | None = None, replaceable: bool | None = None, identity_lock: list[str] | None = None, negative_constraints: list[str] | None = None, set_default: bool = False) -> DataFrame:
    """Add or change a subject in profiles (project_id, default_id, subjects map of structs).

    It starts as a copy of the one that it replaces, else of itself, else with
    defaults; what is given is set, and appearance is merged. A replaced subject
    goes, and the default follows.
    """
    own, old = F.try_element_at("subjects", F.lit(subject_id)), F.try_element_at("subjects", F.lit(replace_id)) if replace_id else F.lit(None)
    base = F.coalesce(old, own)
    pick = lambda given, key, default: F.lit(given) if given is not None else F.coalesce(base[key], default)
    words = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    extra = F.create_map(*(F.lit(x) for kv in (appearance or {}).items() for x in kv)) if appearance else F.create_map().cast("map<string,string>")
    look = F.coalesce(base["appearance"], F.create_map().cast("map<string,string>"))
    look = F.map_concat(F.map_filter(look, lambda k, _: ~k.isin(*(appearance or {"": ""}))), extra)
    listed = lambda given, key: words(given) if given is not None else F.coalesce(base[key], words([]))
    entry = F.struct(
        pick(kind, "kind", F.lit("object")).alias("kind"),
        pick(name, "name", F.lit(subject_id)).alias("name"),
        pick(replaceable, "replaceable", F.lit(True)).alias("replaceable"),
        look.alias("appearance"),
        listed(identity_lock, "identity_lock").alias("identity_lock"),
        listed(negative_constraints, "negative_constraints").alias("negative_constraints"),
    )
    gone = [x for x in (subject_id, replace_id) if x]
    subjects = F.map_concat(F.map_filter("subjects", lambda k, _: ~k.isin(*gone)), F.create_map(F.lit(subject_id), entry))
    default = F.lit(subject_id) if set_default else F.when(F.col("default_id") == F.lit(replace_id), F.lit(subject_id)).otherwise(F.col("default_id"))
    return profiles.withColumns({"subjects": subjects, "default_id": default})


def dropped(profiles: DataFrame, subject_id: str) -> DataFrame:
    """Profiles without a subject; a default of that subject becomes null."""
    return profiles.withColumns({"subjects": F.map_filter("subjects", lambda k, _: k != subject_id), "default_id": F.when(F.col("default_id") != subject_id, F.col("default_id"))})


def emptied(profiles: DataFrame) -> DataFrame:
    """Profiles of mode `none`: no subjects, no default."""
    return profiles.withColumns({"mode": F.lit("none"), "default_id": F.lit(None).cast("string"), "subjects": F.map_filter("subjects", lambda k, v: F.lit(False))})


def rewritten(scenes: DataFrame, old: str, new: str | None, column: str = "subject_ids") -> DataFrame:
    """scenes with old replaced by new, or removed if new is None, and `changed` where that makes a difference."""
    ids = F.coalesce(F.col(column), F.array().cast("array<string>"))
    after = removed(ids, F.lit(old)) if new is None else replaced(ids, F.lit(old), F.lit(new))
    return scenes.withColumns({"changed": after != ids, column: after})


def resequenced(elements: DataFrame) -> DataFrame:
    """scene_id, element_id, sequence: arrays of elements (scene_id, elements) numbered from 1 in their order."""
    rows = elements.select("scene_id", F.posexplode("elements").alias("n", "e"))
    return rows.select("scene_id", F.col("e.id").alias("element_id"), (F.col("n") + 1).alias("sequence"))


def with_defaults(elements: DataFrame) -> DataFrame:
    """Element rows with what the format leaves out filled in."""
    return elements.withColumns(
        {
            "element_id": F.coalesce("element_id", F.concat(F.lit("element-"), (F.col("position") + 1).cast("string"))),
            "sequence": F.coalesce(F.col("sequence").cast("long"), F.col("position").cast("long") + 1),
            "start_ms": F.coalesce("start_ms", F.lit(0)),
            "duration_ms": F.coalesce("duration_ms", F.lit(1200)),
            "direction": F.coalesce("direction", F.lit("auto")),
            "policy": F.coalesce("policy", F.lit("subtract-later")),
            "final_hold_ms": F.coalesce("final_hold_ms", F.lit(700)),
        }
    )
