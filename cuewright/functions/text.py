"""Column functions on timed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks that end sentences and clauses, and the closing marks that may follow.
SENTENCE_MARKS = "。！？!?…"
CLAUSE_MARKS = "，、；：,;:"
CLOSING_MARKS = "\"'”’）】》」』"
TIMESTAMP = r"(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[,.](\d{1,3})"
TAG = r"<[^>]+>"
#: What has the property White_Space, which is what \s means with (?U).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Pause after a cue of estimated length, and the least length of one, in ms.
PAUSE_MS, LEAST_MS = 150, 1200


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space at either side, ideographic spaces included."""
    return F.btrim(c, F.lit(WHITE))


def unified(c: Column) -> Column:
    """Without byte order marks in front, and with \n for any line end."""
    return F.replace(F.replace(F.ltrim(c, F.lit("\ufeff")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def timestamp_ms(c: Column) -> Column:
    """Milliseconds of the first time in c, as [h:]mm:ss,mmm; null without one. Fractions are padded on the right."""

    def value(m: Column) -> Column:
        part = lambda i: F.element_at(F.split(m, "[:,.]"), i).cast("long")
        hours = F.when(F.length(m) - F.length(F.replace(m, F.lit(":"))) == 2, part(1)).otherwise(F.lit(0).cast("long"))
        fraction = F.rpad(F.element_at(F.split(m, "[:,.]"), -1), 3, "0").cast("long")
        return F.when(m != "", ((hours * 60 + part(-3)) * 60 + part(-2)) * 1000 + fraction)

    return let(F.regexp_extract(c, TIMESTAMP, 0), value)


def one_line(c: Column) -> Column:
    """A text's lines as one: trimmed, without empty ones and tags, and with single spaces."""
    plain = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, TAG, "")).otherwise(c)
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return one_line(c)


def _last_mark(c: Column) -> Column:
    """The last character before white space and closing marks."""
    return F.substring(F.rtrim(trimmed(c), F.lit(CLOSING_MARKS)), -1, 1)


def ends_sentence(c: Column) -> Column:
    return _last_mark(c).isin(*SENTENCE_MARKS)


def ends_clause(c: Column) -> Column:
    return _last_mark(c).isin(*CLAUSE_MARKS, *SENTENCE_MARKS)


def sentences(c: Column) -> Column:
    """The parts of a plain text: it is cut after each mark that ends a sentence and at line ends."""
    parts = F.filter(F.transform(F.split(trimmed(unified(c)), rf"(?U)(?<=[{SENTENCE_MARKS}])\s*|\n+"), trimmed), lambda x: x != "")
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(parts)


def estimated_ms(c: Column, chars_per_second: float = 6.0) -> Column:
    """Reading time of a text, LEAST_MS at least, rounded half to even."""
    seconds = F.greatest(F.lit(LEAST_MS / 1000), F.length(c) / F.lit(max(0.5, float(chars_per_second))))
    return F.rint(seconds * 1000).cast("long")


def scene_id(n: Column) -> Column:
    return F.format_string("scene-%02d", n)


def element_estimate(text: Column) -> Column:
    """Elements that a scene's text asks for: one for 34 characters, 2 to 7."""
    return F.greatest(F.lit(2), F.least(F.lit(7), F.ceil(F.length(text) / 34.0))).cast("int")


def id_from_stem(stem: Column) -> Column:
    """scene-01 of scene-01-any-title; other stems as they are."""
    return F.when(stem.startswith("scene-"), F.substring_index(stem, "-", 2)).otherwise(stem)


def is_timed(c: Column) -> Column:
    """Whether a text has a timeline, by content."""
    return F.contains(c, F.lit("-->"))


def is_timed_file(name: Column) -> Column:
    """Whether a file holds timed text, by its extension."""
    return F.lower(name).rlike(r"\.(srt|vtt)$")


def key_value(c: Column) -> Column:
    """KEY=VALUE as a struct; the value is JSON (VARIANT), or else a string. Null without a key."""
    key, value = trimmed(F.split_part(c, F.lit("="), F.lit(1))), trimmed(F.regexp_replace(c, r"^[^=]*=", ""))
    parsed = F.coalesce(F.try_parse_json(value), F.to_variant_object(F.array(value)))
    return F.when(F.contains(c, F.lit("=")) & (key != ""), F.struct(key.alias("key"), parsed.alias("value"), value.alias("raw")))


def hex_bgr(c: Column) -> Column:
    """#RRGGBB as [b, g, r]; null for anything else."""
    digits = F.regexp_replace(c, "^#", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.array(*(F.conv(F.substring(digits, at, 2), 16, 10).cast("int") for at in (5, 3, 1))))


def listed(c: Column) -> Column:
    """A comma-separated field as an array, without empty items."""
    return F.filter(F.transform(F.split(c, ","), trimmed), lambda x: x != "")


def srt_time(ms: Column, comma: str = ",") -> Column:
    """hh:mm:ss,mmm"""
    return F.format_string(f"%02d:%02d:%02d{comma}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
