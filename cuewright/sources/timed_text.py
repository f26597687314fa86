"""SRT, WebVTT and plain text as ordered cues, many sources at once.

Sources are rows (source_id, text). Cues are rows (source_id, index,
source_block, start_ms, end_ms, dur_ms, text, estimated); index counts a source's
cues from 1 in the order of start, end and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PAUSE_MS, WHITE, estimated_ms, is_timed, one_line, sentences, srt_time, timestamp_ms, trimmed, unified

ARROW = "-->"
CUE = ["source_id", "index", "source_block", "start_ms", "end_ms", "dur_ms", "text", "estimated"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row each: source_id (the path), name, text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def _parts(sources: DataFrame) -> DataFrame:
    """source_id, format (srt, webvtt or plain), n (from 0), part: the blocks of timed texts and the sentences of plain ones, from one pass over the sources.

    The texts are dealt out before they are cut, so that a file of many isn't cut by
    one task; what follows needs the same key.
    """
    rows = sources.select("source_id", "text").repartition("source_id")
    clean = unified(F.col("text"))
    vtt = F.upper(F.substring(F.ltrim(clean, F.lit(WHITE)), 1, 6)) == "WEBVTT"
    form = F.when(~F.coalesce(is_timed(F.col("text")), F.lit(False)), "plain").when(vtt, "webvtt").otherwise("srt")
    rows = rows.select("source_id", "text", form.alias("format"))
    whole = trimmed(F.when(F.col("format") == "webvtt", F.regexp_replace(clean, r"(?Ui)^\s*WEBVTT[^\n]*\n", "")).otherwise(clean))
    rows = rows.withColumn("whole", F.when(F.col("format") != "plain", whole))
    timed = F.when(F.col("whole") != "", F.split("whole", r"(?U)\n\s*\n")).otherwise(F.array().cast("array<string>"))
    return rows.select("source_id", "format", F.posexplode(F.when(F.col("format") == "plain", sentences(F.col("text"))).otherwise(timed)).alias("n", "part"))


def _judged(parts: DataFrame) -> DataFrame:
    """Parts of timed text as blocks(); those of plain text pass with nulls.

    A part is cut at its first arrow by string functions. What is wrong with a block
    comes out of inline(), so that filters on it stay behind it and repeat no parsing.
    """
    plain, part, head, rest, side = F.col("format") == "plain", F.col("part"), F.col("head"), F.col("rest"), F.col("side")
    rows = parts.select("source_id", "format", (F.col("n") + 1).alias("source_block"), "part", F.when(~plain & F.contains("part", F.lit(ARROW)), F.substring_index("part", ARROW, 1)).alias("head"))
    rows = rows.withColumn("rest", F.substr(part, F.length(head) + len(ARROW) + 1))
    rows = rows.withColumn("side", F.substring_index(rest, "\n", 1))
    word = lambda s: F.regexp_extract(s, r"(?U)^\s*(\S+)", 1)
    rows = rows.select(
        *("source_id", "format", "source_block", "part", "head"),
        timestamp_ms(word(F.substring_index(head, "\n", -1))).alias("start_ms"),
        timestamp_ms(word(side)).alias("end_ms"),
        F.when(plain, part).otherwise(one_line(F.when(head.isNull(), part).otherwise(F.substr(rest, F.length(side) + 2)))).alias("text"),
    )
    note = head.isNull() & (F.col("format") == "webvtt") & part.rlike(r"(?U)^(?:\s*\n)?(?:NOTE|STYLE|REGION)")
    kept = plain | ((trimmed(part) != "") & ~note)
    problem = F.when(head.isNull(), "no-timeline").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "bad-timestamp").when(F.col("text") == "", "empty-body").when(F.col("end_ms") <= F.col("start_ms"), "end-not-after-start")
    block = F.struct("start_ms", "end_ms", "text", F.when(~plain, problem).alias("problem"), kept.alias("kept"))
    return rows.select("source_id", "format", "source_block", F.inline(F.array(block))).where("kept").drop("kept")


def blocks(sources: DataFrame) -> DataFrame:
    """Blocks of timed text with what is wrong with each: format, source_block, start_ms, end_ms, text, problem.

    problem is null for a cue, else no-timeline, bad-timestamp, empty-body or
    end-not-after-start, whichever comes first. WebVTT's NOTE, STYLE and REGION
    blocks are left out. A timeline with nothing at one side is a bad timestamp.
    Texts without any timeline are plain, and have no blocks.
    """
    return _judged(_parts(sources)).where("format <> 'plain'")


def _ordered(rows: DataFrame, chars_per_second: float) -> DataFrame:
    """Cues of sound blocks and of sentences: those by their times, these one after another with PAUSE_MS between two."""
    plain = F.col("format") == "plain"
    rows = rows.withColumn("dur_ms", F.when(plain, estimated_ms(F.col("text"), chars_per_second)).otherwise(F.col("end_ms") - F.col("start_ms")))
    order = Window.partitionBy("source_id").orderBy("start_ms", "end_ms", "source_block")
    cursor = F.coalesce(F.sum(F.col("dur_ms") + PAUSE_MS).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumns({"index": F.row_number().over(order), "cursor": cursor})
    rows = rows.withColumns({"start_ms": F.when(plain, F.col("cursor")).otherwise(F.col("start_ms")), "end_ms": F.when(plain, F.col("cursor") + F.col("dur_ms")).otherwise(F.col("end_ms")), "estimated": plain})
    return rows.select(*CUE)


def timed_cues(sources: DataFrame) -> DataFrame:
    return _ordered(blocks(sources).where("problem is null"), 6.0)


def warnings(sources: DataFrame) -> DataFrame:
    """source_id, source_block, problem: blocks of timed text that are left out, and estimated-timing for plain text."""
    form = F.when(F.coalesce(is_timed(F.col("text")), F.lit(False)), F.col("text"))
    # a plain text's warning is a row of its own: it goes along as a part, however many sentences there are
    plain = F.struct(F.lit("plain").alias("format"), F.lit(None).cast("int").alias("source_block"), F.lit("estimated-timing").alias("problem"))
    rows = _judged(_parts(sources.select("source_id", F.coalesce(form, F.lit("-")).alias("text"))))
    found = F.when(F.col("format") == "plain", plain).otherwise(F.struct("format", "source_block", "problem"))
    return rows.select("source_id", found.alias("w")).where("w.problem is not null").select("source_id", "w.source_block", "w.problem")


def plain_cues(sources: DataFrame, chars_per_second: float = 6.0) -> DataFrame:
    """Cues of plain text: a sentence each, its length from its characters, PAUSE_MS between two."""
    # the texts are dealt out before they are cut, so that a file of many isn't cut by one task; the sums below need the same key
    texts = sources.select("source_id", "text").repartition("source_id")
    rows = texts.select("source_id", F.posexplode(sentences(F.col("text"))).alias("n", "text"))
    rows = rows.select("source_id", (F.col("n") + 1).alias("index"), "text", estimated_ms(F.col("text"), chars_per_second).alias("dur_ms"))
    before = Window.partitionBy("source_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_ms") + PAUSE_MS).over(before), F.lit(0).cast("long"))
    rows = rows.withColumns({"source_block": F.col("index"), "start_ms": start, "estimated": F.lit(True)})
    return rows.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms")).select(*CUE)


def cues(sources: DataFrame, chars_per_second: float = 6.0) -> DataFrame:
    """Cues of each source, timed if it has a timeline, else estimated."""
    return _ordered(_judged(_parts(sources)).where("problem is null"), chars_per_second)


def to_srt(cue_rows: DataFrame, webvtt: bool = False) -> DataFrame:
    """source_id, text: each source's cues as one SRT or WebVTT text."""
    mark = "." if webvtt else ","
    block = F.concat_ws("\n", F.col("index").cast("string"), F.concat(srt_time(F.col("start_ms"), mark), F.lit(" --> "), srt_time(F.col("end_ms"), mark)), "text")
    texts = cue_rows.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("index", block.alias("b")))).alias("b"))
    return texts.select("source_id", F.concat(F.lit("WEBVTT\n\n" if webvtt else ""), F.array_join("b.b", "\n\n"), F.lit("\n")).alias("text"))
