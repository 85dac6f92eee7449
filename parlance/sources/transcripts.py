"""Transcript sources: subtitle files (SRT, VTT) and RTTM segments, read as text and parsed with column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Time of a cue: hours may be missing, a comma or a point before the fraction.
_STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[,.](\d{1,6})"
#: A cue that names its speaker: "Speaker 2:", "[spk 1]:", with an ASCII or a full-width colon.
SPEAKER = r"(?i)^\s*[\[(]?\s*((?:speaker|spk)\s*[_ ]?\s*\d+)\s*[\])]?\s*[:：]\s*"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text), a row per file; bytes that are no UTF-8 are replaced and ``damaged`` says so."""
    f = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    raw = "cast(content as string)"
    return f.select("file", F.expr(f"make_valid_utf8({raw})").alias("text"), (~F.expr(f"is_valid_utf8({raw})")).alias("damaged"))


def seconds(stamp: Column) -> Column:
    """Seconds of a time stamp; null if it is none."""
    g = lambda i: F.regexp_extract(stamp, "^" + _STAMP + "$", i)
    h = F.when(g(1) == "", 0).otherwise(g(1).try_cast("int"))
    value = h * 3600 + g(2).try_cast("int") * 60 + g(3).try_cast("int") + F.concat(F.lit("0."), g(4)).try_cast("double")
    return F.when(stamp.rlike("^" + _STAMP + "$"), value)


def parse_cues(files: DataFrame) -> DataFrame:
    """(file, pos, start_s, end_s, text) of the blocks of subtitle texts (file, text), in order.

    A byte order mark, carriage returns, missing numbers and settings after the times are put up with; blocks
    without an arrow are left out. A stamp that cannot be read gives a null time.
    """
    clean = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(clean, r"\n[ \t]*\n\s*"), lambda b: b.contains("-->"))
    b = files.select("file", F.posexplode(blocks).alias("pos", "block"))
    line = r"(?s)^(?:.*?\n)?\s*(\S+)[ \t]*-->[ \t]*(\S+)[^\n]*(?:\n(.*))?$"
    part = lambda i: F.regexp_extract("block", line, i)
    return b.select("file", "pos", seconds(part(1)).alias("start_s"), seconds(part(2)).alias("end_s"), F.trim(part(3)).alias("text"))


def fill_speakers(cues: DataFrame) -> DataFrame:
    """(file, pos, speaker, start_s, end_s, text): a cue without a name goes on with the last one of its file.

    Cues before the first name and cues that do not end after they start are left out, and files that name no
    speaker at all give nothing (see ``unnamed``).
    """
    label = F.regexp_extract("text", SPEAKER, 1)
    c = cues.withColumn("__label", F.when(label != "", label))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("speaker", F.last("__label", ignorenulls=True).over(w))
    c = c.where("speaker IS NOT NULL AND end_s > start_s")
    n = F.regexp_extract("speaker", r"(\d+)", 1).cast("int")
    return c.select("file", "pos", F.format_string("SPEAKER_%02d", n).alias("speaker"), "start_s", "end_s", F.regexp_replace("text", SPEAKER, "").alias("text"))


def unnamed(cues: DataFrame) -> DataFrame:
    """Files in which no cue names a speaker."""
    return cues.groupBy("file").agg(F.bool_or(F.col("text").rlike(SPEAKER)).alias("__any")).where("NOT __any").select("file")


def parse_rttm(lines: DataFrame) -> DataFrame:
    """(file, speaker, start_s, end_s) of RTTM lines (file, line). Segments without a length are left out; a line
    that is too short has ``error``."""
    one = F.split(F.regexp_replace(F.trim("line"), r"\s+", " "), " ")
    # a generator, as a filter on its output is not pushed below it: each line is made and split once
    f = lines.select("file", F.explode(F.array(one)).alias("__f"))
    long = F.size("__f") >= 8
    at = lambda i: F.when(long, F.get("__f", F.lit(i)))
    start, length = at(3).try_cast("double"), at(4).try_cast("double")
    kept = f.where((F.size("__f") > 1) | (F.get("__f", F.lit(0)) != "")).where(~long | ((at(0) == "SPEAKER") & (length > 0)))
    return kept.select("file", at(7).alias("speaker"), start.alias("start_s"), (start + length).alias("end_s"), F.when(~long, F.lit("too few fields")).alias("error"))


READERS = {"srt": "cues", "vtt": "cues", "rttm": "rttm"}


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all transcripts under a path, each file by the reader of its extension; others are refused."""
    f = read_files(spark, path).withColumn("__kind", F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)))
    bad = f.where(~F.col("__kind").isin(*READERS)).select("file").take(3)
    if bad:
        raise ValueError("no times in " + ", ".join(r["file"] for r in bad))
    cues = fill_speakers(parse_cues(f.where(F.col("__kind").isin("srt", "vtt")))).select("file", "speaker", "start_s", "end_s", "text")
    lines = f.where("__kind = 'rttm'").select("file", F.explode(F.split("text", "\n")).alias("line"))
    rttm = parse_rttm(lines).where("error IS NULL").select("file", "speaker", "start_s", "end_s", F.lit(None).cast("string").alias("text"))
    return cues.unionByName(rttm)
