"""The test tables in the shapes that the operators take, for Spark and as SQL common table expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: Time parameters for the spans of ``events``, in microseconds.
GAP, PAUSE, LATENCY = 5 * MINUTE, 2 * MINUTE, 240 * MINUTE
#: One bucket of a long session when it is swept.
WIDTH = 24 * 60 * MINUTE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("start", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)"))
    e = e.withColumn("session_id", F.floor(F.col("user_id") / 5).cast("long"))
    kind = F.col("event_type")
    speaker = F.when(kind.isin("click", "view"), "SPEAKER_00").when(kind.isin("purchase", "signup"), "SPEAKER_01").otherwise("SPEAKER_02")
    return e.withColumn("speaker", speaker)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, speaker, start, end) in microseconds, from events and their values in minutes."""
    e = timed_events(spark, sf_dir)
    return e.select("session_id", "speaker", "start", (F.col("start") + F.round(F.col("value") * 60).cast("long") * 1_000_000).alias("end"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, speaker, role) for the first two speakers; the third has none."""
    s = spans(spark, sf_dir).select("session_id", "speaker").distinct().where("speaker <> 'SPEAKER_02'")
    return s.withColumn("role", F.when(F.col("speaker") == "SPEAKER_00", "subject").otherwise("partner"))


def role_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.turns import with_roles

    return with_roles(spans(spark, sf_dir), roles(spark, sf_dir)).select("session_id", "role", "start", "end")


def named(spans: DataFrame) -> DataFrame:
    """Spans with the column names of results."""
    return spans.withColumnsRenamed({"start": "start_us", "end": "end_us"})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-instant measurements: two units, a detection flag and a confidence."""
    e = timed_events(spark, sf_dir)
    return e.select(
        "session_id",
        F.col("event_id").alias("frame_index"),
        F.col("start").alias("t"),
        (F.col("event_type") != "error").alias("detected"),
        (F.col("value") / 500).alias("confidence"),
        F.col("value").alias("unit_a"),
        F.get_json_object("props", "$.k").cast("double").alias("unit_b"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-channel samples by supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("session_id"), "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("left"), (F.col("l_extendedprice") / 100000).alias("right"))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch, level and harmonicity frames: one span per order and supplier; a discount of 0 is unvoiced."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("session_id"),
        F.col("l_orderkey").alias("span_index"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") * 10).alias("f0"),
        (F.col("l_extendedprice") / 1000).alias("intensity"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("hnr"),
    )


EVENTS_SQL = """
ev AS (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS start, CAST(floor(user_id / 5) AS BIGINT) AS session_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'SPEAKER_00' WHEN event_type IN ('purchase', 'signup') THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker
  FROM events)"""
SPANS_SQL = EVENTS_SQL + """,
spans AS (SELECT session_id, speaker, start, start + CAST(round(value * 60) AS BIGINT) * 1000000 AS "end",
  CASE speaker WHEN 'SPEAKER_00' THEN 'subject' WHEN 'SPEAKER_01' THEN 'partner' ELSE 'unknown' END AS role FROM ev)"""
FRAMES_SQL = EVENTS_SQL + """,
frames AS (SELECT session_id, event_id AS frame_index, start AS t, event_type <> 'error' AS detected, value / 500 AS confidence,
  value AS unit_a, CAST(json_extract(props, '$.k') AS DOUBLE) AS unit_b FROM ev)"""
CHANNELS_SQL = """
channels AS (SELECT l_suppkey AS session_id, l_quantity / 50 AS "left", l_extendedprice / 100000 AS "right" FROM lineitem)"""
CONTOURS_SQL = """
contours AS (SELECT l_suppkey AS session_id, l_orderkey AS span_index, l_linenumber AS pos, CASE WHEN l_discount > 0 THEN l_quantity * 10 END AS f0,
  l_extendedprice / 1000 AS intensity, CASE WHEN l_tax > 0 THEN l_tax * 100 END AS hnr FROM lineitem)"""


def merge_sql(name: str, source: str, keys: str, gap: int = 0) -> str:
    """A merged CTE ``name`` of the spans of ``source`` (a table or a parenthesised query)."""
    return f"""
{name}_1 AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE "end" > start),
{name}_2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_1),
{name} AS (SELECT {keys}, min(start) AS start, max("end") AS "end", count(*) AS n_spans FROM {name}_2 GROUP BY {keys}, island)"""


def elementary_sql(name: str, left: str, right: str, key: str, both: bool) -> str:
    """Brute force: stretches between neighbouring ends, tested against every span of either side, then merged."""
    test = "EXISTS" if both else "NOT EXISTS"
    return f"""
{name}_t AS (SELECT {key}, t, lead(t) OVER (PARTITION BY {key} ORDER BY t) AS u FROM (
  SELECT {key}, start AS t FROM {left} UNION SELECT {key}, "end" FROM {left} UNION SELECT {key}, start FROM {right} UNION SELECT {key}, "end" FROM {right})),
{name}_p AS (SELECT {key}, t AS start, u AS "end" FROM {name}_t WHERE u IS NOT NULL
  AND EXISTS (SELECT 1 FROM {left} a WHERE a.{key} = {name}_t.{key} AND a.start <= t AND t < a."end")
  AND {test} (SELECT 1 FROM {right} b WHERE b.{key} = {name}_t.{key} AND b.start <= t AND t < b."end")),{merge_sql(name, name + '_p', key)}"""


def pairs_sql(name: str, left: str, right: str, key: str) -> str:
    """Brute force: overlaps of all pairs of merged spans."""
    return (
        merge_sql(f"{name}_l", left, key)
        + ","
        + merge_sql(f"{name}_r", right, key)
        + f""",
{name} AS (SELECT a.{key}, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM {name}_l a JOIN {name}_r b USING ({key})
  WHERE greatest(a.start, b.start) < least(a."end", b."end"))"""
    )
