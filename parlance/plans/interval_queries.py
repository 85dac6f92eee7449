"""Queries of the interval algebra and of turn taking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spans as sp
from ..operators import turns as tn
from . import adapters as ad

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


US = 'start AS start_us, "end" AS end_us'
SUBJECT = "(SELECT * FROM spans WHERE role = 'subject')"
OWN_OTHER = ",\nown AS (SELECT * FROM spans WHERE role = 'subject'), other AS (SELECT * FROM spans WHERE role = 'partner')"
TURNS_SQL = (
    ad.SPANS_SQL
    + ","
    + ad.merge_sql("m", "spans", "session_id, role", ad.GAP)
    + """,
t1 AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY session_id ORDER BY start, "end", role)),
t2 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start, "end", role ROWS UNBOUNDED PRECEDING) AS run FROM t1),
t3 AS (SELECT session_id, CAST(run - 1 AS INT) AS turn_index, any_value(role) AS role, min(start) AS start, max("end") AS "end", CAST(sum(n_spans) AS BIGINT) AS n_spans FROM t2 GROUP BY session_id, run),
turns AS (SELECT *, CASE WHEN role = 'subject' AND lag(role) OVER w = 'partner' THEN start - lag("end") OVER w END AS latency
  FROM t3 WINDOW w AS (PARTITION BY session_id ORDER BY turn_index))"""
)
PAUSES_SQL = (
    ","
    + ad.merge_sql("u", "spans", "session_id, role")
    + f""",
h AS (SELECT u.session_id, u.role, u.start, u."end", max(t.turn_index) AS turn_index FROM u JOIN turns t
  ON t.session_id = u.session_id AND t.role = u.role AND t.start <= u.start AND u."end" <= t."end" GROUP BY ALL),
p AS (SELECT session_id, role, turn_index, lag("end") OVER w AS pause_start, start AS pause_end FROM h
  WINDOW w AS (PARTITION BY session_id, role, turn_index ORDER BY start)),
pauses AS (SELECT *, pause_end - pause_start AS pause FROM p WHERE pause_end - pause_start > {ad.PAUSE})"""
)


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = ad.role_spans(spark, sf)
    return tuple(s.where(F.col("role") == r).select("session_id", "start", "end") for r in (tn.SUBJECT, tn.PARTNER))


@query("span_merge", "WITH " + ad.SPANS_SQL + "," + ad.merge_sql("m", "spans", "session_id, speaker", ad.GAP) + f"\nSELECT session_id, speaker, {US}, n_spans FROM m")
def span_merge(spark, sf):
    return ad.named(sp.merge(ad.spans(spark, sf), ["session_id", "speaker"], ad.GAP, width=ad.WIDTH))


@query("span_intersect", "WITH " + ad.SPANS_SQL + OWN_OTHER + "," + ad.pairs_sql("x", "own", "other", "session_id") + f"\nSELECT session_id, {US} FROM x")
def span_intersect(spark, sf):
    return ad.named(sp.intersect(*_sides(spark, sf), ["session_id"], width=ad.WIDTH))


@query("span_subtract", "WITH " + ad.SPANS_SQL + OWN_OTHER + "," + ad.elementary_sql("x", "own", "other", "session_id", False) + f"\nSELECT session_id, {US} FROM x")
def span_subtract(spark, sf):
    return ad.named(sp.subtract(*_sides(spark, sf), ["session_id"], width=ad.WIDTH))


@query(
    "span_gaps",
    "WITH " + ad.SPANS_SQL + "," + ad.merge_sql("m", "spans", "session_id, speaker")
    + f"""\nSELECT session_id, speaker, before AS start_us, start AS end_us FROM (SELECT *, lag("end") OVER (PARTITION BY session_id, speaker ORDER BY start) AS before FROM m)
WHERE start - before > {ad.PAUSE}""",
)
def span_gaps(spark, sf):
    return ad.named(sp.gaps(ad.spans(spark, sf), ["session_id", "speaker"], ad.PAUSE))


@query(
    "span_durations",
    "WITH " + ad.SPANS_SQL + OWN_OTHER + "," + ad.pairs_sql("x", "own", "other", "session_id")
    + """,
t AS (SELECT session_id, sum("end" - start) AS total FROM own GROUP BY 1), c AS (SELECT session_id, sum("end" - start) AS covered FROM x_l GROUP BY 1),
o AS (SELECT session_id, sum("end" - start) AS overlap FROM x GROUP BY 1)
SELECT session_id, CAST(total AS BIGINT) AS total, CAST(coalesce(covered, 0) AS BIGINT) AS covered, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap
FROM t LEFT JOIN c USING (session_id) LEFT JOIN o USING (session_id)""",
)
def span_durations(spark, sf):
    return sp.durations(*_sides(spark, sf), ["session_id"])


EXTENT_SQL = """,
extents AS (SELECT session_id, min(start) + (max(start) - min(start)) // 4 AS x0, min(start) + (max(start) - min(start)) // 2 AS x1 FROM spans GROUP BY 1)"""


def _extents(s: DataFrame) -> DataFrame:
    lo, reach = F.min("start"), F.max("start") - F.min("start")
    return s.groupBy("session_id").agg((lo + F.floor(reach / 4)).cast("long").alias("extent_start"), (lo + F.floor(reach / 2)).cast("long").alias("extent_end"))


@query(
    "span_clip",
    "WITH " + ad.SPANS_SQL + EXTENT_SQL
    + """\nSELECT session_id, speaker, greatest(start, x0) AS start_us, least("end", x1) AS end_us FROM spans JOIN extents USING (session_id) WHERE greatest(start, x0) < least("end", x1)""",
)
def span_clip(spark, sf):
    s = ad.spans(spark, sf)
    return ad.named(sp.clip(s, _extents(s), ["session_id"]).select("session_id", "speaker", "start", "end"))


@query(
    "span_invert",
    "WITH " + ad.SPANS_SQL + EXTENT_SQL + """,
whole AS (SELECT session_id, x0 AS start, x1 AS "end" FROM extents)""" + "," + ad.elementary_sql("x", "whole", "spans", "session_id", False) + f"\nSELECT session_id, {US} FROM x",
)
def span_invert(spark, sf):
    s = ad.spans(spark, sf)
    return ad.named(sp.invert(s, _extents(s), ["session_id"]))


@query(
    "points_in_spans",
    "WITH " + ad.FRAMES_SQL + ad.SPANS_SQL[len(ad.EVENTS_SQL) :]
    + """\nSELECT session_id, frame_index, EXISTS (SELECT 1 FROM spans s WHERE s.session_id = f.session_id AND s.role = 'partner' AND s.start <= f.t AND f.t < s."end") AS inside FROM frames f""",
)
def points_in_spans(spark, sf):
    partner = _sides(spark, sf)[1]
    p = ad.frames(spark, sf).select("session_id", "frame_index", "t")
    return sp.points_in_spans(p, partner, ["session_id"]).select("session_id", "frame_index", "inside")


SPEECH_SQL = ",\nspeech AS (SELECT session_id, start, \"end\" - (\"end\" - start) // 2 AS \"end\" FROM spans)"


def _speech(spark, sf):
    half = F.floor((F.col("end") - F.col("start")) / 2).cast("long")
    return ad.spans(spark, sf).select("session_id", "start", (F.col("end") - half).alias("end"))


@query(
    "refine_intersect",
    "WITH " + ad.SPANS_SQL + SPEECH_SQL + "," + ad.merge_sql("a", "spans", "session_id, speaker") + "," + ad.merge_sql("b", "speech", "session_id")
    + """\nSELECT a.session_id, a.speaker, greatest(a.start, b.start) AS start_us, least(a."end", b."end") AS end_us FROM a JOIN b USING (session_id)
WHERE greatest(a.start, b.start) < least(a."end", b."end")""",
)
def refine_intersect(spark, sf):
    return ad.named(sp.refine_by_intersection(ad.spans(spark, sf), _speech(spark, sf)))


@query(
    "refine_shift",
    "WITH " + ad.EVENTS_SQL + """,
seg AS (SELECT event_id AS segment_id, session_id, speaker, start, start + CAST(round(value * 60) AS BIGINT) * 1000000 AS "end" FROM ev),
moved AS (SELECT session_id, speaker, start + o AS start, least(start + o + 60000000, "end") AS "end" FROM seg, (SELECT unnest([0, 30000000, 300000000]) AS o))"""
    + "," + ad.merge_sql("m", "moved", "session_id, speaker") + f"\nSELECT session_id, speaker, {US} FROM m",
)
def refine_shift(spark, sf):
    e = ad.timed_events(spark, sf)
    seg = e.select(F.col("event_id").alias("segment_id"), "session_id", "speaker", "start", (F.col("start") + F.round(F.col("value") * 60).cast("long") * 1_000_000).alias("end"))
    local = seg.select("segment_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, ad.MINUTE // 2, 5 * ad.MINUTE)])).alias("start"))
    return ad.named(sp.refine_by_shift(seg, local.withColumn("end", F.col("start") + ad.MINUTE)))


@query("spans_by_role", "WITH " + ad.SPANS_SQL + "\nSELECT session_id, role, count(*) AS n, CAST(sum(\"end\" - start) AS BIGINT) AS total FROM spans GROUP BY 1, 2")
def spans_by_role(spark, sf):
    return ad.role_spans(spark, sf).groupBy("session_id", "role").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"))


@query("turns", "WITH " + TURNS_SQL + f"\nSELECT session_id, turn_index, role, {US}, n_spans FROM turns")
def turns(spark, sf):
    return ad.named(tn.build_turns(ad.role_spans(spark, sf), ad.GAP))


@query("latencies", "WITH " + TURNS_SQL + "\nSELECT session_id, turn_index, latency FROM turns WHERE latency IS NOT NULL")
def latencies(spark, sf):
    t = tn.with_latency(tn.build_turns(ad.role_spans(spark, sf), ad.GAP))
    return t.where("latency IS NOT NULL").select("session_id", "turn_index", "latency")


@query("pauses", "WITH " + TURNS_SQL + PAUSES_SQL + "\nSELECT session_id, role, turn_index, pause_start, pause_end, pause FROM pauses")
def pauses(spark, sf):
    s = ad.role_spans(spark, sf)
    return tn.pauses(s, ad.GAP, ad.PAUSE)


TIMELINE_SQL = ad.SPANS_SQL + OWN_OTHER + "," + ad.merge_sql("speaking", "own", "session_id") + "," + ad.elementary_sql("listening", "other", "own", "session_id", False) + """,
timeline AS (SELECT session_id, 'speaking' AS state, start, "end" FROM speaking UNION ALL SELECT session_id, 'listening', start, "end" FROM listening)"""


@query("timeline", "WITH " + TIMELINE_SQL + f"\nSELECT session_id, state, {US} FROM timeline")
def timeline(spark, sf):
    return ad.named(tn.timeline(ad.role_spans(spark, sf)))


FEATURES = [
    "n_per_minute", "subject_speaking_ratio", "overlap_ratio", "latency_mean", "latency_median", "latency_sd", "interruption_rate",
    "subject_turn_duration_mean", "subject_turn_duration_sd", "partner_turn_duration_mean", "pause_within_mean", "pause_within_rate",
]
_S = "1000000.0"


@query(
    "turn_features",
    "WITH " + TURNS_SQL + PAUSES_SQL + OWN_OTHER + ",\npair AS (SELECT * FROM spans WHERE role <> 'unknown')," + ad.merge_sql("pm", "pair", "session_id")
    + "," + ad.pairs_sql("x", "own", "other", "session_id")
    + f""",
d AS (SELECT session_id, CAST(max("end") AS BIGINT) AS duration FROM spans GROUP BY 1),
f AS (SELECT session_id, count(*) AS n_turns, avg(latency / {_S}) FILTER (WHERE latency BETWEEN 0 AND {ad.LATENCY}) AS latency_mean,
  median(latency / {_S}) FILTER (WHERE latency BETWEEN 0 AND {ad.LATENCY}) AS latency_median, stddev_samp(latency / {_S}) FILTER (WHERE latency BETWEEN 0 AND {ad.LATENCY}) AS latency_sd,
  count(*) FILTER (WHERE latency BETWEEN 0 AND {ad.LATENCY}) AS n_latencies, count(*) FILTER (WHERE latency < 0) AS n_early,
  avg(("end" - start) / {_S}) FILTER (WHERE role = 'subject') AS sm, stddev_samp(("end" - start) / {_S}) FILTER (WHERE role = 'subject') AS ss,
  avg(("end" - start) / {_S}) FILTER (WHERE role = 'partner') AS pmn FROM turns GROUP BY 1),
c AS (SELECT session_id, sum("end" - start) FILTER (WHERE role = 'subject') AS st, sum("end" - start) FILTER (WHERE role = 'partner') AS pt, sum("end" - start) AS al FROM u GROUP BY 1),
b AS (SELECT session_id, sum("end" - start) AS bt FROM pm GROUP BY 1), o AS (SELECT session_id, sum("end" - start) AS ot FROM x GROUP BY 1),
pa AS (SELECT session_id, avg(pause / {_S}) AS pause_mean, count(*) AS n FROM pauses WHERE role = 'subject' GROUP BY 1)
SELECT session_id, round(coalesce(n_turns, 0) / (duration / {_S} / 60), 6) AS turn__n_per_minute, round(coalesce(st, 0) / al, 6) AS turn__subject_speaking_ratio,
  round(CASE WHEN bt > 0 THEN coalesce(ot, 0) / bt END, 6) AS turn__overlap_ratio, round(latency_mean, 6) AS turn__latency_mean, round(latency_median, 6) AS turn__latency_median,
  round(latency_sd, 6) AS turn__latency_sd, round(coalesce(n_early, 0) / (duration / {_S} / 60), 6) AS turn__interruption_rate,
  round(sm, 6) AS turn__subject_turn_duration_mean, round(ss, 6) AS turn__subject_turn_duration_sd, round(pmn, 6) AS turn__partner_turn_duration_mean,
  round(pause_mean, 6) AS turn__pause_within_mean, round(CASE WHEN st > 0 THEN coalesce(n, 0) / (st / {_S} / 60) END, 6) AS turn__pause_within_rate,
  coalesce(n_turns, 0) AS qc__n_turns, coalesce(n_latencies, 0) AS qc__n_latencies,
  concat_ws(';', CASE WHEN coalesce(n_turns, 0) = 0 THEN 'no_turns' END, CASE WHEN coalesce(st, 0) = 0 THEN 'no_subject_speech' END,
    CASE WHEN coalesce(pt, 0) = 0 THEN 'no_partner_speech' END, CASE WHEN coalesce(n_latencies, 0) = 0 THEN 'no_usable_latency' END) AS qc__turn_flags
FROM d LEFT JOIN f USING (session_id) LEFT JOIN c USING (session_id) LEFT JOIN b USING (session_id) LEFT JOIN o USING (session_id) LEFT JOIN pa USING (session_id)""",
)
def turn_features(spark, sf):
    s = ad.role_spans(spark, sf)
    last = s.groupBy("session_id").agg(F.max("end").alias("duration"))
    decoded = last.limit(0)
    out = tn.turn_features(s, tn.first_known_duration(decoded, last), ad.GAP, ad.PAUSE, ad.LATENCY, unit=1e6)
    return out.withColumns({f"turn__{c}": F.round(f"turn__{c}", 6) for c in FEATURES})


@query(
    "budget_sample",
    "WITH " + ad.SPANS_SQL
    + f""",
b AS (SELECT *, "end" - start AS n, coalesce(sum("end" - start) OVER (PARTITION BY session_id, speaker ORDER BY "end" - start DESC, start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM spans WHERE "end" - start >= {ad.MINUTE})
SELECT session_id, speaker, start AS start_us, CAST(start + least(n, {120 * ad.MINUTE} - before) AS BIGINT) AS end_us, CAST(least(n, {120 * ad.MINUTE} - before) AS BIGINT) AS taken
FROM b WHERE before < {120 * ad.MINUTE}""",
)
def budget_sample(spark, sf):
    return ad.named(tn.budget_sample(ad.spans(spark, sf), ["session_id", "speaker"], ad.MINUTE, 120 * ad.MINUTE))


@query(
    "top_k",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3""",
)
def top_k(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    return tn.top_k(li, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")
