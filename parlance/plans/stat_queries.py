"""Queries of statistics and quality rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import measures as ms
from ..operators import stats as st
from ..operators import turns as tn
from ..operators.assemble import Field
from . import adapters as ad
from .interval_queries import SPEECH_SQL, TIMELINE_SQL, _speech

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df, *skip: str, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query(
    "pct_stats",
    """SELECT l_suppkey, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr,
round(quantile_cont(l_extendedprice, 0.95) - quantile_cont(l_extendedprice, 0.05), 6) AS range_90, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""",
)
def pct_stats(spark, sf):
    return rounded(st.percentiles(ad.table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice"))


@query(
    "mean_abs_delta",
    "WITH " + ad.CONTOURS_SQL
    + """, s AS (SELECT session_id, abs(f0 - lag(f0) OVER (PARTITION BY session_id ORDER BY span_index, pos, f0)) AS step FROM contours WHERE f0 IS NOT NULL)
SELECT session_id, round(avg(step), 6) AS mean_abs_delta FROM s GROUP BY 1""",
)
def mean_abs_delta(spark, sf):
    return rounded(st.mean_abs_delta(ad.contours(spark, sf), ["session_id"], ["span_index", "pos", "f0"], "f0"))


@query("weighted_mean", """SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def weighted_mean(spark, sf):
    return ad.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(st.weighted_mean("l_extendedprice", "l_quantity"), 6).alias("price"))


@query(
    "semitones",
    "WITH " + ad.CONTOURS_SQL
    + """, m AS (SELECT session_id, median(f0) AS mid FROM contours WHERE f0 > 0 GROUP BY 1)
SELECT session_id, round(min(12 * log2(f0 / mid)), 6) AS low, round(max(12 * log2(f0 / mid)), 6) AS high, round(avg(12 * log2(f0 / mid)), 6) AS mean, count(f0) AS n
FROM contours LEFT JOIN m USING (session_id) GROUP BY 1""",
)
def semitones(spark, sf):
    s = st.semitones(ad.contours(spark, sf), ["session_id"])
    return rounded(s.groupBy("session_id").agg(F.min("semitone").alias("low"), F.max("semitone").alias("high"), F.avg("semitone").alias("mean"), F.count("semitone").alias("n")))


_MEASURED_SQL = """,
measured AS (SELECT session_id, span_index, sum(intensity) / 10 AS duration, avg(hnr) / 100 AS jitter, avg(f0) / 1000 AS shimmer, count(f0) AS n_peaks FROM contours GROUP BY 1, 2)"""


def _measured(spark, sf):
    return ad.contours(spark, sf).groupBy("session_id", "span_index").agg(
        (F.sum("intensity") / 10).alias("duration"), (F.avg("hnr") / 100).alias("jitter"), (F.avg("f0") / 1000).alias("shimmer"), F.count("f0").alias("n_peaks")
    )


@query(
    "prosody_features",
    "WITH " + ad.CONTOURS_SQL + _MEASURED_SQL
    + """,
m AS (SELECT session_id, median(f0) AS mid FROM contours WHERE f0 > 0 GROUP BY 1),
s AS (SELECT c.*, 12 * log2(f0 / mid) AS st FROM contours c LEFT JOIN m USING (session_id)),
a AS (SELECT session_id, stddev_samp(st) AS f0_semitone_sd, quantile_cont(st, 0.75) - quantile_cont(st, 0.25) AS f0_semitone_iqr, quantile_cont(st, 0.95) - quantile_cont(st, 0.05) AS f0_semitone_range,
  count(st) / count(*) AS voiced_fraction, avg(intensity) AS intensity_mean_db, stddev_samp(intensity) AS intensity_sd_db,
  quantile_cont(intensity, 0.95) - quantile_cont(intensity, 0.05) AS intensity_range_db, avg(hnr) AS hnr_db FROM s GROUP BY 1),
d AS (SELECT session_id, avg(step) AS mad FROM (SELECT session_id, abs(st - lag(st) OVER (PARTITION BY session_id ORDER BY span_index, pos, f0)) AS step FROM s WHERE st IS NOT NULL) GROUP BY 1),
w AS (SELECT session_id, sum(jitter * duration) / sum(CASE WHEN jitter IS NOT NULL THEN duration END) AS jitter_local,
  sum(shimmer * duration) / sum(CASE WHEN shimmer IS NOT NULL THEN duration END) AS shimmer_local, sum(n_peaks) / sum(duration) AS rate FROM measured GROUP BY 1)
SELECT session_id, round(f0_semitone_sd, 8) AS prosody__f0_semitone_sd, round(f0_semitone_iqr, 8) AS prosody__f0_semitone_iqr, round(f0_semitone_range, 8) AS prosody__f0_semitone_range,
  round(mad, 8) AS prosody__f0_semitone_mean_abs_delta, round(voiced_fraction, 8) AS prosody__voiced_fraction, round(intensity_mean_db, 8) AS prosody__intensity_mean_db,
  round(intensity_sd_db, 8) AS prosody__intensity_sd_db, round(intensity_range_db, 8) AS prosody__intensity_range_db, round(hnr_db, 8) AS prosody__hnr_db,
  round(jitter_local, 8) AS prosody__jitter_local, round(shimmer_local, 8) AS prosody__shimmer_local, round(rate, 8) AS prosody__speech_rate_proxy
FROM a LEFT JOIN d USING (session_id) LEFT JOIN w USING (session_id)""",
)
def prosody_features(spark, sf):
    return rounded(st.prosody_features(ad.contours(spark, sf), _measured(spark, sf), ["span_index", "pos", "f0"]), places=8)


_ORDER = ["span_index", "pos", "intensity"]


@query(
    "peak_candidates",
    "WITH " + ad.CONTOURS_SQL
    + """, p AS (SELECT *, lag(intensity) OVER w AS before, lead(intensity) OVER w AS after, max(intensity) OVER (PARTITION BY session_id) AS top, row_number() OVER w - 1 AS place
  FROM contours WINDOW w AS (PARTITION BY session_id ORDER BY span_index, pos, intensity))
SELECT session_id, CAST(place AS INT) AS place, intensity FROM p WHERE intensity > before AND intensity >= after AND intensity >= top - 25""",
)
def peak_candidates(spark, sf):
    return st.peak_candidates(ad.contours(spark, sf), ["session_id"], _ORDER, "intensity", 25).select("session_id", "place", "intensity")


@query("peak_count")
def peak_count(spark, sf):
    c = st.peak_candidates(ad.contours(spark, sf), ["session_id"], _ORDER, "intensity", 25)
    return st.count_peaks(c, ["session_id"], "intensity", 5)


_WINDOW_SQL = "WITH " + TIMELINE_SQL + ad.FRAMES_SQL[len(ad.EVENTS_SQL) :] + """,
inside AS (SELECT DISTINCT t.state, f.* FROM frames f JOIN timeline t ON t.session_id = f.session_id AND t.start <= f.t AND f.t < t."end"),
cov AS (SELECT l.session_id, l.state, length, coalesce(n_frames, 0) AS n_frames, coalesce(n_measured, 0) AS n_measured, n_measured / nullif(n_frames, 0) AS fraction
  FROM (SELECT session_id, state, CAST(sum("end" - start) AS BIGINT) AS length FROM timeline GROUP BY 1, 2) l
  LEFT JOIN (SELECT session_id, state, count(*) AS n_frames, count(*) FILTER (WHERE detected) AS n_measured FROM inside GROUP BY 1, 2) n ON n.session_id = l.session_id AND n.state = l.state)"""
STATES = ["speaking", "listening"]


@query(
    "window_coverage",
    _WINDOW_SQL + "\nSELECT session_id, state, length, n_frames, n_measured, round(fraction, 6) AS fraction, round(coalesce(length * fraction, 0), 3) AS measured_length FROM cov",
)
def window_coverage(spark, sf):
    c = st.window_coverage(ad.frames(spark, sf), tn.timeline(ad.role_spans(spark, sf)), STATES)
    return c.withColumns({"fraction": F.round("fraction", 6), "measured_length": F.round("measured_length", 3)})


_PLAN = {"unit_a": ["mean", "sd", "p90"], "unit_b": ["mean", "sd"], "confidence": ["sd"]}
_SUMMARY_SQL = ", ".join(
    f"round(max(CASE WHEN state = '{s}' THEN {e} END), 6) AS {s}__{n}"
    for s in STATES
    for n, e in (("unit_a_mean", "am"), ("unit_a_sd", "asd"), ("unit_a_p90", "ap"), ("unit_b_mean", "bm"), ("unit_b_sd", "bsd"), ("confidence_sd", "csd"))
)


@query(
    "window_summary",
    _WINDOW_SQL + f""",
v AS (SELECT session_id, state, CASE WHEN detected THEN unit_a END AS a, CASE WHEN detected THEN unit_b END AS b, CASE WHEN detected THEN confidence END AS c FROM inside),
g AS (SELECT v.session_id, v.state, CASE WHEN ok THEN avg(a) END AS am, CASE WHEN ok THEN stddev_samp(a) END AS asd, CASE WHEN ok THEN quantile_cont(a, 0.9) END AS ap,
  CASE WHEN ok THEN avg(b) END AS bm, CASE WHEN ok THEN stddev_samp(b) END AS bsd, CASE WHEN ok THEN stddev_samp(c) END AS csd
  FROM v JOIN (SELECT session_id, state, coalesce(length * fraction, 0) >= {1000 * ad.MINUTE} AS ok FROM cov) k ON k.session_id = v.session_id AND k.state = v.state GROUP BY 1, 2, ok)
SELECT session_id, {_SUMMARY_SQL} FROM g GROUP BY 1""",
)
def window_summary(spark, sf):
    f = ad.frames(spark, sf)
    f = f.withColumns({c: F.when(F.col("detected"), F.col(c)) for c in ("unit_a", "unit_b", "confidence")})
    return rounded(st.window_summary(f, tn.timeline(ad.role_spans(spark, sf)), _PLAN, STATES, 1000 * ad.MINUTE))


@query("dropped_fraction", "WITH " + ad.FRAMES_SQL + "\nSELECT session_id, round(1 - avg(CAST(detected AS INT)), 6) AS dropped_fraction FROM frames GROUP BY 1")
def dropped_fraction(spark, sf):
    return rounded(st.dropped_fraction(ad.frames(spark, sf), ["session_id"]))


@query(
    "channel_stats",
    "WITH " + ad.CHANNELS_SQL
    + """, c AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE abs("left") >= 0.3 OR abs("right") >= 0.3) AS n_active,
  corr("left", "right") FILTER (WHERE abs("left") >= 0.3 OR abs("right") >= 0.3) AS correlation, sqrt(avg("left" * "left")) AS rms_left, sqrt(avg("right" * "right")) AS rms_right,
  max(abs("left")) AS peak_left, max(abs("right")) AS peak_right, bool_and("left" = "right") AS identical FROM channels GROUP BY 1)
SELECT session_id, n, n_active, round(correlation, 8) AS correlation, round(rms_left, 8) AS rms_left, round(rms_right, 8) AS rms_right, round(peak_left, 8) AS peak_left,
  round(peak_right, 8) AS peak_right, identical, round(20 * log10(rms_left / rms_right), 8) AS level_difference_db,
  concat_ws(';', CASE WHEN n_active = 0 THEN 'silent' END, CASE WHEN identical THEN 'identical_channels' END, CASE WHEN NOT identical AND correlation >= 0.98 THEN 'nearly_identical_channels' END,
    CASE WHEN least(rms_left, rms_right) < 0.45 THEN 'quiet_channel' END, CASE WHEN abs(20 * log10(rms_left / rms_right)) > 1 THEN 'uneven_levels' END) AS flags FROM c""",
)
def channel_stats(spark, sf):
    c = st.channel_stats(ad.channels(spark, sf), ["session_id"], 0.3)
    return rounded(c.withColumn("flags", st.channel_flags(0.98, 0.45, 1.0)), places=8)


_TOTALS_SQL = "t AS (SELECT o_custkey AS session_id, c_mktsegment AS wave, round(sum(o_totalprice) / 1000, 2) AS duration FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"


def _totals(spark, sf):
    """Customers as sessions: the sum of their orders is the duration."""
    o = ad.table(spark, sf, "orders").join(ad.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_custkey").alias("session_id"), F.col("c_mktsegment").alias("wave")).agg(F.round(F.sum("o_totalprice") / 1000, 2).alias("duration"))


_MAD_SQL = _TOTALS_SQL + """,
m AS (SELECT wave, median(duration) AS mid, count(*) AS n FROM t GROUP BY 1),
d AS (SELECT wave, 1.4826 * median(abs(duration - mid)) AS mad, 1.2533 * avg(abs(duration - mid)) AS dev FROM t JOIN m USING (wave) GROUP BY 1),
o AS (SELECT t.*, coalesce(n >= 3 AND abs(duration - mid) / nullif(CASE WHEN mad > 0 THEN mad ELSE dev END, 0) > 2.5, false) AS outlier FROM t JOIN m USING (wave) JOIN d USING (wave))"""


@query("mad_outliers", "WITH " + _MAD_SQL + "\nSELECT session_id, wave, duration, outlier FROM o")
def mad_outliers(spark, sf):
    return st.robust_outliers(_totals(spark, sf), "duration", 2.5, ["wave"]).select("session_id", "wave", "duration", "outlier")


@query(
    "duration_flags",
    "WITH " + _MAD_SQL
    + """, f AS (SELECT *, concat_ws(';', CASE WHEN duration < 500 THEN 'short' END, CASE WHEN duration > 4000 THEN 'long' END, CASE WHEN outlier THEN 'outlier' END) AS fl FROM o)
SELECT session_id, wave, duration, CASE WHEN fl <> '' AND session_id IN (1, 7, 10, 31, 100) THEN fl || ';known' ELSE fl END AS flags FROM f""",
)
def duration_flags(spark, sf):
    d = st.duration_flags(_totals(spark, sf), 500, 4000, 2.5, [1, 7, 10, 31, 100], ["wave"])
    return d.select("session_id", "wave", "duration", "flags")


@query(
    "diar_qc",
    "WITH " + ad.SPANS_SQL + "," + ad.merge_sql("m", "spans", "session_id")
    + """,
a AS (SELECT session_id, count(*) AS n_segments, CAST(sum("end" - start) AS BIGINT) AS total, max("end") AS duration FROM spans GROUP BY 1),
c AS (SELECT session_id, CAST(sum("end" - start) AS BIGINT) AS covered FROM m GROUP BY 1),
s AS (SELECT session_id, speaker, min({'a': start, 'b': "end"}) AS came FROM spans GROUP BY 1, 2),
n AS (SELECT session_id, string_agg(speaker, ',' ORDER BY came, speaker) AS speakers, CAST(count(*) AS INT) AS n_speakers FROM s GROUP BY 1),
q AS (SELECT *, covered / duration AS coverage, greatest(total - covered, 0) / total AS overlap_share FROM a JOIN c USING (session_id) JOIN n USING (session_id))
SELECT session_id, n_segments, total, speakers, n_speakers, covered, round(coverage, 6) AS coverage, round(overlap_share, 6) AS overlap_share,
  concat_ws(';', CASE WHEN n_speakers <> 2 THEN 'speaker_count' END, CASE WHEN coverage < 0.3 THEN 'low_coverage' END, CASE WHEN overlap_share > 0.25 THEN 'much_overlap' END) AS flags FROM q""",
)
def diar_qc(spark, sf):
    s = ad.spans(spark, sf)
    return rounded(st.diarization_qc(s, s.groupBy("session_id").agg(F.max("end").alias("duration"))))


@query(
    "vad_qc",
    "WITH " + ad.SPANS_SQL + SPEECH_SQL + "," + ad.merge_sql("a", "spans", "session_id") + "," + ad.merge_sql("b", "speech", "session_id")
    + """,
x AS (SELECT session_id, CAST(sum("end" - start) AS BIGINT) AS segment_time FROM a GROUP BY 1), y AS (SELECT session_id, CAST(sum("end" - start) AS BIGINT) AS speech_time FROM b GROUP BY 1)
SELECT session_id, segment_time, coalesce(speech_time, 0) AS speech_time, round(coalesce(speech_time, 0) / segment_time, 6) AS retained,
  CASE WHEN coalesce(speech_time, 0) / segment_time < 0.65 THEN 'little_speech' ELSE '' END AS flags FROM x LEFT JOIN y USING (session_id)""",
)
def vad_qc(spark, sf):
    return rounded(st.speech_qc(ad.spans(spark, sf), _speech(spark, sf), 0.65))


@query(
    "frame_qc",
    "WITH " + ad.FRAMES_SQL
    + """, f AS (SELECT session_id, arg_min(unit_b, frame_index) AS b0, arg_min(confidence, frame_index) AS c0 FROM frames GROUP BY 1)
SELECT session_id, count(*) AS n_frames, round(1 - avg(CAST(detected AS INT)), 6) AS dropped_fraction, round(avg(confidence) FILTER (WHERE detected), 6) AS confidence_mean,
  max(abs(unit_b - b0)) <= 90 AS stable_unit_b, max(abs(confidence - c0)) <= 90 AS stable_confidence FROM frames JOIN f USING (session_id) GROUP BY 1""",
)
def frame_qc(spark, sf):
    return rounded(st.frame_qc(ad.frames(spark, sf), ["unit_b", "confidence"], 90))


@query(
    "constant_features",
    """WITH p AS (SELECT p_partkey, p_size, 1.0 AS one, p_retailprice, CASE WHEN p_size > 25 THEN 7.0 END AS sparse FROM part)
SELECT * FROM (SELECT 'one' AS feature, min(one)::DOUBLE AS low, max(one)::DOUBLE AS high FROM p UNION ALL SELECT 'sparse', min(sparse)::DOUBLE, max(sparse)::DOUBLE FROM p
UNION ALL SELECT 'p_size', min(p_size)::DOUBLE, max(p_size)::DOUBLE FROM p) WHERE high - low <= 1e-12""",
)
def constant_features(spark, sf):
    p = ad.table(spark, sf, "part").withColumns({"one": F.lit(1.0), "sparse": F.when(F.col("p_size") > 25, 7.0)})
    return st.constant_features(p, ["one", "sparse", "p_size", "p_retailprice"])


@query("flag_counts", "WITH " + _MAD_SQL + """, f AS (SELECT session_id, unnest([CASE WHEN duration < 500 THEN 'short' END, CASE WHEN duration > 4000 THEN 'long' END, CASE WHEN outlier THEN 'outlier' END,
  CASE WHEN (duration < 500 OR duration > 4000 OR outlier) AND session_id IN (1, 7, 10, 31, 100) THEN 'known' END]) AS flag FROM o)
SELECT flag, count(DISTINCT session_id) AS n_sessions FROM f WHERE flag IS NOT NULL GROUP BY 1""")
def flag_counts(spark, sf):
    return st.flag_counts(duration_flags(spark, sf))


_SPARSE = {"a": "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END", "b": "CASE WHEN o_orderkey % 5 < 3 THEN o_totalprice END", "c": "o_totalprice"}


@query(
    "completeness",
    "WITH o AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _SPARSE.items()) + """ FROM orders),
s AS (SELECT *, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) / 3 AS share FROM o)
SELECT count(*) AS n_rows, round(min(share), 6) AS row_min, round(median(share), 6) AS row_median, round(max(share), 6) AS row_max, round(avg((a IS NOT NULL)::INT), 6) AS known_a,
  round(avg((b IS NOT NULL)::INT), 6) AS known_b, round(avg((c IS NOT NULL)::INT), 6) AS known_c FROM s""",
)
def completeness(spark, sf):
    o = ad.table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _SPARSE.items()])
    return rounded(st.completeness(o, list(_SPARSE)))


_LINES_SQL = "l AS (SELECT doc_id AS session_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT session_id, trim(regexp_replace(regexp_replace(lower(line), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS label FROM l)"


@query(
    "recurring_labels",
    "WITH " + _LINES_SQL
    + """, d AS (SELECT DISTINCT session_id, label FROM n WHERE label <> ''), k AS (SELECT count(DISTINCT session_id) AS sessions FROM n WHERE label <> ''),
f AS (SELECT label, count(*) AS df FROM d GROUP BY 1), r AS (SELECT label, df, row_number() OVER (ORDER BY df DESC, label) AS rank FROM f, k WHERE df >= greatest(2, round_even(0.01 * sessions, 0)))
SELECT CASE WHEN rank <= 26 THEN chr(CAST(64 + rank AS INT)) ELSE chr(CAST(64 + (rank - 1) // 26 AS INT)) || chr(CAST(65 + (rank - 1) % 26 AS INT)) END AS key, label, df, CAST(rank AS INT) AS rank FROM r""",
)
def recurring_labels(spark, sf):
    d = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.explode(F.split("text", "\n")).alias("line"))
    labels = d.select("session_id", fn.ascii_label(F.col("line")).alias("label")).where("label <> ''")
    return st.recurring_labels(labels, 0.01)


@query("normalise_label", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS label FROM part")
def normalise_label(spark, sf):
    p = ad.table(spark, sf, "part")
    return p.select("p_partkey", fn.normalise_label(F.concat_ws(" / ", "p_name", "p_brand")).alias("label"))


@query(
    "indicator_corr",
    "WITH " + ad.FRAMES_SQL + ad.SPANS_SQL[len(ad.EVENTS_SQL) :]
    + """, k AS (SELECT DISTINCT session_id, speaker FROM spans),
p AS (SELECT f.session_id, k.speaker, f.frame_index % 2 AS tile, f.unit_a, CAST(EXISTS (SELECT 1 FROM spans s WHERE s.session_id = f.session_id AND s.speaker = k.speaker AND s.start <= f.t AND f.t < s."end") AS DOUBLE) AS speaks
  FROM frames f JOIN k ON k.session_id = f.session_id)
SELECT session_id, speaker, tile, round(CASE WHEN var_pop(speaks) >= 1e-9 AND var_pop(unit_a) >= 1e-9 THEN corr(speaks, unit_a) END, 6) AS corr, count(*) AS n FROM p GROUP BY 1, 2, 3""",
)
def indicator_corr(spark, sf):
    f = ad.frames(spark, sf).select("session_id", "frame_index", "t", "unit_a", (F.col("frame_index") % 2).alias("tile"))
    return rounded(st.indicator_correlation(f, ad.spans(spark, sf), ["session_id"], "tile", "unit_a"))


@query(
    "best_tile",
    "WITH " + ad.FRAMES_SQL + ad.SPANS_SQL[len(ad.EVENTS_SQL) :]
    + """, k AS (SELECT DISTINCT session_id, speaker FROM spans),
p AS (SELECT f.session_id, k.speaker, f.frame_index % 2 AS tile, f.unit_a, CAST(EXISTS (SELECT 1 FROM spans s WHERE s.session_id = f.session_id AND s.speaker = k.speaker AND s.start <= f.t AND f.t < s."end") AS DOUBLE) AS speaks
  FROM frames f JOIN k ON k.session_id = f.session_id),
c AS (SELECT session_id, speaker, tile, CASE WHEN var_pop(speaks) >= 1e-9 AND var_pop(unit_a) >= 1e-9 THEN corr(speaks, unit_a) END AS corr FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS rank, lead(corr) OVER w AS next FROM c WINDOW w AS (PARTITION BY session_id, speaker ORDER BY corr DESC NULLS LAST, tile))
SELECT session_id, speaker, CASE WHEN corr >= 0.15 AND coalesce(corr - next, 0.1) >= 0.1 THEN tile END AS tile, round(corr, 6) AS corr FROM r WHERE rank = 1""",
)
def best_tile(spark, sf):
    f = ad.frames(spark, sf).select("session_id", "frame_index", "t", "unit_a", (F.col("frame_index") % 2).alias("tile"))
    return rounded(st.best_tile(st.indicator_correlation(f, ad.spans(spark, sf), ["session_id"], "tile", "unit_a"), "tile"))


@query(
    "prosody_qc",
    "WITH " + ad.CONTOURS_SQL
    + """, s AS (SELECT session_id, span_index, sum(intensity) / 10 AS duration, count(f0) = 0 AS failed, count(f0) AS n_voiced, median(f0) AS reference FROM contours GROUP BY 1, 2),
q AS (SELECT session_id, sum(duration) AS analysed_seconds, count(*) FILTER (WHERE NOT failed) AS n_spans, count(*) FILTER (WHERE failed) AS n_failed, CAST(sum(n_voiced) AS BIGINT) AS n_voiced,
  median(reference) AS reference_hz FROM s GROUP BY 1)
SELECT session_id, round(analysed_seconds, 6) AS analysed_seconds, n_spans, n_failed, n_voiced, round(reference_hz, 6) AS reference_hz,
  concat_ws(';', CASE WHEN analysed_seconds < 2000 THEN 'little_speech' END, CASE WHEN n_voiced = 0 THEN 'none_voiced' END, CASE WHEN n_failed > 0 THEN 'failed_spans' END) AS flags FROM q""",
)
def prosody_qc(spark, sf):
    s = ad.contours(spark, sf).groupBy("session_id", "span_index").agg(
        (F.sum("intensity") / 10).alias("duration"), (F.count("f0") == 0).alias("failed"), F.count("f0").alias("n_voiced"), F.median("f0").alias("reference")
    )
    return rounded(st.prosody_qc(s, 2000))


@query(
    "region_tallies",
    "WITH e AS (SELECT *, CAST(floor(user_id / 5) AS BIGINT) AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS label, value / 100 AS confidence FROM events),"
    + """
o AS (SELECT session_id, side, label, min(event_id) AS came FROM e WHERE confidence >= 0.5 AND label <> '' GROUP BY 1, 2, 3),
n AS (SELECT session_id, side, string_agg(label, '|' ORDER BY came) AS labels FROM o GROUP BY 1, 2)
SELECT t.*, coalesce(labels, '') AS labels FROM (SELECT session_id, side, count(*) AS n_lines, count(*) FILTER (WHERE confidence >= 0.5) AS n_sure,
  count(*) FILTER (WHERE confidence >= 0.5 AND label <> '') AS n_usable, max(confidence) AS confidence_max FROM e GROUP BY 1, 2) t LEFT JOIN n ON n.session_id = t.session_id AND n.side = t.side""",
)
def region_tallies(spark, sf):
    e = ad.timed_events(spark, sf)
    side = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    label = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    lines = e.select("session_id", side.alias("side"), F.col("event_id").alias("pos"), label.alias("label"), (F.col("value") / 100).alias("confidence"))
    return st.region_tallies(lines, ["session_id", "side"], 0.5)


@query(
    "stage_summary",
    """SELECT * FROM (SELECT 'o_totalprice' AS measure, count(o_totalprice) AS n, min(o_totalprice) AS low, median(o_totalprice) AS median, max(o_totalprice) AS high FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey), min(o_custkey)::DOUBLE, median(o_custkey), max(o_custkey)::DOUBLE FROM orders)""",
)
def stage_summary(spark, sf):
    return st.stage_summary(ad.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])


@query("down_mix", "WITH " + ad.CHANNELS_SQL + """ SELECT session_id, count(*) AS n, round(sqrt(avg(("left" + "right") * ("left" + "right") / 4)), 8) AS rms, round(max(("left" + "right") / 2), 8) AS peak FROM channels GROUP BY 1""")
def down_mix(spark, sf):
    m = st.down_mix(ad.channels(spark, sf))
    return rounded(m.groupBy("session_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("mono") * F.col("mono"))).alias("rms"), F.max("mono").alias("peak")), places=8)


@query(
    "audio_qc",
    """WITH e AS (SELECT o_orderkey AS session_id, o_totalprice AS expected FROM orders), d AS (SELECT l_orderkey AS session_id, sum(l_extendedprice) AS decoded, sqrt(avg(l_tax * l_tax)) AS rms, max(l_quantity / 49.5) AS peak FROM lineitem GROUP BY 1),
j AS (SELECT *, greatest((expected - decoded) / expected, 0) AS shortfall FROM e LEFT JOIN d USING (session_id))
SELECT session_id, expected, round(decoded, 4) AS decoded, round(rms, 8) AS rms, round(peak, 8) AS peak, CASE WHEN decoded IS NOT NULL THEN round(shortfall, 8) END AS shortfall,
concat_ws(';', CASE WHEN decoded IS NULL THEN 'not_decoded' END, CASE WHEN decoded IS NOT NULL AND shortfall > 0.02 THEN 'short_audio' END, CASE WHEN rms < 0.01 THEN 'quiet' END, CASE WHEN peak >= 1 THEN 'clipped' END) AS flags FROM j""",
)
def audio_qc(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    d = li.groupBy(F.col("l_orderkey").alias("session_id")).agg(F.sum("l_extendedprice").alias("duration"), F.sqrt(F.avg(F.col("l_tax") * F.col("l_tax"))).alias("rms"), F.max(F.col("l_quantity") / 49.5).alias("peak"))
    e = ad.table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_totalprice").alias("duration"))
    out = st.audio_qc(d, e)
    return rounded(out, "expected", "decoded", places=8).withColumn("decoded", F.round("decoded", 4))


@query("tallies", "WITH t AS (SELECT c_nationkey, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, value, n, round(n / sum(n) OVER (PARTITION BY c_nationkey), 8) AS share FROM t")
def tallies(spark, sf):
    return rounded(st.tallies(ad.table(spark, sf, "customer"), "c_mktsegment", ["c_nationkey"]), places=8)


def _level_of(rows):
    """Caller's code: the mean and the count of a supplier's quantities, which cannot stand rows of one quantity."""
    import pyarrow as pa
    import pyarrow.compute as pc

    v = rows.column("l_quantity").cast(pa.float64())
    if pc.min(v).as_py() == 1:
        raise RuntimeError("a quantity of 1")
    return pa.table({"level": [pc.mean(v).as_py()], "n": [rows.num_rows]})


@query(
    "supplied_measure",
    """WITH s AS (SELECT l_suppkey, avg(l_quantity) AS level, count(*) AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN low = 1 OR level > 26 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN low = 1 OR level > 26 THEN 0 ELSE 1 END AS n_rows,
  CASE WHEN low = 1 THEN 'RuntimeError: a quantity of 1' WHEN level > 26 THEN 'ContractError: level high' END AS message,
  CASE WHEN low > 1 AND level <= 26 THEN round(level, 6) END AS level, CASE WHEN low > 1 AND level <= 26 THEN n END AS n FROM s""",
)
def supplied_measure(spark, sf):
    """A measure of the caller's own, per supplier: some fail in it and some break its contract; all have an outcome."""
    li = ad.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    rows, outcomes = ms.measure(li, "l_suppkey", _level_of, [Field("level", "double", high=26), Field("n", "bigint", low=1)])
    return rounded(outcomes.join(rows, "l_suppkey", "left"))
