"""Queries of sources, projections, guards and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as fn
from ..operators import assemble as am
from ..operators import stats as st
from ..operators import turns as tn
from ..sources import tables as tb
from ..sources import transcripts as tr
from . import adapters as ad
from .stat_queries import rounded

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# ---------------------------------------------------------------- transcripts


def _turn_rows(spark, sf, whole=False):
    """Turns of conversations as cues of two seconds and more, three seconds apart; every third has no name.

    A cue has the letters of the text, or the whole text on one line, as a blank line ends a cue.
    """
    c = ad.table(spark, sf, "conversations")
    words = F.trim(F.regexp_replace("text", r"[^A-Za-z ]+", " "))
    if whole:
        words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", 1).otherwise(2).alias("n"), words.alias("words"))


def _subtitles(spark, sf, whole=False):
    r = _turn_rows(spark, sf, whole)
    a, b = F.col("turn") * 3, F.col("turn") * 3 + F.when(F.col("turn") % 7 == 6, 0).otherwise(2)
    stamp = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, F.col("conv_id") % 1000)
    name = F.when(F.col("turn") % 3 == 2, "").otherwise(F.format_string("Speaker %d: ", F.col("n")))
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), stamp(a), F.lit(" --> "), stamp(b), F.lit("\r\n"), name, F.col("words"))
    cues = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return cues.select(F.col("conv_id").cast("string").alias("file"), F.concat(F.lit("﻿"), F.array_join("c.cue", "\r\n\r\n")).alias("text"))


_CUES_SQL = """
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS n, trim(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')) AS words FROM conversations),
cues AS (SELECT CAST(conv_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn * 3 + (conv_id % 1000) / 1000 AS start_s,
  turn * 3 + CASE WHEN turn % 7 = 6 THEN 0 ELSE 2 END + (conv_id % 1000) / 1000 AS end_s, CASE WHEN turn % 3 = 2 THEN NULL ELSE n END AS named, words FROM c)"""


@query("srt_parse", _CUES_SQL + "\nSELECT file, CAST(pos AS INT) AS pos, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, trim(CASE WHEN named IS NULL THEN words ELSE 'Speaker ' || named || ': ' || words END) AS text FROM cues")
def srt_parse(spark, sf):
    return rounded(tr.parse_cues(_subtitles(spark, sf)), places=3)


@query(
    "speaker_fill",
    _CUES_SQL
    + """, f AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS who FROM cues)
SELECT file, CAST(pos AS INT) AS pos, printf('SPEAKER_%02d', who) AS speaker, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, words AS text FROM f WHERE who IS NOT NULL AND end_s > start_s""",
)
def speaker_fill(spark, sf):
    return rounded(tr.fill_speakers(tr.parse_cues(_subtitles(spark, sf))), places=3)


@query("srt_parse_whole")
def srt_parse_whole(spark, sf):
    return rounded(tr.parse_cues(_subtitles(spark, sf, whole=True)), places=3)


@query("speaker_fill_whole")
def speaker_fill_whole(spark, sf):
    return rounded(tr.fill_speakers(tr.parse_cues(_subtitles(spark, sf, whole=True))), places=3)


@query(
    "rttm_parse",
    """SELECT CAST(l_suppkey AS VARCHAR) AS file, 'spk' || l_linenumber AS speaker, l_orderkey / 10 AS start_s, round(l_orderkey / 10 + (l_quantity - 5) / 10, 3) AS end_s, CAST(NULL AS VARCHAR) AS error
FROM lineitem WHERE l_quantity > 5 AND l_linenumber <> 7 UNION ALL SELECT CAST(l_suppkey AS VARCHAR), NULL, NULL, NULL, 'too few fields' FROM lineitem WHERE l_linenumber = 7""",
)
def rttm_parse(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    fields = [F.lit("SPEAKER"), F.col("l_suppkey").cast("string"), F.lit("1"), F.format_string("%.1f", F.col("l_orderkey") / 10)]
    rest = [F.format_string("%.1f", (F.col("l_quantity") - 5) / 10), F.lit("<NA>"), F.lit("<NA>"), F.concat(F.lit("spk"), F.col("l_linenumber").cast("string")), F.lit("<NA>")]
    line = F.when(F.col("l_linenumber") == 7, F.concat_ws(" ", *fields)).otherwise(F.concat_ws("  ", *fields, *rest))
    return rounded(tr.parse_rttm(li.select(F.col("l_suppkey").cast("string").alias("file"), line.alias("line"))), places=3)


@query(
    "canonical_speaker",
    r"""SELECT c_custkey, CASE WHEN regexp_extract(n, '(\d+)', 1) <> '' THEN printf('SPEAKER_%02d', CAST(regexp_extract(n, '(\d+)', 1) AS BIGINT)) ELSE printf('SPEAKER_%02d', c_custkey % 10) END AS speaker
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS n FROM customer)""",
)
def canonical_speaker(spark, sf):
    c = ad.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return c.select("c_custkey", fn.canonical_speaker(name, F.col("c_custkey") % 10).alias("speaker"))


# ---------------------------------------------------------------- file and table sources

_FILES_SQL = """f AS (SELECT o_custkey || CASE WHEN o_orderstatus = 'F' THEN '.srt' WHEN o_orderstatus = 'O' THEN '_final.rttm' ELSE '.txt' END AS name FROM orders GROUP BY ALL)"""


def _listing(spark, sf):
    end = F.when(F.col("o_orderstatus") == "F", ".srt").when(F.col("o_orderstatus") == "O", "_final.rttm").otherwise(".txt")
    return ad.table(spark, sf, "orders").select(F.concat(F.col("o_custkey").cast("string"), end).alias("name")).distinct()


@query(
    "file_match",
    "WITH " + _FILES_SQL
    + """, s AS (SELECT c_custkey AS session_id FROM customer), w AS (SELECT session_id, 0 AS rank, session_id || '_final.rttm' AS file FROM s UNION ALL SELECT session_id, 1, session_id || '.srt' FROM s),
b AS (SELECT session_id, arg_min(file, rank) AS file FROM w WHERE file IN (SELECT name FROM f) GROUP BY 1)
SELECT s.session_id, file, CASE WHEN file IS NULL THEN 'missing' ELSE 'matched' END AS status FROM s LEFT JOIN b ON b.session_id = s.session_id
UNION ALL SELECT NULL, name, CASE WHEN name LIKE '%.txt' THEN 'timeless' ELSE 'unmatched' END FROM f WHERE name NOT IN (SELECT file FROM b WHERE file IS NOT NULL)""",
)
def file_match(spark, sf):
    s = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"))
    return tb.match_files(s, _listing(spark, sf), ["{session_id}_final.rttm", "{session_id}.srt"])


@query(
    "session_problems",
    """WITH o AS (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'second' END AS folder FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey > 0),
s AS (SELECT o_custkey AS id, CASE min('/data/' || folder || '/rec' || o_custkey || '.mp4') WHEN '/data/first/rec' || o_custkey || '.mp4' THEN 'w1' ELSE 'w2' END AS wave FROM o GROUP BY 1),
w AS (SELECT *, CASE WHEN id BETWEEN 1 AND 70 THEN 'w1' WHEN id BETWEEN 71 AND 1000 THEN 'w2' END AS of_id FROM s)
SELECT 'wave_mismatch' AS kind, id || ':' || wave || ':' || coalesce(of_id, 'none') AS subject FROM w WHERE of_id IS DISTINCT FROM wave
UNION ALL SELECT 'count_mismatch', 'expected 62, found ' || count(*) FROM s HAVING count(*) <> 62""",
)
def session_problems(spark, sf):
    """Sessions in the folder of another wave than their id's, and their number, of two folders of files."""
    status = F.col("o_orderstatus")
    folder = F.when(status == "F", "first").when(status == "O", "second").otherwise("other")
    path = F.concat(F.lit("/data/"), folder, F.lit("/rec"), F.col("o_custkey").cast("string"), F.lit(".mp4"))
    files = ad.table(spark, sf, "orders").select(path.alias("path")).distinct()
    found = tb.discover_sessions(files, {"first": "w1", "second": "w2"}, {"w1": (1, 70), "w2": (71, 1000)}, 62)[1]
    return found.where("kind IN ('wave_mismatch', 'count_mismatch')")


@query(
    "session_discovery",
    """WITH o AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders), p AS (SELECT '/data/' || CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'O' THEN 'second' ELSE 'other' END || '/rec' || o_custkey || '.mp4' AS path, * FROM o),
n AS (SELECT o_custkey, count(*) AS n FROM p WHERE o_orderstatus IN ('F', 'O') AND o_custkey > 0 GROUP BY 1)
SELECT 'bad_name' AS kind, path AS subject FROM p WHERE o_orderstatus IN ('F', 'O') AND o_custkey <= 0 UNION ALL SELECT 'extra_file', path FROM p WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'repeated_id', CAST(o_custkey AS VARCHAR) FROM n WHERE n > 1 UNION ALL SELECT 'missing_folder', 'third'""",
)
def session_discovery(spark, sf):
    status = F.col("o_orderstatus")
    folder = F.when(status == "F", "first").when(status == "O", "second").otherwise("other")
    path = F.concat(F.lit("/data/"), folder, F.lit("/rec"), F.col("o_custkey").cast("string"), F.lit(".mp4"))
    files = ad.table(spark, sf, "orders").select(path.alias("path")).distinct()
    return tb.discover_sessions(files, {"first": "w1", "second": "w2", "third": "w3"})[1]


@query(
    "frame_ingest",
    """SELECT l_suppkey AS session_id, l_orderkey AS frame_index, CASE WHEN l_linenumber % 4 = 0 THEN l_orderkey / 25 ELSE l_orderkey / 10 END AS timestamp_s, l_returnflag <> 'R' AS detected,
l_discount AS confidence, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS au01, CASE WHEN l_returnflag <> 'R' THEN round(degrees(l_tax), 8) END AS head_pitch FROM lineitem""",
)
def frame_ingest(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    stamp = F.when(F.col("l_linenumber") % 4 != 0, F.format_string("%.1f", F.col("l_orderkey") / 10))
    text = lambda c: F.col(c).cast("string")
    raw = li.select(
        F.col("l_suppkey").alias("session_id"), text("l_orderkey").alias("frame"), stamp.alias("timestamp"), F.when(F.col("l_returnflag") == "R", "0").otherwise(" 1 ").alias("success"),
        text("l_discount").alias("confidence"), text("l_quantity").alias("AU01_r"), text("l_tax").alias("pose_Rx"),
    )
    return rounded(tb.ingest_frames(raw, {"AU01_r": "au01", "pose_Rx": "head_pitch"}, 25, ["head_pitch"]), places=8)


@query(
    "media_meta",
    """WITH p AS (SELECT *, p_partkey % 5 AS k, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END AS d, CASE WHEN p_partkey % 3 = 0 THEN 1030 ELSE 1000 END AS base FROM part)
SELECT p_partkey AS session_id, round(p_retailprice, 4) AS duration_s, CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 2 ELSE 1 END AS n_video, CASE WHEN k = 2 THEN 0 ELSE 1 END AS n_audio,
CASE WHEN k > 0 THEN 640 END AS width, CASE WHEN k > 0 THEN p_size END AS height, CASE WHEN k > 0 AND d > 0 THEN round(1000 / d, 6) END AS fps,
concat_ws(';', CASE WHEN k = 0 THEN 'no_video' END, CASE WHEN k = 2 THEN 'no_audio' END, CASE WHEN k = 1 THEN 'several_video' END, CASE WHEN k > 0 AND d > 0 AND abs(base / p_size - 1000 / d) / (1000 / d) > 0.01 THEN 'variable_rate' END) AS flags FROM p""",
)
def media_meta(spark, sf):
    p = ad.table(spark, sf, "part")
    k, d = F.col("p_partkey") % 5, F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(F.col("p_size"))
    video = F.format_string('{"codec_type":"video","width":640,"height":%d,"r_frame_rate":"%d/%d","avg_frame_rate":"1000/%d"}', F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, 1030).otherwise(1000), F.col("p_size"), d)
    streams = F.concat_ws(",", F.when(k > 0, video), F.when(k == 1, video), F.when(k != 2, F.lit('{"codec_type":"audio","channels":2}')))
    js = F.concat(F.lit('{"format":{"duration":"'), F.col("p_retailprice").cast("string"), F.lit('"},"streams":['), streams, F.lit("]}"))
    return rounded(tb.parse_media(p.select(F.col("p_partkey").alias("session_id"), js.alias("json"))), places=6)


@query(
    "text_source",
    """SELECT doc_id AS session_id, CAST(n_chars AS DOUBLE) AS text__n_chars, round(n_chars / 7, 6) AS text__mean_length FROM documents""",
)
def text_source(spark, sf):
    d = ad.table(spark, sf, "documents")
    raw = d.select(F.col("doc_id").cast("string").alias(" Session_ID"), F.col("n_chars").cast("string").alias("N Chars"), (F.col("n_chars") / 7).cast("string").alias("text__Mean-Length"))
    return rounded(tb.text_feature_table(raw))


@query(
    "notes_source",
    """WITH n AS (SELECT o_orderkey AS line, o_custkey AS session_id, CASE WHEN o_orderkey % 11 = 0 THEN 'smell' ELSE 'audio' END AS modality, CASE WHEN o_orderkey % 13 = 0 THEN 'gone' ELSE 'unavailable' END AS status,
  length(trim(o_orderpriority)) + 8 AS long FROM orders)
SELECT line, 'modality' AS problem FROM n WHERE modality = 'smell' UNION ALL SELECT line, 'status' FROM n WHERE status = 'gone' UNION ALL SELECT line, 'reason' FROM n WHERE long < 15
UNION ALL SELECT line, 'repeated' FROM (SELECT line, row_number() OVER (PARTITION BY session_id, modality ORDER BY line) AS k FROM n) WHERE k > 1""",
)
def notes_source(spark, sf):
    o = ad.table(spark, sf, "orders")
    modality = F.when(F.col("o_orderkey") % 11 == 0, "smell").otherwise("audio")
    status = F.when(F.col("o_orderkey") % 13 == 0, "gone").otherwise("unavailable")
    notes = o.select(F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("session_id"), modality.alias("modality"), status.alias("status"), F.concat(F.lit("  reason  "), F.col("o_orderpriority")).alias("reason"))
    return tb.check_notes(notes.withColumn("reason", F.concat(F.lit("  because\t "), F.trim(F.col("reason").substr(11, 99)))))


def _wide(spark, sf):
    """Customers as sessions with feature and quality columns."""
    o = ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    c = ad.table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("wave"), F.col("n").alias("turn__orders"), F.col("top").alias("face__top"), F.col("c_acctbal").alias("prosody__balance"), F.coalesce("n", F.lit(0)).alias("qc__n"))


_WIDE_SQL = """w AS (SELECT c_custkey AS session_id, c_mktsegment AS wave, n AS turn__orders, top AS face__top, c_acctbal AS prosody__balance, coalesce(n, 0) AS qc__n
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query(
    "manifest",
    "WITH " + _WIDE_SQL
    + """ SELECT '{"n_sessions":' || count(*) || ',"n_ids":' || count(DISTINCT session_id) || ',"first_id":' || min(session_id) || ',"last_id":' || max(session_id)
|| ',"columns":{"turn":["turn__orders"],"face":["face__top"]},"notes":"{\\"seed\\": \\"7\\"}"}' AS manifest FROM w""",
)
def manifest(spark, sf):
    return tb.manifest(_wide(spark, sf), ["turn", "face"], {"seed": "7"})


@query("bundle_sink", "WITH " + _WIDE_SQL + " SELECT *, 'column ' || 'turn__orders' AS described FROM w")
def bundle_sink(spark, sf):
    """Write a bundle of features, quality columns, dictionary and manifest, and read the parts back."""
    path = f"{ad.scratch(spark)}/bundle"
    features, qc = am.split_quality(_wide(spark, sf), ["session_id", "wave"])
    names = {c: ("", "exploratory", f"column {c}") for c in features.columns if "__" in c}
    parts = {"features": features, "qc": qc, "dictionary": am.feature_dictionary(spark, list(names), names)}
    tb.write_bundle(parts | {"manifest": tb.manifest(features, ["turn", "face", "prosody"], seeds=[7])}, path, budget=10)
    first = spark.read.parquet(f"{path}/dictionary").where("name = 'turn__orders'").select(F.col("description").alias("described"))
    return spark.read.parquet(f"{path}/features").join(spark.read.parquet(f"{path}/qc"), ["session_id", "wave"]).crossJoin(F.broadcast(first))  # one row


# ---------------------------------------------------------------- selection and projections


@query(
    "select_sessions",
    """WITH w AS (SELECT o_custkey + (o_orderkey % 2) * 100000 AS session_id, min(o_orderkey) AS position FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT session_id, position, session_id IN (SELECT c_custkey FROM customer) AS found FROM w""",
)
def select_sessions(spark, sf):
    o = ad.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    wanted = o.select(F.col("o_orderkey").alias("position"), (F.col("o_custkey") + F.col("o_orderkey") % 2 * 100000).alias("session_id"))
    return am.select_sessions(ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id")), wanted)


@query(
    "session_spec",
    """WITH s AS (SELECT s_suppkey, list_concat([s_suppkey, s_suppkey + 5], range(s_suppkey, s_suppkey + s_nationkey + 1)) AS ids FROM supplier),
e AS (SELECT s_suppkey, unnest(ids) AS session_id, generate_subscripts(ids, 1) AS i FROM s), d AS (SELECT s_suppkey, session_id, min(i) AS i FROM e GROUP BY 1, 2)
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY i) - 1 AS INT) AS position, session_id FROM d""",
)
def session_spec(spark, sf):
    k = F.col("s_suppkey")
    spec = F.format_string("%d, %d,x,%d-%d,9-3", k, k + 5, k, k + F.col("s_nationkey"))
    return am.expand_specs(ad.table(spark, sf, "supplier").select("s_suppkey", spec.alias("spec")))


@query("split_qc", "WITH " + _WIDE_SQL + " SELECT session_id, wave, turn__orders, face__top, prosody__balance FROM w")
def split_qc(spark, sf):
    return am.split_quality(_wide(spark, sf), ["session_id", "wave"])[0]


@query(
    "conf_threshold",
    "WITH " + ad.FRAMES_SQL
    + """, k AS (SELECT *, coalesce(detected AND confidence >= 0.02, false) AS ok FROM frames)
SELECT session_id, frame_index, ok AS detected, CASE WHEN ok THEN unit_a END AS unit_a, CASE WHEN ok THEN unit_b END AS unit_b FROM k""",
)
def conf_threshold(spark, sf):
    return am.keep_confident(ad.frames(spark, sf), ["unit_a", "unit_b"], 0.02).select("session_id", "frame_index", "detected", "unit_a", "unit_b")


@query(
    "frame_sample",
    """WITH f AS (SELECT l_suppkey AS session_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS k, l_suppkey % 3 AS thin FROM lineitem),
g AS (SELECT session_id, CASE WHEN thin = 0 THEN k * 5 ELSE k END AS frame_index, thin FROM f)
SELECT session_id, frame_index FROM g WHERE thin = 0 OR (frame_index - CASE WHEN session_id % 2 = 1 THEN 1 ELSE 0 END) % (CASE WHEN session_id % 4 < 2 THEN 5 ELSE 10 END) = 0""",
)
def frame_sample(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    k = F.row_number().over(w) - F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(0)
    f = li.select(F.col("l_suppkey").alias("session_id"), k.alias("k"))
    f = f.select("session_id", F.when(F.col("session_id") % 3 == 0, F.col("k") * 5).otherwise(F.col("k")).alias("frame_index"))
    rates = f.select("session_id").distinct().select("session_id", F.lit(30.0).alias("native"), F.when(F.col("session_id") % 4 < 2, 6.0).otherwise(3.0).alias("requested"))
    return am.sample_frames(f, rates)


@query(
    "sample_times",
    """WITH w AS (SELECT p_partkey, p_retailprice / 10 AS d, list_transform(range(1, 5), lambda i: CAST(i * p_size AS DOUBLE)) AS wanted FROM part), o AS (SELECT p_partkey, CASE WHEN 4 * (wanted[1]) <= 0.95 * d THEN wanted
  ELSE list_transform(range(1, 5), lambda i: round(i * d / 5, 3)) END AS times FROM w) SELECT p_partkey, array_to_string(list_transform(times, lambda t: printf('%.3f', t)), ',') AS times FROM o""",
)
def sample_times(spark, sf):
    p = ad.table(spark, sf, "part")
    wanted = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (i * F.col("p_size")).cast("double"))
    times = fn.sample_times(wanted, F.col("p_retailprice") / 10)
    return p.select("p_partkey", F.array_join(F.transform(times, lambda t: F.format_string("%.3f", t)), ",").alias("times"))


@query(
    "coerce",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS number, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM orders""",
)
def coerce(spark, sf):
    k = F.col("o_orderkey")
    number = F.when(k % 8 == 0, "n/a").when(k % 8 == 4, "NaN").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit(" ")))
    flag = F.element_at(F.array(*[F.lit(x) for x in ("True", "False", " yes", "0", "maybe")]), (k % 5 + 1).cast("int"))
    return ad.table(spark, sf, "orders").select("o_orderkey", fn.parse_number(number).alias("number"), fn.parse_flag(flag).alias("flag"))


@query(
    "analysis_spans",
    "WITH " + ad.SPANS_SQL
    + """, own AS (SELECT * FROM spans WHERE role = 'subject'), rest AS (SELECT * FROM spans WHERE role <> 'subject'),
x AS (SELECT session_id, min(start) AS a, max(start) AS b FROM spans GROUP BY 1),"""
    + ad.elementary_sql("s", "own", "rest", "session_id", False)
    + f"""
SELECT session_id, greatest(start, a) AS start_us, least("end", b) AS end_us FROM s JOIN x USING (session_id) WHERE least("end", b) - greatest(start, a) >= {ad.MINUTE}""",
)
def analysis_spans(spark, sf):
    s = ad.role_spans(spark, sf)
    x = s.groupBy("session_id").agg(F.min("start").alias("extent_start"), F.max("start").alias("extent_end"))
    return ad.named(am.analysis_spans(s, x, ad.MINUTE))


@query(
    "apply_notes",
    "WITH " + _WIDE_SQL
    + """ SELECT session_id, CASE WHEN session_id % 17 = 0 THEN NULL ELSE turn__orders END AS turn__orders, CASE WHEN session_id % 17 = 3 THEN NULL ELSE face__top END AS face__top,
CASE WHEN session_id % 17 = 0 THEN NULL ELSE prosody__balance END AS prosody__balance,
CASE session_id % 17 WHEN 0 THEN 'annotated_prosody_unavailable;annotated_turn_unavailable' WHEN 3 THEN 'annotated_face_unavailable' ELSE '' END AS qc__note_flags FROM w""",
)
def apply_notes(spark, sf):
    k = F.col("c_custkey") % 17
    modality = F.when(k == 0, "audio").when(k == 3, "video").otherwise("speech")
    notes = ad.table(spark, sf, "customer").where(k.isin(0, 3, 5)).select(F.col("c_custkey").alias("session_id"), modality.alias("modality"), F.when(k == 5, "degraded").otherwise("unavailable").alias("status"))
    out = am.apply_notes(_wide(spark, sf), notes, {"audio": ["prosody", "turn"], "video": ["face"], "speech": ["turn"]})
    return out.select("session_id", "turn__orders", "face__top", "prosody__balance", "qc__note_flags")


_NAMES_SQL = "n AS (SELECT DISTINCT lower(p_type) || '__' || replace(p_name, ' ', '-') || CASE WHEN p_size % 3 = 0 THEN ' Score' WHEN p_size % 3 = 1 THEN '2similarity score' ELSE '_targets' END AS name FROM part)"


def _names(spark, sf):
    size = F.col("p_size") % 3
    tail = F.when(size == 0, " Score").when(size == 1, "2similarity score").otherwise("_targets")
    return ad.table(spark, sf, "part").select(F.concat(F.lower("p_type"), F.lit("__"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), tail).alias("name")).distinct()


@query("leak_guard", "WITH " + _NAMES_SQL + " SELECT name, name LIKE '% Score' OR name LIKE '%_targets' AS refused FROM n")
def leak_guard(spark, sf):
    return _names(spark, sf).select("name", am.outcome_like(F.col("name")).alias("refused"))


@query("normalise_name", "WITH " + _NAMES_SQL + " SELECT name, 'text__' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS column_name FROM n")
def normalise_name(spark, sf):
    return _names(spark, sf).select("name", fn.normalise_name(F.col("name")).alias("column_name"))


@query(
    "head_pose",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity / 40 AS x, CASE WHEN l_linenumber = 7 THEN 2 ELSE l_tax * 15 END AS s, l_discount * 20 - 1 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN s < 1.5 THEN round(degrees(x), 6) END AS head_pitch, CASE WHEN s < 1.5 THEN round(degrees(s), 6) END AS head_yaw, CASE WHEN s < 1.5 THEN round(degrees(z), 6) END AS head_roll FROM a""",
)
def head_pose(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    x, y, z = F.col("l_quantity") / 40, F.when(F.col("l_linenumber") == 7, F.pi() / 2).otherwise(F.col("l_tax") * 15), F.col("l_discount") * 20 - 1
    sx, cx, sy, cy, sz, cz = F.sin(x), F.cos(x), F.sin(y), F.cos(y), F.sin(z), F.cos(z)
    r = [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *[c.alias(n) for n, c in fn.head_pose(r).items()]), "l_extendedprice")


@query(
    "combine_present",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(list_avg(list_filter([CASE WHEN l_quantity > 20 THEN l_quantity END, CASE WHEN l_tax > 0.02 THEN l_tax END, CASE WHEN l_discount > 0.05 THEN l_discount END], lambda x: x IS NOT NULL)), 6) AS value FROM lineitem""",
)
def combine_present(spark, sf):
    v = fn.combine_present([F.expr("CASE WHEN l_quantity > 20 THEN l_quantity END"), F.expr("CASE WHEN l_tax > 0.02 THEN l_tax END"), F.expr("CASE WHEN l_discount > 0.05 THEN l_discount END")])
    return ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(v, 6).alias("value"))


# ---------------------------------------------------------------- joins and guards


@query(
    "role_precedence",
    """WITH r AS (SELECT l_suppkey AS session_id, l_linenumber AS speaker, l_suppkey % 3 AS k FROM lineitem GROUP BY ALL)
SELECT session_id, speaker, CASE WHEN k > 0 THEN 'subject' ELSE 'partner' END AS role, CASE WHEN k > 0 THEN 'assigned' ELSE 'manual' END AS source FROM r""",
)
def role_precedence(spark, sf):
    r = ad.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("session_id"), F.col("l_linenumber").alias("speaker")).distinct()
    assigned = r.where("session_id % 3 > 0").withColumn("role", F.lit("subject"))
    manual = tb.role_table(r.withColumn("role", F.lit(" partner ")).withColumn("speaker", F.col("speaker").cast("string")))
    return am.role_precedence(assigned, manual.withColumn("speaker", F.col("speaker").cast("int")))


@query(
    "assemble_features",
    """WITH o AS (SELECT o_custkey AS session_id, count(*) AS turn__n, CASE WHEN count(*) > 12 THEN 'many;busy' ELSE '' END AS fl FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS session_id, c_acctbal AS face__balance, CASE WHEN c_acctbal < 0 THEN 'debt;busy' END AS fl FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c.c_custkey AS session_id, c_mktsegment AS wave, turn__n, face__balance, concat_ws(';', CASE WHEN o.session_id IS NULL THEN 'turns' END, CASE WHEN a.session_id IS NULL THEN 'face' END) AS qc__stages_missing,
CASE WHEN o.fl = 'many;busy' AND a.fl = 'debt;busy' THEN 'many;busy;debt' ELSE concat_ws(';', nullif(o.fl, ''), a.fl) END AS qc__flags
FROM customer c LEFT JOIN o ON o.session_id = c_custkey LEFT JOIN a ON a.session_id = c_custkey""",
)
def assemble_features(spark, sf):
    c = ad.table(spark, sf, "customer")
    turns = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.count("*").alias("turn__n"))
    turns = turns.withColumn("qc__flags", F.when(F.col("turn__n") > 12, "many;busy").otherwise(""))
    face = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("session_id"), F.col("c_acctbal").alias("face__balance"), F.when(F.col("c_acctbal") < 0, "debt;busy").alias("qc__flags"))
    return am.assemble_features(c.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("wave")), {"turns": turns, "face": face})


@query(
    "join_coverage",
    """WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels WHERE doc_id % 10 <> 3 UNION SELECT -doc_id FROM labels WHERE doc_id % 10 = 3)
SELECT CASE WHEN a.doc_id IS NULL THEN 'theirs_only' WHEN b.doc_id IS NULL THEN 'ours_only' ELSE 'matched' END AS side, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1""",
)
def join_coverage(spark, sf):
    d = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"))
    k = F.col("doc_id")
    return am.join_coverage(d, ad.table(spark, sf, "labels").select(F.when(k % 10 == 3, -k).otherwise(k).alias("session_id")))


@query(
    "positional_join",
    """WITH l AS (SELECT doc_id AS session_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), d AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id DESC) - 1 AS k FROM documents)
SELECT session_id, k AS ordinal, n_chars FROM l JOIN d USING (k)""",
)
def positional_join(spark, sf):
    d = ad.table(spark, sf, "documents").select((-F.col("doc_id")).alias("back"), "n_chars")
    # the source numbers its rows; here the order of ids from the last to the first does so, for all documents
    table = am.number_rows(d, "back", "ordinal").select("ordinal", "n_chars")
    ids = ad.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("session_id"))
    return am.positional_join(table, ids, "ordinal").select("session_id", F.col("ordinal").cast("long").alias("ordinal"), "n_chars")


@query(
    "upsert",
    """WITH o AS (SELECT *, o_orderkey % 2 = 1 AND o_custkey % 2 = 1 AS fresh FROM orders)
SELECT o_custkey AS session_id, o_orderkey, o_totalprice AS value, CASE WHEN fresh THEN o_orderstatus END AS extra FROM o WHERE fresh OR o_custkey NOT IN (SELECT o_custkey FROM o WHERE fresh)""",
)
def upsert(spark, sf):
    o = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey", F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("extra"))
    fresh = F.expr("o_orderkey % 2 = 1 AND session_id % 2 = 1")
    return am.upsert(o.where(~fresh).drop("extra"), o.where(fresh))


@query(
    "new_columns",
    """WITH o AS (SELECT *, o_orderkey % 2 = 1 AND o_custkey % 2 = 1 AS fresh FROM orders)
SELECT 'extra' AS "column", count(*) AS n_carried FROM o WHERE NOT fresh AND o_custkey NOT IN (SELECT o_custkey FROM o WHERE fresh)""",
)
def new_columns(spark, sf):
    o = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey", F.col("o_orderstatus").alias("extra"))
    fresh = F.expr("o_orderkey % 2 = 1 AND session_id % 2 = 1")
    return am.new_columns(o.where(~fresh).drop("extra"), o.where(fresh))


@query(
    "pending_sessions",
    """SELECT c_custkey AS session_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 3 > 0 THEN 'skipped' ELSE 'pending' END AS status FROM customer""",
)
def pending_sessions(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"))
    return am.pending(c, ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id")), c.where("session_id % 3 > 0"))


@query(
    "cohort",
    """SELECT coalesce(d.doc_id, l.doc_id) AS session_id, CASE WHEN l.doc_id IS NULL THEN 'features_only' WHEN d.doc_id IS NULL THEN 'labels_only' ELSE 'cohort' END AS part, coalesce(source, CAST(coalesce(d.doc_id, l.doc_id) AS VARCHAR)) AS "group"
FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN source END AS source FROM documents) d FULL JOIN labels l ON l.doc_id = d.doc_id""",
)
def cohort(spark, sf):
    d = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.col("source").alias("group"))
    groups = d.withColumn("group", F.when(F.col("session_id") % 5 > 0, F.col("group")))
    return am.cohort(d, ad.table(spark, sf, "labels").select(F.col("doc_id").alias("session_id")), groups)


@query("single_source", "SELECT l_suppkey, count(DISTINCT l_shipmode) AS n_sources, count(DISTINCT l_shipmode) <= 1 AS comparable FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'one' ELSE l_returnflag END AS l_shipmode FROM lineitem) GROUP BY 1")
def single_source(spark, sf):
    li = ad.table(spark, sf, "lineitem").withColumn("backend", F.when(F.col("l_suppkey") % 2 == 0, "one").otherwise(F.col("l_returnflag")))
    return am.single_source(li, ["l_suppkey"], "backend")


@query(
    "validate",
    """SELECT * FROM (SELECT 'c_acctbal' AS "column", 'low' AS "check", count(*) FILTER (WHERE c_acctbal < 0) AS failures FROM customer UNION ALL SELECT 'c_acctbal', 'high', count(*) FILTER (WHERE c_acctbal > 9000) FROM customer
UNION ALL SELECT 'c_mktsegment', 'value', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer UNION ALL SELECT '*', 'even_or_rich', count(*) FILTER (WHERE NOT (c_custkey % 2 = 0 OR c_acctbal > 1000)) FROM customer
UNION ALL SELECT 'c_nationkey', 'unexpected', 1 UNION ALL SELECT 'c_name', 'type', 1 UNION ALL SELECT 'c_phone', 'missing', 1
UNION ALL SELECT 'c_mktsegment', 'unique', (SELECT count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1))) WHERE failures > 0""",
)
def validate(spark, sf):
    fields = [am.Field("c_custkey", "bigint", low=0), am.Field("c_name", "bigint"), am.Field("c_acctbal", "double", low=0, high=9000), am.Field("c_mktsegment", "string", values=("BUILDING", "MACHINERY")), am.Field("c_phone", "string")]
    return am.validate(ad.table(spark, sf, "customer"), fields, ["c_mktsegment"], {"even_or_rich": "c_custkey % 2 = 0 OR c_acctbal > 1000"})


@query(
    "dictionary",
    """WITH s AS (SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type = 'DOUBLE')
SELECT 'line__' || name AS name, 'line' AS family, CASE WHEN name = 'l_extendedprice' THEN 'money' ELSE 'ratio' END AS unit, 'exploratory' AS tier, 'column ' || name AS description FROM s""",
)
def dictionary(spark, sf):
    names = [c for c, t in ad.table(spark, sf, "lineitem").dtypes if t == "double"]
    described = {f"line__{c}": ("money" if c == "l_extendedprice" else "ratio", "exploratory", f"column {c}") for c in names}
    return am.feature_dictionary(spark, list(described), described)


@query(
    "wave_of_id",
    """SELECT c_custkey AS session_id, wave, by_id AS wave_by_id, wave IS NOT DISTINCT FROM by_id AS agrees FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'late' ELSE 'early' END AS wave,
CASE WHEN c_custkey BETWEEN 1 AND 50 THEN 'early' WHEN c_custkey BETWEEN 60 AND 120 THEN 'late' END AS by_id FROM customer)""",
)
def wave_of_id(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 9 == 0, "late").otherwise("early").alias("wave"))
    return am.wave_of_id(c, [("early", 1, 50), ("late", 60, 120)])


@query(
    "keep_all_rows",
    """SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS value, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'unreadable: ' || c_mktsegment ELSE 'not measured' END AS flags FROM customer""",
)
def keep_all_rows(spark, sf):
    c = ad.table(spark, sf, "customer").withColumnRenamed("c_custkey", "session_id")
    measured = c.where("session_id % 3 = 0").select("session_id", F.col("c_acctbal").alias("value"), F.lit("").alias("flags"))
    return am.keep_all_rows(c, measured, c.where("session_id % 3 = 1").select("session_id", F.col("c_mktsegment").alias("reason")))


@query(
    "outcomes",
    """SELECT 'totals' AS stage, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END) AS DOUBLE) AS seconds FROM customer GROUP BY 1, 2""",
)
def outcomes(spark, sf):
    c = ad.table(spark, sf, "customer").withColumnRenamed("c_custkey", "session_id")
    done = c.where("session_id % 3 = 0").select("session_id", F.col("c_nationkey").cast("double").alias("seconds"))
    out = am.stage_outcomes(done, c.where("session_id % 3 = 1").select("session_id", F.lit("boom").alias("message")), c.where("session_id % 3 = 2"), "totals")
    return out.groupBy("stage", "status").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


@query(
    "role_evidence",
    "WITH " + ad.SPANS_SQL
    + """ SELECT session_id, '{"session_id":' || session_id || ',"roles":[' || string_agg('{"speaker":"' || speaker || '","role":"' || role || '","n_spans":' || n || '}', ',' ORDER BY speaker) || ']}' AS evidence
FROM (SELECT session_id, speaker, role, count(*) AS n FROM spans GROUP BY 1, 2, 3) GROUP BY 1""",
)
def role_evidence(spark, sf):
    s = tn.with_roles(ad.spans(spark, sf), ad.roles(spark, sf)).groupBy("session_id", "speaker", "role").agg(F.count("*").alias("n_spans"))
    r = s.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("speaker", "role", "n_spans"))).alias("roles"))
    return r.select("session_id", F.to_json(F.struct("session_id", "roles")).alias("evidence"))


# ---------------------------------------------------------------- files and schemas that come back


@query(
    "label_file",
    """SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS total, CAST(o_custkey AS DOUBLE) AS customer FROM orders""",
)
def label_file(spark, sf):
    """Labels of every order written as a CSV file and read back by its id column; a target that is no number is null."""
    o = ad.table(spark, sf, "orders")
    total = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    path = f"{ad.scratch(spark)}/labels.csv"
    tb.write_table(o.select(F.col("o_orderkey").alias(" ID "), total.alias("total"), F.col("o_custkey").alias("customer")), path)
    return tb.label_table(tb.read_table(spark, path))


@query(
    "typed_table",
    """SELECT CAST(c_custkey AS VARCHAR) AS session_id, c_acctbal AS balance, CAST(NULL AS BIGINT) AS absent, CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey AS BIGINT) END AS nation FROM customer""",
)
def typed_table(spark, sf):
    """All customers in the types of a contract, through a Parquet file: a column that is not there is null and keeps its type."""
    c = ad.table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("session_id"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("nation"), "c_name")
    fields = [am.Field("session_id", "string"), am.Field("balance", "double"), am.Field("absent", "bigint", nullable=True), am.Field("nation", "bigint", nullable=True)]
    path = f"{ad.scratch(spark)}/typed.parquet"
    tb.write_table(am.empty_table(spark, fields).unionByName(am.typed(rows, fields)), path)
    return tb.read_table(spark, path)


_LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "described_features",
    "WITH l AS (SELECT "
    + ", ".join(f"CASE WHEN l_orderkey % {i + 2} > 0 THEN {c} END AS {c}" for i, c in enumerate(_LINE_COLUMNS))
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT 'line__{c}' AS name, 'line' AS family, '{"money" if c == "l_extendedprice" else "ratio"}' AS unit, 'exploratory' AS tier, 'column {c}' AS description, round(count({c}) / count(*), 6) AS known FROM l"""
        for c in _LINE_COLUMNS
    ),
)
def described_features(spark, sf):
    """The dictionary of features with the share of rows in which each is known."""
    k = F.col("l_orderkey")
    li = ad.table(spark, sf, "lineitem").select(*[F.when(k % (i + 2) > 0, F.col(c)).alias(f"line__{c}") for i, c in enumerate(_LINE_COLUMNS)])
    names = am.family_columns(li.columns, ["line"])
    words = {n: ("money" if n.endswith("extendedprice") else "ratio", "exploratory", "column " + n.removeprefix("line__")) for n in names}
    shares = st.completeness(li, names).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"known_{n}").alias("known")) for n in names])).alias("s"))
    return rounded(am.feature_dictionary(spark, names, words).join(shares.select("s.*"), "name"))
