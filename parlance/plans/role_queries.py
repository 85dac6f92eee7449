"""Queries of role decisions, over ``embeddings`` as voices and ``events`` as labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roles as ro
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


def _vectors(spark, sf):
    """(references, speakers): the first vector of each of two labels, and all other vectors, 50 sessions."""
    e = ad.table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    first = e.where("label IN (0, 1)").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    refs = e.join(first.select("vec_id"), "vec_id").select(F.concat(F.lit("ref"), F.col("label").cast("string")).alias("reference"), "vector", "vec_id")
    s = e.join(first.select("vec_id"), "vec_id", "left_anti").select((F.col("vec_id") % 50).alias("session_id"), F.col("vec_id").alias("speaker"), "vector")
    return refs, s


_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label, min(vec_id) AS vec_id FROM e WHERE label IN (0, 1) GROUP BY 1),
refs AS (SELECT 'ref' || e.label AS reference, e.v, e.vec_id FROM e JOIN f ON e.vec_id = f.vec_id), sp AS (SELECT vec_id % 50 AS session_id, vec_id AS speaker, v FROM e WHERE vec_id NOT IN (SELECT vec_id FROM f)),
scores AS (SELECT session_id, speaker, reference, coalesce(list_dot_product(sp.v, refs.v) / nullif(sqrt(list_dot_product(sp.v, sp.v)) * sqrt(list_dot_product(refs.v, refs.v)), 0), 0) AS similarity FROM sp, refs)"""


@query("cosine", _SQL + " SELECT session_id, speaker, reference, round(similarity, 6) AS similarity FROM scores")
def cosine_scores(spark, sf):
    refs, s = _vectors(spark, sf)
    return rounded(ro.score_references(s, refs))


@query(
    "ref_pairs",
    _SQL
    + """, h AS (SELECT *, v[1:len(v) // 2] AS a, v[len(v) // 2 + 1:(len(v) // 2) * 2] AS b FROM refs), o AS (SELECT *, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS own FROM h),
p AS (SELECT x.reference AS reference_a, y.reference AS reference_b, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS similarity, least(x.own, y.own) AS control FROM o x JOIN o y ON x.reference < y.reference)
SELECT reference_a, reference_b, round(similarity, 6) AS similarity, round(control, 6) AS control, similarity < control AS "distinct" FROM p""",
)
def ref_pairs(spark, sf):
    refs, _ = _vectors(spark, sf)
    half = F.floor(F.size("vector") / 2).cast("int")
    refs = refs.withColumns({"first_half": F.slice("vector", F.lit(1), half), "second_half": F.slice("vector", half + 1, half)})
    return rounded(ro.compare_references(refs))


_DECIDE = """, spk AS (SELECT session_id, speaker, (speaker % 7) * 10 AS speech, (speaker % 5) * 3 AS embedded FROM sp),
b AS (SELECT k.*, coalesce(m.best, -1) AS best, embedded >= 3 AS eligible FROM spk k LEFT JOIN (SELECT session_id, speaker, max(similarity) AS best FROM scores GROUP BY 1, 2) m USING (session_id, speaker)),
r AS (SELECT *, CASE WHEN eligible THEN row_number() OVER w END AS rank, CASE WHEN eligible THEN best - lead(best) OVER w END AS gap, sum(eligible::INT) OVER (PARTITION BY session_id) AS n
  FROM b WINDOW w AS (PARTITION BY session_id, eligible ORDER BY best DESC, speaker)),
q AS (SELECT *, CASE WHEN rank > 1 THEN row_number() OVER (PARTITION BY session_id, coalesce(rank > 1, false) ORDER BY speech DESC, speaker) END AS place FROM r),
roles AS (SELECT session_id, speaker, CASE WHEN n < 2 THEN 'unknown' WHEN rank = 1 THEN 'partner' WHEN place = 1 THEN 'subject' ELSE 'unknown' END AS role, best, CASE WHEN rank = 1 THEN gap END AS margin,
  concat_ws(';', CASE WHEN n < 2 THEN 'unassigned' END, CASE WHEN rank = 1 AND gap < 0.05 THEN 'small_margin' END, CASE WHEN n > 2 THEN 'extra_speakers' END) AS flags FROM q)"""


def _decided(spark, sf):
    refs, s = _vectors(spark, sf)
    scores = ro.score_references(s, refs)
    speech = s.select("session_id", "speaker", (F.col("speaker") % 7 * 10).alias("speech"), (F.col("speaker") % 5 * 3).alias("embedded"))
    return scores, ro.decide_roles(speech, scores, 3, 0.05)


@query("decide_roles", _SQL + _DECIDE + " SELECT session_id, speaker, role, round(best, 6) AS best, round(margin, 6) AS margin, flags FROM roles")
def decide_roles(spark, sf):
    return rounded(_decided(spark, sf)[1])


_VOTES = ", vt AS (SELECT session_id, reference, speaker, similarity FROM (SELECT *, row_number() OVER (PARTITION BY session_id, reference ORDER BY similarity DESC, speaker) AS k FROM scores) WHERE k = 1)"


@query("ref_votes", _SQL + _VOTES + " SELECT session_id, count(*) AS n_references, count(DISTINCT speaker) = 1 AS agree FROM vt GROUP BY 1")
def ref_votes(spark, sf):
    refs, s = _vectors(spark, sf)
    return ro.reference_votes(ro.score_references(s, refs))[1]


@query(
    "decisive_refs",
    _SQL + """, m AS (SELECT DISTINCT session_id, 'ref' || (session_id % 2) AS reference FROM sp WHERE session_id % 3 = 0)
SELECT s.session_id, r.reference FROM (SELECT DISTINCT session_id FROM sp) s CROSS JOIN refs r LEFT JOIN m ON m.session_id = s.session_id WHERE m.reference IS NULL OR m.reference = r.reference""",
)
def decisive_refs(spark, sf):
    refs, s = _vectors(spark, sf)
    sessions = s.select("session_id").distinct()
    mapping = sessions.where("session_id % 3 = 0").select("session_id", F.concat(F.lit("ref"), (F.col("session_id") % 2).cast("string")).alias("reference"))
    return ro.decisive_references(sessions, refs.select("reference"), mapping)


_BRIDGE = """, sides AS (SELECT DISTINCT session_id, CASE session_id % 4 WHEN 0 THEN ' Left' WHEN 1 THEN 'right' WHEN 2 THEN 'assumed' ELSE 'left' END AS side FROM sp),
placed AS (SELECT session_id, speaker, CASE WHEN speaker % 6 = 0 THEN 'left' WHEN speaker % 6 = 1 THEN 'right' ELSE 'none' END AS side FROM sp),
sr AS (SELECT p.session_id, CASE WHEN count(*) = 1 THEN min(p.speaker) END AS subject_speaker FROM placed p JOIN sides s ON s.session_id = p.session_id AND lower(trim(s.side)) = p.side GROUP BY 1),
dec AS (SELECT session_id, max(CASE WHEN role = 'subject' THEN speaker END) AS subject_speaker FROM roles GROUP BY 1),
bridge AS (SELECT d.session_id, CASE WHEN d.subject_speaker IS NULL OR sr.subject_speaker IS NULL THEN 'unavailable' WHEN d.subject_speaker = sr.subject_speaker THEN 'agree' ELSE 'disagree' END AS agreement FROM dec d LEFT JOIN sr USING (session_id))"""


def _bridge(spark, sf, roles):
    _, s = _vectors(spark, sf)
    k = F.col("session_id") % 4
    sides = s.select("session_id").distinct().withColumn("side", F.when(k == 0, " Left").when(k == 1, "right").when(k == 2, "assumed").otherwise("left"))
    placed = s.select("session_id", "speaker", F.when(F.col("speaker") % 6 == 0, "left").when(F.col("speaker") % 6 == 1, "right").otherwise("none").alias("side"))
    decided = roles.groupBy("session_id").agg(F.max(F.when(F.col("role") == "subject", F.col("speaker"))).alias("subject_speaker"))
    return ro.agreement(decided, ro.side_roles(placed, sides))


@query("bridge_agreement", _SQL + _DECIDE + _BRIDGE + " SELECT * FROM bridge")
def bridge_agreement(spark, sf):
    return _bridge(spark, sf, _decided(spark, sf)[1])


@query(
    "side_decision",
    "WITH " + ad.EVENTS_SQL + """, l AS (SELECT event_id // 4 AS session_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, event_type || '-' || CAST(floor(value / 40) AS INT) AS label FROM ev),
d AS (SELECT label FROM (SELECT DISTINCT session_id, label FROM l) GROUP BY 1 HAVING count(*) >= 150),
g AS (SELECT session_id, coalesce(bool_or(label LIKE 'signup%' AND side = 'left'), false) AS nl, coalesce(bool_or(label LIKE 'signup%' AND side = 'right'), false) AS nr,
  coalesce(bool_or(label IN (SELECT label FROM d) AND side = 'left'), false) AS rl, coalesce(bool_or(label IN (SELECT label FROM d) AND side = 'right'), false) AS rr FROM l GROUP BY 1),
o AS (SELECT session_id, CASE WHEN nl AND NOT nr THEN 'left' WHEN nr AND NOT nl THEN 'right' END AS named, CASE WHEN rl AND NOT rr THEN 'left' WHEN rr AND NOT rl THEN 'right' END AS often FROM g)
SELECT session_id, coalesce(named, often, 'left') AS side, CASE WHEN named IS NOT NULL THEN 'explicit' WHEN often IS NOT NULL THEN 'recurring' ELSE 'assumed' END AS source,
CASE WHEN coalesce(named, often) IS NULL THEN 'inconclusive' WHEN coalesce(named, often) <> 'left' THEN 'other_than_assumed' ELSE '' END AS flags FROM o""",
)
def side_decision(spark, sf):
    e = ad.timed_events(spark, sf)
    label = F.concat_ws("-", "event_type", F.floor(F.col("value") / 40).cast("string"))
    lab = e.select(F.floor(F.col("event_id") / 4).alias("session_id"), F.when(F.col("event_id") % 2 == 0, "left").otherwise("right").alias("side"), label.alias("label"))
    often = lab.select("session_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).where("n >= 150")
    return ro.decide_sides(lab, often, "^signup", "left")


@query(
    "evidence_pivot",
    _SQL + " SELECT session_id, speaker, round(max(CASE WHEN reference = 'ref0' THEN similarity END), 6) AS sim__ref0, round(max(CASE WHEN reference = 'ref1' THEN similarity END), 6) AS sim__ref1 FROM scores GROUP BY 1, 2",
)
def evidence_pivot(spark, sf):
    refs, s = _vectors(spark, sf)
    return rounded(ro.evidence_wide(ro.score_references(s, refs), ["ref0", "ref1"]))


@query(
    "decision_row",
    _SQL + _DECIDE + _BRIDGE + _VOTES
    + """, v AS (SELECT session_id, string_agg(reference || '=' || speaker, ',' ORDER BY reference || '=' || speaker) AS votes, count(DISTINCT speaker) = 1 AS agree FROM vt GROUP BY 1)
SELECT r.session_id, max(CASE WHEN role = 'partner' THEN speaker END) AS partner_speaker, max(CASE WHEN role = 'subject' THEN speaker END) AS subject_speaker, round(max(CASE WHEN role = 'partner' THEN best END), 6) AS best,
round(max(margin), 6) AS margin, max(flags) AS flags, '[' || string_agg('{"speaker":' || speaker || ',"role":"' || role || '"}', ',' ORDER BY speaker) || ']' AS evidence, any_value(votes) AS votes, any_value(agree) AS agree, any_value(agreement) AS agreement
FROM roles r LEFT JOIN v USING (session_id) LEFT JOIN bridge USING (session_id) GROUP BY 1""",
)
def decision_row(spark, sf):
    scores, roles = _decided(spark, sf)
    return rounded(ro.decision_rows(roles, scores, ro.reference_votes(scores)[1], _bridge(spark, sf, roles)))
