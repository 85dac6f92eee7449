"""Role decisions: a rule engine over similarities, sides and movement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import cosine

#: Bytes of reference vectors that may be broadcast; beyond it references are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def score_references(speakers: DataFrame, references: DataFrame) -> DataFrame:
    """(session_id, speaker, reference, similarity) of every speaker (session_id, speaker, vector) and reference
    (reference, vector). References are few; they are broadcast only if their measured size allows it."""
    r = references.select("reference", F.col("vector").alias("__v"))
    size = references.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        both = speakers.crossJoin(F.broadcast(r))
    else:
        # rows of each side meet in a grid of buckets, so that neither side goes whole to a task
        k = int(size // BROADCAST_BYTES) + 1
        r = r.withColumn("__b", F.pmod(F.xxhash64("reference"), F.lit(k)))
        both = speakers.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).join(r, "__b")
    return both.select("session_id", "speaker", "reference", cosine(F.col("vector"), F.col("__v")).alias("similarity"))


def compare_references(references: DataFrame) -> DataFrame:
    """Similarity of each pair of references (i < j), with the worst similarity of either's own halves as control.

    ``references``: (reference, vector, first_half, second_half), a few rows.
    """
    r = references.withColumn("own", cosine(F.col("first_half"), F.col("second_half")))
    a = r.select(F.col("reference").alias("reference_a"), F.col("vector").alias("va"), F.col("own").alias("own_a"))
    b = r.select(F.col("reference").alias("reference_b"), F.col("vector").alias("vb"), F.col("own").alias("own_b"))
    p = a.join(b, F.col("reference_a") < F.col("reference_b"))
    control = F.least("own_a", "own_b")
    sim = cosine(F.col("va"), F.col("vb"))
    return p.select("reference_a", "reference_b", sim.alias("similarity"), control.alias("control"), (sim < control).alias("distinct"))


def decisive_references(sessions: DataFrame, references: DataFrame, mapping: DataFrame) -> DataFrame:
    """(session_id, reference): the mapped reference of a session, or all of them; unknown names are refused."""
    if mapping.join(references, "reference", "left_anti").take(1):
        raise ValueError("the map names a reference that does not exist")
    mapped = sessions.select("session_id").join(mapping.select("session_id", "reference"), "session_id", "left")
    every = references.agg(F.collect_set("reference").alias("__all"))
    out = mapped.crossJoin(F.broadcast(every))  # one row
    return out.select("session_id", F.explode(F.when(F.col("reference").isNotNull(), F.array("reference")).otherwise(F.col("__all"))).alias("reference"))


def reference_votes(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best speaker of each (session, reference), and per session whether all references agree."""
    w = Window.partitionBy("session_id", "reference").orderBy(F.desc_nulls_last("similarity"), "speaker")
    votes = scores.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("session_id", "reference", "speaker", "similarity")
    agree = votes.groupBy("session_id").agg(F.count("*").alias("n_references"), (F.count_distinct("speaker") == 1).alias("agree"))
    return votes, agree


def decide_roles(speech: DataFrame, scores: DataFrame, least_embedded: float, least_margin: float) -> DataFrame:
    """(session_id, speaker, role, best, margin, flags) by similarity to the partner's references.

    ``speech``: (session_id, speaker, speech, embedded). Speakers with enough embedded speech are ranked by their
    best similarity (-1 without any); the first is the partner, of the others the one with most speech the
    subject. Under two eligible speakers nobody is assigned. A small margin is flagged, not refused. Ties go to the
    smaller name.
    """
    best = scores.groupBy("session_id", "speaker").agg(F.max("similarity").alias("best"))
    s = speech.join(best, ["session_id", "speaker"], "left").withColumn("best", F.coalesce("best", F.lit(-1.0)))
    s = s.withColumn("eligible", F.col("embedded") >= least_embedded)
    by = Window.partitionBy("session_id", "eligible").orderBy(F.desc("best"), "speaker")
    s = s.withColumns({"rank": F.when(F.col("eligible"), F.row_number().over(by)), "margin": F.when(F.col("eligible"), F.col("best") - F.lead("best").over(by))})
    every = Window.partitionBy("session_id")
    s = s.withColumn("n_eligible", F.sum(F.col("eligible").cast("int")).over(every))
    rest = Window.partitionBy("session_id", F.coalesce(F.col("rank") > 1, F.lit(False))).orderBy(F.desc("speech"), "speaker")
    s = s.withColumn("place", F.when(F.col("rank") > 1, F.row_number().over(rest)))
    role = F.when(F.col("n_eligible") < 2, "unknown").when(F.col("rank") == 1, "partner").when(F.col("place") == 1, "subject").otherwise("unknown")
    tests = [(F.col("n_eligible") < 2, "unassigned"), ((F.col("rank") == 1) & (F.col("margin") < least_margin), "small_margin"), (F.col("n_eligible") > 2, "extra_speakers")]
    flags = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])), ";")
    top = F.when(F.col("rank") == 1, F.col("margin"))
    return s.select("session_id", "speaker", role.alias("role"), "best", top.alias("margin"), flags.alias("flags"))


def side_roles(placed: DataFrame, sides: DataFrame) -> DataFrame:
    """Role by session from the one speaker on the side known to be the subject's; null for none or several.

    ``placed``: (session_id, speaker, side); ``sides``: (session_id, side) of the subject, left or right. Other
    values, such as an assumed side, do not count.
    """
    known = sides.where(F.lower(F.trim("side")).isin("left", "right")).select("session_id", F.lower(F.trim("side")).alias("side"))
    on = placed.join(known, ["session_id", "side"])
    n = on.groupBy("session_id").agg(F.count("*").alias("n"), F.min("speaker").alias("s"))
    return n.select("session_id", F.when(F.col("n") == 1, F.col("s")).alias("subject_speaker"))


def agreement(decided: DataFrame, other: DataFrame, column: str = "subject_speaker") -> DataFrame:
    """agree, disagree or unavailable, by session."""
    o = other.select("session_id", F.col(column).alias("__o"))
    a = decided.select("session_id", F.col(column).alias("__d")).join(o, "session_id", "left")
    return a.select("session_id", F.when(F.col("__d").isNull() | F.col("__o").isNull(), "unavailable").when(F.col("__d") == F.col("__o"), "agree").otherwise("disagree").alias("agreement"))


def decide_sides(labels: DataFrame, recurring: DataFrame, explicit: str, assumed: str) -> DataFrame:
    """(session_id, side, source, flags) of the side where the partner's label stands.

    ``labels``: (session_id, side, label). A label that fits ``explicit`` decides before one that recurs over
    sessions; on both sides or on neither it is inconclusive, and the assumed side is taken with a flag. A
    conclusive side other than the assumed one is flagged and kept.
    """
    r = recurring.select("label").withColumn("__r", F.lit(True))
    x = labels.join(r, "label", "left")
    pick = lambda cond, side: F.coalesce(F.bool_or(cond & (F.col("side") == side)), F.lit(False))
    named, often = F.col("label").rlike(explicit), F.coalesce("__r", F.lit(False))
    g = x.groupBy("session_id").agg(pick(named, "left").alias("nl"), pick(named, "right").alias("nr"), pick(often, "left").alias("rl"), pick(often, "right").alias("rr"))
    one = lambda left, right: F.when(F.col(left) & ~F.col(right), "left").when(F.col(right) & ~F.col(left), "right")
    g = g.withColumns({"named": one("nl", "nr"), "often": one("rl", "rr")})
    side = F.coalesce("named", "often")
    source = F.when(F.col("named").isNotNull(), "explicit").when(F.col("often").isNotNull(), "recurring").otherwise("assumed")
    flags = F.when(side.isNull(), "inconclusive").when(side != assumed, "other_than_assumed").otherwise("")
    return g.select("session_id", F.coalesce(side, F.lit(assumed)).alias("side"), source.alias("source"), flags.alias("flags"))


def evidence_wide(scores: DataFrame, references: Sequence[str]) -> DataFrame:
    """(session_id, speaker, sim__<reference>...) from long rows."""
    wide = scores.groupBy("session_id", "speaker").pivot("reference", list(references)).agg(F.first("similarity"))
    return wide.select("session_id", "speaker", *[F.col(str(r)).alias(f"sim__{r}") for r in references])


def decision_rows(roles: DataFrame, scores: DataFrame, agree: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per session: partner and subject, best and margin, votes, agreements, flags and evidence as JSON."""
    votes, _ = reference_votes(scores)
    v = votes.groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", F.col("reference").cast("string"), "speaker"))), ",").alias("votes"))
    r = roles.groupBy("session_id").agg(
        F.max(F.when(F.col("role") == "partner", F.col("speaker"))).alias("partner_speaker"),
        F.max(F.when(F.col("role") == "subject", F.col("speaker"))).alias("subject_speaker"),
        F.max(F.when(F.col("role") == "partner", F.col("best"))).alias("best"),
        F.max("margin").alias("margin"),
        F.max("flags").alias("flags"),
        F.to_json(F.sort_array(F.collect_list(F.struct("speaker", "role")))).alias("evidence"),
    )
    return r.join(v, "session_id", "left").join(agree.select("session_id", "agree"), "session_id", "left").join(bridge, "session_id", "left")
