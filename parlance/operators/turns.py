"""Turn taking: turns, response latencies, pauses, the speaking / listening timeline and turn features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans as sp
from .scans import order_statistics, previous, same_keys, scan, settled

SUBJECT, PARTNER, UNKNOWN = "subject", "partner", "unknown"


def with_roles(spans: DataFrame, roles: DataFrame) -> DataFrame:
    """Add ``role`` by (session, speaker); speakers without one are unknown."""
    r = roles.select("session_id", "speaker", "role")
    return spans.join(r, ["session_id", "speaker"], "left").withColumn("role", F.coalesce("role", F.lit(UNKNOWN)))


def turn_spans(spans: DataFrame, gap: float, eps: float = 0, width: float | None = None) -> DataFrame:
    """The merged spans of every role (gap 0) with the turn that each belongs to: (session_id, role, start, end, n_spans,
    turn_index, and ``gap_before``, the silence since the turn's span before).

    Spans merge per role, bridging gaps of at most ``gap``, into runs; runs are ordered by start, end and role, and
    consecutive ones of a role are one turn, numbered from 0. All comes from one merge and the windows over its few rows; with
    ``width`` from segmented scans, which give the same rows and no session to one task.
    """
    if width is not None:
        return _scanned_turn_spans(spans, gap, eps, width)
    m = sp.merge(spans, ["session_id", "role"], 0, eps)
    own = Window.partitionBy("session_id", "role").orderBy("start")
    m = m.withColumn("__opens", F.when(F.col("start") - F.lag("end").over(own) <= gap + eps, 0).otherwise(1))
    m = m.withColumn("__run", F.sum("__opens").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")
    run = Window.partitionBy("session_id", "role", "__run")
    m = m.withColumns({"__from": F.min("start").over(run), "__to": F.max("end").over(run)})
    order = Window.partitionBy("session_id").orderBy("__from", "__to", "role", "start")
    m = m.withColumn("__new", F.when(F.lag("role").over(order) == F.col("role"), 0).otherwise(1))
    m = m.withColumn("turn_index", (F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    # spans of a role do not touch, so within a turn the one before ends before this one starts
    m = m.withColumn("gap_before", F.when(F.col("__new") == 0, F.col("start") - F.lag("end").over(order)))
    return m.select("session_id", "role", "start", "end", "n_spans", "turn_index", "gap_before")


def _scanned_turn_spans(spans: DataFrame, gap: float, eps: float, width: float) -> DataFrame:
    own, bucket = ["session_id", "role"], F.floor(F.col("start") / width)
    m = previous(sp.merge(spans, own, 0, eps, width), own, ["start"], {"__last": "end"}, bucket)
    m = m.withColumn("__opens", F.when(F.col("start") - F.col("__last") <= gap + eps, 0).otherwise(1))
    m = scan(m, own, ["start"], bucket, {"__before": ("sum", F.col("__opens"))})
    m = settled(m.withColumn("__run", F.col("__before") + F.col("__opens")).withColumn("__at", bucket).drop("__before"))
    runs = m.groupBy(*own, "__run").agg(F.min("start").alias("__from"), F.max("end").alias("__to"))
    order, begin = ["__from", "__to", "role"], F.floor(F.col("__from") / width)
    runs = previous(runs, ["session_id"], order, {"__other": "role"}, begin)
    runs = runs.withColumn("__new", F.when(F.col("__other") == F.col("role"), 0).otherwise(1))
    runs = scan(runs, ["session_id"], order, begin, {"__turns": ("sum", F.col("__new"))})
    # a long run meets its spans bucket by bucket
    runs = runs.withColumn("__at", F.explode(F.sequence(begin, F.floor(F.col("__to") / width))))
    runs = runs.select(*own, "__run", "__at", "__new", (F.col("__turns") + F.col("__new") - 1).cast("int").alias("turn_index"))
    m = same_keys(m, runs, [*own, "__run", "__at"])
    m = m.withColumn("gap_before", F.when(F.col("__opens") * F.col("__new") == 0, F.col("start") - F.col("__last")))
    return m.select("session_id", "role", "start", "end", "n_spans", "turn_index", "gap_before")


def build_turns(spans: DataFrame, gap: float, eps: float = 0, width: float | None = None) -> DataFrame:
    """Turns of (session_id, role, start, end) spans, numbered from 0 (``turn_spans``); a turn reaches to the latest end."""
    t = turn_spans(spans, gap, eps, width).groupBy("session_id", "turn_index", "role")
    t = t.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_spans").alias("n_spans"))
    return t.select("session_id", "turn_index", "role", "start", "end", "n_spans")


def with_latency(turns: DataFrame, width: float | None = None) -> DataFrame:
    """Add ``latency``: from the end of a partner's turn to the start of the subject's next; negative if early."""
    bucket = None if width is None else F.floor(F.col("start") / width)  # turns are numbered by their start
    t = previous(turns, ["session_id"], ["turn_index"], {"__role": "role", "__end": "end"}, bucket)
    answer = (F.col("role") == SUBJECT) & (F.col("__role") == PARTNER)
    return t.withColumn("latency", F.when(answer, F.col("start") - F.col("__end"))).drop("__role", "__end")


def pauses(spans: DataFrame, gap: float, least: float, eps: float = 0, width: float | None = None) -> DataFrame:
    """Gaps longer than ``least`` between the spans of a turn (``turn_spans``)."""
    p = turn_spans(spans, gap, eps, width).where(F.col("gap_before") > max(least, eps))
    return p.select("session_id", "role", "turn_index", (F.col("start") - F.col("gap_before")).alias("pause_start"), F.col("start").alias("pause_end"), F.col("gap_before").alias("pause"))


def timeline(spans: DataFrame, eps: float = 0, width: float | None = None) -> DataFrame:
    """Speaking time of the subject, and listening time: the partner's where the subject is silent; one sweep gives both."""
    marks = {"own": F.col("role") == SUBJECT, "other": F.col("role") == PARTNER}
    pieces = sp.levels(spans.where(F.col("role").isin(SUBJECT, PARTNER)), ["session_id"], marks, eps, width)
    state = F.when(F.col("own") > 0, "speaking").when(F.col("other") > 0, "listening")
    pieces = pieces.withColumn("state", state).where("state IS NOT NULL")
    return sp.merge(pieces.select("session_id", "state", "start", "end"), ["session_id", "state"], 0, eps, width).select("session_id", "state", "start", "end")


def _covered(merged: DataFrame, width: float | None = None) -> DataFrame:
    """Add ``__more``, the time that each of a role's merged spans adds to what subject and partner together covered before."""
    pair = F.col("role").isin(SUBJECT, PARTNER)
    order, ends = ["start", "end", "role"], F.when(pair, F.col("end"))
    if width is None:
        before = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        merged = merged.withColumn("__reach", F.max(ends).over(before))
    else:
        merged = scan(merged, ["session_id"], order, F.floor(F.col("start") / width), {"__reach": ("max", ends)})
    reach = F.col("__reach")
    more = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    return merged.withColumn("__more", F.when(pair, more)).drop("__reach")


def _coverage_sums() -> list:
    length = F.col("end") - F.col("start")
    mine, theirs = (F.coalesce(F.sum(F.when(F.col("role") == r, length)), F.lit(0)) for r in (SUBJECT, PARTNER))
    both = F.coalesce(F.sum("__more"), F.lit(0))
    return [mine.alias("subject_time"), theirs.alias("partner_time"), F.sum(length).alias("all_time"), both.alias("both_time"), (mine + theirs - both).alias("overlap_time")]


def coverage(spans: DataFrame, eps: float = 0, width: float | None = None) -> DataFrame:
    """Per session: covered time of subject, partner, all roles added up, both together, and their overlap."""
    return _covered(sp.merge(spans, ["session_id", "role"], 0, eps, width), width).groupBy("session_id").agg(*_coverage_sums())


def turn_features(
    spans: DataFrame, durations: DataFrame, gap: float, least_pause: float, most_latency: float, unit: float = 1.0, eps: float = 0, width: float | None = None
) -> DataFrame:
    """One row of turn features per session of ``durations`` (session_id, duration).

    ``unit`` is the length of a second. Rates are per minute of the session; pauses per minute of the subject's
    speech. Every feature that has nothing to rest on is null, never 0. The spans are read and merged once.
    """
    s = _covered(turn_spans(spans, gap, eps, width), width)
    pause = F.when(F.col("gap_before") > max(least_pause, eps), F.col("gap_before"))
    turns = s.groupBy("session_id", "turn_index", "role").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("spoken"), F.sum("__more").alias("more"), F.sum(pause).alias("pause"), F.count(pause).alias("n_pauses")
    )
    turns = with_latency(turns, width)
    length, latency = (F.col("end") - F.col("start")) / unit, F.col("latency") / unit
    usable = F.when((F.col("latency") >= 0) & (F.col("latency") <= most_latency), latency)
    mine, theirs = (F.when(F.col("role") == r, length) for r in (SUBJECT, PARTNER))
    of = lambda r, c: F.coalesce(F.sum(F.when(F.col("role") == r, F.col(c))), F.lit(0))
    both = F.coalesce(F.sum("more"), F.lit(0))
    t = turns.groupBy("session_id").agg(
        F.count("*").alias("n_turns"),
        F.avg(usable).alias("latency_mean"),
        *([F.median(usable).alias("latency_median")] if width is None else []),
        F.stddev_samp(usable).alias("latency_sd"),
        F.count(usable).alias("n_latencies"),
        F.count(F.when(F.col("latency") < 0, 1)).alias("n_interruptions"),
        F.avg(mine).alias("subject_turn_duration_mean"),
        F.stddev_samp(mine).alias("subject_turn_duration_sd"),
        F.avg(theirs).alias("partner_turn_duration_mean"),
        of(SUBJECT, "spoken").alias("subject_time"),
        of(PARTNER, "spoken").alias("partner_time"),
        F.sum("spoken").alias("all_time"),
        both.alias("both_time"),
        (of(SUBJECT, "spoken") + of(PARTNER, "spoken") - both).alias("overlap_time"),
        of(SUBJECT, "n_pauses").alias("n_pauses"),
        (F.sum(F.when(F.col("role") == SUBJECT, F.col("pause"))) / unit).alias("__paused"),
    )
    if width is not None:
        middle = order_statistics(turns.select("session_id", usable.alias("__usable")), ["session_id"], "__usable", {"latency_median": 0.5})
        t = same_keys(t, middle.drop("n"), ["session_id"], "left")
    t = t.withColumn("pause_within_mean", F.when(F.col("n_pauses") > 0, F.col("__paused") / F.col("n_pauses")))
    s = durations.select("session_id", "duration").join(t, "session_id", "left")
    minutes = F.col("duration") / unit / 60
    per_minute = lambda n: F.when(F.col("duration") > 0, F.coalesce(F.col(n), F.lit(0)) / minutes)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    flags = F.array_compact(
        F.array(
            F.when(F.coalesce("n_turns", F.lit(0)) == 0, F.lit("no_turns")),
            F.when(F.coalesce("subject_time", F.lit(0)) == 0, F.lit("no_subject_speech")),
            F.when(F.coalesce("partner_time", F.lit(0)) == 0, F.lit("no_partner_speech")),
            F.when(F.coalesce("n_latencies", F.lit(0)) == 0, F.lit("no_usable_latency")),
        )
    )
    return s.select(
        "session_id",
        per_minute("n_turns").alias("turn__n_per_minute"),
        ratio("subject_time", "all_time").alias("turn__subject_speaking_ratio"),
        ratio("overlap_time", "both_time").alias("turn__overlap_ratio"),
        *[F.col(c).alias(f"turn__{c}") for c in ("latency_mean", "latency_median", "latency_sd")],
        per_minute("n_interruptions").alias("turn__interruption_rate"),
        *[F.col(c).alias(f"turn__{c}") for c in ("subject_turn_duration_mean", "subject_turn_duration_sd", "partner_turn_duration_mean", "pause_within_mean")],
        F.when(F.col("subject_time") > 0, F.coalesce("n_pauses", F.lit(0)) / (F.col("subject_time") / unit / 60)).alias("turn__pause_within_rate"),
        F.coalesce("n_turns", F.lit(0)).alias("qc__n_turns"),
        F.coalesce("n_latencies", F.lit(0)).alias("qc__n_latencies"),
        F.array_join(flags, ";").alias("qc__turn_flags"),
    )


def first_known_duration(*tables: DataFrame) -> DataFrame:
    """Duration by session from the first of the tables that has any row: a table is chosen, not a row."""
    found = next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])
    return found.select("session_id", "duration")


def budget_sample(segments: DataFrame, keys: list[str], least: float, budget: float) -> DataFrame:
    """The longest segments of each key up to a total budget, the last one cut to what is left."""
    length = F.col("end") - F.col("start")
    s = segments.withColumn("__length", length).where(F.col("__length") >= least)
    w = Window.partitionBy(*keys).orderBy(F.desc("__length"), "start", "end").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__before", F.coalesce(F.sum("__length").over(w), F.lit(0))).where(F.col("__before") < budget)
    taken = F.least(F.col("__length"), F.lit(budget) - F.col("__before"))
    return s.select(*keys, "start", (F.col("start") + taken).alias("end"), taken.alias("taken"))


def top_k(df: DataFrame, keys: list[str], score: str, ties: list[str], k: int) -> DataFrame:
    """The k best rows of each key; NaN and null scores come last, the first by ``ties`` wins."""
    known = F.when(F.isnan(score), None).otherwise(F.col(score))
    w = Window.partitionBy(*keys).orderBy(known.desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
