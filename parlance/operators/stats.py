"""Pooled, robust and window-dependent statistics, and the quality rows built on them.

Null means "no measure": every statistic of nothing is null, spreads need two values, and NaN is turned into null
on the way in (``clean``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import order_statistics, previous, same_keys, scan
from .spans import merge, points_by_kind


def clean(col: str | Column) -> Column:
    """NaN and infinite values as null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rate_per_minute(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / (seconds / 60))


def spread(value: str | Column, low: float, high: float) -> Column:
    """Distance of two percentiles (linear interpolation); null under two values."""
    v = clean(value)
    return F.when(F.count(v) >= 2, F.percentile(v, F.lit(high)) - F.percentile(v, F.lit(low)))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, approximate: int | None = None, long: bool = False) -> DataFrame:
    """Median, interquartile range, 5-95 range and 90th percentile; ``approximate`` sets the sketch's accuracy, ``long`` ranks the values of
    a key in several tasks (``order_statistics``)."""
    v = clean(value)
    if long or not keys:
        at = {"median": 0.5, "__q1": 0.25, "__q3": 0.75, "__low": 0.05, "__high": 0.95, "p90": 0.9}
        q = order_statistics(df, keys, v, at)
        two = lambda a, b: F.when(F.col("n") >= 2, F.col(a) - F.col(b))
        return q.select(*keys, "median", two("__q3", "__q1").alias("iqr"), two("__high", "__low").alias("range_90"), "p90")
    if approximate is not None:
        at = lambda p: F.percentile_approx(v, p, approximate)
        two = F.count(v) >= 2
        return df.groupBy(*keys).agg(at(0.5).alias("median"), F.when(two, at(0.75) - at(0.25)).alias("iqr"), F.when(two, at(0.95) - at(0.05)).alias("range_90"), at(0.9).alias("p90"))
    return df.groupBy(*keys).agg(F.median(v).alias("median"), spread(value, 0.25, 0.75).alias("iqr"), spread(value, 0.05, 0.95).alias("range_90"), F.percentile(v, F.lit(0.9)).alias("p90"))


def mean_abs_delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: float | None = None) -> DataFrame:
    """Mean absolute step between consecutive known values of each key's pooled sequence; ``width`` cuts the first column of
    ``order`` into buckets, so that a very long sequence is scanned in several tasks (``order`` then has no ties)."""
    s = df.select(*keys, *order, clean(value).alias("__v")).where("__v IS NOT NULL")
    s = previous(s, keys, order, {"__prev": "__v"}, None if width is None else F.floor(F.col(order[0]) / width))
    s = s.withColumn("__step", F.abs(F.col("__v") - F.col("__prev")))
    return s.groupBy(*keys).agg(F.avg("__step").alias("mean_abs_delta"))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Mean weighted by positive, finite weights over known values."""
    v, w = clean(value), clean(weight)
    ok = v.isNotNull() & (w > 0)
    return F.sum(F.when(ok, v * w)) / F.sum(F.when(ok, w))


def semitones(df: DataFrame, keys: Sequence[str], value: str = "f0") -> DataFrame:
    """Add ``semitone``: 12 log2 of positive values over their key's median."""
    v = F.when(clean(value) > 0, clean(value))
    mid = df.groupBy(*keys).agg(F.median(v).alias("__reference"))
    out = df.join(mid, list(keys), "left")
    return out.withColumn("semitone", 12 * F.log2(v / F.col("__reference"))).drop("__reference")


def prosody_features(frames: DataFrame, spans: DataFrame, order: Sequence[str]) -> DataFrame:
    """Twelve features per session of pitch / level frames (session_id, *order, f0, intensity, hnr) and of measured
    spans (session_id, duration, jitter, shimmer, n_peaks)."""
    key = ["session_id"]
    f = semitones(frames, key)
    hnr = F.when(clean("hnr") > -200, clean("hnr"))
    by = f.groupBy(*key).agg(
        F.stddev_samp("semitone").alias("f0_semitone_sd"),
        spread("semitone", 0.25, 0.75).alias("f0_semitone_iqr"),
        spread("semitone", 0.05, 0.95).alias("f0_semitone_range"),
        (F.count("semitone") / F.count("*")).alias("voiced_fraction"),
        F.avg(clean("intensity")).alias("intensity_mean_db"),
        F.stddev_samp(clean("intensity")).alias("intensity_sd_db"),
        spread("intensity", 0.05, 0.95).alias("intensity_range_db"),
        F.avg(hnr).alias("hnr_db"),
    )
    delta = mean_abs_delta(f, key, order, "semitone").withColumnRenamed("mean_abs_delta", "f0_semitone_mean_abs_delta")
    per = spans.groupBy(*key).agg(
        weighted_mean("jitter", "duration").alias("jitter_local"),
        weighted_mean("shimmer", "duration").alias("shimmer_local"),
        F.when(F.sum("duration") > 0, F.sum("n_peaks") / F.sum("duration")).alias("speech_rate_proxy"),
    )
    out = by.join(delta, key, "left").join(per, key, "left")
    return out.select("session_id", *[F.col(c).alias(f"prosody__{c}") for c in out.columns if c != "session_id"])


def peak_candidates(frames: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, below_top: float, width: float | None = None) -> DataFrame:
    """Local maxima (over the last, not under the next) that reach the key's top less ``below_top``; ``width`` as in ``mean_abs_delta``."""
    if width is not None:
        row, bucket = F.struct(F.col(value).alias("v")), F.floor(F.col(order[0]) / width)
        f = scan(frames, keys, order, bucket, {"__prev": ("last", row), "__next": ("next", row), "place": ("sum", F.lit(1))})
        top = frames.groupBy(*keys).agg(F.max(value).alias("__top"))
        v = F.col(value)
        f = f.join(top, list(keys)).where((v > F.col("__prev.v")) & (v >= F.col("__next.v")) & (v >= F.col("__top") - below_top))
        return f.drop("__prev", "__next", "__top")
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.col(value)
    top = F.max(value).over(Window.partitionBy(*keys))
    f = frames.withColumns({"__prev": F.lag(value).over(w), "__next": F.lead(value).over(w), "__top": top, "place": F.row_number().over(w) - 1})
    f = f.where((v > F.col("__prev")) & (v >= F.col("__next")) & (v >= F.col("__top") - below_top))
    return f.drop("__prev", "__next", "__top")


def count_peaks(candidates: DataFrame, keys: Sequence[str], value: str, spacing: int) -> DataFrame:
    """Peaks of each key that stand ``spacing`` places apart; of nearer ones the louder stays and becomes the anchor.

    The rule depends on the last peak kept, so it folds over the ordered candidates of a key, which is to be one span.
    """
    in_order = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.col(value).cast("double").alias("v")))).alias("__c"))
    start = F.struct(F.lit(0).cast("long").alias("kept"), F.lit(None).cast("long").alias("last"), F.lit(0.0).alias("loud"))

    def step(acc: Column, c: Column) -> Column:
        apart = acc["last"].isNull() | (c["place"] - acc["last"] >= spacing)
        moves = apart | (c["v"] > acc["loud"])
        kept = acc["kept"] + F.when(apart, 1).otherwise(0)
        return F.struct(kept.cast("long").alias("kept"), F.when(moves, c["place"]).otherwise(acc["last"]).alias("last"), F.when(moves, c["v"]).otherwise(acc["loud"]).alias("loud"))

    return in_order.select(*keys, F.aggregate("__c", start, step)["kept"].alias("n_peaks"))


def _frames_by_state(frames: DataFrame, timeline: DataFrame, states: Sequence[str], width: float | None) -> DataFrame:
    """A row of ``frames`` with ``state`` for each state that holds it; one sweep finds all."""
    marks = {f"__in{i}": F.col("state") == s for i, s in enumerate(states)}
    p = points_by_kind(frames, timeline, ["session_id"], marks, width=width)
    held = F.array_compact(F.array(*[F.when(F.col(f"__in{i}"), F.lit(s)) for i, s in enumerate(states)]))
    return p.withColumn("state", F.explode(held)).drop(*marks)


def _covered_by_state(got: DataFrame, timeline: DataFrame, states: Sequence[str], aggs: Sequence[Column] = (), measured: str = "detected") -> DataFrame:
    long = timeline.where(F.col("state").isin(*states)).groupBy("session_id", "state").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    n = got.groupBy("session_id", "state").agg(F.count("*").alias("n_frames"), F.count_if(F.col(measured)).alias("n_measured"), *aggs)
    n = long.join(n, ["session_id", "state"], "left").fillna(0, ["n_frames", "n_measured"])
    share = F.when(F.col("n_frames") > 0, F.col("n_measured") / F.col("n_frames"))
    return n.withColumn("fraction", share).withColumn("measured_length", F.coalesce(F.col("length") * share, F.lit(0.0)))


def window_coverage(frames: DataFrame, timeline: DataFrame, states: Sequence[str], measured: str = "detected", width: float | None = None) -> DataFrame:
    """Per session and state: frames in its time, those measured, its length and the measured share of it."""
    got = _frames_by_state(frames, timeline, states, width)
    return _covered_by_state(got, timeline, states, measured=measured).select("session_id", "length", "n_frames", "n_measured", "state", "fraction", "measured_length")


def window_summary(frames: DataFrame, timeline: DataFrame, plan: dict[str, Sequence[str]], states: Sequence[str], least: float, width: float | None = None) -> DataFrame:
    """One row per session of ``<state>__<measure>_<stat>`` by a per-measure plan (mean, sd, p90).

    A state with less measured time than ``least`` gives nulls; sessions without a frame in any state have no row. Missing
    measures are null in ``frames``. Frames meet the timeline once, for coverage and values of all states.
    """
    stat = {"mean": F.avg, "sd": F.stddev_samp, "p90": lambda c: F.percentile(c, F.lit(0.9))}
    names = [f"{m}_{s}" for m, stats in plan.items() for s in stats]
    aggs = [stat[s](clean(m)).alias(f"{m}_{s}") for m, stats in plan.items() for s in stats]
    by = _covered_by_state(_frames_by_state(frames, timeline, states, width), timeline, states, aggs).where("n_frames > 0")
    by = by.select("session_id", "state", *[F.when(F.col("measured_length") >= least, F.col(n)).alias(n) for n in names])
    wide = by.groupBy("session_id").pivot("state", list(states)).agg(*[F.first(n).alias(n) for n in names])
    return wide.select("session_id", *[F.col(f"{s}_{n}").alias(f"{s}__{n}") for s in states for n in names])


def dropped_fraction(frames: DataFrame, keys: Sequence[str], detected: str = "detected") -> DataFrame:
    return frames.groupBy(*keys).agg((1 - F.avg(F.col(detected).cast("double"))).alias("dropped_fraction"))


def channel_stats(samples: DataFrame, keys: Sequence[str], floor: float) -> DataFrame:
    """Two-channel statistics in one partial and final aggregation: samples, active ones (either side at the
    floor or over), their correlation, level of each side, peaks, level difference and whether both are equal."""
    left, right = F.col("left"), F.col("right")
    active = (F.abs(left) >= floor) | (F.abs(right) >= floor)
    level = lambda c: F.sqrt(F.avg(c * c))
    c = samples.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(active).alias("n_active"),
        F.corr(F.when(active, left), F.when(active, right)).alias("correlation"),
        level(left).alias("rms_left"),
        level(right).alias("rms_right"),
        F.max(F.abs(left)).alias("peak_left"),
        F.max(F.abs(right)).alias("peak_right"),
        F.bool_and(left == right).alias("identical"),
    )
    c = c.withColumn("correlation", F.greatest(F.least("correlation", F.lit(1.0)), F.lit(-1.0)))
    both = (F.col("rms_left") > 0) & (F.col("rms_right") > 0)
    return c.withColumn("level_difference_db", F.when(both, 20 * F.log10(F.col("rms_left") / F.col("rms_right"))))


def down_mix(samples: DataFrame) -> DataFrame:
    """Add ``mono``: the mean of both sides; a single side passes through."""
    return samples.withColumn("mono", F.coalesce((F.col("left") + F.col("right")) / 2, F.col("left"), F.col("right")))


def audio_qc(decoded: DataFrame, expected: DataFrame, most_shortfall: float = 0.02, quiet: float = 0.01) -> DataFrame:
    """Per session: decoded and expected duration, the share that is missing, level, and flags.

    ``decoded``: (session_id, duration, rms, peak); sessions that were never decoded keep a row.
    """
    e = expected.select("session_id", F.col("duration").alias("expected"))
    d = e.join(decoded.select("session_id", F.col("duration").alias("decoded"), "rms", "peak"), "session_id", "left")
    short = F.when((F.col("expected") > 0) & F.col("decoded").isNotNull(), F.greatest((F.col("expected") - F.col("decoded")) / F.col("expected"), F.lit(0.0)))
    d = d.withColumn("shortfall", short)
    tests = [(F.col("decoded").isNull(), "not_decoded"), (F.col("shortfall") > most_shortfall, "short_audio"), (F.col("rms") < quiet, "quiet"), (F.col("peak") >= 1, "clipped")]
    return d.withColumn("flags", flags(tests))


def tallies(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per value of a column, with the share among rows that have one."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("__total"))
    both = n.join(total, list(keys)) if keys else n.crossJoin(F.broadcast(total))  # one row
    return both.select(*keys, "value", "n", (F.col("n") / F.col("__total")).alias("share"))


def channel_flags(same: float, quiet: float, uneven_db: float) -> Column:
    """Flags of a channel_stats row, in order."""
    tests = [
        (F.col("n_active") == 0, "silent"),
        (F.col("identical"), "identical_channels"),
        (~F.col("identical") & (F.col("correlation") >= same), "nearly_identical_channels"),
        (F.least("rms_left", "rms_right") < quiet, "quiet_channel"),
        (F.abs("level_difference_db") > uneven_db, "uneven_levels"),
    ]
    return flags(tests)


def flags(tests: Sequence[tuple[Column, str]]) -> Column:
    """The names of tests that hold, in order, joined with ';'."""
    return F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])), ";")


def robust_outliers(df: DataFrame, value: str, k: float, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``outlier``: further than k robust scales from the median of its group.

    The scale is 1.4826 MAD, or 1.2533 times the mean deviation where the MAD is 0; none under three values.
    """
    ks = list(keys)
    if not ks:
        return _outliers_of_all(df, value, k)
    mid = df.groupBy(*ks).agg(F.median(clean(value)).alias("__mid"), F.count(clean(value)).alias("__n"))
    meet = lambda d, g: d.join(g, ks, "left")
    off = F.abs(clean(value) - F.col("__mid"))
    dev = meet(df, mid).groupBy(*ks).agg(F.first("__n").alias("__n"), F.first("__mid").alias("__mid"), (1.4826 * F.median(off)).alias("__mad"), (1.2533 * F.avg(off)).alias("__dev"))
    scale = F.when(F.col("__n") >= 3, F.when(F.col("__mad") > 0, F.col("__mad")).when(F.col("__dev") > 0, F.col("__dev")))
    out = meet(df, dev.select(*ks, F.col("__mid"), scale.alias("__scale")))
    return out.withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("__mid")) / F.col("__scale") > k, F.lit(False))).drop("__mid", "__scale")


def _outliers_of_all(df: DataFrame, value: str, k: float) -> DataFrame:
    """``robust_outliers`` of the whole table as one group: its statistics are one row, found without one task for all values."""
    mid = order_statistics(df, [], clean(value), {"__mid": 0.5})
    off = df.select(clean(value).alias("__v")).crossJoin(F.broadcast(mid)).select("n", "__mid", F.abs(F.col("__v") - F.col("__mid")).alias("__off"))
    mad = order_statistics(off, [], "__off", {"__mad": 0.5}).drop("n")
    dev = off.agg(F.first("n").alias("__n"), F.first("__mid").alias("__mid"), (1.2533 * F.avg("__off")).alias("__dev")).crossJoin(mad)
    half = 1.4826 * F.col("__mad")
    scale = F.when(F.col("__n") >= 3, F.when(half > 0, half).when(F.col("__dev") > 0, F.col("__dev")))
    out = df.crossJoin(F.broadcast(dev.select("__mid", scale.alias("__scale"))))
    return out.withColumn("outlier", F.coalesce(F.abs(F.col(value) - F.col("__mid")) / F.col("__scale") > k, F.lit(False))).drop("__mid", "__scale")


def duration_flags(df: DataFrame, low: float, high: float, k: float, known: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Flags for durations outside [low, high], for outliers, and a marker of known cases where flagged."""
    d = robust_outliers(df, "duration", k, keys)
    found = F.array_compact(F.array(F.when(F.col("duration") < low, F.lit("short")), F.when(F.col("duration") > high, F.lit("long")), F.when(F.col("outlier"), F.lit("outlier"))))
    marked = F.when((F.size(found) > 0) & F.col("session_id").isin(list(known)), F.concat(found, F.array(F.lit("known")))).otherwise(found)
    return d.withColumn("flags", F.array_join(marked, ";"))


def diarization_qc(segments: DataFrame, durations: DataFrame, speakers: int = 2, least_coverage: float = 0.3, most_overlap: float = 0.25, text: str | None = None) -> DataFrame:
    """Per session: segments, speakers in order of first appearance, seconds, coverage, overlap share and flags; with a column
    ``text``, whether any segment has some, too."""
    first = segments.groupBy("session_id", "speaker").agg(F.min(F.struct("start", "end")).alias("at"))
    names = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "speaker"))).alias("s"))
    names = names.select("session_id", F.array_join("s.speaker", ",").alias("speakers"), F.size("s").alias("n_speakers"))
    total = segments.groupBy("session_id").agg(F.count("*").alias("n_segments"), F.sum(F.col("end") - F.col("start")).alias("total"))
    covered = merge(segments, ["session_id"]).groupBy("session_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    out = durations.join(total, "session_id", "left").join(names, "session_id", "left").join(covered, "session_id", "left")
    out = out.withColumn("coverage", F.when(F.col("duration") > 0, F.col("covered") / F.col("duration")))
    out = out.withColumn("overlap_share", F.when(F.col("total") > 0, F.greatest(F.col("total") - F.col("covered"), F.lit(0)) / F.col("total")))
    tests = [
        (F.coalesce("n_speakers", F.lit(0)) != speakers, "speaker_count"),
        (F.coalesce("coverage", F.lit(0.0)) < least_coverage, "low_coverage"),
        (F.col("overlap_share") > most_overlap, "much_overlap"),
    ]
    if text is not None:
        some = segments.groupBy("session_id").agg(F.coalesce(F.bool_or(F.col(text) != ""), F.lit(False)).alias("has_text"))
        out = out.join(some, "session_id", "left").fillna(False, ["has_text"])
        tests.append((~F.col("has_text"), "no_text"))
    return out.withColumn("flags", flags(tests)).drop("duration")


def speech_qc(segments: DataFrame, speech: DataFrame, least: float = 0.35) -> DataFrame:
    """Per session: time in segments, in detected speech within them, the share retained and a flag."""
    length = F.sum(F.col("end") - F.col("start"))
    a = merge(segments, ["session_id"]).groupBy("session_id").agg(length.alias("segment_time"))
    b = merge(speech, ["session_id"]).groupBy("session_id").agg(length.alias("speech_time"))
    out = a.join(b, "session_id", "left").fillna(0, ["speech_time"])
    out = out.withColumn("retained", F.when(F.col("segment_time") > 0, F.col("speech_time") / F.col("segment_time")))
    return out.withColumn("flags", flags([(F.col("retained") < least, "little_speech")]))


def frame_qc(frames: DataFrame, probes: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Per session: frames, dropped share, mean confidence of detected ones, and whether each probe stays near its first."""
    first = frames.groupBy("session_id").agg(*[F.min_by(p, "frame_index").alias(f"__{p}") for p in probes])
    f = frames.join(first, "session_id")
    return f.groupBy("session_id").agg(
        F.count("*").alias("n_frames"),
        (1 - F.avg(F.col("detected").cast("double"))).alias("dropped_fraction"),
        F.avg(F.when(F.col("detected"), clean("confidence"))).alias("confidence_mean"),
        *[(F.max(F.abs(F.col(p) - F.col(f"__{p}"))) <= tolerance).alias(f"stable_{p}") for p in probes],
    )


def constant_features(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(feature, low, high) of columns whose known values are all the same, in one aggregation."""
    one = df.agg(*[f(clean(F.col(c).cast("double"))).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo_{i}").alias("low"), F.col(f"hi_{i}").alias("high")) for i, c in enumerate(columns)]))
    return one.select(rows.alias("r")).select("r.*").where(F.col("high") - F.col("low") <= tolerance)


def flag_counts(df: DataFrame, column: str = "flags") -> DataFrame:
    """Rows per flag of a ';'-joined column, with the sessions that have it."""
    f = df.where(F.col(column) != "").select("session_id", F.explode(F.split(column, ";")).alias("flag"))
    return f.groupBy("flag").agg(F.count_distinct("session_id").alias("n_sessions"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of known values per row, summed up as least, median and greatest, and per column."""
    known = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    share = sum(known[1:], known[0]) / F.lit(len(columns))
    one = df.agg(
        F.count("*").alias("n_rows"),
        F.min(share).alias("row_min"),
        F.max(share).alias("row_max"),
        *[F.avg(k.cast("double")).alias(f"known_{c}") for k, c in zip(known, columns)],
    )
    # a row has one of len(columns) + 1 shares, so the median is read off their counts
    counts = df.groupBy(share.alias("__share")).agg(F.count("*").alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(Window.orderBy("__share")))
    places = one.select(F.explode(F.array(F.floor((F.col("n_rows") + 1) / 2), F.ceil((F.col("n_rows") + 1) / 2))).alias("__place"))
    middle = places.crossJoin(F.broadcast(upto)).where((F.col("__place") <= F.col("__upto")) & (F.col("__place") > F.col("__upto") - F.col("__n"))).agg(F.avg("__share").alias("row_median"))
    both = one.crossJoin(F.broadcast(middle))
    return both.select("n_rows", "row_min", "row_median", "row_max", *[f"known_{c}" for c in columns])


def recurring_labels(labels: DataFrame, fraction: float, least: int = 2) -> DataFrame:
    """Labels of (session_id, label) that occur in at least max(least, round(fraction x sessions)) sessions.

    Ranked by falling document frequency, then label, and named by opaque keys A, B, ... The rounding is half
    to even.
    """
    d = labels.dropDuplicates(["session_id", "label"])
    n = labels.agg(F.count_distinct("session_id").alias("__sessions"))
    df = d.groupBy("label").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    df = df.where(F.col("df") >= F.greatest(F.lit(least), F.bround(F.lit(fraction) * F.col("__sessions")).cast("long")))
    # what is left is at most 1 / fraction labels per line of a session
    w = Window.orderBy(F.desc("df"), "label")
    df = df.withColumn("rank", F.row_number().over(w))
    key = F.when(F.col("rank") <= 26, F.char(F.lit(64) + F.col("rank"))).otherwise(F.concat(F.char(F.lit(64) + F.floor((F.col("rank") - 1) / 26)), F.char(F.lit(65) + (F.col("rank") - 1) % 26)))
    return df.select(key.alias("key"), "label", "df", "rank")


def indicator_correlation(samples: DataFrame, spans: DataFrame, keys: Sequence[str], tile: str, value: str, t: str = "t", width: float | None = None) -> DataFrame:
    """Correlation of each tile's values with whether each speaker speaks; null where either hardly varies. ``keys`` hold session_id.

    Times at which anybody starts or ends cut a session into stretches in which the same speakers speak. One sweep gives each sample its
    stretch, and the samples of a stretch and tile become a count, a mean and a sum of squares; only these meet the speakers. ``width``
    cuts a very long session into buckets for the sweep.
    """
    if "session_id" not in keys:
        raise ValueError("keys must hold session_id")
    ks = list(keys)
    m = merge(spans, ["session_id", "speaker"], width=width)
    times = m.select("session_id", F.explode(F.array("start", "end")).alias("__t")).distinct()
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*ks, tile, value])])
    p = samples.select("session_id", F.col(t).alias("__t"), F.lit(1).alias("__kind"), row.alias("__row"))
    p = p.unionByName(times.select("session_id", "__t", F.lit(0).alias("__kind"), F.lit(None).cast(p.schema["__row"].dataType).alias("__row")))
    # a sample belongs to the last time at or before it, and so does a time itself
    if width is None:
        upto = Window.partitionBy("session_id").orderBy("__t", "__kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        p = p.withColumn("__stretch", F.sum(1 - F.col("__kind")).over(upto))
    else:
        p = p.withColumn("__one", F.monotonically_increasing_id())
        p = scan(p, ["session_id"], ["__t", "__kind", "__one"], F.floor(F.col("__t") / width), {"__before": ("sum", 1 - F.col("__kind"))})
        p = p.withColumn("__stretch", F.col("__before") + 1 - F.col("__kind")).drop("__one")
    v = clean(F.col(f"__row.{value}").cast("double"))
    a = p.where("__kind = 1").groupBy(*[F.col(f"__row.{c}").alias(c) for c in ks], F.col(f"__row.{tile}").alias(tile), "__stretch")
    a = a.agg(F.count("*").alias("__rows"), F.count(v).alias("__n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("__m"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("__q"))
    mean = a.groupBy(*ks, tile).agg((F.sum(F.col("__n") * F.col("__m")) / F.sum("__n")).alias("__mean"))
    a = same_keys(a, mean, [*ks, tile]).withColumn("__off", F.col("__m") - F.col("__mean"))
    whole = a.groupBy(*ks, tile).agg(F.sum("__rows").alias("n"), F.sum("__n").alias("__known"), F.sum(F.col("__q") + F.col("__n") * F.col("__off") * F.col("__off")).alias("__squares"))
    # the stretches of a speaker's spans: from that of its start to that before its end
    at = times.withColumn("__stretch", F.row_number().over(Window.partitionBy("session_id").orderBy("__t")))  # the count of times up to it
    ends = m.join(at.withColumnsRenamed({"__t": "start", "__stretch": "__from"}), ["session_id", "start"]).join(at.withColumnsRenamed({"__t": "end", "__stretch": "__to"}), ["session_id", "end"])
    on = ends.select("session_id", "speaker", F.explode(F.sequence("__from", F.col("__to") - 1)).alias("__stretch"))
    on = a.join(on, ["session_id", "__stretch"]).groupBy(*ks, "speaker", tile)
    on = on.agg(F.sum("__rows").alias("__on_rows"), F.sum("__n").alias("__on"), F.sum(F.col("__n") * F.col("__off")).alias("__cross"))
    out = same_keys(whole.join(spans.select("session_id", "speaker").distinct(), "session_id"), on, [*ks, "speaker", tile], "left").fillna(0, ["__on_rows", "__on", "__cross"])
    share = F.col("__on_rows") / F.col("n")
    enough = (share * (1 - share) >= 1e-9) & (F.col("__squares") / F.col("__known") >= 1e-9)
    spread_on = F.col("__on") - F.col("__on") * F.col("__on") / F.col("__known")
    return out.select(*ks, "speaker", tile, F.when(enough & (spread_on > 0), F.col("__cross") / F.sqrt(F.col("__squares") * spread_on)).alias("corr"), "n")


def best_tile(corr: DataFrame, tile: str, least: float = 0.15, lead: float = 0.10) -> DataFrame:
    """The tile of each speaker that moves with their speech, where it is clear enough."""
    w = Window.partitionBy("session_id", "speaker").orderBy(F.desc_nulls_last("corr"), tile)
    r = corr.withColumns({"__rank": F.row_number().over(w), "__next": F.lead("corr").over(w)}).where("__rank = 1")
    clear = (F.col("corr") >= least) & (F.coalesce(F.col("corr") - F.col("__next"), F.lit(lead)) >= lead)
    return r.select("session_id", "speaker", F.when(clear, F.col(tile)).alias(tile), "corr")


def prosody_qc(spans: DataFrame, least_seconds: float, role_sources: DataFrame | None = None) -> DataFrame:
    """Per session of measured spans: seconds, spans analysed and failed, voiced frames, reference and flags, among them
    that the roles (``role_sources``: session_id, source) are hand-written."""
    q = spans.groupBy("session_id").agg(
        F.sum("duration").alias("analysed_seconds"),
        F.count_if(~F.col("failed")).alias("n_spans"),
        F.count_if(F.col("failed")).alias("n_failed"),
        F.sum("n_voiced").alias("n_voiced"),
        F.median("reference").alias("reference_hz"),
    )
    tests = [(F.col("analysed_seconds") < least_seconds, "little_speech"), (F.col("n_voiced") == 0, "none_voiced"), (F.col("n_failed") > 0, "failed_spans")]
    if role_sources is None:
        return q.withColumn("flags", flags(tests))
    manual = role_sources.groupBy("session_id").agg(F.bool_or(F.col("source") == "manual").alias("__manual"))
    q = q.join(manual, "session_id", "left")
    return q.withColumn("flags", flags([*tests, (F.coalesce("__manual", F.lit(False)), "manual_roles")])).drop("__manual")


def region_tallies(lines: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Recognised lines (keys, pos, label, confidence) of each region: seen, sure, usable, best, and distinct
    usable labels in order of first appearance."""
    sure = F.col("confidence") >= least
    usable = sure & (F.col("label") != "")
    one = lines.where(usable).groupBy(*keys, "label").agg(F.min("pos").alias("at"))
    names = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("s"))
    names = names.select(*keys, F.array_join("s.label", "|").alias("labels"))
    t = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(sure).alias("n_sure"), F.count_if(usable).alias("n_usable"), F.max("confidence").alias("confidence_max"))
    return t.join(names, list(keys), "left").fillna("", ["labels"])


def stage_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(measure, n, low, median, high) of the known values of numeric columns."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(rows.alias("r")).select("r.measure", clean("r.v").alias("v"))
    return order_statistics(long, ["measure"], "v", {"low": 0.0, "median": 0.5, "high": 1.0}).select("measure", "n", "low", "median", "high")
