"""Interval algebra on DataFrames of half-open spans [start, end).

A set of spans is rows: key columns, ``start`` and ``end`` (microseconds as BIGINT, or seconds as DOUBLE with
``eps=1e-9``). Nothing compares spans pairwise: every operator sorts the ends of spans within a key and sweeps
them with window functions, so the cost is n log n whatever the overlap. ``width`` cuts a very long
key into time buckets that are swept apart and joined again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import previous, scan

Keys = Sequence[str]


def normalise(spans: DataFrame, eps: float = 0) -> DataFrame:
    """Drop spans that are not longer than eps."""
    return spans.where(F.col("end") - F.col("start") > eps)


def merge(spans: DataFrame, keys: Keys, gap: float = 0, eps: float = 0, width: float | None = None) -> DataFrame:
    """Union of the spans of each key, bridging gaps of at most ``gap``; ``n_spans`` counts the spans merged.

    Touching spans merge. With ``width``, spans are merged within buckets of their start first, and what is left of a bucket meets
    what the buckets before it reach to by a segmented scan, so one very long key is no one task's.
    """
    counted = "n_spans" in spans.columns
    n = F.col("n_spans") if counted else F.lit(1).cast("long")
    s = normalise(spans, eps).select(*keys, "start", "end", n.alias("n_spans"))
    if width is not None:
        s = s.withColumn("__bucket", F.floor(F.col("start") / width))
        s = _islands(s, [*keys, "__bucket"], gap, eps).drop("__bucket")
        return _scanned_islands(s, list(keys), gap, eps, width)
    return _islands(s, list(keys), gap, eps)


def _islands(s: DataFrame, keys: list[str], gap: float, eps: float) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") - reach > gap + eps), 1).otherwise(0)
    s = s.withColumn("__opens", opens)
    s = s.withColumn("__island", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = s.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_spans").alias("n_spans"))
    return out.drop("__island")


def _scanned_islands(s: DataFrame, keys: list[str], gap: float, eps: float, width: float) -> DataFrame:
    """``_islands`` of spans of which no two of a key start together."""
    bucket = F.floor(F.col("start") / width)
    s = scan(s, keys, ["start"], bucket, {"__reach": ("max", F.col("end"))})
    s = s.withColumn("__opens", F.when(F.col("__reach").isNull() | (F.col("start") - F.col("__reach") > gap + eps), 1).otherwise(0))
    s = scan(s, keys, ["start"], bucket, {"__before": ("sum", F.col("__opens"))}).withColumn("__island", F.col("__before") + F.col("__opens"))
    out = s.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_spans").alias("n_spans"))
    return out.drop("__island")


def cut(spans: DataFrame, width: float) -> DataFrame:
    """Cut spans at multiples of ``width``; column ``__bucket`` numbers the pieces' buckets."""
    first = F.floor(F.col("start") / width)
    last = F.greatest(F.ceil(F.col("end") / width) - 1, first)
    s = spans.withColumn("__bucket", F.explode(F.sequence(first, last)))
    edge = F.col("__bucket") * width
    kind = spans.schema["start"].dataType
    start, end = F.greatest("start", edge).cast(kind), F.least("end", edge + width).cast(kind)
    return s.withColumns({"start": start, "end": end})


def levels(spans: DataFrame, keys: Keys, marks: dict[str, Column], eps: float = 0, width: float | None = None) -> DataFrame:
    """Stretches (keys, start, end) between neighbouring ends of spans, with how many spans of each mark are open in them.

    One pass: the ends of all spans are added up per time, and running sums over them count what is open.
    """
    ks = list(keys)
    s = normalise(spans, eps)
    s = s.select(*ks, "start", "end", *[F.when(m, 1).otherwise(0).alias(n) for n, m in marks.items()])
    s = cut(s, width) if width is not None else s.withColumn("__bucket", F.lit(0).cast("long"))
    ends = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"))))
    per = [*ks, "__bucket"]
    e = s.select(*per, *marks, ends.alias("x")).groupBy(*per, F.col("x.t").alias("t")).agg(*[F.sum(F.col(n) * F.col("x.d")).alias(n) for n in marks])
    w = Window.partitionBy(*per).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*ks, F.col("t").alias("start"), F.lead("t").over(w).alias("end"), *[F.sum(n).over(upto).alias(n) for n in marks])
    return e.where(F.col("end") - F.col("start") > eps)


def _sweep(left: DataFrame, right: DataFrame, keys: Keys, wanted: Column, eps: float, width: float | None) -> DataFrame:
    """Stretches where ``wanted`` holds of the numbers of left and right spans (l, r) that are open."""
    sides = [df.select(*keys, "start", "end", F.lit(name).alias("__side")) for df, name in ((left, "l"), (right, "r"))]
    marks = {n: F.col("__side") == n for n in ("l", "r")}
    pieces = levels(sides[0].unionByName(sides[1]), keys, marks, eps, width).where(wanted)
    return merge(pieces.select(*keys, "start", "end"), keys, 0, eps, width).drop("n_spans")


def intersect(left: DataFrame, right: DataFrame, keys: Keys, eps: float = 0, width: float | None = None) -> DataFrame:
    """Time that both sides cover, as disjoint spans."""
    return _sweep(left, right, keys, (F.col("l") > 0) & (F.col("r") > 0), eps, width)


def subtract(left: DataFrame, right: DataFrame, keys: Keys, eps: float = 0, width: float | None = None) -> DataFrame:
    """Time that the left side covers and the right does not."""
    return _sweep(left, right, keys, (F.col("l") > 0) & (F.col("r") <= 0), eps, width)


def gaps(spans: DataFrame, keys: Keys, least: float = 0, eps: float = 0, width: float | None = None) -> DataFrame:
    """Gaps between consecutive merged spans that are longer than ``least``."""
    bucket = None if width is None else F.floor(F.col("start") / width)
    m = previous(merge(spans, keys, 0, eps, width), keys, ["start"], {"gap_start": "end"}, bucket)
    m = m.select(*keys, "gap_start", F.col("start").alias("gap_end"))
    m = m.where(F.col("gap_end") - F.col("gap_start") > max(least, eps))
    return m.select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def clip(spans: DataFrame, extents: DataFrame, keys: Keys, eps: float = 0) -> DataFrame:
    """Spans cut to the extent (extent_start, extent_end) of their key."""
    s = spans.join(extents.select(*keys, "extent_start", "extent_end"), list(keys))
    s = s.withColumns({"start": F.greatest("start", "extent_start"), "end": F.least("end", "extent_end")})
    return normalise(s.drop("extent_start", "extent_end"), eps)


def invert(spans: DataFrame, extents: DataFrame, keys: Keys, eps: float = 0, width: float | None = None) -> DataFrame:
    """What the extent of each key has beside its spans."""
    whole = extents.select(*keys, F.col("extent_start").alias("start"), F.col("extent_end").alias("end"))
    return subtract(whole, spans, keys, eps, width)


def durations(left: DataFrame, right: DataFrame, keys: Keys, eps: float = 0) -> DataFrame:
    """Per key: total and covered duration of the left spans, and how long they overlap the right ones."""
    length = F.sum(F.col("end") - F.col("start"))
    total = left.groupBy(*keys).agg(length.alias("total"))
    covered = merge(left, keys, 0, eps).groupBy(*keys).agg(length.alias("covered"))
    overlap = intersect(left, right, keys, eps).groupBy(*keys).agg(length.alias("overlap"))
    out = total.join(covered, list(keys), "left").join(overlap, list(keys), "left")
    return out.fillna(0, ["covered", "overlap"])


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict overlap: touching spans do not overlap."""
    return (s1 < e2) & (s2 < e1)


def contains(start: Column, end: Column, t: Column) -> Column:
    """Half-open point test."""
    return (start <= t) & (t < end)


def points_by_kind(points: DataFrame, spans: DataFrame, keys: Keys, kinds: dict[str, Column], t: str = "t", eps: float = 0, width: float | None = None) -> DataFrame:
    """All points with a column for each kind: whether any span of their key and of that kind contains them.

    An as-of join on the merged spans: starts and points are sorted together, starts first at equal times, and the last start of
    each kind before a point is carried forward; no range join is planned, and all kinds share one sort. ``width`` cuts the
    spans of a very long key into time buckets, which are swept apart.
    """
    ks = list(keys)
    one = spans.withColumn("__kind", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))))
    m = merge(one, [*ks, "__kind"], 0, eps, width)
    m = cut(m, width) if width is not None else m.withColumn("__bucket", F.lit(0).cast("long"))
    point = F.struct(*[F.col(c) for c in points.columns])
    bucket = F.floor(F.col(t) / width) if width is not None else F.lit(0).cast("long")
    p = points.select(*ks, bucket.alias("__bucket"), F.col(t).alias("__t"), F.lit(1).alias("__order"), F.lit(None).cast("string").alias("__kind"), F.lit(None).cast(m.schema["end"].dataType).alias("__end"), point.alias("__point"))
    s = m.select(*ks, "__bucket", F.col("start").alias("__t"), F.lit(0).alias("__order"), "__kind", F.col("end").alias("__end"), F.lit(None).cast(p.schema["__point"].dataType).alias("__point"))
    w = Window.partitionBy(*ks, "__bucket").orderBy("__t", "__order").rowsBetween(Window.unboundedPreceding, 0)
    reach = {k: F.last(F.when(F.col("__kind") == k, F.col("__end")), ignorenulls=True).over(w) for k in kinds}
    both = p.unionByName(s).withColumns({f"__reach{i}": r for i, r in enumerate(reach.values())})
    inside = [F.coalesce(F.col("__t") < F.col(f"__reach{i}"), F.lit(False)).alias(k) for i, k in enumerate(kinds)]
    return both.where("__order = 1").select("__point.*", *inside)


def points_in_spans(points: DataFrame, spans: DataFrame, keys: Keys, t: str = "t", eps: float = 0, width: float | None = None) -> DataFrame:
    """All points with ``inside``: whether any span of their key contains them (``points_by_kind``)."""
    return points_by_kind(points, spans, keys, {"inside": F.lit(True)}, t, eps, width)


def shift(spans: DataFrame, offset: Column) -> DataFrame:
    return spans.withColumns({"start": F.col("start") + offset, "end": F.col("end") + offset})


def refine_by_intersection(segments: DataFrame, speech: DataFrame, eps: float = 0) -> DataFrame:
    """Segments per (session, speaker) reduced to the session's detected speech."""
    who = segments.select("session_id", "speaker").distinct()
    spread = speech.select("session_id", "start", "end").join(who, "session_id")
    return intersect(segments, spread, ["session_id", "speaker"], eps)


def refine_by_shift(segments: DataFrame, detections: DataFrame, eps: float = 0) -> DataFrame:
    """Detections local to a segment, moved to the segment's place, clipped to it and merged per speaker."""
    where = segments.select("segment_id", "session_id", "speaker", F.col("start").alias("__from"), F.col("end").alias("__to"))
    d = shift(detections.join(where, "segment_id"), F.col("__from"))
    d = d.withColumns({"start": F.greatest("start", "__from"), "end": F.least("end", "__to")})
    return merge(d.select("session_id", "speaker", "start", "end"), ["session_id", "speaker"], 0, eps).drop("n_spans")


def speaker_overlap(segments: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session: total and covered time over all speakers, and their difference (never below 0)."""
    total = segments.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    covered = merge(segments, [key]).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    out = total.join(covered, key, "left").fillna(0, ["covered"])
    return out.withColumn("overlap", F.greatest(F.col("total") - F.col("covered"), F.lit(0)))
