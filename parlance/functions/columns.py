"""Column functions: labels, names, vectors, poses and schedules."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_label(c: Column) -> Column:
    """Lower case, with everything but ASCII letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +", " "))


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalise_label(c: Column) -> Column:
    """Compatibility form, case folded, punctuation as single blanks. Texts in ASCII stay in the JVM."""
    plain = F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(_compatible(c))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N} ]+", " "), " +", " "))


def canonical_speaker(c: Column, index: Column) -> Column:
    """SPEAKER_nn from the first run of digits, or from the index where there is none."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    n = F.when(digits != "", digits.cast("long")).otherwise(index.cast("long"))
    return F.format_string("SPEAKER_%02d", n)


def normalise_name(c: Column, prefix: str = "text__") -> Column:
    """Lower case, other characters than letters and digits as single underscores, with a prefix."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def parse_number(c: Column) -> Column:
    """A number, or null for anything else (NaN included)."""
    n = F.trim(c).try_cast("double")
    return F.when(~F.isnan(n), n)


def parse_flag(c: Column) -> Column:
    """true / yes / 1 and false / no / 0 in any case; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "t", "yes", "y", "1"), True).when(t.isin("false", "f", "no", "n", "0"), False)


def combine_present(columns: Sequence[Column]) -> Column:
    """Mean of the values that are there; null if none is."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns[1:]), F.when(columns[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def head_pose(r: Sequence[Sequence[Column]]) -> dict[str, Column]:
    """Pitch, yaw and roll in degrees of a rotation Rz Ry Rx; null near the gimbal lock or without finite entries."""
    sin_yaw = -r[2][0]
    finite = F.lit(True)
    for row in r:
        for c in row:
            finite = finite & F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    ok = finite & (F.abs(sin_yaw) < 1 - 1e-6)
    values = {"pitch": F.atan2(r[2][1], r[2][2]), "yaw": F.asin(F.least(F.greatest(sin_yaw, F.lit(-1.0)), F.lit(1.0))), "roll": F.atan2(r[1][0], r[0][0])}
    return {f"head_{k}": F.when(ok, F.degrees(v)) for k, v in values.items()}


def sample_times(wanted: Column, duration: Column) -> Column:
    """The wanted times if all lie in the first 95 % of the duration, else as many spread evenly; no repeats."""
    n = F.size(wanted)
    spread = F.transform(F.sequence(F.lit(1), n), lambda i: F.round(i * duration / (n + 1), 3))
    fits = F.forall(wanted, lambda t: t <= 0.95 * duration)
    return F.array_distinct(F.when(n == 0, wanted).when(fits, wanted).otherwise(spread))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def session_ids(spec: Column) -> Column:
    """Ids of a list such as "3,17,1-5", in order, without repeats; bad parts are null and left out."""

    def part(p: Column) -> Column:
        lo = F.regexp_extract(p, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1)
        hi = F.regexp_extract(p, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 2)
        a = lo.try_cast("long")
        b = F.when(hi == "", a).otherwise(hi.try_cast("long"))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(F.split(spec, ","), part)))
