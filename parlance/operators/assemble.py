"""Selection, guards and assembly: joins that keep every session, upserts, contracts and leak guards."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as fn
from . import spans as sp
from .scans import order_statistics, previous

# ---------------------------------------------------------------- selection


def select_sessions(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_id, position, found) of wanted ids (position, session_id) in asked order, each once."""
    w = wanted.groupBy("session_id").agg(F.min("position").alias("position"))
    known = sessions.select("session_id").distinct().withColumn("__here", F.lit(True))
    return w.join(known, "session_id", "left").select("session_id", "position", F.coalesce("__here", F.lit(False)).alias("found"))


def expand_specs(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Rows (position, session_id) of id lists such as "3,17,1-5"."""
    return specs.select(*[c for c in specs.columns if c != column], F.posexplode(fn.session_ids(F.col(column))).alias("position", "session_id"))


def family_columns(columns: Sequence[str], families: Sequence[str]) -> list[str]:
    """Columns <family>__<name> of the families, in the table's order."""
    return [c for c in columns if re.match(r"^([a-z][a-z0-9]*)__[a-z0-9_]+$", c) and c.split("__")[0] in families]


def split_quality(df: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Features and quality columns, each with the ids."""
    qc = [c for c in df.columns if c.startswith("qc__")]
    return df.select(*ids, *[c for c in df.columns if c not in qc and c not in ids]), df.select(*ids, *qc)


def keep_confident(frames: DataFrame, measures: Sequence[str], least: float) -> DataFrame:
    """Frames without detection or enough confidence keep their row and lose their measures."""
    ok = F.coalesce(F.col("detected") & (F.col("confidence") >= least), F.lit(False))
    return frames.withColumns({m: F.when(ok, F.col(m)) for m in measures} | {"detected": ok})


def sample_frames(frames: DataFrame, rates: DataFrame, width: float | None = None) -> DataFrame:
    """Every n-th frame of each session, n = native / requested rate of ``rates`` (session_id, native, requested).

    A ratio that is no whole number is refused, one-based indexes count from 0, and sessions that are thinned
    already (median step over 1) stay as they are. ``width`` cuts the frames of a very long session into buckets of their
    index, so that steps are taken in several tasks; their median is found by counts either way.
    """
    r = rates.select("session_id", (F.col("native") / F.col("requested")).alias("__step"))
    if r.where(F.abs(F.col("__step") - F.round("__step")) > 1e-6).take(1):
        raise ValueError("the requested rate does not divide the native one")
    bucket = None if width is None else F.floor(F.col("frame_index") / width)
    steps = previous(frames.select("session_id", "frame_index"), ["session_id"], ["frame_index"], {"__prev": "frame_index"}, bucket)
    steps = steps.select("session_id", "frame_index", (F.col("frame_index") - F.col("__prev")).alias("__d"))
    if width is None:
        info = steps.groupBy("session_id").agg(F.median("__d").alias("__median"), F.min("frame_index").alias("__first"))
    else:
        info = order_statistics(steps, ["session_id"], "__d", {"__median": 0.5}).drop("n").join(steps.groupBy("session_id").agg(F.min("frame_index").alias("__first")), "session_id")
    f = frames.join(info, "session_id").join(r, "session_id")
    base = F.when(F.col("__first") == 1, 1).otherwise(0)
    keep = (F.col("__median") > 1) | (F.pmod(F.col("frame_index") - base, F.round("__step").cast("long")) == 0)
    return f.where(keep).select(*frames.columns)


def excluded_overlap(spans: DataFrame) -> DataFrame:
    """(session_id, excluded): how much of the subject's speech others talk into; 0 where they never do."""
    own = spans.where("role = 'subject'").select("session_id", "start", "end")
    rest = spans.where("role <> 'subject'").select("session_id", "start", "end")
    over = sp.intersect(own, rest, ["session_id"]).groupBy("session_id").agg(F.sum(F.col("end") - F.col("start")).alias("excluded"))
    return own.select("session_id").distinct().join(over, "session_id", "left").fillna(0, ["excluded"])


def analysis_spans(spans: DataFrame, extents: DataFrame, least: float, exclusive: bool = True) -> DataFrame:
    """(session_id, start, end): the subject's merged speech without the others' (if exclusive), in the extent, long
    enough. ``excluded_overlap`` has the time that others talk into."""
    own = spans.where("role = 'subject'").select("session_id", "start", "end")
    rest = spans.where("role <> 'subject'").select("session_id", "start", "end")
    s = sp.subtract(own, rest, ["session_id"]) if exclusive else sp.merge(own, ["session_id"]).drop("n_spans")
    return sp.clip(s, extents, ["session_id"]).where(F.col("end") - F.col("start") >= least)


# ---------------------------------------------------------------- guards

#: Words that name an outcome, after a column name is cut into words. Fixed values of this engine.
OUTCOME_WORDS = ("label", "target", "outcome", "diagnosis", "severity", "score", "quality", "toxic", "brand")
#: Endings that make a name harmless all the same.
HARMLESS_ENDINGS = ("confidence score", "similarity score")
#: Pieces of column names that hold what was said or shown, rather than a measure of it.
TEXT_PIECES = ("transcript", "utterance", "text_content", "words_spoken", "speech_text", "caption", "srt", "name", "label_text", "ocr")
#: Pieces of names that could carry identity.
FORBIDDEN = (*TEXT_PIECES, "subtitle", "email", "phone", "address", "birth")


def words_of_name(c: Column) -> Column:
    """A column name as words: punctuation and joints of letters and digits are blanks."""
    w = F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    w = F.regexp_replace(F.regexp_replace(w, "([a-z])([0-9])", "$1 $2"), "([0-9])([a-z])", "$1 $2")
    return F.trim(w)


def outcome_like(c: Column, words: Sequence[str] = OUTCOME_WORDS, harmless: Sequence[str] = HARMLESS_ENDINGS, exempt: Sequence[str] = ()) -> Column:
    """Whether a name looks like an outcome: it has one of ``words``, and no harmless ending.

    ``exempt`` names have a recorded confirmation. One holds for every name that ends with its words, so it still does after
    the column has been given a family's prefix.
    """
    w = words_of_name(c)
    found = w.rlike(r"\b(" + "|".join(words) + r")s?\b")
    if harmless:
        found = found & ~w.rlike("(" + "|".join(harmless) + ")$")
    for name in exempt:
        allowed = words_of_name(F.lit(name))
        found = found & ~((w == allowed) | w.endswith(F.concat(F.lit(" "), allowed)))
    return found


def label_like(columns: Sequence[str], words: Sequence[str] = OUTCOME_WORDS, harmless: Sequence[str] = HARMLESS_ENDINGS, exempt: Sequence[str] = ()) -> list[str]:
    """The columns of a schema whose names look like outcomes, by the same rule (``outcome_like``), run over one row of names."""
    if not columns:
        return []
    spark = SparkSession.active()
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("name"))
    bad = {r["name"] for r in names.where(outcome_like(F.col("name"), words, harmless, exempt)).collect()}
    return [c for c in columns if c in bad]


def refuse_forbidden(columns: Sequence[str], budget: int | None = None, pieces: Sequence[str] = FORBIDDEN) -> None:
    """Raise for names with ``pieces`` that could carry text or identity, and for more features than the budget."""
    if bad := [c for c in columns if any(f in c.lower() for f in pieces)]:
        raise ValueError("columns that must not leave: " + ", ".join(bad))
    if budget is not None and len(columns) > budget:
        raise ValueError(f"{len(columns)} features are more than {budget}")


def single_source(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Groups with the number of different sources; more than one cannot be compared."""
    n = df.groupBy(*keys).agg(F.count_distinct(source).alias("n_sources"))
    return n.withColumn("comparable", F.col("n_sources") <= 1)


def require_single_source(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """The table, refused if any group has several sources."""
    if bad := single_source(df, keys, source).where("NOT comparable").take(3):
        raise ValueError("several sources: " + "; ".join(", ".join(str(r[k]) for k in keys) for r in bad))
    return df


def typed(df: DataFrame, fields: Sequence[Field], order: Sequence[str] = ()) -> DataFrame:
    """The fields' columns, cast to their types, so that empty and all-null tables keep them; one that ``df`` lacks is null."""
    have = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.type).alias(f.name) for f in fields])
    return out.orderBy(*order) if order else out


def empty_table(spark: SparkSession, fields: Sequence[Field]) -> DataFrame:
    """A table of the fields without rows."""
    return spark.createDataFrame([], ", ".join(f"`{f.name}` {f.type}" for f in fields))


@dataclass(frozen=True)
class Field:
    """Contract of a column: type, nulls, a range and the values allowed."""

    name: str
    type: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple = ()


def validate(df: DataFrame, fields: Sequence[Field], keys: Sequence[str] = (), rows: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """(column, check, failures) of a contract, in one pass over the rows and one over the keys; no value is quoted."""
    names, types = set(df.columns), dict(df.dtypes)
    fixed = [(f.name, "missing") for f in fields if f.name not in names]
    fixed += [(f.name, "type") for f in fields if f.name in names and types[f.name] != f.type]
    fixed += [(c, "unexpected") for c in df.columns if strict and c not in {f.name for f in fields}]
    tests: list[tuple[str, str, Column]] = []
    for f in (f for f in fields if f.name in names):
        c = F.col(f.name)
        if not f.nullable:
            tests.append((f.name, "null", c.isNull()))
        if f.low is not None:
            tests.append((f.name, "low", c < f.low))
        if f.high is not None:
            tests.append((f.name, "high", c > f.high))
        if f.values:
            tests.append((f.name, "value", ~c.isin(*f.values)))
    tests += [("*", name, ~F.expr(e)) for name, e in (rows or {}).items()]
    spark = df.sparkSession
    checks = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"t{i}").alias("failures")) for i, (c, k, _) in enumerate(tests)])
    counts = df.agg(*[F.coalesce(F.sum(F.when(t, 1)), F.lit(0)).alias(f"t{i}") for i, (_, _, t) in enumerate(tests)])
    out = counts.select(F.explode(checks).alias("r")).select("r.*").where("failures > 0")
    if fixed:
        rows_ = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.lit(1).cast("long").alias("failures")) for c, k in fixed])
        out = out.unionByName(spark.range(1).select(F.explode(rows_).alias("r")).select("r.*"))
    if keys:
        twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("failures"))
        out = out.unionByName(twice.select(F.lit(",".join(keys)).alias("column"), F.lit("unique").alias("check"), "failures").where("failures > 0"))
    return out


# ---------------------------------------------------------------- assembly


def role_precedence(assigned: DataFrame, manual: DataFrame) -> DataFrame:
    """Assigned roles, and the manual ones of sessions that have none assigned."""
    rest = manual.join(assigned.select("session_id").distinct(), "session_id", "left_anti")
    return assigned.withColumn("source", F.lit("assigned")).unionByName(rest.withColumn("source", F.lit("manual")))


def assemble_features(base: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Every session of ``base`` with the columns of all stage tables (unique session_id; qc__flags joined in order)
    and the names of the stages that lack it."""
    out, flags, here = base, [], []
    for name, t in stages.items():
        t = t.withColumn(f"__has_{name}", F.lit(True))
        if "qc__flags" in t.columns:
            t = t.withColumnRenamed("qc__flags", f"__flags_{name}")
            flags.append(f"__flags_{name}")
        out = out.join(t, "session_id", "left")
        here.append(f"__has_{name}")
    missing = F.array_compact(F.array(*[F.when(F.col(h).isNull(), F.lit(n)) for h, n in zip(here, stages)]))
    out = out.withColumn("qc__stages_missing", F.array_join(missing, ";"))
    both = F.concat(*[F.split(F.coalesce(f, F.lit("")), ";") for f in flags]) if flags else F.array().cast("array<string>")
    out = out.withColumn("qc__flags", F.array_join(F.array_distinct(F.array_remove(both, "")), ";"))
    return out.drop(*here, *flags)


def apply_notes(df: DataFrame, notes: DataFrame, modalities: dict[str, Sequence[str]]) -> DataFrame:
    """Null the families of a modality that a note calls unavailable, and flag it. Other notes change nothing.

    ``modalities``: families by modality. Adds qc__note_flags (annotated_<family>_unavailable, each once).
    """
    families = F.create_map(*[x for m, f in modalities.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in f]))])
    n = notes.where("status = 'unavailable'").select("session_id", F.explode(families[F.col("modality")]).alias("family"))
    n = n.groupBy("session_id").agg(F.array_sort(F.collect_set("family")).alias("__gone"))
    out = df.join(n, "session_id", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<string>")))
    known = {f for fs in modalities.values() for f in fs}
    blank = {c: F.when(~F.array_contains("__gone", c.split("__")[0]), F.col(c)) for c in df.columns if "__" in c and c.split("__")[0] in known}
    flags = F.array_join(F.transform("__gone", lambda f: F.concat(F.lit("annotated_"), f, F.lit("_unavailable"))), ";")
    return out.withColumns(blank | {"qc__note_flags": flags}).drop("__gone")


def join_text(ours: DataFrame, theirs: DataFrame, key: str = "session_id") -> DataFrame:
    """Every row of ``ours`` with the columns of ``theirs``; the key must be unique on both sides, and no column on both."""
    if both := (set(ours.columns) & set(theirs.columns)) - {key}:
        raise ValueError("columns of both sides: " + ", ".join(sorted(both)))
    for side in (ours, theirs):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique")
    return ours.join(theirs, key, "left")


def join_coverage(ours: DataFrame, theirs: DataFrame, key: str = "session_id") -> DataFrame:
    """How many keys of two tables match or stand on one side only."""
    a = ours.select(key).distinct().withColumn("__a", F.lit(1))
    b = theirs.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__a").isNull(), "theirs_only").when(F.col("__b").isNull(), "ours_only").otherwise("matched")
    return a.join(b, key, "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def number_rows(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``df`` with the place of each row (``ordinal``, from 0) in the order of ``key``, whose values are unique.

    Running totals over range buckets of the key: no task sorts all rows, and nothing rests on which task had a row, so a lost
    executor changes no number.
    """
    from .evaluate import running_total

    ones = df.select(key, F.lit(1).cast("long").alias("__one"))
    places = running_total(ones, [], key, "__one", "__upto").select(key, (F.col("__upto") - 1).alias(ordinal))
    return df.join(places, key)


def positional_join(table: DataFrame, ids: DataFrame, ordinal: str, expected: int | None = None) -> DataFrame:
    """Rows numbered by the source (``ordinal``, from 0) joined to ids in numeric order.

    Ids must be unique whole numbers; the counts of both sides, and ``expected``, must agree. The ordinals of
    ids come from two levels, so no task sorts all of them.
    """
    n = ids.select(F.col("session_id").cast("string").try_cast("long").alias("session_id"))
    counts = n.agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("d")).first()
    rows = table.count()
    if counts["n"] != counts["d"] or counts["n"] != rows or (expected is not None and expected != rows):
        raise ValueError(f"{rows} rows cannot be given to {counts['n']} ids ({counts['d']} different)")
    return number_rows(n, "session_id", ordinal).join(table, ordinal)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("session_id",), scope: Sequence[str] = ("session_id",), force: bool = False) -> DataFrame:
    """Rows of this run, and the old rows of sessions that it did not touch; columns that one side lacks are null.

    Old rows without a key are dropped. An old table without the key columns is none of ours and is refused, or left out
    if forced. ``new_columns`` tells which columns the old rows lack.
    """
    if gone := [k for k in (*keys, *scope) if k not in old.columns]:
        if force:
            return new
        raise ValueError("the table that is there lacks " + ", ".join(dict.fromkeys(gone)))
    kept = old.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).join(new.select(*scope).distinct(), list(scope), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def new_columns(old: DataFrame, new: DataFrame, scope: Sequence[str] = ("session_id",)) -> DataFrame:
    """(column, n_carried): columns of this run that the old table predates, with how many of its rows stay without them."""
    kept = old.join(new.select(*scope).distinct(), list(scope), "left_anti").agg(F.count("*").alias("n_carried"))
    fresh = F.array(*[F.lit(c) for c in new.columns if c not in old.columns]).cast("array<string>")
    return kept.select(F.explode(fresh).alias("column"), "n_carried").where("n_carried > 0")


def pending(selected: DataFrame, artifacts: DataFrame, rows: DataFrame) -> DataFrame:
    """(session_id, status): 'skipped' where both the artifact and the row are there, else 'pending'."""
    done = artifacts.select("session_id").intersect(rows.select("session_id")).withColumn("__done", F.lit(True))
    return selected.select("session_id").join(done, "session_id", "left").select("session_id", F.when(F.col("__done"), "skipped").otherwise("pending").alias("status"))


def keep_all_rows(selected: DataFrame, measured: DataFrame, failures: DataFrame, old: DataFrame | None = None, contract: Sequence[Field] = (), force: bool = False) -> DataFrame:
    """Every selected session: measured, or with nulls and the reason why as its flag.

    ``old`` rows of other sessions are carried forward, once the old table has met the contract; a foreign one is refused, or
    left out if forced.
    """
    if old is not None:
        bad = validate(old, contract, ("session_id",), strict=False).take(5) if "session_id" in old.columns else [{"column": "session_id", "check": "missing"}]
        if bad and not force:
            raise ValueError("the table that is there is not ours: " + ", ".join(f"{r['column']} {r['check']}" for r in bad))
        fresh = keep_all_rows(selected, measured, failures)
        return fresh if bad else upsert(old, fresh)
    why = failures.select("session_id", F.concat(F.lit("unreadable: "), F.col("reason")).alias("__why"))
    out = selected.select("session_id").join(measured, "session_id", "left").join(why, "session_id", "left")
    return out.withColumn("flags", F.coalesce("flags", "__why", F.lit("not measured"))).drop("__why")


def stage_outcomes(done: DataFrame, failed: DataFrame, skipped: DataFrame, stage: str) -> DataFrame:
    """Audit rows (session_id, stage, status, seconds, message) of a stage."""
    none = F.lit(None)
    ok = done.select("session_id", F.lit("ok").alias("status"), "seconds", none.cast("string").alias("message"))
    bad = failed.select("session_id", F.lit("failed").alias("status"), none.cast("double").alias("seconds"), "message")
    skip = skipped.select("session_id", F.lit("skipped").alias("status"), none.cast("double").alias("seconds"), none.cast("string").alias("message"))
    return ok.unionByName(bad).unionByName(skip).select("session_id", F.lit(stage).alias("stage"), "status", "seconds", "message")


def cohort(features: DataFrame, labels: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(session_id, part, group): sessions with features, labels or both; the group is the session where none is given."""
    f = features.select("session_id").distinct().withColumn("__f", F.lit(1))
    t = labels.select("session_id").distinct().withColumn("__l", F.lit(1))
    part = F.when(F.col("__l").isNull(), "features_only").when(F.col("__f").isNull(), "labels_only").otherwise("cohort")
    out = f.join(t, "session_id", "full_outer").select("session_id", part.alias("part"))
    if groups is None:
        return out.withColumn("group", F.col("session_id").cast("string"))
    out = out.join(groups.select("session_id", F.col("group").alias("__g")), "session_id", "left")
    return out.select("session_id", "part", F.coalesce("__g", F.col("session_id").cast("string")).alias("group"))


def modelled_cohort(features: DataFrame, labels: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(session_id, group) of the sessions with features and labels; none at all is an error."""
    out = cohort(features, labels, groups).where("part = 'cohort'").select("session_id", "group")
    if out.isEmpty():
        raise ValueError("no session has both features and labels")
    return out


def feature_dictionary(spark: SparkSession, columns: Sequence[str], described: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(name, family, unit, tier, description) of feature columns; a column that nobody describes is an error."""
    if unknown := [c for c in columns if c not in described]:
        raise ValueError("not described: " + ", ".join(unknown))
    rows = [(c, c.split("__")[0], *described[c]) for c in columns]
    return spark.createDataFrame(rows, "name string, family string, unit string, tier string, description string")


def wave_of_id(sessions: DataFrame, ranges: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Add the wave whose range (wave, first, last) holds the id, and whether it is the folder's.

    Waves are configuration, so they become one CASE expression.
    """
    by_id = F.lit(None).cast("string")
    for wave, first, last in reversed(ranges):
        by_id = F.when(F.col("session_id").between(first, last), F.lit(wave)).otherwise(by_id)
    out = sessions.select("session_id", "wave", by_id.alias("wave_by_id"))
    return out.withColumn("agrees", F.col("wave").eqNullSafe(F.col("wave_by_id")))
