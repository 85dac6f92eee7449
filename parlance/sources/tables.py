"""Table sources and sinks: session discovery, frame exports, media descriptions, labels, notes, text features, bundles."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as fn

#: What a note may be about, what it may say, and how long its reason is at least.
MODALITIES, STATUSES, LEAST_REASON = ("audio", "video", "face", "speech"), ("unavailable", "degraded", "note"), 15
#: Names of identifier columns of label files and of text-feature files, in order of preference.
ID_NAMES = ("session_id", "session", "id")
TEXT_ID_NAMES = (*ID_NAMES, "recording_id", "file_id")
#: Endings of files that carry no times.
TIMELESS = (".txt", ".json", ".tsv", ".csv")
ROLES = ("subject", "partner", "unknown")


# ---------------------------------------------------------------- discovery and matching


def discover_sessions(files: DataFrame, folders: dict[str, str], ids: dict[str, tuple[int, int]] | None = None, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions and problems of a file listing (path): ids are the digits of file names, waves their folders.

    ``folders``: wave by folder name. Problems are (kind, subject): bad names, ids that repeat, folders without
    files and files in other folders; with ``ids`` (first and last id by wave) sessions in the folder of another wave than their
    id's, and with ``expected`` another number of sessions than that.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    wave = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])[F.col("folder")]
    f = files.select("path", stem.alias("stem"), folder.alias("folder")).withColumn("wave", wave)
    f = f.withColumn("session_id", F.when(F.col("stem").rlike(r"^\D*\d+\D*$"), F.regexp_extract("stem", r"(\d+)", 1).try_cast("long")))
    good = f.where("wave IS NOT NULL AND session_id > 0")
    seen = good.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by("path", "path").alias("path"), F.min_by("wave", "path").alias("wave"))
    wanted = F.explode(F.array(*[F.lit(k) for k in folders])).alias("folder")
    missing = files.sparkSession.range(1).select(wanted).join(f.select("folder").distinct(), "folder", "left_anti")
    problems = (
        f.where("wave IS NOT NULL AND (session_id IS NULL OR session_id <= 0)").select(F.lit("bad_name").alias("kind"), F.col("path").alias("subject"))
        .unionByName(f.where("wave IS NULL").select(F.lit("extra_file").alias("kind"), F.col("path").alias("subject")))
        .unionByName(seen.where("n > 1").select(F.lit("repeated_id").alias("kind"), F.col("session_id").cast("string").alias("subject")))
        .unionByName(missing.select(F.lit("missing_folder").alias("kind"), F.col("folder").alias("subject")))
    )
    if ids is not None:
        of_id = F.coalesce(*[F.when(F.col("session_id").between(low, high), F.lit(w)) for w, (low, high) in ids.items()])
        strays = seen.where(~of_id.eqNullSafe(F.col("wave"))).select(F.lit("wave_mismatch").alias("kind"), F.concat_ws(":", F.col("session_id").cast("string"), "wave", F.coalesce(of_id, F.lit("none"))).alias("subject"))
        problems = problems.unionByName(strays)
    if expected is not None:
        many = seen.agg(F.count("*").alias("n")).where(F.col("n") != expected)
        problems = problems.unionByName(many.select(F.lit("count_mismatch").alias("kind"), F.concat(F.lit(f"expected {expected}, found "), F.col("n").cast("string")).alias("subject")))
    return seen.select("session_id", "wave", "path"), problems


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files under a folder; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def match_files(sessions: DataFrame, files: DataFrame, patterns: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """(session_id, file, status): each session with the first pattern's file that exists.

    ``patterns`` hold {session_id}; ``files`` has (name). Sessions without a file are 'missing'; of the files that no session
    claims, those with an ending that carries no times are 'timeless' and the others 'unmatched'. ``known`` has all sessions
    there are: where a run takes some of them only, the files of the others are theirs and are not reported.
    """
    by = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)]))
    every = sessions.select("session_id", F.lit(True).alias("asked"))
    if known is not None:
        rest = known.select("session_id").distinct().join(every, "session_id", "left_anti")
        every = every.unionByName(rest.withColumn("asked", F.lit(False)))
    want = every.select("session_id", "asked", by.alias("p"))
    want = want.select("session_id", "asked", "p.rank", F.replace(F.col("p.pattern"), F.lit("{session_id}"), F.col("session_id").cast("string")).alias("file"))
    found = want.join(files.select(F.col("name").alias("file")), "file")
    best = found.groupBy("session_id", "asked").agg(F.min_by("file", "rank").alias("file"))
    mine = best.where("asked").select("session_id", "file")
    out = sessions.select("session_id").join(mine, "session_id", "left").withColumn("status", F.when(F.col("file").isNull(), "missing").otherwise("matched"))
    rest = files.select(F.col("name").alias("file")).join(best.select("file").distinct(), "file", "left_anti")
    timeless = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1)).isin(*TIMELESS)
    none = F.lit(None).cast(sessions.schema["session_id"].dataType).alias("session_id")
    return out.unionByName(rest.select(none, "file", F.when(timeless, "timeless").otherwise("unmatched").alias("status")))


# ---------------------------------------------------------------- measurements


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (with a header, all strings) or Parquet table by its extension, header blanks stripped."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def write_table(df: DataFrame, path: str, force: bool = False) -> None:
    """Write a CSV (with a header) or Parquet folder by its extension; one that is there is kept unless forced.

    Spark commits a folder as a whole, so a reader sees all of it or nothing.
    """
    w = df.write.mode("overwrite" if force else "errorifexists")
    w.parquet(path) if path.rstrip("/").endswith(".parquet") else w.option("header", True).csv(path)


def ingest_frames(raw: DataFrame, measures: dict[str, str], fps: float, poses: Sequence[str] = ()) -> DataFrame:
    """Frames of an exported measurement table (frame, timestamp, success, confidence, measures).

    ``measures``: our name by the export's. A frame without success stays, with null measures; poses come in
    radians and leave in degrees; a missing timestamp is frame / fps.
    """
    need = [c for c in ("session_id", "frame", "success", "confidence", *measures) if c not in raw.columns]
    if need:
        raise ValueError("missing columns: " + ", ".join(need))
    ok = fn.parse_flag(F.col("success").cast("string"))
    stamp = fn.parse_number(F.col("timestamp").cast("string")) if "timestamp" in raw.columns else F.lit(None).cast("double")

    def measure(c: str, name: str) -> Column:
        v = fn.parse_number(F.col(c).cast("string"))
        return F.when(ok, F.degrees(v) if name in poses else v).alias(name)

    frame = F.col("frame").cast("long")
    return raw.select(
        "session_id", frame.alias("frame_index"), F.coalesce(stamp, frame / F.lit(fps)).alias("timestamp_s"), ok.alias("detected"),
        fn.parse_number(F.col("confidence").cast("string")).alias("confidence"), *[measure(c, n) for c, n in measures.items()],
    )


MEDIA = "format struct<duration:string>, streams array<struct<codec_type:string,width:int,height:int,channels:int,r_frame_rate:string,avg_frame_rate:string>>"


def ratio(c: Column) -> Column:
    """Value of "a/b"; null for a 0 denominator or anything else."""
    return F.try_divide(F.split(c, "/")[0].try_cast("double"), F.get(F.split(c, "/"), F.lit(1)).try_cast("double"))


def parse_media(rows: DataFrame, column: str = "json") -> DataFrame:
    """Duration, streams, frame rate and flags of probe descriptions in JSON."""
    m = rows.withColumn("__m", F.from_json(column, MEDIA))
    of = lambda kind: F.filter(F.col("__m.streams"), lambda s: s["codec_type"] == kind)
    video, audio = of("video"), of("audio")
    m = m.withColumns({"__v": video, "__a": audio, "duration_s": F.col("__m.format.duration").try_cast("double")})
    first = F.get("__v", F.lit(0))
    base, mean = ratio(first["r_frame_rate"]), ratio(first["avg_frame_rate"])
    m = m.withColumns({"n_video": F.coalesce(F.size("__v"), F.lit(0)), "n_audio": F.coalesce(F.size("__a"), F.lit(0)), "width": first["width"], "height": first["height"], "fps": mean})
    varies = F.coalesce(F.abs(base - mean) / mean > 0.01, F.lit(False))
    tests = [(F.col("n_video") <= 0, "no_video"), (F.col("n_audio") <= 0, "no_audio"), (F.col("n_video") > 1, "several_video"), (F.col("n_audio") > 1, "several_audio"), (varies, "variable_rate")]
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))
    return m.withColumn("flags", F.array_join(found, ";")).drop("__m", "__v", "__a", column)


# ---------------------------------------------------------------- labels, notes, roles, text features


def id_column(columns: Sequence[str], names: Sequence[str] = ID_NAMES) -> str | None:
    """The first of the names that a table has, in any case."""
    low = {c.lower(): c for c in reversed(list(columns))}
    return next((low[n] for n in names if n in low), None)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The table, if no key repeats or is missing."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where(" OR ".join(["n > 1", *[f"`{k}` IS NULL" for k in keys]])).take(1)
    if bad:
        raise ValueError(f"{what}: a key repeats or is missing")
    return df


def label_table(df: DataFrame) -> DataFrame:
    """(session_id long, numeric targets) of a label file; ids that are no numbers or repeat are refused."""
    key = id_column(df.columns)
    targets = [c for c in df.columns if c != key]
    if key is None or not targets:
        raise ValueError("a label table has an id column and a target at least")
    out = df.select(F.col(key).cast("string").try_cast("long").alias("session_id"), *[fn.parse_number(F.col(c).cast("string")).alias(c) for c in targets])
    return require_unique(out, ["session_id"], "labels")


def check_notes(notes: DataFrame) -> DataFrame:
    """(line, problem) of human quality notes (line, session_id, modality, status, reason)."""
    reason = F.trim(F.regexp_replace(F.coalesce("reason", F.lit("")), r"\s+", " "))
    tests = [
        (F.col("session_id").cast("string").try_cast("long").isNull(), "session_id"),
        (~F.coalesce(F.col("modality").isin(*MODALITIES), F.lit(False)), "modality"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status"),
        (F.length(reason) < LEAST_REASON, "reason"),
    ]
    problems = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])))
    bad = notes.select("line", problems.alias("problem"))
    w = Window.partitionBy("session_id", "modality").orderBy("line")
    twice = notes.withColumn("__n", F.row_number().over(w)).where("__n > 1").select("line", F.lit("repeated").alias("problem"))
    return bad.unionByName(twice)


def read_notes(notes: DataFrame) -> DataFrame:
    """The notes, reasons with single blanks; a table with any problem is refused as a whole."""
    bad = check_notes(notes).orderBy("line").take(5)
    if bad:
        raise ValueError("notes: " + ", ".join(f"line {r['line']} {r['problem']}" for r in bad))
    return notes.withColumn("reason", F.trim(F.regexp_replace("reason", r"\s+", " ")))


def role_table(df: DataFrame) -> DataFrame:
    """(session_id, speaker, role) of a hand-written table; refused as a whole if a column is missing, an id is no number, a
    role is none of ROLES or a speaker of a session comes twice."""
    if gone := [c for c in ("session_id", "speaker", "role") if c not in df.columns]:
        raise ValueError("a role table lacks " + ", ".join(gone))
    out = df.select(F.col("session_id").cast("string").try_cast("long").alias("session_id"), F.trim("speaker").alias("speaker"), F.trim("role").alias("role"))
    if not out.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))).isEmpty():
        raise ValueError("a role table has a role that is none of " + ", ".join(ROLES))
    return require_unique(out, ["session_id", "speaker"], "roles")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def text_feature_table(df: DataFrame, prefix: str = "text__", exempt: Sequence[str] = ()) -> DataFrame:
    """(session_id, text__*) of an external table: label-like columns are refused, but for those with a recorded exemption,
    and names normalised once."""
    from ..operators.assemble import label_like

    df = df.toDF(*[c.strip() for c in df.columns])
    key = id_column(df.columns, TEXT_ID_NAMES)
    others = [c for c in df.columns if c != key]
    if bad := label_like(others, exempt=exempt):
        raise ValueError("columns look like labels: " + ", ".join(bad))
    if key is None:
        raise ValueError("no id column")

    def name(c: str) -> str:
        plain = re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_")
        return prefix + plain.removeprefix(prefix.strip("_") + "_")

    out = df.select(F.col(key).cast("string").try_cast("long").alias("session_id"), *[fn.parse_number(F.col(c).cast("string")).alias(name(c)) for c in others])
    return require_unique(out, ["session_id"], "text features")


# ---------------------------------------------------------------- sinks


def manifest(df: DataFrame, families: Sequence[str], notes: dict[str, str] | None = None, **record: object) -> DataFrame:
    """One JSON row: sessions, ids, columns by family and notes, and what else is to be on record (seeds, backends, digests)."""
    cols = {f: [c for c in df.columns if c.startswith(f + "__")] for f in families}
    listed = F.struct(*[F.array(*[F.lit(c) for c in v]).cast("array<string>").alias(f) for f, v in cols.items()])
    one = df.agg(F.count("*").alias("n_sessions"), F.count_distinct("session_id").alias("n_ids"), F.min("session_id").alias("first_id"), F.max("session_id").alias("last_id"))
    extra = F.lit(json.dumps(notes or {}, sort_keys=True))
    more = [F.lit(json.dumps(record, sort_keys=True, default=str)).alias("record")] if record else []
    return one.select(F.to_json(F.struct("n_sessions", "n_ids", "first_id", "last_id", listed.alias("columns"), extra.alias("notes"), *more)).alias("manifest"))


def write_bundle(tables: dict[str, DataFrame], path: str, force: bool = False, budget: int | None = None) -> list[str]:
    """Write tables as Parquet under a path, as features, qc, dictionary, text, notes and whatever else a bundle has.

    No column of any table may look like an outcome or could carry text or identity, and ``features`` may have ``budget``
    columns at most: all is checked before anything is written. Notes are exempt, as they are sentences by nature, and so is
    the dictionary, whose rows name columns. The tables go into a folder beside the path first, which then takes the path's
    name; the manifest is written last, so a bundle that has one is whole. One that is there is kept unless forced.
    """
    from ..operators.assemble import label_like, refuse_forbidden

    for name, df in tables.items():
        if name not in ("notes", "dictionary", "manifest"):
            columns = [c for c in df.columns if c != "session_id"]
            if bad := label_like(columns):
                raise ValueError(f"{name}: columns look like labels: " + ", ".join(bad))
            refuse_forbidden(columns, budget if name == "features" else None)
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm
    target, staged = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, path.rstrip("/") + ".partial"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not force:
        raise ValueError(f"a bundle is there already: {path}")
    order = sorted(tables, key=lambda n: (n == "manifest", n))
    for name in order:
        tables[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}.partial/{name}")
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(staged, target):
        raise OSError(f"could not publish {path}")
    return order
