"""Shared helpers of the corpus operators: scratch tables, components and vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared scratch folder and read it back, which cuts its lineage."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Seen(NamedTuple):
    """What was counted of a table while it was written: its rows, and the sum and the largest of one of its columns."""

    rows: int
    total: int
    most: int


def written(df: DataFrame, name: str, number: str | None = None) -> tuple[DataFrame, Seen]:
    """``materialise``, and what is ``Seen`` of the rows as they are written (of column ``number``), so that no query of its own has to count
    them: each query that runs takes the driver a plan, compiled code and a thread for each exchange."""
    one = F.lit(1) if number is None else F.col(number)
    watch = Observation()
    out = materialise(df.observe(watch, F.count(F.lit(1)).alias("rows"), F.sum(one).alias("total"), F.max(one).alias("most")), name)
    got = watch.get
    return out, Seen(got["rows"], got["total"] or 0, got["most"] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with an underscore more at its front as long as a column of ``taken`` has it, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------- joins on hot keys

#: Hot keys known at most, and rows up to which a key is never hot.
MOST_HOT, LEAST_HOT = 1 << 16, 256


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", number: str = "n", seen: Seen | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, with the rows of hot keys dealt to several tasks.

    ``right`` is a written table with one row per key, and in ``number`` (dropped) how many rows of ``left``
    have the key, or more; ``seen`` is what ``written`` saw of that column, which is counted here without. A key is hot from LEAST_HOT rows and a MOST_HOT-th of all rows on, so there are
    MOST_HOT hot keys at most and their list can be broadcast. The rows of a hot key are dealt by the hash of
    ``by``, and its row of ``right`` is given to each deal. Both sides grow with the input, so they are merged and
    neither is ever broadcast.
    """
    right = right.hint("merge")
    total, most = seen[1:] if seen else right.agg(F.sum(number), F.max(number)).first()
    limit = max(LEAST_HOT, -(-(total or 0) // MOST_HOT))
    if (most or 0) <= limit:
        return left.join(right.drop(number), keys, how)
    hot = F.broadcast(right.where(F.col(number) > limit).select(*keys, F.ceil(F.col(number) / limit).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    dealt = left.join(hot, keys, "left").withColumn("__deal", F.pmod(F.xxhash64(*by), parts)).drop("__parts")
    copies = right.join(hot, keys, "left").withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts", number)
    return dealt.join(copies, [*keys, "__deal"], how).drop("__deal")


# ---------------------------------------------------------------- filters of fixed size

#: Least and most bits of a filter (8 MB at most); beyond, it only holds back less.
FILTER_BITS = (1 << 16, 1 << 26)


def document_filter(needed: DataFrame, col: str = "id", per: int = 128) -> np.ndarray:
    """A bit for each hash bucket that a needed value falls in: some ``per`` for each value, FILTER_BITS at most, so one value in
    ``per`` passes for nothing; with few bits that would be more rows than the needed ones where most are not."""
    many = needed.agg(F.approx_count_distinct(col)).first()[0]
    bits = 1 << int(np.clip(np.ceil(np.log2(max(per * many, 1))), np.log2(FILTER_BITS[0]), np.log2(FILTER_BITS[1])))
    bucket = F.pmod(F.xxhash64(col), F.lit(bits))
    words = needed.select(F.shiftright(bucket, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({col}), {bits}L) & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got.column("word")).astype(np.int64)] = np.asarray(got.column("bits")).astype(np.int64)
    return out


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = (mix(np.asarray(batch.column(0)).view(np.uint64)) % np.uint64(bits)).astype(np.int64)
            word, back = np.unique(bucket >> 6, return_inverse=True)
            out = np.zeros(len(word), np.int64)
            np.bitwise_or.at(out, back, np.int64(1) << (bucket & 63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(out)], names=["word", "bits"])

    return run


def hash_filter(hashes: DataFrame, per: int = 32, col: str = "h", many: int | None = None) -> np.ndarray:
    """A bit for each bucket that a 64-bit hash falls in (``mix`` of it, modulo the bits; ``per`` bits for a hash, FILTER_BITS at
    most), for tests on arrays of hashes. ``many``: the number of rows, where it is known."""
    many = hashes.count() if many is None else many
    bits = 1 << int(np.clip(np.ceil(np.log2(max(per * many, 1))), np.log2(FILTER_BITS[0]), np.log2(FILTER_BITS[1])))
    got = hashes.select(col).mapInArrow(_fill(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got.column("word")).astype(np.int64)] = np.asarray(got.column("bits")).astype(np.int64)
    return out


def in_filter(bits: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows whose last column, their bucket, is in the filter; without that column."""
    bucket = np.asarray(batch.column(batch.num_columns - 1)).astype(np.int64)
    some = ((bits[bucket >> 6] >> (bucket & 63)) & 1).astype(bool)
    return batch.select(list(range(batch.num_columns - 1))).filter(pa.array(some))


def filter_bucket(bits: np.ndarray, col: str = "id") -> Column:
    return F.pmod(F.xxhash64(col), F.lit(64 * len(bits))).alias("bucket")


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of each vertex of ``edges``: rows (node, component), component = smallest node.

    Rounds of contraction: every vertex moves to the vertex of least random rank within two steps, so a hub and
    all its leaves become one vertex in one round, and long paths shrink by a constant factor. Each round is a
    few aggregations with map-side combine and joins on vertices, hubs split by their degree; nothing is collected.
    """
    cur = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    cur, seen = written(cur.distinct(), "edges")
    placed, turn = None, 0
    while seen.rows:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: B023, E731
        near = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("best"), F.count("*").alias("n"))
        near = near.select("u", F.when(rank("best") < rank("u"), F.col("best")).otherwise(F.col("u")).alias("best"), "n")
        near, degrees = written(near, "near", "n")
        hop = spread_join(both, near.select(F.col("u").alias("v"), F.col("best").alias("far"), "n"), ["v"], ["u"], seen=degrees)
        step = hop.groupBy("u").agg(F.min_by("far", rank("far")).alias("far")).join(near, "u")
        step = step.select("u", F.when(rank("far") < rank("best"), F.col("far")).otherwise(F.col("best")).alias("to"), "n")
        step, degrees = written(step, "step", "n")
        if placed is None:
            placed = step.select(F.col("u").alias("node"), F.col("to").alias("at"))
        else:
            sizes = placed.groupBy("at").agg(F.count("*").alias("n"))
            moves, moved = written(step.select(F.col("u").alias("at"), "to").join(sizes, "at"), "moves", "n")
            placed = spread_join(placed, moves, ["at"], ["node"], "left", seen=moved).select("node", F.coalesce("to", "at").alias("at"))
        placed = materialise(placed, "placed")
        left = spread_join(cur, step.select("u", F.col("to").alias("cu"), "n"), ["u"], ["v"], seen=degrees).select("cu", "v")
        both_ends = spread_join(left, step.select(F.col("u").alias("v"), F.col("to").alias("cv"), "n"), ["v"], ["cu"], seen=degrees)
        cur = both_ends.where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"))
        cur, seen = written(cur.distinct(), "edges")
        turn += 1
    if placed is None:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    first, sizes = written(placed.groupBy("at").agg(F.min("node").alias("component"), F.count("*").alias("n")), "first", "n")
    return materialise(spread_join(placed, first, ["at"], ["node"], seen=sizes).select("node", "component"), "components")


# ---------------------------------------------------------------- vectorised words


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rule_table(n: int, start: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(start)) * np.uint64(_GOLDEN))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither a letter nor a digit separates plain words.
_NOT_PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _rule_table(256, 1000)[LOWER]
_STEP = _rule_table(64, 5000) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _GOLDEN | 1, np.uint64)
    p[0] = 1
    return np.cumprod(p)


class Words:
    """The words of a run of texts, without a Python object per word.

    ``data`` bytes of all texts; ``offsets`` of each text in them; ``start``/``end`` byte positions of each
    word; ``row`` the text of each word; ``first`` the first word of each text (one entry more than texts);
    ``code`` a 64-bit hash of each word, with ASCII letters lower-cased. Words are parted by ASCII white space,
    or, if ``plain``, by anything in ASCII but letters and digits.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> None:
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        size = len(data)
        apart = _NOT_PLAIN if plain else _SPACE
        inside = ~apart[data]
        full = offsets[1:] > offsets[:-1]
        before = np.zeros(size, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][full]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(size, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][full] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(self.n), np.diff(self.first))
        if len(self.start):
            where = np.arange(self.start[0], size) - np.repeat(self.start, np.diff(np.append(self.start, size)))
            longest = int((self.end - self.start).max())
            power = _powers(longest + 1)
            values = np.where(apart, np.uint64(0), _BYTE)[data[self.start[0] :]] * power[np.minimum(where, longest)]
            self.code = mix(np.add.reduceat(values, self.start - self.start[0]))
        else:
            self.code = np.zeros(0, np.uint64)

    def shingles(self, k: int, whole_if_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of k words; a shorter text gives its whole sequence if asked."""
        n = len(self.code)
        if n >= k:
            h = self.code[: n - k + 1] * _STEP[0]
            for i in range(1, k):
                h = h + self.code[i : n - k + 1 + i] * _STEP[i]
            inside = self.row[: n - k + 1] == self.row[k - 1 :]
            rows, h = self.row[: n - k + 1][inside], mix(h[inside])
        else:
            rows, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if whole_if_short:
            counts = np.diff(self.first)
            for r in np.flatnonzero((counts > 0) & (counts < k)):
                c = self.code[self.first[r] : self.first[r + 1]]
                whole = mix(np.asarray([(c * _STEP[: len(c)]).sum() + np.uint64(len(c))], np.uint64))
                rows, h = np.append(rows, r), np.append(h, whole)
            order = np.argsort(rows, kind="stable")
            rows, h = rows[order], h[order]
        return rows, h


def _as_string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of texts of at most so many bytes (one text at least)."""
    column = _as_string_array(column)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], 0 for empty runs."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
