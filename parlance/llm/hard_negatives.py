"""Operator 11: hard negatives for labelled vectors, mined by a secondary-sort shuffle."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, quoted, scratch_root, table

#: Anchors that one sweep over the rows scores, and bytes of their vectors: with positives and windows, what a task is given.
ANCHORS, ANCHOR_BYTES = 1 << 15, 1 << 25
#: Scores held at a time in a task, and rows and bytes that are scored together.
SCORES, RUN_ROWS, RUN_BYTES = 1 << 22, 1 << 15, 1 << 24
#: One row in so many is scored first, to bound from below what can still be among the first.
SEEDS = 64
_SIGN = 1 << 63
_SPREAD = 0x9E3779B97F4A7C15
_KEY = struct.Struct(">QQBQ")
_FOUND = "anchor long, kind int, id long, score long"
POSITIVE, NEGATIVE = 0, 1


# ---------------------------------------------------------------- packed keys


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """A key whose bytes order by anchor, descending score, positives before negatives, id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, kind, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, row - _SIGN


def secondary_sort(found: DataFrame, walk: Callable[[Iterator[bytes]], Iterable[tuple]], schema: str) -> DataFrame:
    """``found`` (anchor, kind, id, score) shuffled by anchor, sorted by packed key within each partition, and walked.

    Partitions are the hash ranges of anchors; the sort spills. ``walk`` sees a partition's keys in order, one at a time.
    """
    spark = found.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = found.select("anchor", "score", "kind", "id").rdd.map(lambda r: (pack(*r), None))
    ordered = keyed.repartitionAndSortWithinPartitions(many, lambda key: int.from_bytes(key[:8], "big") * _SPREAD >> 64)
    return spark.createDataFrame(ordered.mapPartitions(lambda it: walk(key for key, _ in it)), schema)


def _different(keys: Iterator[bytes]) -> Iterator[tuple[int, int, int, int]]:
    last = None
    for key in keys:
        if key != last:
            yield unpack(key)
        last = key


def first_of_each(most: int) -> Callable:
    """The first ``most`` keys of each anchor."""

    def walk(keys: Iterator[bytes]) -> Iterator[tuple]:
        at, n = None, 0
        for anchor, score, kind, row in _different(keys):
            if anchor != at:
                at, n = anchor, 0
            if n < most:
                n += 1
                yield anchor, kind, row, score

    return walk


def open_windows(low: int, high: int, most: int) -> Callable:
    """Each positive opens a window of scores when it passes; negatives fall into the open windows until these are full.

    Keys come by descending score, so a positive passes before all negatives of its window, and what is held is the open windows
    of one anchor.
    """

    def walk(keys: Iterator[bytes]) -> Iterator[tuple]:
        at, windows = None, []
        for anchor, score, kind, row in _different(keys):
            if anchor != at:
                at, windows = anchor, []
            if kind == POSITIVE:
                windows.append([row, score, 0])
                continue
            for w in windows:
                if low * w[1] <= 100 * score <= high * w[1]:
                    w[2] += 1
                    yield anchor, w[0], w[2], row, w[1], score
            windows = [w for w in windows if w[2] < most and 100 * score >= low * w[1]]

    return walk


# ---------------------------------------------------------------- scoring in blocks


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    within = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    keep = within < width
    out[np.repeat(np.arange(len(sizes)), sizes)[keep], within[keep]] = values[keep]
    return out


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0.0)))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, in the smallest type that holds every partial sum.

    No partial sum is over the product of the norms, so below 2^24 or 2^53 floats are exact; above, whole numbers are used.
    """
    bound = 1.01 * _norm(a) * _norm(b)
    if bound < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if bound < 1 << 62:
        return a @ b.T
    raise OverflowError("a score may pass 64 bits")


def _best(scores: np.ndarray, allowed: np.ndarray, floor: np.ndarray, most: int, ids: np.ndarray, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``most`` allowed scores of each row, none under its floor; ties by smaller id, equal pairs of id and score once."""
    low = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    held = np.where(allowed & (scores >= floor[:, None]), scores, low)
    if held.shape[1] > most and not repeats:
        edge = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
        r, c = np.nonzero((held >= edge[:, None]) & (held > low))
    else:
        r, c = np.nonzero(held > low)
    order = np.lexsort((ids[c], -held[r, c], r))
    r, c = r[order], c[order]
    if repeats:
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]]) | (held[r[1:], c[1:]] != held[r[:-1], c[:-1]])
        r, c = r[new], c[new]
    first = np.arange(len(r)) - np.searchsorted(r, r) < most
    return r[first], c[first]


class Anchors:
    """A block of anchors as arrays: ids, labels, vectors, and for negatives the score bounds of each window."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        vectors = rows.column("vector").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        self.ids = np.asarray(rows.column("id"))
        self.labels = np.asarray(rows.column("label"))
        self.width = int(np.diff(np.asarray(vectors.offsets)).max(initial=0))
        self.vectors = _matrix(vectors, self.width)


def _scorer(anchors: Anchors, windows: tuple[np.ndarray, np.ndarray] | None, floors: np.ndarray, most: int, seeding: bool = False):
    """Batches (id, label, vector) scored against all anchors; what may be among the first of an anchor comes out.

    Without ``windows`` same-label rows are looked for, with them (lowest and highest score, an anchor a row, a window a column) rows of
    other labels. ``floors`` are under the last score of the first. Rows are brought together to runs, and what one run finds is
    passed on, so a task holds a run and some of its scores. ``seeding`` gives the window in place of the kind.
    """
    kind = POSITIVE if windows is None else NEGATIVE

    def found(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // len(ids))
        repeats = len(np.unique(ids)) < len(ids)
        for at in range(0, len(anchors.ids), step):
            to = min(at + step, len(anchors.ids))
            scores = exact_products(anchors.vectors[at:to], vectors)
            same = anchors.labels[at:to, None] == labels[None, :]
            picked = []
            for w in range(floors.shape[1]):
                if windows is None:
                    allowed = same & (anchors.ids[at:to, None] != ids[None, :])
                else:
                    lows, highs = (x[at:to, w, None].astype(scores.dtype) for x in windows)
                    allowed = ~same & (scores >= lows) & (scores <= highs)
                r, c = _best(scores, allowed, floors[at:to, w], most, ids, repeats)
                picked.append((r, c, np.full(len(r), w if seeding else kind, np.int32)))
            r, c, k = map(np.concatenate, zip(*picked, strict=True))
            if not seeding:  # windows overlap
                both = np.unique(r * len(ids) + c)
                r, c, k = both // len(ids), both % len(ids), np.full(len(both), kind, np.int32)
            arrays = [anchors.ids[at + r], k, ids[c], scores[r, c].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["anchor", "kind", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2), anchors.width)))
                n += batch.num_rows
            if n >= RUN_ROWS or n * anchors.width * 8 >= RUN_BYTES:
                yield from found(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from found(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _floors(seeded: DataFrame, anchors: Anchors, windows: int, most: int) -> np.ndarray:
    """A bound just under the ``most``-th best score that the seeds hold for each anchor and window, or none."""
    turn = Window.partitionBy("anchor", "kind").orderBy(F.desc("score"), "id")
    last = seeded.distinct().withColumn("turn", F.row_number().over(turn)).where(F.col("turn") == most).select("anchor", "kind", "score").toArrow()
    floors = np.full((len(anchors.ids), windows), float("-inf"))
    order = np.argsort(anchors.ids)
    if last.num_rows:
        place = order[np.searchsorted(anchors.ids[order], np.asarray(last.column("anchor")))]
        # a float under the score, so that nothing is held back by rounding
        floors[place, np.asarray(last.column("kind"))] = np.nextafter(np.asarray(last.column("score")).astype(np.float64), -np.inf)
    return floors


def _windows(anchors: Anchors, positives: pa.Table, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest negative score of each positive, by anchor; windows that do not exist are empty."""
    lows = np.full((len(anchors.ids), most), np.iinfo(np.int64).max)
    highs = np.full((len(anchors.ids), most), np.iinfo(np.int64).min)
    place = {int(i): n for n, i in enumerate(anchors.ids)}
    seen: dict[int, int] = {}
    for anchor, score in zip(positives.column("anchor").to_pylist(), positives.column("score").to_pylist(), strict=True):
        n, w = place[anchor], seen.get(anchor, 0)
        seen[anchor] = w + 1
        lows[n, w], highs[n, w] = -(-low * score // 100), high * score // 100
    return lows, highs


# ---------------------------------------------------------------- operator


def scaled_vector(col: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    x = F.col(quoted(col))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor's positives and their hard negatives.

    ``rows`` and ``anchors``: (id long, label, vector array<long>). A score is the inner product, exact. An anchor's positives are its first
    ``positives`` other rows of the same label, by descending score, then id; each positive's negatives are the first
    ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive.

    Anchors are a stated query set, taken in blocks of about ``block`` (chosen by hash), so what a task is given and the driver holds is bounded (also by bytes of vectors); a block reads
    the rows without shuffling them. A run of rows gives, for each anchor, only what may still be among the first, above a floor
    that one row in SEEDS has set before. These pairs are packed into (anchor, descending score, kind, id) keys, shuffled by
    anchor and sorted by ``repartitionAndSortWithinPartitions``, and an iterator opens the windows of an anchor as its positives pass. No anchor's
    rows are held.

    Rows with a null id, label or vector take no part; a row that repeats an id stands for itself, but equal pairs count once, and no row of
    an anchor's own id is its positive; of anchors that share an id the least by label and vector is taken. Missing components
    count as 0. Where positives score 0 or less a window is empty, or holds 0 alone. Scores that may pass 64 bits raise OverflowError.
    Empty tables give no rows.
    """
    spark = rows.sparkSession
    whole = "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"
    rows = materialise(rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").where(whole), "vectors")
    chosen = anchors.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").where(whole)
    chosen = materialise(chosen.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"), "anchors")
    many, width = chosen.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-many // max(1, min(block, ANCHOR_BYTES // (8 * max(width or 0, 1))))))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = f"{scratch_root(spark)}/negatives-{uuid.uuid4().hex}"
    seeds = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SEEDS)) == 0)
    for b in range(blocks):
        some = Anchors(chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow())

        def found(windows, most, some=some) -> DataFrame:
            columns = 1 if windows is None else positives
            none = np.full((len(some.ids), columns), float("-inf"))
            floors = _floors(seeds.mapInArrow(_scorer(some, windows, none, most, True), _FOUND), some, columns, most)
            return rows.mapInArrow(_scorer(some, windows, floors, most), _FOUND)

        best = materialise(secondary_sort(found(None, positives), first_of_each(positives), _FOUND), "positives")
        windows = _windows(some, best.toArrow(), low, high, positives)
        pairs = found(windows, negatives).union(best)
        secondary_sort(pairs, open_windows(low, high, negatives), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), scaled_vector("embedding").alias("vector"))
    return hard_negatives(rows, rows.where("id % 50 = 0"))


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
         s.id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {"op11_hard_negatives": OP11_SQL}
