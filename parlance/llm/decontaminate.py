"""Operator 5: benchmark decontamination by n-gram seeds and Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _GOLDEN, _STEP, Words, document_filter, filter_bucket, free_name, hash_filter, in_filter, materialise, mix, quoted, slices, spread_join, table, text_or_empty, written

#: Words of a seed; a seed that more than MOST_ITEMS item texts share is made longer, up to LONGEST words.
SEED, LONGEST, MOST_ITEMS = 3, 8, 32
#: Entries of a seed, and hits of a document, in one row, about.
ENTRIES, HITS = 256, 1 << 16
#: What parts the hashes of seeds by their words and kind.
_TAG = np.arange(64, dtype=np.uint64) * np.uint64(_GOLDEN)
#: Words of benchmark items that are sent to the tasks at once, at most (8 MB).
BLOCK_WORDS = 1 << 20
#: Alignment: points for an equal word, and off for an unequal or a missing one.
MATCH, UNEQUAL, GAP = 2, 1, 1
_AT_ONCE = 1 << 21


# ---------------------------------------------------------------- seeds


def _runs(code: np.ndarray, row: np.ndarray, kinds: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(size, gapped, first words, hashes) of the runs of so many words within one text. Gapped runs leave out every third
    word, so a passage with every third word changed still has them."""
    for gapped in (0, 1):
        sizes = {size for size, g in kinds if g == gapped}
        h = np.zeros(len(code), np.uint64)
        for size in range(1, max(sizes, default=0) + 1):
            last = size - 1 + gapped * ((size - 1) // 2)
            m = len(code) - last
            if m <= 0:
                break
            h = h[:m] + code[last:] * _STEP[size - 1]
            if size in sizes:
                at = np.flatnonzero(row[:m] == row[last:])
                yield size, gapped, at, mix(h[at] + _TAG[size + 32 * gapped])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in slices(batch.column(1)):
            w = Words(data, offsets, plain=True)
            words = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.code.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), words], names=["key", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1)
        length = np.asarray(words.value_lengths()).astype(np.int64)
        code = np.asarray(words.flatten()).view(np.uint64)
        row = np.repeat(np.arange(len(length)), length)
        first = np.cumsum(length) - length
        for size, gapped, at, h in _runs(code, row, [(n, 0) for n in range(1, LONGEST + 1)] + [(n, 1) for n in range(SEED, LONGEST + 1)]):
            # an item shorter than a seed is one as a whole
            ok = np.minimum(length[row[at]], SEED) <= size
            at, h = at[ok], h[ok]
            keys = batch.column(0).take(pa.array(row[at]))
            place = (at - first[row[at]]).astype(np.int32)
            kind = [pa.array(np.full(len(at), x, np.int32)) for x in (size, gapped)]
            yield pa.RecordBatch.from_arrays([keys, *kind, pa.array(place), pa.array(h.view(np.int64))], names=["key", "size", "gapped", "place", "h"])


def rare_seeds(items: DataFrame) -> DataFrame:
    """(h, size, gapped, part, entries): the seeds of the item texts (key, words), entries = array of (key, place, length), in
    parts of about ENTRIES.

    At each place, of either kind, the shortest run of SEED words or more that MOST_ITEMS texts or fewer share, however often
    it occurs in the corpus; where all runs are shared by more, as in the stem of a template, the longest of them. A text all of
    whose runs are shared by more keeps its runs of SEED words. So rarity makes seeds longer and no place goes without one.
    """
    runs = materialise(items.select("key", "words").mapInArrow(_item_seeds, "key long, size int, gapped int, place int, h long"), "runs")
    shared = runs.select("h", "key").distinct().groupBy("h").agg(F.count("*").alias("n"))
    shared = materialise(shared, "shared")
    known = runs.join(shared.hint("merge"), "h").withColumn("rare", F.col("n") <= MOST_ITEMS)
    seed = F.struct("h", "size", "rare")
    # of rare runs the shortest, before any that is not, and of those the longest
    order = F.when(F.col("rare"), F.col("size")).otherwise(3 * LONGEST - F.col("size"))
    chosen = materialise(known.groupBy("key", "place", "gapped").agg(F.min_by(seed, order).alias("seed")).select("key", "place", "gapped", "seed.*"), "chosen")
    rare = chosen.where("rare").select("key").distinct()
    others = runs.join(rare, "key", "left_anti").withColumn("least", F.min("size").over(Window.partitionBy("key"))).where("size = least")
    columns = ["key", "place", "h", "size", "gapped"]
    chosen = chosen.join(rare, "key", "left_semi").select(*columns).unionByName(others.select(*columns))
    chosen = materialise(chosen.join(items.select("key", F.size("words").alias("length")), "key"), "chosen")
    many, seen = written(chosen.groupBy("h").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / ENTRIES)), "many", "n")
    dealt = spread_join(chosen, many, ["h"], ["key", "place"], seen=seen).withColumn("part", F.pmod(F.xxhash64("key", "place"), "parts"))
    return dealt.groupBy("h", "part").agg(*[F.min(c).alias(c) for c in ("size", "gapped")], F.collect_list(F.struct("key", "place", "length")).alias("entries"))


def _corpus_seeds(bits: np.ndarray, kinds: list[tuple[int, int]]) -> Callable:
    """Places of the runs of a document that may be seeds: those in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets, plain=True)
                for _, _, at, h in _runs(w.code, w.row, kinds):
                    bucket = (mix(h) % np.uint64(64 * len(bits))).astype(np.int64)
                    some = ((bits[bucket >> 6] >> (bucket & 63)) & 1).astype(bool)
                    at, found = at[some], h[some].view(np.int64)
                    docs = batch.column(0).take(pa.array(w.row[at] + i))
                    place = (at - w.first[w.row[at]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(place), pa.array(found)], names=["doc", "place", "h"])

    return run


# ---------------------------------------------------------------- alignment


class Items:
    """The words of item texts of one block, by their keys in order."""

    def __init__(self, keys: np.ndarray, codes: list[np.ndarray]) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.codes = keys[order], [codes[i] for i in order]
        self.length = np.array([len(c) for c in self.codes], np.int64)


def smith_waterman(query: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score, and the window's word at its end, of each row of codes against a row of words.

    Both are padded with 0, which equals nothing. Rows of the score matrix follow one another; within a row the
    best run of gaps is a running maximum.
    """
    n, wide = window.shape
    slope = np.arange(wide, dtype=np.int32) * GAP
    h = np.zeros((n, wide), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(query.shape[1]):
        q = query[:, i : i + 1]
        step = np.where((window == q) & (q != 0), MATCH, -UNEQUAL).astype(np.int32)
        step[:, 1:] += h[:, :-1]
        row = np.maximum(np.maximum(step, h - GAP), 0)
        row = np.maximum(row, np.maximum.accumulate(row + slope, axis=1) - slope)
        h = row
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _windows(row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, count: np.ndarray, words: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(row, item, from word, to word, seeds) of the passages that seeds point to, ``count`` of them on each diagonal;
    words: how many each text has."""
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal, count = row[order], item[order], diagonal[order], count[order]
    length = items.length[item]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > np.maximum(8, length[1:] // 2))
    first = np.flatnonzero(new)
    seeds = np.add.reduceat(count, first) if len(first) else count
    row, item, low = row[first], item[first], diagonal[first]
    high = np.maximum.reduceat(diagonal, first) if len(first) else diagonal
    margin = items.length[item] // 4 + 4
    return row, item, np.maximum(low - margin, 0), np.minimum(high + items.length[item] + margin, words[row]), seeds


def _align(items: Items, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                hits = batch.column(2).slice(i, j - i)
                entries = hits.flatten()
                key, diagonal = np.asarray(entries.field("key")), np.asarray(entries.field("diagonal")).astype(np.int64)
                row = np.repeat(np.arange(j - i), np.asarray(hits.value_lengths()))
                at = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
                own = items.keys[at] == key
                w = Words(data, offsets, plain=True)
                count = np.asarray(entries.field("seeds")).astype(np.int64)
                row, item, low, high, seeds = _windows(row[own], at[own], diagonal[own], count[own], np.diff(w.first), items)
                ok = high > low
                row, item, low, high, seeds = row[ok], item[ok], low[ok], high[ok], seeds[ok]
                size = np.lexsort((items.length[item], high - low))
                score, end = np.zeros(len(row)), np.zeros(len(row), np.int64)
                at = 0
                while at < len(size):
                    # windows of like width, as many as fit the cells held at once
                    count = max(1, min(len(size) - at, 4096))
                    wide = int((high - low)[size[at + count - 1]])
                    count = max(1, min(count, _AT_ONCE // max(wide, 1)))
                    some = size[at : at + count]
                    at += count
                    wide, deep = int((high - low)[some].max()), int(items.length[item[some]].max())
                    places = low[some][:, None] + np.arange(wide)
                    inside = places < high[some][:, None]
                    words = np.where(inside, w.code[np.minimum(w.first[row[some]][:, None] + places, len(w.code) - 1)], np.uint64(0))
                    query = np.zeros((len(some), deep), np.uint64)
                    for k, it in enumerate(item[some]):
                        query[k, : items.length[it]] = items.codes[it]
                    best, last = smith_waterman(query, words)
                    score[some] = best / (MATCH * items.length[item[some]])
                    end[some] = low[some] + last
                ok = np.flatnonzero(score >= least)
                ids = batch.column(0).take(pa.array(row[ok] + i))
                out = [ids, pa.array(items.keys[item[ok]]), pa.array(score[ok]), pa.array(seeds[ok]), pa.array(end[ok])]
                yield pa.RecordBatch.from_arrays(out, names=["id", "key", "score", "seeds", "last_word"])

    return run


def _only_filtered(bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield in_filter(bits, batch)

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, item_id, score, seeds, last_word) of every document and benchmark item that align well.

    Words are runs of letters and digits, ASCII letters in lower case. Rare seeds (``rare_seeds``) of the items, runs
    with and without gaps, are joined with those of the documents by their hashes; each item is aligned (Smith-Waterman
    over words) with the passages its seeds point to. The score is the best local alignment as a share of a full one of the whole
    item; pairs of ``least`` or more are kept, each once with its best passage.

    The corpus is read twice, whatever the benchmark: once for seeds, of which only those in a filter of bounded
    size leave their task, and once for the documents that share some. A seed of very many documents is dealt to
    several tasks, one of very many items meets them in parts, and so do the items that one document meets. Items are
    sent to the tasks in blocks of BLOCK_WORDS words.

    Ids of both sides have any type; a null id stays null, and items that share an id are versions of it, of
    which the best counts, as are rows of ``docs`` that share an id. Null and empty texts align with nothing; an
    item shorter than a seed is found where all its words stand in a row; very long texts are aligned only around
    their seeds. Repeated rows change nothing; an empty table on either side gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).where("text IS NOT NULL")
    source = source.withColumn("doc", F.xxhash64("id", "text"))
    known = benchmark.select(F.col(quoted(item_col)).alias("item_id"), text_or_empty(F.col(quoted(item_text)).cast("string")).alias("text"))
    known = materialise(known.select("item_id", "text", F.xxhash64("text").alias("key")).distinct(), "items")
    items = known.groupBy("key").agg(F.min("text").alias("text")).mapInArrow(_item_words, "key long, words array<long>")
    items = materialise(items.where("size(words) > 0"), "words")
    seeds, seen = written(rare_seeds(items), "seeds")
    bits, kinds = hash_filter(seeds, 64, many=seen.rows), sorted((r["size"], r["gapped"]) for r in seeds.select("size", "gapped").distinct().collect())
    found = source.select("doc", "text").mapInArrow(_corpus_seeds(bits, kinds), "doc long, place int, h long")
    found = materialise(found, "found")
    often, met_often = written(found.groupBy("h").agg(F.count("*").alias("n")).join(seeds.select("h", "part", "entries").hint("merge"), "h"), "often", "n")
    wide, seen = written(often.groupBy("h").agg(F.min("n").alias("n"), (F.max("part") + 1).alias("parts")).where("parts > 1"), "wide", "n")
    if not seen.rows:
        found = found.withColumn("part", F.lit(0).cast("long"))
    else:
        # a seed of several parts meets each of them
        found = spread_join(found, wide, ["h"], ["doc", "place"], "left", seen=seen)
        found = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    hits = spread_join(found, often, ["h", "part"], ["doc", "place"], seen=met_often).select("doc", "place", F.explode("entries").alias("e"))
    # equal diagonals of a document and an item are one row before anything moves
    hits = hits.groupBy("doc", F.col("e.key").alias("key"), (F.col("place") - F.col("e.place")).alias("diagonal")).agg(F.count("*").alias("seeds"))
    hits = materialise(hits, "met")
    large, seen = written(hits.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") > HITS).withColumn("parts", F.ceil(F.col("n") / HITS)), "large", "n")
    if not seen.rows:
        hits = hits.withColumn("parts", F.lit(1))
    else:
        hits = spread_join(hits, large, ["doc"], ["key"], "left", seen=seen).withColumn("parts", F.coalesce("parts", F.lit(1)))
    hit = F.struct("key", "diagonal", "seeds")
    hits = materialise(hits.groupBy("doc", F.pmod(F.xxhash64("key"), "parts").alias("part")).agg(F.collect_list(hit).alias("hits")).drop("part"), "hits")
    wanted = document_filter(hits.select("doc"), "doc")
    texts = source.select("id", "text", "doc", filter_bucket(wanted, "doc")).mapInArrow(_only_filtered(wanted), f"id {id_type}, text string, doc long")
    met = texts.join(hits, "doc").select("id", "text", "hits")
    blocks = int((items.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS) + 1
    met = materialise(met, "met") if blocks > 1 else met
    aligned = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
        block = Items(np.asarray(part.column("key")).astype(np.int64), [np.asarray(x.values).view(np.uint64) for x in part.column("words")])
        if not len(block.keys):
            continue
        got = met.mapInArrow(_align(block, least), f"id {id_type}, key long, score double, seeds long, last_word long")
        aligned = got if aligned is None else aligned.unionByName(got)
    if aligned is None:
        aligned = met.sparkSession.createDataFrame([], f"id {id_type}, key long, score double, seeds long, last_word long")
    best = F.max(F.struct("score", "seeds", "last_word")).alias("best")
    aligned = aligned.groupBy("id", "key").agg(best).join(known.select("key", "item_id"), "key")
    return aligned.groupBy("id", "item_id").agg(F.max("best").alias("best")).select("id", "item_id", "best.score", "best.seeds", "best.last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, id_col: str = "doc_id", text_col: str = "text", **items: str) -> DataFrame:
    """The documents that align with no benchmark item, with all their columns, whatever their names. Rows of an
    id go together; nulls, empties and repeats are as in ``contaminated``, and without items all rows stay."""
    bad = free_name("__bad", docs.columns)
    found = contaminated(docs, benchmark, least, id_col, text_col, **items).select(F.col("id").alias(bad)).distinct()
    found = materialise(found, "contaminated")
    return docs.join(found, docs[quoted(id_col)].eqNullSafe(F.col(bad)), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL: dict[str, str] = {}
