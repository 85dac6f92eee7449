"""Operator 12: collocations from suffix subtrees, partitioned vertically by word prefixes under a memory budget."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Words, hash_filter, materialise, mix, quoted, spread_join, table

#: Bytes of text that a task counts before it passes records on.
CHUNK_BYTES = 8 << 20
#: Occurrences that the prefixes of one group have together, about; a prefix over an eighth of it is made longer by a word.
BUDGET = 1 << 20
#: Hash buckets that are packed into groups: least and most.
BUCKETS = (1 << 10, 1 << 22)
#: 0 inside a word, 1 between words of a piece, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2
_RECORDS = "grp int, level int, lang string, size long, packed binary"
_NODES = "lang string, phrase binary, size int, f long"


# ---------------------------------------------------------------- words of a chunk


class Chunk:
    """The words of a run of texts: ``code`` of each (1 to ``many``, per language and word), ``piece`` numbers, and for each
    code its word, language and 64-bit hash."""

    def __init__(self, langs: list[str], texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offs, data = texts.buffers()
        offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        kind = _CLASS[raw]
        inside = kind == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        # a piece ends at its marks and with its text
        self.piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, start, side="right") - 1
        sizes = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(LOWER[raw[inside]])])
        seen = words.dictionary_encode()
        code, values = np.asarray(seen.indices).astype(np.int64), seen.dictionary
        self.langs = sorted(set(langs))
        place = {x: i for i, x in enumerate(self.langs)}
        of_lang = np.asarray([place[x] for x in langs], np.int64)
        key = (of_lang[row] if len(row) else np.zeros(0, np.int64)) * max(len(values), 1) + code
        if len(self.langs) * len(values) <= 1 << 24:
            there = np.bincount(key, minlength=1) > 0
            self.code, kept = np.cumsum(there, dtype=np.int32)[key], np.flatnonzero(there)
        else:
            kept, self.code = np.unique(key, return_inverse=True)
            self.code = (self.code + 1).astype(np.int32)
        self.many = len(kept)
        self.lang = kept // max(len(values), 1)
        self.word = values.take(pa.array(kept % max(len(values), 1)))
        hashes = np.asarray([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        _, offs, data = self.word.buffers()
        bounds = np.frombuffer(offs, np.int64)[self.word.offset : self.word.offset + len(self.word) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        codes = Words(raw[bounds[0] : bounds[-1]], bounds - bounds[0]).code if self.many else np.zeros(0, np.uint64)
        #: of each code, 0 for the end of a piece
        self.hash = np.concatenate([np.zeros(1, np.uint64), mix(codes ^ mix(hashes[self.lang]))]) if self.many else np.zeros(1, np.uint64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """(lang, text) batches as chunks of some CHUNK_BYTES; a longer text is one by itself."""
    langs, texts, size = [], [], 0
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
        i = 0
        while i < len(column):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + CHUNK_BYTES - size, side="right")))
            langs += batch.column(0).slice(i, j - i).to_pylist()
            texts.append(column.slice(i, j - i))
            size += int(ends[j - 1] - done)
            i = j
            if size >= CHUNK_BYTES:
                yield Chunk(langs, pa.concat_arrays(texts))
                langs, texts, size = [], [], 0
    if texts:
        yield Chunk(langs, pa.concat_arrays(texts))


# ---------------------------------------------------------------- suffixes and their prefixes


def suffixes(c: Chunk, depth: int, bits: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes (a column of ``depth`` codes each, 0 from their end on) and how often they occur.

    A suffix ends with its piece, or before the first word that the filter knows to be infrequent; one that starts with such a word is left out, as is
    one whose first code is not marked in ``first``.
    """
    bucket = (mix(c.hash) % np.uint64(64 * len(bits))).astype(np.int64)
    frequent = ((bits[bucket >> 6] >> (bucket & 63)) & 1).astype(bool)
    frequent[0] = False
    n, many = len(c.code), c.many + 1
    kept = np.flatnonzero((frequent if first is None else frequent & first)[c.code]) if n else np.zeros(0, np.int64)
    key, going, reach, packed = c.code[kept].astype(np.int64), np.ones(len(kept), bool), many, True
    columns = []
    for d in range(1, depth):
        at = np.minimum(kept + d, n - 1)
        going &= (kept + d < n) & frequent[c.code[at]] & (c.piece[at] == c.piece[kept])
        column = np.where(going, c.code[at], 0)
        if reach * many >= 1 << 62:  # too wide for one number: positions are kept, and what is there so far is renumbered
            packed = False
            key = np.unique(key, return_inverse=True)[1]
            reach = len(kept) + 1
        key, reach = key * many + column, reach * many
        columns.append(column)
    if packed:
        key.sort()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count, key = np.diff(np.append(new, len(key))), key[new]
        found = np.empty((depth, len(key)), np.int64)
        for d in range(depth - 1, -1, -1):
            found[d] = key % many
            key //= many
        return found, count
    _, place, count = np.unique(key, return_index=True, return_counts=True)
    return np.stack([c.code[kept[place]], *(x[place] for x in columns)]), count


def prefixes(c: Chunk, found: np.ndarray, hot: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the prefix that stands for each suffix, and its words: a word more for each hot prefix.

    ``hot[0]`` holds hashes of words; the others mark, of all buckets, those whose longer prefixes are hot.
    """
    at, level = c.hash[found[0]], np.ones(found.shape[1], np.int64)
    where = np.flatnonzero(np.isin(c.hash, hot[0])[found[0]])
    for d in range(1, len(found)):
        at[where] = mix(at[where] * np.uint64(31) + c.hash[found[d, where]] + np.uint64(d))
        level[where] += 1
        if d < len(found) - 1:
            where = where[hot[d][(at[where] % np.uint64(buckets)).astype(np.int64)]]
    return (at % np.uint64(buckets)).astype(np.int64), level


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        langs = pa.array(c.langs, pa.string()).take(pa.array(c.lang))
        f = np.bincount(c.code, minlength=c.many + 1)[1:]
        arrays = [langs, c.word.cast(pa.binary()), pa.array(c.hash[1:].view(np.int64)), pa.array(f)]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "h", "f"])


def _prefix_counts(depth: int, bits: np.ndarray, hot: list[np.ndarray], buckets: int):
    """Occurrences in each bucket of the prefixes of ``depth`` words whose shorter prefixes are hot at every length; once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(buckets, np.int64)
        for c in chunks(batches):
            found, count = suffixes(c, depth, bits, np.isin(c.hash, hot[0]))
            at, level = prefixes(c, found, hot, buckets)
            np.add.at(load, at[level == depth], count[level == depth])
        some = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(load[some])], names=["bucket", "load"])

    return run


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def pack_suffixes(codes: np.ndarray, count: np.ndarray, words: pa.Array) -> tuple[int, bytes]:
    """(size, compressed bytes) of suffixes in order: codes (from 1) into a list of words, a column for each depth, and counts."""
    codes = codes.copy()
    codes[0, 1:] -= codes[0, :-1].copy()
    parts = [_narrow(x) for x in (*codes, count)]
    _, offs, data = words.buffers()
    at = np.frombuffer(offs, np.int32)[words.offset : words.offset + len(words) + 1]
    text = np.full(int(at[-1] - at[0]) + len(words), 32, np.uint8)
    ends = np.arange(1, len(words) + 1) + (at[1:] - at[0]) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    head = np.asarray([len(count), len(words), *(x.itemsize for x in parts)], np.int64)
    whole = b"".join([head.tobytes(), *(x.tobytes() for x in parts), text.tobytes()])
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def unpack_suffixes(size: int, packed: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, counts, bytes of the words, each followed by a space) as they were packed."""
    whole = np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), np.uint8)
    n, _, *widths = whole[: 8 * (depth + 3)].view(np.int64).tolist()
    at, parts = 8 * (depth + 3), []
    for width in widths:
        parts.append(np.frombuffer(whole[at : at + n * width].tobytes(), f"u{width}").astype(np.int64))
        at += n * width
    parts[0] = np.cumsum(parts[0])
    return np.stack(parts[:-1]), parts[-1], whole[at:]


def _records(depth: int, bits: np.ndarray, hot: list[np.ndarray], groups: np.ndarray):
    """A packed row for each group and language of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            found, count = suffixes(c, depth, bits)
            if not len(count):
                continue
            at, level = prefixes(c, found, hot, len(groups))
            # nodes of fewer words than the prefix that chose the group have leaves in other groups too
            key = (groups[at].astype(np.int64) * (depth + 1) + level) * len(c.langs) + c.lang[found[0] - 1]
            order = np.argsort(key, kind="stable")
            key, found, count = key[order], found[:, order], count[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes, packed = [], []
            for a, b in zip(new, np.append(new[1:], len(key)), strict=True):
                held = np.unique(found[:, a:b])
                held = held[held > 0]
                codes = np.where(found[:, a:b] > 0, np.searchsorted(held, found[:, a:b]) + 1, 0)
                size, content = pack_suffixes(codes, count[a:b], c.word.take(pa.array(held - 1)).cast(pa.binary()))
                sizes.append(size)
                packed.append(content)
            which = key[new]
            langs = pa.array(c.langs, pa.string()).take(pa.array(which % len(c.langs)))
            rest = which // len(c.langs)
            arrays = [pa.array((rest // (depth + 1)).astype(np.int32)), pa.array((rest % (depth + 1)).astype(np.int32)), langs, pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["grp", "level", "lang", "size", "packed"])

    return run


# ---------------------------------------------------------------- subtrees of a group


def _subtrees(depth: int, least: int):
    """The suffix subtrees of one group, cut at ``depth``: suffixes are sorted, equal ones are a leaf, and a node has the total of its leaves."""

    def run(records: pa.Table) -> pa.Table:
        langs, texts, codes, counts, rows = records.column("lang").to_pylist(), [], [], [], []
        for size, packed in zip(records.column("size").to_pylist(), records.column("packed").to_pylist(), strict=True):
            code, count, text = unpack_suffixes(size, packed, depth)
            texts.append(text)
            codes.append(code)
            counts.append(count)
            rows.append(len(count))
        many = np.asarray([int((t == 32).sum()) for t in texts])
        text = np.concatenate(texts)
        gap = text == 32
        bounds = np.concatenate([[0], np.cumsum(~gap)[gap]]).astype(np.int64)
        seen = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text[~gap])]).dictionary_encode()
        words, size = seen.dictionary, len(seen.dictionary)
        names = sorted(set(langs))
        of_row = np.asarray([names.index(x) for x in langs])
        # words of all rows in one numbering, by language; 0 is the end
        number = np.concatenate([[0], np.repeat(of_row, many) * size + np.asarray(seen.indices) + 1])
        begin = np.repeat(np.cumsum(many) - many, rows)
        level = np.repeat(np.concatenate([np.asarray(x) for x in records.column("level").chunks]), rows)
        code, count = np.concatenate(codes, 1), np.concatenate(counts)
        del codes, counts, texts
        columns = [number[np.where(x > 0, begin + x, 0)] for x in code]
        order = np.lexsort(columns[::-1])
        columns, level, total = [x[order] for x in columns], level[order], np.concatenate([[0], np.cumsum(count[order])])
        new = np.zeros(len(order), bool)
        new[:1] = True
        out = []
        for d in range(depth):
            new[1:] |= columns[d][1:] != columns[d][:-1]
            node = np.flatnonzero(new)
            f = total[np.append(node[1:], len(order))] - total[node]
            keep = (columns[d][node] > 0) & ((f >= least) | (level[node] > d + 1))
            if d:  # words themselves are counted before
                node, f = node[keep], f[keep]
                parts = [words.take(pa.array((columns[k][node] - 1) % size)) for k in range(d + 1)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())
                lang = pa.array(names, pa.string()).take(pa.array((columns[0][node] - 1) // size))
                out.append(pa.table([lang, phrase, pa.array(np.full(len(node), d + 1, np.int32)), pa.array(f)], names=["lang", "phrase", "size", "f"]))
        return pa.concat_tables(out)

    return run


# ---------------------------------------------------------------- operator


def pack(loads: np.ndarray, budget: int) -> np.ndarray:
    """The group of each bucket: neighbours go together as long as their loads stay within the budget."""
    out, group, held = np.zeros(len(loads), np.int32), 0, 0
    for i, load in enumerate(loads.tolist()):
        if held and held + load > budget:
            group, held = group + 1, 0
        out[i] = group
        held += load
    return out


def _by_bucket(sums: DataFrame, buckets: int) -> np.ndarray:
    got, out = sums.select("bucket", "load").toArrow(), np.zeros(buckets, np.int64)
    out[np.asarray(got.column("bucket")).astype(np.int64)] = np.asarray(got.column("load")).astype(np.int64)
    return out


def phrase_counts(texts: DataFrame, depth: int, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, n), and (lang, phrase, size, f) of every phrase of 1 to ``depth`` words that occurs ``least`` times or more.

    ``texts``: (lang, text). Vertical partitioning: prefixes of one word are counted; one that occurs more often than an eighth of the
    budget is made longer by a word and counted again, up to ``depth``. Prefixes fall into hash buckets (longer ones are found hot by bucket), and neighbouring
    buckets into groups of the budget. Each group's suffixes, pre-aggregated per chunk of text, are shuffled to one task, which sorts them into subtrees cut at
    ``depth`` and reads the counts from the totals of their leaves. A node whose leaves were dealt to several groups is added up.

    What the driver holds is bounded: a filter of frequent words (8 MB at most, which only holds back), words over an eighth of
    the budget (8 * all words / budget at most), a sum for each bucket.
    """
    spark = texts.sparkSession
    words = texts.mapInArrow(_word_counts, "lang string, word binary, h long, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"), F.first("h").alias("h"))
    words = materialise(words, "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    bits = hash_filter(frequent.select("h"))
    limit = max(1, budget // 8)
    every = frequent.agg(F.sum("f")).first()[0] or 0
    buckets = 1 << int(np.clip(np.ceil(np.log2(max(32 * every / budget, 1))), *np.log2(BUCKETS)))
    over = frequent.where(F.col("f") > limit).select("h").toArrow()
    hot = [np.asarray(over.column("h")).astype(np.int64).view(np.uint64)]
    sums = frequent.where(F.col("f") <= limit).groupBy(F.col("h").bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.sum("f").alias("load"))
    loads = _by_bucket(sums, buckets)
    for d in range(2, depth + 1):
        more = np.zeros(buckets, np.int64)
        if hot[-1].any():
            found = texts.mapInArrow(_prefix_counts(d, bits, hot, buckets), "bucket long, load long")
            more = _by_bucket(found.groupBy("bucket").agg(F.sum("load").alias("load")), buckets)
        hot.append((more > limit) & (d < depth))
        loads += np.where(hot[-1], 0, more)
    records = texts.mapInArrow(_records(depth, bits, hot, pack(loads, budget)), _RECORDS)
    nodes = records.groupBy("grp").applyInArrow(_subtrees(depth, least), _NODES)
    nodes = nodes.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    single = frequent.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("size"), "f")
    return totals, materialise(nodes.union(single), "nodes")


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact: no product passes 38 digits below counts of 10^16."""
    wide = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in (a, l, r)}
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {wide[a]} * {wide[a]}) div ({wide[l]} * {wide[r]})")


def collocations(
    docs: DataFrame, most_words: int = 3, least: int = 10, within: int = 50, top: int = 2000, budget: int = BUDGET, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The strongest phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A phrase of 2 to
    ``most_words`` words that occurs ``least`` times or more (a) is a candidate; at each place it can be cut in two parts that occur l and r times, with
    score floor(1000000 a a / (l r)), and the lowest counts (ties: the first place). Candidates inside a longer candidate
    that occurs at least ``within`` percent as often go. The first ``top`` by score, a and phrase are returned. n is the number of words.

    Counts come from ``phrase_counts``. Parts are looked up by joins in which the rows of a frequent part are dealt to several tasks; ranking first cuts
    each of 256 hash slices to ``top``.

    A null text is empty; texts without words give nothing; a null language is ``und``. Rows that repeat count as often as they stand there. A
    very long text is one chunk of its task. Other columns are not read. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(quoted(lang_col)), F.lit("und")).alias("lang"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    totals, nodes = phrase_counts(texts, most_words, least, budget)
    parts = F.split("phrase", " ")
    slices = lambda begin, size: F.array_join(F.slice(parts, begin, size), " ")
    found = nodes.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.posexplode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at", "k"))
    found = found.select("lang", "phrase", "size", "a", "k", slices(F.lit(1), F.col("k")).alias("left"), slices(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    # a part begins (or ends) at most f / least candidates of a length
    part = nodes.where(F.col("size") < most_words)
    of = lambda side, f: part.select("lang", F.col("phrase").alias(side), F.col("f").alias(f), (F.floor(F.col("f") / least) * (most_words - 1) + 1).alias("many"))
    cut = spread_join(found, of("left", "l"), ["lang", "left"], ["phrase"], number="many")
    cut = spread_join(cut, of("right", "r"), ["lang", "right"], ["phrase"], number="many")
    cut = cut.withColumn("score", _score("a", "l", "r"))
    scored = cut.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # the phrases inside a candidate, shorter than it
    spans = [(b, s) for s in range(2, most_words) for b in range(1, most_words - s + 2)]
    inner = nodes.where("size > 2").select(
        "lang", "f", F.explode(F.array_distinct(F.filter(F.array(*[F.when((F.lit(b + s - 1) <= F.col("size")) & (F.col("size") > s), slices(b, s)) for b, s in spans]), lambda x: x.isNotNull()))).alias("phrase")
    ) if spans else nodes.where("false").select("lang", "f", "phrase")
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(within)} * a"))
    rows = kept.join(totals, "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slice_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    rows = rows.withColumn("turn", F.row_number().over(slice_of)).where(F.col("turn") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (
  SELECT lang, w1, w2, w3, count(*) AS f
  FROM (SELECT lang, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3 FROM w)
  WHERE w1 IS NOT NULL GROUP BY ALL),
f AS (
  SELECT lang, w1 AS phrase, 1 AS size, sum(f) AS f FROM s GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, sum(f) FROM s WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, sum(f) FROM s WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, CAST(f AS HUGEINT) AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
t AS (
  SELECT k.lang, k.phrase, k.a, k.k, CAST(l.f AS HUGEINT) AS l, CAST(r.f AS HUGEINT) AS r, 1000000 * k.a * k.a // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM k JOIN f l ON k.lang = l.lang AND array_to_string(k.ws[1:k.k], ' ') = l.phrase
         JOIN f r ON k.lang = r.lang AND array_to_string(k.ws[k.k + 1:], ' ') = r.phrase),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, ws[1] || ' ' || ws[2] AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM c WHERE size = 3)
  GROUP BY ALL),
o AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
  FROM b JOIN n ON b.lang = n.lang LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM o WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE_SQL = {"op12_collocations": OP12_SQL}
