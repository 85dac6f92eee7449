"""Operator 7: n-gram Jaccard join by T-occurrence search over short and long inverted lists."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Seen, Words, connected_components, document_filter, filter_bucket, hash_filter, in_filter, materialise, mix, slices, spread_join, table, written

#: Most shingles known as frequent (2 MB), and documents that make one frequent.
FREQUENT, FREQUENT_FROM = 1 << 17, 4
#: Shingles a task holds while it counts; members, and shingles of members, that meet one query in a group.
_BUFFER, MEMBERS, GROUP_SHINGLES = 1 << 21, 64, 1 << 20
#: Members of one list that meet in one tile.
TILE = 512
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085
#: Least bits of a set's parity sketch, and of the folded one that goes into tiles; both are wider for sets of more shingles.
SKETCH, FOLDED = 1024, 256


# ---------------------------------------------------------------- shingle sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each text, in order of row and hash."""
    rows, h = Words(data, offsets).shingles(k, whole_if_short=True)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


def _count_frequent(k: int) -> Callable:
    """Shingles that several documents of a stretch of a partition have, with their number."""

    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= 2
        return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                held.append(shingle_sets(data, offsets, k)[1])
                size += len(held[-1])
                if size >= _BUFFER:
                    yield count(held)
                    held, size = [], 0
        if held:
            yield count(held)

    return run


def frequent_shingles(docs: DataFrame, k: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles of most documents, sorted by hash, with counts.

    Counts come from stretches of partitions and may be too small. They only order the inverted lists, and any
    order finds all pairs, so neither that nor the bound can lose a link.
    """
    counted = docs.select(text_col).mapInArrow(_count_frequent(k), "h long, n long")
    top = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "h").limit(FREQUENT)
    got = top.toArrow()
    h = np.asarray(got.column("h")).astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.asarray(got.column("n")).astype(np.int64)[order]


def parity_sketches(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets) of a sketch for each of n sets, each bit the parity of the number of its shingles that fall on it.

    A sketch has SKETCH bits, or as many as the set has shingles, as the next power of two, so it does not fill up
    in long texts. Sets that differ in d shingles differ in at most d bits, so the sketches tell pairs apart that
    cannot link and never a pair that does.
    """
    first = np.searchsorted(rows, np.arange(n + 1))
    size = np.diff(first)
    width = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    offsets = np.r_[0, np.cumsum(width // 64)]
    out = np.zeros(offsets[-1], np.int64)
    for m in np.unique(width):
        same, at_once = np.flatnonzero(width == m), max(1, (1 << 20) // int(m))
        for a in range(0, len(same), at_once):
            some = same[a : a + at_once]
            own = np.repeat(np.arange(len(some)), size[some])
            at = first[some][own] + np.arange(len(own)) - (np.cumsum(size[some]) - size[some])[own]
            odd = np.bincount(own * m + (h[at] % np.uint64(m)).astype(np.int64), minlength=len(some) * m) & 1
            out[offsets[some][:, None] + np.arange(m // 64)] = np.packbits(odd.astype(np.uint8).reshape(-1, m), axis=1).view(np.int64)
    return out, offsets


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as if they had been made with so many words: parities of several bits together are parities again."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


class Sketches:
    """The sketches of a column of lists; a null one is unlike nothing."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.words = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        self.flat = np.asarray(column.drop_null().flatten()).view(np.uint64)
        self.at = np.cumsum(self.words) - self.words

    def rows(self, some: np.ndarray, words: int) -> np.ndarray:
        return self.flat[self.at[some][:, None] + np.arange(words)]

    def apart(self, i: np.ndarray, other: Sketches, j: np.ndarray) -> np.ndarray:
        """Bits in which rows i (or a single one) of these differ from rows j of the others, folded to the narrower."""
        out = np.zeros(len(j), np.int64)
        left, right = np.broadcast_to(self.words[i], len(j)), other.words[j]
        for p, q in {(int(a), int(b)) for a, b in zip(left, right) if a and b}:
            same, at_once = np.flatnonzero((left == p) & (right == q)), max(1, (1 << 19) // max(p, q))
            for a in range(0, len(same), at_once):
                some = same[a : a + at_once]
                x = _folded(self.rows(i if len(i) == 1 else i[some], p), min(p, q))
                y = _folded(other.rows(j[some], q), min(p, q))
                out[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


def _profiles(k: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> Callable:
    """Size and digests of each set, and its short lists: the rarest shingles, one of which any partner shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                rows, h = shingle_sets(data, offsets, k)
                first = np.searchsorted(rows, np.arange(j - i + 1))
                n = np.diff(first)
                sums = [np.zeros(len(h) + 1, np.uint64) for _ in range(2)]
                np.cumsum(mix(h + np.uint64(1)), out=sums[0][1:])
                np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1][1:])
                digests = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                rank = np.zeros(len(h), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    rank = np.where(frequent[at] == h, counts[at], 0)
                order = np.lexsort((h, rank, rows))
                needed = -(-percent * n // 100)
                short = np.where(n > 0, n - needed + 1, 0)
                place = np.arange(len(h)) - np.repeat(first[:-1], n)
                kept = h[order][place < np.repeat(short, n)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(short)].astype(np.int32)), pa.array(kept))
                bits, edge = parity_sketches(rows, h, j - i)
                sketch = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(bits))
                out = [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *[pa.array(d) for d in digests], lists, sketch]
                yield pa.RecordBatch.from_arrays(out, names=["id", "n", "d1", "d2", "short", "sketch"])

    return run


# ---------------------------------------------------------------- T-occurrence search


def divide_skip(query: np.ndarray, sets: list[np.ndarray], need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``sets``, overlaps) of the sets that share at least ``need`` shingles with the query.

    All are sorted. The inverted lists of the query's shingles over ``sets`` are divided by length: of the short
    ones a heap merges the entries and counts how often each set occurs; sets that still can reach their
    overlap are looked up in the long ones by binary search, the longest first, until they no longer can.
    """
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(query) or not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = np.flatnonzero(query[at] == flat)
    order = hit[np.argsort(at[hit], kind="stable")]
    ids, bounds = owner[order], np.searchsorted(at[order], np.arange(len(query) + 1))
    length = np.diff(bounds)
    by_length = np.argsort(length, kind="stable")
    least, longest = int(need.min()), max(int(length.max()), 2)
    n_long = max(0, min(int(least / (MU * np.log2(longest) + 1)), least - 1))
    edge = len(query) - n_long
    short = [ids[bounds[i] : bounds[i + 1]].tolist() for i in by_length[:edge] if length[i]]
    count = np.zeros(len(sets), np.int64)
    for member, run in groupby(heapq.merge(*short)):
        count[member] = sum(1 for _ in run)
    alive = np.flatnonzero((count > 0) & (count + n_long >= need))
    for k, i in enumerate(by_length[edge:][::-1]):
        if not len(alive):
            break
        entries = ids[bounds[i] : bounds[i + 1]]
        if len(entries):
            place = np.minimum(np.searchsorted(entries, alive), len(entries) - 1)
            count[alive] += entries[place] == alive
        alive = alive[count[alive] + (n_long - k - 1) >= need[alive]]
    return alive, count[alive]


def _sets_of(k: int, bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = in_filter(bits, batch)
            for i, j, data, offsets in slices(some.column(1)):
                rows, h = shingle_sets(data, offsets, k)
                first = np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0).slice(i, j - i), lists], names=["id", "set"])

    return run


def needed_sets(texts: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents that stand in a candidate pair: the only ones whose sets are made and ever move."""
    bits = document_filter(needed)
    return materialise(texts.select("id", "text", filter_bucket(bits)).mapInArrow(_sets_of(k, bits), "id long, set array<long>"), "sets")


def _shared_lists(bits: np.ndarray) -> Callable:
    """(rep, n, pos, h) of the short lists whose shingle is in the filter: most stand in one text only and go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, h = batch.column(2), np.asarray(batch.column(2).flatten()).view(np.uint64)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            bucket = (mix(h) % np.uint64(64 * len(bits))).astype(np.int64)
            some = np.flatnonzero((bits[bucket >> 6] >> (bucket & 63)) & 1)
            rep, n = (batch.column(c).take(pa.array(row[some])) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([rep, n, pa.array(pos[some].astype(np.int32)), pa.array(h[some].view(np.int64))], names=["rep", "n", "pos", "h"])

    return run


def _only_needed(bits: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = in_filter(bits, batch)
            if some.num_rows:
                yield some

    return run


def _search(percent: int) -> Callable:
    """Links of the queries of one group with its members, by T-occurrence search."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = np.asarray(group.column("is_query"))
        column = group.column("set").combine_chunks() if isinstance(group.column("set"), pa.ChunkedArray) else group.column("set")
        flat, edge = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.offsets) - column.offsets[0].as_py()
        sets = [flat[edge[i] : edge[i + 1]] for i in range(len(asks))]
        ids = np.asarray(group.column("id"))
        rest = np.flatnonzero(~asks)
        a, b = [], []
        for q in np.flatnonzero(asks):
            both = len(sets[q]) + np.array([len(sets[m]) for m in rest], np.int64)
            need = np.maximum(-(-percent * both // (100 + percent)), 1)
            found, _ = divide_skip(sets[q], [sets[m] for m in rest], need)
            a.append(np.repeat(ids[q], len(found)))
            b.append(ids[rest[found]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(join(a).astype(np.int64)), "b": pa.array(join(b).astype(np.int64))})

    return run


def search(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, of candidates (a, b, both): a is the query. The members of a query are dealt
    to groups of about MEMBERS members and GROUP_SHINGLES shingles, so no group grows with the table."""
    sizes, seen = written(pairs.groupBy("a").agg(F.count("*").alias("n"), F.sum("both").alias("shingles")), "sizes", "n")
    parts = F.ceil(F.greatest(F.col("n") / MEMBERS, F.col("shingles") / GROUP_SHINGLES)).cast("long")
    dealt = spread_join(pairs.select("a", "b"), sizes.select("a", parts.alias("parts"), "n"), ["a"], ["b"], seen=seen)
    dealt = materialise(dealt.select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part")), "pairs")
    roles = dealt.select("a", "part", F.col("b").alias("id"), F.lit(False).alias("is_query"))
    roles = roles.unionByName(dealt.select("a", "part", F.col("a").alias("id"), F.lit(True).alias("is_query")).distinct())
    bits = document_filter(roles.select("id"))
    some = sets.select("id", "set", filter_bucket(bits)).mapInArrow(_only_needed(bits), "id long, set array<long>")
    return roles.join(some.hint("merge"), "id").groupBy("a", "part").applyInArrow(_search(percent), "a long, b long").distinct()


# ---------------------------------------------------------------- candidates


def _placed(lists: DataFrame, place: DataFrame | None) -> DataFrame:
    if place is None:
        return lists.withColumn("component", F.col("rep"))
    return lists.join(place.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _pivot_pairs(lists: DataFrame, open_: DataFrame, percent: int, seen: Seen | None = None) -> DataFrame:
    """(a, b, both): in each list, one member, the query a, with all others of other components and fitting size."""
    got = spread_join(lists, open_, ["h"], ["rep"], seen=seen)
    got = got.where(f"component <> pivot.component AND 100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)")
    pair = got.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b"), (F.col("n") + F.col("pivot.n")).alias("both"))
    return pair.groupBy("a", "b").agg(F.min("both").alias("both"))


def _tile_pairs(percent: int) -> Callable:
    """Pairs of members of a list, from the two parts that meet in a tile, whose components differ and whose
    sizes, places of the common shingle and sketches leave room for a link."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        get = lambda c: np.asarray(group.column(c))
        h, band, deal, other, rep, n, pos, component, home = (get(c) for c in ("h", "band", "deal", "other", "rep", "n", "pos", "component", "home"))
        sketches = Sketches(group.column("sketch"))
        order = np.lexsort((rep, other, deal, band, h))
        key = np.stack([x[order].astype(np.int64) for x in (h, band, deal, other)])
        edge = np.flatnonzero(np.r_[True, (np.diff(key) != 0).any(axis=0), True])
        a, b, both = [], [], []
        # a tile (i, j) holds the rows of part i under (i, j) and those of part j under (j, i)
        start = {tuple(key[:, x].tolist()): order[x:y] for x, y in zip(edge[:-1], edge[1:])}
        for (one, at, i, j), left in start.items():
            if i > j or (one, at, j, i) not in start:
                continue
            right = start[one, at, j, i]
            for x in left:
                y = right[rep[right] > rep[x]] if i == j else right
                y = y[(component[y] != component[x]) & (home[y] | home[x])]
                total = n[y] + n[x]
                y = y[(percent * total <= (100 + percent) * np.minimum(n[y] - pos[y], n[x] - pos[x])) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                y = y[(100 + percent) * sketches.apart(np.array([x]), sketches, y) <= (100 - percent) * (n[y] + n[x])]
                a.append(np.minimum(rep[x], rep[y]))
                b.append(np.maximum(rep[x], rep[y]))
                both.append(n[y] + n[x])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({c: pa.array(join(v).astype(np.int64)) for c, v in (("a", a), ("b", b), ("both", both))})

    return run


def _tiles(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, both): what is left after the pivots. A list is cut into bands of sizes, so narrow that texts of fitting sizes
    stand in one band or in two that follow each other; each band has its own members (home) and those of the next. Bands with
    one component only are done. The members of the others are dealt to parts of about TILE rows, and each two parts
    meet in a tile; small bands share tiles. Only pairs that may link leave their tile."""
    # a little wider than the ratio of sizes, so that rounding cannot put two bands between two sizes that fit
    band = F.floor(F.log(F.col("n")) / F.lit(max(math.log(100 / percent), 1e-3) * (1 + 1e-9))).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band - 1).alias("band"), F.lit(False).alias("home")))
    rows = lists.select("h", "pos", "rep", "n", "component", F.explode(both).alias("at")).select("h", "pos", "rep", "n", "component", "at.*")
    bands = rows.groupBy("h", "band").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("home").alias("some"))
    bands, seen = written(bands.where("some AND lo <> hi").select("h", "band", "c", F.ceil(F.col("c") / TILE).cast("int").alias("parts")), "bands", "c")
    narrow = F.expr(f"""transform(sequence(0, greatest({FOLDED // 64}, cast(size(sketch) / 2 as int) * int(size(sketch) > {SKETCH // 64})) - 1),
        i -> aggregate(sequence(i, size(sketch) - 1, greatest({FOLDED // 64}, cast(size(sketch) / 2 as int) * int(size(sketch) > {SKETCH // 64}))), 0L, (x, j) -> x ^ sketch[j]))""")
    folded = sketches.select("rep", F.when(F.col("sketch").isNotNull(), narrow).alias("sketch"))
    rows = spread_join(rows, bands, ["h", "band"], ["rep"], number="c", seen=seen).join(folded.hint("merge"), "rep", "left")
    rows = rows.withColumn("deal", F.pmod(F.xxhash64(F.lit(7), "rep"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    small = F.pmod(F.xxhash64("h", "band"), F.greatest(F.lit(1), F.lit(seen.total // TILE)))
    tile = F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("h", "band", F.least("deal", "other"), F.greatest("deal", "other")))
    rows = rows.select(tile.alias("tile"), "h", "band", "home", "deal", "other", "rep", "n", "pos", "component", "sketch")
    return rows.groupBy("tile").applyInArrow(_tile_pairs(percent), "a long, b long, both long").groupBy("a", "b").agg(F.min("both").alias("both"))


def _near(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            apart = Sketches(batch.column(3)).apart(every, Sketches(batch.column(4)), every)
            near = (100 + percent) * apart <= (100 - percent) * np.asarray(batch.column(2)).astype(np.int64)
            yield batch.select([0, 1, 2]).filter(pa.array(near))

    return run


def _may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches do not differ in more bits than the sets of a link may differ in shingles."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    one, seen = written(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")).join(sizes.hint("merge"), "a"), "queries", "n")
    p = spread_join(pairs, one, ["a"], ["b"], seen=seen).join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b")
    return p.select("a", "b", "both", "sa", "sb").mapInArrow(_near(percent), "a long, b long, both long")


# ---------------------------------------------------------------- the join


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80, turns: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component) for every row: documents link when the Jaccard similarity of their sets of
    distinct k-word shingles is at least ``percent`` / 100; component is the smallest id reachable by links.

    Equal sets become one representative first. A document that needs T shingles in common looks, of its n
    lists, at the n - T + 1 shortest (rarest shingles first): any partner stands in one of these. A query and
    the members it meets there are dealt to bounded groups, and in each a T-occurrence search decides: the
    short inverted lists over the group are merged by a heap that counts occurrences, and what can still reach
    the overlap is probed in the long ones (DivideSkip). In each list one member is the query of all others, so
    candidates grow with the entries, not with their square; lists that still hold several components get other
    queries, and after ``turns`` rounds their bands of like sizes meet in tiles, which only pairs that may link leave.
    Parity sketches drop pairs that differ in too many shingles before any set moves. No filter can drop a
    link, so no link that would join two components is lost.

    Words are runs of anything but ASCII white space, A-Z in lower case; shorter documents have their whole
    sequence as one shingle. Null and empty texts have no shingle and are alone; very long texts are whole
    sets, cut only where groups are dealt. Ids are whole numbers (but -2^63); others raise. Rows that share an
    id are one document; a null id counts as the smallest and comes back null. An empty table gives no rows.
    """
    least = -(2**63)
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(least)).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    frequent, counts = frequent_shingles(texts, k, "text")
    profiles = texts.mapInArrow(_profiles(k, percent, frequent, counts), "id long, n long, d1 long, d2 long, short array<long>, sketch array<long>")
    profiles = materialise(profiles, "profiles")
    sets = ["n", "d1", "d2"]
    classes = profiles.groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    classes, of_classes = written(classes, "classes", "c")
    # one row of each class has its lists and its sketch
    reps = profiles.where("n > 0").join(classes.select(*sets, F.col("rep").alias("id")), [*sets, "id"], "left_semi")
    lists = reps.select(F.col("id").alias("rep"), F.col("n"), F.posexplode("short").alias("pos", "h"))
    shared, seen = written(lists.groupBy("h").agg(F.count("*").alias("c"), F.min("n").alias("smallest")).where("c > 1"), "shared", "c")
    bits = hash_filter(shared, many=seen.rows)
    lists = reps.select("id", "n", "short").mapInArrow(_shared_lists(bits), "rep long, n long, pos int, h long")
    lists = spread_join(lists, shared, ["h"], ["rep"], number="c", seen=seen).where(f"{percent} * (n + smallest) <= {100 + percent} * (n - pos)").select("h", "pos", "rep", "n")
    lists = materialise(lists, "lists")
    met = materialise(lists.select(F.col("rep").alias("id")).distinct(), "met")
    # sketches of those documents only that share a list with another; none where an id has different sets
    sketches = profiles.join(met, "id").groupBy(F.col("id").alias("rep")).agg(F.min("sketch").alias("lo"), F.max("sketch").alias("hi"))
    sketches = materialise(sketches.select("rep", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("sketch")), "sketches")
    whole, fetched = None, None
    # rows of one id with different sets are the same node
    twice = profiles.select("id", *sets).distinct().groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    twice, seen = written(twice, "twice")
    place, tried = None, None
    if seen.rows:
        same = profiles.join(twice, "id", "left_semi").join(classes, sets).where("id <> rep")
        place = connected_components(same.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    for turn in range(turns + 1):
        known = materialise(_placed(lists, place), "lists") if place is not None else _placed(lists, None)
        rank = F.col("rep") if turn == 0 else F.xxhash64(F.lit(turn), F.col("rep"))
        open_ = known.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.min_by(F.struct("rep", "n", "component"), rank).alias("pivot"))
        open_, seen = written(open_.where("lo <> hi").select("h", "pivot", "n"), "open", "n")
        if not seen.rows:
            break
        pairs = _pivot_pairs(known, open_, percent, seen) if turn < turns else _tiles(known, sketches, percent)
        pairs = materialise(pairs, "met")
        if tried is not None:
            swapped = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = pairs.join(tried.unionByName(swapped), ["a", "b"], "left_anti")
        pairs, seen = written(_may_link(pairs, sketches, percent), "candidates")
        if not seen.rows:
            continue
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        new = materialise(asked if fetched is None else asked.join(fetched, "id", "left_anti"), "asked")
        sets_of = needed_sets(texts, new, k).join(new, "id", "left_semi") if fetched is not None else needed_sets(texts, new, k)
        whole = sets_of if whole is None else whole.unionByName(sets_of)
        fetched = whole.select("id").distinct()
        links, seen = written(search(pairs, whole, percent), "links")
        if seen.rows:
            # what is known goes on as one edge for each node
            before = [] if place is None else [place.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            place = connected_components(links.unionByName(before[0]) if before else links)
    out = spread_join(profiles.select("id", *sets), classes, sets, ["id"], number="c", seen=of_classes)
    if place is not None:
        heads, seen = written(place.withColumnRenamed("node", "rep").join(classes.groupBy("rep").agg(F.sum("c").alias("c")), "rep"), "heads", "c")
        out = spread_join(out, heads, ["rep"], ["id"], "left", number="c", seen=seen)
    else:
        out = out.withColumn("component", F.col("rep"))
    back = lambda c: F.when(c != least, c)
    component = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(back(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), back(component).alias("component"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join(table(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT x AS v, x AS u FROM l UNION SELECT r.v, l.y FROM r JOIN l ON l.x = r.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(m.u, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = d.doc_id
"""

QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLE_SQL = {"op7_ngram_join": OP7_SQL}
