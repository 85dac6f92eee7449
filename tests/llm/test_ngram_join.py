"""Operator 7 against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import ngram_join as nj
from parlance.llm.common import Words, connected_components, slices


def shingles(t, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def check(documents, rows, k, percent):
    got = {r.id: (r.n_shingles, r.component) for r in nj.ngram_join(documents(rows), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_components_equal_all_pairs(documents, prose):
    rng = random.Random(1)
    rows, base, common = [], prose(0, 150), prose(77, 40)
    for i in range(40):  # near copies at all distances, some linked through others only
        rows.append((i * 3, edited(rng, base, rng.randrange(0, 12))))
    chain = prose(5, 120)
    for i in range(12):
        rows.append((200 + i, chain))
        chain = edited(rng, chain, 2)
    rows += [(300 + i, prose(i, 30) + " " + common) for i in range(25)]  # a passage that many share
    rows += [(400 + i, common) for i in range(4)] + [(410, None), (411, ""), (412, " \n"), (413, "one"), (414, "ONE"), (415, "one two"), (416, prose(9, 6000)), (417, prose(9, 6000) + " end")]
    rng.shuffle(rows)
    check(documents, rows, 4, 85)
    check(documents, rows, 5, 80)


@pytest.mark.parametrize("seed", range(2))
def test_random_small_vocabulary(documents, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    check(documents, rows, 2, 60)


def test_repeated_ids_nulls_and_nothing(documents):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (None, "a b c d e f"), (9, None), (9, None)]
    got = sorted(((r.id if r.id is not None else -1), r.n_shingles, r.component) for r in nj.ngram_join(documents(rows), 4, 85).collect())
    assert got == [(-1, 3, None), (5, 3, None), (5, 3, None), (7, 3, None), (9, 0, 9), (9, 0, 9)]
    assert nj.ngram_join(documents([])).count() == 0


def test_sketches_never_drop_a_link():
    rng = np.random.default_rng(0)
    sets = []
    for size in (1, 60, 400, 1000, 1020, 1500, 9000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size * 19 // 20 + 1], rng.integers(0, 2**63, size // 12).astype(np.uint64)]))
        sets += [a, b, np.unique(rng.integers(0, 2**63, size).astype(np.uint64))]
    bits, edge = nj.parity_sketches(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), len(sets) + 1)
    column = pa.array([None] + [bits[i:j].tolist() for i, j in zip(edge[:-1], edge[1:])])
    sketches = nj.Sketches(column)
    assert len(edge) == len(sets) + 2 and len(set(sketches.words.tolist())) > 3
    for i, x in enumerate(sets):
        apart = sketches.apart(np.array([i + 1]), sketches, np.arange(len(sets) + 2))
        assert apart[0] == 0 and apart[i + 1] == 0
        assert all(n <= len(np.setxor1d(x, y)) for n, y in zip(apart[1:], sets))
        unlike = apart[i // 3 * 3 + 3]
        assert i % 3 == 2 or len(x) < 100 or 100 * unlike > 20 * len(x)


def test_long_texts_that_share_a_passage_leave_no_tile(documents, prose, monkeypatch):
    """Texts of 2,000 words with 700 in common, no shingle known as frequent: none links, and no pair of them may leave a tile."""
    monkeypatch.setattr(nj, "FREQUENT", 1)
    monkeypatch.setattr(nj, "TILE", 16)
    left, tiles = [], nj._tiles
    monkeypatch.setattr(nj, "_tiles", lambda *args: left.append(tiles(*args)) or left[-1])
    common = prose(7, 700)
    rows = [(i, f"{common} {prose(100 + i, 1300)}") for i in range(40)] + [(50, f"{common} {prose(100, 1300)} more")]
    got = {r.id: r.component for r in nj.ngram_join(documents(rows), 4, 85, turns=0).collect()}
    assert got == {i: 0 if i == 50 else i for i, _ in rows}
    assert [tuple(r) for r in left[0].select("a", "b").collect()] == [(0, 50)]


@pytest.mark.parametrize("percent", [50, 85])
def test_bands_part_no_fitting_sizes(documents, percent):
    """Every size from 1 to 400 words beside the largest and smallest that fit it, all of one common beginning."""
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[:n])) for n in range(4, 400, 7)]
    rows += [(1000 + n, " ".join(words[: max(4, -(-percent * (n - 3) // 100) + 3)])) for n in range(4, 400, 7)]
    got = {r.id: (r.n_shingles, r.component) for r in nj.ngram_join(documents(rows), 4, percent, turns=0).collect()}
    assert got == brute(rows, 4, percent)


def test_words_are_cut_as_the_pattern_says():
    texts = ["", "  ", "a", "Ab\tC\x0bd\x1ce", "ü x  é\n", "Z" * 70 + " z", None]
    got = []
    for _, _, data, offsets in slices(pa.array(texts), 12):
        w = Words(data, offsets)
        got += [[bytes(data[w.start[i] : w.end[i]]).decode() for i in range(w.first[r], w.first[r + 1])] for r in range(w.n)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_have_equal_codes():
    (_, _, data, offsets), = slices(pa.array(["Abc x abc", "aBC y"]))
    w = Words(data, offsets)
    assert w.code[0] == w.code[2] == w.code[3] and len(set(w.code.tolist())) == 3


def test_components_of_shapes(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([*path, *star, (500, 501), (500, 500)], "a long, b long")
    got = connected_components(edges).groupBy("component").agg(F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 61), (100, 30), (500, 2)]
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_divide_skip_finds_all_that_reach_the_overlap(seed):
    rng = np.random.default_rng(seed)
    space = rng.integers(0, 2**63, 160).astype(np.uint64)
    query = np.unique(rng.choice(space, 90))
    sets = [np.unique(rng.choice(space, rng.integers(0, 140))) for _ in range(30)] + [query, query[:1], query[:0]]
    sets += [np.unique(np.r_[query[: 40 + i], space[:i]]) for i in range(20)]
    need = np.maximum(-(-60 * (len(query) + np.array([len(x) for x in sets])) // 160), 1)
    overlap = np.array([len(np.intersect1d(query, x)) for x in sets])
    found, count = nj.divide_skip(query, sets, need)
    assert found.tolist() == np.flatnonzero(overlap >= need).tolist() and (count == overlap[found]).all()
    assert len(nj.divide_skip(query[:0], sets, need)[0]) == 0


def test_tiles_find_what_pivots_leave(documents, prose, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 4)
    monkeypatch.setattr("parlance.llm.common.LEAST_HOT", 3)
    rng = random.Random(3)
    common = prose(50, 60)
    rows = [(i, edited(rng, common, 1 + i % 9)) for i in range(60)] + [(100 + i, common + " " + prose(i, 12)) for i in range(12)]
    for turns in (0, 1):
        got = {r.id: (r.n_shingles, r.component) for r in nj.ngram_join(documents(rows), 4, 85, turns=turns).collect()}
        assert got == brute(rows, 4, 85)
