"""Collocations against phrases counted in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, most_words=3, least=10, within=50, top=2000):
    out = []
    by_lang = {}
    for lang, text in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append((text or "").translate(LOWER))
    for lang, texts in by_lang.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                ws = re.findall(r"[^\x20\x09]+", piece)
                n += len(ws)
                f.update(tuple(ws[i : i + m]) for m in range(1, most_words + 1) for i in range(len(ws) - m + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for sub in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p)}:
                inside[sub] = max(inside[sub], a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside[p] >= within * a and inside[p]:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def run(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, f int, phrase string").repartition(parts)
    out = co.collocations(df, **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def odd_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["The", "of", "New", "York", "city", "Ünï", "ÀB", "x\x1cy", "a-b", "日本", "é", "é"] + [f"w{i}" for i in range(30)]
    weights = [40, 20, 8, 8, 6, 5, 5, 3, 3, 3, 2, 2] + [1] * 30
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r", "\x0b", "!?", " "]
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice(gaps) for w in rng.choices(words, weights, k=rng.choice([0, 1, 2, 5, 60])))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("fr", ""), ("en", "New York City " * 40), ("de", " ... \n ,")] + [("en", "same row of text, same row of text")] * 12


@pytest.mark.parametrize("budget", [1, 64, 1 << 20])
@pytest.mark.parametrize("most_words", [2, 3, 4])
def test_same_phrases(spark, budget, most_words):
    rows = odd_rows(most_words)
    want = brute(rows, most_words)
    assert len(want) > 20
    assert run(spark, rows, budget=budget, most_words=most_words) == want


def test_cut_to_the_first_and_other_settings(spark):
    rows = odd_rows(9)
    assert run(spark, rows, least=3, within=90, top=7, budget=200) == brute(rows, least=3, within=90, top=7)


def test_one_phrase_holds_a_third_of_all_words(spark):
    rows = [("en", "the the " * 700)] * 20 + odd_rows(5)
    assert run(spark, rows, budget=1000, parts=7) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("en", ""), ("en", "few words")]) == []


def test_long_and_chunked_texts():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d."]) for _ in range(n)) for n in (5, 0, 40, 2000, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y", "x"]), pa.array(texts)], names=["lang", "text"])
    whole = list(co.chunks(iter([batch, batch.slice(1, 3)])))
    assert len(whole) == 1
    size, co.CHUNK_BYTES = co.CHUNK_BYTES, 100
    try:
        cut = list(co.chunks(iter([batch, batch.slice(1, 3)])))
    finally:
        co.CHUNK_BYTES = size
    assert len(cut) > 2
    count = lambda cs: sum((Counter({(c.langs[c.lang[i - 1]], c.word[i - 1].as_py(), int(c.hash[i])): int(k) for i, k in zip(*np.unique(c.code, return_counts=True))}) for c in cs), Counter())  # noqa: E731, B905
    assert count(whole) == count(cut)
    assert sum(count(cut).values()) == sum(len(t.replace(".", "").split()) for t in texts + texts[1:4])


def test_groups_keep_to_the_budget():
    loads = np.asarray([5, 5, 1, 30, 0, 2, 9, 1, 1])
    got = co.pack(loads, 10)
    assert got.tolist() == [0, 0, 1, 2, 3, 3, 4, 4, 5]
