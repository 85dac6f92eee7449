"""Operators 4, 5 and 10, and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate as dc
from parlance.llm import quality as ql
from parlance.llm import toxicity as tx
from parlance.llm.common import Words, slices

# ---------------------------------------------------------------- 4


def junk(rng, text):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + "***" for w in text.split())
    return text.upper() if kind == 1 else " ".join([text.split()[0]] * 60)


@pytest.fixture
def labelled(documents, spark, prose):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        good = rng.random() < 0.7
        rows.append((i, prose(i, 70) if good else junk(rng, prose(i, 70))))
        if i % 4:
            labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, prose(5, 20000))]
    return documents(rows), spark.createDataFrame(labels, "id long, label int")


def test_quality_of_held_out_rows(labelled):
    docs, labels = labelled
    got = {r.id: r.score for r in ql.score_quality(docs, labels).collect()}
    held = labels.where("pmod(crc32(cast(id as string)), 5) = 0").collect()
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[r.id] >= 0.5) == bool(r.label) for r in held) >= 0.93 * len(held)


def test_quality_without_labels(labelled):
    docs, labels = labelled
    assert {r.score for r in ql.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    one = {r.score for r in ql.score_quality(docs, labels.where("label = 1")).collect()}
    assert min(one) > 0.9
    assert ql.score_quality(docs.limit(0), labels).count() == 0


def test_pairs_of_features_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = ql.AdditiveModel(pairs=2).fit(x, y)
    assert m.pairs[0] == (0, 1) and ((m.predict(x) > 0.5) == y).mean() > 0.95


def test_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    m = ql.AdditiveModel(rounds=20).fit(x, (x[:, 0] > 0.4).astype(float))
    fine, coarse = m._bin(x)
    score = m.start + sum(t[fine[:, f]] for f, t in enumerate(m.tables)) + sum(t[coarse[:, a], coarse[:, b]] for (a, b), t in zip(m.pairs, m.pair_tables))
    assert np.allclose(1 / (1 + np.exp(-score)), m.predict(x))


# ---------------------------------------------------------------- 5


def align(q, w):
    h = np.zeros((len(q) + 1, len(w) + 1), int)
    for i in range(1, len(q) + 1):
        for j in range(1, len(w) + 1):
            step = dc.MATCH if q[i - 1] == w[j - 1] and q[i - 1] else -dc.UNEQUAL
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - dc.GAP, h[i, j - 1] - dc.GAP)
    return h.max()


def test_alignment_equals_the_full_matrix():
    rng = np.random.default_rng(2)
    q, w = rng.integers(0, 6, (40, 9)).astype(np.uint64), rng.integers(0, 6, (40, 17)).astype(np.uint64)
    best, _ = dc.smith_waterman(q, w)
    assert best.tolist() == [align(a, b) for a, b in zip(q, w)]


def test_edited_passages_are_found(documents, spark, prose):
    items = [(i, prose(1000 + i, 40)) for i in range(12)] + [(50, None), (51, "two words")]
    rng = random.Random(4)
    rows, want = [(500 + i, prose(i, 200)) for i in range(60)], set()
    for i, t in items[:12]:
        w = t.split()
        for _ in range(7):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["other"], [w[p], "more"]])
        rows.append((i, prose(300 + i, 50) + " " + " ".join(w) + " " + prose(400 + i, 3000 if i == 3 else 50)))
        want.add((i, i))
    rows += [(100 + i, items[0][1]) for i in range(80)]  # one item copied into most of the table
    want |= {(100 + i, 0) for i in range(80)}
    rows += [(700, None), (701, ""), (702, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(documents(rows), bench).collect()
    assert {(r.id, r.item_id) for r in got} == want
    assert all(r.score == 1 for r in got if r.id >= 100)
    kept = {r.doc_id for r in dc.decontaminate(documents(rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}


def test_many_copies_of_one_edited_passage_are_found(documents, spark, prose):
    w = prose(1000, 40).split()
    for p in (7, 15, 23, 31):
        w[p] = "other"
    rows = [(i, prose(i, 20) + " " + " ".join(w) + " " + prose(5000 + i, 20)) for i in range(1000)]
    rows += [(5000 + i, prose(1000, 40)) for i in range(3)] + [(6000 + i, prose(9000 + i, 80)) for i in range(20)]
    bench = spark.createDataFrame([(1, prose(1000, 40)), (2, prose(1001, 40))], "item_id long, text string")
    got = dc.contaminated(documents(rows), bench).collect()
    assert {(r.id, r.item_id) for r in got} == {(i, 1) for i, _ in rows if i < 6000}


def plain_words(t):
    return re.findall(r"[a-z0-9]+", (t or "").lower())


def plain_contaminated(rows, items, least=0.4, seeded=True):
    """Every item against every whole document that shares three words in a row, or three of four, by the full matrix."""
    out = {}
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} | {(w[i], w[i + 1], 0, w[i + 3]) for i in range(len(w) - 3)}
    for i, t in rows:
        for j, u in items:
            q, w = plain_words(u), plain_words(t)
            if q and w and (not seeded or runs(q) & runs(w)):
                score = align(q, w) / (dc.MATCH * len(q))
                if score >= least:
                    out[i, j] = max(score, out.get((i, j), 0))
    return out


def test_contaminated_equals_a_plain_version(documents, spark, prose, monkeypatch):
    rng = random.Random(8)
    items = [(f"i{j}", prose(1000 + j, 10 + 3 * j)) for j in range(8)] + [("again", prose(1001, 13)), (None, prose(1002, 16)), ("i3", prose(1020, 12)), ("empty", ""), ("null", None)]
    rows = [(i, prose(i, 25)) for i in range(10)] + [(90, None), (91, " . "), (None, prose(1004, 22)), (5, prose(1005, 25))]
    for n in range(30):
        w = prose(1000 + n % 8, 10 + 3 * (n % 8)).split()
        for _ in range(rng.randrange(len(w) // 2)):
            w[rng.randrange(len(w))] = "other"
        w = w[: rng.randrange(len(w) // 2, len(w) + 1)]
        rows.append((100 + n, prose(200 + n, 15) + " " + " ".join(w) + " " + prose(300 + n, 9)))
    want = plain_contaminated(rows, items)
    bench = spark.createDataFrame(items, "item string, words string")
    for most in (32, 1):  # with every seed of copied items shared by more than the most, too
        monkeypatch.setattr(dc, "MOST_ITEMS", most)
        monkeypatch.setattr("parlance.llm.common.LEAST_HOT", 4)
        got = {(r.id, r.item_id): r.score for r in dc.contaminated(documents(rows), bench, item_col="item", item_text="words").collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert 12 < len(want) < 60


def test_recall_against_the_alignment_of_all_pairs(documents, spark, prose):
    """Templates of 40 items, every third word changed, and passages edited at random, without any seed in the plain version."""
    rng = random.Random(11)
    stem = prose(2000, 20)
    items = [(j, f"{stem} {prose(2100 + j, 4)}") for j in range(40)] + [(100 + j, prose(1000 + j, 40)) for j in range(6)]
    rows = [(1, f"{prose(1, 30)} {stem} {prose(2, 30)}"), (2, prose(3, 60)), (3, f"{prose(4, 9)} {items[7][1]}")]
    for n in range(36):
        w = prose(1000 + n % 6, 40).split()
        every = [3, 4, 5][n % 3]
        for p in range(n % every, 40, every) if n < 12 else rng.sample(range(40), n // 3):
            w[p] = f"other{n}"
        rows.append((10 + n, prose(300 + n, 15) + " " + " ".join(w) + " " + prose(400 + n, 9)))
    want = plain_contaminated(rows, items, seeded=False)
    got = {(r.id, r.item_id): r.score for r in dc.contaminated(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.9 * len(want) and {k for k in want if k[0] in (1, 3)} <= set(got)
    assert len([k for k in want if k[0] == 1]) == 40 and {10 + n for n in range(12)} <= {i for i, _ in got}


def test_seeds_and_hits_in_parts_give_the_same(documents, spark, prose, monkeypatch):
    stem = prose(2000, 20)
    items = spark.createDataFrame([(j, f"{stem} {prose(2100 + j, 4)}") for j in range(40)], "item_id long, text string")
    docs = documents([(i, f"{prose(i, 9)} {stem} {prose(50 + i, 9)}") for i in range(6)] + [(9, prose(99, 40))])
    whole = sorted(map(tuple, dc.contaminated(docs, items).collect()))
    for name, value in (("ENTRIES", 4), ("HITS", 16), ("parlance.llm.common.LEAST_HOT", 4)):
        monkeypatch.setattr(name, value) if "." in name else monkeypatch.setattr(dc, name, value)
    assert sorted(map(tuple, dc.contaminated(docs, items).collect())) == whole and len(whole) == 240


def test_common_seeds_grow_longer(spark):
    texts = ["a b c " + " ".join(f"{i}w{k}" for k in range(6)) for i in range(40)] + ["a b c", "x y"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string").mapInArrow(dc._item_words, "key long, words array<long>")
    seeds = dc.rare_seeds(items).where("gapped = 0").selectExpr("size", "explode(entries) as e").selectExpr("size", "e.key", "e.place").collect()
    at = {(r.key, r.place): r["size"] for r in seeds}
    assert at[0, 0] == 4 and at[0, 1] == 3 and at[40, 0] == 3 and at[41, 0] == 2 and len(at) == 40 * 7 + 2


def test_blocks_of_items_give_the_same(documents, spark, prose, monkeypatch):
    items = spark.createDataFrame([(i, prose(1000 + i, 40)) for i in range(9)], "item_id long, text string")
    docs = documents([(i, prose(i, 30) + " " + prose(1000 + i, 40)) for i in range(9)] + [(3, prose(1003, 40)), (None, prose(1001, 40))])
    whole = sorted(map(tuple, dc.contaminated(docs, items).collect()), key=str)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 400)
    assert sorted(map(tuple, dc.contaminated(docs, items).collect()), key=str) == whole and len(whole) == 10
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.decontaminate(docs, items).count() == 0


# ---------------------------------------------------------------- 10


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = tx.Network(5, 3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, size = rng.normal(size=(4, 6, 5)), np.array([4, 3, 1, 4, 2, 4])
    mask = (np.arange(4)[:, None] < size).astype(float)
    y, weight = rng.integers(0, 2, 6).astype(float), rng.random(6)
    _, g = net.gradients(x, mask, y, weight)
    for name, p in net.p.items():
        for at in list(np.ndindex(p.shape))[:12]:
            old, values = p[at], []
            for e in (1e-5, -1e-5):
                p[at] = old + e
                values.append(net.gradients(x, mask, y, weight)[0])
            p[at] = old
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-7)


def test_gradients_of_learned_inputs_by_differences():
    rng = np.random.default_rng(5)
    net, learned = tx.Network(2 * 3, 3), tx.Embeddings(3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    learned.t = {k: v.astype(float) for k, v in learned.t.items()}
    buckets = rng.integers(0, 40, (4, 5, tx.KINDS))
    buckets[0, 0, 3:] = buckets[1, 2, 1:] = tx.BUCKETS - 1  # words too short for some, or all, characters
    mask, y, weight = np.ones((4, 5)), rng.integers(0, 2, 5).astype(float), rng.random(5)
    loss = lambda: net.gradients(learned.inputs(buckets), mask, y, weight)
    for name, (rows, grads) in learned.gradients(buckets, loss()[1]["x"]).items():
        assert tx.BUCKETS - 1 not in rows or name == "word"
        for r, g in list(zip(rows, grads))[:8]:
            for k in range(3):
                old, values = learned.t[name][r, k], []
                for e in (1e-5, -1e-5):
                    learned.t[name][r, k] = old + e
                    values.append(loss()[0])
                learned.t[name][r, k] = old
                assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[k], abs=1e-7)


def plain_score(model, text):
    """Every window by itself, word after word."""
    (_, _, data, offsets), = slices(pa.array([text]))
    w = Words(data, offsets, plain=True)
    kinds, back = tx.unique_words(w)
    if not len(back):
        return 1 / (1 + np.exp(-(model.calibration @ np.array([1, -20, 0, 0]))))
    p, k = model.network.p, model.network.hidden
    inputs = []
    for b in (kinds[i] for i in back):
        chars = [model.learned.t["char"][c] for c in b[1:] if c != tx.BUCKETS - 1]
        inputs.append(np.concatenate([[model.tables[j][b[j]] for j in range(tx.KINDS)], model.learned.t["word"][b[0]], np.mean(chars, axis=0) if chars else np.zeros(tx.LEARNED)]))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    logits, at = [], 0
    while True:
        window = inputs[at : at + tx.WIDTH]
        states = [[None] * len(window), [None] * len(window)]
        for d, order in ((0, range(len(window))), (1, reversed(range(len(window))))):
            h = np.zeros(k)
            for t in order:
                x, hu = (window[t] @ p["W"] + p["b"])[3 * k * d : 3 * k * (d + 1)], h @ p[f"U{d}"]
                z, r = sigmoid(x[:k] + hu[:k]), sigmoid(x[k : 2 * k] + hu[k : 2 * k])
                h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * hu[2 * k :])
                states[d][t] = h
        both = [np.concatenate([a, b]) for a, b in zip(*states)]
        e = np.array([(np.tanh(s @ p["A"] + p["a"]) @ p["v"])[0] for s in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        logits.append(float((sum(w * s for w, s in zip(a, both)) @ p["o"])[0] + p["c"][0]))
        if at + tx.WIDTH >= len(inputs):
            break
        at += tx.STRIDE
    logits = np.array(logits)
    return sigmoid(model.calibration @ np.array([1, np.clip(logits.max(), -20, 20), np.log1p(sigmoid(logits).sum()), np.log1p(len(logits))]))


def test_scores_equal_a_plain_scorer(prose):
    texts = [prose(i, 20 + i * 25) + (" Grobbit, zarkle!" if i % 2 else "") for i in range(10)] + ["", "one", "a b " * 60]
    model = tx.fit(pa.array(texts), np.array([i % 2 for i in range(len(texts))]), np.ones(len(texts)))
    (_, _, data, offsets), = slices(pa.array(texts))
    assert np.allclose(model.scores(data, offsets), [plain_score(model, t) for t in texts], atol=1e-4)


def test_padding_changes_no_window():
    net, rng = tx.Network(4, 3), np.random.default_rng(1)
    gates = rng.normal(size=(5, 2, 18))
    long = np.concatenate([gates, rng.normal(size=(3, 2, 18))])
    mask = np.ones((5, 2))
    assert np.allclose(net.logits(gates, mask), net.logits(long, np.concatenate([mask, np.zeros((3, 2))])))


def test_windows_cover_and_overlap():
    first = np.array([0, 0, 10, 10 + tx.WIDTH, 10 + tx.WIDTH + 200])
    row, start, size = tx.windows_of(first)
    for r in range(4):
        covered = np.zeros(first[-1], int)
        for s, n in zip(start[row == r], size[row == r]):
            covered[s : s + n] += 1
        own = covered[first[r] : first[r + 1]]
        assert (own >= 1).all() and covered.sum() == own.sum()
    assert (size <= tx.WIDTH).all() and (row == 0).sum() == 0


@pytest.fixture
def insults(documents, spark, prose):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        w, bad = prose(i, 40 + i % 300).split(), rng.random() < 0.3
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["grobbit", "Grobbity", "zarkle!", "zarkles"]))
        rows.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, prose(1, 9000) + " grobbit zarkle grobbit zarkle " + prose(2, 9000)), (903, prose(1, 9000))]
    return documents(rows), spark.createDataFrame(labels, "id long, label int")


def test_toxicity_of_held_out_rows(insults):
    docs, labels = insults
    got = {r.id: r.score for r in tx.score_toxicity(docs, labels).collect()}
    held = labels.where("pmod(crc32(cast(id as string)), 3) = 1").collect()
    assert sum((got[r.id] >= 0.7) == bool(r.label) for r in held) >= 0.93 * len(held)
    assert got[902] > got[903] and got[900] == got[901] < 0.7 and all(0 <= s <= 1 for s in got.values())
    # repeated rows and null ids are scored like any other, and teach nothing more
    more = docs.unionByName(docs.limit(30)).unionByName(docs.where("doc_id = 902").withColumn("doc_id", F.lit(None).cast("long")))
    again = tx.score_toxicity(more, labels.union(labels.limit(9))).collect()
    assert len(again) == docs.count() + 31
    assert all(r.score == pytest.approx(got[902 if r.id is None else r.id]) for r in again)


def test_toxicity_learns_from_a_bounded_sample(insults):
    docs, labels = insults
    got = {r.id: r.score for r in tx.score_toxicity(docs, labels, most_docs=60, most_bytes=40_000).collect()}
    assert len(got) == docs.count() and len(set(got.values())) > 100


def test_toxicity_without_labels(insults):
    docs, labels = insults
    assert {r.score for r in tx.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in tx.score_toxicity(docs, labels.where("label = 1")).collect()} == {1.0}
    assert tx.score_toxicity(docs.limit(0), labels).count() == 0


def test_scores_do_not_depend_on_the_batch(prose):
    texts = pa.array([prose(i, 30 + i * 40) for i in range(8)])
    y = np.array([0, 1] * 4)
    model = tx.fit(texts, y, np.ones(8))
    (_, _, data, offsets), = slices(texts)
    whole = model.scores(data, offsets)
    single = np.concatenate([model.scores(d, o) for _, _, d, o in slices(texts, 1)])
    assert np.allclose(whole, single, atol=1e-5)
    assert Words(data, offsets, plain=True).n == 8


# ---------------------------------------------------------------- the pipeline


def test_stages_take_effect_and_keep_the_columns(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    from parlance.llm.common import table

    docs = table(spark, sf_dir, "documents").limit(200)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()


def test_pipeline_stages_against_plain_versions(spark, documents, prose, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from plain_versions import lines_of, near_of

    base = [(i, prose(i, 60)) for i in range(30)]
    rows = base + [(100, base[3][1]), (101, base[4][1] + " x"), (102, "l one\nl two\nl three\nmine\n" + prose(50, 30)), (103, "l one\nl two\nl three\nyours\n" + prose(51, 30)), (104, "l one\nl two\nl three"), (105, None)]
    docs = documents(rows)
    got = {r.doc_id: r.text for r in pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == lines_of(rows)
    near = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert near == near_of(rows, 5, 80)
    spark.createDataFrame([(0, prose(7, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, _ in rows} - {7}
    assert pipeline.mix(spark, docs, "").agg(F.sum("taken")).first()[0] > 0


def test_toxicity_stage_against_its_plain_version(spark, insults, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = insults
    labels.select(F.col("id").alias("doc_id"), F.col("label").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.unionByName(docs.where("doc_id < 6"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # the model is fitted once more by itself; what it says of each text is worked out window by window
    known = {r.id: r.label for r in labels.where("pmod(crc32(cast(id as string)), 3) <> 1").collect()}
    texts = {i: t for i, t in rows if i in known}
    order = sorted(texts)
    y = np.array([known[i] for i in order])
    weight = np.where(y == 1, 1.0, 1.0)
    model = tx.fit(pa.array([texts[i] for i in order]), y, weight)
    want = {i for i, t in rows if plain_score(model, t or "") < pipeline.TOXIC}
    got = [r.doc_id for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == sum(i in want for i, _ in rows) and 0 < len(set(dict(rows)) - want) < 120


def test_near_copies_are_found_up_to_the_similarity(spark, documents, prose):
    """Copies with edits on either side of a similarity of 0.8 in runs of five words."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from plain_versions import near_of
    from test_ngram_join import edited, shingles

    rng = random.Random(11)
    rows, near, far = [(i, prose(i, 150)) for i in range(20)], set(), set()
    for i in range(20):
        for n in (1, 2, 4, 9):
            t = edited(rng, rows[i][1], n)
            a, b = shingles(rows[i][1], 5), shingles(t, 5)
            rows.append((100 + 10 * i + n, t))
            (near if len(a & b) >= 0.8 * len(a | b) else far).add(100 + 10 * i + n)
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, documents(rows), "").collect()}
    assert not kept & near and kept == near_of(rows, 5, 80) and len(near) >= 40 and len(far & kept) >= 15


def test_stages_of_empty_tables_and_odd_columns(spark, documents, prose, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = documents([(1, prose(1)), (None, None), (2, ""), (2, "")]).withColumnsRenamed({"id": "__removed", "component": "a.b", "lang": "__gone"}).drop("n_chars")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, documents([]), str(tmp_path)).count() == 0, name
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.count() == 4, name
    assert pipeline.mix(spark, documents([]), str(tmp_path)).count() == 0
