"""Hard negatives against all pairs scored in plain Python."""

import math
import random

import numpy as np
import pytest

from parlance.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id int, score string"


def plain_rows(table):
    """The operator's rows: id, label, whole components."""
    out = set()
    for i, v, label in table:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.add((i, label, tuple(math.floor(256 * x) for x in v)))
    return out


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    for r in sorted(rows):
        if is_anchor(r[0]):
            anchors.setdefault(r[0], r)
    out = []
    for a, label, v in anchors.values():
        same = sorted({(-dot(v, w), i) for i, x, w in rows if x == label and i != a})[:positives]
        others = sorted({(-dot(v, w), i) for i, x, w in rows if x != label})
        for p, i in same:
            inside = [(s, j) for s, j in others if low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(inside)]
    return sorted(out)


def run(spark, table, is_anchor, **more):
    df = spark.createDataFrame([(i, v, label, 3, "x") for i, v, label in table], SCHEMA).repartition(5)
    rows = df.select("label", hn.F.col("vec_id").alias("id"), hn.scaled_vector("embedding").alias("vector"), "score")
    return sorted(map(tuple, hn.hard_negatives(rows, rows.where(is_anchor), **more).collect()))


def vectors(seed, n, width, size=1.0, step=None):
    rng = random.Random(seed)
    draw = lambda: rng.uniform(-0.3, 1) * size if step is None else rng.randrange(-1, 3) * step
    return [(i, [draw() for _ in range(width)], rng.randrange(3)) for i in range(n)]


def test_small_numbers_with_ties(spark):
    table = vectors(1, 300, 3, step=1 / 256)
    table += [(301, None, 1), (302, [0.1, None, 0.2], 1), (303, [0.1, float("nan"), 0.2], 1), (304, [0.1, float("inf"), 0.2], 1), (305, [0.1, 0.1, 0.1], None)]
    table += [(None, [0.1, 0.1, 0.1], 1), (306, [], 1), (10, [], 2), (20, [0.0, 0.0, 0.0], 2), (307, [0.01], 0), (308, [0.01, 0.01, 0.01, 0.5], 0)]
    table += table[:40] + [(i, v, 2) for i, v, _ in table[40:60]] + [(i, [0.01, 0.01, 0.0], 1) for i in range(60, 80)]
    want = brute(plain_rows(table), lambda i: i % 10 == 0)
    assert len(want) > 50
    assert run(spark, table, "id % 10 = 0") == want


@pytest.mark.parametrize("size", [1.0, 300.0, 1e5])
def test_every_number_type_and_several_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(hn, "SEEDS", 4)
    table = vectors(2, 400, 8, size)
    rows = plain_rows(table)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 100
    assert run(spark, table, "id % 5 = 0", block=30) == want


def test_a_label_with_a_third_of_all_rows_and_many_copies(spark):
    base = vectors(3, 50, 4)
    table = [(i, base[i % 50][1], 0 if i % 3 else i % 4) for i in range(900)]
    assert run(spark, table, "id % 30 = 0") == brute(plain_rows(table), lambda i: i % 30 == 0)


def test_empty(spark):
    assert run(spark, [], "id % 5 = 0") == []
    assert run(spark, [(1, [0.5], 1), (2, [0.5], 2)], "id % 5 = 0") == []
    assert run(spark, [(5, [0.5], 1), (2, [0.4], 2)], "id % 5 = 0") == []


def test_keys_order_as_their_parts():
    rng = random.Random(4)
    parts = [(rng.choice([-(2**63), -1, 0, 7, 2**63 - 1]), rng.choice([-(2**63), -5, 0, 5, 2**63 - 1]), rng.randrange(2), rng.choice([-3, 0, 2**62])) for _ in range(200)]
    assert [hn.unpack(k) for k in sorted(hn.pack(*p) for p in parts)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    with pytest.raises(OverflowError):
        hn.exact_products(np.full((1, 2), 2**40), np.full((1, 2), 2**40))
