"""Segmented scans and order statistics: the same rows as windows and percentiles, with no key in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import assemble as asm
from parlance.operators import scans as sc
from parlance.operators import spans as sp
from parlance.operators import stats as st
from parlance.operators import turns as tn


def rows_of(df):
    return sorted((tuple((round(v, 9) if v == v else "nan") if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_scan_is_a_window(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), t, rng.choice([None, 1, 2, 5]), rng.choice([None, "x", "y"])) for t in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(data, "k string, t long, v long, s string")
    carried = {"total": ("sum", F.coalesce("v", F.lit(0))), "top": ("max", F.col("v")), "last": ("last", F.col("s")), "next": ("next", F.col("v"))}
    got = {}
    for k in ("a", "b", None):
        some = sorted((r for r in data if r[0] == k), key=lambda r: r[1])
        for i, r in enumerate(some):
            before, after = some[:i], some[i + 1 :]
            known = [b[2] for b in before if b[2] is not None]
            got[k, r[1]] = (sum(known), max(known, default=None), next((b[3] for b in reversed(before) if b[3]), None), next((a[2] for a in after if a[2] is not None), None))
    for width in (7, 300, 10_000):
        out = sc.scan(df, ["k"], ["t"], F.floor(F.col("t") / width), carried)
        assert {(r.k, r.t): (r.total, r.top, r["last"], r.next) for r in out.collect()} == got


def speech(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randrange(4000)
        rows.append((rng.randrange(2), rng.choice(["subject", "partner", "unknown"]), start, start + rng.choice([0, 1, 2, 5, 9, 400 if rng.random() < 0.02 else 3])))
    return spark.createDataFrame(rows, "session_id int, role string, start long, end long")


@pytest.mark.parametrize("width", [3, 100_000])
def test_width_changes_no_row(spark, width):
    s = speech(spark, width)
    d = spark.createDataFrame([(0, 4000), (1, 4000), (2, 10)], "session_id int, duration long")
    assert rows_of(tn.turn_features(s, d, 3, 1, 50)) == rows_of(tn.turn_features(s, d, 3, 1, 50, width=width))
    assert rows_of(tn.turn_spans(s, 4)) == rows_of(tn.turn_spans(s, 4, width=width))
    assert rows_of(tn.pauses(s, 4, 1)) == rows_of(tn.pauses(s, 4, 1, width=width))
    assert rows_of(tn.with_latency(tn.build_turns(s, 2))) == rows_of(tn.with_latency(tn.build_turns(s, 2, width=width), width))
    assert rows_of(tn.coverage(s)) == rows_of(tn.coverage(s, width=width))
    assert rows_of(tn.timeline(s)) == rows_of(tn.timeline(s, width=width))
    assert rows_of(sp.gaps(s, ["session_id", "role"], 1)) == rows_of(sp.gaps(s, ["session_id", "role"], 1, width=width))
    assert rows_of(sp.merge(s, ["session_id"], 2)) == rows_of(sp.merge(s, ["session_id"], 2, width=width))


@pytest.mark.parametrize("width", [7, 5000])
def test_width_changes_no_statistic(spark, width):
    rng = random.Random(width)
    data = [(k, i, rng.choice([None, float("nan"), rng.random(), 1.5, 2.5]), i % 3) for k in (1, 2) for i in rng.sample(range(900), 300)]
    f = spark.createDataFrame(data, "session_id int, frame_index long, v double, tile int")
    assert rows_of(st.mean_abs_delta(f, ["session_id"], ["frame_index"], "v")) == rows_of(st.mean_abs_delta(f, ["session_id"], ["frame_index"], "v", width=width))
    known = f.where("v IS NOT NULL AND NOT isnan(v)")
    columns = ["session_id", "frame_index", "v", "tile", "place"]
    one, two = (st.peak_candidates(known, ["session_id"], ["frame_index"], "v", 1.5, width=w).select(columns) for w in (None, width))
    assert rows_of(one) == rows_of(two)
    rates = spark.createDataFrame([(1, 30.0, 10.0), (2, 30.0, 30.0)], "session_id int, native double, requested double")
    assert rows_of(asm.sample_frames(f, rates)) == rows_of(asm.sample_frames(f, rates, width))
    spans = spark.createDataFrame([(1, "A", 10, 300), (1, "B", 200, 500), (1, "A", 290, 310), (2, "A", 0, 0), (3, "C", 1, 2)], "session_id int, speaker string, start long, end long")
    one, two = (st.indicator_correlation(f, spans, ["session_id"], "tile", "v", "frame_index", width=w) for w in (None, width))
    assert rows_of(one) == rows_of(two)


def test_indicator_correlation_by_numpy(spark):
    rng = random.Random(8)
    data = [(1, t, rng.choice([None, rng.gauss(50, 4)]), t % 2) for t in range(400)] + [(2, t, 3.0, 0) for t in range(9)]
    f = spark.createDataFrame(data, "session_id int, t long, v double, tile int")
    spans = [(1, "A", 10, 300), (1, "B", 200, 390), (1, "A", 350, 360), (1, "C", 900, 950), (2, "A", 0, 4)]
    got = {(r.session_id, r.speaker, r.tile): (r.corr, r.n) for r in st.indicator_correlation(f, spark.createDataFrame(spans, "session_id int, speaker string, start long, end long"), ["session_id"], "tile", "v").collect()}
    for who in "ABC":
        for tile in (0, 1):
            some = [(any(a <= t < b for k, w, a, b in spans if k == 1 and w == who), v) for k, t, v, x in data if k == 1 and x == tile]
            known = np.array([(on, v) for on, v in some if v is not None], float)
            corr, n = got.pop((1, who, tile))
            assert n == len(some)
            assert corr is None if known[:, 0].std() == 0 else abs(corr - np.corrcoef(known.T)[0, 1]) < 1e-12
    assert got == {(2, "A", 0): (None, 9)}


def test_one_long_session_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = spark.range(200_000).selectExpr("1 AS session_id", "CASE WHEN id % 3 = 0 THEN 'subject' ELSE 'partner' END AS role", "id * 10 AS start", "id * 10 + 9 AS end")
        t = tn.turn_spans(s, 2, width=20_000)
        held = t.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(held) == 4 and max(r["count"] for r in held) < 120_000
        assert t.count() == 200_000 and t.agg(F.max("turn_index")).first()[0] == 133_333
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_order_statistics_are_percentiles(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, rng.random(), rng.gauss(0, 1e6)])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    at = {"low": 0.05, "q1": 0.25, "mid": 0.5, "p90": 0.9, "top": 1.0}
    want = df.groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(q)).alias(n) for n, q in at.items()])
    for most in (1 << 20, 3):  # in one round, and in several
        assert rows_of(sc.order_statistics(df, ["k"], "v", at, most)) == rows_of(want)
        whole = df.agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(q)).alias(n) for n, q in at.items()])
        assert rows_of(sc.order_statistics(df, [], "v", at, most)) == rows_of(whole)
    assert rows_of(sc.order_statistics(df.where("false"), [], "v", at)) == [(0, None, None, None, None, None)]
    assert rows_of(sc.order_statistics(df.where("false"), ["k"], "v", at)) == []


def test_percentiles_without_keys_and_long(spark, plan):
    df = spark.range(1000).selectExpr("id % 7 AS k", "CAST(id * id % 101 AS DOUBLE) AS v")
    assert rows_of(st.percentiles(df, ["k"], "v")) == rows_of(st.percentiles(df, ["k"], "v", long=True))
    for q in (st.percentiles(df, [], "v"), st.stage_summary(df, ["v"]), st.completeness(df, ["k", "v"]), st.robust_outliers(df, "v", 3)):
        assert "percentile(" not in plan(q) and "median(" not in plan(q)
    one = df.withColumn("all", F.lit(1))
    assert rows_of(st.robust_outliers(one, "v", 1.2)) == rows_of(st.robust_outliers(one, "v", 1.2, ["all"]).select("k", "v", "all", "outlier"))


def test_a_summary_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(900).selectExpr("CAST(id * id % 101 AS DOUBLE) AS v", "IF(id % 3 = 0, NULL, id) AS w", "CAST(NULL AS INT) AS none")
    got = st.stage_summary(df.mapInArrow(count, df.schema), ["v", "w", "none"])
    want = [(c, *df.agg(F.count(c), F.min(c).cast("double"), F.percentile(c, F.lit(0.5)), F.max(c).cast("double")).first()) for c in ("v", "w", "none")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert seen.value == 900
