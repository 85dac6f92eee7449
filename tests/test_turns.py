"""Turn taking on hand-made schedules."""

from pyspark.sql import functions as F

from parlance.operators import spans as sp
from parlance.operators import turns as tn


def spans(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "session_id int, role string, start long, end long")


def turns_of(spark, rows, gap=1):
    t = tn.with_latency(tn.build_turns(spans(spark, rows), gap))
    return [(r.turn_index, r.role, r.start, r.end, r.latency) for r in t.orderBy("turn_index").collect()]


def test_an_interjection_is_the_next_turn(spark):
    got = turns_of(spark, [("partner", 0, 20), ("subject", 5, 6)])
    assert got == [(0, "partner", 0, 20, None), (1, "subject", 5, 6, -15)]


def test_a_third_turn_needs_a_new_span(spark):
    got = turns_of(spark, [("partner", 0, 10), ("subject", 5, 6), ("partner", 30, 40)])
    assert [g[1] for g in got] == ["partner", "subject", "partner"]


def test_merging_comes_before_interleaving(spark):
    got = turns_of(spark, [("subject", 0, 5), ("partner", 5, 6), ("subject", 6, 9)], gap=1)
    assert got == [(0, "subject", 0, 9, None), (1, "partner", 5, 6, None)]


def test_zero_latency_is_a_response(spark):
    d = spark.createDataFrame([(1, 60)], "session_id int, duration long")
    f = tn.turn_features(spans(spark, [("partner", 0, 5), ("subject", 5, 9)]), d, 1, 1, 10).collect()[0]
    assert f["turn__latency_mean"] == 0 and f["turn__interruption_rate"] == 0 and f["turn__n_per_minute"] == 2


def test_features_of_nothing_are_null(spark):
    d = spark.createDataFrame([(1, 60), (2, 0)], "session_id int, duration long")
    f = {r.session_id: r for r in tn.turn_features(spans(spark, []), d, 1, 1, 10).collect()}
    assert f[1]["turn__latency_mean"] is None and f[1]["turn__subject_speaking_ratio"] is None
    assert f[1]["qc__turn_flags"] == "no_turns;no_subject_speech;no_partner_speech;no_usable_latency"
    assert f[2]["turn__n_per_minute"] is None


def test_pauses_use_unbridged_spans(spark):
    s = spans(spark, [("subject", 0, 5), ("subject", 8, 10), ("subject", 11, 12)])
    assert [(r.pause_start, r.pause_end) for r in tn.pauses(s, 5, 1).collect()] == [(5, 8)]


def test_timeline_silence_is_neither(spark):
    s = spans(spark, [("subject", 0, 5), ("partner", 3, 10), ("partner", 20, 25)])
    got = sorted((r.state, r.start, r.end) for r in tn.timeline(s).collect())
    assert got == [("listening", 5, 10), ("listening", 20, 25), ("speaking", 0, 5)]


def test_budget_cuts_the_last(spark):
    s = spark.createDataFrame([(1, 0, 50), (1, 60, 100), (1, 100, 130), (1, 200, 201)], "k int, start long, end long")
    got = sorted((r.start, r.end, r.taken) for r in tn.budget_sample(s, ["k"], 5, 100).collect())
    assert got == [(0, 50, 50), (60, 100, 40), (100, 110, 10)]


def test_top_k_puts_nan_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("a", float("nan"), 0)], "k string, s double, i int")
    assert [r.i for r in tn.top_k(df, ["k"], "s", ["i"], 2).orderBy("rank").collect()] == [1, 2]


def test_width_changes_no_feature(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["subject", "partner", "unknown"]), a := rng.randrange(1000), a + rng.randrange(1, 40)) for _ in range(150)]
    s = spans(spark, rows)
    d = s.groupBy("session_id").agg(F.max("end").alias("duration"))
    same = lambda w: [tuple(r) for r in tn.turn_features(s, d, 3, 1, 50, width=w).collect()]
    assert same(None) == same(37)
    assert sorted(map(tuple, tn.timeline(s).collect())) == sorted(map(tuple, tn.timeline(s, width=50).collect()))
    points = spark.createDataFrame([(1, t) for t in range(0, 1100, 3)], "session_id long, t long").withColumn("session_id", s.select("session_id").limit(1).collect()[0][0] + F.lit(0))
    marks = {"a": F.col("role") == "subject", "b": F.col("role") == "partner"}
    one, two = (sorted(map(tuple, sp.points_by_kind(points, s, ["session_id"], marks, width=w).collect())) for w in (None, 41))
    want = [tuple(any(r == role and a <= t < b for r, a, b in rows) for role in ("subject", "partner")) for t in range(0, 1100, 3)]
    assert one == two and [x[2:] for x in one] == want
