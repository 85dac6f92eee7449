"""Interval algebra against hand cases, properties and a plain model."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parlance.operators import spans as sp

SCHEMA = "k int, start long, end long"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SPANS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8)), max_size=14)


def frame(spark, rows):
    return spark.createDataFrame([(k, s, s + n) for k, s, n in rows], SCHEMA)


def ticks(rows):
    return {(k, t) for k, s, n in rows for t in range(s, s + n)}


def covered(df):
    return {(r.k, t) for r in df.collect() for t in range(r.start, r.end)}


def out(df):
    return sorted((r.k, r.start, r.end) for r in df.collect())


def test_merge_touching_and_gap(spark):
    df = frame(spark, [(1, 0, 2), (1, 2, 2), (1, 6, 1), (1, 9, 0)])
    assert out(sp.merge(df, ["k"])) == [(1, 0, 4), (1, 6, 7)]
    assert out(sp.merge(df, ["k"], gap=2)) == [(1, 0, 7)]
    assert {r.n_spans for r in sp.merge(df, ["k"], gap=2).collect()} == {3}


def test_touching_spans_do_not_intersect(spark):
    assert out(sp.intersect(frame(spark, [(1, 0, 5)]), frame(spark, [(1, 5, 5)]), ["k"])) == []


def test_self_overlap_is_merged_by_intersection(spark):
    left = frame(spark, [(1, 0, 6), (1, 2, 6)])
    assert out(sp.intersect(left, frame(spark, [(1, 1, 9)]), ["k"])) == [(1, 1, 8)]


def test_gaps_are_strict(spark):
    df = frame(spark, [(1, 0, 2), (1, 4, 2), (1, 9, 1)])
    assert out(sp.gaps(df, ["k"], 2)) == [(1, 6, 9)]


def test_seconds_with_epsilon(spark):
    df = spark.createDataFrame([(1, 0.1, 0.3), (1, 0.30000000001, 0.5)], "k int, start double, end double")
    assert sp.merge(df, ["k"], eps=1e-9).count() == 1


def test_clip_and_invert(spark):
    x = spark.createDataFrame([(1, 2, 10)], "k int, extent_start long, extent_end long")
    df = frame(spark, [(1, 0, 4), (1, 6, 2), (1, 20, 3)])
    assert out(sp.clip(df, x, ["k"])) == [(1, 2, 4), (1, 6, 8)]
    assert out(sp.invert(df, x, ["k"])) == [(1, 4, 6), (1, 8, 10)]


def test_empty_sides(spark):
    e, df = frame(spark, []), frame(spark, [(1, 0, 4)])
    assert out(sp.merge(e, ["k"])) == [] and out(sp.intersect(e, df, ["k"])) == []
    assert out(sp.subtract(df, e, ["k"])) == [(1, 0, 4)]


@FEW
@given(a=SPANS, b=SPANS)
def test_algebra_equals_sets_of_ticks(spark, a, b):
    left, right = frame(spark, a), frame(spark, b)
    for width in (None, 7):
        assert covered(sp.merge(left, ["k"], width=width)) == ticks(a)
        assert covered(sp.intersect(left, right, ["k"], width=width)) == ticks(a) & ticks(b)
        assert covered(sp.subtract(left, right, ["k"], width=width)) == ticks(a) - ticks(b)
    m = sp.merge(left, ["k"]).drop("n_spans")
    assert out(sp.merge(m, ["k"]).drop("n_spans")) == out(m)


def test_bucketed_sweep_gives_the_same_spans(spark):
    rng = random.Random(3)
    a = [(rng.randrange(3), rng.randrange(100), rng.randrange(15)) for _ in range(60)]
    b = [(rng.randrange(3), rng.randrange(100), rng.randrange(15)) for _ in range(60)]
    left, right = frame(spark, a), frame(spark, b)
    assert out(sp.intersect(left, right, ["k"], width=10)) == out(sp.intersect(left, right, ["k"]))
    assert out(sp.merge(left, ["k"], gap=2, width=10).drop("n_spans")) == out(sp.merge(left, ["k"], gap=2).drop("n_spans"))


def test_points(spark):
    p = spark.createDataFrame([(1, 0), (1, 4), (1, 5), (2, 1), (1, -1)], "k int, t long")
    got = sp.points_in_spans(p, frame(spark, [(1, 0, 3), (1, 1, 4)]), ["k"]).collect()
    assert sorted((r.k, r.t, r.inside) for r in got) == [(1, -1, False), (1, 0, True), (1, 4, True), (1, 5, False), (2, 1, False)]


@pytest.mark.parametrize("op", ["intersect", "subtract", "points"])
def test_no_nested_loops(spark, plan, op):
    left = frame(spark, [(1, 0, 4)])
    if op == "points":
        df = sp.points_in_spans(left.withColumnRenamed("start", "t"), left, ["k"])
    else:
        df = getattr(sp, op)(left, left, ["k"])
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_speaker_overlap_counts_the_same_speaker(spark):
    df = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 5, 10), (1, "b", 8, 12)], "session_id int, speaker string, start long, end long")
    r = sp.speaker_overlap(df).collect()[0]
    assert (r.total, r.covered, r.overlap) == (19, 12, 7)
