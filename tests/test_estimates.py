"""Estimates made together against each made alone, and tests of their errors against plain counts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_evaluate import COLUMNS, rows

from parlance.functions import tails
from parlance.operators import estimates as es
from parlance.operators import evaluate as ev


def integral(f, a, b, n=200_000):
    x = np.linspace(a, b, 2 * n + 1)
    y = f(x)
    return (b - a) / (6 * n) * (y[0] + y[-1] + 4 * y[1::2].sum() + 2 * y[2:-1:2].sum())


def test_correlation_p_is_the_tail_of_t():
    for n, r in [(3, 0.2), (5, -0.7), (10, 0.5), (40, 0.05), (400, 0.1), (62, -0.31)]:
        free = n - 2
        t = abs(r) * math.sqrt(free / (1 - r * r))
        front = math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(free * math.pi)
        # the middle of the density over an angle, so that the ends are finite
        middle = integral(lambda x: front * (1 + x * x / free) ** (-(free + 1) / 2), 0.0, t)
        assert tails.correlation_p(r, n) == pytest.approx(1 - 2 * middle, abs=1e-10)
    assert tails.correlation_p([1.0, -1.0, 0.0], [9, 9, 9]).tolist() == [0.0, 0.0, 1.0]
    assert np.isnan(tails.correlation_p([0.5, float("nan")], [2, 9])).all()


@pytest.mark.parametrize("n", [1, 2, 5, 9, 20])
def test_rank_sums_are_counted_out(n):
    signs = (np.arange(2**n)[:, None] >> np.arange(n)) & 1
    sums = signs @ np.arange(1, n + 1)
    for w in {0, 1, n, n * (n + 1) // 4, n * (n + 1) // 2}:
        want = min(1.0, 2 * min((sums <= w).mean(), (sums >= w).mean()))
        assert tails.signed_rank_exact(w, n) == pytest.approx(want, rel=1e-12)


def test_signed_rank_is_exact_where_it_can_be(spark):
    data = [("few", 1.0, 0.5), ("few", 2.0, 0.0), ("few", 0.0, 3.5), ("few", 9.0, 1.0), ("zero", 1.0, 1.0), ("zero", 3.0, 1.0), ("zero", 1.0, 2.0), ("tie", 1.0, 0.0), ("tie", 2.0, 1.0), ("tie", 0.0, 5.0)]
    got = {r.k: r.p_value for r in ev.signed_rank_p(ev.signed_rank(spark.createDataFrame(data, "k string, a double, b double"), ["k"], "a", "b")).collect()}
    plus = {1, 2, 4}  # ranks of 0.5, 2, 8
    below = sum(1 for s in itertools.product((0, 1), repeat=4) if sum(r for r, on in zip((1, 2, 3, 4), s) if on) >= sum(plus))
    assert got["few"] == pytest.approx(min(1.0, 2 * below / 16))
    normal = lambda n, w, ties: math.erfc((n * (n + 1) / 4 - w) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / math.sqrt(2))
    assert got["zero"] == pytest.approx(normal(3, 2.5, 0)) and got["tie"] == pytest.approx(normal(3, 3.0, 6))


def test_schemes_are_runs_of_their_own(spark):
    r = rows(spark, 144, noise=4.0)
    got = es.scheme_scores(r, COLUMNS, "y", 4, 2, seed=3, inner=3).collect()[0]

    def alone(k, seed):
        p, fits = ev.cross_validate(r, COLUMNS, "y", k, seed, inner=3)
        return ev.out_of_fold_scores(p.withColumn("m", F.lit(1)), ["m"], "y").collect()[0]

    loo, repeats = alone(0, 3), [alone(4, s).r2 for s in (3, 4)]
    assert got.n == loo.n and got.r2 == pytest.approx(loo.r2, abs=1e-9)
    assert got.r2_mean == pytest.approx(np.mean(repeats), abs=1e-9) and got.r2_sd == pytest.approx(np.std(repeats, ddof=1), abs=1e-9)
    assert (got.n_repeats, got.n_features, got.sign_disagrees) == (2, 3, False)
    with pytest.raises(ValueError, match="fewer than"):
        es.scheme_scores(r.limit(9), COLUMNS, "y")


def test_a_plan_is_its_estimates(spark):
    r = rows(spark, 120, noise=2.0).withColumn("z", F.when(F.col("id") % 3 > 0, F.col("b") * 2 + F.col("id") % 5)).withColumn("thin", F.when(F.col("id") < 4, F.col("b")))
    targets = spark.createDataFrame([("y", 1), ("z", 1), ("thin", 1), ("gone", 1), ("none", 0)], "target string, n_known long")
    plan = ev.estimate_plan(targets, [("all", "confirmatory"), ("one", "confirmatory")], ["net", "odd"])
    variants = {"all": COLUMNS, "one": ["b"]}
    results, outcomes, errors = es.run_plan(r, plan, variants, 4, inner=3)
    results, errors = results.cache(), errors.cache()
    seen = {(x.target, x.variant, x.model): (x.status, x.message) for x in outcomes.collect()}
    assert len(seen) == 20 and {s for s, _ in (v for k, v in seen.items() if k[0] == "none")} == {"skipped"}
    assert all(seen[t, v, "net"] == ("ok", None) for t in "yz" for v in variants)
    assert seen["y", "all", "odd"] == ("failed", "KeyError: 'odd'") and seen["gone", "one", "net"] == ("failed", "no column gone")
    assert "too few" in seen["thin", "one", "net"][1]
    assert {(x.target, x.variant, x.model) for x in results.select("target", "variant", "model").collect()} == {(t, v, "net") for t in "yz" for v in variants}
    for t in "yz":
        for v, columns in variants.items():
            known = r.where(F.col(t).isNotNull())
            folds = ev.group_folds(r, 4)
            # the folds of a plan are those of all rows
            medians = ev.prepare_folds(known.join(folds, "group"), columns, folds)
            part = known.join(folds, "group").withColumn("inner", es.inner_fold("group", 3))
            fits = ev.fit_elastic_nets(ev.gram(part, columns, t, ["fold", "inner"]), medians, columns)
            want = {x.id: abs(x[t] - x.prediction) for x in ev.predict(part, columns, fits, medians).collect()}
            got = {x.id: x.error for x in errors.where((F.col("target") == t) & (F.col("variant") == v)).collect()}
            assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-9)
            one = results.where((F.col("target") == t) & (F.col("variant") == v)).collect()[0]
            assert one.n == len(want) and one.mae == pytest.approx(np.mean(list(want.values()))) and 0 <= one.spearman_p <= 1
    family = spark.createDataFrame([("t1", "y", "all", "one"), ("t1", "z", "all", "one"), ("t2", "y", "all", "all"), ("t3", "y", "all", "gone")], "test string, target string, left string, right string")
    tests = {(x.test, x.target): x for x in es.compare_models(errors.where("model = 'net'"), family).collect()}
    assert tests["t3", "y"].status == "too few pairs" and tests["t3", "y"].p_value is None and tests["t3", "y"].p_holm is None
    assert tests["t2", "y"].p_value == 1.0 and tests["t2", "y"].median_difference == 0.0
    pair = {v: {x.id: x.error for x in errors.where(f"target = 'y' AND variant = '{v}'").collect()} for v in variants}
    d = np.array([pair["one"][i] - pair["all"][i] for i in pair["all"]])
    assert tests["t1", "y"].n == len(d) and tests["t1", "y"].median_difference == pytest.approx(np.median(d))
    order = sorted(x.p_value for x in tests.values() if x.p_value is not None)
    assert tests["t1", "y"].p_holm == pytest.approx(min(1.0, max((3 - i) * p for i, p in enumerate(order) if p <= tests["t1", "y"].p_value)))


def test_a_forest_is_fitted_on_all_cores(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    held, fit = [], RandomForestRegressor.fit

    def noted(self, df, *rest):
        held.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, df, *rest)

    monkeypatch.setattr(RandomForestRegressor, "fit", noted)
    monkeypatch.setattr(ev, "FOREST_ROWS", 30)
    r = rows(spark, 120).join(ev.group_folds(rows(spark, 120), 3), "group").coalesce(1)
    assert ev.forest_out_of_fold(r, COLUMNS, "y", range(3), trees=5).count() == 117
    assert [len(h) for h in held] == [4, 4, 4] and max(map(max, held)) < 60


def test_forests_share_one_table(spark):
    r = rows(spark, 120).join(ev.group_folds(rows(spark, 120), 3), "group")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    p = ev.forest_out_of_fold(r.mapInArrow(count, r.schema), COLUMNS, "y", range(3), trees=5).collect()
    assert read.value == 120 and len(p) == 117
    assert ev.out_of_fold_scores(spark.createDataFrame(p).withColumn("k", F.lit(1)), ["k"], "y").collect()[0].r2 > 0.5
    with pytest.raises(ValueError, match="at most"):
        ev.forest_out_of_fold(r, COLUMNS, "y", range(21))
