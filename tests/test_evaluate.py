"""Models on sums against plain numpy, and their plans and result tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import evaluate as ev

COLUMNS = ["a", "b", "c"]


def rows(spark, n=240, noise=0.5, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=(3, n))
    y = 3 * a - 2 * b + noise * rng.normal(size=n)
    data = [(i, f"g{i % 24}", float(a[i]) if i % 11 else None, float(b[i]), float(c[i]), float(y[i]) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(data, "id int, group string, a double, b double, c double, y double")


def plain_net(x, y, alpha, ratio, turns=5000):
    """Coordinate descent over standardised rows, one problem at a time."""
    b = np.zeros(x.shape[1])
    for _ in range(turns):
        old = b.copy()
        for j in range(len(b)):
            z = x[:, j] @ (y - x @ b + x[:, j] * b[j]) / len(y)
            b[j] = np.sign(z) * max(abs(z) - alpha * ratio, 0) / (x[:, j] @ x[:, j] / len(y) + alpha * (1 - ratio))
        if np.abs(b - old).max() < 1e-9:
            break
    return b


def test_coordinate_descent_at_all_penalties():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ rng.normal(size=6) + rng.normal(size=80)
    y -= y.mean()
    alpha = np.tile(np.geomspace(1, 1e-2, 12) * 2, 4)
    ratio = np.repeat(ev.L1_RATIOS, 12)
    got, ok = ev.coordinate_descent(x.T @ x / 80, np.tile(x.T @ y / 80, (48, 1)), alpha, ratio)
    assert ok.all() and np.allclose(got, [plain_net(x, y, a, r) for a, r in zip(alpha, ratio)], atol=1e-4)


def plain_fit(x, y, inner):
    """The chosen elastic net on training rows whose nulls are imputed: (coefficients, intercept, alpha, ratio)."""
    std = lambda x: (x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), np.inf))
    m, s = std(x)
    best = (np.inf,)
    for ratio in ev.L1_RATIOS:
        top = np.abs(((x - m) / s).T @ (y - y.mean()) / len(y)).max() / ratio
        for alpha in top * np.geomspace(1, ev.ALPHA_SPAN, ev.N_ALPHAS):
            loss = 0
            for k in np.unique(inner):
                t = inner != k
                mi, si = std(x[t])
                b = plain_net((x[t] - mi) / si, y[t] - y[t].mean(), alpha, ratio) / si
                loss += ((y[~t] - y[t].mean() - (x[~t] - mi) @ b) ** 2).sum()
            if loss < best[0] - 1e-9:
                best = (loss, alpha, ratio)
    b = plain_net((x - m) / s, y - y.mean(), best[1], best[2]) / s
    return b, y.mean() - b @ m, best[1], best[2]


def test_cross_validation_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(ev, "BUCKETS", 5)
    r = rows(spark, 120)
    p, fits = ev.cross_validate(r, COLUMNS, "y", 4, inner=3)
    pdf = p.withColumn("inner", F.pmod(F.crc32("group"), F.lit(3))).toPandas()
    got = {(f.fold, f.feature): f for f in fits.collect()}
    known = pdf[pdf.y.notna()]
    for fold in range(4):
        t, held = known[known.fold != fold], pdf[pdf.fold == fold]
        med = t[COLUMNS].median()
        b, a, alpha, ratio = plain_fit(t[COLUMNS].fillna(med).to_numpy(), t.y.to_numpy(), t.inner.to_numpy())
        assert np.allclose([got[fold, c].coefficient for c in COLUMNS], b, atol=1e-3)
        assert got[fold, "a"].l1_ratio == ratio and got[fold, "a"].alpha == pytest.approx(alpha)
        assert np.allclose(held.prediction, a + held[COLUMNS].fillna(med).to_numpy() @ b, atol=5e-3)
    with pytest.raises(ValueError, match="fewer than"):
        ev.cross_validate(r.limit(12).withColumn("y", F.when(F.col("id") < 9, F.col("y"))), COLUMNS, "y", 2)


def test_leaving_each_group_out(spark):
    p, fits = ev.cross_validate(rows(spark, 96), COLUMNS, "y", 0)
    assert fits.select("fold").distinct().count() == 24
    assert ev.out_of_fold_scores(p.withColumn("k", F.lit(1)), ["k"], "y").collect()[0].r2 > 0.8


@pytest.mark.parametrize("k", [3, 0])
def test_fold_preparation_equals_pandas(spark, monkeypatch, k):
    monkeypatch.setattr(ev, "BUCKETS", 4)
    r = rows(spark, 60).withColumn("b", F.round("b", 0)).withColumn("c", F.when(F.col("group") == "g3", F.col("c") + 1e6))
    folds = ev.group_folds(r, k)
    r = r.join(folds, "group")
    got = {(x.fold, x.feature): x for x in ev.prepare_folds(r, COLUMNS, folds).collect()}
    pdf = r.toPandas()
    for fold in pdf.fold.unique():
        for c in COLUMNS:
            rest = pdf[pdf.fold != fold][c]
            if rest.notna().sum() == 0:
                assert (fold, c) not in got
                continue
            v = rest.fillna(rest.median())
            x = got[fold, c]
            assert (x.median, x.mean) == pytest.approx((rest.median(), v.mean())) and x.sd == pytest.approx(v.std(ddof=0), rel=1e-6, abs=1e-6)


def test_ranks_over_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 40, 300)
    df = spark.createDataFrame([(int(i % 2), int(i), float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    for buckets in (2, 128):
        monkeypatch.setattr(ev, "BUCKETS", buckets)
        got = ev.average_ranks(df, ["k"], "v", "r").toPandas()
        assert (got.r == got.groupby("k").v.rank()).all()


def test_ranks_of_short_and_long_keys(spark, plan):
    rng = np.random.default_rng(4)
    data = [(rng.choice([0, 0, 0, 1, None]), i, rng.choice([None, float("nan"), -0.0, 0.0, *map(float, range(30))])) for i in range(400)]
    df = spark.createDataFrame([(None if k is None else int(k), i, v) for k, i, v in data], "k int, i int, v double")
    for most in (10, 150, 1000):  # all keys long, some, none
        got = {r.i: r.r for r in ev.average_ranks(df, ["k"], "v", "r", most).collect()}
        assert len(got) == 400
        for k in (0, 1, None):
            some = [(i, v) for j, i, v in df.collect() if j == k]
            known = [v if v == v else np.inf for _, v in some if v is not None]
            for i, v in some:
                at = np.inf if v is not None and v != v else v
                assert got[i] == (None if v is None else sum(x < at for x in known) + (sum(x == at for x in known) + 1) / 2)
    p = df.select("k", F.col("v").alias("truth"), F.col("i").alias("prediction"))
    scores = ev.out_of_fold_scores(p, ["k"])
    assert "Join" not in plan(scores) and plan(scores).count("Exchange") == 1  # rows of short keys are dealt once
    assert "Window" not in plan(scores.select("k", "n", "r2", "mae"))  # what needs no ranks makes none


def test_permutations_are_one_to_one_and_scored_as_refits(spark):
    r = rows(spark, 120)
    ys = ev.permuted_targets(r, "y", 6).toPandas().set_index("id").ys
    own = r.where("y IS NOT NULL").toPandas().set_index("id").y
    table = np.stack(ys.sort_index().to_numpy())
    assert (table[:, 0] == own.sort_index()).all() and len(own) == len(ys)
    for p in range(1, 7):
        assert sorted(table[:, p]) == sorted(own) and (table[:, p] != table[:, 0]).mean() > 0.8
    s = {x.permutation: x.score for x in ev.permutation_null(r, COLUMNS, "y", 3, k=4, inner=3).collect()}
    ids = {int(i): [float(v) for v in y] for i, y in ys.items()}
    three = ev.permuted_targets(r, "y", 3).toPandas().set_index("id").ys
    for p in (0, 2):
        moved = spark.createDataFrame([(int(i), float(y[p])) for i, y in three.items()], "id int, z double")
        got, _ = ev.cross_validate(r.where("y IS NOT NULL").join(moved, "id"), COLUMNS, "z", 4, inner=3)
        assert s[p] == pytest.approx(ev.out_of_fold_scores(got.withColumn("k", F.lit(1)), ["k"], "z").collect()[0].r2, abs=1e-4)
    assert s[0] > 0.8 > max(s[p] for p in (1, 2, 3)) and len(ids) == len(own)


def test_signed_rank_p_by_the_formula(spark):
    rng = np.random.default_rng(5)
    d = np.r_[rng.integers(-4, 7, 60), 0, 0]
    df = spark.createDataFrame([(1, float(x), 0.0) for x in d], "k int, a double, b double")
    r = ev.signed_rank_p(ev.signed_rank(df, ["k"], "a", "b")).collect()[0]
    m = np.abs(d)
    ranks = np.array([(m < x).sum() + ((m == x).sum() + 1) / 2 for x in m])
    w = ranks[d > 0].sum() + ranks[d == 0].sum() / 2
    n, ties = len(d), sum(c**3 - c for c in np.unique(m, return_counts=True)[1])
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = -abs(w - n * (n + 1) / 4) / sd
    assert r.w_plus == w and r.p_value == pytest.approx(2 * 0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-12)


def test_estimates_go_on_after_a_failure(spark):
    plan = ev.estimate_plan(spark.createDataFrame([("y", 5), ("z", 0)], "target string, n_known long"), [("all", "confirmatory")], ["net", "bad"])

    def fit(e):
        if e["model"] == "bad":
            raise RuntimeError("boom")
        return spark.createDataFrame([(0.123456789, 10)], "r2 double, n long")

    results, outcomes = ev.run_estimates(plan, fit)
    assert [tuple(x) for x in results.collect()] == [("y", "all", "confirmatory", "net", 0.123457, 10)]
    got = {(x.target, x.model): (x.status, x.message) for x in outcomes.collect()}
    assert got == {("y", "net"): ("ok", None), ("y", "bad"): ("failed", "RuntimeError: boom"), ("z", "net"): ("skipped", None), ("z", "bad"): ("skipped", None)}
    assert {(x.tier, x.status): x.n for x in ev.estimate_counts(outcomes).collect()} == {("confirmatory", "ok"): 1, ("confirmatory", "failed"): 1, ("confirmatory", "skipped"): 2}
    with pytest.raises(ValueError, match="prediction"):
        ev.result_table(spark.createDataFrame([(1.0,)], "prediction double"))
