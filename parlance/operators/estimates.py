"""Many model estimates at once: all targets, variants, models and validation schemes of a plan from one set of sums.

Rows are read once, into sums of products per (unit, fold, inner fold); a unit is a target, or a validation scheme of one. Each fit is a group of
cells of one unit and fold, cut to the columns of its variant inside the task; what goes wrong in a fit is a value, not the end of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluate as ev
from .scans import settled

#: Models that rest on sums of products: (imputed sums of the inner folds, number of columns) -> coefficients, intercepts, fits that did not converge.
MODELS: dict[str, Callable] = {"net": ev.elastic_nets}
KEY = ("unit", "variant", "tier", "model")
_FIT = "unit string, variant string, tier string, model string, fold int, b map<string,double>, intercept double, n_features int, not_converged long, message string, n double, error double, sum double, squares double"


def inner_fold(group: str, inner: int) -> Column:
    return F.pmod(F.crc32(F.col(group).cast("string")), F.lit(inner)).cast("int")


def fold_medians(units: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(unit, fold, feature, median) of the training rows of every fold of every unit. ``units``: rows (unit, fold, columns)."""
    apart = "\x1f"
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    x = units.select("unit", F.col("fold").cast("int").alias("fold"), long.alias("x"))
    x = settled(x.select("fold", F.concat_ws(apart, "unit", "x.c").alias("feature"), "x.v"))
    made = ev.prepare_values(x, x.select("fold", "feature").distinct())
    parts = F.split("feature", apart)
    return made.select(parts[0].alias("unit"), "fold", parts[1].alias("feature"), "median")


def fit_all(cells: DataFrame, medians: DataFrame, plan: DataFrame, variants: dict[str, Sequence[str]], models: dict[str, Callable] | None = None) -> DataFrame:
    """A row for each estimate of ``plan`` (unit, variant, tier, model) and fold: its fit, sums of what it leaves in its own fold, and ``message``.

    ``cells``: (unit, fold, inner, i, j, s). The training sums of a fold are all sums of its unit less its own.
    """
    models = MODELS if models is None else models
    cells = settled(cells.select("unit", F.col("fold").cast("int").alias("fold"), "inner", "i", "j", "s"))
    every = cells.groupBy("unit", "inner", "i", "j").agg(F.sum("s").alias("all"))
    train = every.join(cells.select("unit", "fold").distinct(), "unit").join(cells, ["unit", "fold", "inner", "i", "j"], "left").withColumn("own", F.coalesce("s", F.lit(0.0)))
    train = train.withColumn("s", F.col("all") - F.col("own"))
    train = train.join(medians.select("unit", F.col("fold").cast("int").alias("fold"), F.concat(F.lit("x_"), "feature").alias("i"), "median"), ["unit", "fold", "i"], "left")
    each = train.join(plan.select(*KEY), "unit")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in (*KEY, "fold")}
        try:
            columns = list(variants[row["variant"]])
            p, at = len(columns), {n: i for i, n in enumerate(ev.gram_names(columns))}
            some = pdf[pdf["i"].isin(list(at)) & pdf["j"].isin(list(at))].reset_index(drop=True)
            parts, _ = ev._matrices(some, at, p)
            own, _ = ev._matrices(some.assign(s=some["own"]), at, p)
            held = np.sum(list(own.values()), axis=0)
            rows = sum(x[-1, -1] for x in parts.values())
            if rows + held[-1, -1] < ev.MIN_ROWS:
                raise ValueError(f"{rows + held[-1, -1]:.0f} rows are too few; at least {ev.MIN_ROWS} are needed")
            made = models[row["model"]](list(parts.values()), p)
            error = ev._squared_error(held, p, made["b"], made["intercept"], np.zeros(1, int))[0]
            row |= {"b": dict(zip(columns, made["b"][0].tolist(), strict=True)), "intercept": made["intercept"][0], "n_features": p, "not_converged": int(made["stuck"][0])}
            row |= {"message": None, "n": held[-1, -1], "error": error, "sum": held[p, -1], "squares": held[p, p]}
        except Exception as problem:  # noqa: BLE001 - whatever it is, it is on record
            row |= {"b": None, "intercept": None, "n_features": None, "not_converged": None, "message": f"{type(problem).__name__}: {problem}"[:300], "n": None, "error": None, "sum": None, "squares": None}
        return pd.DataFrame([row])[[c.split()[0] for c in _FIT.replace("<string,double>", "").split(", ")]]

    return each.groupBy(*KEY, "fold").applyInPandas(fit, _FIT)


def scores_from_sums(fits: DataFrame) -> DataFrame:
    """(unit, variant, tier, model, n, n_features, r2, not_converged, message): out-of-fold r2 without another pass over rows."""
    g = fits.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n", "error", "sum", "squares", "not_converged")], F.max("n_features").alias("n_features"), F.min("message").alias("message"))
    spread = F.col("squares") - F.col("sum") * F.col("sum") / F.col("n")
    r2 = F.when(F.col("message").isNull() & (spread > 1e-12 * F.col("squares")), 1 - F.col("error") / spread)
    return g.select(*KEY, F.col("n").cast("long").alias("n"), "n_features", r2.alias("r2"), "not_converged", "message")


# ---------------------------------------------------------------- validation schemes


def schemes(groups: DataFrame, k: int, repeats: int, seed: int = 0, group: str = "group", alone: bool = True) -> DataFrame:
    """(group, unit, fold): an assignment of every group under leaving one out ('loo', if ``alone``) and under each repeat of k folds ('repeat 0', ...)."""
    g = settled(groups.select(group).distinct())
    made = [ev.group_folds(g, 0, seed, group).withColumn("unit", F.lit("loo"))] if alone else []
    made += [ev.group_folds(g, k, seed + r, group).withColumn("unit", F.lit(f"repeat {r}")) for r in range(repeats)]
    return settled(reduce(DataFrame.unionByName, made))


def scheme_scores(rows: DataFrame, columns: Sequence[str], target: str, k: int = 5, repeats: int = 3, seed: int = 0, inner: int = 5, group: str = "group", model: str = "net", alone: bool = True) -> DataFrame:
    """(model, n, n_features, r2, r2_mean, r2_sd, n_repeats, sign_disagrees, not_converged): leave-one-group-out beside repeated k-fold.

    The rows are summed once, by group; the cells of every scheme are sums of groups' sums, and each (scheme, fold) is a fit. The
    signs disagree where r2 and the mean of the repeats lie on different sides of 0; without ``alone`` only the repeats are made, and it is their
    own signs. Fewer than MIN_ROWS rows are refused.
    """
    known = settled(ev.enough_rows(rows.where(F.col(target).isNotNull()), target).select(group, inner_fold(group, inner).alias("inner"), *columns, F.col(target).cast("double").alias("y")))
    assigned = schemes(known, k, repeats, seed, group, alone)
    sums = settled(ev.gram(known, columns, "y", [group, "inner"]))
    cells = sums.join(assigned, group).groupBy("unit", "fold", "inner", "i", "j").agg(F.sum("s").alias("s"))
    medians = fold_medians(known.join(assigned, group).select("unit", "fold", *columns), columns)
    plan = assigned.select("unit").distinct().select("unit", F.lit("all").alias("variant"), F.lit("").alias("tier"), F.lit(model).alias("model"))
    s = scores_from_sums(fit_all(cells, medians, plan, {"all": columns}))
    of = lambda c: F.when(F.col("unit") == "loo", F.col(c))
    repeat = F.when(F.col("unit") != "loo", F.col("r2"))
    out = s.groupBy("model").agg(
        F.max(of("n")).alias("n"), F.max(of("n_features")).alias("n_features"), F.max(of("r2")).alias("r2"), F.avg(repeat).alias("r2_mean"),
        F.when(F.count(repeat) == 1, 0.0).otherwise(F.stddev_samp(repeat)).alias("r2_sd"), F.count(repeat).alias("n_repeats"), F.max(of("not_converged")).alias("not_converged"),
        ((F.min(repeat) < 0) & (F.max(repeat) > 0)).alias("__mixed"),
    )
    return out.withColumn("sign_disagrees", (F.col("r2") < 0) != (F.col("r2_mean") < 0) if alone else F.col("__mixed")).drop("__mixed")


# ---------------------------------------------------------------- plans of estimates


def run_plan(
    rows: DataFrame, plan: DataFrame, variants: dict[str, Sequence[str]], k: int = 5, seed: int = 0, inner: int = 5, group: str = "group", row_id: str = "id", models: dict[str, Callable] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, outcomes, errors) of a plan (target, variant, tier, model, status), in one job for all its estimates.

    ``results``: n, n_features, r2, mae, spearman, spearman_p and not_converged of each estimate that went well. ``outcomes``: status ok, failed or
    skipped, and a message. ``errors``: (row_id, target, variant, tier, model, error), the absolute out-of-fold errors for comparisons.
    Targets are columns of ``rows``; nulls of one target do not touch the others.
    """
    if bad := {"__id", "fold", "inner", "unit", "y"} & {c for v in variants.values() for c in v}:
        raise ValueError(f"feature columns may not be called {sorted(bad)}")
    planned = settled(plan.where("status = 'planned'").withColumnRenamed("target", "unit"))
    targets = [r["unit"] for r in planned.select("unit").distinct().collect()]  # configuration
    have = [t for t in targets if t in rows.columns]
    columns = list(dict.fromkeys(c for v in variants.values() for c in v if c in rows.columns))
    folds = settled(ev.group_folds(rows, k, seed, group))
    long = F.explode(F.array(*[F.struct(F.lit(t).alias("unit"), F.col(t).cast("double").alias("y")) for t in have])) if have else F.explode(F.expr("CAST(array() AS array<struct<unit: string, y: double>>)"))
    units = rows.join(folds, group).select(F.col(row_id).alias("__id"), "fold", inner_fold(group, inner).alias("inner"), *columns, long.alias("__t"))
    units = settled(units.select("__id", "fold", "inner", *columns, "__t.unit", "__t.y").where("y IS NOT NULL"))
    cells = ev.gram(units, columns, "y", ["unit", "fold", "inner"])
    fits = settled(fit_all(cells, fold_medians(units, columns), planned, variants, models))
    sums = scores_from_sums(fits)
    state = planned.select(*KEY).join(sums.select(*KEY, "n", "message"), list(KEY), "left")
    message = F.when(~F.col("unit").isin(have), F.concat(F.lit("no column "), "unit")).when(F.coalesce("n", F.lit(0)) == 0, F.coalesce("message", F.lit("no out-of-fold predictions were produced"))).otherwise(F.col("message"))
    state = state.withColumn("message", message).withColumn("status", F.when(F.col("message").isNull(), "ok").otherwise("failed"))
    state = settled(state.select(*KEY, "status", "message"))
    rest = plan.where("status <> 'planned'").select(F.col("target").alias("unit"), "variant", "tier", "model", "status", F.lit(None).cast("string").alias("message"))
    outcomes = state.unionByName(rest).withColumnRenamed("unit", "target")
    # predictions: each row meets the fits of its fold, one short row per estimate
    good = fits.join(state.where("status = 'ok'").select(*KEY), list(KEY)).select(*KEY, "fold", F.col("b").alias("__b"), F.col("intercept").alias("__intercept"))
    filled = fold_medians(units, columns).groupBy("unit", "fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("__m"))
    p = units.join(good.join(filled, ["unit", "fold"]), ["unit", "fold"])
    total = F.col("__intercept")
    for c in columns:
        total = total + F.coalesce(F.col("__b")[c], F.lit(0.0)) * F.coalesce(F.col(c).cast("double"), F.col("__m")[c], F.lit(0.0))
    p = settled(p.select("__id", *KEY, "y", total.alias("prediction")))
    scores = ev.with_spearman_p(ev.out_of_fold_scores(p, list(KEY), "y", "prediction"))
    results = scores.join(sums.select(*KEY, "n_features", "not_converged"), list(KEY)).withColumnRenamed("unit", "target")
    errors = p.select(F.col("__id").alias(row_id), F.col("unit").alias("target"), "variant", "tier", "model", F.abs(F.col("y") - F.col("prediction")).alias("error"))
    return results, outcomes, errors


def compare_models(errors: DataFrame, plan: DataFrame, row_id: str = "id") -> DataFrame:
    """(test, target, left, right, status, n, median_difference, p_value, p_holm): planned comparisons of the errors of two variants.

    ``errors``: (row_id, target, variant, error), ``plan``: (test, target, left, right). Pairs are rows that both predicted; the difference is right less
    left, so a positive one favours the left. Under two pairs a comparison is refused ('too few pairs', no p value); differences of 0
    throughout have p = 1. Holm's correction is over all that were made.
    """
    side = lambda name: errors.select(row_id, "target", F.col("variant").alias(name), F.col("error").alias(f"__{name}"))
    pairs = plan.join(side("left"), ["target", "left"]).join(side("right"), [row_id, "target", "right"])
    keys = ["test", "target", "left", "right"]
    pairs = settled(pairs.where("__left IS NOT NULL AND __right IS NOT NULL").select(*keys, "__left", "__right"))
    tests = ev.signed_rank_p(ev.signed_rank(pairs, keys, "__right", "__left"))
    widest = pairs.groupBy(*keys).agg(F.max(F.abs(F.col("__right") - F.col("__left"))).alias("__widest"))
    t = plan.select(*keys).join(tests.join(widest, keys), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    same, few = F.col("__widest") <= 1e-8, F.col("n") < 2
    p = F.when(few, None).when(same, 1.0).otherwise(F.col("p_value"))
    middle = F.when(few, None).when(same, 0.0).otherwise(F.col("median_difference"))
    t = settled(t.select(*keys, F.when(few, "too few pairs").otherwise("ok").alias("status"), "n", middle.alias("median_difference"), p.alias("p_value")))
    return ev.holm(t)
