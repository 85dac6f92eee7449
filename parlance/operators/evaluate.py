"""Grouped model evaluation as Spark jobs: folds, fold-safe preparation, Gram matrices, elastic nets and tests.

Rows never leave their executors: what a fit needs is the sums of products of each fold, one small symmetric matrix per (target, fold), and
the training matrix of a fold is the total less that of the fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.tails import correlation_p, signed_rank_exact

from .scans import MOST_ROWS, same_keys, settled

# ---------------------------------------------------------------- running totals in range buckets

#: Ranges of keys and their values; any boundaries give the same totals.
BUCKETS = 128


def running_total(df: DataFrame, keys: Sequence[str], order: str, amount: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``amount`` over the rows of the keys up to ``order`` and with it, and ``__bucket``.

    ``order`` has no ties within the keys. Rows are dealt by ranges of (keys, order); a window runs over the few ranges that hold a
    part of the keys, and one over the rows of each range, so no task holds all rows of a long key.
    """
    ks = list(keys)
    d = settled(df.repartitionByRange(BUCKETS, *ks, order).withColumn("__bucket", F.spark_partition_id()))
    totals = d.groupBy(*ks, "__bucket").agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*ks).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = same_keys(d, totals.select(*ks, "__bucket", before.alias("__before")), [*ks, "__bucket"])
    within = F.sum(amount).over(Window.partitionBy(*ks, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, F.col("__before") + within).drop("__before")


# ---------------------------------------------------------------- plans


def tier_plan(names: DataFrame, confirmatory: Sequence[str], families: Sequence[str]) -> DataFrame:
    """(name, family, tier): confirmatory columns, exploratory ones of known families, and the others as awaiting;
    confirmatory names that no column has are missing."""
    n = names.select("name").distinct().withColumn("family", F.split("name", "__")[0])
    tier = F.when(F.col("name").isin(*confirmatory), "confirmatory").when(F.col("family").isin(*families), "exploratory").otherwise("awaiting")
    planned = F.explode(F.array(*[F.lit(c) for c in confirmatory]))
    want = names.sparkSession.range(1).select(planned.alias("name"))
    gone = want.join(n, "name", "left_anti").select("name", F.split("name", "__")[0].alias("family"), F.lit("missing").alias("tier"))
    return n.withColumn("tier", tier).unionByName(gone)


def estimate_plan(targets: DataFrame, variants: Sequence[tuple[str, str]], models: Sequence[str]) -> DataFrame:
    """(target, variant, tier, model, status): every estimate to make; targets without values are skipped."""
    v = F.explode(F.array(*[F.struct(F.lit(a).alias("variant"), F.lit(b).alias("tier")) for a, b in variants]))
    m = F.explode(F.array(*[F.lit(x) for x in models]))
    p = targets.withColumn("v", v).withColumn("model", m)
    return p.select("target", "v.variant", "v.tier", "model", F.when(F.col("n_known") > 0, "planned").otherwise("skipped").alias("status"))


def comparison_plan(estimates: DataFrame, plan: DataFrame) -> DataFrame:
    """(test, target, left, right, status) of planned comparisons (test, left, right), for confirmatory variants only."""
    e = estimates.where("tier = 'confirmatory'").select("target", "variant").distinct()
    t = e.select("target").distinct()
    p = plan.crossJoin(F.broadcast(t))  # targets are configuration
    p = p.join(e.withColumn("__l", F.lit(1)).withColumnRenamed("variant", "left"), ["target", "left"], "left")
    p = p.join(e.withColumn("__r", F.lit(1)).withColumnRenamed("variant", "right"), ["target", "right"], "left")
    return p.select("test", "target", "left", "right", F.when(F.col("__l").isNull() | F.col("__r").isNull(), "missing").otherwise("planned").alias("status"))


# ---------------------------------------------------------------- folds and preparation


def group_folds(rows: DataFrame, k: int, seed: int = 0, group: str = "group") -> DataFrame:
    """(group, fold): groups in order of a seeded hash, dealt to k folds in turn; k = 0 leaves each group out alone.

    The number of a group is its place among the group table's hash order, found in two levels.
    """
    g = rows.select(group).distinct()
    g = g.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))))
    g = g.withColumn("__b", F.substring("__h", 1, 2))
    sizes = g.groupBy("__b").agg(F.count("*").alias("__n"))  # 256 rows
    sizes = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", group)) - 1
    g = g.withColumn("__i", place).join(F.broadcast(sizes), "__b")
    number = F.col("__before") + F.col("__i")
    return g.select(group, (number % k if k else number).cast("int").alias("fold"))


def _fold_medians(x: DataFrame, cells: DataFrame) -> DataFrame:
    """(fold, feature, median) of the known values of all other folds. ``x``: (fold, feature, v), ``cells``: (fold, feature, n, total).

    A place t among the values outside a fold is the place t + c among all of them, c being how many of the fold's own stand
    before it; so each fold needs running counts of its own values, and two look-ups among those of all.
    """
    own = x.where("v IS NOT NULL").groupBy("fold", "feature", "v").agg(F.count("*").alias("k"))
    own = settled(own)
    every = settled(running_total(own.groupBy("feature", "v").agg(F.sum("k").alias("k")), ["feature"], "v", "k", "upto"))
    own = running_total(own, ["fold", "feature"], "v", "k", "mine").drop("__bucket").join(every.select("feature", "v", "upto"), ["feature", "v"])
    wanted = cells.withColumn("rest", F.col("total") - F.col("n")).where("rest > 0")
    wanted = wanted.select("fold", "feature", F.explode(F.array(F.floor((F.col("rest") + 1) / 2), F.ceil((F.col("rest") + 1) / 2))).alias("t")).distinct()
    place = own.join(wanted, ["fold", "feature"], "right").groupBy("fold", "feature", "t").agg(F.max(F.when(F.col("upto") - F.col("mine") < F.col("t"), F.col("mine"))).alias("c"))
    place = place.select("fold", "feature", (F.col("t") + F.coalesce("c", F.lit(0))).alias("at"))
    # the value at a place: the bucket from the few totals of buckets, then the last value that begins at or before it
    starts = every.groupBy("feature", "__bucket").agg(F.min(F.col("upto") - F.col("k")).alias("s"))
    starts = starts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("s", "__bucket"))).alias("starts"))
    place = place.join(starts, "feature").withColumn("__bucket", F.element_at(F.filter("starts", lambda b: b["s"] < F.col("at")), -1)["__bucket"]).drop("starts")
    both = every.select("feature", "__bucket", (F.col("upto") - F.col("k") + 1).alias("at"), F.lit(0).alias("kind"), "v", F.lit(None).cast("int").alias("fold"))
    both = both.unionByName(place.select("feature", "__bucket", "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v"), F.col("fold").cast("int").alias("fold")))
    w = Window.partitionBy("feature", "__bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("v", F.last("v", ignorenulls=True).over(w)).where("kind = 1")
    return found.groupBy("fold", "feature").agg(F.avg("v").alias("median"))


def prepare_folds(rows: DataFrame, columns: Sequence[str], folds: DataFrame) -> DataFrame:
    """(fold, feature, median, mean, sd) of the training rows of every fold: medians of known values, then mean and population
    sd after imputing them. ``rows`` has ``fold``, its own one.

    Counts, means and squares of a fold are summed once, and those of all other folds added up, so rows are never copied per
    fold, however many there are.
    """
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    x = rows.select(F.col("fold").cast("int").alias("fold"), long.alias("x")).select("fold", "x.feature", "x.v")
    grid = folds.select(F.col("fold").cast("int").alias("fold")).distinct().withColumn("feature", F.explode(F.array(*[F.lit(c) for c in columns])))
    return prepare_values(x, grid)


def prepare_values(x: DataFrame, grid: DataFrame) -> DataFrame:
    """``prepare_folds`` of values (fold, feature, v), for the cells (fold, feature) of ``grid``."""
    mine = x.groupBy("fold", "feature").agg(F.count("v").alias("n"), F.count("*").alias("rows"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("q"))
    mine = settled(grid.join(mine, ["fold", "feature"], "left").fillna(0, ["n", "rows", "q"]))
    # moments about a value of the middle, added up over the folds before and after: nothing is subtracted, so values held out
    # leave no trace, however large
    center = mine.groupBy("feature").agg(F.percentile_approx("m", 0.5).alias("at"))
    c = mine.join(center, "feature").withColumn("d", F.when(F.col("n") > 0, F.col("m") - F.col("at")).otherwise(0.0))
    w = Window.partitionBy("feature").orderBy("fold")
    others = lambda v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce(F.sum(v).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    n, d = F.col("n"), F.col("d")
    c = c.withColumns({"rest": others(n), "rest_rows": others(F.col("rows")), "first": others(n * d), "second": others(F.col("q") + n * d * d)})
    c = settled(c.where("rest > 0"))
    c = c.join(_fold_medians(x, c.select("fold", "feature", "n", (F.col("rest") + n).alias("total"))), ["fold", "feature"])
    c = c.withColumn("mean", F.col("at") + F.col("first") / F.col("rest")).withColumn("holes", F.col("rest_rows") - F.col("rest"))
    c = c.withColumn("q_rest", F.greatest(F.lit(0.0), F.col("second") - F.col("first") * F.col("first") / F.col("rest")))
    # imputed values stand at the median
    far, count = F.col("median") - F.col("mean"), F.col("rest") + F.col("holes")
    variance = (F.col("q_rest") + far * far * F.col("rest") * F.col("holes") / count) / count
    return c.select("fold", "feature", "median", (F.col("mean") + far * F.col("holes") / count).alias("mean"), F.sqrt(variance).alias("sd"))


#: Bytes of sums that a task holds before it hands them on.
_HELD = 64 << 20


def gram(rows: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """(keys, i, j, s): sums of products of every pair of [columns with nulls as 0, their null marks, target, 1], i <= j.

    One pass: each task multiplies whole batches of rows into one matrix per key and hands on its upper triangle, so the work
    does not depend on how many expressions a plan can hold.
    """
    names, terms = gram_terms(columns, target)
    ks, p = list(keys), len(names)
    r = rows.where(F.col(target).isNotNull()).select(*ks, F.array(*terms).alias("x"))
    upper = np.triu_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            found = [pa.array([key[i] for key in held], kinds[i]) for i in range(len(ks))]
            return pa.RecordBatch.from_arrays([*found, pa.array([m[upper] for m in held.values()], pa.list_(pa.float64()))], names=[*ks, "s"])

        for batch in batches:
            lists = batch.column(len(ks))
            x = np.asarray(lists.flatten()).reshape(batch.num_rows, p)  # rows lie one after the other
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(ks)):
                code = np.unique(code, return_inverse=True)[1] * (batch.num_rows + 1) + np.asarray(batch.column(i).dictionary_encode("encode").indices)
            order = np.argsort(code, kind="stable")
            new = np.flatnonzero(np.diff(code[order], prepend=-1))
            for begin, end in zip(new, np.append(new[1:], len(order)), strict=True):
                key = tuple(batch.column(i)[int(order[begin])].as_py() for i in range(len(ks)))
                some = x[order[begin:end]]
                held[key] = held.get(key, 0) + some.T @ some
            if len(held) * p * p * 8 > _HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    kinds = [f.type for f in to_arrow_schema(r.select(*ks).schema)]
    types = dict(r.dtypes)
    g = r.mapInArrow(sums, ", ".join(f"`{k}` {types[k]}" for k in ks) + ", s array<double>")
    g = g.select(*ks, F.posexplode("s").alias("cell", "s")).groupBy(*ks, "cell").agg(F.sum("s").alias("s"))
    at = lambda side: F.element_at(F.array(*[F.lit(names[int(i)]) for i in upper[side]]), F.col("cell") + 1)
    return g.select(*ks, at(0).alias("i"), at(1).alias("j"), "s")


def gram_names(columns: Sequence[str]) -> list[str]:
    return [f"x_{c}" for c in columns] + [f"m_{c}" for c in columns] + ["y", "one"]


def gram_terms(columns: Sequence[str], target: str) -> tuple[list[str], list]:
    names = gram_names(columns)
    terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    terms += [F.col(c).isNull().cast("double") for c in columns]
    return names, [*terms, F.col(target).cast("double"), F.lit(1.0)]


# ---------------------------------------------------------------- elastic net on Gram matrices

L1_RATIOS, N_ALPHAS, ALPHA_SPAN, TURNS, TOLERANCE = (0.1, 0.5, 0.9, 1.0), 50, 1e-2, 200_000, 1e-6
#: Fewer rows than these are not modelled.
MIN_ROWS = 10


def _imputed(s: np.ndarray, p: int, medians: np.ndarray) -> np.ndarray:
    """Sums of products of the columns with nulls at the median, the targets (one or more) and 1, from those with null marks."""
    t = np.eye(len(s))
    t[:p, p : 2 * p] = np.diag(medians)
    s = t @ s @ t.T
    keep = np.r_[0:p, 2 * p : len(s)]
    return s[np.ix_(keep, keep)]


def _scaled(s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(correlations of the standardised columns, with each centred target, means of targets, of columns, sds), from imputed sums."""
    n = s[-1, -1]
    mean, ymean = s[:p, -1] / n, s[p:-1, -1] / n
    cov = s[:p, :p] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = np.inf
    return cov / np.outer(sd, sd), ((s[:p, p:-1] / n - np.outer(mean, ymean)) / sd[:, None]).T, ymean, mean, sd


def coordinate_descent(c: np.ndarray, r: np.ndarray, alpha: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, converged) of many elastic nets with the same columns at once: c (p, p), r (problems, p).

    Each turn goes over the coordinates, for all problems that still move.
    """
    b, done = np.zeros_like(r), np.zeros(len(r), bool)
    live = np.arange(len(r))
    x, g, al, l1 = b.copy(), r.copy(), alpha.copy(), alpha * ratio
    l2 = al - l1
    for _ in range(TURNS):
        worst = np.zeros(len(live))
        for j in np.flatnonzero(np.diag(c) > 0):
            old = x[:, j]
            z = g[:, j] + c[j, j] * old
            new = np.sign(z) * np.maximum(np.abs(z) - l1, 0) / (c[j, j] + l2)
            moved = new - old
            g -= moved[:, None] * c[j]
            x[:, j] = new
            worst = np.maximum(worst, np.abs(moved))
        still = worst >= TOLERANCE
        if not still.all():
            b[live[~still]], done[live[~still]] = x[~still], True
            live, x, g, l1, l2 = live[still], x[still], g[still], l1[still], l2[still]
        if not len(live):
            break
    b[live] = x
    return b, done


def _squared_error(s: np.ndarray, p: int, b: np.ndarray, intercept: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Sum of squared errors of linear predictions (problems, p) of the targets ``which``, from imputed sums."""
    w = np.concatenate([b, intercept[:, None]], axis=1)
    keep = np.r_[0:p, len(s) - 1]
    y = p + which
    return np.einsum("mi,ij,mj->m", w, s[np.ix_(keep, keep)], w, optimize=True) - 2 * np.einsum("mi,im->m", w, s[np.ix_(keep, y)]) + s[y, y]


def elastic_nets(parts: Sequence[np.ndarray], p: int) -> dict[str, np.ndarray]:
    """The elastic net of every target, with its penalty chosen over the parts (imputed sums of the inner folds)."""
    total = np.sum(parts, axis=0)
    c, r, ymean, mean, sd = _scaled(total, p)
    m = len(r)
    tops = np.maximum(np.abs(r).max(axis=1)[:, None] / np.array(L1_RATIOS), 1e-9)
    # problems: targets x ratios x penalties
    alpha = (tops[:, :, None] * np.geomspace(1, ALPHA_SPAN, N_ALPHAS)).ravel()
    ratio = np.tile(np.repeat(L1_RATIOS, N_ALPHAS), m)
    which = np.repeat(np.arange(m), len(L1_RATIOS) * N_ALPHAS)
    loss, stuck = np.zeros(len(alpha)), np.zeros(m, np.int64)
    for part in parts:
        rest = total - part
        if rest[-1, -1] < 2:
            continue
        ci, ri, yi, mi, si = _scaled(rest, p)
        b, ok = coordinate_descent(ci, ri[which], alpha, ratio)
        b = b / si
        loss += _squared_error(part, p, b, yi[which] - b @ mi, which)
        stuck += np.bincount(which[~ok], minlength=m)
    best = loss.reshape(m, -1).argmin(axis=1) + np.arange(m) * len(L1_RATIOS) * N_ALPHAS
    b, ok = coordinate_descent(c, r, alpha[best], ratio[best])
    b = b / sd
    return {"b": b, "intercept": ymean - b @ mean, "alpha": alpha[best], "ratio": ratio[best], "stuck": stuck + ~ok}


def _matrices(pdf: pd.DataFrame, at: dict[str, int], p: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Imputed sums of each inner fold, and the medians, of one outer fold's rows (inner, i, j, s, median)."""
    medians = np.zeros(p)
    cells: dict[int, np.ndarray] = {}
    i, j = pdf["i"].map(at).to_numpy(), pdf["j"].map(at).to_numpy()
    known = (i < p) & pdf["median"].notna().to_numpy()
    medians[i[known]] = pdf["median"].to_numpy()[known]
    for inner, some in pdf.groupby("inner").indices.items():
        g = np.zeros((len(at), len(at)))
        g[i[some], j[some]] = g[j[some], i[some]] = pdf["s"].to_numpy()[some]
        cells[int(inner)] = _imputed(g, p, medians)
    return cells, medians


def _training_sums(grams: DataFrame, medians: DataFrame) -> DataFrame:
    """(out, inner, i, j, s, median): the sums of all rows outside each outer fold, those of all less the fold's own."""
    g = settled(grams.select(F.col("fold").cast("int").alias("fold"), "inner", "i", "j", "s"))
    every = g.groupBy("inner", "i", "j").agg(F.sum("s").alias("all"))
    outs = g.select(F.col("fold").alias("out")).distinct()
    # a small matrix per (outer, inner) fold: this is what a fit needs, whatever the number of rows
    train = every.crossJoin(outs).join(g.withColumnRenamed("fold", "out"), ["out", "inner", "i", "j"], "left").withColumn("s", F.col("all") - F.coalesce("s", F.lit(0.0)))
    m = medians.select(F.col("fold").cast("int").alias("out"), F.concat(F.lit("x_"), F.col("feature")).alias("i"), "median")
    return train.join(m, ["out", "i"], "left").select("out", "inner", "i", "j", "s", "median")


def fit_elastic_nets(grams: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(fold, feature, coefficient, intercept, alpha, l1_ratio, not_converged): the elastic net of each outer fold.

    ``grams``: (fold, inner, i, j, s), ``medians``: (fold, feature, median). The penalty is chosen over the inner
    folds of the other outer folds; a task holds the matrices of one outer fold.
    """
    p = len(columns)
    at = {n: i for i, n in enumerate(gram_terms(columns, "y")[0])}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, _ = _matrices(pdf, at, p)
        f = elastic_nets(list(cells.values()), p)
        return pd.DataFrame({"fold": int(pdf["out"].iloc[0]), "feature": list(columns), "coefficient": f["b"][0], "intercept": f["intercept"][0], "alpha": f["alpha"][0], "l1_ratio": f["ratio"][0], "not_converged": f["stuck"][0]})

    schema = "fold int, feature string, coefficient double, intercept double, alpha double, l1_ratio double, not_converged long"
    return _training_sums(grams, medians).groupBy("out").applyInPandas(fit, schema)


def enough_rows(rows: DataFrame, target: str) -> DataFrame:
    """``rows``, refused if fewer than MIN_ROWS have the target."""
    if len(rows.where(F.col(target).isNotNull()).take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"fewer than {MIN_ROWS} rows with {target}")
    return rows


def cross_validate(rows: DataFrame, columns: Sequence[str], target: str, k: int, seed: int = 0, inner: int = 5, group: str = "group") -> tuple[DataFrame, DataFrame]:
    """(rows with ``fold`` and ``prediction``, fits) of elastic nets under k folds of groups; k = 0 leaves each group out alone."""
    folds = settled(group_folds(enough_rows(rows, target), k, seed, group))
    rows = settled(rows.join(folds, group))
    medians = settled(prepare_folds(rows.where(F.col(target).isNotNull()), columns, folds))
    part = F.pmod(F.crc32(F.col(group).cast("string")), F.lit(inner)).cast("int")
    fits = settled(fit_elastic_nets(gram(rows.withColumn("inner", part), columns, target, ["fold", "inner"]), medians, columns))
    return predict(rows, columns, fits, medians), fits


def permuted_targets(rows: DataFrame, target: str, n: int, seed: int = 0, row_id: str = "id") -> DataFrame:
    """(row_id, ys): for every row with a target, its own and those that n permutations of all rows pair it with.

    Rows are numbered in the order of a hash; permutation p gives place i the target of place (a i + b) mod the number of rows,
    with a coprime to it, so each pairing is one to one and no permutation is sorted by itself.
    """
    r = rows.where(F.col(target).isNotNull()).select(F.col(row_id).alias("__id"), F.col(target).cast("double").alias("__y"))
    r = r.withColumn("__h", F.xxhash64(F.lit(seed), "__id").cast("double")).groupBy("__h").agg(F.collect_list(F.struct("__id", "__y")).alias("__same"), F.count("*").alias("__n"))
    # rows whose hashes are equal as doubles are few, and stand in order of id
    r = running_total(r, [], "__h", "__n", "__to").select(F.col("__to"), "__n", F.posexplode(F.array_sort("__same")).alias("__k", "__row"))
    r = r.select("__row.*", (F.col("__to") - F.col("__n") + F.col("__k")).alias("__i"))
    many = r.count()
    rng = np.random.default_rng(seed)
    steps = []
    while len(steps) < n:
        a, b = int(rng.integers(1, max(many, 2))), int(rng.integers(0, max(many, 1)))
        if math.gcd(a, max(many, 1)) == 1:
            steps.append((a, b))
    # place j = a i + b sends its target to i: the inverse steps, one row per permutation
    to = F.explode(F.array(*[F.struct(F.lit(p + 1).alias("p"), F.lit(pow(a, -1, many) if many > 1 else 0).alias("a"), F.lit(b).alias("b")) for p, (a, b) in enumerate(steps)]))
    wide = F.lit(many).cast("decimal(38,0)")
    place = F.pmod(F.col("t.a").cast("decimal(18,0)") * (F.col("__i") - F.col("t.b")).cast("decimal(19,0)"), wide).cast("long")
    sent = r.select("__i", "__y", to.alias("t")).select(place.alias("__i"), F.col("t.p").alias("p"), "__y")
    ys = sent.groupBy("__i").agg(F.array_sort(F.collect_list(F.struct("p", "__y"))).alias("ys"))
    out = r.join(ys, "__i").select(F.col("__id").alias(row_id), F.concat(F.array("__y"), F.transform("ys", lambda x: x["__y"])).alias("ys"))
    return out


def permutation_null(rows: DataFrame, columns: Sequence[str], target: str, n: int, k: int = 5, seed: int = 0, inner: int = 5, group: str = "group", row_id: str = "id") -> DataFrame:
    """(permutation, score): out-of-fold r2 of the elastic net for the targets as they are (0) and for n permutations.

    All are fitted under the same folds. Sums of products of the columns are those of the first fit; a permutation changes only
    those with the target, which one pass over the rows adds up for all of them. The scores come from sums as well.
    """
    p, count = len(columns), n + 1
    folds = settled(group_folds(enough_rows(rows, target), k, seed, group))
    part = F.pmod(F.crc32(F.col(group).cast("string")), F.lit(inner)).cast("int")
    r = rows.where(F.col(target).isNotNull()).join(folds, group).withColumn("inner", part)
    r = settled(r.join(permuted_targets(rows, target, n, seed, row_id), row_id))
    names, terms = gram_terms(columns, target)
    fixed = settled(gram(r, columns, target, ["fold", "inner"])).where("i <> 'y' AND j <> 'y'")
    x = F.array(*[t for nm, t in zip(names, terms) if nm != "y"])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([[*key, m.ravel()] for key, m in held.items()], columns=["fold", "inner", "s"])

        for pdf in batches:
            for key, some in pdf.groupby(["fold", "inner"]):
                y = np.stack(some["ys"].to_numpy())
                held[key] = held.get(key, 0) + np.concatenate([np.stack(some["x"].to_numpy()).T @ y, (y * y).sum(axis=0, keepdims=True)])
            if len(held) * (2 * p + 2) * count * 8 > _HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    crossed = r.select("fold", "inner", x.alias("x"), "ys").mapInPandas(products, "fold int, inner int, s array<double>")
    crossed = crossed.select("fold", "inner", F.posexplode("s").alias("cell", "s")).groupBy("fold", "inner", "cell").agg(F.sum("s").alias("s"))
    crossed = crossed.groupBy("fold", "inner").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "s"))), lambda c: c["s"]).alias("ys"))  # p x n cells
    order = {nm: i for i, nm in enumerate(nm for nm in names if nm != "y")}
    square = fixed.groupBy("fold", "inner").agg(F.collect_list(F.struct("i", "j", "s")).alias("cells")).join(crossed, ["fold", "inner"])
    medians = prepare_folds(r, columns, folds).groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("medians"))
    # one row of sums per (outer, inner) fold, met by each outer fold: what a fit needs, whatever the number of rows
    outs = medians.select(F.col("fold").alias("out"), "medians")
    met = square.crossJoin(outs)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        med = dict(pdf["medians"].iloc[0])
        medians_ = np.array([med.get(c) if med.get(c) is not None else 0.0 for c in columns])
        train: dict[int, np.ndarray] = {}
        held = 0.0
        size = 2 * p + count + 1
        for fold, own, cells, ys in zip(pdf["fold"], pdf["inner"], pdf["cells"], pdf["ys"]):
            s = np.zeros((size, size))
            xs = np.r_[0 : 2 * p, size - 1]
            for c in cells:
                a, b = xs[order[c["i"]]], xs[order[c["j"]]]
                s[a, b] = s[b, a] = c["s"]
            y = np.asarray(ys).reshape(2 * p + 2, count)
            s[xs, 2 * p : -1] = y[:-1]
            s[2 * p : -1, xs] = y[:-1].T
            s[np.arange(2 * p, size - 1), np.arange(2 * p, size - 1)] = y[-1]
            s = _imputed(s, p, medians_)
            if fold == pdf["out"].iloc[0]:
                held = held + s
            else:
                train[int(own)] = train.get(int(own), 0) + s
        which = np.arange(count)
        empty = pd.DataFrame({"permutation": which, "n": 0.0, "error": 0.0, "sum": 0.0, "squares": 0.0})
        if np.ndim(held) == 0 or not train:
            return empty
        f = elastic_nets(list(train.values()), p)
        error = _squared_error(held, p, f["b"], f["intercept"], which)
        return pd.DataFrame({"permutation": which, "n": held[-1, -1], "error": error, "sum": held[p:-1, -1], "squares": np.diag(held)[p:-1]})

    s = met.groupBy("out").applyInPandas(score, "permutation int, n double, error double, sum double, squares double")
    g = s.groupBy("permutation").agg(*[F.sum(c).alias(c) for c in ("n", "error", "sum", "squares")])
    spread = F.col("squares") - F.col("sum") * F.col("sum") / F.col("n")
    return g.select("permutation", F.when(spread > 0, 1 - F.col("error") / spread).alias("score"))


def predict(rows: DataFrame, columns: Sequence[str], fits: DataFrame, medians: DataFrame) -> DataFrame:
    """rows with ``prediction`` by the fit of their own fold; fits are one short row per fold."""
    f = fits.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", "coefficient"))).alias("__b"), F.first("intercept").alias("__a"))
    m = medians.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("__m"))
    x = rows.join(f.join(m, "fold"), "fold", "left")
    total = F.col("__a")
    for c in columns:
        total = total + F.col("__b")[c] * F.coalesce(F.col(c).cast("double"), F.col("__m")[c], F.lit(0.0))
    return x.withColumn("prediction", total).drop("__a", "__b", "__m")


# ---------------------------------------------------------------- scores and tests


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, most: int = MOST_ROWS) -> DataFrame:
    """Add ranks in which ties share the mean of their places; a null value has none (``ranked``)."""
    return ranked(df, keys, {name: value}, most)


def ranked(df: DataFrame, keys: Sequence[str], values: dict[str, str], most: int = MOST_ROWS) -> DataFrame:
    """Add average ranks of several columns (``values``: {name: column}) within the keys.

    Keys of up to ``most`` rows are dealt once and ranked by windows. Longer ones, and a table without keys, have their values counted
    and the places before a value come from running totals over ranges, so no task holds all rows of a long key.
    """
    ks = list(keys)
    if not ks:
        return _ranked_by_totals(df, ks, values)
    long = settled(df.groupBy(*ks).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*ks))  # rows / most at most
    if long.isEmpty():
        return _ranked_by_windows(df, ks, values)
    few, many = (same_keys(df, F.broadcast(long), ks, how) for how in ("left_anti", "left_semi"))
    return _ranked_by_windows(few, ks, values).unionByName(_ranked_by_totals(many, ks, values))


def _ranked_by_windows(df: DataFrame, ks: list[str], values: dict[str, str]) -> DataFrame:
    for name, value in values.items():
        w = Window.partitionBy(*ks).orderBy(F.col(value).asc_nulls_last())  # nulls come after all places
        last = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        df = df.withColumn(name, F.when(F.col(value).isNotNull(), (F.rank().over(w) + last) / 2))
    return df


def _ranked_by_totals(df: DataFrame, ks: list[str], values: dict[str, str]) -> DataFrame:
    out = df
    for name, value in values.items():
        counts = df.where(F.col(value).isNotNull()).groupBy(*ks, value).agg(F.count("*").alias("__n"))
        counts = running_total(counts, ks, value, "__n", "__upto")
        counts = counts.select(*ks, value, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))
        out = same_keys(out, counts, [*ks, value], "left")
    return out


def out_of_fold_scores(df: DataFrame, keys: Sequence[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(keys, n, r2, mae, spearman) over rows with a prediction; null where a side does not vary."""
    d = df.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    d = ranked(d, keys, {"__rt": truth, "__rp": prediction})
    err = F.col(truth) - F.col(prediction)
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(err * err).alias("__e"), F.var_pop(truth).alias("__v"), F.var_pop(prediction).alias("__p"), F.avg(F.abs(err)).alias("mae"), F.corr("__rt", "__rp").alias("__s"))
    r2 = F.when(F.col("__v") > 0, 1 - F.col("__e") / (F.col("__v") * F.col("n")))
    return g.select(*keys, "n", r2.alias("r2"), "mae", F.when((F.col("__v") > 0) & (F.col("__p") > 0), F.col("__s")).alias("spearman"))


def with_spearman_p(scores: DataFrame) -> DataFrame:
    """Add ``spearman_p`` to rows of ``out_of_fold_scores``: two-sided, uncorrected; null without a correlation or under three rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = correlation_p(pdf["spearman"].to_numpy(float), pdf["n"].to_numpy(float))
            yield pdf.assign(spearman_p=pd.Series(p, index=pdf.index).astype(object).where(~np.isnan(p), None))

    return scores.mapInPandas(add, ", ".join(f"`{c}` {t}" for c, t in scores.dtypes) + ", spearman_p double")


def repeated_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and spread of scores over repeats, and whether their signs disagree."""
    return scores.groupBy(*keys).agg(F.count("*").alias("n_repeats"), F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_sd"), ((F.min("r2") < 0) & (F.max("r2") > 0)).alias("sign_disagrees"))


def signed_rank(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank sums of a - b: (keys, n, w_plus, w_minus, median_difference, ties).

    Zero differences are split: they are ranked, and half of their ranks goes to either side.
    """
    d = df.withColumn("__d", F.col(a) - F.col(b)).where("__d IS NOT NULL").withColumn("__m", F.abs("__d"))
    d = average_ranks(d, keys, "__m", "__r")
    half = F.when(F.col("__d") == 0, F.col("__r") / 2)
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce(half, F.when(F.col("__d") > 0, F.col("__r")), F.lit(0.0))).alias("w_plus"),
        F.sum(F.coalesce(half, F.when(F.col("__d") < 0, F.col("__r")), F.lit(0.0))).alias("w_minus"),
        F.median("__d").alias("median_difference"),
    )
    ties = d.groupBy(*keys, "__m").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return g.join(ties, list(keys)) if keys else g.crossJoin(F.broadcast(ties))  # one row


#: Differences up to which the distribution of the rank sum is counted out.
EXACT_RANKS = 50


def signed_rank_p(tests: DataFrame) -> DataFrame:
    """Add the two-sided p value of signed_rank rows: exact up to EXACT_RANKS differences without ties and zeros, else by the
    normal approximation."""

    def one(n: int, plus: float, minus: float, ties: float) -> float:
        if n <= EXACT_RANKS and not ties and plus == int(plus):  # a zero would leave half a rank
            return signed_rank_exact(int(plus), n)
        sd = math.sqrt(max(n * (n + 1) * (2 * n + 1) / 24 - ties / 48, 0.0))
        return min(1.0, math.erfc((n * (n + 1) / 4 - min(plus, minus)) / sd / math.sqrt(2))) if sd > 0 else 1.0

    def p(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(p_value=[one(*row) for row in zip(pdf["n"], pdf["w_plus"], pdf["w_minus"], pdf["ties"], strict=True)])

    schema = ", ".join(f"{c} {t}" for c, t in tests.dtypes) + ", p_value double"
    return tests.mapInPandas(lambda it: (p(x) for x in it), schema)


def permutation_p(scores: DataFrame, keys: Sequence[str], observed: str = "observed", null: str = "score") -> DataFrame:
    """(keys, n, p_value, null_mean, null_p95) of permutation scores against the observed one: (ge + 1) / (n + 1)."""
    g = scores.groupBy(*keys).agg(F.count(null).alias("n"), F.count(F.when(F.col(null) >= F.col(observed), 1)).alias("__ge"), F.avg(null).alias("null_mean"), F.percentile(null, F.lit(0.95)).alias("null_p95"))
    return g.select(*keys, "n", ((F.col("__ge") + 1) / (F.col("n") + 1)).alias("p_value"), "null_mean", "null_p95")


def holm(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """Add Holm's step-down adjusted p values of one family of tests; null stays null, p outside [0, 1] is refused.

    Equal p values get the same. Ranks and running maxima go over range buckets of p, so no task orders the whole family.
    """
    if tests.where((F.col(p) < 0) | (F.col(p) > 1)).take(1):
        raise ValueError("a p value outside [0, 1]")
    c = tests.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__c"))
    c = running_total(c, [], "__p", "__c", "__upto")
    c = c.crossJoin(F.broadcast(c.agg(F.sum("__c").alias("__all"))))  # one row
    c = c.withColumn("__raw", (F.col("__all") - F.col("__upto") + F.col("__c")) * F.col("__p"))
    tops = c.groupBy("__bucket").agg(F.max("__raw").alias("__top"))  # BUCKETS rows
    tops = tops.select("__bucket", F.max("__top").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    within = F.max("__raw").over(Window.partitionBy("__bucket").orderBy("__p").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("__within", within).join(tops, "__bucket")
    c = c.select("__p", F.least(F.lit(1.0), F.greatest("__within", "__before")).alias("p_holm"))
    return tests.join(c, tests[p] == c["__p"], "left").drop("__p")


#: Folds that a forest is fitted for at most: each is a distributed fit of its own, so leaving groups out one by one is refused.
MOST_FOREST_FOLDS = 20
#: Rows that a task of a forest holds at least: the written table is small, so it would come in one or two partitions whatever the cores.
FOREST_ROWS = 256


def forest_out_of_fold(rows: DataFrame, columns: Sequence[str], target: str, folds: Sequence[int], trees: int = 500, depth: int = 6, seed: int = 0) -> DataFrame:
    """Out-of-fold predictions of a random forest, a distributed fit for each of a few folds (MOST_FOREST_FOLDS; more are refused).

    The source is read once: rows are written with an array of every fold's imputed vector of features, so that fits and predictions of all folds
    read that table and nothing else. Its rows are dealt evenly to the cores; more tasks would only send more sums of nodes, of which each
    task has all.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    folds = list(folds)
    if len(folds) > MOST_FOREST_FOLDS:
        raise ValueError(f"a forest for {len(folds)} folds; at most {MOST_FOREST_FOLDS} are fitted")
    kept = rows.columns
    x = settled(rows.where(F.col(target).isNotNull()).withColumn("__x", F.array(*[F.col(c).cast("double") for c in columns])))
    flat = x.select("fold", *[F.col("__x")[i].alias(c) for i, c in enumerate(columns)])
    grid = rows.sparkSession.createDataFrame([(int(k),) for k in folds], "fold int")
    medians = prepare_folds(flat, columns, grid).select("fold", "feature", "median").collect()  # folds x columns, both bounded
    at = {(r["fold"], r["feature"]): r["median"] for r in medians}
    # an array of vectors, one for each fold in turn
    imputed = F.array(*[F.array(*[F.coalesce(F.col("__x")[i], F.lit(at.get((k, c), 0.0))) for i, c in enumerate(columns)]) for k in folds])
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(x.count() / FOREST_ROWS))
    x = settled(x.withColumn("__all", imputed).drop("__x").repartition(max(1, tasks)))
    out = None
    for place, k in enumerate(folds):
        v = x.withColumn("__v", array_to_vector(F.col("__all")[place]))
        model = RandomForestRegressor(featuresCol="__v", labelCol=target, predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=seed).fit(v.where(F.col("fold") != k))
        got = model.transform(v.where(F.col("fold") == k)).select(*kept, "prediction")
        out = got if out is None else out.unionByName(got)
    return out


# ---------------------------------------------------------------- estimates and result tables

#: Columns that a result table may have: metrics and what they are of, never a prediction or a label.
RESULT_COLUMNS = (
    "target", "variant", "tier", "model", "n", "n_features", "r2", "mae", "spearman", "r2_mean", "r2_sd", "sign_disagrees", "n_repeats", "not_converged",
    "p_value", "null_mean", "null_p95", "p_holm", "test", "left", "right", "median_difference",
)


def result_table(df: DataFrame, columns: Sequence[str] = RESULT_COLUMNS, places: int = 6) -> DataFrame:
    """The columns of ``df``, numbers rounded to ``places``; a column that is not among ``columns`` is refused."""
    if bad := [c for c in df.columns if c not in columns]:
        raise ValueError("no result columns: " + ", ".join(bad))
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def run_estimates(plan: DataFrame, fit: Callable[[dict], DataFrame], most_scores: int = 100) -> tuple[DataFrame, DataFrame]:
    """(results, outcomes) of planned estimates by models that are jobs of their own: each by ``fit``, which gives a handful of score
    rows (more than ``most_scores`` is a failure). Models that rest on sums of products are fitted together (``estimates.run_plan``).

    A plan (target, variant, tier, model, status) is configuration, so the driver goes through it. An estimate that fails is
    noted and the others go on. Outcomes have (target, variant, tier, model, status, message), status ok, failed or skipped.
    """
    spark = plan.sparkSession
    results, notes = None, []
    for row in plan.collect():
        e = row.asDict()
        key = [e[k] for k in ("target", "variant", "tier", "model")]
        if e["status"] != "planned":
            notes.append((*key, e["status"], None))
            continue
        try:
            scores = fit(e)
            few = scores.limit(most_scores + 1).collect()
            if len(few) > most_scores:
                raise ValueError(f"more than {most_scores} score rows")
            got = spark.createDataFrame(few, scores.schema)
        except Exception as problem:  # noqa: BLE001 - whatever it is, it is on record
            notes.append((*key, "failed", f"{type(problem).__name__}: {problem}".splitlines()[0][:300]))
            continue
        notes.append((*key, "ok", None))
        got = got.select(*[F.lit(v).alias(k) for k, v in zip(("target", "variant", "tier", "model"), key)], *[c for c in got.columns if c not in ("target", "variant", "tier", "model")])
        results = got if results is None else results.unionByName(got, allowMissingColumns=True)
    outcomes = spark.createDataFrame(notes, "target string, variant string, tier string, model string, status string, message string")
    empty = spark.createDataFrame([], "target string, variant string, tier string, model string")
    return (empty if results is None else result_table(results)), outcomes


def estimate_counts(outcomes: DataFrame) -> DataFrame:
    """(tier, status, n) of estimates."""
    return outcomes.groupBy("tier", "status").agg(F.count("*").alias("n"))


def composition(tiers: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, tier, n): features by where they come from (``sources``: family, source; 'unknown' where none says) and tier."""
    s = F.coalesce("source", F.lit("unknown")).alias("source")
    return tiers.join(sources.select("family", "source").distinct(), "family", "left").groupBy(s, "tier").agg(F.count_distinct("name").alias("n"))
