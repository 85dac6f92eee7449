"""Queries of model evaluation, over documents with labels, and of the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import estimates as es
from ..operators import evaluate as ev
from ..streaming import streams as sm
from . import adapters as ad
from .stat_queries import rounded
from .table_queries import _NAMES_SQL, _names

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COLUMNS = ["n_words", "n_lines", "n_thousand", "n_upper"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_ROWS_SQL = """
d AS (SELECT doc_id AS id, source AS "group", len(string_split(text, ' ')) AS n_words, CASE WHEN doc_id % 9 > 0 THEN len(string_split(text, chr(10))) END AS n_lines, n_chars / 1000 AS n_thousand,
  CASE WHEN doc_id % 4 > 0 THEN length(regexp_replace(text, '[^A-Z]', '', 'g')) END AS n_upper, quality + toxic * 2 + n_chars % 7 AS y FROM documents JOIN labels USING (doc_id)),
h AS (SELECT "group", row_number() OVER (ORDER BY md5('0:' || "group"), "group") - 1 AS k FROM (SELECT DISTINCT "group" FROM d)),
folds AS (SELECT "group", CAST(k % 5 AS INT) AS fold FROM h), rows AS (SELECT d.*, fold FROM d JOIN folds USING ("group"))"""


def _documents(spark, sf):
    d = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        k.alias("id"),
        F.col("source").alias("group"),
        F.size(F.split("text", " ", -1)).alias("n_words"),
        F.when(k % 9 > 0, F.size(F.split("text", "\n", -1))).alias("n_lines"),
        (F.col("n_chars") / 1000).alias("n_thousand"),
        F.when(k % 4 > 0, F.length(F.regexp_replace("text", "[^A-Z]", ""))).alias("n_upper"),
        (F.col("quality") + F.col("toxic") * 2 + F.col("n_chars") % 7).alias("y"),
    )


def _folded(spark, sf):
    d = _documents(spark, sf)
    folds = ev.group_folds(d, 5)
    return d.join(folds, "group"), folds


@query(
    "tier_plan",
    "WITH " + _NAMES_SQL
    + """ SELECT name, string_split(name, '__')[1] AS family, CASE WHEN name IN ('economy__x', 'standard__y') THEN 'confirmatory' WHEN string_split(name, '__')[1] IN ('economy', 'large') THEN 'exploratory' ELSE 'awaiting' END AS tier FROM n
UNION ALL SELECT m, string_split(m, '__')[1], 'missing' FROM (SELECT unnest(['economy__x', 'standard__y']) AS m) WHERE m NOT IN (SELECT name FROM n)""",
)
def tier_plan(spark, sf):
    return ev.tier_plan(_names(spark, sf), ["economy__x", "standard__y"], ["economy", "large"])


_TARGETS_SQL = "t AS (SELECT o_orderpriority AS target, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_custkey > 9999999) + CASE WHEN o_orderpriority < '4' THEN count(*) ELSE 0 END AS n_known FROM orders GROUP BY 1)"


def _targets(spark, sf):
    o = ad.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("target"))
    return o.agg(F.count(F.when(F.col("o_orderpriority") < "4", 1)).alias("n_known"))


VARIANTS = [("all", "confirmatory"), ("turn", "confirmatory"), ("face", "exploratory")]


@query(
    "estimate_plan",
    "WITH " + _TARGETS_SQL
    + """ SELECT target, v.variant, v.tier, m AS model, CASE WHEN n_known > 0 THEN 'planned' ELSE 'skipped' END AS status FROM t, (VALUES ('all', 'confirmatory'), ('turn', 'confirmatory'), ('face', 'exploratory')) v(variant, tier), (SELECT unnest(['net', 'forest']) AS m)""",
)
def estimate_plan(spark, sf):
    return ev.estimate_plan(_targets(spark, sf), VARIANTS, ["net", "forest"])


@query(
    "comparison_plan",
    "WITH " + _TARGETS_SQL
    + """ SELECT c.test, target, c."left", c."right", CASE WHEN c."right" = 'face' THEN 'missing' ELSE 'planned' END AS status FROM t, (VALUES ('c1', 'all', 'turn'), ('c2', 'all', 'face')) c(test, "left", "right") WHERE n_known > 0""",
)
def comparison_plan(spark, sf):
    e = ev.estimate_plan(_targets(spark, sf), VARIANTS, ["net", "forest"]).where("status = 'planned'")
    plan = spark.createDataFrame([("c1", "all", "turn"), ("c2", "all", "face")], "test string, left string, right string")
    return ev.comparison_plan(e, plan)


@query("group_folds", "WITH " + _ROWS_SQL + ' SELECT "group", fold FROM folds')
def group_folds(spark, sf):
    return _folded(spark, sf)[1]


@query(
    "fold_prep",
    "WITH " + _ROWS_SQL
    + """, l AS (UNPIVOT (SELECT fold, coalesce(CAST(n_words AS DOUBLE), -1e9) AS n_words, coalesce(CAST(n_lines AS DOUBLE), -1e9) AS n_lines, coalesce(CAST(n_thousand AS DOUBLE), -1e9) AS n_thousand, coalesce(CAST(n_upper AS DOUBLE), -1e9) AS n_upper FROM rows)
  ON n_words, n_lines, n_thousand, n_upper INTO NAME feature VALUE v),
x AS (SELECT f.fold, l.feature, nullif(v, -1e9) AS v FROM l JOIN (SELECT DISTINCT fold FROM folds) f ON f.fold <> l.fold), m AS (SELECT fold, feature, median(v) AS med FROM x GROUP BY 1, 2)
SELECT fold, feature, med AS median, round(avg(coalesce(v, med)), 6) AS mean, round(stddev_pop(coalesce(v, med)), 6) AS sd FROM x JOIN m USING (fold, feature) GROUP BY 1, 2, 3""",
)
def fold_prep(spark, sf):
    rows, folds = _folded(spark, sf)
    return rounded(ev.prepare_folds(rows, COLUMNS, folds), "median")


_TERMS = {f"x_{c}": f"coalesce(CAST({c} AS DOUBLE), 0)" for c in COLUMNS} | {f"m_{c}": f"CAST({c} IS NULL AS DOUBLE)" for c in COLUMNS} | {"y": "CAST(y AS DOUBLE)", "one": "1.0"}
_NAMES_ = list(_TERMS)


@query(
    "gram",
    "WITH " + _ROWS_SQL
    + ", g AS (SELECT fold, "
    + ", ".join(f'sum({_TERMS[a]} * {_TERMS[b]}) AS "{a}|{b}"' for i, a in enumerate(_NAMES_) for b in _NAMES_[i:])
    + """ FROM rows WHERE y IS NOT NULL GROUP BY 1), u AS (UNPIVOT g ON * EXCLUDE (fold) INTO NAME cell VALUE s)
SELECT fold, string_split(cell, '|')[1] AS i, string_split(cell, '|')[2] AS j, round(s, 7) AS s FROM u""",
)
def gram(spark, sf):
    return rounded(ev.gram(_folded(spark, sf)[0], COLUMNS, "y"), places=7)


@query("elastic_net")
def elastic_net(spark, sf):
    return ev.cross_validate(_documents(spark, sf), COLUMNS, "y", 5)[1]


@query("elastic_net_scores")
def elastic_net_scores(spark, sf):
    p, _ = ev.cross_validate(_documents(spark, sf), COLUMNS, "y", 5)
    return ev.out_of_fold_scores(p.withColumn("model", F.lit("net")), ["model"], "y", "prediction")


@query("leave_one_out")
def leave_one_out(spark, sf):
    """Every group left out alone."""
    p, _ = ev.cross_validate(_documents(spark, sf), COLUMNS, "y", 0)
    return ev.out_of_fold_scores(p.withColumn("model", F.lit("net")), ["model"], "y", "prediction")


@query("repeated_folds")
def repeated_folds(spark, sf):
    """The elastic net under three seeds of five folds."""
    got = es.scheme_scores(_documents(spark, sf), COLUMNS, "y", 5, 3, alone=False)
    return got.select("model", "n_repeats", "r2_mean", "r2_sd", "sign_disagrees")


@query("stability")
def stability(spark, sf):
    """Leave-one-group-out beside three repeats of five folds, from one pass over the rows."""
    return es.scheme_scores(_documents(spark, sf), COLUMNS, "y", 5, 3)


@query("forest_scores")
def forest_scores(spark, sf):
    rows, _ = _folded(spark, sf)
    p = ev.forest_out_of_fold(rows.withColumn("y", F.col("y").cast("double")), COLUMNS, "y", range(5)).withColumn("model", F.lit("forest"))
    return ev.out_of_fold_scores(p, ["model"], "y", "prediction")


def _wide_documents(spark, sf):
    """54 columns of documents: how often each of as many byte sequences stands in the text."""
    d = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels"), "doc_id")
    marks = [chr(97 + i) for i in range(26)] + [a + b for a, b in zip("thenarsoitelnd" * 2, "henarsoitelndt" * 2)]
    counted = [((F.length("text") - F.length(F.replace(F.col("text"), F.lit(m), F.lit("")))) / len(m)).alias(f"c{i}") for i, m in enumerate(marks)]
    return d.select(F.col("source").alias("group"), F.col("quality").alias("y"), *counted), marks


_MARKS = [chr(97 + i) for i in range(26)] + [a + b for a, b in zip("thenarsoitelnd" * 2, "henarsoitelndt" * 2)]


@query(
    "gram_wide",
    "WITH d AS (SELECT source AS \"group\", quality AS y, "
    + ", ".join(f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)} AS c{i}" for i, m in enumerate(_MARKS))
    + """ FROM documents JOIN labels USING (doc_id)), r AS (SELECT row_number() OVER () AS r, * FROM d),
u AS (UNPIVOT (SELECT r, "group", CAST(y AS DOUBLE) AS y, 1.0::DOUBLE AS one, """
    + ", ".join(f"CAST(c{i} AS DOUBLE) AS x_c{i}" for i in range(54))
    + """ FROM r) ON * EXCLUDE (r, "group") INTO NAME k VALUE v)
SELECT a."group", a.k AS i, b.k AS j, CAST(sum(a.v * b.v) AS BIGINT) AS s FROM u a JOIN u b ON a.r = b.r
WHERE a.k <= b.k GROUP BY 1, 2, 3""",
)
def gram_wide(spark, sf):
    """Whole numbers only, so that sums are exact; the marks of nulls, of which there are none, are left out."""
    d, marks = _wide_documents(spark, sf)
    g = ev.gram(d, [f"c{i}" for i in range(len(marks))], "y", ["group"]).where("NOT (i LIKE 'm%' OR j LIKE 'm%')")
    return g.select("group", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.round("s").cast("long").alias("s"))


@query(
    "result_rows",
    """WITH q AS (SELECT l_suppkey, l_extendedprice AS truth, l_quantity * 1500 AS prediction FROM lineitem WHERE l_linenumber % 7 > 0)
SELECT CAST(l_suppkey AS VARCHAR) AS target, count(*) AS n, round(1 - sum((truth - prediction) * (truth - prediction)) / (var_pop(truth) * count(*)), 6) AS r2, round(avg(abs(truth - prediction)), 6) AS mae FROM q GROUP BY 1""",
)
def result_rows(spark, sf):
    """The result table of every supplier: only columns that a result may have, rounded to six places."""
    li = ad.table(spark, sf, "lineitem")
    p = li.select(F.col("l_suppkey").cast("string").alias("target"), F.col("l_extendedprice").alias("truth"), F.when(F.col("l_linenumber") % 7 > 0, F.col("l_quantity") * 1500).alias("prediction"))
    return ev.result_table(ev.out_of_fold_scores(p, ["target"]).select("target", "n", "r2", "mae"))


@query("oof_p")
def oof_p(spark, sf):
    """The scores of every supplier with the p value of the rank correlation."""
    li = ad.table(spark, sf, "lineitem")
    p = li.select("l_suppkey", F.col("l_extendedprice").alias("truth"), F.when(F.col("l_linenumber") % 7 > 0, F.col("l_quantity") * 1500).alias("prediction"))
    return ev.with_spearman_p(ev.out_of_fold_scores(p, ["l_suppkey"]))


@query(
    "oof_scores",
    """WITH p AS (SELECT l_suppkey, l_extendedprice AS truth, CASE WHEN l_linenumber % 7 > 0 THEN l_quantity * 1500 END AS prediction FROM lineitem), q AS (SELECT * FROM p WHERE prediction IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY truth) + (count(*) OVER (PARTITION BY l_suppkey, truth) - 1) / 2 AS rt, rank() OVER (PARTITION BY l_suppkey ORDER BY prediction) + (count(*) OVER (PARTITION BY l_suppkey, prediction) - 1) / 2 AS rp FROM q)
SELECT l_suppkey, count(*) AS n, round(1 - sum((truth - prediction) * (truth - prediction)) / (var_pop(truth) * count(*)), 6) AS r2, round(avg(abs(truth - prediction)), 6) AS mae, round(corr(rt, rp), 6) AS spearman FROM r GROUP BY 1""",
)
def oof_scores(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    p = li.select("l_suppkey", F.col("l_extendedprice").alias("truth"), F.when(F.col("l_linenumber") % 7 > 0, F.col("l_quantity") * 1500).alias("prediction"))
    return rounded(ev.out_of_fold_scores(p, ["l_suppkey"]))


_SIGNED_SQL = """WITH p AS (SELECT l_suppkey, round(l_extendedprice / 1500) - l_quantity AS d FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2 AS r FROM p),
t AS (SELECT l_suppkey, sum(c * c * c - c) AS ties FROM (SELECT l_suppkey, abs(d), count(*) AS c FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT l_suppkey, count(*) AS n, sum(CASE WHEN d = 0 THEN r / 2 WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d = 0 THEN r / 2 WHEN d < 0 THEN r ELSE 0 END) AS w_minus, median(d) AS median_difference, CAST(any_value(ties) AS BIGINT) AS ties FROM r JOIN t USING (l_suppkey) GROUP BY 1"""


def _signed(spark, sf):
    li = ad.table(spark, sf, "lineitem").select("l_suppkey", F.round(F.col("l_extendedprice") / 1500).alias("a"), F.col("l_quantity").alias("b"))
    return ev.signed_rank(li, ["l_suppkey"], "a", "b")


@query("signed_rank", _SIGNED_SQL)
def signed_rank(spark, sf):
    return _signed(spark, sf)


@query("signed_rank_p")
def signed_rank_p(spark, sf):
    return ev.signed_rank_p(_signed(spark, sf))


@query(
    "perm_p",
    """WITH s AS (SELECT l_suppkey, l_extendedprice AS score, max(l_quantity) OVER (PARTITION BY l_suppkey) * 1700 AS observed FROM lineitem)
SELECT l_suppkey, count(*) AS n, round((count(*) FILTER (WHERE score >= observed) + 1) / (count(*) + 1), 6) AS p_value, round(avg(score), 6) AS null_mean, round(quantile_cont(score, 0.95), 6) AS null_p95 FROM s GROUP BY 1""",
)
def perm_p(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    top = li.groupBy("l_suppkey").agg((F.max("l_quantity") * 1700).alias("observed"))
    s = li.select("l_suppkey", F.col("l_extendedprice").alias("score")).join(top, "l_suppkey")
    return rounded(ev.permutation_p(s, ["l_suppkey"]))


@query("permutation_null")
def permutation_null(spark, sf):
    s = ev.permutation_null(_documents(spark, sf), COLUMNS, "y", 50).withColumn("model", F.lit("net"))
    observed = s.where("permutation = 0").select(F.col("score").alias("observed"))
    return ev.permutation_p(s.where("permutation > 0").crossJoin(F.broadcast(observed)), ["model"])  # one row


def _planned(spark, sf):
    """Two targets, one of which no row has, three variants, one of a column that is not there, and two models, one unknown."""
    targets = spark.createDataFrame([("y", 1), ("long", 1), ("none", 0)], "target string, n_known long")
    plan = ev.estimate_plan(targets, [("all", "confirmatory"), ("words", "confirmatory"), ("absent", "exploratory")], ["net", "unknown"])
    rows = _documents(spark, sf).withColumn("long", F.when(F.col("id") % 5 > 0, F.log1p("n_thousand")))
    return es.run_plan(rows, plan, {"all": COLUMNS, "words": ["n_words", "n_upper"], "absent": ["nothing"]})


@query("estimates")
def estimates(spark, sf):
    """Every planned estimate with its outcome and scores, all in one set of sums and fits."""
    results, outcomes, _ = _planned(spark, sf)
    return outcomes.join(results, ["target", "variant", "tier", "model"], "left")


@query("model_comparison")
def model_comparison(spark, sf):
    """The variants of each target compared by their paired out-of-fold errors, corrected as one family."""
    _, _, errors = _planned(spark, sf)
    plan = spark.createDataFrame([("c1", "y", "all", "words"), ("c1", "long", "all", "words"), ("c2", "y", "all", "absent")], "test string, target string, left string, right string")
    return es.compare_models(errors, plan)


@query(
    "composition",
    "WITH " + _NAMES_SQL
    + """, t AS (SELECT name, string_split(name, '__')[1] AS family FROM n), p AS (SELECT DISTINCT lower(p_type) AS family, any_value(p_brand) AS b, min(p_brand) AS source FROM part GROUP BY 1)
SELECT coalesce(source, 'unknown') AS source, CASE WHEN t.family IN ('economy', 'large') THEN 'exploratory' ELSE 'awaiting' END AS tier, count(DISTINCT name) AS n FROM t LEFT JOIN p USING (family) GROUP BY 1, 2""",
)
def composition(spark, sf):
    sources = ad.table(spark, sf, "part").groupBy(F.lower("p_type").alias("family")).agg(F.min("p_brand").alias("source"))
    return ev.composition(ev.tier_plan(_names(spark, sf), [], ["economy", "large"]), sources)


@query(
    "holm",
    """WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 > 0 THEN abs(s_acctbal) / 20000 / (1 + s_nationkey * 40) END AS p_value FROM supplier), k AS (SELECT * FROM p WHERE p_value IS NOT NULL),
h AS (SELECT s_suppkey, p_value, (count(*) OVER () - row_number() OVER (ORDER BY p_value, s_suppkey) + 1) * p_value AS raw FROM k)
SELECT s_suppkey, round(p_value, 9) AS p_value, round(least(1, max(raw) OVER (ORDER BY p_value, s_suppkey ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM h UNION ALL SELECT s_suppkey, NULL, NULL FROM p WHERE p_value IS NULL""",
)
def holm(spark, sf):
    p = F.when(F.col("s_suppkey") % 10 > 0, F.abs("s_acctbal") / 20000 / (1 + F.col("s_nationkey") * 40))
    return rounded(ev.holm(ad.table(spark, sf, "supplier").select("s_suppkey", p.alias("p_value"))), places=9)


# ---------------------------------------------------------------- streaming


def _stream(spark, sf, name):
    """A table of the test data as a file stream."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def _drained(spark, df, mode: str):
    name = f"s{uuid.uuid4().hex}"
    sm.run_available(df, ad.scratch(spark), name, mode)
    return spark.table(name)


@query("stream_channel_stats", "WITH " + ad.CHANNELS_SQL + """ SELECT session_id, count(*) AS n, round(sqrt(avg("left" * "left")), 6) AS rms_left, round(max(abs("right")), 8) AS peak_right, bool_and("left" = "right") AS identical FROM channels GROUP BY 1""")
def stream_channel_stats(spark, sf):
    li = _stream(spark, sf, "lineitem")
    s = li.select(F.col("l_suppkey").alias("session_id"), (F.col("l_quantity") / 50).alias("left"), (F.col("l_extendedprice") / 100000).alias("right"))
    out = _drained(spark, sm.stream_channel_stats(s, ["session_id"], 0.3), "complete")
    return out.select("session_id", "n", F.round("rms_left", 6).alias("rms_left"), F.round("peak_right", 8).alias("peak_right"), "identical")


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), o AS (SELECT *, CASE WHEN t - lag(t) OVER w < 14400000000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(t) AS start_us, max(t) + 14400000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf):
    """Sessions of all events: the stream ends with a row of nobody's that is later than any."""
    e = _stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    late = ad.table(spark, sf, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    last = late.select(F.lit(None).cast(e.schema["user_id"].dataType).alias("user_id"), "ts")
    s = sm.run_to_the_end(lambda rows: sm.stream_sessions(rows, "ts", "4 hours", "1 day", ["user_id"]), e, last, ad.scratch(spark))
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("stream_upsert", "SELECT o_custkey AS session_id, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY 1")
def stream_upsert(spark, sf):
    """Orders carried forward by micro-batch, keyed by order, then counted."""
    path = ad.scratch(spark)
    o = _stream(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), "o_orderkey")
    q = o.writeStream.foreachBatch(sm.upsert_batches(path, ["session_id", "o_orderkey"])).option("checkpointLocation", ad.scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sm.read_upserted(spark, path).groupBy("session_id").agg(F.count("*").alias("n"))


@query("stream_upsert_newest", "SELECT o_custkey AS session_id, max(o_orderkey) AS sequence, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def stream_upsert_newest(spark, sf):
    """The newest order of every customer, by its number, whatever the order of rows and batches."""
    path = ad.scratch(spark)
    o = _stream(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("sequence"), F.col("o_totalprice").alias("price"))
    q = o.writeStream.foreachBatch(sm.upsert_batches(path, order="sequence")).option("checkpointLocation", ad.scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return sm.read_upserted(spark, path)
