"""Operator 2: mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table, text_or_empty

#: Hash buckets of one source, and finish-time buckets per unit of virtual time.
BUCKETS = 4096
#: One word with what follows it; used to count words in one pass.
_ONE_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
_LEADING = r"^[\x20\x09-\x0D]+"


def word_count(col: str | Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    text = F.regexp_replace(text_or_empty(col), _LEADING, "")
    return F.length(F.regexp_replace(text, _ONE_WORD, "x")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target of each source: ``share`` of all words dealt by weight, none above ``most`` times its size.

    ``sizes``: (source, source_size), one row per source. The level at which the capped shares add up to the
    budget is found in closed form: sources in ascending order of cap / weight are capped until the level that
    the others need is under the next one's ratio. Sources are a dimension, not rows of the corpus; the
    windows over all of them see one short row each.
    """
    every, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("place", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    # the level to use is the first that its own source's ratio covers
    s = s.withColumn("chosen", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every))
    target = F.when(F.col("chosen").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("chosen.level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"), "budget")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, epochs).

    Sources in code-point order (null last) get the weights in turn. Documents of a source stand in a shuffled
    order (a hash of seed and id; ties by id and size) and pass as often as ``most`` allows; each passing
    entry has the virtual finish time *words of its source so far / target of the source*. Entries are taken
    in the order of finish time while they fit into the budget, so every source reaches its target at time 1.

    Running sums are two-level (sums of hash or time buckets, then within one bucket), so a source holding a
    third of all rows is spread over thousands of groups. Null texts have size 0; empty documents and sources
    take 0; rows that repeat stand as entries of their own; an empty table gives no rows.
    """
    passes = int(-(-most // 1))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("turn"),
    )
    narrow = narrow.withColumn("bucket", (F.conv(F.substring("turn", 1, 3), 16, 10).cast("int") % BUCKETS))
    narrow = materialise(narrow, "mix")
    buckets = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    plan = source_targets(sizes, weights, share, most)
    starts = buckets.alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source"))
    starts = materialise(starts.select("b.source", "b.bucket", "b.before", "p.source_size", "p.target", "p.budget"), "starts")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = narrow.withColumn("upto", F.sum("size").over(inside)).withColumn("place", F.row_number().over(inside)).alias("d")
    rows = rows.join(starts.alias("s"), F.expr("d.source <=> s.source AND d.bucket = s.bucket"))
    rows = rows.select(
        "d.source", "d.bucket", "d.place", "d.doc_id", "d.size", "d.turn", "s.source_size", "s.target", "s.budget", (F.col("upto") + F.col("before")).alias("upto")
    )
    rows = materialise(rows, "placed")  # read twice from here on, and its plan is long
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target"))
    entries = rows.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)])))
    entries = entries.withColumn("finish", finish)
    entries = entries.withColumn("slot", F.floor(F.least(F.col("finish"), F.lit(passes * 2.0)) * BUCKETS).cast("long"))
    # time slots are few whatever the corpus: passes * 2 * BUCKETS + 1 rows at most
    slots = entries.where("size > 0 AND slot IS NOT NULL").groupBy("slot").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    slots = slots.withColumn("upto", F.sum("words").over(Window.orderBy("slot")))
    slots = slots.select("slot", (F.col("upto") <= F.col("budget")).alias("whole"), (F.col("upto") - F.col("words")).alias("before"))
    cut = slots.where("NOT whole").agg(F.min("slot").alias("cut"), F.min_by("before", "slot").alias("cut_before")).first()
    entries = entries.withColumns({c: F.lit(cut[c]).cast("long") for c in ("cut", "cut_before")})
    at_cut = Window.partitionBy("slot").orderBy("finish", "turn", "doc_id", "size", "pass").rowsBetween(Window.unboundedPreceding, 0)
    boundary = entries.where("slot = cut AND size > 0").withColumn("taken", F.sum("size").over(at_cut) + F.col("cut_before") <= F.col("budget"))
    rest = entries.where("NOT coalesce(slot = cut AND size > 0, false)")
    rest = rest.withColumn("taken", F.coalesce((F.col("size") > 0) & (F.col("slot") < F.coalesce("cut", F.lit(2**62))), F.lit(False)))
    marked = boundary.unionByName(rest)
    out = marked.groupBy("source", "bucket", "place").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum(F.col("taken").cast("long")).alias("epochs")
    )
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][CAST((place - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s2),
s4 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
lv AS (SELECT level FROM s4 WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
s5 AS (SELECT source, source_size, budget, least(cap, coalesce((SELECT level FROM lv) * weight, cap)) AS target FROM s4),
e AS (
  SELECT d.doc_id, d.size, d.turn, s5.source_size, s5.target, s5.budget, p.pass,
         (sum(d.size) OVER (PARTITION BY d.source, p.pass ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
          + p.pass * s5.source_size) / nullif(s5.target, 0) AS finish
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source CROSS JOIN (SELECT unnest([0, 1]) AS pass) p),
t AS (
  SELECT *, coalesce(size > 0 AND sum(size) OVER (ORDER BY finish NULLS LAST, turn, doc_id, size, pass ROWS UNBOUNDED PRECEDING) <= budget, false) AS got
  FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN got THEN size ELSE 0 END) AS BIGINT) AS taken,
       CAST(sum(CASE WHEN got THEN 1 ELSE 0 END) AS BIGINT) AS epochs
FROM t GROUP BY doc_id, size, source_size, target, turn
"""

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE_SQL = {"op2_mix_sources": OP2_SQL}
