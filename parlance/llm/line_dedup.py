"""Operator 3: line dedup by overlapping windows of three lines (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, quoted, spread_join, table, text_or_empty, written


def repeated_windows(lines: DataFrame, window: int) -> DataFrame:
    """(id, version, drop): original line numbers covered by windows that are not the first of their kind.

    ``lines``: (id, version, full), full = array of (t, i), the trimmed non-blank lines with their numbers.
    """
    w = lines.where(F.size("full") >= window).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("full") - (window - 1))))
    texts = [F.expr(f"full[at + {k - 1}].t") for k in range(window)]
    w = w.select(
        "id",
        "version",
        F.xxhash64(F.lit(1), *texts).alias("h1"),
        F.xxhash64(F.lit(2), *texts).alias("h2"),
        F.array(*[F.expr(f"full[at + {k - 1}].i") for k in range(window)]).alias("covers"),
    )
    return w


def line_dedup(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove later occurrences of any run of ``window`` lines that occurs before, across the whole table.

    Lines are split at line feeds and compared without white space at their ends; blank lines are kept and
    stand in no window. The first occurrence is that with the smallest (id, line). All lines covered by a
    later one go, overlapping windows merging; what is left is joined with line feeds. Returns all columns of
    ``docs`` with the new text, and ``__lines`` and ``__removed``, the numbers of lines before and removed; where
    ``docs`` has such a column, that of the counts has more underscores (``free_name``).

    Documents of fewer lines than a window stay as they are, as does a null text (with 0 lines); a very long text
    is one row of lines. Rows that share an id are versions of one document: the smallest line number is the
    first for all of them, so equal rows come out equal. A null id comes first. Windows of which there are very
    many are dealt to several tasks. An empty table gives an empty table.
    """
    columns = docs.columns
    base = docs.select(
        F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns) if c != text_col]).alias("others"),
        F.col(quoted(id_col)).alias("id"),
        F.xxhash64(text_or_empty(F.col(quoted(text_col)))).alias("version"),
        F.split(F.col(quoted(text_col)), "\n", -1).alias("lines"),
    )
    trimmed = F.transform("lines", lambda x, i: F.struct(F.regexp_replace(x, r"^\s+|\s+$", "").alias("t"), i.alias("i")))
    full = base.select("id", "version", F.filter(trimmed, lambda x: x["t"] != "").alias("full"))
    w = repeated_windows(full, window)
    # one first occurrence per run, found by a map-side combined aggregation
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("id", "covers")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first, seen = written(first, "windows", "n")
    later = spread_join(w, first, ["h1", "h2"], ["id", "covers"], seen=seen).where("NOT (struct(id, covers) <=> first)")
    covered = later.groupBy("id", "version").agg(F.collect_set("covers").alias("covers"))
    drop = F.array_distinct(F.flatten("covers"))
    covered = covered.select(F.col("id").alias("cid"), F.col("version").alias("cversion"), drop.alias("drop"))
    both = base.join(covered, F.expr("id <=> cid AND version = cversion"), "left")
    all_lines = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1))
    kept = F.transform(F.array_except(all_lines, "drop"), lambda i: F.element_at("lines", i + 1))
    text = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return both.select(
        *[(text if c == text_col else F.col(f"others.c{i}")).alias(c) for i, c in enumerate(columns)],
        F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias(free_name("__lines", columns)),
        F.greatest(F.coalesce(F.size("drop"), F.lit(0)), F.lit(0)).cast("long").alias(free_name("__removed", columns)),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3
      FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, i) AS occurrence FROM f WHERE t3 IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM r WHERE occurrence > 1),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS text, count(*) AS n_lines, count(c.i) AS n_removed
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {"op3_line_dedup": OP3_SQL}
