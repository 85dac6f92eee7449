"""Operator 9: secret scans over an incremental blob ledger (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread_join, table, text_or_empty


class Rule(NamedTuple):
    """A kind of secret: ``group`` of a match must have ``least`` characters or more."""

    kind: str
    version: str
    pattern: str
    group: int
    least: int


#: Base rules, in the order in which spans at the same place are listed. Fixed values.
BASE_RULES = (
    Rule("assign", "1", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "1", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules that add spans to the base ones.
MORE_RULES = (
    Rule("private_key", "1", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    Rule("forge_token", "1", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("web_token", "1", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
#: A span in code points, with the rule and version that found it; rank is the place of the rule.
_SPAN = "array<struct<start:int,rank:int,kind:string,version:string,end:int>>"
#: Hits of a text that are numbered together: running sums go over blocks and then within them.
BLOCK = 256


def _matches(rule: Rule) -> Column:
    return F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(rule: Rule, rank: int, matches: Column) -> Column:
    """Spans, in code points, of a rule's matches: what lies between them comes from a split at the same pattern."""
    pieces = F.split("text", rule.pattern, -1)
    parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("gap"), matches.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        value = x["hit"] if rule.group == 0 else F.regexp_extract(x["hit"], rule.pattern, rule.group)
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), end.alias("end")))
        kept = F.when(F.length(value) >= rule.least, F.concat(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    def within(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), F.array().cast(_SPAN).alias("found"))
        return F.aggregate(block["parts"], start, step, lambda acc: acc["found"])

    def numbered(blocks: Column) -> Column:
        size = lambda acc, x: acc + F.length(x["gap"]) + F.length(x["hit"])
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), size))
        running = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        starts = F.aggregate(sizes, F.array(F.lit(0)), running)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("parts"), F.slice(starts, F.lit(1), F.size(blocks)).alias("at")), within))

    return _let(parts, lambda p: _let(_blocks(p), numbered))


def _blocks(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(parts) / BLOCK).cast("int") - 1), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))


def blob_id(col: str | Column) -> Column:
    """Content address: SHA-256 of the text, null as the empty text."""
    return F.sha2(text_or_empty(col), 256)


def blob_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text, copies): every different text once, written to the shared folder. Copies fall away on the map side."""
    text = F.col(f"`{text_col}`").cast("string")
    blobs = docs.select(blob_id(text).alias("blob"), text_or_empty(text).alias("text"))
    return materialise(blobs.groupBy("blob").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "blobs")


def _name(kind: Column | str, version: Column | str) -> Column:
    return F.concat_ws("@", kind, version)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the (blob, rule version) pairs that the ledger does not have.

    ``blobs``: (blob, text), one row per blob. ``ledger``: (blob, pairs), pairs = array of kind@version, any
    number of rows for a blob. Returns the findings (blob, spans), for blobs with findings only, and the ledger
    rows of the pairs scanned here.
    """
    names = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    if ledger is None:
        due = blobs.withColumn("due", names)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("pairs")).alias("seen"))
        due = blobs.join(seen, "blob", "left")
        due = due.withColumn("due", F.when(F.col("seen").isNull(), names).otherwise(F.array_except(names, "seen"))).drop("seen")
        due = due.where(F.size("due") > 0)
    found = due
    for i, r in enumerate(rules):
        hits = _matches(r)
        if ledger is not None:
            hits = F.when(F.array_contains("due", f"{r.kind}@{r.version}"), hits).otherwise(F.array().cast("array<string>"))
        found = found.withColumn(f"hits{i}", hits)
    found = found.where(" OR ".join(f"size(hits{i}) > 0" for i in range(len(rules))))
    for i, r in enumerate(rules):
        spans = F.when(F.size(f"hits{i}") > 0, _spans(r, i, F.col(f"hits{i}"))).otherwise(F.array().cast(_SPAN))
        found = found.withColumn(f"spans{i}", spans)
    found = found.select("blob", F.array_sort(F.concat(*[f"spans{i}" for i in range(len(rules))])).alias("spans"))
    return found.where(F.size("spans") > 0), due.select("blob", F.col("due").alias("pairs"))


def _current(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of earlier runs that the rules as they are now still stand for, with their places."""
    rank = lambda s: F.coalesce(*[F.when((s["kind"] == r.kind) & (s["version"] == r.version), F.lit(i)) for i, r in enumerate(rules)])
    again = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["version"].alias("version"), s["end"].alias("end")))
    return F.filter(again, lambda s: s["rank"].isNotNull())


def scan_versions(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    ledger: DataFrame | None = None,
    known: DataFrame | None = None,
    store: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run over all versions: (rows, findings, ledger rows of this run).

    Equal texts are one blob, which is scanned once. ``known`` has the findings (blob, spans) and ``ledger`` the
    pairs of earlier runs: a span stays while a rule of its kind and version is among ``rules``, so the findings
    of a changed rule go and are looked for anew. ``store`` is the written table of blobs, made here if not
    given. Rows are (id, blob, spans) for every row of ``docs``: spans = array of (start, rank, kind, version,
    end) in code points, in order of start, then of rule; blobs of many copies are joined back in several tasks.
    A null or empty text has no span; a very long one is scanned whole; repeated rows each keep a row; a null id
    is kept; no rows give no rows. Extra columns play no part.
    """
    store = blob_store(docs, text_col) if store is None else store
    paths = docs.select(F.col(f"`{id_col}`").alias("id"), blob_id(F.col(f"`{text_col}`").cast("string")).alias("blob"))
    found, scanned = scan_blobs(store.select("blob", "text"), rules, ledger)
    if known is not None:
        both = known.select("blob", _current(F.col("spans"), rules).alias("spans")).unionByName(found).groupBy("blob")
        found = both.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
        found = found.where(F.size("spans") > 0)
    found, scanned = materialise(found, "findings"), materialise(scanned, "ledger")
    sized = store.select("blob", "copies").join(found, "blob", "left")
    out = spread_join(paths, materialise(sized, "copies"), ["blob"], ["id"], "left", number="copies")
    return out.select("id", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans")), found, scanned


def scan_runs(docs: DataFrame, runs: Sequence[tuple[Rule, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the last of several runs over the same versions, as rules are added or changed from run to run:
    each run scans the pairs that the ledger of those before it lacks, and adds its own to it."""
    store = blob_store(docs, text_col)
    rows = ledger = known = None
    for rules in runs:
        rows, known, scanned = scan_versions(docs, rules, ledger, known, store, id_col, text_col)
        ledger = scanned if ledger is None else ledger.unionByName(scanned)
    return rows


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the base rules first, then all rules: the second run scans for the added ones only
    found = scan_runs(table(spark, sf_dir, "documents"), (BASE_RULES, RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_listed(F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _duck_kind(rank: int, r: Rule) -> str:
    pat = r.pattern.replace("'", "''")
    value = f"regexp_extract(m[i], '{pat}', {r.group})"
    return (
        f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, m[i] AS hit, {value} AS value, "
        "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start "
        f"FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pat}') AS m, "
        f"string_split_regex(text, '{pat}') AS p FROM documents WHERE text IS NOT NULL) WHERE len(m) > 0) "
        f"WHERE length({value}) >= {r.least}"
    )


OP9_SQL = (
    "WITH f AS ("
    + " UNION ALL ".join(_duck_kind(i, r) for i, r in enumerate(RULES))
    + r"""),
g AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS span FROM f),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
        string_agg(span, ',' ORDER BY start, rank) AS spans FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
)

QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE_SQL = {"op9_secret_scan": OP9_SQL}
