"""Operator 8: SimHash fingerprints and a Hamming search by permuted block tables (DataFrame functions only)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table, text_or_empty

#: Two words that stand next to each other; every word but the last starts one.
WORD_PAIR = r"(?<![^\x20\x09-\x0D])(?=([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+))"
#: One of each 16 bits of a 64-bit hash, so that four counters share a long.
_EVERY_16TH = 0x0001000100010001
#: Terms per group of packed counters: at a weight of 8 a 16-bit lane stays under 2 ** 15.
_CHUNK, _MOST = 4000, 8


def terms(text: Column) -> Column:
    """Word pairs of a text, in lower case; of a text of one word, that word; none without words."""
    low = F.lower(text)
    pairs = F.regexp_extract_all(low, F.lit(WORD_PAIR), F.lit(1))
    trimmed = F.regexp_replace(low, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    one = F.filter(F.array(trimmed), lambda x: (x != "") & ~x.rlike(r"[\x20\x09-\x0D]"))
    return F.when(trimmed.rlike(r"[\x20\x09-\x0D]"), pairs).otherwise(one)


def weight(term: Column) -> Column:
    """Weight by length, as long terms say more than pairs of short function words."""
    n = F.length(term)
    return F.least(F.greatest(F.floor((n - 3) / 3), F.lit(1)), F.lit(_MOST)).cast("long")


def simhash(texts: DataFrame, keys: list[str], text_cols: list[str]) -> DataFrame:
    """(keys, kind, fingerprint): 16 hexadecimal digits for each of the texts of each row; keys are unique.

    Each term votes with its weight for the bits of its hash; a bit is set where it has more than half of all
    votes. Votes are counted four to a long, per 4,000 terms, in one aggregation that map-side combine reduces
    to a row per text, so only a hundred bytes per text are shuffled. Without terms all bits are 0.
    """
    e = texts.select(*keys, F.posexplode(F.array(*text_cols)).alias("kind", "text"))
    e = e.select(*keys, "kind", F.posexplode_outer(terms(F.col("text"))).alias("place", "term"))
    e = e.select(
        *keys,
        "kind",
        F.coalesce(F.floor(F.col("place") / _CHUNK), F.lit(0)).cast("int").alias("chunk"),
        F.xxhash64("term").alias("h"),
        F.when(F.col("term").isNotNull(), weight(F.col("term"))).otherwise(F.lit(0).cast("long")).alias("w"),
    )
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_EVERY_16TH)) * F.col("w")).alias(f"lane{i}") for i in range(16)]
    packed = e.groupBy(*keys, "kind", "chunk").agg(F.sum("w").alias("w"), *lanes)
    bit = lambda b: F.shiftrightunsigned(f"lane{b % 16}", 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))
    votes = packed.groupBy(*keys, "kind").agg(F.sum("w").alias("w"), *[F.sum(bit(b)).alias(f"bit{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        on = (1 << b) - (1 << 64 if b == 63 else 0)
        value = value.bitwiseOR(F.when(2 * F.col(f"bit{b}") > F.col("w"), F.lit(on)).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, "kind", F.lower(F.lpad(F.hex(value), 16, "0")).alias("fingerprint"))


def as_long(fingerprint: Column) -> Column:
    """The bits of a fingerprint as a long (the upper half shifted in, as a plain conversion is unsigned)."""
    half = lambda at: F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(as_long(a).bitwiseXOR(as_long(b))) / F.lit(64.0)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - radius of the blocks: within the radius, one choice agrees at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Pairs (query, found, distance) of distinct fingerprints within a Hamming radius, each once.

    ``queries`` and ``index`` have one column ``fingerprint``, without repeats. A permuted table for each choice
    of blocks is joined on the bits of the choice; the join condition keeps a pair only within the radius and
    in the first table that finds it.
    """
    masks = block_masks(radius, blocks)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)]))
    sides = [df.select("fingerprint", as_long(F.col("fingerprint")).alias("bits")).withColumn("key", keyed) for df in (queries, index)]
    q, x = [s.select(F.col("key.t").alias(f"{n}t"), F.col("key.block").alias(f"{n}block"), F.col("bits").alias(f"{n}bits"), F.col("fingerprint").alias(f"{n}fp")) for s, n in zip(sides, "qx")]
    differ = F.col("qbits").bitwiseXOR(F.col("xbits"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    on = (F.col("qt") == F.col("xt")) & (F.col("qblock") == F.col("xblock")) & (F.bit_count(differ) <= radius) & (first == F.col("qt"))
    return q.join(x, on).select(F.col("qfp").alias("query"), F.col("xfp").alias("found"), F.bit_count(differ).alias("distance"))


def following(keys: DataFrame, order: list[str], name: str = "next") -> DataFrame:
    """Each distinct key with the next one in order, the first following the last, in column ``next``.

    Range partitions are written once with their number; each finds its rows' followers, and the first key of
    each partition (a row per partition) closes the gaps.
    """
    ranged = keys.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "order")
    key = F.struct(*order)
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    found = ranged.withColumn("after", F.lead(key).over(inside))
    heads = ranged.groupBy("part").agg(F.min(key).alias("head"))
    line = Window.orderBy("part")
    heads = heads.select(F.col("part"), F.lead("head").over(line).alias("gap"), F.first("head").over(line).alias("start"))
    found = found.join(F.broadcast(heads), "part")  # one row per partition
    return found.select(*keys.columns, F.coalesce("after", "gap", "start").alias(name))


#: Stands for a null id, so that ids join and partition as plain values; it sorts first, as a null does.
NO_ID = -(2**63)


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, text, n_chars, edited, nid, nversion): the last quarter replaced by the start of the next document.

    All joins are on (id, version), the partitioning that removing repeats has made, so whole texts are
    shuffled once and only the starts of texts move again.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("version", F.xxhash64("text"))
    order = following(base.select("id", "version", F.length("text").cast("long").alias("n_chars")).distinct(), ["id", "version"])
    base = base.dropDuplicates(["id", "version"])
    order = order.select(F.col("id").alias("pid"), F.col("version").alias("pversion"), "n_chars", F.col("next.id").alias("id"), F.col("next.version").alias("version"))
    heads = base.join(order, ["id", "version"]).select(
        F.col("pid").alias("id"),
        F.col("pversion").alias("version"),
        "n_chars",
        F.col("id").alias("nid"),
        F.col("version").alias("nversion"),
        F.expr("substring(text, 1, cast(floor(n_chars / 4) as int))").alias("head"),
    )
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.col("head"))
    return base.join(heads, ["id", "version"]).select("id", "version", "text", "n_chars", edited.alias("edited"), "nid", "nversion")


def fingerprint_documents(docs: DataFrame, radius: int = 3, query_step: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, likenesses, and a radius search.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next
    document in order of id (of texts that share an id, in order of their hash; a null id first). Rows that
    repeat an id and text are one document. For ids divisible by ``query_step``, n_within is the number of
    documents whose fingerprint lies within ``radius`` bits, itself included; null for others. Null texts are
    empty; an empty text has fingerprint 0; without rows there is no result.
    """
    texts = edited_texts(docs, id_col, text_col)
    keys = ["id", "version", "n_chars", "edited_sha256", "nid", "nversion"]
    prints = simhash(texts.withColumn("edited_sha256", F.sha2("edited", 256)), keys, ["text", "edited"])
    prints = prints.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == i, F.col("fingerprint"))).alias(n) for i, n in enumerate(("fingerprint", "edited_fingerprint"))])
    prints = materialise(prints, "prints")
    nexts = prints.select(F.col("id").alias("nid"), F.col("version").alias("nversion"), F.col("fingerprint").alias("next_fingerprint"))
    out = prints.join(nexts, ["nid", "nversion"])
    counts = prints.groupBy("fingerprint").agg(F.count("*").alias("documents"))
    is_query = (F.col("id") % query_step == 0) & (F.col("id") != NO_ID)
    pairs = within_radius(prints.where(is_query).select("fingerprint").distinct(), counts.select("fingerprint"), radius)
    near = pairs.join(counts.withColumnRenamed("fingerprint", "found"), "found").groupBy("query").agg(F.sum("documents").alias("n_within"))
    asked = prints.where(is_query).select("id", "version", F.col("fingerprint").alias("query")).join(near, "query", "left")
    out = out.join(asked.select("id", "version", "n_within"), ["id", "version"], "left")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "n_within",
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
