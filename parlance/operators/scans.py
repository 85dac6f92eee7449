"""Ordered operators over keys that are too long for one task: segmented scans and exact order statistics.

A scan cuts a key into buckets of its order. Each bucket is summed up to one row, a window over those few rows gives what stands before each
bucket, and a window inside the bucket adds the rest, so that no task holds or sorts all rows of a key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settled(df: DataFrame) -> DataFrame:
    """``df``, written to the session's checkpoint folder, so that what follows does not compute it again.

    Without ``spark.checkpoint.dir`` a folder under /tmp serves in local mode; elsewhere executors would not share it, so it is refused.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal or equally null columns; those of ``left`` stay."""
    right = right.withColumnsRenamed({n: f"__of_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & left[n].eqNullSafe(right[f"__of_{n}"])
    return left.join(right, on, how).drop(*[f"__of_{n}" for n in names])


# ---------------------------------------------------------------- segmented scan


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, carried: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add what the rows of the keys before each row hold: for each name ("sum" | "max" | "last", value), or ("next", value) of those after it.

    ``last`` and ``next`` are the nearest value that is not null; a struct of a column keeps its nulls. ``order`` has no ties within the keys, and
    ``bucket`` must not fall along it. ``df`` is computed once and written (``settled``).
    """
    ks, values = list(keys), {f"__v{i}": c for i, (_, c) in enumerate(carried.values())}
    d = settled(df.withColumns({**values, "__bucket": bucket}))
    place = F.struct(*order)
    kinds = dict(zip(values, (k for k, _ in carried.values()), strict=True))
    known = lambda v: F.when(F.col(v).isNotNull(), place)
    whole = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, known(v)), "next": lambda v: F.min_by(v, known(v))}
    held = d.groupBy(*ks, "__bucket").agg(*[whole[k](v).alias(v) for v, k in kinds.items()])
    of = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True), "next": lambda v: F.first(v, ignorenulls=True)}

    def around(w, kind: str):
        return w.rowsBetween(1, Window.unboundedFollowing) if kind == "next" else w.rowsBetween(Window.unboundedPreceding, -1)

    over = Window.partitionBy(*ks).orderBy("__bucket")
    held = held.select(*ks, "__bucket", *[of[k](v).over(around(over, k)).alias(f"{v}_far") for v, k in kinds.items()])
    near = Window.partitionBy(*ks, "__bucket").orderBy(*order)
    d = same_keys(d, held, [*ks, "__bucket"]).withColumns({f"{v}_near": of[k](v).over(around(near, k)) for v, k in kinds.items()})
    both = {
        "sum": lambda v: F.coalesce(f"{v}_far", F.lit(0)) + F.coalesce(f"{v}_near", F.lit(0)),
        "max": lambda v: F.greatest(f"{v}_far", f"{v}_near"),
        "last": lambda v: F.coalesce(f"{v}_near", f"{v}_far"),
        "next": lambda v: F.coalesce(f"{v}_near", f"{v}_far"),
    }
    out = d.withColumns({n: both[k](v) for n, (v, k) in zip(carried, kinds.items(), strict=True)})
    return out.drop("__bucket", *[f"{v}{s}" for v in kinds for s in ("", "_far", "_near")])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], bucket: Column | None) -> DataFrame:
    """Add under new names the columns of the row before, null at the first; ``columns``: {name: column}. Without ``bucket`` by one window."""
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({n: F.lag(c).over(w) for n, c in columns.items()})
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    out = scan(df, keys, order, bucket, {"__row": ("last", row)})
    return out.withColumns({n: F.col("__row")[n] for n in columns}).drop("__row")


# ---------------------------------------------------------------- order statistics

#: Ranges that values are dealt to in a round at least, and different values of a range up to which one task ranks them.
RANGES, MOST_ROWS = 32, 1 << 20


def _selected(d: DataFrame, ks: list[str], wanted: DataFrame, most: int) -> DataFrame:
    """(ks, place, v): the values at places (from 0) in the order of each key. ``d``: (ks, v, __k), a row for each different value and how often
    it occurs, ``wanted``: (ks, place, path).

    A round deals the values by ranges of (ks, v), whose bounds may be any, and goes on within the ranges that hold a place, until these are
    small enough for a task or hold one value.
    """
    ranges = max(RANGES, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = settled(d.repartitionByRange(ranges, *ks, "v").withColumn("__range", F.spark_partition_id()))
    held = d.groupBy(*ks, "__range").agg(F.sum("__k").alias("__rows"), F.count("*").alias("__values"), F.min("v").alias("__low"))
    before = Window.partitionBy(*ks).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    meet = same_keys(wanted, held, ks) if ks else wanted.crossJoin(held)  # places of one key by its ranges
    meet = settled(meet.where((F.col("place") >= F.col("__before")) & (F.col("place") < F.col("__before") + F.col("__rows"))))
    found = meet.where("__values = 1").select(*ks, "path", F.col("__low").alias("v"))
    open_ = meet.where("__values > 1")
    largest = open_.agg(F.max("__values")).first()[0]
    if largest is None:
        return found
    inner = [*ks, "__range"]
    rows = same_keys(d, open_.select(*inner).distinct(), inner)
    places = open_.select(*inner, (F.col("place") - F.col("__before")).alias("place"), "path")
    if largest > most:
        deeper = {n: f"__r{i}" for i, n in enumerate(inner)}
        more = _selected(rows.withColumnsRenamed(deeper), list(deeper.values()), places.withColumnsRenamed(deeper), most)
        return found.unionByName(more.withColumnsRenamed({v: k for k, v in deeper.items()}).select(*ks, "path", "v"))
    running = F.sum("__k").over(Window.partitionBy(*inner).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = same_keys(places, rows.withColumn("__upto", running), inner).where((F.col("place") < F.col("__upto")) & (F.col("place") >= F.col("__upto") - F.col("__k")))
    return found.unionByName(hit.select(*ks, "path", "v"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: Column | str, at: dict[str, float], most: int = MOST_ROWS) -> DataFrame:
    """(keys, n, names): exact quantiles of known values by linear interpolation, for keys of any length; ``at``: {name: share}.

    ``df`` is read once, into counts of its different values. Nothing holds all values of a key (``_selected``): the result is that of
    ``percentile``, whose map of different values is one task's. A key without values has n = 0 and nulls, as has an empty table without keys.
    """
    ks, v = list(keys), F.col(value) if isinstance(value, str) else value
    d = settled(df.select(*ks, v.cast("double").alias("v")).groupBy(*ks, "v").agg(F.count("*").alias("__k")))
    n = settled(d.groupBy(*ks).agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("__k"))), F.lit(0)).alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("pos")) for name, q in at.items()])).alias("w")
    wanted = n.where("n > 0").select(*ks, each).select(*ks, "w.name", "w.pos", F.explode(F.array_distinct(F.array(F.floor("w.pos"), F.ceil("w.pos")))).alias("place"))
    wanted = wanted.withColumn("path", F.struct("name", "pos", "place"))
    got = _selected(d.where("v IS NOT NULL"), ks, wanted.select(*ks, "place", "path"), most)
    share = F.when(F.floor("path.pos") == F.ceil("path.pos"), 1.0).when(F.col("path.place") == F.floor("path.pos"), F.ceil("path.pos") - F.col("path.pos")).otherwise(F.col("path.pos") - F.floor("path.pos"))
    parts = got.withColumn("__part", F.col("v") * share)
    wide = parts.groupBy(*ks).agg(*[F.sum(F.when(F.col("path.name") == name, F.col("__part"))).alias(name) for name in at])
    return same_keys(n, wide, ks, "left") if ks else n.crossJoin(wide)  # one row
