"""Streaming forms: running channel statistics, upserts by micro-batch and session grouping of a span stream.

The batch operators are the truth; these keep their results up to date as rows come in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import upsert
from ..operators.stats import channel_stats


def stream_channel_stats(samples: DataFrame, keys: Sequence[str], floor: float) -> DataFrame:
    """channel_stats over a stream: the partial sums are the state. Use output mode update or complete."""
    return channel_stats(samples, keys, floor)


def stream_sessions(spans: DataFrame, time: str, gap: str, lateness: str, keys: Sequence[str]) -> DataFrame:
    """(keys, session_start, session_end, n): runs of events closer than ``gap``; rows later than ``lateness`` are dropped."""
    s = spans.withWatermark(time, lateness).groupBy(*keys, F.session_window(time, gap).alias("w"))
    return s.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def newest_rows(df: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the greatest by ``order``, then by all other columns, so that the result does not depend on how rows came."""
    first = [order] if order else []
    rest = [c for c in df.columns if c not in (*keys, *first)]
    greatest = df.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("__row"))
    return greatest.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def upsert_batches(path: str, keys: Sequence[str] = ("session_id",), buckets: int = 64, order: str | None = None, lateness: float | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that carries a table forward by buckets of its keys.

    With ``order`` (a number that grows, such as a sequence or a time) a key keeps its newest row, whichever batch brings it; without,
    the last batch that has the key. Of rows of one key in a batch the greatest is taken, so the same batch always gives the same. ``lateness``
    is a watermark: rows more than that behind the greatest ``order`` of all batches before are left out and counted (``read_late``).

    Batch n reads the newest version of the buckets that it touches, and writes these as version n; other buckets stay. A batch
    that is tried again reads the same and writes the same, so the table is exact after failures. What a bucket's version
    before the last one held is removed. ``read_upserted`` gives the table.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if order is not None:
            batch = _on_time(batch, path, n, order, lateness)
        new = newest_rows(batch, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets rows
        newest = {b: v for b, v in _newest(spark, path, n).items() if b in touched}
        if newest:
            old = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}/bucket={b}" for b, v in newest.items()]).drop("version")
            if order is None:
                new = upsert(old, new, (*keys, "bucket"), keys)
            else:
                new = newest_rows(old.unionByName(new, allowMissingColumns=True), (*keys, "bucket"), order)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={n}")
        fs, at = _file_system(spark, path)
        for b, v in newest.items():
            for old_version in _versions(spark, path):
                if old_version < v:
                    fs.delete(at(f"{path}/version={old_version}/bucket={b}"), True)

    return run


def _on_time(batch: DataFrame, path: str, n: int, order: str, lateness: float | None) -> DataFrame:
    """The rows of batch n that are not behind the watermark that the batches before it leave; its own mark is written."""
    spark = batch.sparkSession
    before = [v for v in _numbers(spark, f"{path}/marks", "version") if v < n]
    mark = spark.read.parquet(f"{path}/marks/version={before[-1]}").first()["mark"] if before else None
    late = F.lit(False) if mark is None or lateness is None else F.coalesce(F.col(order) < mark - lateness, F.lit(False))
    seen = batch.agg(F.max(F.col(order).cast("double")).alias("mark"), F.count_if(late).alias("n_late"))
    seen.select(F.greatest("mark", F.lit(mark).cast("double")).alias("mark"), "n_late").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/version={n}")
    return batch.where(~late)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """(batch, mark, n_late) of an ordered upsert: the greatest order so far, and how many rows of the batch came too late."""
    return spark.read.option("basePath", f"{path}/marks").parquet(f"{path}/marks").select(F.col("version").cast("long").alias("batch"), "mark", "n_late")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at(path))]
    return sorted(int(f.removeprefix(name + "=")) for f in found if f.startswith(name + "="))


def _versions(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, path, "version")


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, of those before ``before``."""
    out: dict[int, int] = {}
    for v in _versions(spark, path):
        if before is None or v < before:
            out |= {b: v for b in _numbers(spark, f"{path}/version={v}", "bucket")}
    return out


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``upsert_batches`` carries, as of its last batch."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/version={v}/bucket={b}" for b, v in _newest(spark, path).items()]).drop("version", "bucket")


def run_available(query_frame: DataFrame, checkpoint: str, name: str, mode: str) -> StreamingQuery:
    """Process all that is there into an in-memory table and stop; for tests and small reports only."""
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_the_end(build: Callable[[DataFrame], DataFrame], source: DataFrame, last: DataFrame, path: str) -> DataFrame:
    """All rows of an append-mode query over a stream that has ended, those of its last windows too.

    Windows close when later rows come in. When all is read, ``last`` rows (of the source's schema, later than everything by
    more than gap and lateness) follow through a second file stream; their own windows stay open and give no row.
    """
    spark = source.sparkSession
    beats = f"{path}/beats"
    last.limit(0).write.mode("append").parquet(beats)
    rows = build(source.unionByName(spark.readStream.schema(source.schema).parquet(beats)))
    for more in (None, last):
        if more is not None:
            more.write.mode("append").parquet(beats)
        q = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")
