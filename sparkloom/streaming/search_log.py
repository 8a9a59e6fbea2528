"""The search log: a batch-equal stream of appended rows, windows over it, pages of it, and its pruning.

Every function takes a batch or a streaming frame; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RETENTION_DAYS = 36_500
QUERY_CHARS = 500


def trimmed(log: DataFrame, text: str) -> DataFrame:
    return log.withColumn(text, F.substring(text, 1, QUERY_CHARS))


def page(log: DataFrame, key: str, before: int | None, size: int) -> DataFrame:
    """Keyset page: newest first, ids below ``before``, one row more than asked so that the caller sees the end."""
    rows = log if before is None else log.filter(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(size + 1)


def retained(log: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows no older than ``days`` before ``now``."""
    days = min(max(days, 0), MAX_RETENTION_DAYS)
    return log.filter(F.col(at) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))


def per_window(log: DataFrame, at: str, kind: str, width: str, late: str | None = None) -> DataFrame:
    """Rows and distinct kinds by tumbling window."""
    rows = log.withWatermark(at, late) if late else log
    counted = rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(log: DataFrame, at: str, user: str, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's rows without a pause of ``gap``."""
    rows = log.withWatermark(at, late) if late else log
    merged = rows.groupBy(F.session_window(at, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return merged.select(user, F.col("s.start").alias("session_start"), "n")


def append(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that appends the log to ``folder`` in whole batches; each batch has its own path, so a retried one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prune(spark: SparkSession, folder: str, at: str, now: str, days: int) -> int:
    """Drop rows older than ``days`` from an appended log, batch by batch; returns how many batches were rewritten.

    A batch that holds nothing old is left alone; one that does is written aside and put in its place.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    count = 0
    for state in files.listStatus(path(folder)):
        name = state.getPath().getName()
        if not name.startswith("batch="):
            continue
        rows = spark.read.parquet(f"{folder}/{name}")
        kept = retained(rows, at, now, days)
        if kept.count() == rows.count():
            continue
        kept.write.mode("overwrite").parquet(f"{folder}/.{name}")
        files.delete(path(f"{folder}/{name}"), True)
        files.rename(path(f"{folder}/.{name}"), path(f"{folder}/{name}"))
        count += 1
    return count
