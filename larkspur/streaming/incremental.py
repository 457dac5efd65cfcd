"""Structured Streaming jobs: micro-batches, running totals, sessions and late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.tables import BucketedTable


def files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream, so many a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)


def append(stream: DataFrame, path: str, state: str) -> StreamingQuery:
    """Append to a Parquet folder until what is there is read; each row once, by the state folder."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()


def window_totals(stream: DataFrame, ts: str, keys: list[str], value: str, *, size: str = "1 hour", slide: str | None = None, late: str = "15 minutes") -> DataFrame:
    """Counts and sums of tumbling or sliding windows; rows later than the watermark are dropped."""
    at = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(at.alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n", "total")


def session_totals(stream: DataFrame, ts: str, key: str, *, gap: str = "30 minutes", late: str = "15 minutes") -> DataFrame:
    """Sessions of each key: a gap of more than `gap` parts them."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_s"), key).agg(F.count("*").alias("events")).select(key, F.col("_s.start").alias("began"), "events")


def first_seen(stream: DataFrame, key: list[str], ts: str, late: str = "15 minutes") -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def merge_totals(stream: DataFrame, table: BucketedTable, keys: list[str], sums: dict[str, str], greatest: list[str], state: str, on_batch: Callable[[int], None] = lambda n: None) -> StreamingQuery:
    """Running totals by key in a table of buckets: each micro-batch is grouped, added, and rewrites the buckets of its keys.

    The number of the micro-batch is kept with the table, so that one that comes again after a failure is
    not added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        own = batch.groupBy(*keys).agg(*(F.expr(e).alias(c) for c, e in sums.items()), *(F.max(c).alias(c) for c in greatest))
        table.merge(own, list(sums), greatest, number)
        on_batch(number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def audit_updates(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """(key, old, new) where a column of two states differs: an update trigger's log."""
    b, a = before.select(key, F.col(column).alias("old")), after.select(key, F.col(column).alias("new"))
    return b.join(a, key).where(~F.col("old").eqNullSafe(F.col("new")))
