"""State per key in streams: logs of updates with old and new value, and running totals as they change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.functions.shipping import ship

#: The state store that keeps keys on disk beside memory, which state of this kind needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row of a log of updates, with its time in microseconds; and the time or number of a row that has none.
LOGGED, NEVER = Row("key", "old", "new", "change", "at"), -(1 << 63)


def prepare(spark: SparkSession) -> None:
    """Give the session the state store, unless it has it, and the workers the package."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ship(spark)


class Updates(StatefulProcessor):
    """The last value of each key; what changes it comes out with the old value.

    A key's rows are taken in order of time and, within a time, of their number; rows older than the last one kept are
    late and change nothing. A key of which nothing has come for `expiry` of event time is forgotten by a timer.
    """

    def __init__(self, column: str, time: str, number: str, expiry_ms: int | None):
        self.column, self.time, self.number, self.expiry = column, time, number, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value string, at long, number long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get()  # None for a new key; each call asks the JVM
        state, timer = (held[:3], held[3]) if held else (None, None)
        for moment, number, value in sorted(((r[self.time], r[self.number], r[self.column]) for r in rows), key=lambda x: x[:2]):
            if state is not None and (moment, number) <= state[1:]:
                continue
            if state is None or value != state[0]:
                yield LOGGED(key[0], None if state is None else state[0], value, "insert" if state is None else "update", moment)
            state = (value, moment, number)
        if self.expiry is not None and state is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = state[1] // 1000 + self.expiry
            self.handle.registerTimer(timer)
        if state is not None:
            self.last.update((*state, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        self.last.clear()
        if held:
            yield LOGGED(key[0], held[0], None, "expired", held[1])

    def close(self) -> None:
        pass


def update_log(stream: DataFrame, key: str, column: str, time: str, number: str, *, expiry: str | None = None, late: str = "15 minutes") -> DataFrame:
    """(key, old, new, change, at) of a stream of rows: insert, update, and expired for keys without a row for so long."""
    prepare(stream.sparkSession)
    texts = [T.StructField(c, T.StringType()) for c in ("old", "new", "change")]
    schema = T.StructType([T.StructField("key", stream.schema[key].dataType), *texts, T.StructField("at", T.LongType())])
    wait = None if expiry is None else int(pd.Timedelta(expiry).total_seconds() * 1000)
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows if expiry is None else rows.withWatermark(time, late)
    number_of = lambda c: F.coalesce(c.cast("long"), F.lit(NEVER))
    rows = rows.select(key, F.col(column).cast("string").alias("_value"), number_of(F.unix_micros(time)).alias("_at"), number_of(F.col(number)).alias("_number"), *([] if expiry is None else [time]))
    out = rows.groupBy(key).transformWithState(Updates("_value", "_at", "_number", wait), schema, "Append", "None" if expiry is None else "EventTime")
    return out.withColumn("at", F.timestamp_micros(F.nullif("at", F.lit(NEVER))))


class Totals(StatefulProcessor):
    """Count, sum and greatest number of each key, put out whenever rows of it have come."""

    def __init__(self, value: str, number: str):
        self.value, self.number = value, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("totals", "n long, total double, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, last = self.held.get() if self.held.exists() else (0, 0.0, None)
        for r in rows:
            top = int(r[self.number].max())
            n, total, last = n + len(r), total + float(r[self.value].sum()), top if last is None else max(last, top)
        self.held.update((n, total, last))
        yield pd.DataFrame([(*key, n, total, last)], columns=["key", "n", "total", "last"])

    def close(self) -> None:
        pass


def running_totals(stream: DataFrame, key: str, value: str, number: str) -> DataFrame:
    """(key, n, total, last) of each key that a micro-batch touches, over all rows so far; the greatest n is the latest."""
    prepare(stream.sparkSession)
    schema = T.StructType([T.StructField("key", stream.schema[key].dataType), *(T.StructField(c, k) for c, k in (("n", T.LongType()), ("total", T.DoubleType()), ("last", T.LongType())))])
    return stream.select(key, F.col(value).cast("double").alias(value), F.col(number).cast("long").alias(number)).groupBy(key).transformWithStateInPandas(Totals(value, number), schema, "Update", "None")
