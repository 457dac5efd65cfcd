"""Sums and counts over the time before each row, for keys of any number of rows.

A key's time is cut into slices. What has come up to a moment is the sum of the whole slices before, from a running
sum over the slices (of which a key has as many as its time has, not as its rows), and of the rows of the moment's own
slice, looked at one by one. A window is the difference of two moments: its end, and what came ahead of its beginning.
Both are asked in the slice where they lie, so that a slice of a key, and never a key, is what a task has to hold.

Edge cases: rows at the same time are in each other's windows; null values count nothing and a window with none but
those has a null sum; rows without a key are a key of their own; rows without a time have null results; ids tell rows
apart and must be distinct. Sums of decimals and whole numbers are exact; those of doubles lose what a difference of
running sums loses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400_000_000


def rolling(df: DataFrame, id_col: str, key: str, time: str, value: str, widths: dict[str, int], *, slice_us: int = 7 * DAY) -> DataFrame:
    """(id, and for each name of a width in microseconds: <name>_sum, <name>_n) of the rows of the key from so long before to the row's own time.

    time is in microseconds, as a whole number. Widths end at the row, both ends belong to the window.
    """
    kind = df.schema[value].dataType
    number = T.DecimalType(38, 4) if isinstance(kind, T.DecimalType) else T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()
    one = F.col(value).cast(number)
    own = F.coalesce(one, F.lit(0).cast(number)).alias("v"), F.col(value).isNotNull().cast("long").alias("n")
    rows = df.where(F.col(time).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(time).cast("long").alias("at"), *own)
    zero, none = F.lit(0).cast(number), F.lit(0).cast("long")
    # a moment's place is 2 at + 1 for a row, whose own time counts, and 2 at for a beginning, whose own time does not
    asks = [F.struct(F.lit(-1).alias("which"), F.col("at").alias("at"), (2 * F.col("at") + 1).alias("place"), F.col("v").alias("v"), F.col("n").alias("n"))]
    asks += [F.struct(F.lit(k).alias("which"), (F.col("at") - w).alias("at"), (2 * (F.col("at") - w)).alias("place"), zero.alias("v"), none.alias("n")) for k, w in enumerate(widths.values())]
    moments = rows.select("id", "key", F.inline(F.array(*asks))).withColumn("slice", F.floor(F.col("at") / slice_us))
    sums = moments.groupBy("key", "slice").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    before = W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select(
        F.col("key").alias("_key"), F.col("slice").alias("_slice"),
        F.coalesce(F.sum("v").over(before), zero).alias("before_v"), F.coalesce(F.sum("n").over(before), none).alias("before_n"),
    )
    inside = W.partitionBy("key", "slice").orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow)
    upto = moments.withColumns({"upto_v": F.sum("v").over(inside), "upto_n": F.sum("n").over(inside)})
    upto = upto.join(ahead, F.col("key").eqNullSafe(F.col("_key")) & F.col("slice").eqNullSafe(F.col("_slice")))
    found = upto.select("id", "which", (F.col("before_v") + F.col("upto_v")).alias("v"), (F.col("before_n") + F.col("upto_n")).alias("n"))
    at = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c)))
    wide = found.groupBy("id").agg(*(at(k, c).alias(f"_{c}{k}") for k in range(-1, len(widths)) for c in ("v", "n")))
    out = [F.col("id").alias(id_col)]
    for k, name in enumerate(widths):
        n = F.col("_n-1") - F.col(f"_n{k}")
        out += [F.when(n > 0, F.col("_v-1") - F.col(f"_v{k}")).alias(f"{name}_sum"), n.alias(f"{name}_n")]
    timed = wide.select(*out)
    without = df.where(F.col(time).isNull()).select(F.col(id_col), *(F.lit(None).cast(f.dataType).alias(f.name) for f in timed.schema.fields[1:]))
    return timed.unionByName(without)
