"""As-of joins: each left row with the last right row of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, *, how: str = "inner", within: Column | None = None, prefix: str = "", slice_seconds: int | None = None) -> DataFrame:
    """left's columns with those of the matched right row (other than the key), named with prefix.

    Both sides are united and the last right row is carried forward over (key, time), which is one
    shuffle and no pair of rows. Equal times match; of right rows at the same time the one whose columns
    order last wins. within: an interval to which the match is held. how: inner or left.

    slice_seconds cuts each key's time into slices, so that a key of very many rows is spread over
    tasks; what a slice starts with comes from a running maximum over slices.
    """
    own = [c for c in right.columns if c not in on]
    right_row = F.struct(F.col(right_ts).alias("_at"), *(F.col(c) for c in own))
    lefts = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"))
    rights = right.select(*on, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), right_row.alias("_row"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    part = list(on)
    if slice_seconds:
        both = both.withColumn("_slice", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (slice_seconds * 1_000_000)))
        part.append("_slice")
    carried = F.last("_row", ignorenulls=True).over(W.partitionBy(*part).orderBy("_t", "_side", "_row").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_match", carried).where("_side = 1")
    if slice_seconds:
        slices = both.groupBy(*part).agg(F.max("_row").alias("_last"))
        before = W.partitionBy(*on).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        slices = slices.select(*part, F.last("_last", ignorenulls=True).over(before).alias("_before"))
        out = out.join(slices, part, "left").withColumn("_match", F.coalesce("_match", "_before"))
    if within is not None:
        out = out.withColumn("_match", F.when(F.col("_match._at") >= F.col("_t") - within, F.col("_match")))
    if how == "inner":
        out = out.where(F.col("_match").isNotNull())
    return out.select(*left.columns, *(F.col(f"_match.{c}").alias(prefix + c) for c in own))
