"""Ranks over a whole table that do not pass through one task.

A window without partitions sends all rows to one task. Here the rows are cut into ranges of the leading key
and the ties behind it, so that a value which very many rows have is cut as well; places are taken within
ranges and shifted by the counts of the ranges before. Of each range, its size, least and greatest value
and how often it has the greatest come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.checkpoints import cut


def ranked(df: DataFrame, lead: str, *ties: str, ranges: int = 64, alone: int = 100_000) -> DataFrame:
    """df with _row (row number), _rank (by the leading key alone) and _n (rows), ascending by lead, then ties; lead holds numbers or times, without nulls.

    Without ties, all other columns are. Up to `alone` rows are few enough for one task and are ranked there.
    df is read several times, so that a dear one should be cut first. ranges: tasks that share the work.
    """
    if df.limit(alone + 1).count() <= alone:
        whole = W.partitionBy()
        return df.select(*df.columns, F.row_number().over(W.orderBy(lead, *ties)).alias("_row"), F.rank().over(W.orderBy(lead)).alias("_rank"), F.count("*").over(whole).alias("_n"))
    order = [lead, *(ties or (c for c in df.columns if c != lead))]
    key = F.struct(*order)
    spread = df.select(*order).repartitionByRange(ranges, *order).select(F.spark_partition_id().alias("_p"), key.alias("_key"))
    cuts = spread.groupBy("_p").agg(F.min("_key").alias("_first")).agg(F.array_sort(F.collect_list("_first")).alias("_cuts"))
    at = df.crossJoin(F.broadcast(cut(cuts))).withColumn("_range", F.greatest(F.lit(0), F.size(F.filter("_cuts", lambda x: x <= key)) - 1)).drop("_cuts")
    by_value = at.groupBy("_range", lead).agg(F.count("*").alias("_k"))
    seen = by_value.groupBy("_range").agg(F.sum("_k").alias("size"), F.min(lead).alias("least"), F.max(lead).alias("most"), F.max_by("_k", lead).alias("of_most")).orderBy("_range").collect()
    rows, before = [], 0
    for j, r in enumerate(seen):
        i, ahead = j, before
        while i and seen[i - 1].most == r.least:  # the least value goes on from the range before
            i -= 1
            ahead -= seen[i].size if seen[i].least == r.least else seen[i].of_most
        rows.append((r["_range"], before, ahead + 1, r.least))
        before += r.size
    starts = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_of_least", T.LongType()), T.StructField("_least", df.schema[lead].dataType)]))
    inside = W.partitionBy("_range").orderBy(*order)
    out = at.join(F.broadcast(starts), "_range")
    row = (F.row_number().over(inside) + F.col("_before")).alias("_row")
    rank = F.when(F.col(lead) == F.col("_least"), F.col("_of_least")).otherwise(F.rank().over(W.partitionBy("_range").orderBy(lead)) + F.col("_before")).alias("_rank")
    return out.select(*df.columns, row, rank, F.lit(before).cast("long").alias("_n"))


def percent_ranks(df: DataFrame, key: str, leads: dict[str, str], alone: int = 100_000) -> DataFrame:
    """key with, under each name, the percent_rank of every row by a column. df is read several times."""
    if df.limit(alone + 1).count() <= alone:
        return df.select(key, *(F.percent_rank().over(W.orderBy(c)).alias(n) for n, c in leads.items()))
    out = df.select(key)
    for name, lead in leads.items():
        out = out.join(ranked(df.select(key, lead), lead, key, alone=alone).select(key, percent_rank().alias(name)), key)
    return out


def ntile(n: int) -> Column:
    """Bucket 1 to n of a ranked row: the first buckets take one row more if they cannot be equal."""
    small, more = F.floor(F.col("_n") / n), F.col("_n") % n
    edge = more * (small + 1)
    early = F.floor((F.col("_row") - 1) / (small + 1)) + 1
    return F.when(F.col("_row") <= edge, early).otherwise(more + F.floor((F.col("_row") - edge - 1) / F.greatest(small, F.lit(1))) + 1).cast("long")


def percent_rank() -> Column:
    """(rank - 1) / (rows - 1) of a ranked row, 0 if it is alone."""
    return F.when(F.col("_n") > 1, (F.col("_rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)
