"""First, last and top rows of groups without sorting groups that need not be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by order (nulls first), by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by order; groups are cut to n rows before the shuffle where Spark can."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def capped(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows by order, with truncated: whether there are more. One row beyond the cap is looked for."""
    head = df.orderBy(*order).limit(most + 1)
    more = head.agg((F.count("*") > most).alias("truncated"))
    return head.orderBy(*order).limit(most).crossJoin(F.broadcast(more))


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key (ties to the least value) and its count: counts first, then one row a key."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))
