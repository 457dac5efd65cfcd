"""All queries over the driver's tables, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


@query(
    """SELECT o_orderstatus, count(*) AS orders, count(o_custkey) AS with_customer, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean,
    min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus"""
)
def g1_order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy("o_orderstatus")
        .agg(
            F.count("*").alias("orders"),
            F.count("o_custkey").alias("with_customer"),
            F.round(F.sum("o_totalprice"), 2).alias("total"),
            F.round(F.avg("o_totalprice"), 4).alias("mean"),
            F.min("o_totalprice").alias("least"),
            F.max("o_totalprice").alias("most"),
        )
    )
