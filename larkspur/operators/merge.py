"""Merging several sources' records into one entity table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topn import latest


def dictionary(column: str, values: dict[str, str], otherwise: str | None = None) -> Column:
    """column by a table of values; null stays null, an unknown value becomes otherwise, or null if none is given."""
    found = F.lit(None).cast("string") if otherwise is None else F.when(F.col(column).isNotNull(), F.lit(otherwise))
    for k, v in values.items():
        found = F.when(F.col(column) == k, v).otherwise(found)
    return found


def unknown_values(rows: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """(value, n) that the dictionary lacks."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def dedupe(rows: DataFrame, key: list[str], latest_by: str, batch: str, record: str) -> DataFrame:
    """One row a key: greatest latest_by (null least), then latest batch, then record id."""
    return latest(rows, key, [latest_by, batch, record])


def mapping_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(mapping, field, change, old, new) where two versions of (mapping, field, expression) differ."""
    a, b = (v.select("mapping", "field", F.col("expression").alias(n)) for v, n in ((old, "old"), (new, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, ["mapping", "field"], "full").where("NOT old <=> new").select("mapping", "field", change.alias("change"), "old", "new")


def key_space(prefix: str, *columns: str) -> list[Column]:
    """Key columns with their space ahead, so that the keys of two sources never meet."""
    return [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string"))).alias(c) for c in columns]


def shared_keys(mappings: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Keys that more than one mapping writes, and which ones."""
    tagged = reduce(DataFrame.unionByName, (df.select(*key, F.lit(name).alias("_mapping")) for name, df in mappings.items()))
    return tagged.groupBy(*key).agg(F.array_sort(F.collect_set("_mapping")).alias("_m")).where(F.size("_m") > 1).select(*key, F.concat_ws(",", "_m").alias("mappings"))


def overlap(a: DataFrame, b: DataFrame, key: str, attribute: str, same: float = 0.8, apart: float = 0.2) -> DataFrame:
    """One row: rows of either side, common keys, share that agrees, and what to do about it."""
    both = a.select(key, F.col(attribute).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(key, F.col(attribute).alias("_b"), F.lit(1).alias("_in_b")), key, "full")
    n = both.agg(F.count("_in_a").alias("n_a"), F.count("_in_b").alias("n_b"), F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("common"), F.count_if(F.col("_a") == F.col("_b")).alias("agree"))
    share = F.try_divide(F.col("agree").cast("double"), F.col("common"))
    advice = F.when(F.col("common") == 0, "separate").when(share >= same, F.when(F.col("common") == F.least("n_a", "n_b"), "duplicate").otherwise("drop_one")).when(share <= apart, "key_space").otherwise("review")
    return n.withColumns({"agreement": F.round(share, 6), "advice": advice})


def refresh(winners: DataFrame, records: DataFrame, touched: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """winners after a batch: those of the touched keys are picked afresh from all current records, the others stay.

    records hold every mapping's current rows and not the winners alone, so that the runner-up comes
    forward when a winner is deleted, and a key without records disappears.
    """
    keys = touched.select(*key).distinct()
    fresh = latest(records.join(keys, key, "left_semi"), key, order)
    return winners.join(keys, key, "left_anti").unionByName(fresh.select(winners.columns))


def by_priority(rows: DataFrame, key: list[str], priority: str, order: list[str]) -> DataFrame:
    """The whole row of the source with the least priority number, then the last by order."""
    return latest(rows.withColumn("_p", -F.col(priority)), key, ["_p", *order]).drop("_p")


def coalesced(rows: DataFrame, key: list[str], priority: str, order: list[str]) -> DataFrame:
    """Of each column the first value that is not null, by priority and then order."""
    columns = [c for c in rows.columns if c not in (*key, priority, *order)]
    rank = F.struct(priority, *order)
    return rows.groupBy(*key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns))
