"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut


#: Rows of a side that is broadcast, at most: two numbers each, some 40 bytes as hashed.
MOST = 1_000_000


def meet(rows: DataFrame, few: DataFrame, key: str, bound: int, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row for each key and no more rows than the bound.

    A small few is broadcast. Beyond, it is written first, so that both sides of the join are plain exchanges,
    of which adaptive execution splits those of a hot key.
    """
    return rows.join(F.broadcast(few) if bound <= MOST else cut(few), key, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v) that is not its component's smallest.

    Each round makes, of every node's larger neighbours, neighbours of its smallest one, and then the same
    of its smaller neighbours, and is written to the shared folder. The rounds grow with the logarithm of
    a component's size, and no group is ever gathered: a hub is one key of a pre-aggregated minimum and
    of a join that may be split.
    """
    oriented = lambda e: e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first())
    now = cut(oriented(edges))
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both.where("v > u"), least, "u", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least, "u", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(oriented(small))
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
