"""Matching the contacts of two lists: by telephone, then by name within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.fuzzy import jaro_winkler


def by_key(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """(b_id, a_id) of equal keys; the key is an expression over either's columns, null matches nothing."""
    keyed = lambda df, i: df.select(i, key.alias("_key")).where("_key IS NOT NULL")
    return keyed(b, "b_id").join(keyed(a, "a_id"), "_key").select("b_id", "a_id")


def numbered(name: Column) -> Column:
    """Hashes of a name's characters, each with how many of its kind have come, ascending: a multiset as a set."""
    chars = F.split(name, "")
    nth = lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))
    return F.array_sort(F.transform(chars, lambda c, i: F.xxhash64(c, nth(c, i))))


def enough(least: float) -> Column:
    """Common characters without which two names are less alike than least; a common beginning of one to four raises a likeness, and so asks for fewer."""
    begin = lambda k: F.substring("a_name", 1, k) == F.substring("b_name", 1, k)
    out = None
    for k in (4, 3, 2, 1, 0):
        jaro = (least - 0.1 * k) / (1 - 0.1 * k)
        need = F.ceil(F.lit(3 * jaro - 1) * F.col("_la") * F.col("_lb") / (F.col("_la") + F.col("_lb")) - 1e-9)
        out = F.when(begin(k), need) if out is None else out.when(begin(k), need) if k else out.otherwise(need)
    return out


def like_names(a: DataFrame, b: DataFrame, block: list[str], least: float, every_b: DataFrame | None = None) -> DataFrame:
    """(block, a_name, b_name, similarity) of the distinct names of a block that are alike by Jaro-Winkler; least from 0.4.

    A block's pairs are not all formed. A likeness of at least `least` needs a Jaro similarity of (least - 0.4) / 0.6,
    and so, for two lengths, a number of common characters; hence two such names share one of the first few of
    their numbered characters in any fixed order, and meet by it, and by the two lengths. They are looked at
    once, at the first that they share, and measured only if they have as many characters in common as names
    with their common beginning need. every_b: cheaper rows than b with at least the lengths of its names.
    """
    jaro = (least - 0.4) / 0.6
    length, need = F.length("name"), F.ceil(F.lit(3 * jaro - 1) * F.col("_la") * F.col("_lb") / (F.col("_la") + F.col("_lb")) - 1e-9)
    lengths = lambda df: F.broadcast(df.agg(F.collect_set(length).alias("_lengths")))  # noqa: E731  a number for each length

    def keyed(df: DataFrame, own: str, partner: str, others: DataFrame, to: str) -> DataFrame:
        named = df.where("name != ''").crossJoin(lengths(others))
        rows = named.select(*block, F.col("name").alias(to), length.alias(own), numbered(F.col("name")).alias("_all"), F.explode("_lengths").alias(partner))
        rows = rows.where(need <= F.least("_la", "_lb")).withColumn(f"{to}_first", F.slice("_all", 1, (F.col(own) - need + 1).cast("int")))
        return rows.select(*block, "_la", "_lb", to, f"{to}_first", F.col("_all").alias(f"{to}_all"), F.explode(f"{to}_first").alias("_token"))

    met = keyed(a, "_la", "_lb", b if every_b is None else every_b, "a_name").join(keyed(b, "_lb", "_la", a, "b_name"), [*block, "_la", "_lb", "_token"])
    once = met.where(F.col("_token") == F.array_min(F.array_intersect("a_name_first", "b_name_first")))
    once = once.where(F.size(F.array_intersect("a_name_all", "b_name_all")) >= enough(least))
    return once.select(*block, "a_name", "b_name", jaro_winkler("a_name", "b_name").alias("similarity")).where(F.col("similarity") >= least)


def by_name(a: DataFrame, b: DataFrame, block: list[str], least: float = 0.9, every_b: DataFrame | None = None) -> DataFrame:
    """(b_id, a_id, similarity): the most alike name of the same block, left out where two contacts are equally alike."""
    held = a.groupBy(*block, "name").agg(F.min("a_id").alias("a_id"), F.count("*").alias("_n")).where(F.col("name").isNotNull())
    asked = b.select(*block, "name").where(F.col("name").isNotNull()).distinct()
    found = like_names(held, asked, block, least, every_b)
    first = W.partitionBy(*block, "b_name").orderBy(F.desc("similarity"), "a_name")
    best = found.withColumns({"_k": F.row_number().over(first), "_next": F.lead("similarity").over(first)}).where("_k = 1 AND (_next IS NULL OR _next < similarity)")
    alone = best.join(held.withColumnRenamed("name", "a_name").where("_n = 1"), [*block, "a_name"]).select(*block, F.col("b_name").alias("name"), "a_id", "similarity")
    return b.join(alone, [*block, "name"]).select("b_id", "a_id", "similarity")


def match(a: DataFrame, b: DataFrame, phone: Column, block: list[str], least: float = 0.9) -> DataFrame:
    """(b_id, a_id, how): by telephone; for the contacts of b without such a match, by name."""
    found = by_key(a, b, phone)
    rest = b.join(found.select("b_id").distinct(), "b_id", "left_anti")
    return found.withColumn("how", F.lit("phone")).unionByName(by_name(a, rest, block, least, b).select("b_id", "a_id", F.lit("name").alias("how")))


def quality(matches: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """(method, pairs, correct, expected) of matches (b_id, a_id), against truth (b_id, true_a_id)."""
    known = truth.where("true_a_id IS NOT NULL")
    expected = known.agg(F.count("*").alias("expected"))
    out = None
    for method, found in matches.items():
        right = found.join(known, "b_id", "left").agg(F.lit(method).alias("method"), F.count("*").alias("pairs"), F.count_if(F.col("true_a_id") == F.col("a_id")).alias("correct"))
        out = right if out is None else out.unionByName(right)
    return out.crossJoin(F.broadcast(expected))
