"""Identity: which records of several sources are one consumer."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut

from .components import components, meet
from .topn import latest


def match_edges(records: DataFrame, node: str, fields: list[str]) -> DataFrame:
    """Edges (u, v) whose components are those of all links between records.

    Two records are linked if they agree on a field and do not conflict on any field ahead of it. Null
    matches nothing and conflicts with nothing. No pairs are formed: records of a value are split by
    which of the earlier fields they have; two such classes are linked as wholes where the fields they
    share agree, so that a star around the smallest record stands for all their links. Every record goes out
    once for each pair of classes that it is in (at most 7 times for three fields), in one shuffle.
    """
    rules = []
    for k, field in enumerate(fields):
        ahead = fields[:k]
        masks = [m for r in range(k + 1) for m in combinations(ahead, r)]

        def has(mask: tuple[str, ...], field: str = field, ahead: list[str] = ahead) -> Column:
            out = F.col(field).isNotNull()
            for c in ahead:
                out = out & (F.col(c).isNotNull() if c in mask else F.col(c).isNull())
            return out

        for p, (one, two) in enumerate(combinations_with_replacement(masks, 2)):
            key = F.array(F.lit(f"{k}.{p}"), *(F.col(c).cast("string") for c in (field, *(c for c in one if c in two))))
            rules.append(F.when(has(one) | has(two), F.struct(key.alias("key"), has(one).alias("a"), has(two).alias("b"))))
    rows = records.select(F.col(node).alias("n"), F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())))
    stars = rows.groupBy("key").agg(F.min("n").alias("_hub"), F.count("*").alias("_n"), F.bool_or("a").alias("_a"), F.bool_or("b").alias("_b"))
    return rows.join(stars.where("_n > 1 AND _a AND _b"), "key").select(F.col("n").alias("u"), F.col("_hub").alias("v")).where("u != v").distinct()


def without(records: DataFrame, fields: list[str], excluded: DataFrame) -> DataFrame:
    """records with the excluded values (field, value as text) of their fields made null, so that they match nothing."""
    bound = excluded.count()
    for field in fields:
        own = excluded.where(F.col("field") == field).select(F.col("value").alias("_value"), F.lit(True).alias("_out")).distinct()
        keyed = records.withColumn("_value", F.col(field).cast("string"))
        records = meet(keyed, own, "_value", bound, "left").withColumn(field, F.when(F.col("_out").isNull(), F.col(field))).drop("_value", "_out")
    return records


def resolve(records: DataFrame, node: str, fields: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """(node, consumer): the smallest record of each record's group. excluded: (field, value) that link nobody, such as a shared telephone."""
    if excluded is not None:
        records = without(records, fields, excluded)
    roots = components(match_edges(records, node, fields))
    return records.select(F.col(node).alias("node")).join(roots, "node", "left").select(F.col("node").alias(node), F.coalesce("root", "node").alias("consumer"))


def add_late(records: DataFrame, before: DataFrame, late: DataFrame, node: str, fields: list[str]) -> DataFrame:
    """(node, consumer) of all records, of which the late ones (by node) have come after `before` was resolved.

    Whom a late record can link shares a value with it. Only the groups of those are resolved again, as wholes,
    together with the late records; all others stay as they are. The result is that of resolving everything.
    """
    arrived = records.join(late.select(node).distinct(), node, "left_semi")
    values = lambda df: df.select(node, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")).select(node, "p.*").where("value IS NOT NULL")
    hit = values(records).join(values(arrived).select("field", "value").distinct(), ["field", "value"], "left_semi").select(node).distinct()
    groups = before.join(hit, node, "left_semi").select("consumer").distinct()
    again = cut(before.join(groups, "consumer", "left_semi").select(node).unionByName(arrived.select(node)).distinct())
    return before.join(again, node, "left_anti").select(node, "consumer").unionByName(resolve(records.join(again, node, "left_semi"), node, fields))


def hot_values(records: DataFrame, fields: list[str], least: int = 10, most: int = 20) -> DataFrame:
    """(field, value, n) of the values that most records share."""
    pairs = records.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")).select("p.*")
    counted = pairs.where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), "field", "value").limit(most)


def stable_ids(now: DataFrame, before: DataFrame, node: str) -> DataFrame:
    """now's (node, consumer) with the id that each group keeps: that of an earlier group of which it owns more than half.

    before: (node, consumer, assigned_at). If a group owns several, the earliest assigned stays, then the
    smaller id; a group that owns none has its own new id. Two windows over groups, not records.
    """
    sizes = before.groupBy(F.col("consumer").alias("old")).agg(F.count("*").alias("size"), F.min("assigned_at").alias("since"))
    shared = now.join(before.select(node, F.col("consumer").alias("old")), node).groupBy("consumer", "old").agg(F.count("*").alias("n"))
    owned = shared.join(sizes, "old").where("2 * n > size")
    kept = owned.groupBy("consumer").agg(F.min_by("old", F.struct("since", "old")).alias("_kept"))
    return now.join(kept, "consumer", "left").select(node, F.coalesce("_kept", "consumer").alias("consumer"))


def device_owners(logins: DataFrame, device: str, consumer: str, ts: str) -> DataFrame:
    """Last login's consumer of each device; at the same time the smaller id."""
    return logins.groupBy(device).agg(F.min_by(consumer, F.struct(-F.unix_micros(F.col(ts).cast("timestamp")), F.col(consumer))).alias(consumer), F.max(ts).alias(ts))


def survivors(records: DataFrame, consumer: str, attributes: list[str], order: list[str], source: str) -> DataFrame:
    """One row a consumer: of each attribute the first value that is not null by order, and the source it comes from."""
    rank = F.struct(*(F.col(c) for c in order))
    picks = []
    for a in attributes:
        there = F.when(F.col(a).isNotNull(), rank)
        picks += [F.min_by(a, there).alias(a), F.min_by(source, there).alias(f"{a}__source")]
    return records.groupBy(consumer).agg(*picks)


def consents(rows: DataFrame, consumer: str, channel: str, status: str, ts: str) -> DataFrame:
    """Last status of each consumer and channel; revoked wins at the same instant."""
    return latest(rows.select(consumer, channel, status, ts).withColumn("_no", (F.col(status) == "revoked").cast("int")), [consumer, channel], [ts, "_no"]).drop("_no")


def chains(merges: DataFrame, most: int = 20) -> DataFrame:
    """(old, current) of a table of merges (old, new): followed until none goes on, in at most `most` doublings."""
    now = merges.select("old", F.col("new").alias("current"))
    for _ in range(most):
        onward = now.select(F.col("old").alias("current"), F.col("current").alias("_next"))
        step = now.join(onward, "current", "left")
        if step.where("_next IS NOT NULL").isEmpty():
            break
        now = cut(step.select("old", F.coalesce("_next", "current").alias("current")))
    return now


def point_chain_breaks(log: DataFrame, member: str, ts: str, number: str, change: str, balance: str) -> DataFrame:
    """Rows whose balance is not the one before plus the change, by time and then number."""
    before = F.lag(balance).over(W.partitionBy(member).orderBy(ts, number))
    return log.withColumn("expected", before + F.col(change)).where(F.col("expected").isNotNull() & (F.col("expected") != F.col(balance)))
