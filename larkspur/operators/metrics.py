"""Metrics and tags declared as data and built as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a dimension value that is missing.
UNLINKED = "未关联"
#: Aggregates whose missing value is 0; the others' is null.
COUNTS = {"count", "count_distinct", "sum"}
#: Aggregates that may be added up over groups.
ADDITIVE = {"count", "sum"}

FILTERS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "is_null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Path:
    """A column reached over many-to-one relations: (table, own key, its key) for each hop, then the column. A key may be several columns."""

    column: str
    hops: tuple[tuple[str, str | tuple[str, ...], str | tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class Metric:
    """agg is count, count_distinct, sum, avg, min, max, latest, earliest, days_since or ratio.

    measure and the fields of filters are columns of the base or paths from it. A ratio has a numerator
    and a denominator, of which only agg, measure and filters count.
    """

    base: str
    agg: str
    measure: str | Path | None = None
    time: str | None = None
    days: int | None = None
    filters: tuple[tuple[str | Path, str, object], ...] = ()
    dimensions: dict[str, Path] = field(default_factory=dict)
    numerator: Metric | None = None
    denominator: Metric | None = None


def link_consumers(rows: DataFrame, identities: DataFrame, *, source: str = "_customer_source", owners: DataFrame | None = None) -> DataFrame:
    """rows with consumer_id, by data source and customer; rows of nobody known are left out.

    owners (device_id, consumer_id): a row without a customer belongs to its device's owner. A customer
    that is not linked is not replaced by the device.
    """
    links = identities.select(F.col("_source").alias(source), "customer_id", "consumer_id")
    if owners is None:
        return rows.join(links, [source, "customer_id"])
    own = owners.select("device_id", F.col("consumer_id").alias("_owner"))
    both = rows.join(links, [source, "customer_id"], "left").join(own, "device_id", "left")
    found = F.coalesce("consumer_id", F.when(F.col("customer_id").isNull(), F.col("_owner")))
    return both.withColumn("consumer_id", found).drop("_owner").where("consumer_id IS NOT NULL")


def reach(df: DataFrame, tables: dict[str, DataFrame], paths: dict[str, Path]) -> DataFrame:
    """df with a column for each path, null where a hop finds nothing. Paths that begin alike share their joins."""
    columns = lambda c: (c,) if isinstance(c, str) else c
    joined: dict[tuple, str] = {}
    own_columns = df.columns
    for path in paths.values():
        for k in range(1, len(path.hops) + 1):
            if path.hops[:k] in joined:
                continue
            table, own, key = path.hops[k - 1]
            ahead, alias = joined.get(path.hops[: k - 1]), f"_j{len(joined)}"
            keys = {f"{alias}_{c}": c for c in columns(key)}
            right = tables[table].select(*(F.col(c).alias(n) for n, c in keys.items()), F.struct("*").alias(alias))
            on = [F.col(f"{ahead}.{a}" if ahead else a) == F.col(n) for a, n in zip(columns(own), keys, strict=True)]
            df = df.join(right, on, "left").drop(*keys)
            joined[path.hops[:k]] = alias
    return df.select(*own_columns, *(F.col(f"{joined[p.hops]}.{p.column}" if p.hops else p.column).alias(n) for n, p in paths.items()))


def filtered(df: DataFrame, metric: Metric, as_of: date) -> DataFrame:
    """Rows in the metric's window (as_of - days, as_of] of UTC dates."""
    if metric.time:
        day = F.to_date(metric.time)
        df = df.where(day <= F.lit(as_of))
        if metric.days:
            df = df.where(day > F.date_sub(F.lit(as_of), metric.days))
    return df


def condition(metric: Metric, names: dict[Path, str]) -> Column | None:
    """All of the metric's filters; a null never passes a comparison."""
    out = None
    for f, op, value in metric.filters:
        c = FILTERS[op](F.col(names.get(f, f)), value)
        out = c if out is None else out & c
    return out


def measure(metric: Metric, as_of: date, names: dict[Path, str], only: Column | None = None) -> Column:
    m = F.lit(1) if metric.measure is None else F.col(names.get(metric.measure, metric.measure))
    m = m if only is None else F.when(only, m)
    match metric.agg:
        case "count":
            return F.count(m)
        case "count_distinct":
            return F.count_distinct(m)
        case "sum":
            return F.sum(m)
        case "avg":
            return F.avg(m)
        case "min":
            return F.min(m)
        case "max":
            return F.max(m)
        case "latest":
            return F.max_by(m, F.struct(F.col(metric.time), m))
        case "earliest":
            return F.min_by(m, F.struct(F.col(metric.time), m))
        case "days_since":
            return F.datediff(F.lit(as_of), F.max(F.to_date(metric.time))).cast("long")
        case "ratio":
            part = lambda p: measure(p, as_of, names, condition(p, names))
            top = F.coalesce(part(metric.numerator), F.lit(0)).cast("double")
            return F.try_divide(top, F.nullif(part(metric.denominator).cast("double"), F.lit(0.0)))
    raise ValueError(f"unknown aggregate {metric.agg}")


def evaluate(metric: Metric, tables: dict[str, DataFrame], as_of: date, by: tuple[str, ...] = ()) -> DataFrame:
    """by, the metric's dimensions (a missing value is UNLINKED), and value, in one aggregate.

    A ratio divides aggregates of the same rows: a numerator without rows counts as 0, a denominator of 0 gives null.
    """
    parts = [m for m in (metric, metric.numerator, metric.denominator) if m]
    wanted = {f for m in parts for f, _, _ in m.filters} | {m.measure for m in parts}
    names = {p: f"_p{k}" for k, p in enumerate(sorted((x for x in wanted if isinstance(x, Path)), key=repr))}
    rows = reach(filtered(tables[metric.base], metric, as_of), tables, {n: p for p, n in names.items()} | {f"_d{k}": p for k, p in enumerate(metric.dimensions.values())})
    rule = condition(metric, names)
    rows = rows if rule is None else rows.where(rule)
    for k, name in enumerate(metric.dimensions):
        rows = rows.withColumn(name, F.coalesce(F.nullif(F.col(f"_d{k}").cast("string"), F.lit("")), F.lit(UNLINKED)))
    return rows.groupBy(*by, *metric.dimensions).agg(measure(metric, as_of, names).alias("value"))


@dataclass(frozen=True)
class Rule:
    """A tag's value and the conditions (metric, operator, value) for it: all of them, or any."""

    value: str
    conditions: tuple[tuple[str, str, object], ...]
    any: bool = False


def tag(population: DataFrame, key: str, metrics: dict[str, tuple[Metric, str]], rules: list[Rule], tables: dict[str, DataFrame], as_of: date, otherwise: str | None = None) -> DataFrame:
    """(key, tag) of everyone in population: the first rule that holds. metrics: each with the base column that holds the key."""
    rows = population.select(key).distinct()
    for name, (metric, own) in metrics.items():
        found = evaluate(metric, tables, as_of, (own,)).select(F.col(own).alias(key), F.col("value").alias(name))
        rows = rows.join(found, key, "left")
        if metric.agg in COUNTS:
            rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast(rows.schema[name].dataType)))
    out = F.lit(otherwise)
    for rule in reversed(rules):
        holds = None
        for name, op, value in rule.conditions:
            c = FILTERS[op](F.col(name), value)
            holds = c if holds is None else holds | c if rule.any else holds & c
        out = F.when(holds, rule.value).otherwise(out)
    return rows.select(key, out.alias("tag"))


def impact(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(before, after, n): how many keys move from one value to another between two results; absent ones show as null."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full").groupBy("before", "after").agg(F.count("*").alias("n"))


def changed_keys(before: DataFrame, after: DataFrame, key: str, value: str = "value") -> DataFrame:
    """One row (changed, added, removed): keys whose values differ as multisets, or that only one result has."""
    values = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.coalesce(F.col(value).cast("string"), F.lit("\0")))).alias(name))
    both = values(before, "_b").join(values(after, "_a"), key, "full")
    gone, new = F.col("_a").isNull(), F.col("_b").isNull()
    return both.agg(F.count_if(~gone & ~new & (F.col("_a") != F.col("_b"))).alias("changed"), F.count_if(new).alias("added"), F.count_if(gone).alias("removed"))


def may_sum(metric: Metric) -> bool:
    """Whether values of groups may be added to that of their union."""
    return metric.agg in ADDITIVE
