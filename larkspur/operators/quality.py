"""Assertions over tables, what fails them, and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows, failed, passed) of row rules, all in one pass; a null verdict fails."""
    failed = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    one = df.agg(F.count("*").alias("_rows"), *failed)
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failed")) for n in rules)))
    return one.select("_rows", pairs.alias("p")).select("p.rule", F.col("_rows").alias("rows"), "p.failed", (F.col("p.failed") == 0).alias("passed"))


def split_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of those they break."""
    broken = F.concat_ws(",", *(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    judged = df.withColumn("_broken", broken)
    return judged.where("_broken = ''").drop("_broken"), judged.where("_broken != ''").withColumnRenamed("_broken", "broken")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, or have a null, and how often."""
    null = " OR ".join(f"{k} IS NULL" for k in key)
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(f"n > 1 OR {null}")


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """One row: children with a value, and those whose parent is missing."""
    keys = parent.select(F.col(key).alias(column), F.lit(True).alias("_there")).distinct()
    held = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    return held.join(keys, column, "left").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("with_value"), F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"))


def quarantine(df: DataFrame, rule: Column, key: str, name: str, most: int = 100) -> DataFrame:
    """(rule, key, row as JSON) of up to so many rows that break a rule: a report, not a filter."""
    return df.where(~F.coalesce(rule, F.lit(False))).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("row")).orderBy("key").limit(most)


def drop_against_mean(daily: DataFrame, day: str, n: str, days: int = 7, share: float = 0.5) -> DataFrame:
    """Days whose count is less than a share of the mean of the days before."""
    from pyspark.sql import Window as W

    mean = F.avg(n).over(W.partitionBy().orderBy(day).rowsBetween(-days, -1))  # a row a day: a small table by nature
    return daily.withColumn("mean_before", mean).where(F.col(n) < share * F.col("mean_before"))


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, distinct values (approximate, by a sketch of 5 % standard error), least and greatest as text, longest text. One pass."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        simple = isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        text = c.cast("string") if simple else F.to_json(F.struct(c))
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count("*").alias("rows"),
                F.count_if(c.isNull()).alias("nulls"),
                F.approx_count_distinct(text).alias("values"),
                (F.min(c) if simple else F.min(text)).cast("string").alias("least"),
                (F.max(c) if simple else F.max(text)).cast("string").alias("greatest"),
                F.max(F.length(text)).cast("long").alias("longest"),
            )
        )
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def top_values(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """The most frequent values of a column: a report."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


#: Names of columns that look personal, of which a profile lists no values.
PERSONAL = "phone|mobile|tel|mail|name|addr|id_card|id_no|passport|cert|birth|ssn|contact|手机|电话|邮箱|姓名|名字|地址|身份证|证件|生日"
#: Formats of texts, each by a pattern that the whole value has to match.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?![0-9]{4}-[0-9]{2}-[0-9]{2}$)\+?[0-9][0-9 ()-]{6,18}[0-9]",
    "whole": r"[+-]?[0-9]+",
    "decimal": r"[+-]?[0-9]+\.[0-9]+",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "time": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?",
    "uuid": r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "url": r"https?://[^ ]+",
    "json": r"[\[{].*[\]}]",
}
#: Values of a list of the most frequent ones, longest value that one may hold, and values of a column up to which all are counted.
LISTED, LONGEST, COUNTED = 50, 64, 50


def profile_batch(df: DataFrame) -> DataFrame:
    """A mergeable profile of one batch, a row for each column, in one pass; of counts, ends and sketches alone, so that it may be stored.

    rows, nulls, distinct (a HyperLogLog sketch), quantiles (a KLL sketch, of numbers), least and greatest (not of
    texts), shortest and longest text, formats (how many texts match each), and held: the distinct values of a text
    with their counts as long as there are no more than COUNTED, none beyond.
    """
    parts = []
    for f in df.schema.fields:
        c, texts = F.col(f"`{f.name}`"), isinstance(f.dataType, T.StringType)
        number = isinstance(f.dataType, T.NumericType)
        simple = number or isinstance(f.dataType, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        text = c if texts else c.cast("string") if simple else F.to_json(F.struct(c))
        formats = [F.count_if(F.regexp_like(c, F.lit(f"^(?s:{p})$"))).alias(n) if texts else F.lit(0).cast("long").alias(n) for n, p in FORMATS.items()]
        ends = [(a(c).cast("double") if number else F.lit(None).cast("double")).alias(n) for a, n in ((F.min, "least_number"), (F.max, "greatest_number"))]
        ends += [(a(c).cast("string") if simple and not number else F.lit(None).cast("string")).alias(n) for a, n in ((F.min, "least_text"), (F.max, "greatest_text"))]
        sketch = F.kll_sketch_agg_double(c.cast("double")) if number else F.lit(None).cast("binary")
        lengths = [(a(F.length(c)) if texts else F.lit(None)).cast("long").alias(n) for a, n in ((F.min, "shortest"), (F.max, "longest"))]
        parts.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"),
            F.hll_sketch_agg(text).alias("distinct"), sketch.alias("quantiles"), *ends, *lengths, F.struct(*formats).alias("formats"),
        ))
    one = df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
    return one.join(held_texts(df), "column", "left")


def held_texts(df: DataFrame) -> DataFrame:
    """(column, held) of the text columns with few values: each value and how often it occurs; counted by Spark's grouping, and a column dropped once it has more."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, held array<struct<value: string, n: bigint>>")
    pairs = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in texts)))).where("value IS NOT NULL")
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= COUNTED).select("column")
    return counts.join(few, "column", "left_semi").groupBy("column").agg(F.collect_list(F.struct("value", "n")).alias("held"))  # of COUNTED values


def merge_profiles(batches: DataFrame) -> DataFrame:
    """Stored profiles of batches as one: the rows of each column are merged, in any order and any number of times over."""
    add = lambda c: F.sum(c).alias(c)
    whole = batches.groupBy("column", "type").agg(
        add("rows"), add("nulls"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        *(a(n).alias(n) for a, n in ((F.min, "least_number"), (F.max, "greatest_number"), (F.min, "least_text"), (F.max, "greatest_text"), (F.min, "shortest"), (F.max, "longest"))),
        F.struct(*(F.sum(f"formats.{n}").alias(n) for n in FORMATS)).alias("formats"), F.bool_and((F.col("rows") == F.col("nulls")) | F.col("held").isNotNull()).alias("_all"),
    )
    values = batches.select("column", F.inline("held")).groupBy("column", "value").agg(F.sum("n").alias("n"))
    few = values.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= COUNTED).select("column")
    held = values.join(few, "column", "left_semi").groupBy("column").agg(F.collect_list(F.struct("value", "n")).alias("held"))
    out = whole.join(held, "column", "left")
    return out.withColumn("held", F.when(F.col("_all"), F.col("held"))).drop("_all").select(batches.columns)


def read_profile(profile: DataFrame) -> DataFrame:
    """What a profile says: (column, type, rows, null_rate, values, median, least, greatest, shortest, longest, format, top).

    format: one that at least half of the texts have, the one with the most. top: the most frequent values, of a
    text column with few and short ones whose name does not look personal and of which none is an address or number to reach someone.
    """
    there = F.col("rows") - F.col("nulls")
    best = F.array_sort(F.array(*(F.struct((-F.col(f"formats.{n}")).alias("n"), F.lit(n).alias("name")) for n in FORMATS)))[0]
    listed = ~F.regexp_like(F.lower("column"), F.lit(PERSONAL)) & (F.col("formats.email") + F.col("formats.phone") == 0) & (F.col("longest") <= LONGEST)
    top = F.transform(F.slice(F.array_sort(F.transform("held", lambda x: F.struct((-x["n"]).alias("n"), x["value"].alias("value")))), 1, LISTED), lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("n")))
    return profile.select(
        "column", "type", "rows", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).alias("null_rate"), F.hll_sketch_estimate("distinct").alias("values"),
        F.when(F.col("least_number").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"),
        F.coalesce(F.col("least_number").cast("string"), "least_text").alias("least"), F.coalesce(F.col("greatest_number").cast("string"), "greatest_text").alias("greatest"), "shortest", "longest",
        F.when((there > 0) & (-best["n"] * 2 >= there), best["name"]).alias("format"), F.when(listed, top).alias("top"),
    )
