"""Ready-made customer analyses over one shape of orders.

All take qualifying orders: (consumer_id, day, amount), one row an order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut

from . import ranks


def qualifying(orders: DataFrame, identities: DataFrame, statuses: list[str], as_of: date, lookback: int | None = None) -> DataFrame:
    """(consumer_id, order_id, day, amount) of orders that count: status, linked consumer, and trade date in the lookback that ends with as_of.

    The trade date is the UTC date of the payment, or of the order where it has none.
    """
    day = F.to_date(F.coalesce("paid_at", "created_at"))
    rows = orders.where(F.col("status").isin(*statuses)).withColumn("day", day).where(F.col("day") <= F.lit(as_of))
    if lookback:
        rows = rows.where(F.col("day") >= F.date_sub(F.lit(as_of), lookback - 1))
    links = identities.select(F.col("_source").alias("_customer_source"), "customer_id", "consumer_id")
    return rows.join(links, ["_customer_source", "customer_id"]).select("consumer_id", "order_id", "day", "amount")


def per_consumer(q: DataFrame, as_of: date) -> DataFrame:
    days = lambda a, b: F.datediff(a, b).cast("long")
    return q.groupBy("consumer_id").agg(
        F.count("*").alias("orders"),
        F.sum("amount").alias("monetary"),
        F.min("day").alias("first_order_date"),
        F.max("day").alias("last_order_date"),
        days(F.lit(as_of), F.max("day")).alias("recency_days"),
        days(F.lit(as_of), F.min("day")).alias("tenure_days"),
    )


def rfm(q: DataFrame, as_of: date, segments: list[tuple[str, str]], thresholds: dict[str, list[float]] | None = None, otherwise: str = "other") -> DataFrame:
    """consumer_id, recency_days, frequency, monetary, r, f, m (1 to 5) and segment: the first condition over r, f and m that holds.

    Fifths by rank, or by thresholds: four ascending bounds a measure. Frequency and money gain a step at each
    bound that they reach, recency loses one at each that it exceeds.
    """
    c = per_consumer(q, as_of).select("consumer_id", "recency_days", F.col("orders").alias("frequency"), "monetary")
    if thresholds:
        reach = lambda name: 1 + sum((F.col(name) >= x).cast("long") for x in thresholds[name])
        late = sum((F.col("recency_days") > x).cast("long") for x in thresholds["recency_days"])
        scored = c.withColumns({"r": 5 - late, "f": reach("frequency"), "m": reach("monetary")})
    else:
        c = cut(c)  # one row a consumer, ranked three times
        fifth = lambda name, lead, *ties: ranks.ranked(c, lead, *ties).select("consumer_id", ranks.ntile(5).alias(name))
        scored = c.join(fifth("r", "recency_days", "consumer_id"), "consumer_id").withColumn("r", 6 - F.col("r"))
        scored = scored.join(fifth("f", "frequency", "monetary", "consumer_id"), "consumer_id").join(fifth("m", "monetary", "consumer_id"), "consumer_id")
    segment = F.lit(otherwise)
    for name, condition in reversed(segments):
        segment = F.when(F.expr(condition), name).otherwise(segment)
    return scored.select("consumer_id", "recency_days", "frequency", "monetary", "r", "f", "m", segment.alias("segment"))


def cohort(q: DataFrame, as_of: date, unit: str = "month", periods: int = 12) -> DataFrame:
    """consumer_id, cohort_start (the month, or the week from Monday, of the first order), orders, active_periods (offsets, ascending), of the last cohorts."""
    start = lambda c: F.to_date(F.date_trunc(unit, c))
    q = q.withColumn("_start", start(F.col("day"))).withColumn("cohort_start", F.min("_start").over(W.partitionBy("consumer_id")))
    months = (F.year("_start") - F.year("cohort_start")) * 12 + F.month("_start") - F.month("cohort_start")
    offset = months if unit == "month" else F.datediff("_start", "cohort_start").cast("int") / F.lit(7)
    now = start(F.lit(as_of))
    oldest = F.add_months(now, 1 - periods) if unit == "month" else F.date_sub(now, 7 * (periods - 1))
    rows = q.where(F.col("cohort_start") >= oldest).withColumn("_o", offset.cast("int"))
    return rows.groupBy("consumer_id", "cohort_start").agg(F.count("*").alias("orders"), F.array_sort(F.collect_set("_o")).alias("active_periods"))


def repurchase(q: DataFrame, window_days: int) -> DataFrame:
    """consumer_id, orders, first and second order date, days_to_second, and whether it came within the window, its last day included."""
    order = W.partitionBy("consumer_id").orderBy("day", "order_id")
    r = q.withColumn("_k", F.row_number().over(order))
    nth = lambda k: F.min(F.when(F.col("_k") == k, F.col("day")))
    c = r.groupBy("consumer_id").agg(F.count("*").alias("orders"), nth(1).alias("first_order_date"), nth(2).alias("second_order_date"))
    c = c.withColumn("days_to_second", F.datediff("second_order_date", "first_order_date").cast("long"))
    return c.withColumn("repurchased", F.coalesce(F.col("days_to_second") <= window_days, F.lit(False)))


def churn(q: DataFrame, as_of: date, multiplier: float = 2.0, min_gap: float = 7.0, min_orders: int = 3) -> DataFrame:
    """consumer_id, orders, avg_gap_days, recency_days, silence_ratio (2 places) and at_risk: silent for more than multiplier usual gaps."""
    c = per_consumer(q, as_of).where(F.col("orders") >= min_orders)
    gap = F.datediff("last_order_date", "first_order_date") / (F.col("orders") - 1)
    ratio = F.round((F.col("recency_days") / F.greatest(gap, F.lit(min_gap))).cast("decimal(18,6)"), 2)
    out = c.select("consumer_id", "orders", F.round(gap, 2).alias("avg_gap_days"), "recency_days", ratio.cast("double").alias("silence_ratio"))
    return out.withColumn("at_risk", F.col("silence_ratio") > multiplier)


def clv(q: DataFrame, as_of: date, horizon_days: int = 365, min_tenure_days: int = 30, decay: float = 2.0) -> DataFrame:
    """Expected value over the horizon: mean order, orders a year, and the chance that the consumer is still active. A tenure is min_tenure_days at least."""
    c = per_consumer(q, as_of)
    tenure = F.greatest("tenure_days", F.lit(min_tenure_days))
    mean = F.col("monetary").cast("double") / F.col("orders")
    alive = F.exp(-F.col("recency_days") / F.greatest(tenure / F.col("orders"), F.lit(30.0)) / decay)
    per_year = F.col("orders") * 365.0 / tenure
    value = mean * F.col("orders") * horizon_days / tenure * alive
    return c.select("consumer_id", "orders", "monetary", mean.alias("avg_order_value"), "recency_days", tenure.cast("long").alias("tenure_days"), per_year.alias("freq_per_year"), alive.alias("p_alive"), F.round(value.cast("decimal(28,10)"), 2).cast("decimal(18,2)").alias("clv"))


def user_360(consumers: DataFrame, q: DataFrame, consents: DataFrame, as_of: date, channels: tuple[str, ...] = ("sms", "email", "push", "wechat", "app", "other")) -> DataFrame:
    """Every consumer with orders' totals and whether each channel is granted; those without orders stay, with zeros."""
    totals = per_consumer(q, as_of)
    given = consents.groupBy("consumer_id").agg(*(F.bool_or((F.col("channel") == c) & (F.col("status") == "granted")).alias(f"consent_{c}") for c in channels))
    out = consumers.select("consumer_id").join(totals, "consumer_id", "left").join(given, "consumer_id", "left")
    mean = F.try_divide(F.col("monetary").cast("double"), F.col("orders"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)).alias(c)
    return out.select("consumer_id", zero("orders"), zero("monetary"), F.round(mean, 2).alias("avg_order_value"), "first_order_date", "last_order_date", "recency_days", "tenure_days", *(F.coalesce(f"consent_{c}", F.lit(False)).alias(f"consent_{c}") for c in channels))
