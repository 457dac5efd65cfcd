"""Customer analyses over the driver's tables: orders, events and parts stand for a shop's data.

Dates are counted from AS_OF. Statuses F and O stand for paid and refunded orders, P for pending ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut
from larkspur.operators import asof, geo, ranks, sessions, topn

from .registry import query
from .relational import small, t

AS_OF = "2002-01-01"
CLEAN_SQL = "clean AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderdate::DATE AS day, o_totalprice > 2500 AS big FROM orders WHERE o_orderstatus IN ('F', 'O'))"


def clean(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") > 2500).alias("big"))


def days(a, b) -> F.Column:
    """Calendar days from b to a, as long."""
    return F.datediff(a, b).cast("long")


def as_of() -> F.Column:
    return F.to_date(F.lit(AS_OF))


@query(f"WITH {CLEAN_SQL} SELECT * FROM clean")
def d1_clean_orders(spark, sf_dir):
    return clean(spark, sf_dir)


@query("SELECT user_id % 50 AS device, arg_max(user_id, ts) AS user_id FROM events GROUP BY 1")
def d2_device_owner_map(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("device")).agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("user_id"))


SESSIONS_SQL = """s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))"""


def sessionized(spark, sf_dir) -> DataFrame:
    return sessions.sessionize(t(spark, sf_dir, "events"), "user_id", "ts", tie="event_id")


@query(f"WITH {SESSIONS_SQL} SELECT event_id, user_id, ts, session_no, user_id || '-' || session_no AS session_id FROM s")
def d3_sessions(spark, sf_dir):
    return sessionized(spark, sf_dir).select("event_id", "user_id", "ts", "session_no", "session_id")


@query(f"WITH {SESSIONS_SQL} SELECT user_id, session_no, min(ts) AS began, count(*) AS events, count(DISTINCT event_type) AS kinds, date_diff('second', min(ts), max(ts))::BIGINT AS seconds FROM s GROUP BY ALL")
def r5_session_windows(spark, sf_dir):
    seconds = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return sessionized(spark, sf_dir).groupBy("user_id", "session_no").agg(F.min("ts").alias("began"), F.count("*").alias("events"), F.countDistinct("event_type").alias("kinds"), seconds.alias("seconds"))


@query(
    f"""WITH {CLEAN_SQL}, o AS (SELECT o_custkey AS k, count(*) AS orders, round(sum(o_totalprice), 2) AS spent, min(day) AS first_day, max(day) AS last_day FROM clean GROUP BY 1),
    i AS (SELECT o_custkey AS k, round(sum(l_quantity), 2) AS units, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN clean ON l_orderkey = o_orderkey GROUP BY 1),
    b AS (SELECT k, p_brand AS brand FROM (SELECT o_custkey AS k, p_brand, count(*) AS n FROM lineitem JOIN clean ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, p_brand) = 1),
    e AS (SELECT user_id AS k, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1)
    SELECT c_custkey, n_name, c_mktsegment, coalesce(orders, 0) AS orders, coalesce(spent, 0) AS spent, first_day, last_day, date_diff('day', last_day, DATE '{AS_OF}')::BIGINT AS recency, coalesce(units, 0) AS units, coalesce(parts, 0) AS parts, brand, coalesce(events, 0) AS events, coalesce(purchases, 0) AS purchases
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON o.k = c_custkey LEFT JOIN i ON i.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN e ON e.k = c_custkey"""
)
def d4_user_360(spark, sf_dir):
    """One row per customer from inputs that each have one row per customer; all joins share the key's partitioning."""
    paid = clean(spark, sf_dir)
    o = paid.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(paid.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), F.expr("l_orderkey = o_orderkey"))
    i = lines.groupBy("c_custkey").agg(F.round(F.sum("l_quantity"), 2).alias("units"), F.countDistinct("l_partkey").alias("parts"))
    brands = lines.join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
    b = topn.mode_by(brands, ["c_custkey"], "p_brand").select("c_custkey", F.col("p_brand").alias("brand"))
    e = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    out = t(spark, sf_dir, "customer").join(small(t(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    for part in (o, i, b, e):
        out = out.join(part, "c_custkey", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in ("orders", "spent", "units", "parts", "events", "purchases")}
    return out.select("c_custkey", "n_name", "c_mktsegment", zero["orders"], zero["spent"], "first_day", "last_day", days(as_of(), F.col("last_day")).alias("recency"), zero["units"], zero["parts"], "brand", zero["events"], zero["purchases"])


@query(
    f"""WITH {CLEAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM clean),
    c AS (SELECT o_custkey, count(*) AS n, date_diff('day', min(day) FILTER (k = 1), min(day) FILTER (k = 2)) AS to_second, date_diff('day', min(day), max(day)) / (count(*) - 1) AS gap FROM r GROUP BY 1)
    SELECT count(*) AS buyers, count(*) FILTER (n > 1) AS repeaters, round(median(to_second), 4) AS median_days, round(avg(CASE WHEN n > 1 THEN gap END), 4) AS mean_gap, count(*) FILTER (to_second <= 30) AS in30, count(*) FILTER (to_second <= 90) AS in90 FROM c"""
)
def d5_repurchase(spark, sf_dir):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    r = clean(spark, sf_dir).withColumn("_k", F.row_number().over(order))
    day = lambda k: F.min(F.when(F.col("_k") == k, F.col("day")))
    c = r.groupBy("o_custkey").agg(F.count("*").alias("n"), days(day(2), day(1)).alias("to_second"), F.try_divide(days(F.max("day"), F.min("day")).cast("double"), F.count("*") - 1).alias("gap"))
    return c.agg(
        F.count("*").alias("buyers"),
        F.count_if(F.col("n") > 1).alias("repeaters"),
        F.round(F.median("to_second"), 4).alias("median_days"),
        F.round(F.avg(F.when(F.col("n") > 1, F.col("gap"))), 4).alias("mean_gap"),
        F.count_if(F.col("to_second") <= 30).alias("in30"),
        F.count_if(F.col("to_second") <= 90).alias("in90"),
    )


@query(
    f"""WITH {CLEAN_SQL}, c AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM clean GROUP BY 1), b AS (SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '>10' END AS band, n, s FROM c)
    SELECT band, count(*) AS customers, round(sum(s), 2) AS spent, round(sum(s) / sum(sum(s)) OVER (), 6) AS share FROM b GROUP BY band"""
)
def d6_contribution_bands(spark, sf_dir):
    c = clean(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    n = F.col("n")
    band = F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise(">10")
    b = c.groupBy(band.alias("band")).agg(F.count("*").alias("customers"), F.sum("s").alias("_s"))
    return b.select("band", "customers", F.round("_s", 2).alias("spent"), F.round(F.col("_s") / F.sum("_s").over(W.partitionBy()), 6).alias("share"))


@query(
    f"""WITH {CLEAN_SQL}, f AS (SELECT o_custkey, min(date_trunc('month', day))::DATE AS cohort FROM clean GROUP BY 1), m AS (SELECT DISTINCT cohort, o_custkey, date_diff('month', cohort, day)::BIGINT AS m FROM clean JOIN f USING (o_custkey)),
    n AS (SELECT cohort, m, count(*) AS active FROM m WHERE m <= 12 GROUP BY ALL)
    SELECT cohort, m, active, round(active / max(active) FILTER (m = 0) OVER (PARTITION BY cohort), 6) AS retention FROM n"""
)
def d7_cohort_retention(spark, sf_dir):
    month = F.trunc("day", "month")  # a customer's months are few, so that one shuffle brings them together
    paid = clean(spark, sf_dir).groupBy("o_custkey").agg(F.min(month).alias("cohort"), F.collect_set(month).alias("_m")).select("cohort", F.explode("_m").alias("month"))
    m = (F.year("month") - F.year("cohort")) * 12 + F.month("month") - F.month("cohort")
    n = paid.select("cohort", m.cast("long").alias("m")).where("m <= 12").groupBy("cohort", "m").agg(F.count("*").alias("active"))
    first = F.max(F.when(F.col("m") == 0, F.col("active"))).over(W.partitionBy("cohort"))
    return n.select("cohort", "m", "active", F.round(F.col("active") / first, 6).alias("retention"))


def rfm(spark, sf_dir) -> DataFrame:
    c = cut(clean(spark, sf_dir).groupBy("o_custkey").agg(days(as_of(), F.max("day")).alias("recency"), F.count("*").alias("frequency"), F.round(F.sum("o_totalprice"), 2).alias("monetary")))
    fifth = lambda name, lead, *ties: ranks.ranked(c, lead, *ties).select("o_custkey", ranks.ntile(5).alias(name))
    r = fifth("_r", "recency", "o_custkey")
    f = fifth("f", "frequency", "monetary", "o_custkey")
    m = fifth("m", "monetary", "o_custkey")
    scored = c.join(r, "o_custkey").join(f, "o_custkey").join(m, "o_custkey").withColumn("r", 6 - F.col("_r")).drop("_r")
    high = lambda x: F.col(x) >= 4
    segment = (
        F.when(high("r") & high("f") & high("m"), "champion").when(high("r") & high("f"), "loyal").when(high("r") & high("m"), "big spender").when(high("r"), "recent")
        .when(high("f") & high("m"), "at risk").when(high("f"), "slipping").when(high("m"), "big but gone").otherwise("lost")
    )
    return scored.withColumn("segment", segment)


RFM_SQL = f"""{CLEAN_SQL}, c AS (SELECT o_custkey, date_diff('day', max(day), DATE '{AS_OF}')::BIGINT AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM clean GROUP BY 1),
q AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency, o_custkey) AS r, ntile(5) OVER (ORDER BY frequency, monetary, o_custkey) AS f, ntile(5) OVER (ORDER BY monetary, o_custkey) AS m FROM c),
rfm AS (SELECT *, CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'champion' WHEN r >= 4 AND f >= 4 THEN 'loyal' WHEN r >= 4 AND m >= 4 THEN 'big spender' WHEN r >= 4 THEN 'recent' WHEN f >= 4 AND m >= 4 THEN 'at risk' WHEN f >= 4 THEN 'slipping' WHEN m >= 4 THEN 'big but gone' ELSE 'lost' END AS segment FROM q)"""


@query(f"WITH {RFM_SQL} SELECT o_custkey, recency, frequency, monetary, r, f, m, segment FROM rfm")
def d8_rfm(spark, sf_dir):
    return rfm(spark, sf_dir)


@query(f"WITH {RFM_SQL} SELECT segment, count(*) AS customers, round(avg(recency), 4) AS recency, round(sum(monetary), 2) AS monetary FROM rfm GROUP BY segment")
def d8_rfm_segments(spark, sf_dir):
    return rfm(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("customers"), F.round(F.avg("recency"), 4).alias("recency"), F.round(F.sum("monetary"), 2).alias("monetary"))


VALUE_SQL = f"""{CLEAN_SQL}, v AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, date_diff('day', min(day), DATE '{AS_OF}') AS tenure, date_diff('day', max(day), DATE '{AS_OF}') AS recency, date_diff('day', min(day), max(day)) AS span FROM clean GROUP BY 1)"""


def value(spark, sf_dir) -> DataFrame:
    return clean(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), days(as_of(), F.min("day")).alias("tenure"), days(as_of(), F.max("day")).alias("recency"), days(F.max("day"), F.min("day")).alias("span"))


@query(
    f"""WITH {VALUE_SQL} SELECT o_custkey, n, round(n * 365.0::DOUBLE / greatest(tenure, 30), 6) AS per_year, round(exp(-recency / greatest(tenure / n, 30.0::DOUBLE) / 2), 6) AS p_alive,
    round(s / n * (n * 365.0::DOUBLE / greatest(tenure, 30)) * exp(-recency / greatest(tenure / n, 30.0::DOUBLE) / 2), 2) AS clv FROM v"""
)
def d9_lifetime_value(spark, sf_dir):
    per_year = F.col("n") * 365.0 / F.greatest(F.col("tenure"), F.lit(30))
    alive = F.exp(-F.col("recency") / F.greatest(F.col("tenure") / F.col("n"), F.lit(30.0)) / 2)
    return value(spark, sf_dir).select("o_custkey", "n", F.round(per_year, 6).alias("per_year"), F.round(alive, 6).alias("p_alive"), F.round(F.col("s") / F.col("n") * per_year * alive, 2).alias("clv"))


@query(f"WITH {VALUE_SQL} SELECT o_custkey, round(span / (n - 1), 4) AS gap, recency::BIGINT AS recency, recency > 2 * greatest(span / (n - 1), 7.0::DOUBLE) AS at_risk FROM v WHERE n >= 3")
def d10_churn(spark, sf_dir):
    gap = F.col("span") / (F.col("n") - 1)
    return value(spark, sf_dir).where("n >= 3").select("o_custkey", F.round(gap, 4).alias("gap"), "recency", (F.col("recency") > 2 * F.greatest(gap, F.lit(7.0))).alias("at_risk"))


@query(
    f"""WITH {VALUE_SQL}, e AS (SELECT user_id AS k, count(*) AS x FROM events WHERE event_type != 'error' GROUP BY 1), i AS (SELECT c_custkey // 3 AS k, count(*) AS x FROM customer WHERE c_custkey // 3 != c_custkey GROUP BY 1),
    b AS (SELECT o_custkey AS k, count(DISTINCT p_brand) AS x, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
    m AS (SELECT o_custkey, n, s, recency, coalesce(e.x, 0) AS engaged, coalesce(b.x, 0) AS breadth, coalesce(i.x, 0) AS invited, coalesce(b.r, 0) AS returned FROM v LEFT JOIN e ON e.k = o_custkey LEFT JOIN b ON b.k = o_custkey LEFT JOIN i ON i.k = o_custkey),
    p AS (SELECT o_custkey, 1 - percent_rank() OVER (ORDER BY recency) AS recent, percent_rank() OVER (ORDER BY n) AS often, percent_rank() OVER (ORDER BY s) AS money, percent_rank() OVER (ORDER BY engaged) AS engaged, percent_rank() OVER (ORDER BY breadth) AS breadth,
      percent_rank() OVER (ORDER BY invited) AS invited, 1 - percent_rank() OVER (ORDER BY returned) AS kept FROM m)
    SELECT o_custkey, round(100 * (0.25::DOUBLE * recent + 0.25::DOUBLE * often + 0.2::DOUBLE * money + 0.1::DOUBLE * engaged + 0.08::DOUBLE * breadth + 0.07::DOUBLE * invited + 0.05::DOUBLE * kept), 4) AS score FROM p"""
)
def d11_loyalty_score(spark, sf_dir):
    """Seven measures by their percent_rank, weighted: recency, frequency, money, engagement, variety, invitations and few returns."""
    k = F.col("o_custkey")
    engaged = t(spark, sf_dir, "events").where("event_type != 'error'").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("engaged"))
    invited = t(spark, sf_dir, "customer").select(F.expr("c_custkey div 3").alias("o_custkey"), "c_custkey").where("o_custkey != c_custkey").groupBy("o_custkey").agg(F.count("*").alias("invited"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("back"))
    bought = lines.join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).join(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    brands = bought.groupBy("o_custkey").agg(F.countDistinct("p_brand").alias("breadth"), F.sum("back").alias("returned"))
    v = value(spark, sf_dir).select("o_custkey", "n", "s", "recency")
    for part in (engaged, brands, invited):
        v = v.join(part, "o_custkey", "left")
    v = cut(v.na.fill(0, ["engaged", "breadth", "returned", "invited"]))
    measures = ("recency", "n", "s", "engaged", "breadth", "invited", "returned")
    p = ranks.percent_ranks(v, "o_custkey", {f"p_{m}": m for m in measures})
    up, down = (lambda m: F.col(f"p_{m}")), (lambda m: 1 - F.col(f"p_{m}"))
    score = 0.25 * down("recency") + 0.25 * up("n") + 0.2 * up("s") + 0.1 * up("engaged") + 0.08 * up("breadth") + 0.07 * up("invited") + 0.05 * down("returned")
    return p.select(k, F.round(100 * score, 4).alias("score"))


@query(
    f"""WITH {CLEAN_SQL}, q AS (SELECT DISTINCT date_trunc('quarter', day)::DATE AS quarter FROM clean), s AS (SELECT o_custkey, date_trunc('quarter', day)::DATE AS quarter, sum(o_totalprice) AS s FROM clean GROUP BY ALL),
    g AS (SELECT c.o_custkey, q.quarter, coalesce(s, 0) AS s FROM (SELECT DISTINCT o_custkey FROM clean) c CROSS JOIN q LEFT JOIN s ON s.o_custkey = c.o_custkey AND s.quarter = q.quarter),
    b AS (SELECT o_custkey, quarter, CASE WHEN s = 0 THEN 'none' WHEN s < 500 THEN 'low' WHEN s < 2000 THEN 'mid' ELSE 'high' END AS band FROM g),
    n AS (SELECT band, lead(band) OVER (PARTITION BY o_custkey ORDER BY quarter) AS later FROM b)
    SELECT band, count(*) FILTER (later = 'none') AS "none", count(*) FILTER (later = 'low') AS low, count(*) FILTER (later = 'mid') AS mid, count(*) FILTER (later = 'high') AS high FROM n WHERE later IS NOT NULL GROUP BY band"""
)
def d12_band_migration(spark, sf_dir):
    s = clean(spark, sf_dir).groupBy("o_custkey", F.to_date(F.date_trunc("quarter", "day")).alias("quarter")).agg(F.sum("o_totalprice").alias("s"))
    quarters = s.select("quarter").distinct()  # a row per calendar quarter: a small dimension by nature
    grid = s.select("o_custkey").distinct().crossJoin(F.broadcast(quarters)).join(s, ["o_custkey", "quarter"], "left")
    x = F.coalesce("s", F.lit(0.0))
    b = grid.select("o_custkey", "quarter", F.when(x == 0, "none").when(x < 500, "low").when(x < 2000, "mid").otherwise("high").alias("band"))
    n = b.select("band", F.lead("band").over(W.partitionBy("o_custkey").orderBy("quarter")).alias("later")).where("later IS NOT NULL")
    return n.groupBy("band").pivot("later", ["none", "low", "mid", "high"]).count().na.fill(0)


@query(
    f"""WITH {SESSIONS_SQL}, f AS (SELECT user_id, session_no, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p FROM s GROUP BY ALL)
    SELECT count(*) AS sessions, count(*) FILTER (v) AS n_view, count(*) FILTER (v AND c) AS n_click, count(*) FILTER (v AND c AND p) AS n_purchase, round(count(*) FILTER (v) / count(*), 6) AS rate_view,
    round(count(*) FILTER (v AND c) / nullif(count(*) FILTER (v), 0), 6) AS rate_click, round(count(*) FILTER (v AND c AND p) / nullif(count(*) FILTER (v AND c), 0), 6) AS rate_purchase FROM f"""
)
def d14_funnel(spark, sf_dir):
    return sessions.funnel(sessionized(spark, sf_dir), "session_id", {k: F.col("event_type") == k for k in ("view", "click", "purchase")})


ASOF_SQL = """a AS (SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts)"""


def attributed(spark, sf_dir, how="inner", slice_seconds=None, within=None) -> DataFrame:
    e = t(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof.asof_join(bought, clicks, ["user_id"], "ts", "click_ts", how=how, slice_seconds=slice_seconds, within=within)


@query(f"WITH {ASOF_SQL} SELECT event_id, user_id, ts, click_id, click_ts FROM a")
def j9_asof_join(spark, sf_dir):
    return attributed(spark, sf_dir)


@query("SELECT p.event_id, p.user_id, p.ts, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def j10_asof_left_join(spark, sf_dir):
    """In slices of a week, so that no user's whole history lies in one task."""
    return attributed(spark, sf_dir, how="left", slice_seconds=7 * 86_400)


@query(
    f"""WITH {ASOF_SQL}, w AS (SELECT *, click_id % 5 AS channel FROM a WHERE ts - click_ts <= INTERVAL 7 DAYS), n AS (SELECT channel, user_id % 10 AS region, count(*) AS n FROM w GROUP BY ALL)
    SELECT region, channel, n, rank() OVER (PARTITION BY region ORDER BY n DESC) AS place FROM n"""
)
def d15_last_touch_attribution(spark, sf_dir):
    w = attributed(spark, sf_dir, within=F.expr("INTERVAL 7 DAYS"))
    n = w.groupBy((F.col("user_id") % 10).alias("region"), (F.col("click_id") % 5).alias("channel")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(W.partitionBy("region").orderBy(F.desc("n"))).cast("long"))


@query(
    """WITH b AS (SELECT DISTINCT l_orderkey AS k, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT k) AS n FROM b), s AS (SELECT item, count(*) AS c FROM b GROUP BY 1),
    p AS (SELECT x.item AS a, y.item AS b, count(*) AS both FROM b x JOIN b y ON x.k = y.k AND x.item < y.item GROUP BY ALL)
    SELECT p.a, p.b, p.both, round(p.both / n.n, 8) AS support, round(p.both / sa.c, 8) AS confidence, round(p.both * n.n / (sa.c * sb.c), 8) AS lift FROM p, n, s sa, s sb WHERE sa.item = p.a AND sb.item = p.b AND p.both >= 3"""
)
def d16_basket_lift(spark, sf_dir):
    """Baskets are orders of a few lines, so that the pairs within one are few; items repeat over baskets, not within."""
    b = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("p_brand").alias("item")).distinct()
    s = b.groupBy("item").agg(F.count("*").alias("c"))
    whole = b.agg(F.countDistinct("k").alias("n"))
    items = b.groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    pairs = items.select(F.posexplode("items").alias("i", "a"), "items").select("a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    p = pairs.groupBy("a", "b").agg(F.count("*").alias("both")).where("both >= 3")
    p = p.join(s.select(F.col("item").alias("a"), F.col("c").alias("ca")), "a").join(s.select(F.col("item").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(whole))
    both = F.col("both")
    return p.select("a", "b", "both", F.round(both / F.col("n"), 8).alias("support"), F.round(both / F.col("ca"), 8).alias("confidence"), F.round(both * F.col("n") / (F.col("ca") * F.col("cb")), 8).alias("lift"))


@query(
    f"""WITH {RFM_SQL}, v AS (SELECT n_name, p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = orders.o_orderkey JOIN rfm ON rfm.o_custkey = orders.o_custkey JOIN customer ON c_custkey = orders.o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE segment IN ('champion', 'loyal') GROUP BY ALL)
    SELECT n_name, p_brand, revenue FROM v QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY revenue DESC, p_brand) <= 3"""
)
def d18_brands_of_loyal_customers(spark, sf_dir):
    loyal = rfm(spark, sf_dir).where(F.col("segment").isin("champion", "loyal")).select("o_custkey")
    people = t(spark, sf_dir, "customer").join(small(t(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name").join(loyal, "o_custkey")
    bought = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(people, "o_custkey").join(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), F.expr("o_orderkey = l_orderkey"))
    by = bought.join(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")).groupBy("n_name", "p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return topn.top_rows(by, ["n_name"], [F.desc("revenue"), F.asc("p_brand")], 3)


@query(
    f"""WITH {CLEAN_SQL}, w AS (SELECT o_custkey, o_orderkey, o_orderdate, sum(o_totalprice) OVER (x RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS s30, sum(o_totalprice) OVER (x RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS s365,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM clean WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate))
    SELECT o_orderkey, k = 3 AS third, s30 > 3 * (s365 - s30) / 11 AND (s365 - s30) / 11 >= 100 AS surge FROM w"""
)
def d19_rolling_spend_and_triggers(spark, sf_dir):
    day = 86_400_000_000
    c = clean(spark, sf_dir).withColumn("_us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    spent = lambda d: F.sum("o_totalprice").over(W.partitionBy("o_custkey").orderBy("_us").rangeBetween(-d * day, 0))
    w = c.select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("k"), spent(30).alias("s30"), spent(365).alias("s365"))
    base = (F.col("s365") - F.col("s30")) / 11
    return w.select("o_orderkey", (F.col("k") == 3).alias("third"), ((F.col("s30") > 3 * (F.col("s365") - F.col("s30")) / 11) & (base >= 100)).alias("surge"))


@query(
    f"""WITH {SESSIONS_SQL}, c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS p FROM s)
    SELECT user_id || '-' || session_no AS session_id, string_agg(event_type, '>' ORDER BY ts, event_id) FILTER (p IS DISTINCT FROM event_type) AS path, count(*) AS n_steps FROM c GROUP BY user_id, session_no"""
)
def d21_session_paths(spark, sf_dir):
    return sessions.paths(sessionized(spark, sf_dir), "session_id", "ts", "event_type", "event_id")


@query(f"WITH {SESSIONS_SQL}, c AS (SELECT event_type AS from_step, lead(event_type) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS to_step FROM s) SELECT from_step, to_step, count(*) AS n FROM c WHERE to_step IS NOT NULL GROUP BY ALL")
def d21_transition_matrix(spark, sf_dir):
    return sessions.transitions(sessionized(spark, sf_dir), "session_id", "ts", "event_type", "event_id")


@query(
    """WITH p AS (SELECT c_custkey, c_nationkey % 90 - 45 + (c_custkey % 100) / 50.0::DOUBLE AS lat, (c_custkey % 360) - 180.0::DOUBLE AS lon FROM customer), s AS (SELECT s_suppkey, s_nationkey % 90 - 45 + 0.5::DOUBLE AS lat, (s_suppkey * 7 % 360) - 180.0::DOUBLE AS lon FROM supplier),
    d AS (SELECT c_custkey, s_suppkey, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2))) AS m FROM p, s)
    SELECT c_custkey, s_suppkey AS nearest, round(round(m, 3) / 1000, 3) AS km FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(m, 3), s_suppkey) = 1"""
)
def d25_nearest_store(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 90 - 45 + (F.col("c_custkey") % 100) / 50.0).alias("lat"), ((F.col("c_custkey") % 360) - 180.0).alias("lon"))
    s = t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 90 - 45 + 0.5).alias("lat"), ((F.col("s_suppkey") * 7 % 360) - 180.0).alias("lon"))
    return geo.nearest(c, s, "c_custkey", "s_suppkey").select("c_custkey", F.col("s_suppkey").alias("nearest"), F.round(F.col("metres") / 1000, 3).alias("km"))


@query(
    f"""WITH {RFM_SQL}, a AS (SELECT DISTINCT o_custkey FROM clean WHERE day > DATE '{AS_OF}' - INTERVAL 365 DAYS) SELECT segment, count(*) AS customers, count(a.o_custkey) AS active, round(count(a.o_custkey) / count(*), 6) AS rate FROM rfm LEFT JOIN a USING (o_custkey) GROUP BY segment"""
)
def d27_segment_kpi(spark, sf_dir):
    by = rfm(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("customers"), F.count_if(F.col("recency") < 365).alias("active"))
    return by.withColumn("rate", F.round(F.col("active") / F.col("customers"), 6))
