"""Further queries: sets of operators that the other modules build on, one by one."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.functions.shipping import ship
from larkspur.operators import changes, geo, metrics, quality, search, topn
from larkspur.sources import readers

from .crm import SESSIONS_SQL, sessionized
from .domain import AS_OF, lake, shop
from .files import folder
from .registry import query
from .relational import small, t

# projections and predicates


@query("SELECT c_mktsegment AS dim, count(*) AS n FROM customer GROUP BY 1")
def p5_column_parameter(spark, sf_dir):
    return spark.sql("SELECT IDENTIFIER(:dim) AS dim, count(*) AS n FROM {c} GROUP BY 1", args={"dim": "c_mktsegment"}, c=t(spark, sf_dir, "customer"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
def p10_having(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 10")


@query("SELECT op, count(*) AS n FROM (SELECT 'ne' AS op FROM orders WHERE nullif(o_orderstatus, 'P') != 'F' UNION ALL SELECT 'not_in' FROM orders WHERE nullif(o_orderstatus, 'P') NOT IN ('F') UNION ALL SELECT 'is_null' FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL UNION ALL SELECT 'gte' FROM orders WHERE o_totalprice >= 200000) GROUP BY op")
def p11_metric_filters(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    tests = {"ne": ("s", "F"), "not_in": ("s", ["F"]), "is_null": ("s", None), "gte": ("o_totalprice", 200000)}
    one = o.agg(*(F.count_if(metrics.FILTERS[op](F.col(c), v)).alias(op) for op, (c, v) in tests.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(op).alias("op"), F.col(op).alias("n")) for op in tests))).alias("p")).select("p.*").where("n > 0")


@query("SELECT count(*) FILTER (c_acctbal > 0 AND c_custkey % 5 != 0) AS kept, count(*) FILTER (NOT coalesce(CASE WHEN c_custkey % 5 != 0 THEN c_acctbal END > 0, false)) AS filtered FROM customer")
def p12_row_filter_counts(spark, sf_dir):
    rule = F.coalesce(F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")) > 0, F.lit(False))
    return t(spark, sf_dir, "customer").agg(F.count_if(rule).alias("kept"), F.count_if(~rule).alias("filtered"))


@query("SELECT *, (SELECT count(*) FROM orders) > 10000 AS truncated FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000)")
def o4_result_cap(spark, sf_dir):
    """The first 10,000 rows of a result, and whether there are others."""
    return topn.capped(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10_000)


# joins


@query("SELECT p.p_partkey, x.half, x.twice FROM part p, LATERAL (SELECT p.p_size // 2 AS half, p.p_size * 2 AS twice) x")
def j11_lateral(spark, sf_dir):
    return spark.sql("SELECT p.p_partkey, x.half, x.twice FROM {p} p, LATERAL (SELECT cast(p.p_size div 2 AS INT) AS half, p.p_size * 2 AS twice) x", p=t(spark, sf_dir, "part"))


@query("WITH n AS (SELECT count(*) AS all_n FROM orders) SELECT o_orderstatus, round(count(*) / max(all_n), 6) AS share FROM orders, n GROUP BY 1")
def j6_scalar_row_join(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    by = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(o.agg(F.count("*").alias("all_n")))).select("o_orderstatus", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


@query("SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' GROUP BY ALL HAVING count(*) >= 2")
def j5_self_join_pairs(spark, sf_dir):
    """Pairs inside orders of a few lines; pairs are counted before the shuffle."""
    items = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    other = items.select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = items.join(other, "l_orderkey").where("l_partkey < b")
    return pairs.groupBy(F.col("l_partkey").alias("a"), "b").agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END, d.owner) AS consumer FROM events LEFT JOIN (SELECT user_id % 50 AS device, arg_max(user_id, ts) AS owner FROM events WHERE event_id % 4 != 0 GROUP BY 1) d ON d.device = user_id % 50")
def j20_device_attribution(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("device"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user"), "ts")
    owners = e.where("user IS NOT NULL").groupBy("device").agg(F.max_by("user", F.struct("ts", "event_id")).alias("owner"))
    return e.join(small(owners), "device", "left").select("event_id", F.coalesce("user", "owner").alias("consumer"))


@query("SELECT s_nationkey AS hub, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = c_nationkey GROUP BY 1")
def j19_one_hop(spark, sf_dir):
    hubs = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    c = t(spark, sf_dir, "customer").join(small(hubs), "c_nationkey").select("c_custkey", F.col("c_nationkey").alias("hub"))
    return t(spark, sf_dir, "orders").join(c, F.expr("o_custkey = c_custkey")).groupBy("hub").agg(F.count("*").alias("orders"))


# aggregates and windows


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def g2_distinct_counts(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT o_custkey, min(o_orderpriority) AS any_priority, bool_or(o_totalprice > 300000) AS big FROM orders GROUP BY 1")
def g6_any_and_bool(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("any_priority"), F.bool_or(F.col("o_totalprice") > 300000).alias("big"))


@query("SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1")
def g7_ordered_list(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").groupBy("label").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string"))).alias("ids"))


@query("SELECT event_type, user_id % 7 AS g, count(*) AS n FROM events GROUP BY ALL")
def g19_multiset_counts(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("g")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS place FROM supplier")
def w2_rank(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.rank().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))).cast("long").alias("place"))


@query("SELECT event_id, coalesce(lag(value) OVER w, 0) AS before, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS purchases FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w6_running_counts(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(F.lag("value").over(w), F.lit(0.0)).alias("before"), bought.alias("purchases"))


@query("SELECT o_custkey, ntile(10) OVER (ORDER BY s, o_custkey) AS decile FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1)")
def w16_value_deciles(spark, sf_dir):
    from larkspur.operators import ranks

    s = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    return ranks.ranked(s, "s", "o_custkey").select("o_custkey", ranks.ntile(10).alias("decile"))


@query("SELECT l_suppkey, p_type, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 6) AS share FROM (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)")
def w10_window_over_aggregate(spark, sf_dir):
    by = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part").select("p_partkey", "p_type"), F.expr("l_partkey = p_partkey")).groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("l_suppkey")), 6))


# sets, sinks and maintenance


@query("SELECT event_type, user_id % 5 AS g FROM events EXCEPT ALL SELECT event_type, user_id % 5 FROM events WHERE event_id % 2 = 0")
def o11_multiset_difference(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("g"), "event_id")
    return e.drop("event_id").exceptAll(e.where("event_id % 2 = 0").drop("event_id"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def o14_latest_per_key(spark, sf_dir):
    return topn.latest(t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"))


@query("SELECT CASE WHEN k <= 1000 THEN 'archived' ELSE 'left' END AS side, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS k FROM events) GROUP BY 1")
def k12_dequeue(spark, sf_dir):
    """The first thousand rows of a queue, and the rest: both from one pinned input."""
    e = t(spark, sf_dir, "events").select("event_id", "ts")
    head = e.orderBy("ts", "event_id").limit(1000).select("event_id")
    side = e.join(F.broadcast(head.withColumn("_h", F.lit(True))), "event_id", "left").select("event_id", F.when(F.col("_h"), "archived").otherwise("left").alias("side"))
    return side.groupBy("side").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT CASE WHEN c_acctbal >= 0 AND c_custkey % 6 != 0 THEN '' WHEN c_acctbal >= 0 THEN 'key' WHEN c_custkey % 6 != 0 THEN 'balance' ELSE 'balance,key' END AS broken, count(*) AS n FROM customer GROUP BY 1")
def k14_constraints(spark, sf_dir):
    good, bad = quality.split_rows(t(spark, sf_dir, "customer"), {"balance": F.col("c_acctbal") >= 0, "key": F.col("c_custkey") % 6 != 0})
    return good.select(F.lit("").alias("broken")).unionByName(bad.select("broken")).groupBy("broken").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, left(c_name, 1) || repeat('*', length(c_name) - 1) AS name FROM customer WHERE c_acctbal > 0")
def k15_masked_view(spark, sf_dir):
    t(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", X.mask_name(F.col("c_name")).alias("name")).createOrReplaceTempView("masked_customers")
    return spark.table("masked_customers")


@query("SELECT n_name, c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000")
def k21_sorted_extract(spark, sf_dir):
    big = t(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    out = big.join(t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).join(small(t(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    return out.select("n_name", "c_custkey", "o_orderkey").orderBy("n_name", "c_custkey", "o_orderkey")


@query("SELECT k AS customer_id, 1 + (k * 31) % 5 AS orders FROM range(0, 1000) r(k)")
def k30_demo_generator(spark, sf_dir):
    return spark.range(1000).select(F.col("id").alias("customer_id"), (1 + (F.col("id") * 31) % 5).alias("orders"))


# functions that users define


@query("SELECT p_partkey, p_size * 10 + 5 AS x, p_size * 3 + 1 AS y FROM part")
def u2_sql_function_defaults(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION scaled(v INT, by INT DEFAULT 10, plus INT DEFAULT 5) RETURNS INT RETURN v * by + plus")
    return spark.sql("SELECT p_partkey, scaled(p_size) AS x, scaled(p_size, by => 3, plus => 1) AS y FROM {p}", p=t(spark, sf_dir, "part"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def u3_table_function(spark, sf_dir):
    t(spark, sf_dir, "orders").createOrReplaceTempView("orders_for_function")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION orders_of(c BIGINT) RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM orders_for_function WHERE o_custkey = c")
    return spark.sql("SELECT * FROM orders_of(7)")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 IN (3, 4) THEN 'one' WHEN c_custkey % 10 < 3 THEN 'two' ELSE 'other' END AS carrier FROM customer")
def u5_vectorised_function(spark, sf_dir):
    """A function over Arrow batches; the same as a CASE expression is the faster way."""
    ship(spark)

    def carrier(k: pd.Series) -> pd.Series:
        d = k % 10
        return pd.Series("other", index=k.index).mask(d < 3, "two").mask(d.isin([3, 4]), "one")

    return t(spark, sf_dir, "customer").select("c_custkey", F.pandas_udf(carrier, "string")("c_custkey").alias("carrier"))


# domain


@query("WITH d AS (SELECT c_custkey AS m, c_custkey // 3 AS r FROM customer WHERE c_custkey > 0), s AS (SELECT o_custkey AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT r AS referrer, count(*) AS invited, round(coalesce(sum(v), 0), 2) AS value FROM d LEFT JOIN s USING (m) WHERE r > 0 GROUP BY 1")
def d13_referral_value(spark, sf_dir):
    d = t(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("m"), F.expr("c_custkey div 3").alias("referrer")).where("referrer > 0")
    s = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("m")).agg(F.sum("o_totalprice").alias("v"))
    return d.join(s, "m", "left").groupBy("referrer").agg(F.count("*").alias("invited"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 2).alias("value"))


@query("WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'the' WHEN regexp_matches(lower(text), '\\bder\\b') THEN 'der' ELSE 'none' END AS topic, source FROM documents) SELECT topic, count(*) AS n, count(DISTINCT source) AS sources FROM d GROUP BY 1")
def d26_topics_by_value(spark, sf_dir):
    low = F.lower("text")
    topic = F.when(low.rlike(r"(?-U)\bthe\b"), "the").when(low.rlike(r"(?-U)\bder\b"), "der").otherwise("none")
    return t(spark, sf_dir, "documents").groupBy(topic.alias("topic")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(f"WITH {SESSIONS_SQL}, c AS (SELECT user_id, session_no, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM s GROUP BY ALL) SELECT last_type, count(*) AS sessions, round(avg(n), 6) AS mean_events FROM c GROUP BY 1")
def d21_exit_steps(spark, sf_dir):
    last = sessionized(spark, sf_dir).groupBy("session_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))
    return last.groupBy("last_type").agg(F.count("*").alias("sessions"), F.round(F.avg("n"), 6).alias("mean_events"))


@query("SELECT o_custkey % 1200 AS consumer_id, o_orderkey AS order_id, o_orderdate::DATE AS day, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate::DATE <= DATE '2002-01-01' AND o_orderdate::DATE >= DATE '2002-01-01' - 999")
def d46_qualifying_orders(spark, sf_dir):
    return shop(spark, sf_dir, 1000)


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS unique_keys, count(*) FILTER (o_totalprice < 0) AS negative FROM orders")
def d53_error_assertions(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.agg((F.count("*") == F.countDistinct("o_orderkey")).alias("unique_keys"), F.count_if(F.col("o_totalprice") < 0).alias("negative"))


@query("SELECT rule, failed FROM (SELECT 'not_null' AS rule, count(*) FILTER (c_name IS NULL) AS failed FROM customer UNION ALL SELECT 'range', count(*) FILTER (NOT c_acctbal BETWEEN -500 AND 9000) FROM customer UNION ALL SELECT 'in', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')) FROM customer)")
def d55_mapping_assertions(spark, sf_dir):
    rules = {"not_null": F.col("c_name").isNotNull(), "range": F.col("c_acctbal").between(-500, 9000), "in": F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")}
    return quality.check_rows(t(spark, sf_dir, "customer"), rules).select("rule", "failed")


@query("SELECT c_custkey AS id, 'CRM' AS src, trim(lower(c_name)) AS name, c_acctbal::DECIMAL(18,2)::DOUBLE AS balance FROM customer ORDER BY c_custkey LIMIT 50")
def d69_mapping_dry_run(spark, sf_dir):
    """What a mapping would make of the first fifty rows by key, which is all that a dry run shows; nothing is written."""
    c = t(spark, sf_dir, "customer").orderBy("c_custkey").limit(50)
    return c.select(F.col("c_custkey").alias("id"), F.lit("CRM").alias("src"), X.normal_email(F.col("c_name")).alias("name"), F.col("c_acctbal").cast("decimal(18,2)").cast("double").alias("balance"))


@query("SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_custkey % 3 != 1 GROUP BY 1")
def d72_disable_mapping(spark, sf_dir):
    """Rows of a mapping that is switched off leave; those of the others stay."""
    rows = t(spark, sf_dir, "customer").withColumn("_mapping", F.concat(F.lit("m"), (F.col("c_custkey") % 3).cast("string")))
    return rows.where("_mapping != 'm1'").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS source_id, s_nationkey AS consumer FROM supplier WHERE s_suppkey IN (1, 3, 5)")
def d75_lookup_by_source(spark, sf_dir):
    return t(spark, sf_dir, "supplier").where(F.col("s_suppkey").isin(1, 3, 5)).select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("consumer"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def d78_masked_result(spark, sf_dir):
    """Columns with personal names are dropped from an ad-hoc result."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.drop(*(x for x in c.columns if any(w in x for w in ("name", "phone", "email", "address"))))


@query("SELECT event_type AS endpoint, ts::DATE AS day, count(*) AS calls FROM events GROUP BY ALL")
def d80_usage_counter(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    part = lambda k: e.where(f"event_id % 3 = {k}").groupBy(F.col("event_type").alias("endpoint"), F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))
    out = part(0)
    for k in (1, 2):
        out = changes.accumulate(out, part(k), ["endpoint", "day"], ["calls"])
    return out


@query("WITH m AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT n_name, sum(n)::BIGINT AS value FROM m JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def d79_additive_rollup(spark, sf_dir):
    """Counts may be added up over groups; the builder says so of the metric before it does."""
    m = metrics.Metric("order", "count", "o_orderkey")
    assert metrics.may_sum(m)
    by = metrics.evaluate(m, lake(spark, sf_dir), AS_OF, ("o_custkey",))
    places = t(spark, sf_dir, "customer").join(small(t(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name")
    return by.join(places, F.expr("o_custkey = c_custkey")).groupBy("n_name").agg(F.sum("value").alias("value"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate::DATE > DATE '1999-12-31' - 30 AND o_orderdate::DATE <= DATE '1999-12-31' GROUP BY 1")
def d41_half_open_window(spark, sf_dir):
    m = metrics.Metric("order", "count", "o_orderkey", "o_orderdate", 30)
    return metrics.evaluate(m, lake(spark, sf_dir), date(1999, 12, 31), ("o_custkey",)).withColumnRenamed("value", "n")


@query("WITH r AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS c FROM customer) SELECT c_custkey, c > 30 AS crowded FROM r")
def w12_tie_detection(spark, sf_dir):
    n = F.count("*").over(W.partitionBy("c_nationkey", "c_mktsegment"))
    return t(spark, sf_dir, "customer").select("c_custkey", (n > 30).alias("crowded"))


@query("SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(1.0 - c_nationkey) / 2), 2) + cos(radians(c_nationkey)) * cos(radians(1.0)) * pow(sin(radians(2.0 - c_custkey % 90) / 2), 2))), 2) AS metres FROM customer")
def f8_sphere_distance(spark, sf_dir):
    at = geo.haversine(F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 90).cast("double"), F.lit(1.0), F.lit(2.0))
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(at, 2).alias("metres"))


@query("SELECT label, string_agg(printf('%.4f', v), '|' ORDER BY i) AS mean FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 5) r(i) GROUP BY ALL) GROUP BY label")
def d17_mean_vectors(spark, sf_dir):
    """Means by position of a group's vectors, pre-aggregated before the shuffle; the first four shown."""
    e = t(spark, sf_dir, "embeddings").groupBy("label").agg(*(F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"v{i}") for i in range(4)))
    return e.select("label", F.concat_ws("|", *(F.format_string("%.4f", f"v{i}") for i in range(4))).alias("mean"))


@query(
    r"""WITH d AS (SELECT doc_id, source, list_count(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ('the', 'that', 'from'))) AS hits FROM documents)
    SELECT doc_id, hits::BIGINT AS hits, row_number() OVER (ORDER BY hits DESC, doc_id) AS place FROM d WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 50"""
)
def v5_keyword_recall(spark, sf_dir):
    """Recall by keywords: the 50 documents with the most hits, in their order."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return search.keyword_recall(t(spark, sf_dir, "documents"), "doc_id", tokens, ["the", "that", "from"], 50)


@query("SELECT user_id, event_type, ts, event_id FROM events WHERE event_id % 13 != 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def r16_incremental_merge(spark, sf_dir):
    """Rows are deleted and added after a first merge; only the keys that they touch are merged again."""
    from larkspur.operators import merge

    e = t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    first, now = e.where("event_id % 10 != 0"), e.where("event_id % 13 != 0")
    touched = e.where("event_id % 10 = 0 OR event_id % 13 = 0")
    return merge.refresh(topn.latest(first, key, order), now, touched, key, order)


@query()
def v4_cell_index_search(spark, sf_dir):
    """An index of k-means cells over all vectors; every row whose id is divisible by 20 asks for its ten nearest."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    indexed, centres = search.cells(e, "embedding", 16)
    return search.probe(e.where("vec_id % 20 = 0"), indexed, centres, "vec_id", "embedding", 10, probes=12)


@query("SELECT unnest(string_split('region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations', ' ')) AS name")
def s14_prefix_tables(spark, sf_dir):
    """Every table below a prefix of the store."""
    return spark.createDataFrame([(n,) for n in readers.prefix_tables(spark, sf_dir)], "name string")


@query("SELECT event_type AS part, count(*) AS rows, 1::BIGINT AS files, true AS sized FROM events GROUP BY 1")
def s20_file_listing(spark, sf_dir):
    """The files of a partitioned folder with their rows and sizes, summed by partition."""
    at = folder(spark, "listed")
    t(spark, sf_dir, "events").repartition("event_type").write.partitionBy("event_type").parquet(at)
    listed = readers.files_of(readers.parquet(spark, at)).withColumn("part", F.regexp_extract("path", "event_type=([^/]+)/", 1))
    return listed.groupBy("part").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.bool_and(F.col("bytes") > 0).alias("sized"))
