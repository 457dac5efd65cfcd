"""Projection, joins, aggregates, windows, sorting and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut
from larkspur.operators import ranks, topn

from .registry import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if the optimizer's size estimate proves it small; else Spark's own choice."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


# scans and projections


@query("SELECT c_custkey, upper(c_name) AS name, c_acctbal * 2 AS twice, c_acctbal::BIGINT AS whole FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1'")
def p1_project_filter(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where((F.col("c_acctbal") > 0) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").like("%1"))
    return c.select("c_custkey", F.upper("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice"), F.rint("c_acctbal").cast("long").alias("whole"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS INTEGER) AS bad FROM events")
def p2_try_cast(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("int").alias("bad"))


@query("SELECT * EXCLUDE (p_retailprice) REPLACE (upper(p_brand) AS p_brand) FROM part")
def p3_exclude_replace(spark, sf_dir):
    return t(spark, sf_dir, "part").drop("p_retailprice").withColumn("p_brand", F.upper("p_brand"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 5000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(o_orderstatus, 'F'), 'closed') AS status, greatest(o_totalprice, 1000.0::DOUBLE) AS floor_price, least(o_totalprice, 1000.0::DOUBLE) AS cap_price FROM orders")
def p6_case_and_defaults(spark, sf_dir):
    price = F.col("o_totalprice")
    band = F.when(price < 1000, "low").when(price < 5000, "mid").otherwise("high")
    return t(spark, sf_dir, "orders").select("o_orderkey", band.alias("band"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("closed")).alias("status"), F.greatest(price, F.lit(1000.0)).alias("floor_price"), F.least(price, F.lit(1000.0)).alias("cap_price"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS closed, count(DISTINCT o_orderpriority) AS priorities, bool_or(o_orderstatus = 'O') AS has_open, max(o_totalprice) FILTER (o_orderstatus = 'O') AS top_open FROM orders GROUP BY o_custkey HAVING count(*) > 3")
def p8_filtered_aggregates(spark, sf_dir):
    status = F.col("o_orderstatus")
    return (
        t(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count_if(status == "F").alias("closed"), F.countDistinct("o_orderpriority").alias("priorities"), F.bool_or(status == "O").alias("has_open"), F.max(F.when(status == "O", F.col("o_totalprice"))).alias("top_open"), F.count("*").alias("_n"))
        .where("_n > 3")
        .drop("_n")
    )


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def p9_qualify_latest(spark, sf_dir):
    return topn.latest(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_totalprice BETWEEN 100 AND 3000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def p7_predicates(spark, sf_dir):
    debtors = t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = t(spark, sf_dir, "orders").where(~F.col("o_orderstatus").eqNullSafe("F") & F.col("o_totalprice").between(100, 3000) & F.col("o_custkey").isNotNull())
    return kept.join(debtors, "o_custkey", "left_anti").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 500 GROUP BY ALL")
def p14_named_parameters(spark, sf_dir):
    c, n = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    return spark.sql("SELECT n_name, count(*) AS n FROM {c} JOIN {n} ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY ALL", args={"least": 500}, c=c, n=n)


# joins


@query(
    """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def j1_five_table_join(spark, sf_dir):
    places = t(spark, sf_dir, "nation").join(small(t(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    customers = t(spark, sf_dir, "customer").join(small(places), F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name", "r_name")
    sales = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("rev"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = sales.join(orders, F.expr("l_orderkey = o_orderkey")).join(customers, F.expr("o_custkey = c_custkey"))
    return joined.groupBy("r_name", "n_name").agg(F.sum("n").alias("lines"), F.round(F.sum("rev"), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def j2_left_join(spark, sf_dir):
    spent = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    out = t(spark, sf_dir, "customer").select("c_custkey").join(spent, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query(
    """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, a.n AS before_n, b.n AS after_n, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n IS DISTINCT FROM b.n THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k"""
)
def j3_full_join_diff(spark, sf_dir):
    by = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"))
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    counts = by.agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))  # both states in one pass, no join
    a, b = F.nullif("a", F.lit(0)), F.nullif("b", F.lit(0))
    state = F.when(F.col("a") == 0, "added").when(F.col("b") == 0, "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return counts.select("k", a.alias("before_n"), b.alias("after_n"), state.alias("state"))


@query("SELECT r_name, s.status, (SELECT count(*) FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey WHERE n.n_regionkey = r_regionkey AND o_orderstatus = s.status) AS n FROM region, (VALUES ('F'), ('O'), ('P')) s(status)")
def j4_cross_join_grid(spark, sf_dir):
    grid = t(spark, sf_dir, "region").select("r_regionkey", "r_name", F.explode(F.array(*map(F.lit, "FOP"))).alias("status"))
    placed = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(small(t(spark, sf_dir, "nation")), F.expr("c_nationkey = n_nationkey"))
    counts = placed.groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["r_regionkey", "status"], "left").select("r_name", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 5000)")
def j7_semi_join(spark, sf_dir):
    big = t(spark, sf_dir, "orders").where("o_totalprice > 5000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j8_anti_join(spark, sf_dir):
    """Customers without a dear order."""
    dear = t(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(dear, "c_custkey", "left_anti")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def j12_correlated_scalar(spark, sf_dir):
    return spark.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM {o} WHERE o_custkey = c_custkey) AS top FROM {c}", o=t(spark, sf_dir, "orders"), c=t(spark, sf_dir, "customer"))


@query(
    """WITH RECURSIVE tree AS (SELECT c_custkey AS root, c_custkey AS member, 0 AS depth FROM customer
    UNION ALL SELECT root, c.c_custkey, depth + 1 FROM tree JOIN customer c ON c.c_custkey // 3 = tree.member AND c.c_custkey != tree.member WHERE depth < 5)
    SELECT root, count(*) - 1 AS downstream, max(depth)::BIGINT AS levels FROM tree GROUP BY root"""
)
def j15_recursive_referrals(spark, sf_dir):
    """Level by level, each stored: a recursive WITH stops at Spark's limit of a million rows."""
    c = t(spark, sf_dir, "customer").select("c_custkey")
    children = c.select(F.expr("c_custkey div 3").alias("member"), F.col("c_custkey").alias("child")).where("child != member")
    level = c.select(F.col("c_custkey").alias("root"), F.col("c_custkey").alias("member"))
    tree = level.withColumn("depth", F.lit(0))
    for depth in range(1, 6):
        level = cut(level.join(children, "member").select("root", F.col("child").alias("member")))
        tree = tree.unionByName(level.withColumn("depth", F.lit(depth)))
    return tree.groupBy("root").agg((F.count("*") - 1).alias("downstream"), F.max("depth").cast("long").alias("levels"))


@query(
    """WITH RECURSIVE walk AS (SELECT n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey = 0
    UNION SELECT (node * m + 1) % 25, depth + 1 FROM walk, (VALUES (2), (3)) e(m) WHERE depth < 6) SELECT node::BIGINT AS node, min(depth)::BIGINT AS depth FROM walk GROUP BY node"""
)
def j16_least_depth(spark, sf_dir):
    """Breadth first from nation 0: a frontier of new nodes joined with the edges, until none is new."""
    nodes = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("u"))
    edges = nodes.select("u", F.explode(F.array(F.lit(2), F.lit(3))).alias("m")).select("u", ((F.col("u") * F.col("m") + 1) % 25).alias("v")).distinct()
    found = nodes.where("u = 0").select(F.col("u").alias("node"), F.lit(0).cast("long").alias("depth"))
    frontier = found
    for depth in range(1, 7):
        frontier = edges.join(frontier, F.col("u") == F.col("node")).select(F.col("v").alias("node"), F.lit(depth).cast("long").alias("depth")).distinct().join(found, "node", "left_anti")
        found = found.unionByName(frontier)
    return found


@query("SELECT o_orderkey, k::BIGINT AS k FROM orders, range(o_orderkey % 4) r(k)")
def j22_correlated_range(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    return t(spark, sf_dir, "orders").where(n > 0).select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))


# aggregates


@query("SELECT o_custkey, o_orderpriority AS usual, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def g3_mode_in_two_phases(spark, sf_dir):
    return topn.mode_by(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority").withColumnRenamed("o_orderpriority", "usual")


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")
def g4_arg_max(spark, sf_dir):
    """Of equal prices the first order of the table, which is by key, as in SQL."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    dearest = F.max_by(key, F.when(price.isNotNull(), F.struct(price, -key)))
    cheapest = F.min_by(key, F.when(price.isNotNull(), F.struct(price, key)))
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(dearest.alias("dearest"), cheapest.alias("cheapest"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS top3 FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3) GROUP BY o_custkey")
def g5_top_three_list(spark, sf_dir):
    top = topn.top_rows(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")))
    return top.groupBy("o_custkey").agg(F.concat_ws(",", F.transform(ordered, lambda x: x["o_orderkey"].cast("string"))).alias("top3"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '>' ORDER BY o_orderdate, o_orderkey) AS trail FROM orders GROUP BY o_custkey")
def g8_ordered_string_agg(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws(">", F.transform(ordered, lambda x: x["o_orderstatus"])).alias("trail"))


@query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def g9_median_quantile(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("mid"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@query()
def g10_approximate_aggregates(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("mid"))


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::BIGINT AS g, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def g12_rollup(spark, sf_dir):
    return t(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("long").alias("g"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def g13_grouping_sets(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus, o_orderpriority, cast(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid, count(*) AS n FROM {o} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", o=t(spark, sf_dir, "orders"))


@query("SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def g14_cube_distinct(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderpriority, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share FROM orders GROUP BY 1")
def g16_share_of_total(spark, sf_dir):
    by = t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"))
    return by.select("o_orderpriority", F.round(F.col("s") / F.sum("s").over(W.partitionBy()), 6).alias("share"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean_discount FROM lineitem GROUP BY 1")
def g17_weighted_average(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 8).alias("mean_discount"))


# windows


@query(
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after,
    round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, round(avg(o_totalprice) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def w1_window_functions(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    long = lambda c: c.cast("long")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey",
        long(F.row_number().over(w)).alias("rn"),
        long(F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderstatus"))).alias("rk"),
        F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_totalprice").over(w).alias("after"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.avg("o_totalprice").over(w.rowsBetween(-7, -1)), 4).alias("recent"),
    )


@query("SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS fifth, round(percent_rank() OVER (ORDER BY c_acctbal), 9) AS share FROM customer")
def w3_global_ntile(spark, sf_dir):
    ranked = ranks.ranked(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")
    return ranked.select("c_custkey", ranks.ntile(5).alias("fifth"), F.round(ranks.percent_rank(), 9).alias("share"))


@query(
    """SELECT o_orderkey, round(sum(o_totalprice) OVER (w RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW), 2) AS d30, round(sum(o_totalprice) OVER (w RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW), 2) AS d365,
    count(*) OVER (w RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n90 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)"""
)
def w9_range_interval_windows(spark, sf_dir):
    day = 86_400_000_000
    o = t(spark, sf_dir, "orders").withColumn("_us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    w = lambda d: W.partitionBy("o_custkey").orderBy("_us").rangeBetween(-d * day, 0)
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(w(30)), 2).alias("d30"), F.round(F.sum("o_totalprice").over(w(365)), 2).alias("d365"), F.count("*").over(w(90)).alias("n90"))


@query("SELECT o_orderkey, max(o_totalprice) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS top_closed, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS ties FROM orders")
def w11_filtered_window(spark, sf_dir):
    by = W.partitionBy("o_custkey")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).over(by).alias("top_closed"), F.count("*").over(W.partitionBy("o_custkey", "o_orderstatus")).alias("ties"))


@query("SELECT o_orderkey, n.n AS priorities FROM orders o JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) n USING (o_custkey)")
def w13_distinct_over_window(spark, sf_dir):
    seen = F.size(F.collect_set("o_orderpriority").over(W.partitionBy("o_custkey"))).cast("long")
    return t(spark, sf_dir, "orders").select("o_orderkey", seen.alias("priorities"))


# order, limits, pivots, samples, sets


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
def o2_top_n(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").limit(25)


@query("SELECT n_name, p_brand, revenue FROM (SELECT n_name, p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY revenue DESC, p_brand) <= 3")
def o3_group_top_n(spark, sf_dir):
    parts, suppliers = t(spark, sf_dir, "part").select("p_partkey", "p_brand"), t(spark, sf_dir, "supplier").join(small(t(spark, sf_dir, "nation")), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")
    sold = t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("r"))
    by = sold.join(parts, F.expr("l_partkey = p_partkey")).join(suppliers, F.expr("l_suppkey = s_suppkey")).groupBy("n_name", "p_brand").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return topn.top_rows(by, ["n_name"], [F.desc("revenue"), F.asc("p_brand")], 3)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def o6_pivot(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query()
def o7_bernoulli_sample(spark, sf_dir):
    """A tenth of the rows, each by a hash of its key and a seed, so that any partitioning draws the same."""
    return t(spark, sf_dir, "events").where(F.pmod(F.xxhash64(F.lit(42), "event_id"), F.lit(1_000_000)) < 100_000)


@query()
def o7_reservoir_sample(spark, sf_dir):
    """A hundred rows: those of the least hashes of key and seed."""
    return t(spark, sf_dir, "events").orderBy(F.xxhash64(F.lit(42), "event_id"), "event_id").limit(100)


@query("SELECT * FROM events WHERE user_id % 10 = 3")
def o8_entity_sample(spark, sf_dir):
    return t(spark, sf_dir, "events").where(F.col("user_id") % 10 == 3)


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def o9_union_all(spark, sf_dir):
    one = lambda name, k, b: t(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(k).alias("id"), F.col(b).alias("bal"))
    return one("customer", "c_custkey", "c_acctbal").unionByName(one("supplier", "s_suppkey", "s_acctbal"))


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def o10_set_operations(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer")))


@query("SELECT event_id, i::BIGINT AS i, w FROM (SELECT event_id, unnest(range(1, 4)) AS i, unnest([event_type, 'x', NULL]) AS w FROM events)")
def o13_zipped_unnest(spark, sf_dir):
    pairs = F.arrays_zip(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")).alias("i"), F.array("event_type", F.lit("x"), F.lit(None)).alias("w"))
    return t(spark, sf_dir, "events").select("event_id", F.inline(pairs))
