"""Changes, merging, identity, metrics, templates, quality and retrieval over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.functions.fuzzy import jaro_winkler
from larkspur.operators import changes, identity, matching, merge, metrics, quality, search, templates, topn
from larkspur.sources import readers

from .registry import query
from .relational import small, t

AS_OF = date(2002, 1, 1)

# changes

BEFORE_SQL = "b AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 10 != 0)"
AFTER_SQL = "a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 11 != 0)"


def states(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return c.where("k % 10 != 0"), c.where("k % 11 != 0").withColumn("seg", F.when(F.col("k") % 7 != 0, F.col("seg")))


@query(
    f"""WITH {BEFORE_SQL}, {AFTER_SQL} SELECT CASE WHEN b.k IS NULL THEN 'insert' WHEN a.k IS NULL THEN 'delete' ELSE 'update' END AS _op, coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.name ELSE a.name END AS name,
    CASE WHEN a.k IS NULL THEN b.seg ELSE a.seg END AS seg, CASE WHEN a.k IS NULL THEN b.bal ELSE a.bal END AS bal FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.name IS DISTINCT FROM b.name OR a.seg IS DISTINCT FROM b.seg OR a.bal IS DISTINCT FROM b.bal"""
)
def r10_keyed_compare(spark, sf_dir):
    before, after = states(spark, sf_dir)
    return changes.keyed_diff(before, after, ["k"])


@query(
    """WITH b AS (SELECT event_type, user_id % 5 AS g FROM events WHERE event_id % 3 != 0), a AS (SELECT event_type, user_id % 5 AS g FROM events WHERE event_id % 4 != 0)
    SELECT event_type, g, CASE WHEN n > 0 THEN 'insert' ELSE 'delete' END AS _op, abs(n)::BIGINT AS _n FROM (SELECT event_type, g, sum(d) AS n FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL) WHERE n != 0"""
)
def r11_multiset_compare(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("g"), "event_id")
    return changes.multiset_diff(e.where("event_id % 3 != 0").drop("event_id"), e.where("event_id % 4 != 0").drop("event_id"))


@query(f"WITH {BEFORE_SQL}, {AFTER_SQL} SELECT * FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT * FROM a")
def k9_merge_upsert(spark, sf_dir):
    before, after = states(spark, sf_dir)
    return changes.upsert(before, after, ["k"])


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY user_id")
def k10_merge_accumulate(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    batch = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
    out = changes.accumulate(batch(e.where("event_id % 2 = 0")), batch(e.where("event_id % 2 = 1")), ["user_id"], ["n", "total"], ["last_ts"])
    return out.withColumn("total", F.round("total", 4))


@query("WITH l AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events) SELECT user_id, ts, event_id, event_type FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE op != 'delete'")
def r15_current_state(spark, sf_dir):
    log = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("_op"))
    return changes.current_state(log, ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 7 != 0) - INTERVAL 15 MINUTE")
def r7_watermark_read(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "ts")
    mark = e.where("event_id % 7 != 0").agg(F.max("ts").alias("m")).first()["m"]
    return changes.after_watermark(e, "ts", mark, F.expr("INTERVAL 15 MINUTE"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 4 = 0")
def r8_late_rows_unseen(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    old = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.col("c_mktsegment"))).where("c_custkey % 4 != 0")
    state = old.withColumn("_hash", changes.row_hash(["c_name", "c_mktsegment"])).select("c_custkey", "_hash")
    return changes.unseen(rows, state, ["c_custkey"])


@query("SELECT side, count(*) AS n FROM (SELECT 'missing' AS side, k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 != 0) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 != 0) UNION ALL SELECT 'unseen', k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 11 != 0) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 != 0)) GROUP BY side")
def r12_reconcile_keys(spark, sf_dir):
    before, after = (x.select("k") for x in states(spark, sf_dir))
    side = lambda a, b, name: a.join(b, "k", "left_anti").withColumn("side", F.lit(name))
    return side(before, after, "missing").unionByName(side(after, before, "unseen")).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'delete' ELSE 'upsert' END AS _op FROM customer")
def r13_soft_delete(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("gone"))
    return changes.soft_deletes(rows, "gone").drop("gone")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1) GROUP BY 1")
def r2_incremental_aggregate(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    part = lambda k: e.where(f"event_id % 2 = {k}").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return changes.accumulate(part(0), part(1), ["event_type"], ["n", "total"]).withColumn("total", F.round("total", 4))


HISTORY_SQL = """h AS (SELECT c_custkey AS k, c_mktsegment AS seg, TIMESTAMP '1995-01-01' AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1997-06-01' END AS valid_to, c_custkey % 3 != 0 AS is_current FROM customer
UNION ALL SELECT c_custkey, 'MOVED', TIMESTAMP '1997-06-01', NULL, true FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 'NEW', TIMESTAMP '1997-06-01', NULL, true FROM customer WHERE c_custkey % 50 = 0)"""


def history(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    first = changes.scd2_start(c.withColumn("since", at("1995-01-01")), "since").drop("since")
    moved = c.where("k % 6 != 1").withColumn("seg", F.when(F.col("k") % 3 == 0, "MOVED").otherwise(F.col("seg")))  # most rows of a change set don't change
    new = c.where("k % 50 = 0").select((F.col("k") + 1000000).alias("k"), F.lit("NEW").alias("seg"))
    return changes.scd2_apply(first, moved.unionByName(new).withColumn("ts", at("1997-06-01")), ["k"], ["seg"], "ts")


@query(f"WITH {HISTORY_SQL} SELECT * FROM h")
def d23_scd2_apply(spark, sf_dir):
    return history(spark, sf_dir)


@query(f"WITH {HISTORY_SQL} SELECT o_orderkey, h.seg AS seg_then, n.seg AS seg_now FROM orders LEFT JOIN h ON h.k = o_custkey AND h.valid_from <= o_orderdate AND (h.valid_to IS NULL OR o_orderdate < h.valid_to) LEFT JOIN (SELECT * FROM h WHERE is_current) n ON n.k = o_custkey")
def d24_point_in_time(spark, sf_dir):
    h = history(spark, sf_dir)
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderdate")
    then = changes.at_time(o, h.select("k", F.col("seg").alias("seg_then"), "valid_from", "valid_to"), ["k"], "o_orderdate")
    return then.join(h.where("is_current").select("k", F.col("seg").alias("seg_now")), "k", "left").select("o_orderkey", "seg_then", "seg_now")


# merging


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status FROM orders")
def d28_value_dictionary(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", merge.dictionary("o_orderstatus", {"F": "finished", "O": "open"}, "unknown").alias("status"))


@query("SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def d29_dedupe_latest(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", (F.col("event_id") % 3).alias("batch"))
    return merge.dedupe(rows, ["user_id", "event_type"], "ts", "batch", "event_id").select("user_id", "event_type", "ts", "event_id")


@query("SELECT 'shop:' || o_orderkey AS o_orderkey, 'shop:' || o_custkey AS o_custkey, o_totalprice FROM orders")
def d30_key_space(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(*merge.key_space("shop", "o_orderkey", "o_custkey"), "o_totalprice")


@query("SELECT c_custkey AS id, 'crm,shop' AS mappings FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def d31_exclusive_keys(spark, sf_dir):
    one = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return merge.shared_keys({"crm": one, "shop": t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))}, ["id"])


@query("WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS common, count(*) FILTER (a.v = b.v) AS agree FROM a JOIN b USING (k)) SELECT *, round(agree / common, 6) AS agreement, CASE WHEN agree / common >= 0.8 THEN CASE WHEN common = least(n_a, n_b) THEN 'duplicate' ELSE 'drop_one' END WHEN agree / common <= 0.2 THEN 'key_space' ELSE 'review' END AS advice FROM n")
def d32_key_conflicts(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return merge.overlap(a, b, "k", "v")


GROUP_SQL = """s AS (SELECT c_custkey AS k, 1 AS p, c_custkey % 5 AS moment, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, NULL AS city FROM customer UNION ALL SELECT c_custkey, 2, c_custkey % 7, 'second ' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'city ' || c_nationkey END FROM customer WHERE c_custkey % 4 != 0)"""


def group_rows(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    one = c.select(k.alias("k"), F.lit(1).alias("p"), (k % 5).alias("moment"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("city"))
    two = c.where(k % 4 != 0).select(k.alias("k"), F.lit(2).alias("p"), (k % 7).alias("moment"), F.concat(F.lit("second "), k.cast("string")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("city "), F.col("c_nationkey").cast("string"))).alias("city"))
    return one.unionByName(two)


@query(f"WITH {GROUP_SQL} SELECT k, p, moment, name, city FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, moment DESC) = 1")
def d33_merge_by_priority(spark, sf_dir):
    return merge.by_priority(group_rows(spark, sf_dir), ["k"], "p", ["moment"])


@query(f"WITH {GROUP_SQL} SELECT k, arg_min(name, p * 100 + moment) FILTER (name IS NOT NULL) AS name, arg_min(city, p * 100 + moment) FILTER (city IS NOT NULL) AS city FROM s GROUP BY k")
def d33_merge_coalesced(spark, sf_dir):
    return merge.coalesced(group_rows(spark, sf_dir), ["k"], "p", ["moment"])


# identity

RECORDS_SQL = """r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 != 0 THEN c_custkey % 700 END AS phone, CASE WHEN c_custkey % 3 != 0 THEN (c_custkey * 7) % 900 END AS email, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 1100 END AS ext FROM customer)"""


def records(spark, sf_dir):
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 != 0, k % 700).alias("phone"), F.when(k % 3 != 0, (k * 7) % 900).alias("email"), F.when(k % 5 == 0, k % 1100).alias("ext"))


@query(
    f"""WITH RECURSIVE {RECORDS_SQL}, e AS (SELECT a.id AS u, b.id AS v FROM r a JOIN r b ON a.phone = b.phone UNION SELECT a.id, b.id FROM r a JOIN r b ON a.email = b.email AND NOT coalesce(a.phone != b.phone, false)
    UNION SELECT a.id, b.id FROM r a JOIN r b ON a.ext = b.ext AND NOT coalesce(a.phone != b.phone, false) AND NOT coalesce(a.email != b.email, false)),
    reach AS (SELECT id AS u, id AS v FROM r UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v) SELECT u AS id, min(v) AS consumer FROM reach GROUP BY u"""
)
def d34_identity_resolution(spark, sf_dir):
    return identity.resolve(records(spark, sf_dir), "id", ["phone", "email", "ext"])


@query("WITH n AS (SELECT c_custkey AS id, c_custkey % 400 AS consumer FROM customer), b AS (SELECT c_custkey AS id, (c_custkey + (c_custkey % 10 = 0)::INT) % 400 + 10000 AS consumer, c_nationkey AS since_at FROM customer WHERE c_custkey % 6 != 0), s AS (SELECT consumer AS old, count(*) AS size, min(since_at) AS since FROM b GROUP BY 1), x AS (SELECT n.consumer, b.consumer AS old, count(*) AS c FROM n JOIN b USING (id) GROUP BY ALL), k AS (SELECT consumer, old FROM x JOIN s USING (old) WHERE 2 * c > size QUALIFY row_number() OVER (PARTITION BY consumer ORDER BY since, old) = 1) SELECT id, coalesce(k.old, n.consumer)::BIGINT AS consumer FROM n LEFT JOIN k USING (consumer)")
def d35_stable_ids(spark, sf_dir):
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer")
    now = c.select(k.alias("id"), (k % 400).alias("consumer"))
    before = c.where(k % 6 != 0).select(k.alias("id"), ((k + (k % 10 == 0).cast("int")) % 400 + 10000).alias("consumer"), F.col("c_nationkey").alias("assigned_at"))
    return identity.stable_ids(now, before, "id")


@query(f"WITH {RECORDS_SQL} SELECT field, value, count(*) AS n FROM (SELECT 'phone' AS field, phone::VARCHAR AS value FROM r UNION ALL SELECT 'email', email::VARCHAR FROM r) WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, field, value LIMIT 20")
def d37_hot_match_values(spark, sf_dir):
    return identity.hot_values(records(spark, sf_dir), ["phone", "email"], least=2)


@query("SELECT user_id % 60 AS device, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts DESC, user_id) = 1")
def d38_device_owner(spark, sf_dir):
    return identity.device_owners(t(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("device"), "user_id", "ts"), "device", "user_id", "ts")


@query(f"WITH {GROUP_SQL} SELECT k, arg_min(name, p * 100 + moment) FILTER (name IS NOT NULL) AS name, arg_min(p, p * 100 + moment) FILTER (name IS NOT NULL) AS name__source, arg_min(city, p * 100 + moment) FILTER (city IS NOT NULL) AS city, arg_min(p, p * 100 + moment) FILTER (city IS NOT NULL) AS city__source FROM s GROUP BY k")
def d39_consumer_attributes(spark, sf_dir):
    return identity.survivors(group_rows(spark, sf_dir), "k", ["name", "city"], ["p", "moment"], "p")


@query("SELECT user_id, event_type AS channel, CASE WHEN event_id % 2 = 0 THEN 'granted' ELSE 'revoked' END AS status, date_trunc('day', ts)::TIMESTAMP AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC, event_id % 2 DESC) = 1")
def d40_consents(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("channel"), F.when(F.col("event_id") % 2 == 0, "granted").otherwise("revoked").alias("status"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at"))
    return identity.consents(rows, "user_id", "channel", "status", "at")


# metrics


def lake(spark, sf_dir):
    return {"order": t(spark, sf_dir, "orders"), "customer": t(spark, sf_dir, "customer"), "nation": t(spark, sf_dir, "nation"), "region": t(spark, sf_dir, "region"), "event": t(spark, sf_dir, "events")}


TO_CUSTOMER = (("customer", "o_custkey", "c_custkey"),)
TO_NATION = (*TO_CUSTOMER, ("nation", "c_nationkey", "n_nationkey"))
TO_REGION = (*TO_NATION, ("region", "n_regionkey", "r_regionkey"))


@query("SELECT r_name AS region, c_mktsegment AS segment, count(DISTINCT o_custkey) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus != 'P' AND o_orderdate::DATE <= DATE '2000-01-01' AND o_orderdate::DATE > DATE '2000-01-01' - 365 GROUP BY ALL")
def d41_metric_with_paths(spark, sf_dir):
    m = metrics.Metric("order", "count_distinct", "o_custkey", "o_orderdate", 365, (("o_orderstatus", "ne", "P"),), {"region": metrics.Path("r_name", TO_REGION), "segment": metrics.Path("c_mktsegment", TO_CUSTOMER)})
    return metrics.evaluate(m, lake(spark, sf_dir), date(2000, 1, 1))


@query("SELECT n_name AS nation, coalesce(count(*) FILTER (o_orderstatus = 'F'), 0)::DOUBLE / count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def d42_ratio_metric(spark, sf_dir):
    whole = metrics.Metric("order", "count")
    part = metrics.Metric("order", "count", filters=(("o_orderstatus", "eq", "F"),))
    return metrics.evaluate(metrics.Metric("order", "ratio", numerator=part, denominator=whole, dimensions={"nation": metrics.Path("n_name", TO_NATION)}), lake(spark, sf_dir), AS_OF)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01')::BIGINT AS days FROM orders GROUP BY 1")
def d43_latest_and_days_since(spark, sf_dir):
    tables = lake(spark, sf_dir)
    one = metrics.evaluate(metrics.Metric("order", "latest", "o_orderkey", "o_orderdate"), tables, AS_OF, ("o_custkey",)).withColumnRenamed("value", "latest")
    two = metrics.evaluate(metrics.Metric("order", "days_since", None, "o_orderdate"), tables, AS_OF, ("o_custkey",)).withColumnRenamed("value", "days")
    return one.join(two, "o_custkey")


TAG_SQL = "x AS (SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), g AS (SELECT c_custkey, CASE WHEN n >= 12 AND top > 300000 THEN 'core' WHEN n = 0 OR top < 100000 THEN 'cold' ELSE 'other' END AS tag FROM x)"


def tagged(spark, sf_dir, least):
    rules = [metrics.Rule("core", (("n", "gte", least), ("top", "gt", 300000.0))), metrics.Rule("cold", (("n", "eq", 0), ("top", "lt", 100000.0)), any=True)]
    of = {"n": (metrics.Metric("order", "count", "o_orderkey"), "o_custkey"), "top": (metrics.Metric("order", "max", "o_totalprice"), "o_custkey")}
    return metrics.tag(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", of, rules, lake(spark, sf_dir), AS_OF, "other")


@query(f"WITH {TAG_SQL} SELECT * FROM g")
def d44_tag_rules(spark, sf_dir):
    return tagged(spark, sf_dir, 12)


@query(f"WITH {TAG_SQL}, h AS (SELECT c_custkey, CASE WHEN n >= 14 AND top > 300000 THEN 'core' WHEN n = 0 OR top < 100000 THEN 'cold' ELSE 'other' END AS tag FROM x) SELECT g.tag AS before, h.tag AS after, count(*) AS n FROM g JOIN h USING (c_custkey) GROUP BY ALL")
def d45_tag_impact(spark, sf_dir):
    return metrics.impact(tagged(spark, sf_dir, 12), tagged(spark, sf_dir, 14), "c_custkey", "tag")


# templates


def shop(spark, sf_dir, lookback=None):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"), F.lit(None).cast("timestamp_ntz").alias("paid_at"), F.col("o_orderdate").alias("created_at"), F.lit("shop").alias("_customer_source"))
    links = t(spark, sf_dir, "customer").select(F.lit("shop").alias("_source"), F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 1200).alias("consumer_id"))
    return templates.qualifying(o, links, ["F", "O"], AS_OF, lookback)


SHOP_SQL = "q AS (SELECT o_custkey % 1200 AS consumer_id, o_orderkey AS order_id, o_orderdate::DATE AS day, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O'))"


@query(
    f"""WITH {SHOP_SQL}, c AS (SELECT consumer_id, date_diff('day', max(day), DATE '2002-01-01')::BIGINT AS recency_days, count(*) AS frequency, sum(amount) AS amount FROM q WHERE day >= DATE '2002-01-01' - 1824 GROUP BY 1),
    s AS (SELECT *, 6 - ntile(5) OVER (ORDER BY recency_days, consumer_id) AS r, ntile(5) OVER (ORDER BY frequency, amount, consumer_id) AS f, ntile(5) OVER (ORDER BY amount, consumer_id) AS m FROM c)
    SELECT consumer_id, recency_days, frequency, round(amount, 2) AS monetary, r, f, m, CASE WHEN r >= 4 AND f >= 4 THEN 'best' WHEN r <= 2 AND f >= 4 THEN 'losing' ELSE 'other' END AS segment FROM s"""
)
def d47_rfm_template(spark, sf_dir):
    out = templates.rfm(shop(spark, sf_dir, 1825), AS_OF, [("best", "r >= 4 AND f >= 4"), ("losing", "r <= 2 AND f >= 4")])
    return out.withColumn("monetary", F.round("monetary", 2))


@query(
    f"""WITH {SHOP_SQL}, f AS (SELECT *, min(date_trunc('month', day)) OVER (PARTITION BY consumer_id) AS s FROM q) SELECT consumer_id, s::DATE AS cohort_start, count(*) AS orders, string_agg(DISTINCT lpad(date_diff('month', s, day)::VARCHAR, 3, '0'), ',' ORDER BY lpad(date_diff('month', s, day)::VARCHAR, 3, '0')) AS active FROM f WHERE s >= DATE '2002-01-01' - INTERVAL 83 MONTHS GROUP BY ALL"""
)
def d48_cohort_template(spark, sf_dir):
    out = templates.cohort(shop(spark, sf_dir), AS_OF, "month", 84)
    return out.select("consumer_id", "cohort_start", "orders", F.concat_ws(",", F.transform("active_periods", lambda x: F.lpad(x.cast("string"), 3, "0"))).alias("active"))


@query(f"WITH {SHOP_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY day, order_id) AS k FROM q) SELECT consumer_id, count(*) AS orders, min(day) FILTER (k = 1) AS first_order_date, min(day) FILTER (k = 2) AS second_order_date, date_diff('day', min(day) FILTER (k = 1), min(day) FILTER (k = 2))::BIGINT AS days_to_second, coalesce(date_diff('day', min(day) FILTER (k = 1), min(day) FILTER (k = 2)) <= 90, false) AS repurchased FROM r GROUP BY 1")
def d49_repurchase_template(spark, sf_dir):
    return templates.repurchase(shop(spark, sf_dir), 90)


@query(f"WITH {SHOP_SQL}, c AS (SELECT consumer_id, count(*) AS orders, date_diff('day', min(day), max(day)) / (count(*) - 1) AS gap, date_diff('day', max(day), DATE '2002-01-01')::BIGINT AS recency_days FROM q GROUP BY 1 HAVING count(*) >= 3) SELECT consumer_id, orders, round(gap, 2) AS avg_gap_days, recency_days, round((recency_days / greatest(gap, 7.0::DOUBLE))::DECIMAL(18,6), 2)::DOUBLE AS silence_ratio, round((recency_days / greatest(gap, 7.0::DOUBLE))::DECIMAL(18,6), 2)::DOUBLE > 2 AS at_risk FROM c")
def d50_churn_template(spark, sf_dir):
    return templates.churn(shop(spark, sf_dir), AS_OF)


@query(f"WITH {SHOP_SQL}, c AS (SELECT consumer_id, count(*) AS orders, sum(amount) AS s, date_diff('day', max(day), DATE '2002-01-01')::BIGINT AS recency_days, date_diff('day', min(day), DATE '2002-01-01')::BIGINT AS tenure_days FROM q GROUP BY 1) SELECT consumer_id, orders, recency_days, greatest(tenure_days, 30)::BIGINT AS tenure_days, round(orders * 365.0::DOUBLE / greatest(tenure_days, 30), 4) AS freq_per_year, round(exp(-recency_days / greatest(greatest(tenure_days, 30) / orders, 30.0::DOUBLE) / 2), 4) AS p_alive FROM c")
def d51_clv_template(spark, sf_dir):
    return templates.clv(shop(spark, sf_dir), AS_OF).select("consumer_id", "orders", "recency_days", "tenure_days", F.round("freq_per_year", 4).alias("freq_per_year"), F.round("p_alive", 4).alias("p_alive"))


@query(f"WITH {SHOP_SQL}, c AS (SELECT DISTINCT c_custkey % 1300 AS consumer_id FROM customer), o AS (SELECT consumer_id, count(*) AS orders, max(day) AS last_order_date FROM q GROUP BY 1), g AS (SELECT user_id AS consumer_id, bool_or(event_type = 'click') AS consent_push FROM events GROUP BY 1) SELECT consumer_id, coalesce(orders, 0) AS orders, last_order_date, coalesce(consent_push, false) AS consent_push FROM c LEFT JOIN o USING (consumer_id) LEFT JOIN g USING (consumer_id)")
def d52_user_360_template(spark, sf_dir):
    consumers = t(spark, sf_dir, "customer").select((F.col("c_custkey") % 1300).alias("consumer_id")).distinct()
    consents = t(spark, sf_dir, "events").select(F.col("user_id").alias("consumer_id"), F.lit("push").alias("channel"), F.when(F.col("event_type") == "click", "granted").otherwise("revoked").alias("status"))
    return templates.user_360(consumers, shop(spark, sf_dir), consents, AS_OF).select("consumer_id", "orders", "last_order_date", "consent_push")


@query(f"WITH {SHOP_SQL}, c AS (SELECT consumer_id, count(*) AS n FROM q GROUP BY 1) SELECT count(*) AS buyers, count(*) FILTER (n > 1) AS repeat_buyers, round(count(*) FILTER (n > 1) / count(*), 6) AS rate FROM c")
def d74_template_summary(spark, sf_dir):
    r = templates.repurchase(shop(spark, sf_dir), 10**6)
    return r.agg(F.count("*").alias("buyers"), F.count_if("repurchased").alias("repeat_buyers")).withColumn("rate", F.round(F.col("repeat_buyers") / F.col("buyers"), 6))


# quality


@query("SELECT rule, (SELECT count(*) FROM orders) AS rows, failed, failed = 0 AS passed FROM (SELECT 'price' AS rule, count(*) FILTER (NOT o_totalprice >= 0) AS failed FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 'not future', count(*) FILTER (NOT o_orderdate < '2000-01-01') FROM orders)")
def d22_quality_checks(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") >= 0, "status": F.col("o_orderstatus").isin("F", "O"), "not future": F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")}
    return quality.check_rows(t(spark, sf_dir, "orders"), rules)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def d59_duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(t(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT count(*)::BIGINT AS with_value, (count(*) FILTER (user_id NOT IN (SELECT s_suppkey FROM supplier)))::BIGINT AS orphans FROM events")
def d57_orphans(spark, sf_dir):
    return quality.orphans(t(spark, sf_dir, "events"), t(spark, sf_dir, "supplier"), "user_id", "s_suppkey")


@query("SELECT 'big' AS rule, c_custkey::VARCHAR AS key FROM customer WHERE NOT c_acctbal <= 9000 ORDER BY key LIMIT 100")
def d56_quarantine(spark, sf_dir):
    return quality.quarantine(t(spark, sf_dir, "customer"), F.col("c_acctbal") <= 9000, "c_custkey", "big").drop("row")


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n FROM d QUALIFY n < 0.97 * avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def d54_row_drop(spark, sf_dir):
    daily = t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return quality.drop_against_mean(daily, "day", "n", share=0.97).drop("mean_before")


@query("WITH c AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) SELECT o_orderkey, p + o_custkey AS expected FROM c WHERE p + o_custkey IS NOT NULL AND p + o_custkey != o_totalprice")
def d54_points_chain(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("change", F.col("o_custkey"))
    return identity.point_chain_breaks(o, "o_custkey", "o_orderdate", "o_orderkey", "change", "o_totalprice").select("o_orderkey", "expected")


@query()
def g21_profile(spark, sf_dir):
    return quality.profile(t(spark, sf_dir, "customer"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def g21_top_values(spark, sf_dir):
    return quality.top_values(t(spark, sf_dir, "events"), "event_type")


# scalar functions


@query("SELECT c_custkey, substr(c_name, 1, 3) || '-' || lpad(c_custkey::VARCHAR, 8, '0') AS code, regexp_replace(c_name, '[0-9]+', '#', 'g') AS pattern, regexp_extract(c_name, '([0-9]+)', 1) AS digits, length(c_name) AS n, sha256('salt' || c_name) AS pseudo, substr(c_name, 1, 1) || repeat('*', length(c_name) - 1) AS masked FROM customer")
def f1_strings_and_masks(spark, sf_dir):
    name = F.col("c_name")
    return t(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.substring(name, 1, 3), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("code"),
        F.regexp_replace(name, "[0-9]+", "#").alias("pattern"),
        F.regexp_extract(name, "([0-9]+)", 1).alias("digits"),
        F.length(name).cast("long").alias("n"),
        X.pseudonym(name, "salt").alias("pseudo"),
        X.mask_name(name).alias("masked"),
    )


@query("SELECT o_orderkey, date_trunc('quarter', o_orderdate)::DATE AS quarter, date_trunc('week', o_orderdate)::DATE AS week, date_diff('month', o_orderdate, TIMESTAMP '2002-01-01')::BIGINT AS months, date_diff('hour', o_orderdate, TIMESTAMP '2002-01-01 00:30:00')::BIGINT AS hours, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def f2_dates(spark, sf_dir):
    at, end = F.col("o_orderdate"), F.lit("2002-01-01 00:30:00").cast("timestamp_ntz")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.to_date(F.date_trunc("quarter", at)).alias("quarter"), F.to_date(F.date_trunc("week", at)).alias("week"), X.months_between(end, at).alias("months"), X.hours_between(end, at).alias("hours"), F.date_format(at, "yyyy-MM").alias("ym"))


@query("SELECT p_partkey, p_size % 7 AS r, p_size // 7 AS q, round(ln(p_size + 1), 6) AS l, round(pow(p_size, 1.5), 4) AS p, floor(p_retailprice)::BIGINT AS f, abs(p_size - 25) AS a FROM part")
def f3_math(spark, sf_dir):
    s = F.col("p_size")
    return t(spark, sf_dir, "part").select("p_partkey", (s % 7).alias("r"), F.expr("p_size div 7").cast("int").alias("q"), F.round(F.log(s + 1), 6).alias("l"), F.round(F.pow(s, F.lit(1.5)), 4).alias("p"), F.floor("p_retailprice").alias("f"), F.abs(s - 25).alias("a"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, (props ->> '$.missing') IS NOT NULL AS has_missing FROM events")
def f4_json_and_variant(spark, sf_dir):
    e = readers.variant_fields(t(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": ("$.k", "long"), "missing": ("$.missing", "string")})
    return e.select("event_id", "k", F.col("missing").isNotNull().alias("has_missing"))


@query("SELECT o_orderpriority, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::BIGINT - 1 AS rank, count(*) AS n FROM orders GROUP BY 1")
def f5_ordered_enum(spark, sf_dir):
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    counted = t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", X.ordinal(F.col("o_orderpriority"), kinds)).withColumn("rank", F.coalesce("rank", F.lit(-1)))


@query("SELECT p_partkey, list_aggregate(list_transform(range(1, p_size + 1), lambda x: x * x), 'sum')::BIGINT AS squares, len(list_filter(range(1, p_size + 1), lambda x: x % 3 = 0))::BIGINT AS threes FROM part")
def f6_lists(spark, sf_dir):
    every = F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long"))
    return t(spark, sf_dir, "part").select("p_partkey", F.aggregate(F.transform(every, lambda x: x * x), F.lit(0).cast("long"), lambda a, x: a + x).alias("squares"), F.size(F.filter(every, lambda x: x % 3 == 0)).cast("long").alias("threes"))


# retrieval


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20")
def v3_top_k_cosine(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    target = [float(x) for x in e.where("vec_id = 7").first()["embedding"]]
    return search.nearest_vectors(e, "vec_id", "embedding", target, 20).withColumn("similarity", F.round("similarity", 6))


@query("WITH p AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e JOIN embeddings q ON e.vec_id != q.vec_id WHERE q.vec_id % 20 = 0) SELECT query, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS place FROM p QUALIFY place <= 5")
def j14_k_nearest_join(spark, sf_dir):
    """Every row whose id is divisible by 20 against all rows."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.k_nearest_of_each(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 6))


@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d), h AS (SELECT doc_id, len(ts) AS l, w AS term, len(list_filter(ts, lambda x: x = w)) AS tf FROM d, (VALUES ('the'), ('that'), ('avec')) q(w)),
    f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM h GROUP BY 1) SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM h JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id"""
)
def v2_bm25(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return search.bm25(t(spark, sf_dir, "documents"), "doc_id", tokens, ["the", "that", "avec"]).withColumn("score", F.round("score", 6))


@query("WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents) SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) AS gram FROM c) GROUP BY gram")
def v1_bigrams(spark, sf_dir):
    """Document frequencies of the bigrams of whole texts, counted within each document first."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.explode(X.bigrams(F.col("text"))).alias("gram"))
    by = d.groupBy("doc_id", "gram").agg(F.count("*").alias("k"))
    return by.where(F.length("gram") == 2).groupBy("gram").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query("WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part QUALIFY place <= 50), b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 50) SELECT id, round(sum(s), 9) AS score FROM (SELECT id, 2.0::DOUBLE / (60 + place) AS s FROM a UNION ALL SELECT id, 1.0::DOUBLE / (60 + place) FROM b) GROUP BY id")
def v6_rank_fusion(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")

    def lane(by):  # fifty rows, numbered by a window over themselves
        return p.orderBy(F.desc(by), "id").limit(50).select("id", F.row_number().over(W.partitionBy().orderBy(F.desc(by), "id")).alias("place"))

    return search.fuse({"size": lane("p_size"), "price": lane("p_retailprice")}, "id", {"size": 2.0}).withColumn("score", F.round("score", 9))


#: Two lists of contacts made from customers: b's have their telephone as it is, written otherwise, or none, and names with few, more or other letters changed; some of a's occur twice.
CONTACTS_SQL = """p AS (SELECT c_custkey AS k, (13000000000 + (c_custkey * 7919) % 99999989)::VARCHAR AS phone, left(md5(c_custkey::VARCHAR), 10) AS name, c_nationkey AS city, 1950 + c_custkey % 40 AS birth FROM customer),
    a AS (SELECT k AS a_id, phone, name, city, birth FROM p UNION ALL SELECT k + 1000000000, NULL, name, city, birth FROM p WHERE k % 33 = 0),
    b AS (SELECT k + 2000000000 AS b_id, CASE k // 3 % 6 WHEN 0 THEN phone WHEN 1 THEN '+86 ' || left(phone, 3) || '-' || substr(phone, 4) END AS phone,
      CASE k // 3 % 6 WHEN 2 THEN left(name, 4) || 'z' || substr(name, 6) WHEN 3 THEN left(name, 4) || substr(name, 6, 1) || substr(name, 5, 1) || substr(name, 7) WHEN 4 THEN left(name, 4) || 'zzz' || substr(name, 8) WHEN 5 THEN left(md5('x' || k), 10) ELSE name END AS name,
      city, birth, CASE WHEN k // 3 % 6 != 5 THEN k END AS true_a_id FROM p WHERE k % 3 = 0)"""
MATCH_SQL = """by_raw AS (SELECT b_id, a_id FROM b JOIN a USING (phone)), by_phone AS (SELECT b_id, a_id FROM b JOIN a ON right(regexp_replace(b.phone, '[^0-9]', '', 'g'), 11) = right(regexp_replace(a.phone, '[^0-9]', '', 'g'), 11)),
    by_name AS (SELECT r.b_id, a.a_id, jaro_winkler_similarity(a.name, r.name) AS s FROM (SELECT * FROM b WHERE b_id NOT IN (SELECT b_id FROM by_phone)) r JOIN a ON a.city = r.city AND a.birth = r.birth WHERE jaro_winkler_similarity(a.name, r.name) >= 0.9
      QUALIFY row_number() OVER (PARTITION BY r.b_id ORDER BY s DESC) = 1 AND count(*) OVER (PARTITION BY r.b_id, s) = 1)"""


def contacts(spark, sf_dir):
    k = F.col("c_custkey")
    p = t(spark, sf_dir, "customer").select(
        k.alias("k"), (13_000_000_000 + (k * 7919) % 99_999_989).cast("string").alias("phone"), F.substring(F.md5(k.cast("string")), 1, 10).alias("name"), F.col("c_nationkey").alias("city"), (1950 + k % 40).alias("birth")
    )
    own = p.select(F.col("k").alias("a_id"), "phone", "name", "city", "birth")
    again = p.where("k % 33 = 0").select((F.col("k") + 1_000_000_000).alias("a_id"), F.lit(None).cast("string").alias("phone"), "name", "city", "birth")
    b = p.where("k % 3 = 0").selectExpr(
        "k + 2000000000 AS b_id",
        "CASE k div 3 % 6 WHEN 0 THEN phone WHEN 1 THEN '+86 ' || left(phone, 3) || '-' || substr(phone, 4) END AS phone",
        "CASE k div 3 % 6 WHEN 2 THEN left(name, 4) || 'z' || substr(name, 6) WHEN 3 THEN left(name, 4) || substr(name, 6, 1) || substr(name, 5, 1) || substr(name, 7) WHEN 4 THEN left(name, 4) || 'zzz' || substr(name, 8) WHEN 5 THEN left(md5('x' || k), 10) ELSE name END AS name",
        "city", "birth", "CASE WHEN k div 3 % 6 != 5 THEN k END AS true_a_id",
    )
    return own.unionByName(again), b


def bare_phone():
    return F.expr("right(regexp_replace(phone, '[^0-9]', ''), 11)")


@query(f"WITH {CONTACTS_SQL}, {MATCH_SQL} SELECT b_id, a_id, 'phone' AS how FROM by_phone UNION ALL SELECT b_id, a_id, 'name' FROM by_name")
def d20_blocked_fuzzy_match(spark, sf_dir):
    """By normalised telephone, then by name within city and year of birth, equally good candidates dropped."""
    a, b = contacts(spark, sf_dir)
    return matching.match(a, b, bare_phone(), ["city", "birth"])


@query(f"WITH {CONTACTS_SQL}, {MATCH_SQL}, m AS (SELECT 'raw phone' AS method, b_id, a_id FROM by_raw UNION ALL SELECT 'phone', b_id, a_id FROM by_phone UNION ALL SELECT 'phone, then name', b_id, a_id FROM by_phone UNION ALL SELECT 'phone, then name', b_id, a_id FROM by_name) SELECT method, count(*) AS pairs, count(*) FILTER (b.true_a_id = m.a_id) AS correct, (SELECT count(*) FROM b WHERE true_a_id IS NOT NULL) AS expected FROM m JOIN b USING (b_id) GROUP BY method")
def d20_match_quality(spark, sf_dir):
    """What each of the three stages finds, of what there is to be found."""
    a, b = contacts(spark, sf_dir)
    found = {"raw phone": matching.by_key(a, b, F.col("phone")), "phone": matching.by_key(a, b, bare_phone()), "phone, then name": matching.match(a, b, bare_phone(), ["city", "birth"])}
    return matching.quality(found, b.select("b_id", "true_a_id"))


@query("SELECT c_nationkey, count(*) AS n, round(max(jaro_winkler_similarity(c_name, 'Customer#000000042')), 9) AS nearest FROM customer GROUP BY 1")
def j13_similarity_by_block(spark, sf_dir):
    """Of each block, the greatest similarity to a name; distinct names are measured once."""
    names = t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_name").agg(F.count("*").alias("k"))
    measured = names.withColumn("s", jaro_winkler("c_name", F.lit("Customer#000000042")))
    return measured.groupBy("c_nationkey").agg(F.sum("k").alias("n"), F.round(F.max("s"), 9).alias("nearest"))


@query("SELECT s_suppkey, levenshtein(s_name, 'Supplier#0042')::BIGINT AS edits, round(jaccard(s_name, 'Supplier#0042'), 9) AS chars FROM supplier")
def f7_similarities(spark, sf_dir):
    target = F.lit("Supplier#0042")
    return t(spark, sf_dir, "supplier").select("s_suppkey", F.levenshtein("s_name", target).cast("long").alias("edits"), F.round(X.jaccard(F.col("s_name"), target), 9).alias("chars"))


@query(
    """WITH v AS (SELECT o_custkey AS k, p_brand AS brand, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), u AS (SELECT k, sum(w) AS all_w FROM v GROUP BY 1),
    b AS (SELECT brand, sum(w) AS bw FROM v GROUP BY 1), c AS (SELECT u.k, b.brand, bw FROM u, b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.k = u.k AND v.brand = b.brand)) SELECT k, brand, row_number() OVER (PARTITION BY k ORDER BY bw DESC, brand) AS place FROM c QUALIFY place <= 3"""
)
def d17_recommend_unbought(spark, sf_dir):
    """The most bought brands that a customer has none of. Brands are a small list; the customer's own are taken out of it, not joined out."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    v = lines.join(t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), F.expr("l_orderkey = o_orderkey")).join(t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand")), F.expr("l_partkey = p_partkey"))
    ranked = v.groupBy("brand").agg(F.sum("w").alias("bw")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("bw")).alias("n"), "brand"))), lambda x: x["brand"]).alias("_all"))
    own = v.groupBy("k").agg(F.collect_set("brand").alias("_own")).crossJoin(small(ranked))
    best = F.slice(F.array_except("_all", "_own"), 1, 3)
    return own.select("k", F.posexplode(best).alias("p", "brand")).select("k", "brand", (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT o_custkey AS k, max(o_totalprice) AS value, 'top' AS metric FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, count(*)::DOUBLE, 'orders' FROM orders GROUP BY 1")
def k19_serving_rows(spark, sf_dir):
    one = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"), F.count("*").cast("double").alias("orders"))
    rows = one.select("k", F.explode(F.array(F.struct(F.lit("top").alias("metric"), F.col("top").alias("value")), F.struct(F.lit("orders").alias("metric"), F.col("orders").alias("value")))).alias("r"))
    return rows.select("k", "r.value", "r.metric").repartitionByRange("k").sortWithinPartitions("k")


@query(f"WITH {TAG_SQL} SELECT c_custkey FROM g WHERE tag = 'other' AND c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') ORDER BY 1")
def k20_cohort_export(spark, sf_dir):
    from larkspur.sources.tables import export_cohort

    buyers = t(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"), F.lit("yes").alias("tag"))
    return export_cohort({"value": (tagged(spark, sf_dir, 12), "other"), "bought": (buyers, "yes")}, "c_custkey")


@query("WITH f AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM f")
def k22_incremental_months(spark, sf_dir):
    from larkspur.sources.tables import incremental_months

    fresh = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    stale = fresh.where("month <= '1999-06-01'").withColumn("n", F.when(F.col("month") >= "1999-05-01", F.lit(0).cast("long")).otherwise(F.col("n")))
    return incremental_months(stale, fresh, "month", ["k", "month"])


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def o12_distinct_on(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return topn.top_rows(o, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 1)
