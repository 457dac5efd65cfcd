"""Sources, sinks, versions and streams: each query writes its input in the format concerned to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.checkpoints import shared_dir
from larkspur.operators import changes
from larkspur.sources import readers, tables
from larkspur.streaming import incremental

from .registry import query
from .relational import t


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s1_parquet_columns(spark, sf_dir):
    return readers.parquet(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, o_totalprice FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03'")
def s2_hive_partitions(spark, sf_dir):
    """Written by month; the filter on the month prunes folders."""
    at = folder(spark, "months")
    tables.overwrite_partitions(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month")).repartition("month"), at, ["month"])
    return readers.parquet(spark, at).where("month = '1996-03'")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'two' ELSE 'one' END AS source FROM customer")
def s3_union_by_name(spark, sf_dir):
    at, c = folder(spark, "versions"), t(spark, sf_dir, "customer")
    c.where("c_custkey % 2 = 1").select("c_custkey", "c_name").write.parquet(f"{at}/one")
    c.where("c_custkey % 2 = 0").select("c_name", "c_acctbal", "c_custkey").write.parquet(f"{at}/two")
    df = readers.parquet(spark, f"{at}/*", merge=True, file_column="_file")
    return df.select("c_custkey", "c_name", "c_acctbal", F.regexp_extract("_file", "/(one|two)/[^/]*$", 1).alias("source"))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def s4_json_lines(spark, sf_dir):
    at = folder(spark, "json")
    t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value")).write.option("compression", "gzip").json(at)
    return readers.json_lines(spark, at, "event_id long, user_id long, event_type string, value double")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s5_csv(spark, sf_dir):
    at = folder(spark, "csv")
    t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).option("compression", "gzip").csv(at)
    return readers.csv_table(spark, at, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT 'good' AS side, count(*) AS n FROM customer WHERE c_custkey % 10 != 0 UNION ALL SELECT 'c_custkey: not a bigint', count(*) FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT 'c_acctbal: not a double', count(*) FROM customer WHERE c_custkey % 20 = 10")
def s6_csv_rejects(spark, sf_dir):
    at, k = folder(spark, "rejects"), F.col("c_custkey")
    key = F.when(k % 20 == 0, "x").otherwise(k.cast("string"))
    balance = F.when(k % 20 == 10, "none").otherwise(F.col("c_acctbal").cast("string"))
    t(spark, sf_dir, "customer").select(key.alias("c_custkey"), balance.alias("c_acctbal")).write.option("header", True).csv(at)
    good, bad = readers.csv_with_rejects(spark, at, T.StructType().add("c_custkey", "long").add("c_acctbal", "double"))
    return good.select(F.lit("good").alias("side")).unionByName(bad.select(F.col("reason").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_custkey * 2 AS points FROM customer")
def s15_paged_service(spark, sf_dir):
    """A stand-in for a service that gives pages of 100 by key, asked from the table's least to its greatest one."""
    first, last = t(spark, sf_dir, "customer").agg(F.coalesce(F.min("c_custkey"), F.lit(0)), F.coalesce(F.max("c_custkey"), F.lit(-1))).first()

    def fetch(after: int, until: int, size: int) -> list[dict]:
        return [{"id": k, "points": 2 * k} for k in range(after + 1, min(until, after + size, last) + 1)]

    return readers.paged(spark, fetch, "id long, points long", lower=first - 1, upper=last, parts=4, size=100)


@query("SELECT k, k // 2 AS half FROM range(0, 1000) r(k)")
def s18_generator(spark, sf_dir):
    return spark.range(1000).select(F.col("id").alias("k"), F.expr("id div 2").alias("half"))


@query("SELECT table_name, count(*) AS columns FROM information_schema.columns WHERE table_name IN ('customer', 'orders') GROUP BY 1")
def s22_catalog(spark, sf_dir):
    row = [(n, len(t(spark, sf_dir, n).schema)) for n in ("customer", "orders")]
    return spark.createDataFrame(row, "table_name string, columns long")


def versioned(spark, sf_dir):
    table, c = tables.VersionedTable(spark, folder(spark, "table")), t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    table.write(c.where("c_custkey % 3 != 0"), sort_by=("c_custkey",))
    table.upsert(c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])
    return table


@query("SELECT 1::BIGINT AS version, count(*) AS n, count(*) FILTER (c_mktsegment = 'NEW') AS new_n FROM customer WHERE c_custkey % 3 != 0 UNION ALL SELECT 2, count(*), count(*) FILTER (c_custkey % 5 = 0) FROM customer WHERE c_custkey % 3 != 0 OR c_custkey % 5 = 0")
def s24_time_travel(spark, sf_dir):
    table = versioned(spark, sf_dir)
    one = lambda v: table.read(v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "NEW").alias("new_n"))
    return one(1).unionByName(one(2))


@query("SELECT CASE WHEN c_custkey % 3 != 0 THEN 'update' ELSE 'insert' END AS _op, count(*) AS n FROM customer WHERE c_custkey % 5 = 0 GROUP BY 1")
def s25_change_feed(spark, sf_dir):
    return versioned(spark, sf_dir).changes(1, 2, ["c_custkey"]).groupBy("_op").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 OR event_id % 4 = 0 GROUP BY 1")
def k4_idempotent_batches(spark, sf_dir):
    """The second batch is written twice; it replaces itself."""
    at, e = folder(spark, "batches"), t(spark, sf_dir, "events").select("event_id", "event_type")
    tables.append_batch(e.where("event_id % 2 = 1"), at, "1")
    for _ in range(2):
        tables.append_batch(e.where("event_id % 4 = 0"), at, "2")
    return readers.parquet(spark, at).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer")
def k29_inventory(spark, sf_dir):
    return tables.inventory(spark, {"customer": f"{sf_dir}/customer.parquet"}).select("name", "rows")


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def streamed(spark, sf_dir, files: int = 4):
    """The events as a stream of files."""
    at = folder(spark, "stream")
    t(spark, sf_dir, "events").repartition(files, "event_id").write.parquet(at)
    return incremental.files(spark, at, EVENTS, per_batch=2)


@query("SELECT event_id, user_id, event_type FROM events")
def r1_stream_append(spark, sf_dir):
    at = folder(spark, "appended")
    incremental.append(streamed(spark, sf_dir).select("event_id", "user_id", "event_type"), f"{at}/data", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/data")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM events GROUP BY 1")
def r3_stream_merge_totals(spark, sf_dir):
    at = folder(spark, "totals")
    table = tables.BucketedTable(spark, f"{at}/table", ["event_type"])
    incremental.merge_totals(streamed(spark, sf_dir), table, ["event_type"], {"n": "count(*)", "total": "sum(value)"}, ["event_id"], f"{at}/state").awaitTermination()
    return table.read().select("event_type", "n", F.round("total", 4).alias("total"), F.col("event_id").alias("last_id"))


def ended(spark, sf_dir):
    """The events as a stream, and behind them, in a file of its own, a row without a user of twenty years on, by which the watermark closes all that is open."""
    at, e = folder(spark, "stream"), t(spark, sf_dir, "events")
    e.repartition(4, "event_id").write.parquet(at)
    e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 20 YEARS")).alias("ts"), *(F.lit(None).cast(k).alias(c) for c, k in (("user_id", "long"), ("event_type", "string"), ("value", "double"), ("props", "string")))).write.mode("append").parquet(at)
    return incremental.files(spark, at, EVENTS, per_batch=2).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(frame, spark, name: str):
    """What a streaming aggregate puts out for good, in files: each row once, when the watermark has passed it."""
    at = folder(spark, name)
    incremental.append(frame, f"{at}/data", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/data")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r6_stream_windows(spark, sf_dir):
    at = ended(spark, sf_dir)
    out = finished(incremental.window_totals(at, "ts", ["event_type"], "value", late="3650 days"), spark, "windows").where("event_type IS NOT NULL")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
    SELECT user_id, min(ts) AS began, count(*) AS events FROM s GROUP BY user_id, k"""
)
def r5_stream_sessions(spark, sf_dir):
    at = ended(spark, sf_dir)
    out = finished(incremental.session_totals(at, "ts", "user_id", late="3650 days"), spark, "sessions").where("user_id IS NOT NULL")
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "events")


@query("SELECT c_custkey AS key, c_mktsegment AS old, 'MOVED' AS new FROM customer WHERE c_custkey % 9 = 0")
def r4_update_audit(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    after = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return incremental.audit_updates(c, after, "c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "key")


@query("SELECT 'added' AS change, 'note' AS column_name, false AS breaking UNION ALL SELECT 'narrowed', 'c_acctbal', true UNION ALL SELECT 'removed', 'c_name', true UNION ALL SELECT 'widened', 'c_nationkey', false")
def r19_schema_changes(spark, sf_dir):
    before = t(spark, sf_dir, "customer")
    after = before.drop("c_name").withColumns({"note": F.lit(""), "c_nationkey": F.col("c_nationkey").cast("long"), "c_acctbal": F.col("c_acctbal").cast("int")})
    found = [(kind, column, breaks) for column, kind, breaks in changes.schema_diff(before.schema, after.schema)]
    return spark.createDataFrame(found, "change string, column_name string, breaking boolean")


@query("SELECT DISTINCT user_id FROM events")
def r8_stream_first_seen(spark, sf_dir):
    """Each user once, by a stream's state within the watermark."""
    at = folder(spark, "first")
    seen = incremental.first_seen(streamed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", late="3650 days")
    incremental.append(seen.select("user_id"), f"{at}/data", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/data")
