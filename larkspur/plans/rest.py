"""The remaining single operators of the inventory, each as a query of its own."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions import expressions as X
from larkspur.operators import asof, changes, identity, merge, metrics, ranks, search, topn
from larkspur.sources import readers, tables

from .domain import AS_OF, RECORDS_SQL, TO_REGION, lake, records
from .files import folder
from .registry import query
from .relational import small, t

# sources


@query("SELECT c_custkey::VARCHAR AS id, '客户' || c_name AS name FROM customer")
def s7_sniffed_csv(spark, sf_dir):
    """Written with semicolons in a Chinese encoding; what a preview of the first bytes finds is what it is read with."""
    at = folder(spark, "gbk")
    readers.allow_encoding(spark, "GB18030")
    named = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("客户"), "c_name").alias("name"))
    named.write.options(header=True, sep=";", encoding="GB18030").csv(at)
    head = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(at).where("length > 0").select(F.substring("content", 1, 4000).alias("c")).first()["c"]
    found = readers.sniff(bytes(head))
    return readers.csv_table(spark, at, encoding=found["encoding"], delimiter=found["delimiter"], header=found["header"])


@query("SELECT c_custkey, c_nationkey AS home_nation, c_mktsegment AS home_more_segment FROM customer")
def s13_nested_fields(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    nested = c.select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("segment")).alias("more")).alias("home"))
    return readers.flatten(nested)


@query("SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def s19_federated_join(spark, sf_dir):
    """Parquet, CSV and JSON in one query."""
    at = folder(spark, "federated")
    t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.option("header", True).csv(f"{at}/c")
    t(spark, sf_dir, "nation").write.json(f"{at}/n")
    c = readers.csv_table(spark, f"{at}/c", "c_custkey long, c_nationkey int")
    n = readers.json_lines(spark, f"{at}/n", "n_nationkey int, n_name string, n_regionkey int")
    by = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return by.join(c, "c_custkey").join(small(n), F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.sum("k").alias("n"))


@query("SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def s23_tables_and_rows(spark, sf_dir):
    """Counts without a column are answered from the files' footers."""
    paths = readers.prefix_tables(spark, sf_dir)
    one = lambda n: spark.read.parquet(paths[n]).agg(F.lit(n).alias("name"), F.count("*").alias("rows"))
    return one("nation").unionByName(one("region"))


# sinks


@query("SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY ALL")
def k2_partitioned_write(spark, sf_dir):
    at = folder(spark, "parts")
    t(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("g")).repartition("event_type").write.option("compression", "zstd").partitionBy("event_type").parquet(at)
    return spark.read.parquet(at).groupBy("event_type", "g").agg(F.count("*").alias("n"))


@query("SELECT 'csv' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'json', count(*) FROM nation UNION ALL SELECT 'parquet', 2 * count(*) FROM nation")
def k6_exports(spark, sf_dir):
    at, n = folder(spark, "exports"), t(spark, sf_dir, "nation")
    n.write.option("compression", "gzip").option("header", True).csv(f"{at}/csv")
    n.write.option("compression", "gzip").json(f"{at}/json")
    for _ in range(2):
        n.write.mode("append").parquet(f"{at}/parquet")
    back = {"csv": spark.read.option("header", True).csv(f"{at}/csv"), "json": spark.read.json(f"{at}/json"), "parquet": spark.read.parquet(f"{at}/parquet")}
    counts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in back.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def k7_create_table_as(spark, sf_dir):
    name = f"by_nation_{uuid.uuid4().hex}"
    t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).write.saveAsTable(name)
    return spark.table(name)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77")
def k8_clustered_write(spark, sf_dir):
    """Sorted by customer over ranges, so that a lookup reads few row groups."""
    at = folder(spark, "clustered")
    t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartitionByRange(4, "o_custkey").sortWithinPartitions("o_custkey").write.parquet(at)
    return spark.read.parquet(at).where("o_custkey = 77")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS v FROM customer")
def k11_insert_or_replace(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return changes.upsert(c.withColumn("v", F.lit("first")), c.where("k % 2 = 0").withColumn("v", F.lit("second")), ["k"])


@query("SELECT 1::BIGINT AS version, count(*) AS n FROM nation")
def k13_failed_write(spark, sf_dir):
    """A write that fails on the way leaves no version behind."""
    table, n = tables.VersionedTable(spark, folder(spark, "failing")), t(spark, sf_dir, "nation")
    table.write(n)
    try:
        table.write(n.withColumn("n_name", F.raise_error(F.lit("stop"))))
    except Exception as e:
        if "stop" not in str(e):
            raise
    return table.read().agg(F.lit(table.versions()[-1]).cast("long").alias("version"), F.count("*").alias("n"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
def k16_partition_evolution(spark, sf_dir):
    """Older batches by year, later ones by year and month; both are read as one table."""
    at = folder(spark, "evolved")
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").alias("m"))
    o.where("o_orderkey % 2 = 0").repartition("y").write.partitionBy("y").parquet(f"{at}/one")
    o.where("o_orderkey % 2 = 1").repartition("y").write.partitionBy("y", "m").parquet(f"{at}/two")
    both = spark.read.parquet(f"{at}/one").unionByName(spark.read.parquet(f"{at}/two"), allowMissingColumns=True)
    return both.groupBy(F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, 2::BIGINT AS versions, true AS fewer FROM orders")
def k17_compaction_and_expiry(spark, sf_dir):
    table, o = tables.VersionedTable(spark, folder(spark, "small")), t(spark, sf_dir, "orders")
    each = 32 << 20  # of a file, so that the rows that a task takes for it, which are several times as large, stay bounded
    for _ in range(3):
        table.write(o.repartition(5 * tables.files_for(tables.folder_bytes(spark, f"{sf_dir}/orders.parquet"), each), "o_orderkey"))
    table.expire(1)
    before = table.read().select("_metadata.file_path").distinct().count()
    size = tables.folder_bytes(spark, f"{table.path}/v={table.versions()[-1]}")
    table.write(table.read().repartitionByRange(tables.files_for(size, each), "o_orderkey"))
    return table.read().agg(F.count("*").alias("n"), F.lit(len(table.versions())).cast("long").alias("versions"), (F.countDistinct("_metadata.file_path") < before).alias("fewer"))


@query("SELECT c_custkey, length(c_name) * 2 AS tokens FROM customer")
def k25_add_and_fill_column(spark, sf_dir):
    table = tables.VersionedTable(spark, folder(spark, "column"))
    table.write(t(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    table.write(table.read().withColumn("tokens", (F.length("c_name") * 2).cast("long")))
    return table.read().select("c_custkey", "tokens")


def save_result(df: DataFrame, name: str) -> str:
    """A query's result as a table of the user's own, under a plain name."""
    if not re.fullmatch(r"[a-z][a-z0-9_]{0,62}", name):
        raise ValueError("a table's name is lower-case letters, digits and underscores")
    df.write.mode("overwrite").saveAsTable(name)
    return name


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def k27_saved_result(spark, sf_dir):
    return spark.table(save_result(t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")), f"mine_{uuid.uuid4().hex[:8]}"))


# order, joins, aggregates


@query("SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 3) DESC NULLS LAST, c_custkey) AS place FROM customer")
def o1_explicit_null_order(spark, sf_dir):
    """Places over the whole table: the nulls' lead is below all others'."""
    n = F.nullif("c_nationkey", F.lit(3))
    c = t(spark, sf_dir, "customer").select("c_custkey", F.coalesce(-n.cast("double"), F.lit(float("inf"))).alias("lead"))
    return ranks.ranked(c, "lead", "c_custkey").select("c_custkey", F.col("_row").cast("long").alias("place"))


@query("SELECT r_name AS region, n_name AS nation, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def j17_shared_path_prefixes(spark, sf_dir):
    """Two dimensions over the same hops: the joins of the shorter are those of the longer."""
    m = metrics.Metric("order", "count", dimensions={"region": metrics.Path("r_name", TO_REGION), "nation": metrics.Path("n_name", TO_REGION[:2])})
    return metrics.evaluate(m, lake(spark, sf_dir), AS_OF)


@query("SELECT c_custkey % 1200 AS consumer_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY 1")
def j18_consumer_links(spark, sf_dir):
    """Orders of two sources; only one source's customers are linked."""
    source = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")
    o = t(spark, sf_dir, "orders").select("o_orderkey", source.alias("_customer_source"), F.col("o_custkey").alias("customer_id"))
    links = t(spark, sf_dir, "customer").select(F.lit("a").alias("_source"), F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 1200).alias("consumer_id"))
    return metrics.link_consumers(o, links).groupBy("consumer_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, min(ts) AS first_ts, arg_min(event_type, ts) AS first_type FROM events GROUP BY 1")
def g15_first_by_time(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query()
def g11_approximate_distinct(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS total, round(max(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w14_named_window(spark, sf_dir):
    return spark.sql(
        """SELECT o_orderkey, round(sum(o_totalprice) OVER sofar, 2) AS total, round(max(o_totalprice) OVER three, 2) AS recent FROM {o}
        WINDOW sofar AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        three AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        o=t(spark, sf_dir, "orders"),
    )


# changes


@query("SELECT count(*) AS rows, count(DISTINCT (c_name, c_acctbal)) AS hashes FROM customer")
def r9_row_hashes(spark, sf_dir):
    h = t(spark, sf_dir, "customer").select(changes.row_hash(["c_name", "c_acctbal"]).alias("h"))
    return h.agg(F.count("*").alias("rows"), F.countDistinct("h").alias("hashes"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM customer WHERE c_custkey % 3 != 0 OR c_custkey % 2 = 0")
def r14_upserts_only(spark, sf_dir):
    """Deletes of the batch are left out; rows that are absent from it stay."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    target = c.where("k % 3 != 0").withColumn("v", F.lit("old"))
    diff = changes.keyed_diff(target, c.where("k % 2 = 0").withColumn("v", F.lit("new")), ["k"]).where("_op != 'delete'").drop("_op")
    return changes.upsert(target, diff, ["k"])


# user-defined functions


@query("SELECT l_returnflag, round(avg(l_quantity) + max(l_quantity), 6) AS x FROM lineitem GROUP BY 1")
def u6_grouped_function(spark, sf_dir):
    """A user's aggregate over Arrow batches, of groups that Spark has made small by a sum for each quantity."""

    def both(q: pd.Series, n: pd.Series) -> float:
        return float((q * n).sum() / n.sum() + q.max())

    small_groups = t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return small_groups.groupBy("l_returnflag").agg(F.round(F.pandas_udf(both, "double", F.PandasUDFType.GROUPED_AGG)("l_quantity", "n"), 6).alias("x"))


def last_by(value: str, *order: str) -> F.Column:
    """The value of the row that is last by order: a macro."""
    return F.max_by(value, F.struct(*order))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def u7_last_by(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(last_by("value", "ts", "event_id").alias("last_value"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM customer")
def u1_sql_macro(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION side_of(b DOUBLE) RETURNS STRING RETURN CASE WHEN b < 0 THEN 'debt' ELSE 'credit' END")
    return spark.sql("SELECT c_custkey, side_of(c_acctbal) AS side FROM {c}", c=t(spark, sf_dir, "customer"))


# retrieval and the domain


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) SELECT vec_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id) AS place FROM embeddings, q WHERE vec_id % 10 != 0 QUALIFY place <= 15")
def v7_vector_lane(spark, sf_dir):
    """Rows without a vector are skipped; ties go to the smaller id."""
    e = t(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 != 0, F.col("embedding")))
    target = [float(x) for x in e.where("vec_id = 3").first()["embedding"]]
    top = search.nearest_vectors(e, "vec_id", "embedding", target, 15)
    return top.select("vec_id", F.row_number().over(W.partitionBy().orderBy(F.desc("similarity"), "vec_id")).cast("long").alias("place"))


@query("WITH RECURSIVE w AS (SELECT c_custkey AS old, c_custkey // 4 AS current FROM customer WHERE c_custkey >= 4 UNION ALL SELECT old, current // 4 FROM w WHERE current >= 4) SELECT old, min(current) AS current FROM w GROUP BY old")
def d36_alias_chains(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_custkey >= 4").select(F.col("c_custkey").alias("old"), F.expr("c_custkey div 4").alias("new"))
    return identity.chains(c)


@query(f"WITH {RECORDS_SQL} SELECT count(*) AS records, count(phone) AS phones, count(email) AS emails FROM r")
def d58_table_verification(spark, sf_dir):
    """Rows, filled keys and structure of a stored table against the one that it was made from."""
    table = tables.VersionedTable(spark, folder(spark, "verified"))
    table.write(records(spark, sf_dir))
    back = table.read()
    assert not changes.schema_diff(records(spark, sf_dir).schema, back.schema)
    return back.agg(F.count("*").alias("records"), F.count("phone").alias("phones"), F.count("email").alias("emails"))


#: Forms of the names of columns that hold personal data.
PERSONAL = r"(?i)phone|mobile|tel|mail|name|addr|id_?card|id_?no|passport|cert|birth|ssn|contact|手机|电话|邮箱|姓名|名字|地址|身份证|证件|生日"


def personal(df: DataFrame) -> list[str]:
    """Columns that hold personal data, by their names, or by the form of over half of all their values."""
    by_name = [c for c in df.columns if re.search(PERSONAL, c)]
    texts = [c for c, k in df.dtypes if k == "string" and c not in by_name]
    form = r"^(\+?\d[\d -]{8,}\d|[^@\s]+@[^@\s]+\.[^@\s]+)$"
    found = df.agg(*(F.avg(F.col(c).rlike(form).cast("int")).alias(c) for c in texts)).first() if texts else {}
    return by_name + [c for c in texts if (found[c] or 0) > 0.5]


@query("SELECT c_custkey, c_nationkey FROM customer")
def d61_personal_data_guard(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@mail.test")).alias("contact"))
    return c.drop(*personal(c))


@query("SELECT 'extra' AS drift, 'note' AS column_name UNION ALL SELECT 'missing', 'n_regionkey' UNION ALL SELECT 'type', 'n_nationkey'")
def d64_schema_drift(spark, sf_dir):
    declared = t(spark, sf_dir, "nation").schema
    actual = t(spark, sf_dir, "nation").drop("n_regionkey").withColumns({"note": F.lit(""), "n_nationkey": F.col("n_nationkey").cast("string")}).schema
    words = {"added": "extra", "removed": "missing", "narrowed": "type", "widened": "type"}
    return spark.createDataFrame([(words[k], c) for c, k, _ in changes.schema_diff(declared, actual)], "drift string, column_name string")


@query(
    """WITH v AS (SELECT c_nationkey AS mapping, 'f' || c_custkey % 40 AS field, min(c_mktsegment) FILTER (c_custkey % 3 != 0) AS old, min(c_mktsegment) FILTER (c_custkey % 4 != 0) AS new FROM customer GROUP BY ALL)
    SELECT mapping, field, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change, old, new FROM v WHERE old IS DISTINCT FROM new"""
)
def d68_mapping_difference(spark, sf_dir):
    """What differs between two versions of mappings, which are tables of (mapping, field, expression)."""
    c = t(spark, sf_dir, "customer")
    made = lambda kept: c.where(kept).groupBy(F.col("c_nationkey").alias("mapping"), F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string")).alias("field")).agg(F.min("c_mktsegment").alias("expression"))
    return merge.mapping_difference(made("c_custkey % 3 != 0"), made("c_custkey % 4 != 0"))


@query("SELECT o_custkey AS k, 'orders' AS metric, count(*)::DOUBLE AS value FROM orders GROUP BY 1")
def d76_data_scope(spark, sf_dir):
    """A caller sees the rows of the metrics in its scope."""
    from .domain import k19_serving_rows

    return k19_serving_rows(spark, sf_dir).where(F.col("metric").isin("orders")).select("k", "metric", "value")


@query("SELECT c_custkey, c_name AS name, sha256('s' || lower(trim(c_name))) AS stored FROM customer WHERE c_custkey IN (5, 6)")
def d77_reveal(spark, sf_dir):
    """The latest raw row of a key beside what is stored of it, on request only."""
    raw = t(spark, sf_dir, "customer").where(F.col("c_custkey").isin(5, 6))
    last = topn.latest(raw.withColumn("_batch", F.lit(1)), ["c_custkey"], ["_batch"])
    return last.select("c_custkey", F.col("c_name").alias("name"), X.pseudonym(X.normal_email(F.col("c_name")), "s").alias("stored"))


@query("SELECT c_custkey AS id, 'crm:' || c_custkey AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' ELSE 'other' END AS kind, c_acctbal::DECIMAL(18,2)::DOUBLE AS balance FROM customer")
def d66_mapping_transforms(spark, sf_dir):
    """Presets of a mapping as Column expressions: direct, key space, dictionary, decimal."""
    c = t(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), merge.key_space("crm", "c_custkey")[0].alias("key"), merge.dictionary("c_mktsegment", {"BUILDING": "b"}, "other").alias("kind"), F.col("c_acctbal").cast("decimal(18,2)").cast("double").alias("balance"))


@query("SELECT o.o_orderkey, e.event_id AS last_event FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-15' AS at FROM orders) o ASOF LEFT JOIN events e ON o.o_custkey = e.user_id AND o.at >= e.ts")
def j21_bucketed_lookup(spark, sf_dir):
    """The last event of each order's customer at a time: both sides meet by the hash of the customer."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.lit("2024-01-15").cast("timestamp_ntz").alias("at"))
    e = t(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("last_event"))
    return asof.asof_join(o, e, ["user_id"], "at", "ts", how="left").select("o_orderkey", "last_event")
