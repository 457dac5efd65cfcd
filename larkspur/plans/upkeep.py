"""Upkeep of tables and definitions: writes, logs of checks, late records, versions, and what has to be built again."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import identity, merge, quality
from larkspur.sources import readers, tables

from .domain import RECORDS_SQL, records
from .files import folder
from .registry import query
from .relational import t

# sources and sinks


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77")
def s21_bloom_filter_lookup(spark, sf_dir):
    """A lookup by a column that the files are not sorted by: row groups without the value are skipped by its Bloom filter."""
    at = folder(spark, "bloom")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o.repartition(8, "o_orderkey").write.options(**{"parquet.bloom.filter.enabled#o_custkey": "true", "parquet.bloom.filter.expected.ndv#o_custkey": "100000"}).parquet(at)
    return spark.read.parquet(at).where("o_custkey = 77")


@query("SELECT c_custkey::INTEGER AS id, c_name AS name, c_nationkey AS nation FROM customer")
def s8_upload_options(spark, sf_dir):
    """An upload with a line of notes ahead, bars for commas and no header, read as declared."""
    at = folder(spark, "upload")
    line = F.concat_ws("|", "c_custkey", "c_name", "c_nationkey")
    t(spark, sf_dir, "customer").select(line.alias("value")).coalesce(1).write.text(f"{at}/plain")
    spark.read.text(f"{at}/plain", wholetext=True).select(F.concat(F.lit("exported for you\n"), "value").alias("value")).coalesce(1).write.text(f"{at}/noted")
    return readers.csv_table(spark, f"{at}/noted", "id int, name string, nation int", delimiter="|", header=False, skip=1)


@query("SELECT count(*) AS rows, 'zstd' AS codec FROM lineitem")
def k1_zstd_write(spark, sf_dir):
    at = folder(spark, "zstd")
    t(spark, sf_dir, "lineitem").write.option("compression", "zstd").parquet(at)
    named = F.regexp_extract("_metadata.file_name", r"\.([a-z0-9]+)\.parquet$", 1)
    return spark.read.parquet(at).groupBy(named.alias("codec")).agg(F.count("*").alias("rows")).select("rows", "codec")


@query("SELECT 'b' || event_id % 3 AS batch, count(*) AS n FROM events GROUP BY 1")
def k3_append_batches(spark, sf_dir):
    """Batches as partitions of their own; one that is written again replaces itself."""
    at, e = folder(spark, "batches"), t(spark, sf_dir, "events").select("event_id", "user_id")
    for k in (0, 1, 2, 1):
        tables.append_batch(e.where(f"event_id % 3 = {k}"), at, f"b{k}")
    return spark.read.parquet(at).groupBy(F.col("_batch").alias("batch")).agg(F.count("*").alias("n"))


@query("SELECT 'before' AS side, count(*) AS n FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'after', count(*) FROM customer")
def k18_pointer_switch(spark, sf_dir):
    """A version that is written beside is seen only once the pointer names it; the one before stays readable."""
    table, c = tables.VersionedTable(spark, folder(spark, "switch")), t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    first = table.write(c.where("c_acctbal > 0"))
    table.write(c)
    side = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side(table.read(first), "before").unionByName(side(table.read(), "after"))


@query("SELECT 2::BIGINT AS kept, 3::BIGINT AS expired, count(*) AS rows FROM nation")
def k26_snapshot_expiry(spark, sf_dir):
    table, n = tables.VersionedTable(spark, folder(spark, "expiry")), t(spark, sf_dir, "nation")
    for _ in range(5):
        table.write(n)
    gone = table.expire(2)
    return table.read().agg(F.lit(len(table.versions())).cast("long").alias("kept"), F.lit(len(gone)).cast("long").alias("expired"), F.count("*").alias("rows"))


@query("SELECT 'nation' AS source, false AS dropped, count(*) AS rows FROM nation UNION ALL SELECT 'region', true, 0::BIGINT")
def k28_drop_source(spark, sf_dir):
    """A source goes with its files, unless a definition still needs it."""
    at, needs, out = folder(spark, "sources"), {"share of nations": {"nation", "orders"}}, None
    for name in ("nation", "region"):
        t(spark, sf_dir, name).write.parquet(f"{at}/{name}")
        gone = tables.drop_source(spark, f"{at}/{name}", needs, name)
        left = spark.createDataFrame([], "x int") if gone else spark.read.parquet(f"{at}/{name}")
        one = left.agg(F.lit(name).alias("source"), F.lit(gone).alias("dropped"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS rows, true AS small FROM lineitem")
def o5_chunked_export(spark, sf_dir):
    """An export in files of at most 2,048 rows, as many at a time as there are tasks; a reader may follow it file by file."""
    at = folder(spark, "chunks")
    t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").write.option("maxRecordsPerFile", 2048).csv(at)
    by = spark.read.csv(at).groupBy("_metadata.file_path").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("rows"), (F.max("n") <= 2048).alias("small"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last_id FROM events GROUP BY 1")
def k10_merge_touched_buckets(spark, sf_dir):
    """Totals in hash buckets: later batches, and one that comes twice, rewrite only the buckets of their keys."""
    e, table = t(spark, sf_dir, "events"), tables.BucketedTable(spark, folder(spark, "buckets"), ["user_id"], 16)
    group = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last_id"))
    few = F.col("user_id") % 50 == 7
    table.merge(group(e.where(~few)), ["n", "total"], ["last_id"], 0)
    for number in (1, 1):
        table.merge(group(e.where(few)), ["n", "total"], ["last_id"], number)
    return table.read().select("user_id", "n", F.round("total", 4).alias("total"), "last_id")


# checks


@query(
    """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT n, avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM d),
    r AS (SELECT 'order keys are unique' AS rule, 'error' AS severity, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS failed
    UNION ALL SELECT 'orders have a customer', 'error', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 500 != 3))
    UNION ALL SELECT 'prices are not negative', 'error', (SELECT count(*) FROM orders WHERE o_totalprice < 0)
    UNION ALL SELECT 'events are not in the future', 'warn', (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-02-01 01:00:00')
    UNION ALL SELECT 'lines name known parts', 'warn', (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 400 != 9))
    UNION ALL SELECT 'orders of a day do not halve', 'warn', (SELECT count(*) FROM w WHERE n < 0.5 * m))
    SELECT DATE '2024-03-01' AS run_day, *, failed = 0 AS passed FROM r"""
)
def d22_quality_log(spark, sf_dir):
    """Six checks, of rows, keys, references and days; their results are added to a log, from which this run's are read."""
    o, at = t(spark, sf_dir, "orders"), folder(spark, "checks")
    rows = quality.check_rows(o, {"prices are not negative": F.col("o_totalprice") >= 0}).select("rule", "failed")
    future = quality.check_rows(t(spark, sf_dir, "events"), {"events are not in the future": F.col("ts") <= F.lit("2024-02-01 01:00:00").cast("timestamp_ntz")}).select("rule", "failed")
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col(df.columns[0]).cast("long").alias("failed"))
    unique = named(quality.duplicate_keys(o, ["o_orderkey"]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))), "order keys are unique")
    customers = named(quality.orphans(o, t(spark, sf_dir, "customer").where("c_custkey % 500 != 3"), "o_custkey", "c_custkey").select("orphans"), "orders have a customer")
    parts = named(quality.orphans(t(spark, sf_dir, "lineitem").select("l_partkey").distinct(), t(spark, sf_dir, "part").where("p_partkey % 400 != 9"), "l_partkey", "p_partkey").select("orphans"), "lines name known parts")
    daily = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    drops = named(quality.drop_against_mean(daily, "day", "n").agg(F.count("*")), "orders of a day do not halve")
    found = rows.unionByName(future).unionByName(unique).unionByName(customers).unionByName(parts).unionByName(drops)
    error = F.col("rule").isin("order keys are unique", "orders have a customer", "prices are not negative")
    for day in (date(2024, 2, 29), date(2024, 3, 1)):
        run = found.select(F.lit(day).alias("run_day"), "rule", F.when(error, "error").otherwise("warn").alias("severity"), "failed", (F.col("failed") == 0).alias("passed"))
        run.coalesce(1).write.mode("append").parquet(at)
    return spark.read.parquet(at).where(F.col("run_day") == date(2024, 3, 1))


# identity


LINKS_SQL = """e AS (SELECT a.id AS u, b.id AS v FROM r a JOIN r b ON a.phone = b.phone UNION SELECT a.id, b.id FROM r a JOIN r b ON a.email = b.email AND NOT coalesce(a.phone != b.phone, false)
    UNION SELECT a.id, b.id FROM r a JOIN r b ON a.ext = b.ext AND NOT coalesce(a.phone != b.phone, false) AND NOT coalesce(a.email != b.email, false)),
    reach AS (SELECT id AS u, id AS v FROM r UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v) SELECT u AS id, min(v) AS consumer FROM reach GROUP BY u"""


@query(f"WITH RECURSIVE {RECORDS_SQL.replace('r AS', 'every AS')}, r AS (SELECT id, CASE WHEN phone >= 60 THEN phone END AS phone, CASE WHEN email >= 40 THEN email END AS email, ext FROM every), {LINKS_SQL}")
def d37_excluded_values(spark, sf_dir):
    """Identity without the values of an exclusion list."""
    listed = lambda field, n: spark.range(n).select(F.lit(field).alias("field"), F.col("id").cast("string").alias("value"))
    return identity.resolve(records(spark, sf_dir), "id", ["phone", "email", "ext"], listed("phone", 60).unionByName(listed("email", 40)))


@query(f"WITH RECURSIVE {RECORDS_SQL}, {LINKS_SQL}")
def r18_late_records(spark, sf_dir):
    """A tenth of the records comes late; only the groups that they touch are resolved again."""
    every = records(spark, sf_dir)
    before = identity.resolve(every.where("id % 10 != 4"), "id", ["phone", "email", "ext"])
    return identity.add_late(every, before, every.where("id % 10 = 4").select("id"), "id", ["phone", "email", "ext"])


# definitions


@query(
    """WITH s AS (SELECT c_nationkey AS source, max(o_orderdate) AS updated FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), n AS (SELECT n_nationkey AS definition, n_nationkey * 7 % 25 AS source FROM nation UNION SELECT n_nationkey, n_nationkey * 3 % 25 FROM nation),
    b AS (SELECT n_nationkey AS definition, TIMESTAMP '2001-07-20' + INTERVAL 1 DAY * n_nationkey AS built FROM nation)
    SELECT definition, count(*) AS changed, max(updated) AS since FROM n JOIN s USING (source) JOIN b USING (definition) WHERE updated > built GROUP BY 1"""
)
def r17_rebuild_triggers(spark, sf_dir):
    """Definitions that an update of a source they need has made stale, and by how many of them."""
    updated = t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").join(t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source")), F.expr("o_custkey = c_custkey")).groupBy("source").agg(F.max("o_orderdate").alias("updated"))
    k = F.col("n_nationkey")
    needs = t(spark, sf_dir, "nation").select(k.alias("definition"), F.explode(F.array_distinct(F.array(k * 7 % 25, k * 3 % 25))).alias("source"))
    built = t(spark, sf_dir, "nation").select(k.alias("definition"), F.date_add(F.lit("2001-07-20"), k).cast("timestamp_ntz").alias("built"))
    return stale(needs, updated, built)


def stale(needs: DataFrame, updated: DataFrame, built: DataFrame) -> DataFrame:
    """(definition, changed, since): needs (definition, source), updated (source, updated), built (definition, built)."""
    late = needs.join(updated, "source").join(built, "definition").where("updated > built")
    return late.groupBy("definition").agg(F.count("*").alias("changed"), F.max("updated").alias("since"))


@query("WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_custkey % 40 = 1) SELECT d::DATE AS day FROM generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY) g(d) WHERE d::DATE NOT IN (SELECT day FROM d)")
def r20_scheduled_refresh(spark, sf_dir):
    """The days between the first and the last result that have none, which a backfill has to compute."""
    days = t(spark, sf_dir, "orders").where("o_custkey % 40 = 1").select(F.to_date("o_orderdate").alias("day")).distinct()
    whole = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return whole.join(days, "day", "left_anti")


@query("SELECT * FROM supplier")
def d70_pass_through_mapping(spark, sf_dir):
    """A mapping that is made from a table: each of its columns as it is."""
    s = t(spark, sf_dir, "supplier")
    return apply_mapping(s, pass_through(s))


@query("SELECT s_suppkey AS id, upper(s_name) AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, upper(c_name), c_mktsegment FROM customer")
def d71_mapping_reuse(spark, sf_dir):
    """One mapping for two sources, by a prefix of their columns; a column that a source lacks is null."""
    shared = {"id": "{p}key", "name": "upper({p}name)", "segment": "{p}mktsegment"}
    c = t(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "c_key"})
    s = t(spark, sf_dir, "supplier").withColumnsRenamed({"s_suppkey": "s_key"})
    return apply_mapping(s, shared, "s_").unionByName(apply_mapping(c, shared, "c_"))


def pass_through(df: DataFrame) -> dict[str, str]:
    return {c: f"`{c}`" for c in df.columns}


def apply_mapping(df: DataFrame, fields: dict[str, str], prefix: str = "") -> DataFrame:
    """df's rows as fields of expressions, in which {p} stands for the prefix; one over a column that df lacks is null text.

    Which columns an expression names is for Spark's analysis to say, and not for a search in its text.
    """

    def made(expression: str) -> Column:
        column = F.expr(expression)
        try:
            df.select(column)
        except AnalysisException as e:
            if not prefix or not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
            return F.lit(None).cast("string")
        return column

    return df.select(*(made(e.replace("{p}", prefix)).alias(f) for f, e in fields.items()))


@query(
    """WITH v AS (SELECT c_nationkey AS template, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS version, c_mktsegment AS setting FROM customer)
    SELECT template, max(version) AS version, arg_max(setting, version) AS setting, count(DISTINCT setting) AS settings, arg_max(setting, version) FILTER (version <= 5) AS at_five FROM v GROUP BY 1"""
)
def d73_template_versions(spark, sf_dir):
    """A log of template versions: the current one of each, and what it was at its fifth."""
    number = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    v = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("template"), number.alias("version"), F.col("c_mktsegment").alias("setting"))
    at = lambda most: F.max_by("setting", F.when(F.col("version") <= most, F.col("version")))
    return v.groupBy("template").agg(F.max("version").alias("version"), F.max_by("setting", "version").alias("setting"), F.countDistinct("setting").alias("settings"), at(5).alias("at_five"))


@query(
    """WITH c AS (SELECT 'o_custkey' AS child, (SELECT count(DISTINCT o_custkey) FROM orders) AS n, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey) AS hit, 'c_custkey' AS parent
    UNION ALL SELECT 'l_partkey', (SELECT count(DISTINCT l_partkey) FROM lineitem), (SELECT count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey), 'p_partkey'
    UNION ALL SELECT 'l_suppkey', (SELECT count(DISTINCT l_suppkey) FROM lineitem), (SELECT count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey), 's_suppkey') SELECT child, parent, n AS keys, round(hit / n, 6) AS covered FROM c WHERE hit >= 0.95 * n"""
)
def d65_relation_suggestions(spark, sf_dir):
    """Columns whose distinct values are nearly all keys of another table: candidates of a relation."""
    columns = {"o_custkey": ("orders", "customer", "c_custkey"), "l_partkey": ("lineitem", "part", "p_partkey"), "l_suppkey": ("lineitem", "supplier", "s_suppkey")}
    out = None
    for child, (table, other, parent) in columns.items():
        one = quality.orphans(t(spark, sf_dir, table).select(child).distinct(), t(spark, sf_dir, other), child, parent)
        one = one.select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), F.col("with_value").alias("keys"), F.round(1 - F.col("orphans") / F.col("with_value"), 6).alias("covered"))
        out = one if out is None else out.unionByName(one)
    return out.where("covered >= 0.95")


@query("SELECT c_mktsegment AS value, count(*) AS n, c_mktsegment IN ('BUILDING', 'MACHINERY') AS known FROM customer GROUP BY 1")
def d69_dry_run_values(spark, sf_dir):
    """What a dry run tells of a dictionary: each value of the whole table, how often, and whether the dictionary has it."""
    c, known = t(spark, sf_dir, "customer"), {"BUILDING": "b", "MACHINERY": "m"}
    unknown = merge.unknown_values(c, "c_mktsegment", known).withColumn("known", F.lit(False))
    return unknown.unionByName(c.where(F.col("c_mktsegment").isin(*known)).groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n")).withColumn("known", F.lit(True)))
