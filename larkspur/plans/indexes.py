"""Searches over stored indexes, relations found in data, and windows by slices of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import graph_index, quality, relations, rolling, topn
from larkspur.operators.text_index import TextIndex

from . import crm, domain, relational  # noqa: F401, whose SQL is used here
from .files import folder
from .registry import ORACLES, query
from .relational import t

WORDS = ["the", "that", "avec"]


def indexed(spark, sf_dir) -> TextIndex:
    """All documents in two segments, the second appended to the first."""
    index, d = TextIndex(spark, folder(spark, "index"), buckets=16), t(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    for part in ("doc_id % 3 != 0", "doc_id % 3 = 0"):
        index.append(d.where(part), "doc_id", tokens, block=128)
    return index


@query(ORACLES["v2_bm25"])
def v2_index_scores(spark, sf_dir):
    """The scores of v2_bm25, from postings."""
    return indexed(spark, sf_dir).scores(WORDS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT * FROM ({ORACLES['v2_bm25']}) ORDER BY score DESC, doc_id LIMIT 20")
def v2_index_top(spark, sf_dir):
    """The twenty best, by blocks of documents whose bounds reach them."""
    return indexed(spark, sf_dir).top(WORDS, 20).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))



STAR = "region nation customer supplier part orders lineitem".split()
KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)
FOUND_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{u}' AS other, '{k}' AS key, count(DISTINCT {c}) AS keys, round(count(DISTINCT {c}) FILTER ({c} IN (SELECT {k} FROM {u})) / count(DISTINCT {c}), 6) AS covered FROM {t}" for t, c, u, k in KEYS
)


@query(f"SELECT * FROM ({FOUND_SQL}) WHERE covered >= 0.95")
def d65_relations_from_data(spark, sf_dir):
    """The keys of the star schema, which the query does not name: all columns of all its tables are compared."""
    found = relations.suggest({name: t(spark, sf_dir, name) for name in STAR})
    return spark.createDataFrame(found, "table string, column string, other string, key string, keys long, covered double").withColumn("covered", F.round("covered", 6))


@query(ORACLES["w9_range_interval_windows"])
def w9_sliced_windows(spark, sf_dir):
    """The windows of w9_range_interval_windows, by slices of time, for customers with any number of orders."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    day = rolling.DAY
    found = rolling.rolling(o, "o_orderkey", "o_custkey", "us", "o_totalprice", {"d30": 30 * day, "d365": 365 * day, "d90": 90 * day}, slice_us=30 * day)
    return found.select("o_orderkey", F.round("d30_sum", 2).alias("d30"), F.round("d365_sum", 2).alias("d365"), F.col("d90_n").alias("n90"))


@query(ORACLES["d19_rolling_spend_and_triggers"])
def d19_sliced_spend(spark, sf_dir):
    """The triggers of d19_rolling_spend_and_triggers: spend by slices; the third order of a customer is one of the first three of its slices' order."""
    c = crm.clean(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(20,4)").alias("price"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    day = rolling.DAY
    spent = rolling.rolling(c, "o_orderkey", "o_custkey", "us", "price", {"s30": 30 * day, "s365": 365 * day}, slice_us=30 * day)
    # a grouped Top-N that keeps three rows of a customer ahead of the shuffle
    third = topn.top_rows(c.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 3)
    third = third.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey")).where("n = 3").select("o_orderkey", F.lit(True).alias("third"))
    s30, s365 = (F.col(x).cast("double") for x in ("s30_sum", "s365_sum"))
    surge = (s30 > 3 * (s365 - s30) / 11) & ((s365 - s30) / 11 >= 100)
    return spent.join(third, "o_orderkey", "left").select("o_orderkey", F.coalesce("third", F.lit(False)).alias("third"), surge.alias("surge"))


@query(
    """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey || '@example.org' ELSE c_custkey || '@example.com' END AS contact, strftime(DATE '2020-01-01' + (c_custkey % 9)::INTEGER, '%Y-%m-%d') AS since, CASE WHEN c_custkey % 4 != 0 THEN c_mktsegment END AS segment FROM customer)
    SELECT 'segment' AS "column", count(*) AS rows, count(*) - count(segment) AS nulls, min(length(segment)) AS shortest, max(length(segment)) AS longest, NULL::VARCHAR AS format, (SELECT string_agg(segment || '=' || n, ',' ORDER BY n DESC, segment) FROM (SELECT segment, count(*) AS n FROM c WHERE segment IS NOT NULL GROUP BY 1)) AS top FROM c
    UNION ALL SELECT 'contact', count(*), 0, min(length(contact)), max(length(contact)), 'email', NULL FROM c
    UNION ALL SELECT 'since', count(*), 0, 10, 10, 'date', (SELECT string_agg(since || '=' || n, ',' ORDER BY n DESC, since) FROM (SELECT since, count(*) AS n FROM c GROUP BY 1)) FROM c"""
)
def g21_merged_profile(spark, sf_dir):
    """Profiles of two batches, stored, and merged without the rows: counts, lengths, formats and frequent values are those of the whole."""
    at, k = folder(spark, "profiles"), F.col("c_custkey")
    contact = F.when(k % 3 == 0, F.concat(F.lit("u"), k, F.lit("@example.org"))).otherwise(F.concat(k.cast("string"), F.lit("@example.com")))
    since = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 9).cast("int")), "yyyy-MM-dd")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", contact.alias("contact"), since.alias("since"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    for part in (0, 1):
        quality.profile_batch(c.where(k % 2 == part)).write.parquet(f"{at}/batch={part}")
    whole = quality.merge_profiles(spark.read.parquet(at).drop("batch"))
    found = quality.read_profile(whole).where(F.col("column").isin("segment", "contact", "since"))
    top = F.array_join(F.transform("top", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), ",")
    return found.select("column", "rows", F.round(F.col("null_rate") * F.col("rows")).cast("long").alias("nulls"), "shortest", "longest", "format", top.alias("top"))


@query()
def v4_graph_search(spark, sf_dir):
    """Ten neighbours of every vector whose id is divisible by 20, along a stored graph; no SQL, since it is approximate: the test holds its recall."""
    at, e = folder(spark, "graph"), t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    graph_index.build(e, "vec_id", "embedding").write.parquet(at)
    return graph_index.nearest(spark.read.parquet(at), e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).select("query", F.col("id").alias("vec_id"), "similarity", "place")
