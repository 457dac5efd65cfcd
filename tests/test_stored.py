"""Databases, footers, services, and what stored tables keep."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from json import dumps
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspur.operators import search
from larkspur.plans import stored, upkeep
from larkspur.sources import databases, footers, service, tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_database_scan_in_ranges(spark):
    db = stored.orders_database(spark, SF)
    least, greatest, missing = db.bounds("orders", "o_custkey")
    assert least >= 0 and greatest > least and missing > 0
    df = db.scan("orders", "o_custkey", 6)
    assert df.rdd.getNumPartitions() == 7
    parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count("o_custkey").alias("keys")).collect()
    assert sorted(p.n for p in parts if not p["keys"]) == [missing] and sum(p.n for p in parts) == 1500
    assert "PushedFilters: [*IsNotNull(o_totalprice), *GreaterThan(o_totalprice,200000.0)]" in plan(df.where("o_totalprice > 200000"))
    assert db.scan("orders", "o_orderdate", 3).count() == 1500


def test_database_without_rows_or_nulls(spark):
    db = databases.Database(spark, "jdbc:derby:memory:small;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    db.write(spark.createDataFrame([], "k long, v string"), "hollow")
    assert db.scan("hollow", "k").count() == 0
    db.write(spark.createDataFrame([(5, "a"), (5, "b")], "k long, v string"), "alike")
    assert db.scan("alike", "k", 4).rdd.getNumPartitions() == 1 and db.scan("alike", "k", 4).count() == 2
    db.write(spark.createDataFrame([(None, "a")], "k long, v string"), "keyless")
    assert [r.v for r in db.scan("keyless", "k").collect()] == ["a"]


def test_database_aggregates_itself(spark):
    df = stored.s10_database_aggregate(spark, SF)
    assert "PushedAggregates: [COUNT(*)" in plan(df) and "PushedGroupByExpressions: [o_orderstatus]" in plan(df)


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_ranges_part_all_values(parts):
    found = databases.range_predicates("k", 1, 20, parts)
    for k in (-5, 1, 7, 20, 99):
        assert sum(eval(p.replace("AND", "and"), {"k": k}) for p in found if "NULL" not in p) == (1 if len(found) > 1 else 0)


def test_footers_and_bloom(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.range(2000).select((F.col("id") * 2).alias("k"), F.concat(F.lit("name"), F.col("id")).alias("s"), F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("x"))
    options = {f"parquet.{a}#{c}": b for c in ("k", "s", "x") for a, b in (("bloom.filter.enabled", "true"), ("enable.dictionary", "false"), ("bloom.filter.expected.ndv", "2000"))}
    df.coalesce(1).write.options(**options, compression="zstd").parquet(at)
    rows = {r.column: r for r in footers.footers(spark, at).collect()}
    assert {r.codec for r in rows.values()} == {"ZSTD"} and all(r.rows == 2000 and r.bloom_at for r in rows.values())
    assert (rows["k"].least, rows["k"].greatest, rows["k"].nulls, rows["x"].nulls) == ("0", "3998", 0, 500)
    through = lambda c, v: footers.groups_left(spark, at, c, v).first().by_bloom
    assert all(through("k", v) for v in (0, 20, 3998)) and through("s", "name77") and through("x", 33.0)
    assert sum(through("k", v) for v in range(1, 60, 2)) <= 5 and not all(through("s", f"other{k}") for k in range(5))


def test_bloom_filter_saves_reading(spark):
    """The scan itself puts out only the rows of the groups that the footers' filters leave."""
    at = f"{stored.two_copies(spark, SF)}/unsorted"
    left = footers.groups_left(spark, at, "o_orderkey", 5).where("by_range AND by_bloom").agg(F.sum("rows")).first()[0]
    df = spark.read.parquet(at).where("o_orderkey = 5")
    jdf = df._jdf
    assert jdf.collectToPython() is not None
    out, todo = None, [jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            out = node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    assert out == left < 1500


def test_system_sample(spark, tmp_path):
    at = str(tmp_path / "t")
    small = {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
    spark.range(20_000).select("id", F.rand(1).alias("x")).repartition(4).write.options(**small).parquet(at)
    draw = lambda seed, share=0.4: sorted(map(tuple, footers.system_sample(spark, at, share, seed).collect()))
    every = sorted(map(tuple, spark.read.parquet(at).collect()))
    one = draw(1)
    assert one == draw(1) and one != draw(2) and set(one) < set(every)
    assert draw(1, 1.0) == every and draw(1, 0.0) == []
    groups = {r.rows for r in footers.footers(spark, at).where("column = 'id'").collect()}
    assert len(one) >= min(groups)


def test_system_sample_of_a_table_written_again(spark, tmp_path):
    small = {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
    draws = []
    for k in range(2):
        spark.range(0, 20_000, 1, 4).write.options(**small).parquet(str(tmp_path / f"t{k}"))
        draws.append(sorted(r.id for r in footers.system_sample(spark, str(tmp_path / f"t{k}"), 0.4, 1).collect()))
    assert draws[0] == draws[1] and 0 < len(draws[0]) < 20_000


def test_paged_filters_narrow_the_ranges():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    reader = service.BatchReader(stored.spark_schema(), {"client": "parquet", "table": f"{SF}/customer.parquet", "key": "c_custkey", "parts": "3"})
    left = list(reader.pushFilters([GreaterThan(("c_custkey",), 10), LessThanOrEqual(("c_custkey",), 40), EqualTo(("c_name",), "x"), In(("c_custkey",), (12, 30))]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "In"] and (reader.after, reader.until) == (11, 30)
    assert [(p.after, p.until) for p in reader.partitions()] == [(11, 17), (17, 23), (23, 30)]


def test_pages_of_a_web_service(spark, tmp_path):
    """Over HTTP, as a batch and as a stream that goes on where it was."""
    keys = [k for k in range(1, 200) if k % 7]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            found = [k for k in keys if q["after"] < k <= q["until"]]
            out = [{"id": k, "v": f"v{k}"} for k in found[: q["size"]]] if q["size"] else [{"least": min(found, default=None), "greatest": max(found, default=None)}]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(dumps(out).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    service.register(spark)
    options = {"client": "http", "url": f"http://127.0.0.1:{server.server_port}", "key": "id", "size": "10", "parts": "3"}
    try:
        df = spark.read.format("paged").schema("id long, v string").options(**options).load()
        assert sorted(r.id for r in df.collect()) == keys
        assert sorted(r.id for r in df.where("id > 150 AND id <= 170").collect()) == [k for k in keys if 150 < k <= 170]
        seen = lambda: sorted(r.id for r in spark.read.parquet(str(tmp_path / "data")).collect())

        def run():
            stream = spark.readStream.format("paged").schema("id long, v string").options(**options).load()
            stored.incremental.append(stream, str(tmp_path / "data"), str(tmp_path / "state")).awaitTermination()

        run()
        assert seen() == keys
        keys += [500, 501, 777]
        run()
        assert seen() == keys
    finally:
        server.shutdown()


def test_buckets_expire(spark, tmp_path):
    """What a kept pointer names stays; replaced buckets go."""
    table = tables.BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, n long, at long")
    table.merge(batch(*((k, 1, 0) for k in range(40))), ["n"], ["at"], 0)
    for number in range(1, 5):
        table.merge(batch((5, 1, number)), ["n"], ["at"], number)
    want = {k: 5 if k == 5 else 1 for k in range(40)}
    gone = table.expire(2)
    assert len(gone) == 3 and len(table.table.versions()) == 2
    assert {r.k: r.n for r in table.read().collect()} == want
    assert {r.k: r.n for r in table._folders(table.state(table.table.versions()[0])["at"]).collect()} == want | {5: 4}
    table.merge(batch((5, 1, 9)), ["n"], ["at"], 5)
    assert {r.k: r.n for r in table.read().collect()} == want | {5: 6} and table.expire(1)


def test_mapping_of_literals_and_short_names(spark):
    df = spark.createDataFrame([(1, "x")], "s_key int, seg string")
    got = upkeep.apply_mapping(df, {"id": "{p}key", "kind": "'supplier'", "segment": "{p}mktsegment", "two": "1 + 1"}, "s_").first()
    assert tuple(got) == (1, "supplier", None, 2)
    with pytest.raises(AnalysisException):
        upkeep.apply_mapping(df, {"id": "no_such_function({p}key)"}, "s_")
    with pytest.raises(AnalysisException):
        upkeep.apply_mapping(df, {"id": "missing"})


def test_vectors_of_two_widths(spark, monkeypatch):
    rows = [(k, [1.0, k / 10, 0.5]) for k in range(6)] + [(100 + k, [float(k), 1.0]) for k in range(30)] + [(200, None), (201, [0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "id long, v array<double>").repartition(5, "id")
    queries = items.where("id < 6")
    want = sorted(map(tuple, search.k_nearest_of_each(queries, items, "id", "v", 2).collect()))
    assert len(want) == 12 and {r[1] for r in want} <= set(range(6))
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "STEP", 3)
    assert sorted(map(tuple, search.k_nearest_of_each(queries, items, "id", "v", 2).collect())) == want


def log(spark, tmp_path, batches, **how):
    """What a log of updates holds after some micro-batches of rows (key, value, minute, number)."""
    from larkspur.streaming import incremental, state

    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k long, v string, minute long, number long").withColumn("at", F.timestamp_seconds(F.col("minute") * 60 + 10_000_000)).drop("minute")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.files(spark, str(tmp_path / "in"), "k long, v string, number long, at timestamp", per_batch=1)
        incremental.append(state.update_log(stream, "k", "v", "at", "number", **how), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    return sorted([(r.key, r.old, r.new, r.change) for r in spark.read.parquet(str(tmp_path / "log")).collect()], key=repr)


def test_updates_come_with_their_old_value(spark, tmp_path):
    """Over batches and within one; late and repeated rows change nothing, null is a value, as is a null key."""
    one = [(1, "a", 0, 0), (1, "b", 5, 1), (2, "x", 0, 2), (None, "n", 0, 3), (3, None, 0, 4)]
    two = [(1, "b", 9, 5), (1, "late", 2, 6), (2, None, 3, 7), (2, "y", 3, 8), (3, None, 4, 9), (None, "m", 1, 10)]
    want = [(1, None, "a", "insert"), (1, "a", "b", "update"), (2, None, "x", "insert"), (2, "x", None, "update"), (2, None, "y", "update"), (3, None, None, "insert"), (None, None, "n", "insert"), (None, "n", "m", "update")]
    assert log(spark, tmp_path, [one, two]) == sorted(want, key=repr)


def test_forgotten_keys(spark, tmp_path):
    """A key without a row for an hour is put out and forgotten; one that comes again is new."""
    batches = [[(1, "a", 0, 0), (2, "b", 0, 1)], [(2, "c", 50, 2)], [(3, "z", 100, 3)], [(1, "d", 101, 4), (2, "c", 101, 5)]]
    got = log(spark, tmp_path, batches, expiry="60 minutes", late="1 minute")
    assert (1, "a", None, "expired") in got and (1, None, "d", "insert") in got and (2, "b", "c", "update") in got
    assert not [x for x in got if x[0] == 2 and x[3] == "expired"]


def test_text_index(spark, tmp_path, monkeypatch):
    """Scores over segments are those of one scan; the best come from few blocks; a segment without totals is not read."""
    from larkspur.operators.text_index import TextIndex

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.top(["the"], 3).collect() == []
    for k in range(3):
        index.append(docs.where(f"pmod(doc_id, 3) = {k}"), "doc_id", tokens, block=8)
    for words in (["the", "that", "avec"], ["the", "the"], ["zzzz"], ["der", "zzzz"], []):
        want = sorted([(-round(r.score, 9), r.doc_id) for r in search.bm25(docs, "doc_id", tokens, words).collect()]) if words else []
        assert sorted((-round(r.score, 9), r.id) for r in index.scores(words).collect()) == want
        assert [(-round(r.score, 9), r.id) for r in index.top(words, 7).collect()] == want[:7]
    before = index.segments()
    (tmp_path / "i/segment=9/postings").mkdir(parents=True)
    assert index.segments() == before
    index.append(docs.where("false"), "doc_id", tokens)
    assert index.scores(["the"]).count() == search.bm25(docs, "doc_id", tokens, ["the"]).count()


def plain_rolling(rows, widths):
    out = {}
    for i, key, at, _ in rows:
        inside = lambda w: [v for _, k, x, v in rows if k == key and x is not None and at is not None and at - w <= x <= at and v is not None]  # noqa: B023, E731
        out[i] = tuple(y for w in widths.values() for y in ((sum(inside(w)) if inside(w) else None, len(inside(w))) if at is not None else (None, None)))
    return out


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,2)"])
def test_rolling_by_slices(spark, kind):
    """Against a plain loop: a key with most rows, ties, times before 1970, nulls; windows wider and narrower than a slice."""
    import random
    from decimal import Decimal

    from larkspur.operators import rolling

    rng = random.Random(3)
    value = {"long": lambda: rng.randrange(-50, 50), "double": lambda: rng.randrange(100) / 4, "decimal(12,2)": lambda: Decimal(rng.randrange(-900, 900)) / 100}[kind]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(-60, 60)] if i % 9 == 0 else range(-60, 60)), rng.choice([None, value(), value()])) for i in range(160)]
    df = spark.createDataFrame(rows, f"id long, k long, at long, v {kind}")
    widths = {"a": 0, "b": 3, "c": 25, "d": 500}
    got = {r.id: tuple(r)[1:] for r in rolling.rolling(df, "id", "k", "at", "v", widths, slice_us=10).collect()}
    assert got == plain_rolling(rows, widths)
    assert rolling.rolling(df.where("false"), "id", "k", "at", "v", widths).count() == 0


def test_rolling_parts_a_hot_key(spark):
    """One user has a third of all rows, and no slice of it more than three times what the median task has."""
    from larkspur.operators import rolling

    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 200).alias("k"), (F.col("id") * 1_000).alias("at"), F.lit(1).alias("v"))
    slices = df.groupBy("k", F.floor(F.col("at") / 500_000).alias("s")).count()
    assert slices.agg(F.max("count")).first()[0] <= 200
    spread = slices.repartition(16, "k", "s").groupBy(F.spark_partition_id()).agg(F.sum("count").alias("n")).toPandas()["n"]
    assert spread.max() <= 3 * spread.median()
    got = rolling.rolling(df, "id", "k", "at", "v", {"w": 2_999_999}, slice_us=500_000).where("id = 29997").first()
    assert got.w_n == sum(1 for i in range(26_998, 29_998) if i % 3 == 0 or i % 200 == 0)


def test_relations_are_found_in_data(spark):
    """Not by a name alone, nor by values alone; a key has a value once; texts and numbers do not meet; no pair is named here."""
    from larkspur.operators import relations

    shops = spark.range(500).select(F.col("id").alias("shop_id"), F.concat(F.lit("s"), F.col("id")).alias("code"), (F.col("id") % 7).alias("city_id"))
    sales = spark.range(4000).select(F.col("id").alias("x_sale_id"), (F.col("id") % 500).alias("x_shop_id"), F.concat(F.lit("s"), F.col("id") % 500).alias("code"), (F.col("id") % 9).alias("city_id"))
    cities = spark.range(8).select(F.col("id").alias("city_id"), F.col("id").cast("string").alias("shop_id"))
    found = relations.suggest({"shops": shops, "sales": sales, "cities": cities})
    assert [x[:4] for x in found] == [("sales", "code", "shops", "code"), ("sales", "x_shop_id", "shops", "shop_id"), ("shops", "city_id", "cities", "city_id")]
    assert all(x[5] == 1 for x in found)
    loose = relations.suggest({"shops": shops, "sales": sales, "cities": cities}, 0.85, by_name=False)
    assert ("sales", "city_id", "cities", "city_id", 9, 8 / 9) in loose and ("shops", "shop_id", "sales", "x_sale_id", 500, 1.0) in loose
    assert relations.suggest({"shops": shops, "none": spark.createDataFrame([], "code string, shop_id long")}) == []


def test_profiles_merge(spark):
    """Two halves make the whole: exactly where counts are exact, within the sketches' bounds elsewhere; a half without rows adds nothing."""
    from larkspur.operators import quality

    df = spark.range(20_000).select(
        "id", (F.col("id") * 37 % 1000).cast("double").alias("x"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("k"), F.col("id") % 30)).alias("kind"), F.concat(F.lit("v"), F.col("id")).alias("many"),
        F.concat(F.lit("13"), F.col("id") + 100_000_000).alias("code"), F.lit("secret").alias("home_addr"), F.uuid().alias("key"), F.lit(None).cast("string").alias("nothing"), F.array("id").alias("listed"),
    ).cache()
    halves = [quality.profile_batch(df.where(p)) for p in ("id < 5000", "id >= 5000", "id < 0")]
    merged = quality.merge_profiles(halves[0].unionByName(halves[1]).unionByName(halves[2]))
    got, whole = ({r.column: r.asDict() for r in quality.read_profile(p).collect()} for p in (merged, quality.profile_batch(df)))
    for c in df.columns:
        a, b = got[c], whole[c]
        assert {k: v for k, v in a.items() if k not in ("values", "median")} == {k: v for k, v in b.items() if k not in ("values", "median")}
        assert abs(a["values"] - b["values"]) <= 0.05 * b["values"] and (a["median"] is None) == (b["median"] is None)
    assert abs(got["x"]["median"] - 500) < 30 and abs(got["many"]["values"] - 20_000) < 1_000
    assert got["kind"]["null_rate"] == 0.1 and len(got["kind"]["top"]) == 27 and got["kind"]["top"][0].n >= got["kind"]["top"][-1].n
    assert (got["key"]["format"], got["code"]["format"], got["nothing"]["format"]) == ("uuid", "phone", None) or got["code"]["format"] == "whole"
    assert got["many"]["top"] is None and got["home_addr"]["top"] is None and got["nothing"]["null_rate"] == 1
    twice = quality.merge_profiles(merged.unionByName(halves[2]))
    assert {r.column: r.rows for r in twice.collect()} == {c: 20_000 for c in df.columns}


def test_graph_search(spark):
    """Recall of at least 0.9 against all vectors, for under a fifth of the comparisons; odd vectors are left alone."""
    import numpy as np

    from larkspur.operators import graph_index

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(90_000, None), (90_020, [0.0] * 64), (90_040, [1.0, 2.0]), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    index = graph_index.build(e.unionByName(odd.where("vec_id IS NULL OR vec_id != 90040")), "vec_id", "embedding").cache()
    assert index.count() == 2000
    found = graph_index.nearest(index, e.unionByName(odd).where("vec_id % 20 = 0"), "vec_id", "embedding", 10).toPandas()
    rows = e.orderBy("vec_id").toPandas()
    ids, unit = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for query, own in found.groupby("query"):
        s = unit @ unit[ids == query][0]
        s[ids == query] = -2
        best = set(ids[np.argsort(-s)[:10]])
        hits, total = hits + len(best & set(own["id"])), total + 10
        assert np.allclose(own["similarity"], [s[ids == i][0] for i in own["id"]], atol=1e-5) and sorted(own["place"]) == list(range(1, len(own) + 1))
    assert total == 1000 and hits / total >= 0.9
    assert found.groupby("query")["compared"].max().mean() < 0.2 * 2000


def test_graph_of_few_vectors(spark):
    from larkspur.operators import graph_index

    for n in (0, 1, 2, 30):
        e = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("embedding"))
        index = graph_index.build(e, "vec_id", "embedding", part=8)
        got = graph_index.nearest(index, e, "vec_id", "embedding", 3, block=7)
        assert got.count() == n * min(3, max(0, n - 1))
