"""What only larger or more repetitive tables show, on small ones."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.functions.fuzzy import similarity
from larkspur.operators import geo, matching, search, text_index
from larkspur.plans import registry, relational, rest, stored
from larkspur.sources import service
from larkspur.sources import tables as sources
from larkspur.streaming import state

SF = "/root/testdata/sf0.001"


def tables(tmp_path, spark, **frames):
    """A folder of tables, in which only some differ from the given ones."""
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_referrals_beyond_the_limit_of_recursion(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "200")
    try:
        rows = {r.root: (r.downstream, r.levels) for r in relational.j15_recursive_referrals(spark, SF).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    assert rows == {r: (n, k) for r, n, k in db.execute(registry.ORACLES["j15_recursive_referrals"]).fetchall()}


def test_arg_max_of_equal_prices_is_the_first_order(spark, tmp_path):
    rows = [(k, k % 2, None if k == 8 else float(k // 4)) for k in range(1, 12)]
    at = tables(tmp_path, spark, orders=spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double"))
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet/*.parquet'")
    got = sorted(map(tuple, relational.g4_arg_max(spark, at).collect()))
    assert got == sorted(db.execute(registry.ORACLES["g4_arg_max"]).fetchall()) == [(0, 10, 2), (1, 9, 1)]


def test_probing_makes_no_pairs(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    indexed, centres = search.cells(e, "embedding", 4)
    found = search.probe(e.where("vec_id % 20 = 0"), indexed, centres, "vec_id", "embedding", 3, probes=2)
    assert "Join" not in found._jdf.queryExecution().toString()
    rows = {r.vec_id: (np.array(r.embedding, float) / np.linalg.norm(r.embedding), r.cell) for r in indexed.collect()}
    of = {q: np.argsort([-float(v @ (np.array(c) / np.linalg.norm(c))) for c in centres])[:2] for q, (v, _) in rows.items() if q % 20 == 0}
    want = [(q, i, k) for q, cells in of.items() for k, (_, i) in enumerate(sorted((-round(float(rows[q][0] @ v), 12), i) for i, (v, c) in rows.items() if i != q and c in cells)[:3], 1)]
    assert sorted((r["query"], r.vec_id, r.place) for r in found.collect()) == sorted(want)
    assert found.where("similarity IS NULL").count() == 0


def test_lookup_of_a_least_key_among_many(spark, tmp_path):
    """With many orders few row groups reach down to key 5, though the other copy's ranges are of no use."""
    o = spark.range(1, 200_001).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), (F.xxhash64("id") % 1000).cast("double").alias("o_totalprice"))
    at = tables(tmp_path, spark, orders=o)
    got = {r.copy: (r.matches, r.whole, r.by_range_alone, r.by_bloom) for r in stored.s21_lookup_row_groups(spark, at).collect()}
    assert got == {"sorted": (1, True, True, True), "unsorted": (1, True, False, True)}


def test_pages_do_not_scan_their_range_each(spark, tmp_path, monkeypatch):
    keys = [*range(5_000), 10**12, 10**12 + 1]
    pq.write_table(pa.table({"k": keys[::-1], "v": [str(k) for k in keys[::-1]]}), at := str(tmp_path / "t.parquet"))
    reads = []
    dataset = service.pads.dataset
    monkeypatch.setattr(service.pads, "dataset", lambda *a, **b: Counted(dataset(*a, **b), reads))
    pages = service.Pages(StructType.fromDDL("k long, v string"), {"client": "parquet", "table": at, "key": "k", "size": "100"})
    got = [k for batch in pages.read(service.Range(-1, 10**13)) for k in batch.column(0).to_pylist()]
    assert got == keys and len(reads) < 30


class Counted:
    def __init__(self, data, reads):
        self.data, self.reads = data, reads

    def to_table(self, **options):
        self.reads.append(options)
        return self.data.to_table(**options)


def test_many_places_and_points_of_one_position(spark):
    """Places of one position are one candidate; points that are settled do not meet in one task."""
    places = spark.range(4_000).select("id", (F.col("id") % 4).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    points = spark.range(100).select(F.col("id").alias("p"), F.when(F.col("id") != 7, F.col("id") % 4 + 0.1).alias("lat"), F.lit(1.0).alias("lon"))
    for most in (0, 2_000_000):
        found = geo.nearest(points, places, "p", "id", most_broadcast=most)
        assert sorted((r.p, r.id) for r in found.collect()) == [(k, None if k == 7 else k % 4) for k in range(100)]
        assert "CASE WHEN isnull(_best" not in found._jdf.queryExecution().toString() or "ELSE xxhash64" in found._jdf.queryExecution().toString()


def test_small_files_of_larger_tables(spark, monkeypatch):
    """Files and tasks grow with the table."""
    monkeypatch.setattr(sources, "folder_bytes", lambda spark, path: 100 << 20)
    written = []
    write = sources.VersionedTable.write
    monkeypatch.setattr(sources.VersionedTable, "write", lambda self, df, **o: written.append(df.rdd.getNumPartitions()) or write(self, df, **o))
    assert tuple(rest.k17_compaction_and_expiry(spark, SF).first()) == (1500, 2, True)
    assert written == [20, 20, 20, 4]


def test_names_are_measured_only_with_enough_in_common(spark, monkeypatch):
    """Of the names of a block, all that are alike are found, and few others are measured."""
    measured = []
    monkeypatch.setattr(matching, "jaro_winkler", lambda a, b: measured.append(1) or F.lit(0.95))
    names = [(0, f"{k * 7919 % 99_991:05d}{k * 104_729 % 99_991:05d}") for k in range(300)]
    df = spark.createDataFrame(names, "block int, name string")
    got = {tuple(sorted(r)) for r in matching.like_names(df, df, ["block"], 0.9).select("a_name", "b_name").collect()}
    monkeypatch.undo()
    alike = {tuple(sorted((a, b))) for _, a in names for _, b in names if similarity(a, b) >= 0.9}
    assert measured and alike <= got and len(got) < 0.2 * len(names) ** 2 / 2


def test_a_key_of_a_stream_asks_its_state_once():
    """A key costs two calls to the JVM, and no data frame."""
    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("last")

        def exists(self):
            calls.append("exists")
            return "last" in held

        def update(self, value):
            calls.append("update")
            held["last"] = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

    own = state.Updates("v", "at", "number", None)
    own.init(Handle())
    say = Row("v", "at", "number")
    assert [tuple(r) for r in own.handleInputRows((1,), iter([say("b", 5, 1), say("a", 0, 0)]), None)] == [(1, None, "a", "insert", 0), (1, "a", "b", "update", 5)]
    assert [tuple(r) for r in own.handleInputRows((1,), iter([say(None, 6, 2), say("late", 5, 0)]), None)] == [(1, "b", None, "update", 6)]
    assert calls == ["get", "update"] * 2


def test_index_counts_terms_where_texts_are(spark, tmp_path, monkeypatch):
    """Terms are counted without a shuffle or a stored copy of them; null texts, null terms and empty texts are documents like any other."""
    rows = [(1, ["a", "b", "a"]), (2, None), (3, []), (4, ["b", None, "ä"]), (None, ["a"]), (1, ["a"])]
    df = spark.createDataFrame(rows, "id long, words array<string>").coalesce(1)

    def stored_copy(*_):
        raise AssertionError("terms are stored aside")

    monkeypatch.setattr(type(df), "checkpoint", stored_copy)
    index = text_index.TextIndex(spark, str(tmp_path / "index"), buckets=2)
    index.append(df, "id", F.col("words"), block=2)
    got = spark.read.parquet(str(tmp_path / "index/segment=1/postings")).select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths")))
    want = [("a", 1, 1, 1), ("a", 1, 2, 3), ("a", None, 1, 1), ("b", 1, 1, 3), ("b", 4, 1, 3), ("ä", 4, 1, 3)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tuple(spark.read.parquet(str(tmp_path / "index/segment=1/totals")).first()) == (6, 8)
    assert {(r.term, r.df) for r in spark.read.parquet(str(tmp_path / "index/segment=1/terms")).collect()} == {("a", 3), ("b", 2), ("ä", 1)}


def test_unit_rows_make_no_python_numbers():
    """A batch of vectors takes the memory of its matrix a few times over, not that of lists of numbers; odd vectors are near nothing."""
    values = np.random.default_rng(1).normal(size=(2_000, 64)).astype(np.float32)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(2_001) * 64, pa.int32()), pa.array(values.ravel()))
    tracemalloc.start()
    got = search.unit_rows(vectors)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wide = values.astype(float)
    np.testing.assert_allclose(got, wide / np.sqrt((wide * wide).sum(1, keepdims=True)), rtol=1e-15)
    assert most < 4.5 * got.nbytes
    odd = search.unit_rows(pa.array([[3.0, 4.0], None, [1.0], [0.0, 0.0], [1.0, None]], pa.list_(pa.float32())).slice(0, 5), 2)
    assert odd[0].tolist() == [0.6, 0.8] and np.isnan(odd[1:]).all()
    assert search.unit_rows(pa.array([None], pa.list_(pa.float32()))).shape == (1, 0)
