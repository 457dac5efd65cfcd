"""Readers, versioned tables and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources import readers, tables
from larkspur.streaming import incremental


def test_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,points\n1,5\nx,6\n3,\n4,7,8\n5,y\n")
    good, bad = readers.csv_with_rejects(spark, str(tmp_path), T.StructType().add("id", "long").add("points", "integer"))
    assert sorted(map(tuple, good.collect())) == [(1, 5), (3, None)]
    assert {r.reason for r in bad.collect()} == {"id: not a bigint", "wrong number of columns", "points: not a int"}


def test_sniff_and_skip(spark, tmp_path):
    found = readers.sniff("编号;姓名\n1;张三\n2;李四\n".encode("gb18030"))
    assert (found["encoding"], found["delimiter"], found["header"], found["skip"]) == ("GB18030", ";", True, 0)
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.csv").write_bytes("编号;姓名\n1;张三\n".encode("gb18030"))
    assert readers.csv_table(spark, str(tmp_path / "g"), "id int, name string", encoding="GB18030", delimiter=";").first().name == "张三"
    (tmp_path / "b.csv").write_text("made by hand\nid;name\n1;a\n2;b\n")
    found = readers.sniff((tmp_path / "b.csv").read_bytes())
    assert found["skip"] == 1 and found["rows"] == [["1", "a"], ["2", "b"]]
    df = readers.csv_table(spark, str(tmp_path / "b.csv"), "id int, name string", delimiter=";", skip=1)
    assert sorted(map(tuple, df.collect())) == [(1, "a"), (2, "b")]


def test_flatten_and_variant(spark):
    df = spark.createDataFrame([(1, ("x", (2, [3])))], "id int, a struct<b: string, c: struct<d: int, e: array<int>>>")
    assert readers.flatten(df).columns == ["id", "a_b", "a_c_d", "a_c_e"]
    v = spark.createDataFrame([(json.dumps({"k": 5, "s": "t"}),), ("{}",), (None,)], "props string")
    assert [r.k for r in readers.variant_fields(v, "props", {"k": ("$.k", "int")}).collect()] == [5, None, None]


def test_paged(spark):
    fetch = lambda after, until, size: [{"id": k} for k in range(after + 1, min(until, after + size) + 1) if k % 7]
    got = readers.paged(spark, fetch, "id long", lower=0, upper=100, parts=3, size=4)
    assert sorted(r.id for r in got.collect()) == [k for k in range(1, 101) if k % 7]


def test_versions(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"))
    assert table.versions() == []
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert table.write(one) == 1 and table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]) == 2
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, table.read(1).collect())) == [(1, "a"), (2, "b")]
    assert {(r._op, r.k) for r in table.changes(1, 2, ["k"]).collect()} == {("update", 2), ("insert", 3)}
    table.write(one)
    assert table.expire(1) == [1, 2] and table.versions() == [3]
    with pytest.raises(ValueError):
        table.read(1)


def test_failed_write_leaves_no_version(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))
    with pytest.raises(Exception):
        table.write(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")))
    assert table.versions() == [1] and table.read().count() == 3


def test_partition_overwrite(spark, tmp_path):
    at = str(tmp_path / "p")
    tables.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), at, ["d"])
    tables.overwrite_partitions(spark.createDataFrame([(3, "b")], "v int, d string"), at, ["d"])
    assert sorted(map(tuple, spark.read.parquet(at).collect())) == [(1, "a"), (3, "b")]
    tables.compact(spark, at, str(tmp_path / "c"), "v")
    compacted = spark.read.parquet(str(tmp_path / "c"))
    assert compacted.count() == 2 and compacted.select("_metadata.file_path").distinct().count() == 1


def test_stream_totals_once(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k), ("b", 1)], "key string, v long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: incremental.files(spark, str(tmp_path / "in/*"), "key string, v long", per_batch=1)
    table = tables.BucketedTable(spark, str(tmp_path / "t"), ["key"], 8)
    for _ in range(2):  # the second run finds nothing new
        incremental.merge_totals(stream(), table, ["key"], {"n": "count(*)", "s": "sum(v)"}, ["v"], str(tmp_path / "state")).awaitTermination()
    again = incremental.merge_totals(stream(), table, ["key"], {"n": "count(*)", "s": "sum(v)"}, ["v"], str(tmp_path / "lost"))
    again.awaitTermination()  # the same batches once more, as after a lost state
    assert sorted(tuple(r)[:4] for r in table.read().select("key", "n", "s", "v").collect()) == [("a", 3, 3, 2), ("b", 3, 3, 1)]


def test_buckets_touched(spark, tmp_path):
    """A merge writes the buckets of its keys only; a reader of an earlier version is not disturbed; a batch counts once."""
    table = tables.BucketedTable(spark, str(tmp_path / "t"), ["k"], 8)
    batch = lambda *rows: spark.createDataFrame(rows, "k long, n long, at long")
    assert len(table.merge(batch(*((k, 1, 0) for k in range(100))), ["n"], ["at"], 0)) == 8
    before = table.read()
    one = table.merge(batch((5, 2, 9), (1000, 7, 9)), ["n"], ["at"], 1)
    assert 1 <= len(one) <= 2 and table.merge(batch((5, 2, 9)), ["n"], ["at"], 1) == []
    got = {r.k: (r.n, r["at"]) for r in table.read().collect()}
    assert len(got) == 101 and got[5] == (3, 9) and got[1000] == (7, 9) and got[6] == (1, 0)
    assert before.count() == 100
    written = [p for p in (tmp_path / "t/v=2").iterdir() if p.name.startswith("_bucket=")]
    assert sorted(int(p.name.split("=")[1]) for p in written) == one


def test_export(spark):
    tag = lambda *keys: spark.createDataFrame([(k, "yes") for k in keys] + [("z", "no")], "id string, tag string")
    got = tables.export_cohort({"one": (tag("b", "a", "a"), "yes"), "two": (tag("a", "b", "z"), "yes")}, "id")
    assert [r.id for r in got.collect()] == ["a", "b"]
