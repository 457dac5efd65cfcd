"""Versioned Parquet tables: written beside, then switched by one small pointer file; read at any version."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut
from larkspur.operators.changes import accumulate, keyed_diff


class VersionedTable:
    """A folder of versions v=1, v=2 and so on, and of pointers, of which the highest names the current one.

    All files go through Spark's own file system, so that the folder may lie in any store that it knows.
    A reader sees a version only after its pointer is complete; a failed write leaves no pointer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        pointers = self._at("pointers")
        if not self._fs.exists(pointers):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(pointers))

    def write(self, df: DataFrame, *, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> int:
        """Write the next version and switch to it."""
        version = max([0, *self.versions()]) + 1
        if sort_by:
            df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v={version}")
        self.point(version)
        return version

    def point(self, version: int, contents: str = "") -> None:
        """Make a version the current one: the one act by which readers see it."""
        out = self._fs.create(self._at(f"pointers/{version}"), False)
        out.writeBytes(contents)
        out.close()

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def changes(self, first: int, last: int, key: list[str]) -> DataFrame:
        """What was inserted, updated and deleted between two versions."""
        return keyed_diff(self.read(first), self.read(last), key)

    def upsert(self, batch: DataFrame, key: list[str]) -> int:
        """Merge rows by key into the next version."""
        from larkspur.operators.changes import upsert

        return self.write(upsert(self.read(), batch, key) if self.versions() else batch)

    def expire(self, keep: int = 2) -> list[int]:
        """Remove all but the last versions, pointers first."""
        old = self.versions()[:-keep]
        for v in old:
            self._fs.delete(self._at(f"pointers/{v}"), False)
            self._fs.delete(self._at(f"v={v}"), True)
        return old


class BucketedTable:
    """Running totals by key in hash buckets, of which a merge rewrites only those that it touches.

    Each merge writes its buckets beside and then, as its last act, one small pointer file that says in which
    folder every bucket now is, and which batch was the last. A reader sees whole merges only; a batch that comes
    again is known by its number.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.table, self.spark, self.keys, self.buckets = VersionedTable(spark, path), spark, keys, buckets

    def state(self, version: int | None = None) -> dict:
        """What a pointer says, the last one if none is named."""
        known = self.table.versions()
        if not known:
            return {"batch": -1, "at": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.table.path}/pointers/{version or known[-1]}").collect()))

    def _folders(self, at: dict[str, int]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.table.path}/v={v}/_bucket={b}" for b, v in sorted(at.items())))

    def read(self) -> DataFrame:
        return self._folders(self.state()["at"])

    def merge(self, batch: DataFrame, sums: list[str], greatest: list[str], number: int) -> list[int]:
        """Add a grouped batch; the buckets that were written, none if the table has the batch already."""
        state, version = self.state(), max([0, *self.table.versions()]) + 1
        if number <= state["batch"]:
            return []
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = cut(batch)
        touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]
        held = {str(b): state["at"][str(b)] for b in touched if str(b) in state["at"]}
        total = accumulate(self._folders(held), batch, self.keys, sums, greatest) if held else accumulate(batch.limit(0), batch, self.keys, sums, greatest)
        total.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.table.path}/v={version}")
        self.table.point(version, json.dumps({"batch": number, "at": state["at"] | {str(b): version for b in touched}}))
        return sorted(touched)

    def expire(self, keep: int = 2) -> list[str]:
        """Remove all but the last pointers, and the buckets that none of those names any more; what was removed."""
        known = self.table.versions()
        for v in known[:-keep]:
            self.table._fs.delete(self.table._at(f"pointers/{v}"), False)
        named = {f"v={v}/_bucket={b}" for p in known[-keep:] for b, v in self.state(p)["at"].items()}
        gone = []
        for version in self.table._fs.listStatus(self.table._root):
            if not (name := version.getPath().getName()).startswith("v="):
                continue
            there = [f"{name}/{s.getPath().getName()}" for s in self.table._fs.listStatus(version.getPath()) if s.getPath().getName().startswith("_bucket=")]
            gone += (old := [b for b in there if b not in named])
            for b in [name] if len(old) == len(there) else old:
                self.table._fs.delete(self.table._at(b), True)
        return sorted(gone)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df has rows of; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Add a change batch as a partition of its own; the same batch again replaces itself."""
    overwrite_partitions(df.withColumn("_batch", F.lit(batch)), path, ["_batch"])


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(root).getLength()


def files_for(size: int, each: int = 256 << 20) -> int:
    """Files of about so many bytes."""
    return max(1, -(-size // each))


def compact(spark: SparkSession, source: str, target: str, by: str, each: int = 256 << 20) -> None:
    """Rewrite a folder's many files as ranges of a column, each of about so many bytes."""
    spark.read.parquet(source).repartitionByRange(files_for(folder_bytes(spark, source), each), by).write.mode("overwrite").parquet(target)


def drop_source(spark: SparkSession, path: str, dependents: dict[str, set[str]], name: str) -> bool:
    """Remove a source's folder, unless a definition needs it; whether it is gone."""
    if any(name in needs for needs in dependents.values()):
        return False
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def incremental_months(current: DataFrame, fresh: DataFrame, month: str, key: list[str], overlap: int = 1) -> DataFrame:
    """current with the rows of its last months (and later ones) replaced by those computed afresh."""
    since = current.agg(F.add_months(F.max(month), -overlap).alias("_since"))
    recent = fresh.crossJoin(F.broadcast(since)).where(F.col("_since").isNull() | (F.col(month) >= F.col("_since"))).drop("_since")
    return current.join(recent, key, "left_anti").unionByName(recent)


def export_cohort(tags: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Sorted distinct keys that have all of the tag values."""
    out = None
    for snapshot, value in tags.values():
        own = snapshot.where(F.col("tag") == value).select(key).distinct()
        out = own if out is None else out.join(own, key, "left_semi")
    return out.orderBy(key)


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, rows, files, bytes) of Parquet folders, from their metadata."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
        one = df.groupBy("file_path", "file_size").agg(F.count("*").alias("n")).agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out
