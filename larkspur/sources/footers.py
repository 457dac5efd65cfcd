"""Parquet footers as a table, the row groups that a condition leaves, and samples of whole row groups.

A task reads the footers of its files, not their rows. Files are listed on the driver, as Spark does for every scan.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.shipping import ship

FOOTERS = "path string, row_group int, column string, rows long, nulls long, least string, greatest string, codec string, bytes long, raw_bytes long, bloom_at long"
#: What the Parquet format multiplies a hash by for the eight bits of a Bloom filter's block.
SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: What Spark puts into the names of the files of each write, besides their numbers.
MADE_UP = "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, by its address."""
    store, at = pafs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/"))
    return store.open_input_file(at)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the Parquet files of a folder or the file itself, an entry for each, spread over as many tasks as there are files, 1,000 at most."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    return listed.repartition(max(1, min(1000, listed.count())), "path")


def compact(raw: memoryview, at: int, kind: int = 12) -> tuple[object, int]:
    """A value of Thrift's compact protocol, in which footers are written, and the place behind it; structures as {number: value}."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = raw[at]
            out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return out, at

    if kind in (1, 2):
        return kind == 1, at
    if kind == 3:
        return raw[at], at + 1
    if kind in (4, 5, 6):
        n, at = number(at)
        return n >> 1 ^ -(n & 1), at
    if kind == 7:
        return struct.unpack_from("<d", raw, at)[0], at + 8
    if kind == 8:
        n, at = number(at)
        return bytes(raw[at : at + n]), at + n
    if kind in (9, 10):
        n, of, at = raw[at] >> 4, raw[at] & 15, at + 1
        if n == 15:
            n, at = number(at)
        out = []
        for _ in range(n):
            value, at = (raw[at] == 1, at + 1) if of in (1, 2) else compact(raw, at, of)
            out.append(value)
        return out, at
    if kind != 12:
        raise ValueError(f"no kind {kind} in a footer")
    fields: dict[int, object] = {}
    last = 0
    while raw[at]:
        step, of, at = raw[at] >> 4, raw[at] & 15, at + 1
        if step:
            last += step
        else:
            n, at = number(at)
            last = n >> 1 ^ -(n & 1)
        fields[last], at = compact(raw, at, of)
    return fields, at + 1


def bloom_places(file: pa.NativeFile) -> dict[tuple[int, str], int]:
    """Where each column's Bloom filter begins, by row group and column, as the footer has it."""
    file.seek(file.size() - 8)
    length = struct.unpack("<I", file.read(4))[0]
    file.seek(file.size() - 8 - length)
    footer, _ = compact(memoryview(file.read(length)), 0)
    out = {}
    for k, group in enumerate(footer.get(4, [])):
        for chunk in group[1]:
            meta = chunk[3]
            if 14 in meta:
                out[k, ".".join(x.decode() for x in meta[3])] = meta[14]
    return out


def may_hold(file: pa.NativeFile, at: int, raw: bytes) -> bool:
    """Whether a Bloom filter (split blocks, XXH64) lets a value through, given as the bytes that Parquet stores."""
    import xxhash  # only here, so that all else works without it

    file.seek(at)
    head = file.read(64)
    fields, used = compact(memoryview(head), 0)
    h = xxhash.xxh64_intdigest(raw, 0)
    block = (h >> 32) * (fields[1] // 32) >> 32
    file.seek(at + used + 32 * block)
    words = struct.unpack("<8I", file.read(32))
    low = h & 0xFFFFFFFF
    return all(w >> ((low * s & 0xFFFFFFFF) >> 27) & 1 for w, s in zip(words, SALT, strict=True))


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row group and column: rows, nulls, least and greatest value as text, codec, sizes, and where its Bloom filter is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                with opened(path) as file:
                    meta, blooms = pq.ParquetFile(file).metadata, bloom_places(file)
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        for c in range(group.num_columns):
                            col = group.column(c)
                            s = col.statistics if col.is_stats_set else None
                            nulls = s.null_count if s is not None and s.has_null_count else None
                            ends = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                            out.append((path, g, col.path_in_schema, group.num_rows, nulls, *ends, col.compression, col.total_compressed_size, col.total_uncompressed_size, blooms.get((g, col.path_in_schema))))
                if out:
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOOTERS.split(", ")])

    ship(spark)
    return files(spark, path).select("path").mapInArrow(run, FOOTERS)


def stored(value: object, kind: str) -> bytes:
    """A value as Parquet stores it, which is what a Bloom filter hashes."""
    forms = {"int": "<i", "bigint": "<q", "double": "<d", "float": "<f"}
    return value.encode() if kind == "string" else struct.pack(forms[kind], value)


def groups_left(spark: SparkSession, path: str, column: str, value: object, *, bloom: bool = True) -> DataFrame:
    """(path, row_group, rows, by_range, by_bloom): for a lookup of one value, whether a row group's range and Bloom filter leave it; without bloom, the range alone."""
    kind = spark.read.parquet(path).schema[column].dataType.simpleString()
    of = F.col("least").try_cast(kind), F.col("greatest").try_cast(kind)
    wanted = F.lit(value).cast(kind)
    found = footers(spark, path).where(F.col("column") == column)
    inside: Column = F.coalesce((of[0] <= wanted) & (wanted <= of[1]), F.coalesce(F.col("nulls") < F.col("rows"), F.lit(True)))
    if not bloom:
        return found.select("path", "row_group", "rows", inside.alias("by_range"))
    raw = stored(value, kind)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for at, place in zip(batch.column("path").to_pylist(), batch.column("bloom_at").to_pylist(), strict=True):
                if place is None:
                    passed.append(True)
                else:
                    with opened(at) as file:
                        passed.append(may_hold(file, place, raw))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "row_group", "rows", "by_range")), pa.array(passed, pa.bool_())], names=["path", "row_group", "rows", "by_range", "by_bloom"])

    return found.withColumn("by_range", inside).select("path", "row_group", "rows", "by_range", "bloom_at").mapInArrow(probe, "path string, row_group int, rows long, by_range boolean, by_bloom boolean")


def system_sample(spark: SparkSession, path: str, share: float, seed: int = 0) -> DataFrame:
    """The rows of that share of the row groups, rounded up: those with the least hashes of seed, file and number. Nothing else is read.

    A file counts by its name without the letters and figures that a writer makes up anew, so that the same table written again gives the same sample.
    """
    schema = spark.read.parquet(path).schema
    file = F.regexp_replace(F.element_at(F.split("path", "/"), -1), MADE_UP, "")
    groups = footers(spark, path).select("path", "row_group").distinct().withColumn("drawn", F.xxhash64(F.lit(seed), file, "row_group"))
    most = math.ceil(share * groups.count())
    last = groups.orderBy("drawn").limit(most).agg(F.max("drawn")).first()[0]
    groups = groups.where(F.col("drawn") <= last if most else F.lit(False)).select("path", "row_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(at) as file:
                    yield from pq.ParquetFile(file).iter_batches(row_groups=[group], columns=schema.names)

    return groups.mapInArrow(run, schema)
