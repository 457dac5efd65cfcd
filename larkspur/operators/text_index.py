"""A stored inverted index: postings by term bucket, appended in segments, searched without a scan of the texts.

A document falls into a block by a hash of its id. A segment's folder holds `postings` (a row for each term and block:
ids, frequencies, lengths, and of these the greatest frequency and the least length), in folders by a hash of the term
and sorted by term within, and `terms` (document frequencies, in the same folders), and `totals` (documents and their
lengths). A search opens the buckets of its terms; frequencies and lengths are summed over the segments as they are
now, so that scores are those of one index over all of them.

For the best k documents, each block has an upper bound of what a document in it can reach, from the greatest
frequency and the least length of each term. The blocks with the greatest bounds are scored first; all others whose
bound is below the k-th score found are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.shipping import ship

#: Documents of a block, on average; folders of terms; blocks that are scored first, for each document wanted.
BLOCK, BUCKETS, FIRST = 1_024, 64, 2
#: Postings of a batch that goes back to Spark.
ROWS = 100_000
#: A segment and a block as one number.
SEGMENT = 1 << 32


def counted(listed: DataFrame) -> DataFrame:
    """(id, length, term, tf) of rows (id, _t): each row's distinct terms, counted where the row is."""
    schema = T.StructType([T.StructField("id", listed.schema["id"].dataType), *(T.StructField(c, k) for c, k in (("length", T.IntegerType()), ("term", T.StringType()), ("tf", T.LongType())))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            words = texts.flatten().dictionary_encode()
            known = len(words.dictionary) + 1
            code = pc.fill_null(words.indices, known - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, tf = np.unique(pc.list_parent_indices(texts).to_numpy().astype(np.int64) * known + code, return_counts=True)
            tf, pairs = tf[pairs % known < known - 1], pairs[pairs % known < known - 1]  # a null is no term
            row = pa.array(pairs // known)
            length = pc.list_value_length(texts).take(row).cast(pa.int32())
            for a in range(0, len(pairs), ROWS):
                part = [batch.column(0).take(row[a : a + ROWS]), length[a : a + ROWS], words.dictionary.take(pa.array(pairs[a : a + ROWS] % known)), pa.array(tf[a : a + ROWS].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(part, names=schema.names)

    ship(listed.sparkSession)
    return listed.where(F.size("_t") > 0).mapInArrow(count, schema)


class TextIndex:
    """An index in a folder. A segment is whole when its totals, written last, are there; one without them is not read."""

    def __init__(self, spark: SparkSession, path: str, *, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS):
        self.spark, self.path, self.k1, self.b, self.buckets = spark, path.rstrip("/"), k1, b, buckets
        self._totals: tuple | None = None
        self._id: str | None = None

    def segments(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(root):
            return []
        names = [s.getPath().getName() for s in store.listStatus(root)]
        whole = lambda n: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/totals/_SUCCESS"))
        return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment=") and whole(n))

    def append(self, docs: DataFrame, id_col: str, tokens: Column, *, block: int = BLOCK) -> int:
        """Index more documents as a segment of its own; the number of it. Null ids are indexed like any other."""
        number = max([0, *self.segments()]) + 1
        at = f"{self.path}/segment={number}"
        listed = docs.select(F.col(id_col).alias("id"), tokens.alias("_t"))
        total = listed.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("_t").cast("long")), F.lit(0)).alias("length")).first()
        blocks = max(1, -(-total["docs"] // block))
        tasks = max(1, min(4 * self.buckets, blocks * 2))
        posting = counted(listed).withColumn("block", F.pmod(F.xxhash64("id", F.lit(number)), F.lit(blocks)).cast("int"))
        # a bucket's blocks go to four tasks, and a term's documents of a block meet there without a shuffle of their own
        posting = posting.withColumn("to", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int") * 4 + F.pmod("block", F.lit(4))).repartition(tasks, "to")
        rows = posting.groupBy("to", "term", "block").agg(
            F.collect_list(F.struct("id", "tf", "length")).alias("_d"), F.max("tf").alias("most"), F.min("length").alias("shortest")
        )  # of one block's documents
        rows = rows.select(F.shiftright("to", 2).alias("bucket"), "term", "block", "most", "shortest", *(F.col(f"_d.{c}").alias(f"{c}s") for c in ("id", "tf", "length")))
        writer = lambda df: df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("bucket")
        writer(rows.sortWithinPartitions("bucket", "term", "block")).parquet(f"{at}/postings")
        held = self.spark.read.schema("term string, tfs array<long>, bucket int").parquet(f"{at}/postings")
        terms = held.groupBy("bucket", "term").agg(F.sum(F.size("tfs").cast("long")).alias("df"))
        writer(terms.repartition(min(tasks, self.buckets), "bucket").sortWithinPartitions("bucket", "term")).parquet(f"{at}/terms")
        self.spark.createDataFrame([tuple(total)], "docs long, length long").coalesce(1).write.mode("overwrite").parquet(f"{at}/totals")
        return number

    def _at(self, name: str, buckets: set[int]) -> list[str]:
        """The folders that there are of some buckets, in all segments."""
        paths = [f"{self.path}/segment={s}/{name}/bucket={b}" for s in self.segments() for b in buckets]
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        store = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [p for p in paths if store.exists(hadoop(p))]

    def _of(self, name: str, words: list[str]) -> DataFrame:
        """The rows of a search's terms, from their buckets alone; the schema is known, so that no file is opened for it."""
        made = self.spark.sql("SELECT 1").select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(self.buckets)).cast("int") for w in words)).first()  # folded, without a job
        schema, paths = self.schema(name), self._at(name, set(made))
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, bucket int, segment int")
        out = None
        for s in self.segments():
            if own := [p for p in paths if f"/segment={s}/" in p]:
                one = self.spark.read.schema(f"{schema}, bucket int").option("basePath", f"{self.path}/segment={s}/{name}").parquet(*own).withColumn("segment", F.lit(s))
                out = one if out is None else out.unionByName(one)
        return out.where(F.col("term").isin(*words))

    def schema(self, name: str) -> str:
        if name == "terms":
            return "term string, df long"
        if self._id is None:
            first = self.spark.read.parquet(f"{self.path}/segment={self.segments()[0]}/postings")
            self._id = first.schema["ids"].dataType.elementType.simpleString()
        return f"term string, block int, most long, shortest int, ids array<{self._id}>, tfs array<long>, lengths array<int>"

    def weights(self, words: list[str]) -> tuple[dict[str, float], float]:
        """Each term's inverse document frequency, and the mean length, over all segments as they are."""
        known = tuple(self.segments())
        if self._totals is None or self._totals[0] != known:
            whole = self.spark.read.schema("docs long, length long").parquet(*(f"{self.path}/segment={s}/totals" for s in known))
            self._totals = known, *whole.agg(F.sum("docs"), F.sum("length")).first()
        n, length = self._totals[1:]
        found = self._of("terms", words).groupBy("term").agg(F.sum("df").alias("df")).collect()
        return {r["term"]: log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)) for r in found}, length / n if length else 1.0

    def _gain(self, idf: Column, tf: Column, length: Column, mean: float) -> Column:
        return idf * (tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / F.lit(mean))))

    def _scores(self, postings: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
        of = F.create_map(*(x for w, v in idf.items() for x in (F.lit(w), F.lit(v))))
        hits = postings.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths"))).select("term", F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
        return hits.groupBy("id").agg(F.round(F.sum(self._gain(of[F.col("term")], F.col("tf"), F.col("length"), mean)), 12).alias("score"))

    def scores(self, words: list[str]) -> DataFrame:
        """(id, score) of every document that holds one of the words."""
        words = list(dict.fromkeys(words))
        if not words or not self.segments():
            return self.spark.createDataFrame([], "id long, score double")
        idf, mean = self.weights(words)
        return self._scores(self._of("postings", words), idf or {"": 0.0}, mean)

    def top(self, words: list[str], k: int) -> DataFrame:
        """The k best documents; equal scores go to the smaller id."""
        words = list(dict.fromkeys(words))
        if not words or not self.segments():
            return self.spark.createDataFrame([], "id long, score double")
        idf, mean = self.weights(words)
        best = lambda df: df.orderBy(F.desc("score"), "id").limit(k)
        postings = self._of("postings", words)
        of = F.create_map(*(x for w, v in (idf or {"": 0.0}).items() for x in (F.lit(w), F.lit(v))))
        bound = F.sum(self._gain(of[F.col("term")], F.col("most"), F.col("shortest"), mean)).alias("bound")
        bounds = postings.groupBy("segment", "block").agg(bound)
        first = [r["at"] for r in bounds.orderBy(F.desc("bound")).limit(FIRST * k).select((F.col("segment").cast("long") * SEGMENT + F.col("block")).alias("at")).collect()]
        at = F.col("segment").cast("long") * SEGMENT + F.col("block")
        opened = best(self._scores(postings.where(at.isin(first)), idf, mean)).collect() if first else []  # k rows, as is the result
        if len(opened) < k:
            return best(self._scores(postings, idf or {"": 0.0}, mean))
        more = bounds.where((F.col("bound") >= opened[-1]["score"] - 1e-9) & ~at.isin(first)).select("segment", "block")
        held = self.spark.createDataFrame(opened, self._scores(postings, idf, mean).schema)
        return best(held.unionByName(self._scores(postings.join(more, ["segment", "block"]), idf, mean)))
