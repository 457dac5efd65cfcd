"""Document fingerprints by one-permutation MinHash with optimal densification.

Each word shingle is hashed once. The top bits of the hash choose a bin, which keeps its least hash;
an empty bin takes the value of the first filled bin in a fixed random sequence of its own (optimal
densification). Of each bin the low bits are stored, and likeness is the share of equal bins, corrected
for equality by chance.

Edge cases: a null text counts as empty; a text of fewer words than a shingle, or none, has one
shingle of all its words; equal texts have equal fingerprints; repeated ids are ordered by text, null
ids come last; the only document of a table is its own next one; an empty table gives an empty
result; input columns named as a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.shipping import ship

from .bpe import map_columns, slices
from .simhash import LOWER, shingle_hashes

SHINGLE, BITS, SEED = 5, 8, 42
BINS = 256
#: Characters of a range of ids, and the number of ranges beyond which they grow (800 GB of text).
RANGE_CHARS, RANGES = 8_000_000, 100_000


@lru_cache(1)
def sequences(steps: int) -> np.ndarray:
    """For each bin, the bins from which it borrows, in order."""
    return np.random.Generator(np.random.PCG64(SEED)).integers(0, BINS, (BINS, steps), np.int64)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def pack(hashes: np.ndarray) -> np.ndarray:
    """Low bits of each bin's least hash."""
    h = np.sort(hashes)
    bins = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, filled = np.zeros(BINS, np.uint8), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = (h[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8), True
    empty = np.flatnonzero(~filled)
    for steps in (16, 4096):
        if len(empty):
            tried = filled[sequences(4096)[empty, :steps]]
            found, at = tried.any(1), tried.argmax(1)
            out[empty[found]] = out[sequences(4096)[empty[found], at[found]]]
            empty = empty[~found]
    out[empty] = out[np.argmax(filled)]  # once in about 10 million single-shingle texts
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, *, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the packed bins as hexadecimal digits."""

    def make(batch: pa.RecordBatch) -> Iterator:
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts):
            yield (a, b), [[pack(shingle_hashes(split_words(x or ""), SHINGLE, SEED)).tobytes().hex() for x in texts[a:b]]]

    return map_columns(docs, T.StructType([T.StructField(name, T.StringType())]), make)


def edited(text: str, other: str) -> tuple[str, int]:
    """text with its last quarter replaced by the beginning of other, and the length of what stays."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k], len(text) - k


def measure(text: str, own: list[bytes], hashes: np.ndarray, mine: np.ndarray, other: str, others: np.ndarray) -> tuple:
    changed, stays = edited(text, other)
    words = split_words(changed)
    same = max(0, len(split_words(text[:stays])) - 1)  # the last of these words may go on behind the cut
    shared = max(0, same - SHINGLE + 1) if len(words) > SHINGLE and len(own) > SHINGLE else 0
    its = pack(np.concatenate([hashes[:shared], shingle_hashes(words, SHINGLE, SEED, shared)]))
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, mine.tobytes().hex(), its.tobytes().hex(), likeness(mine, its), likeness(mine, others)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_range, _copy, id, text), dealt and sorted so that behind each row stands the next document.

    The order is (id, hash of the text, text), null ids last. It is cut into ranges, each a partition. Each
    range's first document is repeated, as a copy, at the end of the range before (the last range's next is the
    first's), so that every range is read by itself as a stream. The cuts, the first keys of a range
    partitioning of the ids and hashes alone, are one key for each range on the driver.
    """
    key = [F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")]
    keys = docs.select(*key, F.length(text_col).alias("_chars"))
    total = keys.agg(F.sum("_chars").alias("c"), F.count("*").alias("n")).first()
    ranges = min(RANGES, max(1, -(-(total["c"] or 0) // RANGE_CHARS), total["n"] // 1_000_000))
    spread = keys.drop("_chars").repartitionByRange(ranges, "_none", "_id", "_hash").select(F.spark_partition_id().alias("_p"), F.struct("_none", "_id", "_hash").alias("_key"))
    cuts = sorted(tuple(r["k"]) for r in spread.groupBy("_p").agg(F.min("_key").alias("k")).collect())
    orders = [(none, 0 if i is None else i, h) for none, i, h in cuts]  # null is compared by _none alone
    held = docs.sparkSession.sparkContext.broadcast(orders)

    def place(batch: pa.RecordBatch) -> Iterator:
        cuts = held.value
        found = list(zip(batch.column("_none").to_pylist(), (0 if i is None else i for i in batch.column("_id").to_pylist()), batch.column("_hash").to_pylist(), strict=True))
        at = [max(0, bisect_right(cuts, k) - 1) for k in found]
        yield (0, len(found)), [at, [(a - 1) % len(cuts) if k == cuts[a] else None for a, k in zip(at, found, strict=True)]]

    rows = docs.select(*key, F.col(text_col).alias("_text"))
    rows = map_columns(rows, T.StructType([T.StructField(c, T.IntegerType()) for c in ("_range", "_back")]), place)
    both = F.array(F.struct(F.col("_range"), F.lit(0).alias("_copy")), F.struct(F.col("_back").alias("_range"), F.lit(1).alias("_copy")))
    rows = rows.select("_none", "_id", "_hash", "_text", F.explode(F.filter(both, lambda x: x["_range"].isNotNull())).alias("_at")).select("_at._range", "_at._copy", "_none", "_id", "_hash", "_text")
    rows = rows.repartitionById(max(1, len(cuts)), "_range").sortWithinPartitions("_copy", "_none", "_id", "_hash", "_text")
    return rows.select("_range", "_copy", F.col("_id").alias(id_col), F.col("_text").alias(text_col))


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to it and to the next document."""
    kind = docs.schema[id_col].dataType
    text_type = [T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), *text_type, T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            types = pa.schema([(id_col, batch.schema.field(id_col).type), ("n_chars", pa.int64()), *((f.name, pa.string()) for f in text_type), ("near_edited", pa.float64()), ("near_next", pa.float64())])
            for a in range(0, batch.num_rows, 500):
                out = []
                part = batch.slice(a, 500)
                for at, copy, key, text in zip(*(part.column(c).to_pylist() for c in ("_range", "_copy", id_col, text_col)), strict=True):
                    if copy and (held is None or held[0] != at):
                        continue  # only the first copy counts
                    text = text or ""
                    own = split_words(text)
                    hashes = shingle_hashes(own, SHINGLE, SEED)
                    mine = pack(hashes)
                    if held is not None:
                        out.append((held[1], *measure(*held[2:], text, mine)))
                    held = None if copy else (at, key, text, own, hashes, mine)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types.types, strict=True)], schema=types)

    ship(docs.sparkSession)
    return with_next(docs, id_col=id_col, text_col=text_col).mapInArrow(run, schema)
