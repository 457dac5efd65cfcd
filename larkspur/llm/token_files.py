"""Token ids in binary files: canonical length-limited Huffman coding, and its table-driven decoding.

Every text is encoded by the public tokenizers library and gets an end id. The ids, ordered by document id over a range
partitioning, are written as blocks of whole documents. One code holds for a folder, made from the counts of all ids;
it is canonical, so that a length for each id is all that is kept of it. A block stands for itself: a header, the bit
offset of every STEP-th id as checkpoints, and the bits. Reading goes on from all checkpoints at once: each step looks
up a window of bits for every checkpoint in one table of ids and lengths.

A folder holds `code` (one row) and `blocks` (part, number, ids of the part ahead, documents with their ids' number,
payload). An id's place in the corpus is that of its part, from the sums of the parts, and that within it.

The tokenizer splits at white space before anything else, so that a text's ids are those of its words. Words are
encoded once for some ten thousand texts: those of plain Latin letters, figures and signs are cut as the vocabulary's
own pattern does and go to the library's model, all others to the library as they are.

Edge cases: null and empty texts have the end id only; special tokens' strings in a text are special tokens, as the
library has it; repeated ids are ordered by their token ids, null ids come last; a very long text is a block of its
own; an id that never occurs has no code; an empty table gives a folder without blocks, and an empty result; only the
id and text columns are read, so that no other name clashes.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.shipping import release, ship

from .bpe import _arrow, byte_alphabet, slices, vocabulary
from .common import remove, shared_dir

#: Ids of a block, between two checkpoints, and of a part; parts beyond which they grow instead.
BLOCK, STEP, PART, PARTS = 1 << 18, 256, 8_000_000, 100_000
#: Bits of the longest code, if the vocabulary needs no more, and of the longest that a window of 32 bits can hold.
MAX_BITS, LONGEST = 18, 24
#: A block's first bytes: name, bits of the longest code, ids, ids between checkpoints, bits.
HEAD, NAME = struct.Struct("<4sIQIQ"), b"LKH1"
#: Words and pieces whose ids a worker keeps, from task to task.
KEPT_WORDS = 600_000
#: Latin letters that Unicode's composed normal form leaves alone, and whose lower case is one of them.
LATIN = "À-ÖØ-öø-ÿ"
SIMPLE = re.compile(rf"[\x21-\x7e{LATIN}]+")
ODD = re.compile(rf"[^\x21-\x7e{LATIN}\n]")
#: Fixed value: the vocabulary's own pattern, for such words in lower case, a line each.
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}\n]+|\n")


class Pieces(dict):
    """The ids of what the pattern cuts, found when they are first asked for; of a line's end, -1."""

    def __init__(self, model):
        super().__init__({"\n": [-1]})
        self.model, self.stand_in = model, {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, x: str) -> list[int]:
        mapped = x if x.isascii() else "".join(map(self.stand_in.__getitem__, x.encode()))
        found = self[x] = [t.id for t in self.model.tokenize(mapped)]
        return found


class Words:
    """A tokenizer, and the ids of the words seen."""

    def __init__(self, contents: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(contents)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(contents)
        self.specials = [x["content"][:2] for x in spec["added_tokens"]]
        steps = [x["type"] for part in ("normalizer", "pre_tokenizer") for x in spec[part].get("normalizers", spec[part].get("pretokenizers"))]
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError("the vocabulary does not work word by word")
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.pieces = Pieces(self.model)
        self.flat, self.first, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, new: list[str]) -> None:
        whole = "\n".join(new)
        special = any(s in whole for s in self.specials)
        plain, odd = np.arange(len(new)), np.zeros(0, np.int64)
        if special or ODD.search(whole):
            simple = np.array([not x or SIMPLE.fullmatch(x) is not None and not (special and any(s in x for s in self.specials)) for x in new])
            plain, odd = np.flatnonzero(simple), np.flatnonzero(~simple)
            whole = "\n".join([new[k] for k in plain.tolist()])
        first, counts, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), len(self.flat)
        parts = [self.flat]
        if len(plain):
            ids = np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, PATTERN.findall(whole.lower() + "\n"))), np.int32)
            ends = np.flatnonzero(ids < 0)
            counts[plain] = np.diff(ends, prepend=-1) - 1
            first[plain] = at + ends - counts[plain]
            parts.append(ids)
            at += len(ids)
        if len(odd):
            others = [x.ids for x in self.whole.encode_batch([new[k] for k in odd.tolist()], add_special_tokens=False)]
            counts[odd] = list(map(len, others))
            first[odd] = at + np.cumsum(counts[odd]) - counts[odd]
            parts.append(np.fromiter(chain.from_iterable(others), np.int32))
        self.first, self.counts, self.flat = np.concatenate([self.first, first]), np.concatenate([self.counts, counts]), np.concatenate(parts)

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one behind another, the end id behind each, and the number of each text's."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        known, words = len(self.words), self.words
        found = [list(map(words.__getitem__, x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) if x else [] for x in texts]
        if len(words) > known:
            self.add(list(words)[known:])
        upto = np.cumsum([len(x) for x in found])
        at = np.fromiter(chain.from_iterable(found), np.int64, upto[-1] if len(upto) else 0)
        n = self.counts[at]
        ahead = np.concatenate([[0], np.cumsum(n)])
        ends = ahead[upto] + np.arange(len(texts)) if len(texts) else np.zeros(0, np.int64)
        ids = np.full(ahead[-1] + len(texts), end, np.int32)
        own = np.ones(len(ids), bool)
        own[ends] = False
        ids[own] = self.flat[np.repeat(self.first[at] - ahead[:-1], n) + np.arange(ahead[-1])]
        return ids, np.diff(ends, prepend=-1)


@lru_cache(1)
def words(contents: str) -> Words:
    return Words(contents)


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Bits of each id's code, at most longest and 0 where the count is 0, by merging packages of the least counts.

    Level by level the leaves, in order of their counts, are merged with the pairs of the level before. Of the last
    level the first 2 n - 2 count; they name so many leaves, each a bit longer, and pairs, that is twice as many of the level before.
    """
    used = np.flatnonzero(counts)
    n, out = len(used), np.zeros(len(counts), np.uint8)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)  # exact up to 2^53 ids
    level, levels = leaves, []
    for _ in range(longest):
        is_leaf = np.ones(n, bool)
        if levels:
            pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, pairs])
            rank = np.argsort(both, kind="stable")
            level, is_leaf = both[rank], rank < n
        levels.append(is_leaf)
    take, bits = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    out[order] = bits[:n]
    return out


class Code:
    """A canonical code: the codes of one length follow each other in order of their ids, behind those that are shorter."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        width = 1 << (self.bits - self.lengths[order])  # of windows that begin with the code
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.bits - self.lengths[order])).astype(np.uint64)
        self.id_of, self.length_of = np.zeros(1 << self.bits, np.int32), np.ones(1 << self.bits, np.int64)
        spans = np.repeat(order, width)
        self.id_of[: len(spans)], self.length_of[: len(spans)] = spans, self.lengths[spans]

    def encode(self, ids: np.ndarray, step: int = STEP) -> bytes:
        """A block."""
        lengths = self.lengths[ids]
        start = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        sums = np.zeros(total // 32 + 2, np.uint64)
        if len(ids):  # no two codes share a bit, so that sums of the codes' halves are the words
            word, shift = start >> 5, (64 - (start & 31) - lengths).astype(np.uint64)
            placed = self.codes[ids] << shift
            edges = np.flatnonzero(np.diff(word, prepend=-1))
            sums[word[edges]] += np.add.reduceat(placed >> np.uint64(32), edges)
            sums[word[edges] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), edges)
        bits = sums.astype(">u4").tobytes()[: (total + 7) // 8]
        return HEAD.pack(NAME, self.bits, len(ids), step, total) + start[::step].astype("<u8").tobytes() + bits

    def decode(self, block: bytes) -> np.ndarray:
        """The ids of a block, from all of its checkpoints at once."""
        name, bits, n, step, total = HEAD.unpack_from(block)
        lanes = -(-n // step)
        if name != NAME or bits != self.bits or len(block) != HEAD.size + 8 * lanes + (total + 7) // 8:
            raise ValueError("not a block of this code")
        at = np.frombuffer(block, "<u8", lanes, HEAD.size).astype(np.int64)
        raw = np.frombuffer(block + b"\0\0\0\0", np.uint8, offset=HEAD.size + 8 * lanes).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out, down = np.zeros((step, lanes), np.int32), np.uint32(32 - bits)
        for k in range(min(step, n)):
            if k == n - (lanes - 1) * step:  # the last checkpoint's ids are out
                at = at[:-1]
            look = window[at >> 3] << (at & 7).astype(np.uint32) >> down
            out[k, : len(at)] = self.id_of[look]
            at += self.length_of[look]
        return out.T.reshape(-1)[:n]


@lru_cache(1)
def code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def kind_of(size: int) -> str:
    """How ids of a vocabulary of that size are kept on the way."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokens(docs: DataFrame, vocab_path: str, end: int, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """id, ids (little-endian) and their number for each document, and the vocabulary's size."""
    held = vocabulary(docs.sparkSession, vocab_path)
    size = max(words(held.value).size, end + 1)
    kind = kind_of(size)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(held.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                found, n = own.encode(texts[i:j], end)
                offsets = np.concatenate([[0], np.cumsum(n)]) * np.dtype(kind).itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(found.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), raw], names=schema.names)
        release()

    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema), size


def counted(rows: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id of the vocabulary, which bounds what reaches the driver."""
    kind = kind_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                total += np.bincount(np.frombuffer(b"".join(batch.column(0).slice(a, 1000).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def blocks(rows: DataFrame, lengths: bytes, size: int, ids_each: int = BLOCK) -> DataFrame:
    """part, number, at (ids of the part ahead), documents (id, n), payload; rows are in order within their partition."""
    kind, of_id = kind_of(size), rows.schema["id"].dataType
    document = T.StructType([T.StructField("id", of_id), T.StructField("n", T.LongType())])
    schema = T.StructType([*(T.StructField(x, T.LongType()) for x in ("part", "number", "at")), T.StructField("documents", T.ArrayType(document)), T.StructField("payload", T.BinaryType())])
    held = rows.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, at = code(held.value), 0, 0
        keys, raw, waiting = [], [], 0

        def block() -> pa.RecordBatch:
            made = [len(x) // np.dtype(kind).itemsize for x in raw]
            of = pa.StructArray.from_arrays([pa.array(keys, _arrow(of_id)), pa.array(made, pa.int64())], names=document.names)
            payload = own.encode(np.frombuffer(b"".join(raw), kind))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([at]), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of), pa.array([payload])], names=schema.names)

        for batch in batches:
            for part, key, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "n", "ids")), strict=True):
                keys.append(key)
                raw.append(ids)
                waiting += n
                if waiting >= ids_each:
                    yield block()
                    number, at = number + 1, at + waiting
                    keys, raw, waiting = [], [], 0
        if raw:
            yield block()
        release()

    ship(rows.sparkSession)
    return rows.select(F.spark_partition_id().cast("long").alias("part"), "id", "n", "ids").mapInArrow(run, schema)


def write(docs: DataFrame, vocab_path: str, at: str, *, end: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All documents' ids, each with the end id, as files in a folder that all executors reach."""
    spark = docs.sparkSession
    made, size = tokens(docs, vocab_path, end, id_col=id_col, text_col=text_col)
    aside = folder(spark)
    made.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(aside)
    rows = spark.read.parquet(aside)
    counts = counted(rows, size)
    lengths = code_lengths(counts, min(LONGEST, max(MAX_BITS, int(np.count_nonzero(counts)).bit_length()))).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{at}/code")
    parts = min(PARTS, max(1, -(-int(counts.sum()) // PART)))
    key = [F.col("id").isNull(), F.col("id"), F.xxhash64("ids"), F.col("row")]
    ordered = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key[:2], F.col("ids"), F.col("row"))
    blocks(ordered, lengths, size, block).write.option("compression", "uncompressed").option("parquet.block.size.row.check.min", 8).parquet(f"{at}/blocks")
    remove(spark, aside)


def read(spark: SparkSession, at: str, *, digest: bool = False, ids: bool = True) -> DataFrame:
    """Per document, from a folder's files alone: id, start (ids ahead of it in the corpus), n_tokens, and its ids or their CRC-32."""
    stored = spark.read.parquet(f"{at}/blocks")
    held = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{at}/code").first()["lengths"]))
    of_id = stored.schema["documents"].dataType.elementType["id"].dataType
    own_fields = [T.StructField("ids_crc32", T.LongType())] * digest + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("id", of_id), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), *own_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = code(held.value)
        for batch in batches:
            for k in range(batch.num_rows):
                part, at, payload = (batch.column(c)[k].as_py() for c in ("part", "at", "payload"))
                documents = batch.column("documents")[k].values
                n = np.asarray(documents.field("n"))
                found, ends = own.decode(payload), np.cumsum(n)
                if ends[-1] != len(found):
                    raise ValueError("a block without all its ids")
                arrays = [pa.array(np.full(len(n), part)), documents.field("id"), pa.array(at + ends - n), pa.array(n)]
                if digest:
                    raw = memoryview(found.astype("<u4").tobytes())
                    arrays.append(pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(n.tolist(), ends.tolist(), strict=True)], pa.int64()))
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found)))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        release()

    ship(spark)
    # sums of the parts, which number 100,000 at most
    sums = stored.select("part", F.explode("documents").alias("d")).groupBy("part").agg(F.sum("d.n").alias("n"))
    ahead = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("ahead"))
    found = stored.mapInArrow(run, schema).join(F.broadcast(ahead), "part")
    return found.select("id", (F.col("start") + F.col("ahead")).alias("start"), *schema.names[3:])


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
