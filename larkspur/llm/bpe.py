"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a partition lie one behind another in one array of symbols, linked to their
neighbours. An index maps each mergeable pair to all its positions. The active ranks are applied in
ascending order, each to all its positions at once, and the lists of the neighbouring pairs are
updated. A vocabulary whose merges are in training order (each part is made before it is used) gives
the same tokens in this way as merging every pre-token by itself; others are refused.

The partition's texts come as Arrow batches, of which some characters are worked on at a time; the
tokens of the pre-tokens seen are kept from batch to batch, up to a number of words, until the
partition ends.

Edge cases: null texts count as empty; the special token's string in a text is the special token, as
in the public library; a text is never cut; repeated rows are encoded each; an empty table gives an
empty result; input columns named as a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.functions.shipping import release, ship

#: Fixed value: the pre-token pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters worked on at a time, and pre-tokens whose tokens are kept.
CHARS, KEPT_WORDS = 1_000_000, 150_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Codec:
    """Encoder and decoder of one vocabulary file (its contents as text)."""

    def __init__(self, contents: str, reserved: tuple[str, ...] = ()):
        spec = json.loads(contents)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        #: Control strings that a caller splices in by id; they are never read from a text.
        self.reserved = {x: self.size + k for k, x in enumerate(reserved)}
        self.bytes = [b""] * (self.size + len(reserved))
        for token, k in vocab.items():
            self.bytes[k] = bytes(of[c] for c in token)
        for token, k in (self.special | self.reserved).items():
            self.bytes[k] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in of.items():
            self.of_byte[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        made = np.full(self.size, -1)
        made[new] = np.arange(len(new))
        if len(np.unique(new)) < len(new) or (np.maximum(made[left], made[right]) >= np.arange(len(new))).any():
            raise ValueError("the merges are not in training order")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order
        self.left, self.right, self.new = left, right, new
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.rank_of[at], -1)

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pre-tokens, one behind another, and the number of each."""
        lengths = np.array([len(x) for x in raw], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            r = self.ranks(sym[at], sym[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            edges = np.flatnonzero(np.diff(r, prepend=-1))
            for rank, some in zip(r[edges].tolist(), np.split(at, edges[1:]), strict=True) if len(r) else ():
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(active, rank)
                places[rank].append(some)

        add(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            a, b = self.left[rank], self.right[rank]
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at):  # in a run, every other pair from its left end
                first = np.ones(len(at), bool)
                first[1:] = after[at[:-1]] != at[1:]
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(first, k, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = self.new[rank], -1
            beyond = after[gone]
            after[at], after[gone] = beyond, -1
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            add(np.concatenate([ahead[ahead >= 0], at[beyond >= 0]]))
        alive = sym >= 0
        return sym[alive].astype(np.int32), np.bincount(word[alive], minlength=len(raw))

    def words(self, texts: list[str | None], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Index of each pre-token of the texts, one text behind another, and the number of each text. Below 0: a special token."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        index, find, found, counts = self.index, self.pattern.findall, [], []
        known = len(index)
        for text in texts:
            n = len(found)
            for part in self.split.split(text) if special and text and self.split and any(x in text for x in self.special) else (text,):
                if special and part in self.special:
                    found.append(-1 - self.special[part])
                elif part:
                    found += [index.setdefault(x, len(index)) for x in find(part)]
            counts.append(len(found) - n)
        if len(index) > known:
            new = [x.encode("utf-8", "surrogatepass") for x in list(index)[known:]]
            flat, lengths = self.merge(new)
            starts = np.cumsum(lengths) - lengths + len(self.flat)
            self.flat = np.concatenate([self.flat, flat])
            self.start, self.length = np.concatenate([self.start, starts]), np.concatenate([self.length, lengths])
        return np.array(found, np.int64), np.array(counts, np.int64)

    def encode(self, texts: list[str | None], special: bool = True) -> list[np.ndarray]:
        """Token ids of each text."""
        found, counts = self.words(texts, special)
        plain = np.maximum(found, 0)
        lengths = np.where(found < 0, 1, self.length[plain] if len(self.length) else 1)
        ends = np.cumsum(lengths)
        from_ = np.where(found < 0, 0, self.start[plain] if len(self.start) else 0)
        ids = self.flat[np.repeat(from_ - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)] if len(self.flat) else np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        marks = np.flatnonzero(found < 0)
        ids[ends[marks] - 1] = -1 - found[marks]
        edges = np.concatenate([[0], ends])[np.cumsum(counts)[:-1]] if len(counts) else []
        return np.split(ids, edges) if len(counts) else []

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def codec(contents: str, reserved: tuple[str, ...] = ()) -> Codec:
    return Codec(contents, reserved)


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast of its fixed few megabytes, so that executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(texts: list[str | None], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of about so many characters."""
    at = total = 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def map_columns(docs: DataFrame, columns: T.StructType, make: Callable[[pa.RecordBatch], Iterator[list]], done: Callable[[], None] = lambda: None) -> DataFrame:
    """docs with columns that make derives from each Arrow batch, a slice after another: lists of the new columns' values with the slice's range. done is called at a partition's end."""
    made = {n.lower() for n in columns.names}
    own = [f for f in docs.schema.fields if f.name.lower() not in made]
    kept, schema = [f.name for f in own], T.StructType([*own, *columns.fields])
    types = [(f.name, _arrow(f.dataType)) for f in columns.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (a, b), values in make(batch):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(v, t) for v, (_, t) in zip(values, types, strict=True))], names=[*kept, *(n for n, _ in types)])
        done()
        release()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    plain = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary(), T.FloatType(): pa.float32()}
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, T.ArrayType) else plain[kind]


def encode(docs: DataFrame, vocab_path: str, *, text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with token_ids (array of int) and n_tokens; with digests, also ids_sha256 and, after decoding, decoded_sha256."""
    held = vocabulary(docs.sparkSession, vocab_path)
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def make(batch: pa.RecordBatch) -> Iterator:
        own = codec(held.value)
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts):
            found = own.encode(texts[a:b])
            out = [[len(x) for x in found]]
            if ids:
                out.append(found)
            if digests:
                out.append([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found])
                out.append([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in found])
            yield (a, b), out

    return map_columns(docs, T.StructType(fields), make, lambda: codec(held.value).forget())


def decode(docs: DataFrame, vocab_path: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of their token ids; null ids give null."""
    held = vocabulary(docs.sparkSession, vocab_path)

    def make(batch: pa.RecordBatch) -> Iterator:
        own = codec(held.value)
        yield (0, batch.num_rows), [[None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]]

    return map_columns(docs, T.StructType([T.StructField(text_col, T.StringType())]), make)
