"""SimHash fingerprints and near-duplicate groups by a tiled exact comparison.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word
shingles. Fingerprints that differ in few bits are linked, and the links' components are the groups.

The distinct fingerprints are dealt by hash into slices; each pair of slices is a task of its own. A
task sorts both by the number of ones in either half, compares tiles by exclusive-or and bit counts,
and skips each pair of tiles whose counts alone differ by more than the radius. Of the matches it
keeps a spanning forest, so that a group of any size yields no more rows than it has members. The
forests are joined by star contraction in DataFrames, written to the shared folder after each round.

Scale: equal fingerprints meet in one pre-aggregated row. The comparison is exact and so grows with
the square of the number of distinct fingerprints, but over 8-byte values only.

Edge cases: a text without words (null or empty too) has fingerprint zero and is linked like any
other; a text with fewer words than a shingle has one shingle of all its words; repeated rows are
copies of each other; rows without an id count last for the smallest id; an empty table gives an
empty result; input columns named as a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.shipping import ship
from larkspur.operators.components import components, meet

from .bpe import map_columns, slices
from .common import cut

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of a tile, usual and most rows of a slice, least slices, and slices beyond which slices grow.
TILE, SLICE, SLICE_MOST, SLICES_LEAST, SLICES = 256, 32_768, 4_000_000, 8, 64


def shingle_hashes(words: list[bytes], size: int, seed: int, first: int = 0) -> np.ndarray:
    """Hash of each run of so many words, from the run that begins at word first; one of all words if there are fewer."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)] if first == 0 else [], np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(whole[a:b], seed) for a, b in zip(starts[first : len(words) - size + 1].tolist(), ends[first + size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    return majority(shingle_hashes(words, size, seed))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 50_000):
        ones += np.unpackbits(h[k : k + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", size: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a long (the 64 bits, signed)."""

    def make(batch: pa.RecordBatch) -> Iterator:
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts):
            yield (a, b), [[(f ^ 1 << 63) - (1 << 63) for f in (fingerprint(x, size, seed) for x in texts[a:b])]]

    return map_columns(docs, T.StructType([T.StructField(name, T.LongType())]), make)


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Forest of smallest members, with the links i-j added."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]


def forest(a: np.ndarray, b: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Values of a and b with a smaller-numbered value of their component under links within the radius; b empty: a with itself."""
    own = not len(b)
    halves = lambda x: (np.bitwise_count(x >> np.uint64(32)).astype(np.int64), np.bitwise_count(x & np.uint64(0xFFFFFFFF)).astype(np.int64))

    def tiled(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        hi, lo = halves(x)
        order = np.lexsort((lo, hi))
        x, hi, lo = x[order], hi[order], lo[order]
        edges = np.arange(0, len(x), tile)
        return x, [f.reduceat(y, edges) for y in (hi, lo) for f in (np.minimum, np.maximum)] if len(x) else []

    a, of_a = tiled(a)
    b, of_b = (a, of_a) if own else tiled(b)
    values = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    parent = np.arange(len(values))
    if not len(a) or not len(b):
        return values[:0], values[:0]
    gap = lambda s, k: np.maximum(0, np.maximum(of_a[k][s] - of_b[k + 1], of_b[k] - of_a[k + 1][s]))
    near = lambda s: np.flatnonzero(gap(s, 0) + gap(s, 2) <= radius)
    held, n = [], 0
    for s, t in ((s, t) for s in range(len(of_a[0])) for t in near(s).tolist() if not own or t >= s):
        x, y = a[s * tile : (s + 1) * tile], b[t * tile : (t + 1) * tile]
        hit = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
        if own and s == t:
            hit = np.triu(hit, 1)
        if not hit.any():
            continue
        p, q = parent[s * tile : s * tile + len(x)], parent[shift + t * tile : shift + t * tile + len(y)]
        i, j = np.nonzero(hit & (p[:, None] != q[None, :]))
        held.append((i + s * tile, j + shift + t * tile))
        n += len(i)
        if n > 50_000:
            parent, held, n = unite(parent, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        parent = unite(parent, *map(np.concatenate, zip(*held, strict=True)))
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return values[linked], values[parent[linked]]


def links(distinct: DataFrame, *, radius: int = 4, name: str = "fp") -> DataFrame:
    """Links (u, v) between distinct fingerprints whose components are those of all links within the radius."""
    rows = distinct.count()
    g = max(SLICES_LEAST, -(-rows // min(SLICE_MOST, max(SLICE, rows // SLICES))))
    s = F.pmod(F.xxhash64(name), F.lit(g))
    cells = distinct.select(F.col(name), s.cast("int").alias("s")).select(name, "s", F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("o"))
    cells = cells.select(name, (F.least("s", "o") * g + F.greatest("s", "o")).cast("long").alias("cell"), (F.col("s") > F.col("o")).alias("second"))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, second = part[name].to_numpy().view(np.uint64), part["second"].to_numpy(bool)
        u, v = forest(x[~second], x[second], radius) if second.any() or key[0] // g == key[0] % g else (x[:0], x[:0])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    ship(distinct.sparkSession)
    return cells.groupBy("cell").applyInPandas(compare, "u long, v long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, size: int = 4, seed: int = 42) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the smallest id of the document's group."""
    marked = cut(fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("_text")), text_col="_text", size=size, seed=seed, name="_fp").drop("_text"))
    distinct = cut(marked.groupBy("_fp").agg(F.min(id_col).alias("_least")))
    root = components(links(distinct, radius=radius, name="_fp")).select(F.col("node").alias("_fp"), "root")
    members = cut(root.unionByName(root.select(F.col("root").alias("_fp"), "root").distinct()))
    bound = members.count()
    least = members.join(distinct, "_fp").groupBy("root").agg(F.min("_least").alias("_of_all"))
    named = meet(members, least, "root", bound).select("_fp", "_of_all")
    named = cut(distinct.join(named, "_fp", "left").select("_fp", F.coalesce("_of_all", "_least").alias("component_id")))
    return marked.join(named, "_fp").select(id_col, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
