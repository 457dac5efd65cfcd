"""Near copies by SimHash, verified: texts whose sets of 5-word shingles are alike by 0.8 or more (Jaccard).

Texts with equal shingle sets meet first, in one pre-aggregated row. The distinct ones are compared tile
by tile as in simhash.py, but at a wide radius; whatever is within it must also be near by the low bits
of a one-permutation MinHash (256 of them). That gives candidate components only. Within each, the shingle
sets themselves are compared, every pair of them, and only links of at least the likeness count. Of
each group that they connect one row stays.

Scale: the search grows with the square of the number of distinct texts, over 40 bytes each. A candidate
component is cut into slices by its shingles, a task for each pair of slices, which yields a spanning
forest; no group is gathered. Radius and sketch are bounds on chance: at a likeness of exactly 0.8 the
fingerprints of long texts differ in 9.7 bits (deviation 2.9) and the sketches in 25.6 (4.8).

Edge cases: a text without words (null or empty too) has one empty shingle, so that all such texts are
copies of each other; a text with fewer words than a shingle has one shingle of all its words; rows
without an id count last for the row that stays, but are copies like others; of repeated rows with one
id and text the least by the other columns stays; an empty table gives an empty result.
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

from larkspur.functions.shipping import release, ship
from larkspur.operators.components import components

from .bpe import map_columns, slices
from .common import cut
from .minhash import SEED, SHINGLE, pack, split_words
from .quality_lm import joined
from .simhash import SLICE, SLICE_MOST, SLICES, SLICES_LEAST, TILE, majority, shingle_hashes, unite

#: Likeness as a ratio; bits in which fingerprints and sketches of candidates differ at most.
LIKE, RADIUS, FAR = (4, 5), 20, 48
#: Shingles of a slice of a candidate component, usual and most.
PART, PART_MOST = 1_000_000, 4_000_000
SKETCH = [f"_s{k}" for k in range(4)]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(split_words(text or ""), SHINGLE, SEED))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Low bit of each bin of the MinHash fingerprint, as four numbers."""
    return np.packbits(pack(hashes) & 1).view(np.int64)


def marked(docs: DataFrame, text_col: str) -> DataFrame:
    """docs, in place of the text with key and size of its shingle set, fingerprint and sketch of it."""

    def make(batch: pa.RecordBatch) -> Iterator:
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts):
            sets = [shingle_set(x) for x in texts[a:b]]
            keys = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            prints = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
            yield (a, b), [keys, np.array([len(h) for h in sets]), prints, *np.array([sketch(h) for h in sets]).T.copy()]

    return map_columns(docs, T.StructType([T.StructField(c, T.LongType()) for c in ("_key", "_n", "_fp", *SKETCH)]), make).drop(text_col)


def screened(fp: np.ndarray, sk: np.ndarray, first: int, radius: int = RADIUS, far: int = FAR, tile: int = TILE) -> np.ndarray:
    """Forest of the pairs near by fingerprint and sketch (both unsigned: signed numbers' bits are counted without the sign): between the first rows and the others, or among all if there are no others."""
    parent, own = np.arange(len(fp)), first == len(fp)
    for s in range(0, first, tile):
        held = []
        for t in range(s if own else first, len(fp), tile):
            x, y = fp[s : min(s + tile, first)], fp[t : t + tile]
            at = np.flatnonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            i, j = at // len(y) + s, at % len(y) + t
            near = (i < j) & (np.bitwise_count(sk[i] ^ sk[j]).sum(1) <= far)
            if near.any():
                held.append((i[near], j[near]))
        if held:
            parent = unite(parent, *map(np.concatenate, zip(*held, strict=True)))
    return parent


def alike(sets: list[np.ndarray], first: int) -> np.ndarray:
    """As screened, of the pairs whose sets are alike enough, counted exactly."""
    parent, own = np.arange(len(sets)), first == len(sets)
    n = np.array([len(h) for h in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(n)
    begin = 0 if own else first
    others, starts = code[ends[begin] - n[begin] :], (ends - n)[begin:] - (ends[begin] - n[begin])
    mark = np.zeros(int(code.max()) + 1, bool)
    for i in range(first):
        mine = code[ends[i] - n[i] : ends[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[others], starts, dtype=np.int64)
        mark[mine] = False
        j = np.flatnonzero(both * LIKE[1] >= (n[i] + n[begin:] - both) * LIKE[0]) + begin
        j = j[parent[j] != parent[i]]
        if len(j):
            parent = unite(parent, np.full(len(j), i), j)
    return parent


def linked(part: pd.DataFrame, parent: np.ndarray) -> pd.DataFrame:
    keys, at = part["_key"].to_numpy(np.int64), np.flatnonzero(parent != np.arange(len(parent)))
    return pd.DataFrame({"u": keys[at], "v": keys[parent[at]]})


def celled(rows: DataFrame, g) -> DataFrame:
    """rows once for each pair of slices that has theirs, among g slices: _cell, and _second for the larger slice's."""
    rows = rows.withColumn("_g", g.cast("long")).withColumn("_s", F.pmod(F.xxhash64("_key"), F.col("_g")))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_g") - 1)))
    return rows.withColumn("_cell", F.least("_s", "_o") * F.col("_g") + F.greatest("_s", "_o")).withColumn("_second", F.col("_s") > F.col("_o")).drop("_s", "_o")


def halves(part: pd.DataFrame) -> tuple[pd.DataFrame, int]:
    """The first slice's rows ahead of the other's, and their number; 0 if there is no pair."""
    g, cell = int(part["_g"].iloc[0]), int(part["_cell"].iloc[0])
    part = part.sort_values("_second", kind="stable")
    first = int((~part["_second"]).sum())
    return part, first if first < len(part) or cell // g == cell % g else 0


def candidates(distinct: DataFrame) -> DataFrame:
    """(_key, _part) of the texts that have a candidate, with the candidate component's name."""
    rows = distinct.count()
    g = max(SLICES_LEAST, -(-rows // min(SLICE_MOST, max(SLICE, rows // SLICES))))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part, first = halves(part)
        parent = screened(part["_fp"].to_numpy(np.int64).view(np.uint64), np.ascontiguousarray(part[SKETCH].to_numpy(np.int64)).view(np.uint64), first) if first else np.arange(len(part))
        return linked(part, parent)

    ship(distinct.sparkSession)
    cells = celled(distinct.select("_key", "_fp", *SKETCH), F.lit(g))
    found = cut(components(cells.groupBy("_cell").applyInPandas(search, "u long, v long")).select(F.col("node").alias("_key"), F.col("root").alias("_part")))
    return found.unionByName(found.select(F.col("_part").alias("_key"), "_part").distinct())


def links(docs: DataFrame, distinct: DataFrame, text_col: str) -> DataFrame:
    """Verified links (u, v) between keys. docs: _row and text; distinct: as made by deduplicate."""
    held = cut(distinct.join(candidates(distinct), "_key").select("_key", "_part", "_n", F.col("_least._row").alias("_row")))

    def make(batch: pa.RecordBatch) -> Iterator:
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts):
            yield (a, b), [[shingle_set(x).tobytes() for x in texts[a:b]]]

    texts = joined(docs, held.select("_row"), "_row", "left_semi")
    sets = map_columns(texts, T.StructType([T.StructField("_set", T.BinaryType())]), make).groupBy("_row").agg(F.first("_set").alias("_set"))
    total = held.groupBy("_part").agg(F.sum("_n").alias("_total"))
    size = F.least(F.lit(PART_MOST), F.greatest(F.lit(PART), F.col("_total") / SLICES))
    rows = celled(held.join(total, "_part").join(sets, "_row").drop("_row", "_n"), F.ceil(F.col("_total") / size))

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        part, first = halves(part)
        out = linked(part, alike([np.frombuffer(x, np.uint64) for x in part["_set"]], first) if first else np.arange(len(part)))
        release()
        return out

    return rows.groupBy("_part", "_cell").applyInPandas(verify, "u long, v long")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, that of the smallest id, of each group of exact and near copies."""
    names = docs.columns
    docs = docs.withColumn("_row", F.xxhash64(id_col, text_col))
    marks = cut(marked(docs.select(F.col(id_col), "_row", F.col(text_col).alias("_text")), "_text"))
    least = F.min(F.struct(F.col(id_col).isNull().alias("_none"), F.col(id_col).alias("_id"), "_row"))
    distinct = cut(marks.groupBy("_key").agg(least.alias("_least"), *(F.max(c).alias(c) for c in ("_n", "_fp", *SKETCH))))
    root = components(links(docs.select("_row", F.col(text_col).alias("_text")), distinct, "_text")).select(F.col("node").alias("_key"), "root")
    groups = distinct.join(root, "_key", "left").groupBy(F.coalesce("root", "_key").alias("_root")).agg(F.min("_least").alias("_least"))
    stay = groups.select("_least._row").withColumn("_stays", F.lit(True))
    judged = cut(marks.groupBy("_row").agg(F.count("*").alias("_times")).join(stay, "_row", "left"))
    rows = joined(docs, judged.where("_stays IS NULL").select("_row"), "_row", "left_anti")
    repeated = cut(judged.where("_stays AND _times > 1").select("_row"))
    if repeated.isEmpty():
        return rows.select(names)
    once = joined(rows, repeated, "_row", "left_semi").groupBy("_row").agg(F.min(F.struct(*names)).alias("_all")).select("_all.*")
    return joined(rows, repeated, "_row", "left_anti").select(names).unionByName(once)
