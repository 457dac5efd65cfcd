"""A stored graph of near neighbours, and a search along it that compares few vectors.

Vectors fall into parts by a hash of their id, of some thousand each. Within a part every vector gets its nearest
ones by repeated refinement: a neighbour's neighbours, and those whose neighbour one is, are tried until little
changes. Edges run both ways. A search starts from a few entries spread over the part and follows the edges of the best vectors
found, a beam of so many, until none of them leads to a better one; all queries of a block step together. Each part
gives its best, and the best of all parts are the result.

Edge cases: null vectors and those of no length are not indexed and, as queries, find nothing; queries of another
width than a part's vectors find nothing there; a query's own id is no result; equal similarities go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.shipping import ship

from .search import QUERIES, unit_rows

#: Vectors of a part, edges that refinement finds for each, rounds of it, and rows that are refined at a time.
PART, EDGES, ROUNDS, STEP = 4_096, 16, 8, 256
FOUND = "query long, id long, similarity double, compared long"
INDEX = "part int, place int, id long, vector array<float>, edges array<int>"


def best_columns(found: np.ndarray, similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (-1 for none) the k best, each once."""
    order = np.argsort(found, 1, kind="stable")
    found, similarity = np.take_along_axis(found, order, 1), np.take_along_axis(similarity, order, 1)
    again = np.zeros(found.shape, bool)
    again[:, 1:] = found[:, 1:] == found[:, :-1]
    similarity = np.where(again | (found < 0), -np.inf, similarity)
    top = np.argsort(-similarity, 1, kind="stable")[:, :k]
    similarity = np.take_along_axis(similarity, top, 1)
    return np.where(similarity > -np.inf, np.take_along_axis(found, top, 1), -1), similarity


def neighbours(unit: np.ndarray, k: int = EDGES, rounds: int = ROUNDS, seed: int = 7) -> list[np.ndarray]:
    """Edges of each row: its k nearest, as refinement finds them, and the rows whose nearest it is."""
    n = len(unit)
    k = min(k, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    rng = np.random.default_rng(seed)
    near = rng.integers(0, n - 1, (n, k))
    near += near >= np.arange(n)[:, None]
    near, like = best_columns(near, np.einsum("id,ijd->ij", unit, unit[near]), k)
    for _ in range(rounds):
        flat = near.reshape(-1)
        owner = np.repeat(np.arange(n), k)[flat >= 0]
        shuffled = rng.permutation(len(owner))
        to = flat[flat >= 0][shuffled]
        order = np.argsort(to, kind="stable")
        first = np.searchsorted(to[order], np.arange(n))
        count = np.searchsorted(to[order], np.arange(n), "right") - first
        at = first[:, None] + np.arange(k)
        back = np.where(np.arange(k) < count[:, None], owner[shuffled][order][np.minimum(at, len(order) - 1)], -1)
        around, changed = np.concatenate([near, back], 1), 0
        for a in range(0, n, STEP):
            some = around[a : a + STEP]
            tried = np.where(some[:, :, None] >= 0, around[some], -1).reshape(len(some), -1)
            tried = np.concatenate([some, tried], 1)
            tried[tried == np.arange(a, a + len(some))[:, None]] = -1
            s = np.einsum("id,ijd->ij", unit[a : a + STEP], unit[tried])
            best, value = best_columns(np.concatenate([near[a : a + STEP], tried], 1), np.concatenate([like[a : a + STEP], s], 1), k)
            changed += int((best != near[a : a + STEP]).sum())
            near[a : a + STEP], like[a : a + STEP] = best, value
        if changed < 0.001 * n * k:
            break
    both = np.concatenate([np.stack([np.repeat(np.arange(n), k), near.reshape(-1)], 1), np.stack([near.reshape(-1), np.repeat(np.arange(n), k)], 1)])
    both = np.unique(both[(both >= 0).all(1)], axis=0)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))


def build(items: DataFrame, id_col: str, vector_col: str, *, part: int = PART) -> DataFrame:
    """The index as a table: each vector with its part, its place there and its edges."""
    held = items.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    parts = max(1, -(-held.count() // part))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        wide = max(map(len, rows["vector"]))
        matrix = np.array([v if len(v) == wide else np.full(wide, np.nan) for v in rows["vector"]], np.float64)
        sound = np.isfinite(matrix).all(1) & (np.abs(matrix).sum(1) > 0)
        rows, matrix = rows[sound], matrix[sound]
        unit = (matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))).astype(np.float32)
        return pd.DataFrame({"part": key[0], "place": np.arange(len(rows)), "id": rows["id"].to_numpy(), "vector": list(rows["vector"]), "edges": neighbours(unit)}, columns=["part", "place", "id", "vector", "edges"])

    ship(items.sparkSession)
    return held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(make, INDEX)


def walk(unit: np.ndarray, edges: np.ndarray, queries: np.ndarray, beam: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and similarities of the beam that each query ends with, and the vectors that it was compared with."""
    n, q = len(unit), len(queries)
    start = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no vector
    seen[:, start] = seen[:, n] = True
    places, values = best_columns(np.tile(start, (q, 1)), queries @ unit[start].T, beam)
    places = np.pad(places, ((0, 0), (0, beam - places.shape[1])), constant_values=-1)
    values = np.pad(values, ((0, 0), (0, beam - values.shape[1])), constant_values=-np.inf)
    done = np.zeros((q, n + 1), bool)
    compared = np.full(q, len(start))
    going = np.arange(q)
    while len(going):
        open_ = (places[going] >= 0) & ~np.take_along_axis(done[going], places[going] % (n + 1), 1)
        going, open_ = going[open_.any(1)], open_[open_.any(1)]
        if not len(going):
            break
        at = places[going, open_.argmax(1)]
        done[going, at] = True
        next_ = edges[at]
        fresh = ~np.take_along_axis(seen[going], next_, 1)
        seen[going[:, None], next_] = True
        compared[going] += fresh.sum(1)
        s = np.where(fresh, np.einsum("id,ijd->ij", queries[going], unit[np.minimum(next_, n - 1)]), -np.inf)
        places[going], values[going] = best_columns(np.concatenate([places[going], np.where(fresh, next_, -1)], 1), np.concatenate([values[going], s], 1), beam)
    return places, values, compared


def searching(stated: Broadcast, k: int, beam: int, entries: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a part gives for a block of queries."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        names, wanted = stated.value
        rows = rows.sort_values("place")
        matrix = np.stack(rows["vector"].to_numpy()).astype(np.float32)
        fits = np.isfinite(wanted).all(1) if wanted.shape[1] == matrix.shape[1] else np.zeros(len(names), bool)
        names, wanted = names[fits], wanted[fits].astype(np.float32)
        unit = matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))
        longest = max(map(len, rows["edges"]))
        edges = np.array([np.pad(e, (0, longest - len(e)), constant_values=len(rows)) for e in rows["edges"]], np.int64).reshape(len(rows), longest)
        ids, out = rows["id"].to_numpy(), [pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})]
        for a in range(0, len(names), 2_000):
            places, values, compared = walk(unit, edges, wanted[a : a + 2_000], max(beam, k + 1), entries)
            query, at = np.nonzero((places >= 0) & (ids[places] != names[a : a + 2_000, None]))
            out.append(pd.DataFrame({"query": names[a + query], "id": ids[places[query, at]], "similarity": np.round(values[query, at].astype(np.float64), 6), "compared": compared[query]}))
        return pd.concat(out)

    return search


def nearest(index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, *, beam: int = 24, entries: int = 8, block: int = QUERIES) -> DataFrame:
    """(query, id, similarity, place, compared) of the k nearest of each query, and how many vectors it was compared with in that one's part.

    The queries are cut into blocks by a hash, each broadcast as a matrix; a part's vectors are read by one task.
    """
    spark = index.sparkSession
    held = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    blocks, found = max(1, -(-held.count() // block)), None
    ship(spark)
    for b in range(blocks):
        table = held.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        stated = spark.sparkContext.broadcast((table.column(0).to_numpy(), unit_rows(table.column(1).combine_chunks())))
        one = index.groupBy("part").applyInPandas(searching(stated, k, beam, entries), FOUND)
        found = one if found is None else found.unionByName(one)
    of_part = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"), F.max("compared").alias("compared"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return of_part.withColumn("place", place.cast("long")).where(F.col("place") <= k)

