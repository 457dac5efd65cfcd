"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed
greedily into the longest phrases that occur in the sample; the language that needs the fewest, each
weighed by the bits that point into its sample, wins; the bits of the language's share of the labelled
documents are added once, which decides between texts of a word or two. An automaton is a hash table of
its transitions, each a key of state and letter, so that many pieces of texts are walked at once by numpy
lookups, whatever the alphabet: every letter of a sample counts as itself, one of no sample as a phrase.

Every character of a text counts: texts are walked in pieces of BLOCK characters, each parsed from a
fresh start, which costs every language at most one phrase a piece.

The bound of the sample is documented here: CHARS normalised characters a language (fewer if there are over
TOTAL / CHARS languages, so that all samples have TOTAL at most), in pieces of documents drawn by a hash of id and
text, of the LANGUAGES most frequent labels. Only these strings are broadcast; the automata of a language
take up to 150 bytes a character of its sample in a worker, 5 MB for a full one.

Edge cases: null texts and texts without a letter are 'und' with score 0, as are all texts if nothing
is learned; rows without a label teach nothing; ties go to the first language by name; repeated rows
are judged each; an empty table gives an empty result; input columns named as a result column are
replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import map_columns, slices

CHARS, PIECE, BLOCK = 32_768, 1024, 512
#: Characters of all samples, and languages that are learned at most: those of the most documents.
TOTAL, LANGUAGES = 2_097_152, 500
#: Characters of texts worked on at a time.
SLICE = 1_000_000
UNDETERMINED = "und"
#: Bits of a state's number: an automaton has less than twice the states of its sample's characters.
STATE_BITS = 20
STATES = (1 << STATE_BITS) - 1


def references(
    labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", chars: int = CHARS, piece: int = PIECE, total: int = TOTAL, languages: int = LANGUAGES
) -> dict[str, tuple[str, int]]:
    """A bounded sample of text for each language, pieces of documents drawn by a hash, and the number of its documents."""
    drawn_by = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)), F.lit(1 << 40))
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), drawn_by.alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return {}
    chars = min(chars, max(piece, total // len(counts)))
    need = chars // piece * 2
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, 3.0 * need / n)) for lang, n in counts.items()], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.col("h") < F.col("share") * F.lit(1 << 40))
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= need)
    wide = F.greatest(F.lit(piece), F.ceil(F.lit(chars) / F.count("*").over(W.partitionBy("lang")))).cast("int")
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - wide + 1)).cast("int") + 1
    found = drawn.select("lang", "k", start.alias("start"), wide.alias("wide"), "text").select("lang", "k", F.substring("text", F.col("start"), F.col("wide")).alias("t")).collect()
    out: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.k)):
        if len(out.get(r.lang, "")) < chars:
            out[r.lang] = (out.get(r.lang, "") + " " + " ".join("".join(c if c.isalpha() else " " for c in r.t.lower()).split()))[:chars]
    return {k: (v, counts[k]) for k, v in out.items() if v.strip()}


def automaton(text: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of text: for each state, the next state by letter. No edge leads to the root, state 0."""
    links, lengths, edges, last = [-1], [0], [{}], 0
    for c in text:
        now = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        edges.append({})
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = now
            p = links[p]
        if p != -1:
            q = edges[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[now] = q
            else:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                edges.append(dict(edges[q]))
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = links[p]
                links[q] = links[now] = clone
        last = now
    return edges


class Walker:
    """One language's automaton for many walks at once: a perfect hash table of its transitions by state and letter.

    Keys fall into buckets, and each bucket, the fullest first, has the least stride that puts all its keys
    on free places; so that a lookup is two reads and no search.
    """

    def __init__(self, sample: np.ndarray, letters: int):
        edges = automaton(sample.tolist())
        size = np.fromiter(map(len, edges), np.int64, len(edges))
        keys = np.repeat(np.arange(len(edges)), size) * letters + np.fromiter((c for e in edges for c in e), np.int64, int(size.sum()))
        values = np.fromiter((x for e in edges for x in e.values()), np.int64, len(keys))
        self.letters, self.bits = letters, max(4, (2 * len(keys) - 1).bit_length())
        self.root = np.zeros(letters, np.int32)
        self.root[list(edges[0])] = list(edges[0].values())
        self.mask = (1 << self.bits) - 1
        self.stride = np.zeros(1 << self.bits - 3, np.int64)
        bucket, first, step = self.hashes(keys)
        full = np.bincount(bucket, minlength=len(self.stride))
        self.table = np.full(1 << self.bits, -1, np.int64)  # key and next state in one number
        for n in range(int(full.max()), 0, -1):
            left, stride = np.flatnonzero(full[bucket] == n), 0
            left = left[np.argsort(bucket[left], kind="stable")].reshape(-1, n)  # a row for each bucket
            while len(left):
                at = (first[left] + stride * step[left]) & self.mask
                fits = (self.table[at] < 0).all(1)
                asked = np.bincount(at[fits].ravel(), minlength=len(self.table))
                won = np.flatnonzero(fits)[(asked[at[fits]] == 1).all(1)]
                self.table[at[won]], self.stride[bucket[left[won, 0]]] = keys[left[won]] << STATE_BITS | values[left[won]], stride
                left, stride = np.delete(left, won, 0), stride + 1

    def hashes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, first place and step of each key."""
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(67 - self.bits)).view(np.int64), (h >> np.uint64(8)).view(np.int64) & self.mask, (h >> np.uint64(24)).view(np.int64) & self.mask | 1

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the phrases that end: one where a state has no way on, one more for a letter that begins none."""
        keys = state * self.letters + letter
        bucket, first, step = self.hashes(keys)
        at = (first + self.stride[bucket] * step) & self.mask
        entry, root = self.table[at], self.root[letter]
        none = entry >> STATE_BITS != keys
        return np.where(none, root, entry & STATES), none + (none & (root == 0) & (state > 0)).view(np.int8)


class Model:
    """The walkers of all languages, over one numbering of the letters that any sample has."""

    def __init__(self, learned: tuple[tuple[str, tuple[str, int]], ...]):
        samples = [(k, v) for k, (v, _) in learned]
        self.langs = [k for k, _ in samples]
        shares = np.array([n for _, (_, n) in learned], float)
        self.prior = np.log2(shares.sum() / shares)
        letters = sorted(set("".join(v for _, v in samples)) - {" "})
        self.of = np.zeros(0x110000, np.int32)  # 0: anything that is no letter parts words
        self.of[[c for c in range(0x110000) if chr(c).isalpha()]] = 1  # a letter of no sample
        for k, c in enumerate(letters):
            self.of[ord(c)] = k + 2
        self.bits = np.array([math.log2(max(2, len(v))) for _, v in samples])
        self.walkers = [Walker(self.of[np.frombuffer(v.encode("utf-32-le"), np.uint32)], len(letters) + 2) for _, v in samples]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text in each language, its normalised characters, and whether it has a letter."""
        codes = self.of[np.frombuffer("".join(x := [(t or "").lower() for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, x), np.int64, len(x)))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        codes, owner = codes[keep].astype(np.int64), owner[keep]
        lettered = np.bincount(owner[codes > 0], minlength=len(texts)) > 0
        chars = np.bincount(owner, minlength=len(texts))
        start = np.cumsum(chars) - chars
        pieces = -(-chars // BLOCK)
        of = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = start[of] + within * BLOCK
        length = np.minimum(BLOCK, chars[of] - within * BLOCK)
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        out = np.zeros((len(self.langs), len(texts)))
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")
        for k, walker in enumerate(self.walkers):
            state, count = np.zeros(len(of), np.int64), np.ones(len(of), np.int64)
            for t in range(BLOCK):
                n = active[t]
                if not n:
                    break
                state[:n], ended = walker.step(state[:n], codes[begin[:n] + t])
                count[:n] += ended
            out[k] = np.bincount(of, count, minlength=len(texts))
        return out, chars, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        phrases, chars, lettered = self.phrases(texts)
        cost = (phrases * self.bits[:, None] + self.prior[:, None]) / np.maximum(chars, 1)
        best = cost.argmin(0)
        score = 1 / np.exp2(-4 * (cost - cost.min(0))).sum(0)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0).tolist()


@lru_cache(1)
def model(learned: tuple[tuple[str, tuple[str, int]], ...]) -> Model:
    return Model(learned)


def predict(docs: DataFrame, samples: dict[str, tuple[str, int]], *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (between 0 and 1: the share of the weight that the winner has)."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    def make(batch: pa.RecordBatch) -> Iterator:
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts, SLICE):
            yield (a, b), model(held.value).predict(texts[a:b]) if held.value else ([UNDETERMINED] * (b - a), [0.0] * (b - a))

    return map_columns(docs, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), make)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows of docs that are not held out, then predict every row."""
    samples = references(docs.where(~held_out(F.col(id_col))), lang_col=lang_col, text_col=text_col, id_col=id_col)
    return predict(docs, samples, text_col=text_col)
