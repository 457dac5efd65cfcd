"""Token counts under a unigram model, over a trie of the distinct pre-tokens.

The model gives every token of a public byte-level vocabulary a log probability. A text's count is that
of the most probable segmentation of each of its pre-tokens. No pre-token goes on behind a space that stands behind
other than white space, so that a text's pre-tokens are those of its chunks between such spaces, and a worker looks for them
in each distinct chunk once. Those that it has not met are walked down the vocabulary's trie together, all bytes at
once: the best score of the bytes up to each place, and the fewest tokens that reach that score, come from arrays over
all of them.

The probabilities are fitted by expectation and maximisation to all texts: their distinct pre-tokens, counted by
Spark, are stored, and each round goes over them in parallel. The edges of a batch's lattices (the tokens that begin at
each byte) come from one walk of all bytes at once down the vocabulary's trie; forward scores by end, and the expected
occurrences that flow back along them, are arrays over the batch. A round brings to the driver one sum a token.
Zipf-Mandelbrot's law over the vocabulary's order (token k in proportion to 1 / (k + OFFSET)) begins, and stays as a
prior of PRIOR occurrences, so that tokens that never occur keep a probability. `fitted_scores` is the same, plainly.

Edge cases: null and empty texts have no tokens; a text is never cut; special tokens' strings are plain
text here; repeated rows are counted each; an empty table gives an empty result; input columns named as
a result column are replaced by it.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.shipping import release, ship

from .bpe import Codec, codec, map_columns, slices, vocabulary
from .common import remove, shared_dir

OFFSET = 256
#: Pre-tokens that a worker keeps, and chunks, at some 150 bytes each.
KEPT_WORDS = 400_000
#: Bytes of words in one lattice, and more than a word has tokens.
AT_ONCE, MANY = 40_000, 1 << 62
#: Occurrences of the prior, and rounds.
PRIOR, ROUNDS = 20_000, 3


def ordinary(own: Codec) -> list[bytes]:
    """The tokens that are not special, in the vocabulary's order."""
    return [b for k, b in enumerate(own.bytes) if b and k not in own.special.values() and k not in own.reserved.values()]


def zipf_scores(own: Codec, offset: int = OFFSET) -> dict[bytes, float]:
    """Log probability of each ordinary token by the law."""
    tokens = ordinary(own)
    total = math.log(sum(1 / (k + offset) for k in range(len(tokens))))
    return {b: -math.log(k + offset) - total for k, b in enumerate(tokens)}


def log_sum(x: list[float]) -> float:
    top = max(x, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in x))


def expected(scores: dict[bytes, float], words: list[tuple[bytes, int]]) -> tuple[dict[bytes, float], float]:
    """Expected occurrences of each token in sorted distinct words that occur so often, and their log likelihood."""
    longest, get, path, forward = max(map(len, scores)), scores.get, b"", [0.0]
    counts: dict[bytes, float] = {}
    likelihood = 0.0
    for word, n in words:
        shared = len(commonprefix([path, word]))
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            forward.append(log_sum([forward[start] + p for start in range(max(0, end - longest), end) if (p := get(word[start:end])) is not None]))
        path, whole = word, forward[-1]
        likelihood += n * whole
        backward = [0.0] * (len(word) + 1)
        for start in range(len(word) - 1, -1, -1):
            ways = [(end, p + backward[end]) for end in range(start + 1, min(len(word), start + longest) + 1) if (p := get(word[start:end])) is not None]
            backward[start] = log_sum([w for _, w in ways])
            for end, w in ways:
                counts[word[start:end]] = counts.get(word[start:end], 0.0) + n * math.exp(forward[start] + w - whole)
    return counts, likelihood


def fitted_scores(own: Codec, words: dict[str, int], *, prior: float = PRIOR, rounds: int = ROUNDS, offset: int = OFFSET) -> dict[bytes, float]:
    """Log probabilities fitted to words that occur so often, with the law as a prior."""
    law = zipf_scores(own, offset)
    scores, some = law, sorted((w.encode("utf-8", "surrogatepass"), n) for w, n in words.items())
    for _ in range(rounds if some else 0):
        counts, _ = expected(scores, some)
        total = math.log(sum(counts.values()) + prior)
        scores = {b: math.log(counts.get(b, 0.0) + prior * math.exp(p)) - total for b, p in law.items()}
    return scores


class Lattice:
    """The segmentations of many words at once, over a trie of tokens. Nodes that have children come first, each with a row of 256 children; there is none where a child is 0."""

    def __init__(self, tokens: list[bytes]):
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for k, token in enumerate(tokens):
            at = 0
            for byte in token:
                at = nodes.setdefault((at, byte), len(nodes) + 1)
            ends[at] = k
        above, byte = (np.array(x, np.int64) for x in zip(*nodes, strict=True)) if nodes else (np.zeros(0, np.int64),) * 2
        inner = np.zeros(len(nodes) + 1, bool)
        inner[0] = inner[above] = True
        number = np.empty(len(nodes) + 1, np.int64)
        number[np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])] = np.arange(len(nodes) + 1)
        self.inner = int(inner.sum())
        self.child = np.zeros(256 * self.inner, np.int32)
        self.child[256 * number[above] + byte] = number[1:]
        self.token = np.full(len(nodes) + 1, -1, np.int64)
        self.token[number[list(ends)]] = list(ends.values())
        self.n = len(tokens)

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Places of the words' beginnings and ends (a word of n bytes has n + 1 places), and start, end, token and bytes ahead of the end of each edge, in order of these."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes + 1) - sizes - 1
        letters = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
        ahead = np.arange(len(letters)) - np.repeat(first, sizes + 1)
        left = np.repeat(sizes, sizes + 1) - ahead
        start, node, depth, found = np.flatnonzero(left > 0), np.zeros(int(sizes.sum()), np.int64), 0, []
        while len(start):
            node = self.child[256 * node + letters[start + depth]].astype(np.int64)
            there = np.flatnonzero(node)
            start, node, depth = start[there], node[there], depth + 1
            token = self.token[node]
            ends = np.flatnonzero(token >= 0)
            found.append((start[ends], start[ends] + depth, token[ends]))
            more = np.flatnonzero((node < self.inner) & (left[start] > depth))
            start, node = start[more], node[more]
        start, end, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        small = np.uint16 if len(letters) < 1 << 16 else np.int64  # of which numpy sorts the first by counting
        place = np.empty(len(letters), small)
        place[np.argsort(ahead.astype(small), kind="stable")] = np.arange(len(letters))
        order = np.argsort(place[end], kind="stable")
        return first, first + sizes, start[order], end[order], token[order], ahead[end[order]]

    def expected(self, scores: np.ndarray, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected occurrences of each token in distinct words that occur so often."""
        first, last, start, end, token, ahead = self.edges(words)
        cuts = np.flatnonzero(np.diff(ahead, prepend=-1, append=-1))
        forward = np.full(int(last[-1]) + 1 if len(last) else 0, -np.inf)
        forward[first] = 0.0
        share = scores[token]
        with np.errstate(divide="ignore", invalid="ignore"):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # all that end behind so many bytes
                ways, ends = forward[start[a:b]] + share[a:b], end[a:b]
                heads = np.flatnonzero(np.diff(ends, prepend=-1))
                each = np.diff(np.append(heads, b - a))
                top = np.maximum.reduceat(ways, heads)
                ways = np.exp(ways - np.repeat(top, each))
                sums = np.add.reduceat(ways, heads)
                forward[ends[heads]] = top + np.log(sums)
                share[a:b] = ways / np.repeat(sums, each)  # of what reaches this place
        share[np.isnan(share)] = 0.0  # places that no tokens reach
        flow = np.zeros(len(forward))
        flow[last] = times
        for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
            share[a:b] *= flow[end[a:b]]
            np.add.at(flow, start[a:b], share[a:b])
        return np.bincount(token, share, self.n)


    def fewest(self, scores: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Tokens of the most probable segmentation of each word, of equally probable ones the fewest; 0 if there is none."""
        first, last, start, end, token, ahead = self.edges(words)
        cuts = np.flatnonzero(np.diff(ahead, prepend=-1, append=-1))
        best, n = np.full(int(last[-1]) + 1 if len(last) else 0, -np.inf), np.zeros(int(last[-1]) + 1 if len(last) else 0, np.int64)
        best[first] = 0.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # all that end behind so many bytes
            ways, ends = best[start[a:b]] + scores[token[a:b]], end[a:b]
            heads = np.flatnonzero(np.diff(ends, prepend=-1))
            top = np.maximum.reduceat(ways, heads)
            equal = ways == np.repeat(top, np.diff(np.append(heads, b - a)))
            n[ends[heads]] = np.where(top > -np.inf, np.minimum.reduceat(np.where(equal, n[start[a:b]], MANY), heads) + 1, 0)
            best[ends[heads]] = top
        return n[last]


@lru_cache(1)
def lattice(contents: str) -> Lattice:
    return Lattice(ordinary(codec(contents)))


class Numbers(defaultdict):
    """Distinct strings by number, as they are met."""

    def __init__(self):
        super().__init__(count().__next__)

    def of(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64)

    def since(self, known: int) -> list[str]:
        """Those from that number on."""
        return list(islice(reversed(self), len(self) - known))[::-1]


class Chunks:
    """The distinct chunks of texts by number, without the space ahead of them."""

    def __init__(self):
        self.index, self.odd = Numbers(), np.zeros(0, bool)

    def of(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What each text begins with up to its first chunk, all texts' chunks by number, and how many each has. A text with a space behind white space has none, and begins with all it is."""
        found = [(t or "").split(" ") for t in texts]
        heads, sizes = [x[0] for x in found], np.fromiter(map(len, found), np.int64, len(found)) - 1
        at = self.index.of(chain.from_iterable(x[1:] for x in found))
        self.odd = np.concatenate([self.odd, np.fromiter((not w or w[-1].isspace() for w in self.index.since(len(self.odd))), bool)])
        upto = np.cumsum(sizes)
        odd = np.flatnonzero(self.odd[at])
        text = np.searchsorted(upto, odd, "right")
        whole = {*text[odd < upto[text] - 1].tolist(), *(k for k, x in enumerate(heads) if x and x[-1].isspace())}  # the last may end with white space
        if whole:
            some = list(whole)
            kept = np.ones(len(found), bool)
            kept[some] = False
            at, sizes = at[np.repeat(kept, sizes)], sizes * kept
            for k in some:
                heads[k] = texts[k]
        return heads, at, sizes


def parts(find: Callable[[str], list[str]], some: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of distinct chunks one behind another, and the number of each."""
    joined = find("".join(f" {c}" for c in some if c and not c[-1].isspace()))  # in these, the first pre-token alone begins with a space
    counts = np.diff(np.flatnonzero(np.fromiter((p[0] == " " for p in joined), bool, len(joined))), append=len(joined))
    odd = [k for k, c in enumerate(some) if not c or c[-1].isspace()]
    if not odd:
        return joined, counts
    others = [find(" " + some[k]) for k in odd]
    each, plain = np.zeros(len(some), np.int64), np.ones(len(some), bool)
    each[odd], plain[odd] = list(map(len, others)), False
    each[plain] = counts
    out, rest, of = [], iter(joined), iter(others)
    for n, own in zip(each.tolist(), plain.tolist(), strict=True):
        out += islice(rest, n) if own else next(of)
    return out, each


def pretokens(docs: DataFrame, vocab_path: str, *, text_col: str = "text") -> DataFrame:
    """(word, n): the distinct pre-tokens of all texts and how often they occur."""
    held = vocabulary(docs.sparkSession, vocab_path)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, met, found = codec(held.value).pattern.findall, Chunks(), Numbers()
        n, total = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each chunk met, and each pre-token found

        def more(sums: np.ndarray, at: np.ndarray, times: np.ndarray | None, size: int) -> np.ndarray:
            out = np.bincount(at, times, size).astype(np.int64)
            out[: len(sums)] += sums
            return out

        def put(some: Numbers, sums: np.ndarray) -> pa.RecordBatch:
            there = pa.array(np.flatnonzero(sums))  # chunks of texts that are parted as a whole are met without occurring
            return pa.RecordBatch.from_arrays([pa.array(some, pa.string()).take(there), pa.array(sums).take(there)], names=["word", "n"])

        def parted() -> np.ndarray:
            words, each = parts(find, list(met.index))
            return more(total, found.of(words), np.repeat(n, each), len(found))

        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b in slices(own):
                heads, at, _ = met.of(own[a:b])
                n = more(n, at, None, len(met.index))
                total = more(total, found.of(chain.from_iterable(map(find, heads))), None, len(found))
                if len(n) > KEPT_WORDS:
                    total, met, n = parted(), Chunks(), n[:0]
                if len(total) > KEPT_WORDS:
                    yield put(found, total)
                    found, total = Numbers(), total[:0]
        total = parted()
        yield put(found, total)
        del met, found
        release()

    ship(docs.sparkSession)
    return docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sampled_words(docs: DataFrame, vocab_path: str, *, text_col: str = "text") -> dict[str, int]:
    """All pre-tokens of a small table in the driver, for the plain fit that the one by Spark is held against."""
    return {r.word: r.n for r in pretokens(docs, vocab_path, text_col=text_col).collect()}


def fit(docs: DataFrame, vocab_path: str, *, text_col: str = "text", prior: float = PRIOR, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the ordinary tokens, in order, fitted to all texts."""
    spark = docs.sparkSession
    held = vocabulary(spark, vocab_path)
    own = codec(held.value)
    tokens, law = ordinary(own), zipf_scores(own)
    start = scores = np.array([law[b] for b in tokens])
    at = f"{shared_dir(spark)}/pretokens-{uuid.uuid4().hex}"
    pretokens(docs, vocab_path, text_col=text_col).sortWithinPartitions("word").write.parquet(at)  # in order, so that sums do not depend on the run
    words = spark.read.schema("word string, n long").parquet(at)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(scores.tobytes())

        def make(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            own, now = lattice(held.value), np.frombuffer(model.value)
            total = np.zeros(own.n)
            for batch in batches:
                if batch.num_rows:
                    total += own.expected(now, batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])
            release()

        # as decimals, whose sum does not depend on the order
        sums = words.mapInArrow(make, "token long, n double").groupBy("token").agg(F.sum(F.col("n").cast("decimal(38,18)")).alias("n"))
        counts = np.zeros(len(tokens))
        for r in sums.collect():  # one a token of the vocabulary
            counts[r["token"]] = r["n"]
        if not counts.any():
            break
        scores = np.log(counts + prior * np.exp(start)) - math.log(math.fsum(counts) + prior)
        model.unpersist()
    remove(spark, at)
    return scores


def totals(values: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Sums of so many of the values each."""
    upto, sums = np.cumsum(each), np.concatenate([[0], np.cumsum(values)])
    return sums[upto] - sums[upto - each]


class Counter:
    """Counts of pre-tokens and of chunks, kept between batches up to a number of each."""

    def __init__(self, lattice: Lattice, scores: np.ndarray, pattern):
        self.lattice, self.scores, self.find = lattice, scores, pattern.findall
        self.clear()

    def clear(self) -> None:
        self.words, self.counts = Numbers(), np.zeros(0, np.int64)  # tokens of each pre-token
        self.chunks, self.both = Chunks(), np.zeros((0, 2), np.int64)  # tokens and pre-tokens of each chunk

    def tokens(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Of each word, a bounded number of bytes at once."""
        at = total = 0
        for k, word in enumerate(words, 1):
            total += len(word)
            if total >= AT_ONCE or k == len(words):
                yield self.lattice.fewest(self.scores, words[at:k])
                at, total = k, 0

    def sums(self, words: list[str], each: np.ndarray) -> np.ndarray:
        """Tokens and pre-tokens of so many of the words each."""
        at = self.words.of(words)
        new = [w.encode("utf-8", "surrogatepass") for w in self.words.since(len(self.counts))]
        self.counts = np.concatenate([self.counts, *self.tokens(new)])
        return np.stack([totals(self.counts[at], each), each], axis=1)

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        if len(self.counts) > KEPT_WORDS:
            self.words, self.counts = Numbers(), self.counts[:0]
        if len(self.both) > KEPT_WORDS:
            self.chunks, self.both = Chunks(), self.both[:0]
        heads, at, sizes = self.chunks.of(texts)
        self.both = np.concatenate([self.both, self.sums(*parts(self.find, self.chunks.index.since(len(self.both))))])
        found = list(map(self.find, heads))
        out = self.sums(list(chain.from_iterable(found)), np.fromiter(map(len, found), np.int64, len(found)))
        out += np.stack([totals(x, sizes) for x in self.both[at].T], axis=1)
        return out[:, 0].tolist(), out[:, 1].tolist()


@lru_cache(2)
def counter(contents: str, scores: bytes) -> Counter:
    """Of a vocabulary file's contents and the log probabilities of its ordinary tokens, in order."""
    return Counter(lattice(contents), np.frombuffer(scores), codec(contents).pattern)


def count_tokens(docs: DataFrame, vocab_path: str, *, text_col: str = "text", scores: dict[bytes, float] | None = None) -> DataFrame:
    """docs with n_tokens and n_pretokens, under scores or else under those fitted to docs."""
    held = vocabulary(docs.sparkSession, vocab_path)
    fitted = fit(docs, vocab_path, text_col=text_col) if scores is None else np.array([scores[b] for b in ordinary(codec(held.value))])
    model = docs.sparkSession.sparkContext.broadcast(fitted.tobytes())

    def make(batch: pa.RecordBatch) -> Iterator:
        own = counter(held.value, model.value)
        texts = batch.column(text_col).to_pylist()
        for a, b in slices(texts):
            yield (a, b), list(own.count(texts[a:b]))

    return map_columns(docs, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())]), make, lambda: counter(held.value, model.value).clear())


def brute_count(word: bytes, scores: dict[bytes, float]) -> int:
    """Tokens of one pre-token by dynamic programming of its own; what the trie is tested against."""
    best = np.full(len(word) + 1, -np.inf)
    n = np.zeros(len(word) + 1, np.int64)
    best[0] = 0
    for end in range(1, len(word) + 1):
        options = [(best[start] + scores[word[start:end]], -n[start] - 1) for start in range(end) if word[start:end] in scores]
        best[end], minus = max(options)
        n[end] = -minus
    return int(n[-1])
