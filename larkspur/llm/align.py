"""Alignment of two tokenisations of the same texts, and counts of the token pairs that it links.

Tokeniser A is a byte-level vocabulary of the public library, B a piece model with byte fallback. Both always end
before a space behind other than white space, and between a Latin letter and an ASCII character that is none, so
that a text (behind one space) is the sequence of its chunks between such cuts. A first Python worker turns some texts
into one row, of the row's distinct chunks and of each text's chunks by number. Spark brings equal chunks of all rows
together, and a second worker tokenises each once for the whole corpus, some thousands to a row: ids and byte ends
under A and B, one chunk behind another. From there on all is Spark's higher-order functions: array_intersect
of the two arrays of ends gives the offsets where both end, sequence and transform cut the ids into groups and pair
the ids of a group. Each function goes over a row's arrays once.

A pair's count is the number of documents that hold it linked. Counts come to the distinct chunks: those of the
most frequent pairs (HEAVY at most, whatever the corpus) as a broadcast, all others by a join, so that no hot pair
goes through the shuffle. What a chunk adds to a text is made once for the corpus, and goes to the rows that hold it, as a
list a column. There arrays over all chunks of a row's texts count the texts that hold each pair, and sum what chunks add.

Edge cases: a text that is null or empty, or whose bytes under A or B differ from space + text (those with U+2581,
which B reads as a space) has no tokens, zeros and an empty groups_sha256; special tokens' strings are plain text; a
repeated id in a group is counted, not paired again; repeated rows are documents of their own; null ids are kept; an
empty table gives an empty result; only the id and text columns are read, so that no other name clashes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from larkspur.functions.shipping import release, ship

from .bpe import PATTERN, byte_alphabet, slices
from .common import shared_dir

#: Latin letters, and ASCII characters that are none.
LETTER, OTHER = "A-Za-zÀ-ÖØ-öø-ɏ", r"\x00-@\[-`{-\x7f"
#: Where both tokenisers end.
CUT = re.compile(rf"(?=[{OTHER}])(?:(?<=[{LETTER}])|(?<=\S)(?= ))")
#: White space of any tokeniser; with a space behind, it is no place to cut.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
DOUBLE, ODD = [x + " " for x in SPACES], re.compile(r"[^\S\x00-\x7f] ")
#: Characters of texts in one row, and chunks tokenised to a row.
ROW_CHARS, CHUNKS = 8_000_000, 4096
#: Chunks of a row's texts that are looked at together.
AT_ONCE = 200_000
#: Pairs whose counts are broadcast, at 40 bytes each.
HEAVY = 500_000
#: What B writes for a space, and a text of one token that keeps B from writing a space ahead of a chunk.
SPACE, AHEAD = "▁", "a"
#: An id pair as one number: A's id times this, plus B's. An offset and a number go together in the same way.
SHIFT = 1 << 32


def split(text: str) -> list[str]:
    """The text's words; where white space stands ahead of a space, its chunks."""
    if any(x in text for x in DOUBLE) or text[:1] in SPACES or not text.isascii() and ODD.search(text):
        return CUT.split(" " + text)
    return [" " + w for w in text.split(" ")]


def gathered(flat: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """So many of flat from each first place on, and their places."""
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return flat[at], at


def numbered(texts: list[str | None]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct chunks of some texts, and each text's chunks by number. A word is what stands between two spaces, with the one ahead."""
    words: dict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
    found = [np.array(list(map(words.__getitem__, split(x))), np.int32) if x else np.zeros(0, np.int32) for x in texts]
    index: dict[str, int] = defaultdict(count().__next__)
    parts = [[index[w]] if w[1:].isalpha() else list(map(index.__getitem__, CUT.split(w))) for w in words]  # letters behind a space have no cut
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat, first = np.fromiter(chain.from_iterable(parts), np.int32), np.cumsum(counts) - counts
    return list(index), [gathered(flat, first[x], counts[x])[0] if len(x) else x for x in found]


class Pair:
    """Both tokenisers, and the tokens of the chunks given last."""

    def __init__(self, byte_bpe: str, piece_model: bytes):
        import sentencepiece
        import tiktoken

        of = byte_alphabet()
        ranks = {bytes(of[c] for c in x): k for x, k in json.loads(byte_bpe)["model"]["vocab"].items() if all(c in of for c in x)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        across = re.compile(rf"[{LETTER}][{OTHER}]|[^{SPACE}]{SPACE}")
        if any(across.search(x) for k, x in enumerate(pieces) if not self.b.is_byte(k) and not self.b.is_control(k) and not self.b.is_unknown(k)):
            raise ValueError("a piece goes on behind a cut, so that chunks are not independent")
        if len(self.b.encode(AHEAD)) != 1:
            raise ValueError(f"{AHEAD!r} is not one piece")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace(SPACE, " ").encode() for k, x in enumerate(pieces)]
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        for x, k in ranks.items():
            self.widths[0][k] = len(x)

    def chunks(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of each text's chunks, whose tokens are flat then."""
        new, found = numbered(texts)
        self.add(new)
        return found

    def add(self, new: list[str]) -> None:
        """flat: for A and B, ids and byte ends one behind another, each chunk's first place and number. sound: whether B's bytes are the chunk's."""
        a = list(map(self.a.encode_ordinary, new))
        b = [x[1:] for x in self.b.encode([AHEAD + x for x in new], num_threads=1)]
        of = self.b_bytes.__getitem__  # A's bytes are always those of the text
        self.sound = np.array([b"".join(map(of, x)) == y.encode() for x, y in zip(b, new, strict=True)], bool)
        self.flat = []
        for k, ids in enumerate((a, b)):
            counts = np.array(list(map(len, ids)), np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            total = np.concatenate([[0], np.cumsum(self.widths[k][flat])])
            first = np.cumsum(counts) - counts
            self.flat.append((flat, (total[1:] - np.repeat(total[first], counts)).astype(np.int32), first, counts))

    def row(self, chunks: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The chunks' order, sound ones first; of the sound ones ids and ends under A, under B, and their own ends."""
        self.add(chunks)
        sound = np.flatnonzero(self.sound)
        sides = []
        for ids, ends, first, counts in self.flat:
            n, start, upto = counts[sound], first[sound], np.zeros(0, np.int64)
            if len(sound):
                widths = ends[start + n - 1].astype(np.int64)
                upto = np.cumsum(widths)
                ids, at = gathered(ids, start, n)
                sides += [ids, ends[at] + np.repeat(upto - widths, n)]
            else:
                sides += [ids[:0], ends[:0]]
        return np.concatenate([sound, np.flatnonzero(~self.sound)]), [*sides, upto]


@lru_cache(1)
def tokenisers(byte_bpe: str, piece_model: bytes) -> Pair:
    return Pair(byte_bpe, piece_model)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def whole(values: pa.Array) -> pa.ListArray:
    """A row's only list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


INTS, LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())


def texts_in_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of some texts each: texts (id, chunks by number), and the row's distinct chunks."""
    text = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("chunks", INTS)])
    schema = T.StructType([T.StructField("texts", T.ArrayType(text)), T.StructField("names", T.ArrayType(T.StringType()))])

    def made(ids: list[pa.Array], texts: list[str | None]) -> pa.RecordBatch:
        names, numbers = numbered(texts)
        seq = lists(np.concatenate(numbers), np.array(list(map(len, numbers))))
        some = pa.StructArray.from_arrays([pa.concat_arrays(ids), seq], names=text.names)
        return pa.RecordBatch.from_arrays([whole(some), whole(pa.array(names, pa.string()))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total = [], [], 0
        for batch in batches:
            own = batch.column(1).to_pylist()
            for i, j in slices(own, ROW_CHARS):
                ids.append(batch.column(0).slice(i, j - i))
                texts += own[i:j]
                total += sum(len(x or "") for x in own[i:j])
                if total >= ROW_CHARS:
                    yield made(ids, texts)
                    ids, texts, total = [], [], 0
        if texts:
            yield made(ids, texts)
        release()

    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def tokenise(names: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """From (name, places), rows of some chunks each: their places, a and b, their ends, those with their number from 1, and the chunks' own ends.

    Unsound chunks come last, and have places alone.
    """
    sc = names.sparkSession.sparkContext
    with open(byte_bpe, encoding="utf-8") as f, open(piece_model, "rb") as g:
        held = sc.broadcast((f.read(), g.read()))  # the two files' fixed few megabytes
    schema = T.StructType([T.StructField("places", T.ArrayType(names.schema["places"].dataType)), *(T.StructField(x, INTS) for x in ("a", "a_ends", "b", "b_ends", "ends")), T.StructField("a_keys", LONGS), T.StructField("b_keys", LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenisers(*held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, CHUNKS):
                some = batch.slice(k, CHUNKS)
                order, flat = own.row(some.column(0).to_pylist())
                keys = [x.astype(np.int64) * SHIFT + np.arange(1, len(x) + 1) for x in (flat[1], flat[3])]
                yield pa.RecordBatch.from_arrays([whole(some.column(1).take(pa.array(order))), *(whole(pa.array(x, pa.int32())) for x in flat), *map(whole, map(pa.array, keys))], names=schema.names)
        release()

    ship(names.sparkSession)
    return names.select("name", "places").mapInArrow(run, schema)


def keyed(offset: Column, number: Column | int = 0) -> Column:
    return F.shiftleft(offset.cast("long"), 32) + number


def merged(keys: Column, some: Column) -> Column:
    """Keys of offsets and their numbers from 1, and right ahead of each of those that are among some, its number 0. Both are sorted, so that this is a merge."""
    return F.sort_array(F.concat(F.transform(some, lambda e: keyed(e)), keys))


def numbers(both: Column) -> Column:
    """0, and the numbers of those right behind a 0."""
    high, low = F.lit(-SHIFT), F.lit(SHIFT - 1)
    found = F.filter(both, lambda x, j: F.get(both, j - 1) == x.bitwiseAND(high))
    return F.concat(F.array(F.lit(0)), F.transform(found, lambda x: x.bitwiseAND(low).cast("int")))


def tally(ids: Column) -> Column:
    """Distinct ids of a group and how often each occurs."""
    return F.transform(F.array_distinct(ids), lambda x: F.struct(x.cast("long").alias("id"), F.size(F.filter(ids, lambda y: y == x)).cast("long").alias("n")))


def pairs(a: Column, b: Column) -> Column:
    """Distinct pairs of tallied ids and the number of their occurrences."""
    one = lambda x: F.transform(b, lambda y: F.struct(keyed(x["id"], y["id"]).alias("pair"), (x["n"] * y["n"]).alias("n")))
    return F.flatten(F.transform(a, one))


def within(ids: Column, after: Column, upto: Column) -> Column:
    """The ids from number after + 1 to upto; there is one at least."""
    return F.transform(F.sequence(after, upto - 1), lambda k: F.get(ids, k))


def of_groups(r: Column, make) -> Column:
    """make(a after, a upto, b after, b upto) for each group."""
    upto = F.slice(r["a_at"], 2, F.size(r["a_at"]))
    return F.transform(upto, lambda i, g: make(F.get(r["a_at"], g), i, F.get(r["b_at"], g), F.get(r["b_at"], g + 1)))


def group_text(r: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    def ids(side: str, x: Column, y: Column) -> Column:
        return F.when(y - x == 1, F.get(r[side], x).cast("string")).otherwise(F.array_join(within(r[side], x, y).cast("array<string>"), ","))

    return F.concat(ids("a", a0, a1), F.lit("|"), ids("b", b0, b1))


def group_links(r: Column, a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The distinct pairs of a group and their numbers; mostly there is one."""
    one = F.array(F.struct(keyed(F.get(r["a"], a0), F.get(r["b"], b0)).alias("pair"), F.lit(1).cast("long").alias("n")))
    both = F.struct(tally(within(r["a"], a0, a1)).alias("a"), tally(within(r["b"], b0, b1)).alias("b"))
    more = F.get(F.transform(F.array(both), lambda x: pairs(x["a"], x["b"])), F.lit(0))
    return F.when(a1 - a0 + b1 - b0 == 2, one).otherwise(more)


def of_chunks(r: Column, make) -> Column:
    """make(first group, group behind the last) for each chunk."""
    return F.transform(F.slice(r["chunk_at"], 2, F.size(r["chunk_at"])), lambda upto, c: make(F.get(r["chunk_at"], c), upto))


def listed(ids: Column) -> Column:
    """The same array, as objects: an expression that takes elements from it finds them faster there than in a row's bytes."""
    return F.transform(ids, lambda x: x)


def align(names: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """From (name, places), each distinct chunk's key, places, its groups as written, its pairs and their numbers; of an unsound one key and places alone."""
    rows = tokenise(names, byte_bpe, piece_model)
    #: One structure a row goes through the steps: what a step has made is computed once, however often the next one looks into it.
    first = F.struct("places", listed(F.col("a")).alias("a"), listed(F.col("b")).alias("b"), F.array_intersect("a_ends", "b_ends").alias("common"), "ends", "a_keys", "b_keys")
    one = F.array(first)

    def step(make) -> None:
        nonlocal one
        one = F.transform(one, lambda r: F.struct(*(c.alias(name) for name, c in ({"places": r["places"]} | make(r)).items())))

    def both(r: Column) -> dict[str, Column]:
        groups = F.transform(r["common"], lambda e, k: keyed(e, k + 1))
        return {"a": r["a"], "b": r["b"], "a_at": merged(r["a_keys"], r["common"]), "b_at": merged(r["b_keys"], r["common"]), "chunk_at": merged(groups, r["ends"])}

    def chunks(r: Column) -> dict[str, Column]:
        each = lambda g0, g1, name: F.transform(F.sequence(g0, g1 - 1), lambda g: F.get(r[name], g))
        written = lambda g0, g1: F.when(g1 - g0 == 1, F.get(r["written"], g0)).otherwise(F.array_join(each(g0, g1, "written"), ";"))
        links = lambda g0, g1: F.when(g1 - g0 == 1, F.get(r["links"], g0)).otherwise(F.flatten(each(g0, g1, "links")))
        return {"written": of_chunks(r, written), "links": of_chunks(r, links)}

    step(both)
    step(lambda r: {"a": r["a"], "b": r["b"], **{x: numbers(r[x]) for x in ("a_at", "b_at", "chunk_at")}})
    step(lambda r: {"chunk_at": r["chunk_at"], "written": of_groups(r, lambda *at: group_text(r, *at)), "links": of_groups(r, lambda *at: group_links(r, *at))})
    step(chunks)
    rows = rows.select(F.inline(one))
    of_each = ("places", "written", "links")
    rows = rows.select(F.inline(F.arrays_zip(*of_each)))  # null where an array is shorter, as for unsound chunks
    return rows.select(F.monotonically_increasing_id().alias("key"), *of_each[:-1], F.col("links.pair").alias("pairs"), F.col("links.n").alias("numbers"))


def of_rows(chunks: DataFrame, **columns: Column) -> DataFrame:
    """For each row, the numbers of its distinct chunks, whether they are sound and what they have, never null, in the same order: lists of one grouping are filled together."""
    columns = {"sound": F.col("written").isNotNull(), **columns}
    placed = chunks.select(F.explode("places").alias("place"), *(c.alias(name) for name, c in columns.items())).select("place.row", "place.chunk", *columns)
    return placed.groupBy("row").agg(*(F.collect_list(c).alias(c) for c in ("chunk", *columns)))  # column by column, which shuffles less than structures


class Row:
    """A row's texts, and for each of their chunks the place of what it has in the row's lists."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.batch, self.k = batch, k
        self.ids, chunks = self.list("texts").flatten()
        number = self.list("chunk").to_numpy()
        place = np.zeros(len(number), np.int32)
        place[number] = np.arange(len(number))
        self.at, self.sizes = place[chunks.flatten().to_numpy()], chunks.value_lengths().to_numpy().astype(np.int64)

    def list(self, column: str) -> pa.Array:
        """A row without chunks has none."""
        one = self.batch.column(column)[self.k]
        return one.values if one.is_valid else pa.array([], one.type.value_type)

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Each text's sum of its chunks' values."""
        upto, sums = np.cumsum(self.sizes), np.concatenate([[0], np.cumsum(values[self.at])])
        return sums[upto] - sums[upto - self.sizes]

    def sound(self) -> np.ndarray:
        """Whether all chunks of each text are."""
        return self.totals(~self.list("sound").to_numpy(zero_copy_only=False)) == 0


def by_row(rows: DataFrame, make: Callable[[Row], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """What make gives for each row: columns of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenisers.cache_clear()  # which a worker may still hold
        release()
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(make(Row(batch, k)), names=schema.names)
        release()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def held_pairs(row: Row) -> list[pa.Array]:
    """A row's distinct pairs, and how many of its sound texts hold each."""
    pairs = row.list("pairs")
    counts = pairs.value_lengths().to_numpy().astype(np.int64)
    names, number = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
    first, sound, held = np.cumsum(counts) - counts, row.sound(), np.zeros(len(names), np.int64)
    upto = np.cumsum(row.sizes)
    for some in np.split(np.arange(len(upto)), np.flatnonzero(np.diff(upto // AT_ONCE)) + 1):  # texts of so many chunks
        some = some[sound[some] & (row.sizes[some] > 0)]
        if len(some):
            at, _ = gathered(row.at, upto[some] - row.sizes[some], row.sizes[some])
            own, _ = gathered(number, first[at], counts[at])
            found = np.repeat(np.repeat(np.arange(len(some)), row.sizes[some]), counts[at]) * len(names) + own
            found.sort()
            held += np.bincount(found[np.flatnonzero(np.diff(found, prepend=-1))] % len(names), minlength=len(names))
    return [pa.array(names, pa.int64()), pa.array(held, pa.int64())]


def numbers_of(written: pa.Array) -> list[np.ndarray]:
    """Tokens under A and B, groups and links of chunks whose groups are written one behind another."""
    upto = np.frombuffer(written.buffers()[1], np.int32)[written.offset : written.offset + len(written) + 1].astype(np.int64)
    raw = np.frombuffer(written.buffers()[2] or b"", np.uint8)[upto[0] : upto[-1]]
    ends = upto[1:] - upto[0]
    middle, behind = np.flatnonzero(raw == ord("|")), np.sort(np.concatenate([np.flatnonzero(raw == ord(";")), ends[np.diff(upto) > 0]]))
    commas = np.concatenate([[0], np.cumsum(raw == ord(","))])
    a, b = commas[middle] - commas[np.concatenate([[0], behind])[:-1]] + 1, commas[behind] - commas[middle] + 1
    chunk = np.searchsorted(ends, middle, "right")
    return [np.bincount(chunk, x, len(written)).astype(np.int64) for x in (a, b, np.ones(len(a)), a * b)]


def pair_counts(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """pair, the number of documents that hold it linked, and whether that is the highest of its A id (of which B's vocabulary bounds the pairs)."""
    pairs = F.coalesce("pairs", F.array().cast("array<bigint>"))
    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    counts = by_row(texts.join(of_rows(chunks, pairs=pairs), "row"), held_pairs, schema).groupBy("pair").agg(F.sum("n").alias("count"))
    of_a = W.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def heavy_from(counts: DataFrame, most: int) -> float:
    """The least count from which on no more than so many pairs have it, by steps of an eighth."""
    step = F.floor(F.log2("count") * 8)
    left = most
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("step")).collect():
        left -= r["n"]
        if left < 0:
            return least
        least = r["least"]
    return 0


def scores(chunks: DataFrame, counts: DataFrame, most: int = HEAVY) -> DataFrame:
    """For each chunk, the sums of the counts of its links, and of its links whose count is the best."""
    least = heavy_from(counts, most) if most else float("inf")
    parts = chunks.select("key", F.inline(F.arrays_zip("pairs", "numbers"))).toDF("key", "pair", "n")
    top = F.broadcast(counts.where(F.col("count") >= least))
    met = [parts.join(top, "pair")]
    if least:
        met.append(parts.join(top, "pair", "left_anti").join(counts.where(F.col("count") < least), "pair"))
    sums = [x.groupBy("key").agg(F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")) for x in met]
    return sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1]).groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def link_tokens(docs: DataFrame, byte_bpe: str, piece_model: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = HEAVY) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark: SparkSession = docs.sparkSession
    at = f"{shared_dir(spark)}/align-{uuid.uuid4().hex}"

    def writer(df: DataFrame) -> DataFrameWriter:
        return df.write.option("compression", "zstd").option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 8)

    # rows stay in buckets, so that they need no shuffle when what their chunks have comes to them
    table = f"align_{uuid.uuid4().hex}"
    rows = texts_in_chunks(docs, id_col=id_col, text_col=text_col).select(F.monotonically_increasing_id().alias("row"), "texts", "names")
    writer(rows).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "row").format("parquet").option("path", f"{at}/texts").saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name; the files stay
    names = rows.select("row", F.posexplode("names").alias("chunk", "name")).groupBy("name").agg(F.collect_list(F.struct("row", "chunk")).alias("places"))
    chunks = align(names, byte_bpe, piece_model)
    writer(chunks).parquet(f"{at}/chunks")
    chunks = spark.read.schema(chunks.schema).parquet(f"{at}/chunks")
    texts = rows.select("row", "texts")
    writer(pair_counts(texts, chunks)).parquet(f"{at}/counts")
    counts = spark.read.schema("pair long, count long, best boolean").parquet(f"{at}/counts")
    scored = ("n_best", "count_sum")
    sums = {c: F.coalesce(c, F.lit(0).cast("long")) for c in scored}
    both = chunks.select("key", "places", "written").join(scores(chunks, counts, most), "key", "left")
    spark.sparkContext._jvm.System.gc()  # the shuffles of chunks and counts leave the disk when the driver's JVM finds that nothing reads them any more
    both = texts.join(of_rows(both, **sums, written=F.coalesce("written", F.lit("")).cast("binary")), "row", "left")

    def result(row: Row) -> list[pa.Array]:
        sound, written = row.sound(), row.list("written")
        values = [pa.array(row.totals(x) * sound, pa.int64()) for x in (*numbers_of(written), *(row.list(c).to_numpy() for c in scored))]
        written, upto = written.to_pylist(), np.cumsum(row.sizes)
        own = (b";".join(map(written.__getitem__, row.at[i:j].tolist())) if good else b"" for good, i, j in zip(sound.tolist(), (upto - row.sizes).tolist(), upto.tolist(), strict=True))
        return [row.ids, *values, pa.array([sha256(x).hexdigest() if x else "" for x in own], pa.string())]

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", *scored)), T.StructField("groups_sha256", T.StringType())])
    return by_row(both, result, schema)
