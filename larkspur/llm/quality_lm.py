"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has characters as its tokens and reaches back ORDER - 1 of them. Its counts come from all
trusted documents (labelled as of good quality and not toxic) but the held-out tenth, summed per partition
before the shuffle, and lie sharded by n-gram in a table with a row for each n-gram that occurs: its
discounted probability, and the weight that it gives to shorter contexts as a context itself. An n-gram is
known by a 64-bit hash of its characters, whichever they are.

Scoring is a join of sharded counts. Documents are dealt into blocks of about BLOCK_CHARS characters; a
block asks for each n-gram that occurs in it once, the requests are joined with the table by n-gram,
and the answers go back to the block, which looks them up for its documents. The texts are shuffled
once, for the blocks, as compressed Arrow batches, which are opened one after another; both the requests
and the scoring read that exchange.

A document's score is its mean loss in bits a character, with PRIOR characters of the mean loss of its
language's trusted documents added, so that a few words are not judged harshly; the perplexity is 2 to
the power of the mean loss alone. A document is kept if its score is at most SLACK times the QUANTILE of the
scores of its language's held-out trusted documents, which the counts have not seen. A language of fewer than
LEAST of those takes, above its own mean, the quantile of how far all held-out ones are above theirs.

Edge cases: texts without a character (null too) have no perplexity and are not kept; without trusted
documents nothing can be said and all texts with a character are kept; trusted documents too few for any to
be held out are judged by themselves; a language without trusted documents takes the mean of all; a null
language is a language; rows with the same id are scored each, spread over the blocks, and count as trusted
together; rows without an id are never trusted; an empty table gives an empty result; input columns named
as a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions.shipping import release, ship

from .bpe import slices
from .common import cut

ORDER = 4
#: Characters of a block; characters added to a document's score; the threshold; trusted documents of which one is held out.
BLOCK_CHARS, PRIOR, QUANTILE, SLACK, LEAST, HELD_OUT = 32_000_000, 200, 0.99, 1.15, 50, 10
#: Characters worked on at a time.
CHARS = 400_000
#: Symbol ahead of a text.
START = "\x01"
#: Columns of an n-gram of each order that ends at a character, and of the context ahead of it.
GRAMS, CONTEXTS = [f"g{k}" for k in range(1, ORDER + 1)], [f"x{k}" for k in range(2, ORDER + 1)]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each order that end at each character of the texts with START ahead of them, where the texts' own characters are, and whose.

    The hash of an n-gram is made from its last character backwards, so that a context's is that of the
    n-gram that ends one character before.
    """
    lead = START * (ORDER - 1)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    code = np.frombuffer("".join(lead + (t or "") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = np.zeros((ORDER, len(code)), np.uint64)
    h = np.zeros(len(code), np.uint64)
    for k in range(ORDER):
        h[k:] = (h[k:] + code[: len(code) - k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        hashes[k] = h
    owner = np.repeat(np.arange(len(texts)), sizes)
    return hashes.view(np.int64), np.arange(len(owner)) + (owner + 1) * (ORDER - 1), owner


def distinct(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row (GRAMS, CONTEXTS) for each n-gram of the full order that the texts have, which of them ends at each character, and whose it is."""
    hashes, at, owner = grams(texts)
    which, full = pd.factorize(hashes[ORDER - 1][at])
    first = np.empty(len(full), np.int64)
    first[which[::-1]] = at[::-1]
    return np.stack([*(h[first] for h in hashes), *(h[first - 1] for h in hashes[:-1])], 1), which, owner


def combined(rows: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each n-gram once, and the sum of its counts."""
    every = np.concatenate(rows)
    which, full = pd.factorize(every[:, ORDER - 1])
    first = np.empty(len(full), np.int64)
    first[which[::-1]] = np.arange(len(every))[::-1]
    return every[first], np.bincount(which, np.concatenate(counts), minlength=len(full)).astype(np.int64)


def count(docs: DataFrame, text_col: str) -> DataFrame:
    """(GRAMS, CONTEXTS, n): occurrences of each n-gram of the full order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, counts = [np.zeros((0, 2 * ORDER - 1), np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, CHARS):
                once, which, _ = distinct(texts[a:b])
                rows.append(once)
                counts.append(np.bincount(which, minlength=len(once)))
                if sum(map(len, rows[1:])) > 500_000:
                    rows, counts = ([x] for x in combined(rows, counts))
        rows, counts = combined(rows, counts)
        release()
        for a in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows[a : a + 50_000].T), pa.array(counts[a : a + 50_000])], names=[*GRAMS, *CONTEXTS, "n"])

    ship(docs.sparkSession)
    found = docs.select(text_col).mapInArrow(run, ", ".join(f"{c} long" for c in (*GRAMS, *CONTEXTS, "n")))
    return found.groupBy(GRAMS[-1]).agg(*(F.min(c).alias(c) for c in (*GRAMS[:-1], *CONTEXTS)), F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """Of counts 1, 2 and 3 or more, from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    if not all(n):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """Table (gram, p, back): discounted probability of an n-gram, weight of shorter ones behind it as a context; and the weight and share of an unseen symbol."""
    level = counts.withColumnRenamed("n", "c")
    parts, floor = [], 1.0
    none = F.lit(None).cast("float")
    for order in range(ORDER, 0, -1):
        level = cut(level)
        seen = level.agg(*(F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)), F.count("*").alias("types")).first()
        d = discounts([seen[k] for k in range(4)])
        cut_by = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        gram = F.col(f"g{order}").alias("gram")
        if order > 1:
            context = f"x{order}"
            sums = level.groupBy(context).agg(F.sum("c").alias("s"), F.sum(cut_by).alias("held"))
            parts.append(level.join(sums, context).select(gram, ((F.col("c") - cut_by) / F.col("s")).cast("float").alias("p"), none.alias("back")))
            parts.append(sums.select(F.col(context).alias("gram"), none.alias("p"), (F.col("held") / F.col("s")).cast("float").alias("back")))
            left = [*GRAMS[: order - 2], *CONTEXTS[: order - 2]]
            level = level.groupBy(f"g{order - 1}").agg(F.count("*").alias("c"), *(F.min(c).alias(c) for c in left))
        else:
            whole = level.agg(F.sum("c").alias("s"), F.sum(cut_by).alias("held")).first()
            floor = whole.held / whole.s / (seen["types"] + 1) if whole.s else 1.0
            parts.append(level.select(gram, ((F.col("c") - cut_by) / F.lit(whole.s or 1)).cast("float").alias("p"), none.alias("back")))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return cut(table.groupBy("gram").agg(F.max("p").alias("p"), F.max("back").alias("back"))), floor


def losses(rows: np.ndarray, known: pd.DataFrame, floor: float) -> np.ndarray:
    """Bits of each n-gram of the full order, from the rows of the table that concern it."""
    index = pd.Index(known["gram"].to_numpy(np.int64))
    p_of, back_of = (np.append(known[c].fillna(x).to_numpy(float), x) for c, x in (("p", 0.0), ("back", 1.0)))
    p = np.full(len(rows), floor)
    for order in range(1, ORDER + 1):
        back = back_of[index.get_indexer(rows[:, ORDER + order - 2])] if order > 1 else 1.0
        p = p_of[index.get_indexer(rows[:, order - 1])] + back * p
    return -np.log2(p)


def packed(docs: DataFrame, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """(_block, _size, _rows): docs dealt into blocks by a hash, as compressed Arrow batches, and their bytes before that.

    Rows that are equal in id and text are told apart by how many of them a partition has had, so that they
    are spread, and a task that runs again makes the same blocks of the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            block = np.zeros(batch.num_rows, np.int64)
            for k, (key, text) in enumerate(zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), strict=True)):
                h = xxhash.xxh3_64_intdigest(f"{key} {text}".encode("utf-8", "surrogatepass"))
                n = seen[h] = seen.get(h, -1) + 1
                block[k] = (h ^ n * 0x9E3779B97F4A7C15) % (1 << 61) % blocks
            order = np.argsort(block, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                raw = batch.take(pa.array(some)).serialize()
                rows = pa.compress(raw, "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([block[some[0]]], pa.int32()), pa.array([raw.size], pa.int64()), pa.array([rows], pa.binary())], names=["_block", "_size", "_rows"])
        release()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "_block int, _size long, _rows binary")


def opened(part: pd.DataFrame, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for size, rows in zip(part["_size"], part["_rows"], strict=True):
        yield pa.ipc.read_record_batch(pa.decompress(rows, decompressed_size=int(size), codec="zstd"), schema)


def score(docs: DataFrame, table: DataFrame, floor: float, *, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and keep columns of docs with bits (the sum over the text, 0 if it is empty) and chars."""
    blocks = max(1, -(-(docs.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0) // BLOCK_CHARS))
    names = tuple(dict.fromkeys((id_col, *keep)))
    rows = docs.select(*names, text_col)
    arrow = to_arrow_schema(rows.schema)
    base = packed(rows, blocks, id_col, text_col).repartition(blocks, "_block")

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        wanted = np.zeros(0, np.int64)
        for batch in opened(part, arrow):
            texts = batch.column(text_col).to_pylist()
            for a, b in slices(texts, CHARS):
                wanted = pd.unique(np.concatenate([wanted, pd.unique(distinct(texts[a:b])[0].ravel())]))
        release()
        return pd.DataFrame({"_block": np.full(len(wanted), part["_block"].iloc[0], np.int32), "gram": wanted})

    def answer(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        full, bits_of, index, out = np.zeros(0, np.int64), np.zeros(0), None, []
        for batch in opened(part, arrow):
            texts, bits, chars = batch.column(text_col).to_pylist(), [], []
            for a, b in slices(texts, CHARS):
                once, at, owner = distinct(texts[a:b])
                new = once if index is None else once[index.get_indexer(once[:, ORDER - 1]) < 0]
                if len(new):
                    full, bits_of = np.concatenate([full, new[:, ORDER - 1]]), np.concatenate([bits_of, losses(new, known, floor)])
                    index = pd.Index(full)
                loss = bits_of[index.get_indexer(once[:, ORDER - 1])] if len(once) else bits_of
                bits.append(np.bincount(owner, loss[at], minlength=b - a) if len(at) else np.zeros(b - a))
                chars.append(np.bincount(owner, minlength=b - a))
            kept = {c: pd.Series(batch.column(c).to_pylist(), dtype=object) for c in names}  # exact, with nulls
            out.append(pd.DataFrame({**kept, "bits": np.concatenate(bits), "chars": np.concatenate(chars)}))
        release()
        return pd.concat(out) if out else pd.DataFrame({**{c: [] for c in names}, "bits": [], "chars": []})

    asked = base.groupBy("_block").applyInPandas(ask, "_block int, gram long")
    answers = asked.join(table, "gram").select("_block", "gram", "p", "back")
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("bits", T.DoubleType()), T.StructField("chars", T.LongType())])
    return base.groupBy("_block").cogroup(answers.groupBy("_block")).applyInPandas(answer, schema)


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled as good and not as toxic."""
    good = labels.groupBy(id_col).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where(F.col(id_col).isNotNull() & (F.col("q") == 1) & (F.col("t") == 0)).select(id_col)


def only_threshold(id_col: Column, held_out: int = HELD_OUT) -> Column:
    """Whether a trusted document is held out of the counts."""
    return F.pmod(F.xxhash64(F.lit("held out"), id_col), F.lit(held_out)) == 0


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", prior: int = PRIOR, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST, held_out: int = HELD_OUT, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, language, keep columns, perplexity, score, threshold and kept of every row of docs. trusted: distinct ids, of which one in held_out (by a hash) only sets the threshold."""
    docs = docs.select(F.col(id_col), F.col(lang_col), F.col(text_col), *keep)
    trusted = cut(trusted.select(F.col(id_col), only_threshold(F.col(id_col), held_out).alias("_held")))
    few = trusted.where("_held").isEmpty()
    learned = trusted if few else trusted.where("NOT _held")
    table, floor = kneser_ney(count(joined(docs, learned, id_col, "left_semi"), text_col))
    scored = cut(score(docs, table, floor, id_col=id_col, text_col=text_col, keep=(lang_col, *keep)))
    known = joined(scored.where("chars > 0"), trusted if few else trusted.where("_held"), id_col, "left_semi")
    mean = F.sum("bits") / F.sum("chars")
    means = cut(known.groupBy(F.col(lang_col).alias("_lang")).agg(mean.alias("_mean")))
    overall = known.agg(mean.alias("m")).first()["m"]
    smoothed = F.when(F.col("chars") > 0, (F.col("bits") + prior * F.col("_mean")) / (F.col("chars") + prior))
    with_mean = lambda rows: rows.join(means, rows[lang_col].eqNullSafe(means["_lang"]), "left").drop("_lang").fillna({"_mean": overall or 0.0}).withColumn("score", smoothed)
    known = with_mean(known)
    own = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.when(F.count("*") >= least, F.percentile_approx("score", quantile, 100_000)).alias("_own"))
    common = known.agg(F.percentile_approx(F.col("score") - F.col("_mean"), quantile, 100_000)).first()[0]
    rows = with_mean(scored)
    rows = rows.join(own, rows[lang_col].eqNullSafe(own["_lang"]), "left")
    threshold = slack * F.coalesce("_own", F.col("_mean") + F.lit(common).cast("double"))
    kept = (F.col("chars") > 0) & (threshold.isNull() | (F.col("score") <= threshold))
    return rows.select(id_col, lang_col, *keep, F.when(F.col("chars") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("chars"))).alias("perplexity"), "score", threshold.alias("threshold"), kept.alias("kept"))


def joined(docs: DataFrame, ids: DataFrame, id_col: str, how: str, most_rows: int = 500_000) -> DataFrame:
    """Semi or anti join by id, null ids alike. The ids are broadcast while there are at most so many (130 bytes each as measured, so 65 MB), and both sides shuffled beyond."""
    other = ids.select(F.col(id_col).alias("_id"))
    return docs.join(F.broadcast(other) if ids.count() <= most_rows else other, docs[id_col].eqNullSafe(other["_id"]), how)
