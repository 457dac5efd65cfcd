"""Audit of how sources of one language diverge: between each other, and by which terms from the language.

Every kept term of a language has a sparse vector of counts by source. Terms with the same vector add the same to
every figure, so that the vectors are made distinct first: a pair of sources is evaluated once for each distinct
vector, times the number of its terms. Vectors are sparse, and so is the evaluation: what a pair gets from terms that
neither or one of the two holds depends on one count alone, and is summed over the distinct counts of a source; each
vector then adds what its own pairs of sources differ from that. The original terms are ranked in the end.

All arithmetic is of whole numbers: shares are thousand-millionths from decimals, differences fit a long.

Edge cases: null text, language or source count as ''; rows that repeat are documents of their own; a language
without a kept term gives zeros for its pairs and no terms; a group without terms is a group; a language with one
source has no pairs; terms of equal value rank by their UTF-8 bytes; an empty table gives an empty result; only the
three named columns are read, so that no other name clashes.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: A term is a run of ASCII letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term needs, and terms that are reported for a group.
MIN_DOCS, TOP = 10, 10


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term: its occurrences and documents. Both are counted ahead of the shuffle."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    terms = F.regexp_extract_all(F.translate(text(text_col), ascii_uppercase, ascii_lowercase), F.lit(TERM), F.lit(0))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), terms.alias("terms"))
    both = F.array(F.struct(F.col("terms").alias("of"), F.lit(0).alias("d")), F.struct(F.array_distinct("terms").alias("of"), F.lit(1).alias("d")))
    rows = rows.select("lang", "source", F.inline(both)).select("lang", "source", "d", F.explode("of").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("d")).alias("n"), F.sum("d").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total and vector: (source, n) in order of the sources, of which a language's pairs are listed and so bounded."""
    vector = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector")
    return counts.groupBy("lang", "term").agg(vector, F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")


def share(count: Column | str, size: str) -> Column:
    """Thousand-millionths of a smoothed count: 1 + floor(10^9 (count + 2) / size), size with 2 for each term."""
    count = F.col(count) if isinstance(count, str) else count
    over = (count.cast("decimal(20,0)") + F.lit(2)) * F.lit(1_000_000_000)
    return 1 + F.call_function("div", over, F.col(size).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def sizes(docs: DataFrame, kept: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for every (lang, source): V, and count plus 2 V of the group and of its language; null sizes where V is 0."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    of_group = kept.select("lang", F.inline("vector")).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    out = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    size = lambda n: F.coalesce(F.col(n), F.lit(0)) + 2 * F.col("v")
    return out.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), size("group_n").alias("size"), size("lang_n").alias("lang_size"))


def pair_values(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: for each ordered pair of a language's sources the sum over all kept terms."""
    none = F.lit(0)
    own = groups.select("lang", "source", "v", "size")
    other = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"))
    absent = apart(share(none, "size"), share(none, "item_size"))
    pairs = own.join(other, "lang").where(F.col("source") != F.col("item"))
    base = pairs.select("lang", "source", "item", F.coalesce(F.when(F.col("v") > 0, F.col("v") * absent), none).alias("value"))
    #: What a term that one of the two has, so often, differs by from one that neither has.
    entries = vectors.select("lang", "terms", F.inline("vector")).groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms"))
    one = entries.join(own, ["lang", "source"]).join(other, "lang").where(F.col("source") != F.col("item"))
    one = one.select("lang", "source", "item", (F.col("terms") * (apart(share("n", "size"), share(none, "item_size")) - absent)).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    #: And what a term of both differs by from those.
    meet = vectors.select("lang", "terms", "vector", F.inline("vector").alias("source", "n"))
    meet = meet.select("lang", "terms", "source", "n", F.inline(F.filter("vector", lambda x: x["source"] > F.col("source"))).alias("item", "item_n"))
    meet = meet.groupBy("lang", "source", "n", "item", "item_n").agg(F.sum("terms").alias("terms"))
    meet = meet.join(own, ["lang", "source"]).join(other, ["lang", "item"])
    p, q, p0, q0 = share("n", "size"), share("item_n", "item_size"), share(none, "size"), share(none, "item_size")
    two = meet.select("lang", "source", "item", (F.col("terms") * (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0))).alias("value"))
    two = two.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = base.unionByName(one).unionByName(turned(one)).unionByName(two).unionByName(turned(two))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: terms of a group whose share is above that of its language."""
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.inline("vector")).join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "item", share("n", "size").alias("p"), share("total", "lang_size").alias("q")).where(F.col("p") > F.col("q"))
    return rows.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """rank by value, the greatest first; with top, only so many, which Spark finds before it brings a group together."""
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(order))
    return (out if top is None else out.where(F.col("rank") <= top)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Per group of language and source: how far each other source is (part pair), and the terms that set it apart (part term)."""
    names = {"lang_col": lang_col, "source_col": source_col}
    kept = cut(kept_terms(term_counts(docs, text_col=text_col, **names), min_docs))
    groups = cut(sizes(docs, kept, **names))
    vectors = cut(kept.groupBy("lang", "vector").agg(F.count("*").alias("terms")))
    return ranked(pair_values(vectors, groups), "pair").unionByName(ranked(term_values(kept, groups), "term", top))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT r, lang, source, term, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING count(*) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, term, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT lang, source, sum(n) AS n FROM s GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0)::HUGEINT AS n, (1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 2)) // (coalesce(z.n, 0) + 2 * l.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v))::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term LEFT JOIN z ON z.lang = g.lang AND z.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM e WHERE n > 0 AND p > q),
a AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' AS part FROM terms)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM a) WHERE part = 'pair' OR rank <= 10
"""
