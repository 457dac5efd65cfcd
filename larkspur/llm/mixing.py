"""Mixing sources to target weights with a time-varying curriculum.

Every source has a share of all words and a schedule: a piecewise linear density over training
progress. The integral of the density is the share of the source's words that training has asked for
by then; its inverse turns a word's place in the source's stream into a training position. The stream
repeats the source's documents in the order of a hash until its target is reached, and the documents
are sorted by position over a range partitioning.

Scale: a stream is cut into buckets of a bounded number of rows by that same hash. Running sums go
over the buckets' sums, and then over the rows of one bucket, so that a source of any size is spread
over many tasks; the hash is of id and size, so that rows without an id are spread as well. The only table of a row per source is that of the targets.

Edge cases: a null source is a source of its own (last in order); null and empty texts have size 0
and are never taken; rows that repeat are separate rows; documents of a source without words have
target 0; an empty table gives an empty result; input columns named as a result column are replaced, those
named with an underscore ahead are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, plain

#: Density of a source's demand at progress 0, 1/2 and 1, by the class of its weight.
CURRICULUM = ((1.5, 1.0, 0.5), (0.75, 1.0, 1.25), (0.5, 1.0, 1.5))
MADE = ("size", "source_size", "target", "taken", "passes", "first_position")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Target of each source: shares by weight, held to cap times its size, the excess shared again by weight.

    The fixed point of that resharing is a common level: every source gets level * weight or its cap,
    whichever is less. With the sources in order of cap / weight, the level that holds if all before one are
    capped comes from running sums; it is right for the first source that does not exceed its cap by it, and
    falls from there on, so that it is the greatest of those that fit.
    """
    order = W.orderBy(F.col("_null"), F.col("_source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_class") + 1)
    s = sizes.withColumn("_class", ((F.row_number().over(order) - 1) % len(weights)).cast("int")).withColumn("_weight", weight)
    s = s.withColumns({"_cap": cap * F.col("source_size"), "_ratio": cap * F.col("source_size") / F.col("_weight")})
    below = W.orderBy("_ratio", "_null", "_source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    zero = F.lit(0.0)
    s = s.withColumn(
        "_level",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(below), zero)) / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(below), zero)),
    )
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    return s.select("_null", "_source", "_class", "source_size", F.least("_cap", F.coalesce(F.col("_level"), zero) * F.col("_weight")).alias("target"))


def position(share: Column, knots: tuple[float, ...]) -> Column:
    """Progress at which the integral of the density through knots (evenly spaced) is that share of the whole."""
    step = 1.0 / (len(knots) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, parts = sum(areas), 0.0, []
    for k, area in enumerate(areas):
        rest = share * F.lit(whole) - F.lit(before)
        slope = (knots[k + 1] - knots[k]) / step
        x = 2.0 * rest / (knots[k] + F.sqrt(F.greatest(F.lit(0.0), F.lit(knots[k] * knots[k]) + F.lit(2.0 * slope) * rest)))
        parts.append((before + area, F.when(rest <= 0, F.lit(k * step)).otherwise(F.least(F.lit((k + 1) * step), F.lit(k * step) + x))))
        before += area
    out = parts[-1][1]
    for upto, x in reversed(parts[:-1]):
        out = F.when(share * F.lit(whole) < upto, x).otherwise(out)
    return out


def assign(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    curriculum: tuple[tuple[float, ...], ...] = CURRICULUM,
    seed: str = "mix",
    rows_each: int = 4096,
) -> DataFrame:
    """All rows of docs with their size, their source's size and target, the words taken and the passes.

    passes: a struct (pass, words, position) for each time that the document is taken. The last pass
    of a source ends inside one document, of which only the words that are missing are taken.
    """
    size = n_words(F.col(text_col)) if size is None else size
    docs = plain(docs)
    base = docs.withColumn("_size", size.cast("long")).drop(*(c for c in MADE if c not in (id_col, source_col, text_col)))
    buckets = -(-base.count() // rows_each) or 1
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_size").cast("string")))
    part = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(4294967296)
    base = base.withColumns({"_h": hashed, "_null": F.col(source_col).isNull(), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})
    base = base.withColumn("_bucket", F.floor(part).cast("int"))
    sums = cut(base.groupBy("_null", "_source", "_bucket").agg(F.sum("_size").alias("_sum")))
    target = targets(sums.groupBy("_null", "_source").agg(F.sum("_sum").alias("source_size")), weights, cap)
    before = W.partitionBy("_null", "_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(target, ["_null", "_source"])
    key = ["_null", "_source", "_bucket"]
    inside = W.partitionBy(*key).orderBy("_h", id_col, "_size").rowsBetween(W.unboundedPreceding, 0)
    out = base.join(starts, key).withColumn("_start", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))
    goal = F.round("target").cast("long")
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("_size"), goal - k * F.col("source_size") - F.col("_start")))
    at = lambda k: (k * F.col("source_size") + F.col("_start")) / F.col("target")

    def place(k: int) -> Column:
        out = position(at(k), curriculum[-1])
        for c in range(len(curriculum) - 2, -1, -1):
            out = F.when(F.col("_class") == c, position(at(k), curriculum[c])).otherwise(out)
        return out

    most = -(-cap // 1)
    passes = [F.struct(F.lit(k).alias("pass"), words(k).alias("words"), F.when(F.col("target") > 0, place(k)).alias("position")) for k in range(int(most))]
    out = out.withColumn("passes", F.filter(F.array(*passes), lambda x: x["words"] > 0))
    own = [c for c in base.columns if c[0] != "_"]
    return out.select(
        *own,
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]).alias("taken"),
        F.try_element_at("passes", F.lit(1))["position"].alias("first_position"),
        "passes",
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The training order: docs' own columns, a row for each pass, with pass, words and position, sorted by position."""
    rows = assign(docs, **how)
    own = [c for c in docs.columns if c in rows.columns and c not in ("mix_pass", "mix_words", "mix_position")]
    taken = rows.select(*own, F.explode("passes").alias("_p")).select(*own, F.col("_p.pass").alias("mix_pass"), F.col("_p.words").alias("mix_words"), F.col("_p.position").alias("mix_position"))
    return taken.orderBy("mix_position")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, source IS NULL AS nul, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', size)) AS h FROM documents),
s AS (SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
c AS (SELECT *, ((row_number() OVER (ORDER BY nul, src)) - 1) % 3 AS cls FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][cls + 1] AS weight FROM c),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, nul, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM r),
t AS (SELECT *, least(cap, coalesce((SELECT max(lev) FROM l WHERE lev <= ratio), 0) * weight) AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.cls, (sum(d.size) OVER (PARTITION BY d.nul, d.src ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start FROM d JOIN t ON d.nul = t.nul AND d.src = t.src)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - source_size - start)) + greatest(0, least(size, round(target)::BIGINT - 2 * source_size - start)))::BIGINT AS taken
FROM o
"""
