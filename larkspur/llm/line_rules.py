"""Quality rules, lines first: bad lines are removed, then documents that lose too much are rejected.

Built from DataFrame functions only; no shuffle, one pass over the texts.

White space is what parts words (ASCII's), at a line's end too; only \\n ends a line, so that \\r stands at
the end of one. Edge cases: a null text counts as empty (no words, base_failed); repeated rows are judged each for
itself; an empty table gives an empty result; columns of the input that carry the name of a result
column are replaced by it, and those whose name begins with an underscore are dropped.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, words

#: Words in a window of the repetition measure.
WINDOW = 8
#: Phrases of boilerplate lines, matched without case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "subscribe to our newsletter",
    "click here",
    "enable javascript",
    "lorem ipsum",
    "licensed under",
    "spdx-license-identifier",
)
SEPARATORS = ("|", ">", "»", "•", "·", "/")
#: A terminal mark, closing marks and white space at the very end of a line.
TERMINAL = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*\z"""


def repeated_words(hashes: Column, windows: Column, ordered: Column) -> Column:
    """Number of words inside windows that occur more than once.

    ordered: (hash, position) of every window, sorted, so that equal windows stand together.
    Windows are compared by a 64-bit hash made from those of their eight words.
    """
    last = F.size(ordered) - 1
    twice = F.filter(
        ordered,
        lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(ordered, k + 1)["h"] == x["h"])),
    )
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("prev"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(x.alias("prev"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["prev"])).alias("n")),
        lambda acc: acc["n"],
    )


def line_passes(line: Column, *, title_words: int, notice_words: int, max_symbols_per_word: float, max_marks_per_word: float, max_separators: float) -> Column:
    """Whether a line (l, with its words w) is prose by the punctuation, navigation and boilerplate rules.

    Punctuation: a line of fewer than title_words words must end in a terminal mark, and exclamation
    and question marks may not outnumber max_marks_per_word a word. Navigation: words that are nothing
    but a separator (three or more) may not exceed their share of the words. Boilerplate: none of the
    phrases in a line of up to notice_words words, and not more than max_symbols_per_word symbols a word.
    """
    line, found, n = line["l"], line["w"], F.size(line["w"])
    count = lambda kept: F.length(F.regexp_replace(line, kept, ""))
    separators = F.size(F.filter(found, lambda w: w.isin(*SEPARATORS)))
    punctuated = (n >= title_words) | line.rlike(TERMINAL)
    shouting = count(r"[^!?]+") > n * max_marks_per_word
    navigation = line.rlike("[|>»•·/]") & (separators >= 3) & (separators > n * max_separators)
    notice = (n <= notice_words) & reduce(or_, (F.lower(line).contains(x) for x in BOILERPLATE))
    boilerplate = notice | (count(r"[^#*$%&|<>]+") > n * max_symbols_per_word)
    return punctuated & ~shouting & ~navigation & ~boilerplate


def apply_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_lost_percent: int = 65,
    title_words: int = 8,
    notice_words: int = 40,
    max_symbols_per_word: float = 0.5,
    max_marks_per_word: float = 0.5,
    max_separators: float = 0.2,
) -> DataFrame:
    """All rows and columns of docs, with the measures, clean_text, kept_chars, base_failed and kept."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "kept_chars", "line_chars", "kept")
    base = plain(docs).drop(*(c for c in made if c != text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rule = {"title_words": title_words, "notice_words": notice_words, "max_symbols_per_word": max_symbols_per_word, "max_marks_per_word": max_marks_per_word, "max_separators": max_separators}
    step = base.select(
        "*",
        F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("l"), words(x).alias("w"))), lambda x: F.size(x["w"]) > 0).alias("_read"),
    )
    step = step.select("*", F.flatten("_read.w").alias("_words"), F.col("_read.l").alias("_lines"), F.filter("_read", lambda x: line_passes(x, **rule))["l"].alias("_good"))
    step = step.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    for span in (1, 2, 4):  # hashes of 2, 4, then 8 words, each from two of half the length
        step = step.withColumn("_hash", F.transform("_hash", lambda x, i: F.xxhash64(x, F.get(F.col("_hash"), i + span))))
    step = step.withColumn("_windows", F.when(F.size("_hash") >= WINDOW, F.slice("_hash", 1, F.size("_hash") - (WINDOW - 1))))
    unlike = F.coalesce(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(True))
    step = step.select("*", F.when(~unlike, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_ordered"))
    long = lambda c: c.cast("long")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    step = step.select(
        *base.columns,
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.concat_ws("", "_words"))).alias("word_chars"),
        long(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.col("_ordered").isNull(), F.lit(0).cast("long")).otherwise(repeated_words(F.col("_hash"), F.col("_windows"), F.col("_ordered"))).alias("n_repeat_words"),
        F.concat_ws("\n", "_good").alias("clean_text"),
        total("_good").alias("kept_chars"),
        total("_lines").alias("line_chars"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    enough = 100 * F.col("kept_chars") >= (100 - max_lost_percent) * F.col("line_chars")
    return step.withColumns({"base_failed": failed, "kept": ~failed & enough})


#: The same by DuckDB, for the check at small scale.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, range(0, 8) r(o) GROUP BY rid),
lines AS (
  SELECT rid, l, length(l) AS n_chars, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w, len(w) AS n,
    length(regexp_replace(l, '[^!?]+', '', 'g')) AS marks, length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) AS symbols,
    len(list_filter(w, lambda x: x IN ('|', '>', '»', '•', '·', '/'))) AS seps
  FROM (SELECT rid, unnest(ls) AS l FROM w)),
judged AS (
  SELECT rid, sum(n_chars) AS line_chars, coalesce(sum(n_chars) FILTER (
    (n >= 8 OR regexp_matches(l, '[.!?…。！？:;]["''”’»)\]]*[\x20\x09-\x0D]*\z')) AND marks <= n * 0.5 AND NOT (seps >= 3 AND seps > n * 0.2)
    AND symbols <= n * 0.5 AND NOT (n <= 40 AND regexp_matches(lower(l), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|subscribe to our newsletter|click here|enable javascript|lorem ipsum|licensed under|spdx-license-identifier'))), 0) AS kept_chars
  FROM lines GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars, coalesce(line_chars, 0) AS line_chars
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN judged USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * kept_chars >= 35 * line_chars AS kept
FROM m
"""
