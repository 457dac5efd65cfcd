"""The corpus pipeline: documents in, training tokens out.

Stages are written and read again one after another. Each takes (spark, docs, sf_dir) and works on all
rows that the one before has kept; all but the last return the columns of documents, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, langid, mixing, near_copies, quality_lm
from larkspur.llm.common import cut, n_words, shared_dir

#: Least score of a language prediction: below, no language is much better than the others.
MIN_LANGUAGE_SCORE = 0.3
#: The last stage takes the whole text of each document in the mix.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The columns that the stages read; any others are only carried along.
READ = ("doc_id", "text", "lang", "source")


def aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its other columns under names that no step uses, and what gives them theirs back."""
    names = {c: c if c in READ else f"carried{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), lambda out: out.select(*(F.col(n).alias(c) for c, n in names.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, which becomes their lang; undetermined ones go."""
    docs, back = aside(docs)
    found = langid.identify(docs).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return back(found.withColumn("lang", F.col("lang_pred")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model of the trusted ones finds likely enough for their language; each row by itself."""
    docs, back = aside(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text", "lang"))
    judged = quality_lm.classify(docs.select("doc_id", "lang", "text", "_row"), quality_lm.trusted_ids(labels), keep=("_row",))
    refused = cut(judged.where(~F.col("kept")).select("_row").distinct())
    return back(quality_lm.joined(docs, refused, "_row", "left_anti"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of copies: 5-word shingles alike by 0.8 or more, checked exactly."""
    docs, back = aside(docs)
    return back(near_copies.deduplicate(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: documents as often as the mix takes them, sorted by their training position."""
    docs, back = aside(docs)
    return back(mixing.mix(docs.withColumn("words", n_words(F.col("text"))), size=F.col("words")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs.select(*READ), VOCABULARY).drop("text")


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
#: Language ID and the language model have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to a folder of its own in the shared one and read again by the next.

    A folder goes as soon as the stage behind it is written. The last one stays: the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                remove(spark, f"{at}/{k - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
