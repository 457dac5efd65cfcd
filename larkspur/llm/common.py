"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.checkpoints import cut, shared_dir

__all__ = ["WORD", "cut", "n_words", "plain", "read", "remove", "shared_dir", "words"]

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(docs: DataFrame) -> DataFrame:
    """docs without the columns whose names begin with an underscore, as those of an operator's own steps do."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if not c.startswith("_")))


def remove(spark: SparkSession, folder: str) -> None:
    """A folder of the shared one that no one reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
