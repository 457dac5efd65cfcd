"""Reading sources into DataFrames."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, *, base: str | None = None, merge: bool = False, file_column: str | None = None) -> DataFrame:
    """Parquet files, with the partition columns of folders below base, columns aligned by name, and each row's file."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    df = (reader.option("basePath", base) if base else reader).parquet(path)
    return df.withColumn(file_column, F.col("_metadata.file_path")) if file_column else df


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines (plain or compressed) by a declared schema, so that no pass infers one."""
    return spark.read.schema(schema).json(path)


def allow_encoding(spark: SparkSession, encoding: str) -> None:
    """Let the session read texts in any of Java's encodings, where it is not one that Spark always takes."""
    if encoding.upper() not in ("UTF-8", "UTF-16", "UTF-32", "US-ASCII", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def csv_table(spark: SparkSession, path: str, schema: str | None = None, *, encoding: str = "UTF-8", delimiter: str = ",", header: bool = True, skip: int = 0) -> DataFrame:
    """CSV files by a declared schema, or as text columns. skip: leading lines that are notes, left out of every file."""
    options = {"encoding": encoding, "sep": delimiter, "header": str(header).lower()}
    allow_encoding(spark, encoding)
    if not skip:
        reader = spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).csv(path)
    lines = spark.read.option("encoding", encoding).text(path, wholetext=True)  # each an upload, so that one fits a task
    kept = lines.select(F.explode(F.slice(F.split("value", "\r?\n"), skip + (2 if header else 1), 10**9)).alias("line")).where("line != ''")
    if schema is None:
        raise ValueError("a table with notes ahead needs its schema")
    return kept.select(F.from_csv("line", schema, {"sep": delimiter}).alias("r")).select("r.*")


def csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """Good rows by schema, and rejects (line text, column, reason). Each bad row shows the first column that fails."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_line", T.StringType())])
    raw = spark.read.options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_line", **options).schema(text).csv(path)
    reason = F.lit(None).cast("string")
    for f in reversed(schema.fields):
        bad = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        reason = F.when(bad, F.lit(f"{f.name}: not a {f.dataType.simpleString()}")).otherwise(reason)
    reason = F.when(F.col("_line").isNotNull(), "wrong number of columns").otherwise(reason)
    judged = raw.withColumn("_reason", reason)
    good = judged.where("_reason IS NULL").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
    whole = F.coalesce("_line", F.concat_ws(",", *(F.coalesce(f.name, F.lit("")) for f in schema.fields)))
    return good, judged.where("_reason IS NOT NULL").select(whole.alias("line"), F.col("_reason").alias("reason"))


def sniff(sample: bytes, rows: int = 20) -> dict:
    """Encoding, delimiter, header and first rows of the beginning of a CSV file: a preview."""
    for encoding in ("utf-8-sig", "gb18030"):
        try:  # the sample may end within a character
            text = codecs.getincrementaldecoder(encoding)().decode(sample, final=False)
            break
        except UnicodeDecodeError:
            continue
    else:
        encoding, text = "latin-1", sample.decode("latin-1")
    lines = text.splitlines()
    delimiter = max(",;\t|", key=lambda d: (min((x.count(d) for x in lines[1:6] or lines), default=0), -",;\t|".index(d)))
    width = max((x.count(delimiter) for x in lines), default=0)
    skip = next((k for k, x in enumerate(lines) if x.count(delimiter) == width), 0)
    found = list(csv.reader(io.StringIO("\n".join(lines[skip : skip + rows + 1])), delimiter=delimiter))
    header = bool(found) and all(x and not x.replace(".", "").replace("-", "").isdigit() for x in found[0])
    return {"encoding": {"utf-8-sig": "UTF-8", "gb18030": "GB18030"}.get(encoding, encoding), "delimiter": delimiter, "header": header, "skip": skip, "rows": found[header:][:rows]}


def jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 8, query: str | None = None, **options) -> DataFrame:
    """A database table, read in parallel over ranges of a column, or a query that the database itself runs."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def paged(spark: SparkSession, fetch: Callable[[int, int, int], list[dict]], schema: str, *, lower: int, upper: int, parts: int = 8, size: int = 1000) -> DataFrame:
    """A paged service, read by key ranges in parallel. fetch(after, until, size) gives up to size rows with id in (after, until], ascending."""
    step = -(-(upper - lower) // parts)
    ranges = spark.range(parts).select((F.col("id") * step + lower).alias("after"), F.least(F.lit(upper), (F.col("id") + 1) * step + lower).alias("until")).repartition(parts, "after")

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for after, until in zip(batch["after"], batch["until"], strict=True):
                while rows := fetch(int(after), int(until), size):
                    yield pd.DataFrame(rows)
                    after = rows[-1]["id"]

    return ranges.mapInPandas(pull, schema)


def prefix_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """(table, path) of a store's folder: each folder below it, and each file at its top, is a table. No rows are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return {s.getPath().getName().split(".")[0]: str(s.getPath()) for s in found if not s.getPath().getName().startswith(("_", "."))}


def files_of(df: DataFrame) -> DataFrame:
    """(path, bytes, rows) of the files behind a DataFrame."""
    return df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))


def excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of a workbook, read on the driver: for small uploads, and only where openpyxl is installed."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path; arrays stay."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}{sep}{x}") for x in f.dataType.names]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(columns)
    return df


def variant_fields(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """df with fields of a JSON column: each name with its path and type."""
    parsed = F.parse_json(column)
    return df.select("*", *(F.try_variant_get(parsed, path, kind).alias(name) for name, (path, kind) in fields.items()))
