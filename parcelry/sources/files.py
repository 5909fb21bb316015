"""Readers of pipe and comma files, text lines and Parquet, and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def all_strings(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_register(spark: SparkSession, path: str | list[str], names: Sequence[str], least_fields: int | None = None) -> DataFrame:
    """A headerless pipe file as strings under `names`, read by position, whatever each line's width: short lines end
    in nulls, further fields are in `extra` (array). Lines under least_fields are dropped. `NA` stays text."""
    parts = spark.read.text(path).select(F.split("value", r"\|", -1).alias("p"))
    if least_fields:
        parts = parts.filter(F.size("p") >= least_fields)
    return parts.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)], F.slice("p", len(names) + 1, 10_000).alias("extra"))


def reconciled_names(names: Sequence[str], width: int) -> list[str]:
    """Names for a file of that width: cut short, or continued by extra_1, extra_2, ..."""
    return [*names[:width], *[f"extra_{i}" for i in range(1, width - len(names) + 1)]]


def read_positional(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A headerless pipe file whose width is that of its first line, as strings under reconciled names."""
    first = spark.read.text(path).first()
    width = len(first[0].split("|")) if first else len(names)
    return spark.read.schema(all_strings(reconciled_names(names, width))).option("sep", "|").option("header", False).csv(path)


def read_with_header(spark: SparkSession, path: str, sep: str = ",", strip: bool = True, null_value: str | None = None) -> DataFrame:
    """A file with a header, all strings, names stripped. With null_value, that text is null."""
    r = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    df = (r.option("nullValue", null_value) if null_value is not None else r).csv(path)
    return df.toDF(*[c.strip() for c in df.columns]) if strip else df


def read_key_values(spark: SparkSession, path: str | list[str], key_at: int, value_at: int, least_fields: int = 14) -> DataFrame:
    """(key, value, line_no) of pipe files with a header, each its own: lines with enough fields and both values. line_no
    is a struct in the order of file name, block and line, for keep_last. The reader of CSV leaves out the first line of
    each file, whatever it says; a line is one field to it."""
    text = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("enforceSchema", True).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = text.select(place.alias("line_no"), F.split("value", r"\|", -1).alias("p"))
    body = rows.filter(F.size("p") >= least_fields)
    out = body.select(F.trim(F.col("p")[key_at]).alias("key"), F.trim(F.col("p")[value_at]).alias("value"), "line_no")
    return out.filter("key <> '' and value <> ''")


def read_present(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The columns that a Parquet source has, of those asked for, with the file each row is from."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns], F.col("_metadata.file_name").alias("source_file"))


def write_loader_csv(df: DataFrame, path: str) -> None:
    """CSV for a loader: null is empty, booleans and numbers are text."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_qa(df: DataFrame, bad: str, path: str) -> None:
    """The rows that satisfy a condition, as a CSV side file."""
    df.filter(bad).write.mode("overwrite").option("header", True).csv(path)


def with_provenance(df: DataFrame, **values: object) -> DataFrame:
    """Constant columns: year, notice, run id, and so on."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
