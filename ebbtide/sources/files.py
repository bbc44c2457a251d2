"""Readers and writers of the study's files; every schema is explicit, nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A CSV with a header, every column as text, so that leading zeros survive."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_typed_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A CSV with a header and a given schema; bad values are null."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def read_parquet_set(spark: SparkSession, path: str | list[str], ragged: bool = False) -> DataFrame:
    """All files of a folder; with ``ragged``, columns that a file lacks are null."""
    return spark.read.option("mergeSchema", ragged).parquet(*([path] if isinstance(path, str) else path))


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Rows of frames with different columns; missing ones are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def with_file_part(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Add what ``pattern``'s first group finds in each row's file name."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def normalise_header(df: DataFrame) -> DataFrame:
    """Column names stripped and upper-cased, all text stripped."""
    named = df.toDF(*(c.strip().upper() for c in df.columns))
    return named.select(*(F.trim(c).alias(c) if kind == "string" else F.col(c) for c, kind in named.dtypes))


def positional(lines: DataFrame, sep: str = "|") -> DataFrame:
    """Headerless lines as one array of fields each."""
    return lines.select(F.split("value", re.escape(sep), -1).alias("fields"))


def field(position: int | Column) -> Column:
    """A field by position from 1; null beyond the line's end."""
    return F.try_element_at("fields", F.lit(position) if isinstance(position, int) else position)


def looked_up(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """Values whose places a lookup table (variable, start, number) gives: field start + number - 1 of each record."""
    place = (F.col("start") + F.col("number") - 1).cast("int")
    return records.join(lookup, "sequence").withColumn("value", F.try_element_at("fields", place).try_cast("double")).drop("fields", "start", "number", "sequence")


def write_months(df: DataFrame, path: str, kind: str = "parquet", month: str = "month") -> None:
    """Write by month; months that are present are replaced, others stay."""
    writer = df.write.partitionBy(month).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_json_records(df: DataFrame, path: str, month: str = "month") -> None:
    """One JSON line per row in a folder per month; months that are present are replaced, others stay."""
    df.withColumn(f"{month}_of", F.col(month)).write.partitionBy(month).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).json(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, month: str = "month") -> DataFrame:
    """The records of ``write_json_records`` with a given schema; a month keeps its leading zeros."""
    inside = T.StructType([T.StructField(f"{month}_of", f.dataType) if f.name == month else f for f in schema.fields])
    return spark.read.schema(inside).json(f"{path}/{month}=*").withColumnRenamed(f"{month}_of", month).select(*schema.names)


def new_months(df: DataFrame, done: DataFrame, month: str = "month") -> DataFrame:
    """Rows of months that aren't done yet."""
    return df.join(done.select(month).distinct(), month, "left_anti")


def thousands(column: Column) -> Column:
    """A number written with thousands separators; blank is null."""
    return F.replace(F.trim(column), F.lit(","), F.lit("")).try_cast("long")
