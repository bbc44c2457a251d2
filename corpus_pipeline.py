"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that its predecessor kept.  All but the last return the
columns of the documents table; the last returns the pieces of packed
sequences.

Nulls and edge cases: language ID drops documents whose text is null, empty or
without a letter; the other stages keep a null text.  Rows without doc_id and
rows that share one are told apart by a written row key.  Very long texts are
worked on whole.  Columns of any other name pass through unchanged; those that
begin with two underscores are for the stages' own use.  An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.decontamination import contaminated
from ebbtide.llm.language import identify
from ebbtide.llm.lines import drop_repeated_lines
from ebbtide.llm.membership import ROW, numbered, without
from ebbtide.llm.minhash import near_duplicates
from ebbtide.llm.packing import pack_documents, tokenizer_files
from ebbtide.llm.textkit import small_batches
from ebbtide.plans.scratch import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a known language; those without any letter go too, and so do null texts."""
    judged = identify(docs, names=("__lang", "__score", "__rejected"))
    return judged.filter("not __rejected").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one of which nothing is left goes.

    Repeated rows are one document and are treated alike; a null text stays.
    """
    cleaned = drop_repeated_lines(docs, names=("__lines", "__deleted")).filter("__deleted = 0 or text <> ''")
    length = F.when(F.col("__deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest id, rows without one last, ties by row key; a text without words is in no group."""
    rows = numbered(docs)
    groups = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    groups = materialize(groups.join(rows.select(ROW, "doc_id"), ROW), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"))
    dropped = materialize(groups.select(ROW).join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti"), "dropped")
    return without(rows, dropped, ROW).drop(ROW)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, whether or not either has an id; null and empty texts contain none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = numbered(benchmark.select("text")).select(F.col(ROW).alias("item_id"), "text")
    rows = numbered(docs)
    pairs = contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), items)
    found = materialize(pairs.select(F.col("doc_id").alias(ROW)).distinct(), "found")
    return without(rows, found, ROW).drop(ROW)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences; a null text is the end token alone."""
    return pack_documents(docs, *tokenizer_files())


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark_items),
    ("best-fit packing", packed),
]

#: SQL can't express language ID and packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written as Parquet and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        with small_batches(spark):
            rows = materialize(stage(spark, rows, sf_dir), f"stage{number}")
    return rows
