"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugefleet.llm._tables import read, staged
from gaugefleet.llm.decontaminate import find_contamination
from gaugefleet.llm.line_dedup import drop_duplicate_lines
from gaugefleet.llm.neardup import near_duplicates
from gaugefleet.llm.pack import pack
from gaugefleet.llm.pu_quality import score_quality, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_HAS_WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier accepts."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents that only had such lines."""
    out = drop_duplicate_lines(docs, keep=COLUMNS)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(_HAS_WORD))
    return _measured(out, F.col("n_dropped") > 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, 80 %).

    Rows that are equal in id and text are one document; rows of one id with other texts all stay if
    the id does. Of rows without id and with equal texts one stays, unless a named document has that text.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    text = [F.sha2(F.coalesce("text", F.lit("")), 256).alias("__sha")]
    kept = staged(kept).hint("merge")  # one plan at every size: the ids grow with the documents
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*COLUMNS)
    many = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    once = named.join(many, "doc_id", "left_anti")
    again = named.join(many, "doc_id", "left_semi").select("*", *text).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
    nameless = docs.where("doc_id is null").select(*COLUMNS, *text).dropDuplicates(["__sha"])
    taken = docs.where("doc_id is not null").select(*text).distinct()
    nameless = staged(nameless).join(taken, "__sha", "left_anti")
    return once.union(again).union(nameless.select(*COLUMNS)).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out benchmark passages, and drop documents that had nothing else."""
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"), keep=tuple(c for c in COLUMNS if c != "text"), clean=True)
    found = found.withColumnRenamed("clean_text", "text").where((F.col("n_hit") == 0) | F.col("text").rlike(_HAS_WORD))
    return _measured(found, F.col("n_hit") > 0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences."""
    return pack(docs)


def _measured(docs: DataFrame, changed: Column) -> DataFrame:
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmark_free), ("packing", packed)]

#: Tokens, learned scores and graph components are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
