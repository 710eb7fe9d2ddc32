"""A training-data pipeline over the documents table, each stage one of the llm operators.

Each stage works on all rows that the stage before it kept and takes (spark, docs, sf_dir). All but the last return the
columns of documents:

1. quality: rows whose text the compression classifier scores under 0.5 go;
2. near_duplicates: of each group of near-duplicate documents the one with the least doc_id stays;
3. decontamination: stretches of benchmark text go, and documents of which more than half is such text;
4. personal_data: personal data is replaced by its kind;
5. pieces: texts are encoded; returns doc_id, lang, source, n_pieces, pieces and lossless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoryloom.llm import decontaminate, neardup, personal, pieces, quality
from memoryloom.llm.scratch import drop, stage

#: No SQL: a trained classifier decides what the later stages see.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more, unchanged. Null and empty texts are scored as empty ones; repeated rows go or stay
    together; without labelled text of both sorts, and for empty tables, all rows stay. Other columns aren't looked at."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the least doc_id, unchanged.

    Rows without doc_id, and documents without words, are in no group and stay. Rows of one doc_id are one document:
    they go or stay together, but for rows that repeat both doc_id and text, of which the one whose columns hash least
    stays. An empty table gives an empty one; other columns may have any names.
    """
    found = neardup.near_duplicates(docs)
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_key")).distinct()
    packed = docs.select(F.col("doc_id").cast("long").alias("_key"), F.struct("*").alias("_row"))
    rest = packed.join(gone, "_key", "left_anti")
    twice = stage(docs.groupBy(F.col("doc_id").cast("long").alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1 and _key is not null").select("_key"), "repeated-ids")
    if not twice.limit(1).count():
        drop(twice)
        return rest.select("_row.*")
    again = rest.join(twice, "_key", "left_semi").withColumns({"_a": F.xxhash64("_row.text"), "_b": F.xxhash64(F.lit(1), F.col("_row.text")), "_of": F.xxhash64("_row")})
    one = again.groupBy("_key", "_a", "_b").agg(F.min_by("_row", "_of").alias("_row"))
    return rest.join(twice, "_key", "left_anti").select("_row.*").union(one.select("_row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the stretches of benchmark text in them, and without rows of which more than half is such text.

    Null and empty texts have no such text and stay; repeated rows are treated alike; an empty table or benchmark changes
    nothing. Only the text changes.
    """
    return decontaminate.remove_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every span of personal data in their texts replaced by its kind. Null texts and texts without spans are
    unchanged; repeated rows are treated alike; an empty table gives an empty one. Only the text changes."""
    return personal.redact(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, pieces and lossless for every row. Null and empty texts have no pieces; rows that
    repeat doc_id and text get the same ones; an empty table gives an empty one."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over documents, each staged as Parquet and read again by the next.

    Null, empty, very long and repeated texts, and columns of any names beside those of documents, fare as each stage says;
    an empty table of documents gives an empty result, an empty benchmark or table of labels lets its stage keep all.
    """

    def step(docs: DataFrame, function) -> DataFrame:
        out = stage(function(spark, docs, sf_dir), "pipeline")
        drop(docs)
        return out

    return reduce(step, (f for _, f in STAGES), spark.read.parquet(f"{sf_dir}/documents.parquet"))
