"""Retrieval evaluation: ground-truth relevance, hit labels, recall, precision, hit@1 and MRR by difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import diff_files, source_path, text_of

TIERS = ("easy", "medium", "hard")


def tier(files: Column) -> Column:
    """How hard a task is to localise, by the number of files in its patch."""
    return F.when(F.size(files) <= 2, "easy").when(F.size(files) <= 5, "medium").otherwise("hard")


def tasks(rows: DataFrame) -> DataFrame:
    """(instance_id, repo, problem_statement, patch_files, tier) from tasks with a unified diff."""
    out = rows.select("instance_id", text_of(F.col("repo")).alias("repo"), F.substring(text_of(F.col("problem_statement")), 1, 1500).alias("problem_statement"), diff_files(F.col("patch")).alias("patch_files"))
    return out.withColumn("tier", tier(F.col("patch_files")))


def relevance(tasks: DataFrame, experiences: DataFrame) -> DataFrame:
    """(instance_id, experience, relevance) of all pairs of a repository: strong if they share a file, else weak."""
    pairs = tasks.filter("repo <> ''").join(experiences.select("repo", F.col("instance_id").alias("experience"), "source_files"), "repo")
    return pairs.select("instance_id", "experience", F.when(F.arrays_overlap("source_files", "patch_files"), "strong").otherwise("weak").alias("relevance"))


def experiences(rows: DataFrame) -> DataFrame:
    """(instance_id, repo, source_files) from experiences (instance_id, repo, paths): paths without testbed prefixes, tests
    and artifacts; one row an instance, those without one dropped."""
    paths = F.filter(F.array_distinct(F.transform(F.coalesce("paths", F.array().cast("array<string>")), source_path)), lambda p: p != "")
    named = rows.filter(text_of(F.col("instance_id")) != "").select("instance_id", text_of(F.col("repo")).alias("repo"), paths.alias("source_files"))
    return named.groupBy("instance_id").agg(F.max("repo").alias("repo"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_files")))).alias("source_files"))


def markers(hits: DataFrame) -> DataFrame:
    """(instance_id, rank, experience): what stands in brackets in the hits' contents."""
    found = F.array_distinct(F.regexp_extract_all(text_of(F.col("content")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))
    return hits.select("instance_id", "rank", F.explode(found).alias("experience"))


def label_hits(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """hits (instance_id, rank, content) with the best relevance of the experiences whose marker ([name]) their content
    holds. truth: (instance_id, experience, relevance), of the pairs that the hits show at least."""
    grade = F.when(F.col("relevance") == "strong", 2).otherwise(1)
    held = markers(hits).join(truth.withColumn("_grade", grade), ["instance_id", "experience"]).groupBy("instance_id", "rank").agg(F.max("_grade").alias("_grade"))
    out = hits.join(held, ["instance_id", "rank"], "left")
    return out.withColumn("relevance", F.when(F.col("_grade") == 2, "strong").when(F.col("_grade") == 1, "weak").otherwise("none")).drop("_grade")


def shown_relevance(hits: DataFrame, tasks: DataFrame, experiences: DataFrame) -> DataFrame:
    """relevance() of the pairs of a task and an experience that the hits show, without making the others."""
    seen = markers(hits).select("instance_id", "experience").distinct()
    own = experiences.select(F.col("instance_id").alias("experience"), F.col("repo").alias("_repo"), "source_files")
    pairs = seen.join(own, "experience").join(tasks.filter("repo <> ''").select("instance_id", "repo", "patch_files"), "instance_id").filter("repo = _repo")
    return pairs.select("instance_id", "experience", F.when(F.arrays_overlap("source_files", "patch_files"), "strong").otherwise("weak").alias("relevance"))


def task_metrics(tasks: DataFrame, hits: DataFrame) -> DataFrame:
    """Per task: recall (any strong hit), precision, hit@1 and reciprocal rank of the first strong hit."""
    strong = F.col("relevance") == "strong"
    agg = hits.groupBy("instance_id").agg(
        F.max(strong.cast("int")).alias("recall"), (F.sum((F.col("relevance") != "none").cast("int")) / F.greatest(F.count("*"), F.lit(1))).alias("precision"),
        F.max((strong & (F.col("rank") == 1)).cast("int")).alias("hit1"), (1 / F.min(F.when(strong, F.col("rank")))).alias("rr"),
    )
    return tasks.select("instance_id", "tier").join(agg, "instance_id", "left").fillna(0, ["recall", "precision", "hit1", "rr"])


def summary(metrics: DataFrame) -> DataFrame:
    """Means overall (tier 'all') and by tier; tiers without tasks are reported with n = 0."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in (("recall", "recall"), ("precision", "precision"), ("hit1", "hit1"), ("rr", "mrr"))]
    found = metrics.cube("tier").agg(F.grouping_id().alias("_g"), F.count("instance_id").alias("n"), *means)
    found = found.withColumn("tier", F.when(F.col("_g") == 1, "all").otherwise(F.col("tier"))).drop("_g")
    names = metrics.sparkSession.createDataFrame([(t,) for t in ("all", *TIERS)], "tier string")
    return names.join(found, "tier", "left").fillna(0).fillna(0.0)
