"""The evaluation run: tasks are searched for, hits labelled by the experiences they name, metrics summed up by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import task_query
from ..operators import evaluate
from ..params import DEFAULT, Params
from ..sources.checkpoints import staged
from . import pipelines


def run(tasks: DataFrame, experiences: DataFrame, memories: DataFrame, now: Column, k: int = 5, params: Params = DEFAULT, **search) -> tuple[DataFrame, DataFrame]:
    """(metrics by task, summary by tier) of the first k results for each task.

    tasks: evaluate.tasks' columns and user_id, whose memories are searched; experiences: evaluate.experiences' columns.
    A task's query is its repository's name and the statement; one without results counts with zeros. search: models and
    an index for pipelines.search.
    """
    asked = tasks.select(F.col("instance_id").alias("query_id"), "user_id", task_query(F.col("repo"), F.col("problem_statement")).alias("query"), F.lit(k).alias("top_k"), F.array().cast("array<string>").alias("options"))
    found = pipelines.search(asked, memories, now, params=params, granularity="L2", **search)
    hits = staged(found.select(F.col("query_id").alias("instance_id"), F.col("final_rank").alias("rank"), "content"), "hits")
    labelled = evaluate.label_hits(hits, evaluate.shown_relevance(hits, tasks, experiences))
    metrics = staged(evaluate.task_metrics(tasks, labelled), "metrics")
    return metrics, evaluate.summary(metrics)
