"""Segmentation of events: todo, idle-gap and size boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..params import DEFAULT, Params


def word_count(text: Column) -> Column:
    return F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"(?U)\s+")))


def event_weight() -> Column:
    """Words of an event's text, result and (tool calls) input values."""
    inputs = F.aggregate(F.map_values("tool_input"), F.lit(0), lambda s, v: s + word_count(v))
    return word_count(F.col("text")) + word_count(F.col("tool_result")) + F.when(F.col("kind") == "tool_use", F.coalesce(inputs, F.lit(0))).otherwise(0)


def parse_ts(ts: Column) -> Column:
    """Seconds of a time given as milliseconds, seconds or ISO text; null if it can't be read."""
    n = ts.try_cast("double")
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(ts, "Z$", "+00:00"))) / 1e6
    return F.when(ts.rlike("^[0-9]+$"), F.when(n > 1e12, n / 1000).otherwise(n)).otherwise(iso)


def gap_flag(keys: list[str], order: str, seconds: Column, limit: float) -> Column:
    """Whether more than limit seconds passed since the last known time."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(seconds - F.last(seconds, ignorenulls=True).over(w) > limit, F.lit(False))


def _caps(keys: list[str], order: str, params: Params):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by keys and order; only the open segment's totals are carried on
        group, segment, messages, words, before = None, 0, 0, 0, ""
        for pdf in batches:
            found = []
            for row in zip(*(pdf[k] for k in keys), pdf["kind"], pdf["_todo"], pdf["_gap"], pdf["_words"], strict=True):
                key, (kind, todo, gap, w) = row[: len(keys)], row[len(keys) :]
                if key != group:
                    group, segment, messages, words = key, 0, 0, 0
                elif not (kind == "tool_result" and before == "tool_use") and (todo or gap or messages >= params.chunk_max_messages or words + w > params.chunk_max_words):
                    segment, messages, words = segment + 1, 0, 0
                messages, words, before = messages + 1, words + w, kind
                found.append(segment)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, order: pdf[order], "segment_id": pd.Series(found, dtype="int32")})

    return cut


def segment_events(events: DataFrame, keys: list[str], order: str = "event_index", params: Params = DEFAULT) -> DataFrame:
    """events with segment_id. A result directly after its call never begins a segment; else a todo call, a gap of more
    than idle_gap_seconds and the caps on messages and words do.

    The greedy caps are the one sequential step: narrow rows, sorted within partitions, are streamed, so that a long
    session needs no memory of its own. The text is joined back by key.
    """
    todo = F.lit(params.chunk_boundary_on_todo) & (F.col("kind") == "tool_use") & (F.col("tool_name") == "TodoWrite")
    flagged = events.select(*keys, order, "kind", F.coalesce(todo, F.lit(False)).alias("_todo"), gap_flag(keys, order, parse_ts(F.col("ts")), params.idle_gap_seconds).alias("_gap"), event_weight().alias("_words"))
    types = dict(events.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{order}` {types[order]}", "segment_id int"])
    placed = flagged.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(_caps(keys, order, params), schema)
    return events.join(placed, [*keys, order])


def chunk_messages(messages: DataFrame, keys: list[str], order: str, params: Params = DEFAULT) -> DataFrame:
    """The older chunker: segment_id by the caps alone, and only where a conversation exceeds one of them."""
    w = Window.partitionBy(*keys)
    words = word_count(F.col("text"))
    large = (F.count("*").over(w) > params.chunk_max_messages) | (F.sum(words).over(w) > params.chunk_max_words)
    flagged = messages.select(*keys, order, F.lit("text").alias("kind"), F.lit(False).alias("_todo"), F.lit(False).alias("_gap"), words.alias("_words"), large.alias("_large"))
    types = dict(messages.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{order}` {types[order]}", "segment_id int"])
    cut = flagged.filter("_large").repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(_caps(keys, order, params), schema)
    whole = flagged.filter("not _large").select(*keys, order, F.lit(0).alias("segment_id"))
    return messages.join(cut.unionByName(whole), [*keys, order])
