"""Incremental ingest: Structured Streaming over wire requests or raw rows, folded batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import transcript
from ..params import DEFAULT, Params
from ..plans import pipelines
from ..sources.store import Store


def wire_batch(store: Store, now: str, params: Params = DEFAULT, judge=None, embed=None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Ids are hashes of the request and segment, so a batch that is replayed adds nothing."""

    def run(batch: DataFrame, _: int) -> None:
        good, _rejected = transcript.validate(batch)
        events = transcript.events_of_messages(transcript.explode_wire(good))
        pipelines.ingest(events, store, F.lit(now), params, judge, embed).unpersist()

    return run


def ingest_stream(requests: DataFrame, store: Store, checkpoint: str, now: str, params: Params = DEFAULT, **adapters) -> StreamingQuery:
    """Fold a stream of wire requests into the store, all that is available and then stop; progress is in checkpoint."""
    writer = requests.writeStream.foreachBatch(wire_batch(store, now, params, **adapters))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Idle-gap sessions of a stream or table of events (user_id, ts, event_type), late ones up to the watermark."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")
