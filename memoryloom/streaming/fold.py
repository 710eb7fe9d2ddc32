"""The revision fold as a keyed streaming state: each user's newest notes stay with the stream.

Candidates (see pipelines.cards_of_events) come as a stream; what they are held against is the state of their user, and not
a read of the store for each batch. Decisions go to the store by commits, which a replayed batch doesn't repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from ..functions.adapters import Breaker, vectors_of, with_retry
from ..operators import revise
from ..params import DEFAULT, Params
from ..sources.checkpoints import staged
from ..sources.store import Store, active, newest_first

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FIELDS = ("id", "session_id", "request_id", "segment_id", "request_ts", "content", "embedding", "memory_type", "card", "created_at", "version", "supersedes_id", "superseded_by", "superseded")
#: Decisions as JSON; times are in microseconds.
_DECISION = revise.OUT.replace("created_at timestamp", "created_at long")


def _packed(df: DataFrame, *keep: str) -> DataFrame:
    """(user_id, *keep, row): a row as JSON."""
    there = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in ("created_at", "request_ts") else F.col(c) for c in _FIELDS if c in df.columns]
    return df.select("user_id", *keep, F.to_json(F.struct(*there)).alias("row"))


def _opened(text: str) -> dict:
    return dict.fromkeys(_FIELDS) | {"known_pairs": None, "stored": False} | json.loads(text)


class KeyedFold(StatefulProcessor):
    """One user's fold from batch to batch. The state is the notes that the next candidate is held against, newest first
    (after each request no more than dedup_neighbor_cap), what profiles have said, and the request at hand."""

    def __init__(self, params: Params = DEFAULT, judge: revise.Judge | None = None, embed=None) -> None:
        self.params, self.judge, self.embed = params, judge, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "state string")
        self.safe_judge = Breaker(with_retry(self.judge), None, self.params.llm_failure_threshold) if self.judge else None
        self.safe_embed = vectors_of(self.embed, self.params) if self.embed else None

    def _fold(self, user: str) -> revise.Fold:
        fold = revise.Fold(self.params, self.safe_judge, self.safe_embed)
        if self.held.exists():
            held = json.loads(self.held.get()[0])
            fold.request, fold.said = held["request"], {repr(p): p for p in held["said"]}
            # as the store gives them back: newest first, then by id
            for note in sorted(sorted(held["notes"], key=lambda n: n["id"], reverse=True), key=lambda n: n["created_at"] or 0):
                fold.notes.add(note)
        return fold

    def _keep(self, fold: revise.Fold) -> None:
        notes = [fold.notes.notes[k] for k in sorted(fold.notes.notes, reverse=True)]
        self.held.update((json.dumps({"request": fold.request, "said": list(fold.said.values()), "notes": notes}),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (user,) = key
        fold, out = self._fold(user), []
        order = lambda r: tuple((r[c] is None, r[c]) for c in ("request_ts", "request_id", "session_id", "segment_id"))
        for row in sorted((_opened(t) for pdf in rows for t in pdf["row"]), key=order):
            out += fold.row(row | {"user_id": user})
        self._keep(fold)
        yield pd.DataFrame({"user_id": [user] * len(out), "decision": [json.dumps(o) for o in out]})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The store's newest notes of a user, and the pairs of all the user's profiles."""
        (user,) = key
        fold = revise.Fold(self.params)
        for row in initialState.sort_values("place", ascending=False)["row"]:
            fold.notes.add(_opened(row) | {"user_id": user})
        fold.said = {repr(p): p for p in json.loads(initialState["said"].iloc[0] or "[]")}
        self._keep(fold)

    def close(self) -> None:
        pass


def held_notes(store: Store, params: Params = DEFAULT) -> DataFrame:
    """(user_id, place, row, said): what a stream that starts on a store with notes begins from."""
    notes = active(store.memories())
    newest = Window.partitionBy("user_id").orderBy(*newest_first())
    told = F.transform(F.sort_array(F.collect_list(F.struct("created_at", F.col("card.pairs").alias("pairs"))), asc=False), lambda x: x["pairs"])
    said = notes.filter("memory_type = 'profile'").groupBy("user_id").agg(F.to_json(F.array_distinct(F.flatten(told))).alias("said"))
    placed = notes.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= params.dedup_neighbor_cap)
    return _packed(placed, "place").join(said, "user_id", "left")


def opened_decisions(packed: DataFrame) -> DataFrame:
    """Decisions (columns of revise.OUT) from the stream's rows."""
    found = packed.select(F.from_json("decision", _DECISION).alias("d")).select("d.*")
    return found.withColumn("created_at", F.timestamp_micros("created_at"))


def fold_stream(candidates: DataFrame, store: Store, checkpoint: str, params: Params = DEFAULT, judge: revise.Judge | None = None, embed=None, once: bool = True) -> StreamingQuery:
    """Fold a stream of candidates into the store, all that is available and then stop (once), or on and on.

    State and progress are in checkpoint. A batch that is run again after a crash, before or after its commit, decides the
    same from the state before it and adds nothing twice: candidates that the store knows as decided are left out of a
    commit. Users' state is spread over tasks by user. Needs the RocksDB state store, which is set for the session where
    it has Spark's default.
    """
    spark = candidates.sparkSession
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, ROCKSDB)
    began = held_notes(store, params).groupBy("user_id")
    decided = _packed(candidates).groupBy("user_id").transformWithStateInPandas(KeyedFold(params, judge, embed), "user_id string, decision string", "append", "none", began)

    def commit(batch: DataFrame, _: int) -> None:
        found = staged(opened_decisions(batch), "decided")
        while True:
            with store.change() as change:
                known = change.before.decided(found.select("user_id").distinct()).withColumnRenamed("candidate_id", "_known")
                mine = found.withColumn("_of", F.coalesce("candidate_id", "decided_on"))  # a retired note goes with its successor
                fresh = mine.join(known, (mine["user_id"] == known["user_id"]) & (mine["_of"] == known["_known"]), "left_anti").drop("_of")
                change.write_memories(revise.latest(fresh))
                change.write_decisions(fresh)
            if change.made:
                return

    writer = decided.writeStream.foreachBatch(commit).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
