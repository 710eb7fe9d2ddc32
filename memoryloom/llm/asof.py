"""Point-in-time feature join by square-root decomposition of time.

Each version holds over an interval of whole seconds. Blocks of seconds that it covers wholly keep the best version by
block, the seconds at its two ends by second; a question takes the better of its block's and its second's. With blocks of
the root of the intervals' mean length a version makes about two roots of updates, which are combined before they are
shuffled, and no task holds a key's versions or compares two of them beyond that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole seconds that times of versions and questions are drawn from, and the oldest age that is still fresh.
HORIZON, FRESH = 50_000, 120


def _range(first: Column, stop: Column) -> Column:
    """first up to, not including, stop; empty if there are none."""
    return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<bigint>"))


def point_in_time(questions: DataFrame, versions: DataFrame, key: str = "key", at: str = "at", event: str = "event", arrival: str = "arrival", expiry: str = "expiry", version: str = "version", payload: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """questions with a column found: the best version that is usable at each, as a struct (event, arrival, version,
    *payload), or null.

    Usable versions have the question's key (not null), event <= at and arrival <= at < expiry, all in whole seconds; a
    null expiry is never reached. The latest event wins, then the earliest arrival, then the largest version, then (of
    rows that repeat all three) the largest payload. Rows of versions without key, event, arrival or version are never
    usable; questions without key or time, and all questions of an empty table of versions, find nothing; repeated
    questions are answered each. questions may have columns of any names but found.

    block: seconds of a block; by default the rounded root of the mean length of the intervals. Only three numbers go to
    the driver. A hot key is spread over its seconds and blocks.
    """
    asked = questions.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"))
    span = asked.filter("_key is not null").agg(F.min("_at").alias("least"), F.max("_at").alias("most")).first()
    best = F.struct(F.col(event).cast("long").alias("event"), (-F.col(arrival).cast("long")).alias("early"), F.col(version).alias("version"), *[F.col(c).alias(c) for c in payload])
    needed = [F.col(c).isNotNull() for c in (key, event, arrival, version)]
    valid = versions.filter(needed[0] & needed[1] & needed[2] & needed[3])
    never = (span["most"] or 0) + 1
    # nobody asks before the first question or after the last
    valid = valid.select(
        F.col(key).alias("_key"), best.alias("_best"), F.greatest(F.col(event).cast("long"), F.col(arrival).cast("long"), F.lit(span["least"] or 0)).alias("_from"),
        F.least(F.coalesce(F.col(expiry).cast("long"), F.lit(never)), F.lit(never)).alias("_to"),
    ).filter("_from < _to")
    if block is None:
        block = max(1, round(math.sqrt(valid.agg(F.avg(F.col("_to") - F.col("_from"))).first()[0] or 1)))
    in_block = lambda t: ((t - F.pmod(t, F.lit(block))) / block).cast("long")
    first, stop = -in_block(-F.col("_from")), in_block(F.col("_to"))  # the blocks that are covered wholly
    head = F.when(first < stop, first * block).otherwise(F.col("_to"))
    tail = F.when(first < stop, stop * block).otherwise(F.col("_to"))
    blocks = valid.select("_key", "_best", F.explode(_range(first, stop)).alias("_block")).groupBy("_key", "_block").agg(F.max("_best").alias("_of_block"))
    edges = F.concat(_range(F.col("_from"), head), _range(tail, F.col("_to")))
    cells = valid.select("_key", "_best", F.explode(edges).alias("_at")).groupBy("_key", "_at").agg(F.max("_best").alias("_of_cell"))
    met = asked.withColumn("_block", in_block(F.col("_at"))).join(cells, ["_key", "_at"], "left").join(blocks, ["_key", "_block"], "left")
    won = F.greatest("_of_cell", "_of_block")
    found = F.when(won.isNotNull(), F.struct(won["event"].alias("event"), (-won["early"]).alias("arrival"), won["version"].alias("version"), *[won[c].alias(c) for c in payload]))
    return met.select("_row.*", found.alias("found"))


def hashed_integers(key: Column, n: int) -> list[Column]:
    """The first n eight-digit groups of the hex SHA-256 of a key as text, as unsigned integers; null for null."""
    digest = F.sha2(key.cast("string").cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def label_features(documents: DataFrame, labels: DataFrame, fresh: int = FRESH) -> DataFrame:
    """For every label the version of its document's source that was known and valid at the label's time.

    Each document is a version of its source; its times and a label's time t are drawn from the SHA-256 of doc_id. Returns
    doc_id, t, version_id, age (t - event), status (none, stale where age > fresh, else fresh), and the version's n_chars
    and lang where it is fresh.

    A label without doc_id has no time, one without document, or whose document has no source, no source: status none. Of
    several documents of one id a label asks about the one of the least source; each of them is a version. Repeated labels
    have a row each; an empty table of labels gives an empty result; other columns aren't read.
    """
    key = F.col("doc_id").cast("long")
    a, b, c, d = hashed_integers(key, 4)
    event = a % HORIZON
    versions = documents.select(F.col("source").alias("key"), key.alias("version"), event.alias("event"), (event - 60 + b % 600).alias("arrival"), (event + c % 900).alias("expiry"), F.col("n_chars").cast("long").alias("n_chars"), "lang")
    sources = documents.filter("doc_id is not null and source is not null").groupBy(key.alias("doc_id")).agg(F.min("source").alias("key"))
    questions = labels.select(key.alias("doc_id"), (d % HORIZON).alias("at")).join(sources, "doc_id", "left")
    out = point_in_time(questions, versions, payload=("n_chars", "lang"))
    won, age = F.col("found"), F.col("at") - F.col("found.event")
    is_fresh = age <= fresh
    return out.select(
        "doc_id", F.col("at").alias("t"), won["version"].alias("version_id"), age.alias("age"), F.when(won.isNull(), "none").when(is_fresh, "fresh").otherwise("stale").alias("status"),
        F.when(is_fresh, won["n_chars"]).alias("n_chars"), F.when(is_fresh, won["lang"]).alias("lang"),
    )
