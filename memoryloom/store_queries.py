"""Queries through the store: changes of clients as versions of notes, written in several commits that come out of order,
then read by snapshots and searched by the stored index; with DuckDB SQL over the changes themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bm25
from .sources import store as stores
from .sources.checkpoints import shared_folder, staged

#: Commits that the changes are dealt to, by change_id.
COMMITS = 3
#: What is asked of every user's notes.
ASKED = ("retail client in Belcoril by web", "export export partner", "public store", "none of these")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """A client's changes as versions of one note; of rows that repeat client and seq the last counts, D retires."""
    c = spark.read.parquet(f"{sf}/client_changes.parquet").filter("client_id is not null and seq is not null")
    one = c.groupBy("client_id", "seq").agg(F.max_by(F.struct("change_id", "op", "valid_at", "source", "segment", "city"), "change_id").alias("r")).select("client_id", "seq", "r.*")
    return one.select(
        F.concat(F.lit("u"), F.col("client_id") % 20).alias("user_id"), F.concat(F.lit("c"), "client_id").alias("id"), (F.col("seq") + 1).cast("int").alias("version"), (F.coalesce("op", F.lit("")) == "D").alias("superseded"),
        F.concat_ws(" ", F.lit("client in"), "city", "segment", F.lit("by"), "source").alias("content"), F.when(F.col("source") == "web", "event").otherwise("record").alias("memory_type"), F.col("valid_at").cast("timestamp").alias("created_at"), "change_id",
    )


def changed_store(spark: SparkSession, sf: str) -> stores.Store:
    """A store that has taken the versions in COMMITS commits, later ones before earlier ones, one of them twice."""
    store = stores.Store(spark, f"{shared_folder(spark)}/memoryloom-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}")
    rows = staged(versions(spark, sf), "changes")
    for k in (*range(COMMITS - 1, -1, -1), 1):
        store.write_memories(rows.filter(F.pmod("change_id", F.lit(COMMITS)) == k))
    return store


def store_upserts(spark, sf):
    now = changed_store(spark, sf).snapshot()
    notes, log = now.memories(), now.log("memories").groupBy("user_id").agg(F.count("*").alias("n_versions"))
    shown = notes.groupBy("user_id").agg(
        F.count("*").alias("n_notes"), F.sum((~F.col("superseded")).cast("int")).alias("n_active"), F.max(F.when(~F.col("superseded"), F.col("created_at"))).alias("newest"),
        F.sum((~F.col("superseded") & (F.col("memory_type") == "event")).cast("int")).alias("n_events"), F.max("version").alias("top_version"),
    )
    return shown.join(log, "user_id").join(now.index().users.select("user_id", F.col("n").alias("n_indexed")), "user_id", "left")


def stored_index_scores(spark, sf):
    index = changed_store(spark, sf).index()
    asked = index.users.select("user_id", F.posexplode(F.array(*map(F.lit, ASKED))).alias("k", "query")).withColumn("query_id", F.concat_ws("-", "user_id", "k"))
    return bm25.scores(index, asked).select("query_id", "id", F.round("bm25", 4).alias("bm25"))


QUERIES = {f.__name__: f for f in (store_upserts, stored_index_scores)}

_VERSIONS = """versions AS (SELECT 'u' || client_id % 20 AS user_id, 'c' || client_id AS id, seq + 1 AS version, coalesce(op, '') = 'D' AS superseded, concat_ws(' ', 'client in', city, segment, 'by', source) AS content,
    coalesce(source = 'web', false) AS is_event, valid_at AS created_at FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id, seq ORDER BY change_id DESC) = 1),
  latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY version DESC) = 1)"""


def oracles(bm25_sql: str) -> dict[str, str]:
    """bm25_sql: BM25 over notes and requests as common table expressions."""
    asked = ", ".join(f"({k}, '{q}')" for k, q in enumerate(ASKED))
    return {
        "store_upserts": f"""WITH {_VERSIONS},
          log AS (SELECT user_id, count(*) AS n_versions FROM versions GROUP BY ALL)
          SELECT user_id, count(*) AS n_notes, sum((NOT superseded)::INT)::BIGINT AS n_active, max(created_at) FILTER (NOT superseded) AS newest, sum((NOT superseded AND is_event)::INT)::BIGINT AS n_events, max(version)::INT AS top_version, any_value(n_versions) AS n_versions,
            nullif(sum((NOT superseded)::INT), 0)::BIGINT AS n_indexed FROM latest JOIN log USING (user_id) GROUP BY user_id""",
        "stored_index_scores": f"""WITH {_VERSIONS}, notes AS (SELECT user_id, id, content FROM latest WHERE NOT superseded),
          requests AS (SELECT user_id || '-' || k AS query_id, user_id, q AS query FROM (SELECT DISTINCT user_id FROM notes), (VALUES {asked}) v(k, q)), {bm25_sql}
          SELECT query_id, id, round(bm25, 4) AS bm25 FROM bm25""",
    }
