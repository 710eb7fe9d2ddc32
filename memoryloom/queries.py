"""The engine's operators as driver queries over whole tables, with equivalent DuckDB SQL.

Notes are the documents: a source is a user, created_at spreads over 400 days, NOW is fixed. Benchmark items are the
search requests, each of the user that its number names.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session_queries, store_queries
from .functions import scoring, text
from .operators import bm25, evaluate, graph, rank, revise, segment, transcript
from .params import DEFAULT
from .plans import evaluation, pipelines
from .schema import CARD
from .sources import store
from .sources.checkpoints import staged

NOW = "2025-03-01 00:00:00"
WEIGHTS = {"profile": 0.0, "event": 0.6, "record": 1.0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    kinds = F.element_at(F.array(F.lit("event"), F.lit("record"), F.lit("profile")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = F.array(F.concat(F.lit("src/f"), F.col("doc_id") % 7, F.lit(".py")))
    none = F.lit("")
    c = F.struct(
        kinds.alias("memory_type"), none.alias("instance_id"), none.alias("trigger"), none.alias("root_cause"), F.substring("text", 1, 60).alias("action_hint"), files.alias("files_symbols"),
        F.substring("text", 61, 60).alias("failure_if_ignored"), F.concat_ws("/", F.lit("the"), F.col("lang")).alias("scope"), none.alias("temporal_anchor"), F.substring("text", 1, 30).alias("gist"),
        F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("keywords"), F.array().cast("array<struct<attr:string,value:string>>").alias("pairs"),
    ).cast(CARD)
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 400).cast("int"))
    return d.select(
        F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.array().cast("array<float>").alias("embedding"), kinds.alias("memory_type"),
        c.alias("card"), at.alias("created_at"), F.lit(1).alias("version"), F.lit(False).alias("superseded"), "doc_id",
    )


NOTES = """notes AS (
    SELECT source AS user_id, doc_id::VARCHAR AS id, text AS content, ['event', 'record', 'profile'][(doc_id % 3 + 1)::INT] AS memory_type, lang, doc_id,
      TIMESTAMP '2024-01-01' + to_days((doc_id % 400)::INT) AS created_at FROM documents)"""


def requests(spark: SparkSession, sf: str, weights: dict | None = None) -> DataFrame:
    b = table(spark, sf, "benchmark")
    w = F.create_map(*[F.lit(x) for p in weights.items() for x in p]) if weights else F.from_json(F.lit("{}"), "map<string,double>")
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("user_id"), F.col("text").alias("query"), F.array().cast("array<float>").alias("embedding"), w.alias("weights"), F.lit(5).alias("top_k"), F.array().cast("array<string>").alias("options"))


REQUESTS = "requests AS (SELECT item_id::VARCHAR AS query_id, 'src' || (item_id % 20) AS user_id, text AS query FROM benchmark)"


def _tokens_sql(column: str) -> str:
    return f"""list_filter(flatten(list_transform(list_filter(regexp_extract_all({column}, '[A-Za-z_][A-Za-z0-9_]*|[一-鿿]+'), lambda t: len(t) >= 2),
      lambda t: CASE WHEN replace(t, '_', '') = '' THEN [lower(t)] ELSE list_distinct(list_filter(list_transform(list_concat(string_split_regex(t, '_+'),
        flatten(list_transform(string_split_regex(t, '_+'), lambda p: string_split(regexp_replace(regexp_replace(p, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' ')))),
        lambda p: lower(p)), lambda p: p <> '')) END)), lambda x: x <> '')"""


BM25 = f"""terms AS (SELECT user_id, id, term, count(*) AS tf FROM (SELECT user_id, id, unnest({_tokens_sql('content')}) AS term FROM notes) GROUP BY ALL),
  lens AS (SELECT user_id, id, sum(tf) AS dl FROM terms GROUP BY ALL),
  corpora AS (SELECT user_id, n, tokens / n AS avgdl FROM (SELECT user_id, count(*) AS n FROM notes GROUP BY ALL) JOIN (SELECT user_id, sum(tf) AS tokens FROM terms GROUP BY ALL) USING (user_id)),
  idf0 AS (SELECT user_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT user_id, term, count(*) AS df FROM terms GROUP BY ALL) JOIN corpora USING (user_id)),
  idf AS (SELECT user_id, term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY user_id) ELSE idf END AS idf FROM idf0),
  asked AS (SELECT query_id, user_id, term, count(*) AS qtf FROM (SELECT query_id, user_id, unnest({_tokens_sql('query')}) AS term FROM requests) GROUP BY ALL),
  bm25 AS (SELECT query_id, user_id, id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
    FROM asked JOIN terms USING (user_id, term) JOIN idf USING (user_id, term) JOIN lens USING (user_id, id) JOIN corpora USING (user_id) GROUP BY ALL)"""


def tokenize_terms(spark, sf):
    return table(spark, sf, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def fingerprint_dups(spark, sf):
    d = table(spark, sf, "documents").select(text.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"), "doc_id")
    return d.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).filter("copies > 1")


def word_overlap(spark, sf):
    """Texts are cut into words once each, not once a pair; of a note's words a pair meets those alone that some request of
    its user has, which are as few as requests' words are."""
    asked = staged(requests(spark, sf).select("query_id", "user_id", text.word_set(F.col("query")).alias("a"), text.token_set(F.col("query")).alias("c")), "asked")
    sought = asked.groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("sought"))
    words = bm25.spread(notes(spark, sf).select("user_id", "id", "content")).select("user_id", "id", text.word_set(F.col("content")).alias("b"))
    met = words.join(sought, "user_id").select("user_id", "id", F.size("b").alias("n_b"), F.size(F.filter("b", lambda w: F.length(w) > 1)).alias("n_d"), F.array_intersect("b", "sought").alias("met"))
    both = F.size(F.array_intersect("a", "met"))
    long = F.size(F.array_intersect("c", "met"))
    pairs = asked.join(staged(met, "met"), "user_id").select("query_id", "id", "n_b", "n_d", F.size("a").alias("n_a"), F.size("c").alias("n_c"), both.alias("both"), long.alias("long"))
    j = F.coalesce(F.try_divide("both", F.col("n_a") + F.col("n_b") - F.col("both")), F.lit(0.0))
    kind = F.when(j >= 0.85, "duplicate").when(j >= 0.4, "supports").otherwise("unrelated")
    return pairs.select("query_id", "id", F.round(j, 6).alias("jaccard"), F.round(F.coalesce(F.try_divide("long", F.least("n_c", "n_d")), F.lit(0.0)), 6).alias("overlap"), kind.alias("relation"))


def first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


def scan_recent_per_user(spark, sf):
    return store.recent(notes(spark, sf), 10).select("user_id", "id", "created_at")


def scan_by_type(spark, sf):
    return store.active(notes(spark, sf)).filter("memory_type = 'event'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


def upsert_latest_version(spark, sf):
    e = table(spark, sf, "events")
    return store.last_version(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def validate_rejects(spark, sf):
    c = table(spark, sf, "conversations")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("long").alias("timestamp")))
    asked = c.groupBy("conv_id").agg(m.alias("messages")).withColumns({k: F.col("conv_id").cast("string") for k in ("request_id", "user_id", "session_id")})
    good, bad = transcript.validate(asked)
    return good.select("conv_id", F.lit("ok").alias("reason")).union(bad.select("conv_id", "reason"))


def _messages(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(*[F.col("conv_id").cast("string").alias(k) for k in ("user_id", "session_id", "request_id")], F.col("turn").alias("position"), "role", F.col("text").alias("content"), F.lit("").alias("ts"))


def transcript_events(spark, sf):
    e = transcript.events_of_messages(_messages(spark, sf))
    return e.select("session_id", "event_index", "role", "kind", "text")


def events_to_text(spark, sf):
    return transcript.render(transcript.events_of_messages(_messages(spark, sf)), ["session_id"])


def _actions(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    todo = F.col("event_type") == "signup"
    return e.select(
        "user_id", "event_id", F.when(todo, "tool_use").otherwise("text").alias("kind"), F.when(todo, "TodoWrite").alias("tool_name"), F.lit("x").alias("text"),
        F.from_json(F.lit("{}"), "map<string,string>").alias("tool_input"), F.lit(None).cast("string").alias("tool_result"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        F.struct("ts", "event_id").alias("place"),
    )


def segment_idle(spark, sf):
    p = replace(DEFAULT, idle_gap_seconds=21_600.0, chunk_boundary_on_todo=False, chunk_max_messages=10**9, chunk_max_words=10**9)
    return segment.segment_events(_actions(spark, sf), ["user_id"], "place", p).select("user_id", "event_id", "segment_id")


def segment_todo(spark, sf):
    p = replace(DEFAULT, idle_gap_seconds=1e12, chunk_max_messages=10**9, chunk_max_words=10**9)
    return segment.segment_events(_actions(spark, sf), ["user_id"], "place", p).select("user_id", "event_id", "segment_id")


def segment_caps(spark, sf):
    m = table(spark, sf, "conversations")
    return segment.chunk_messages(m, ["conv_id"], "turn", replace(DEFAULT, chunk_max_messages=3, chunk_max_words=60)).select("conv_id", "turn", "segment_id")


def bm25_scores(spark, sf):
    s = bm25.bm25_scores(notes(spark, sf), requests(spark, sf))
    return s.select("query_id", "id", F.round("bm25", 4).alias("bm25"))


def bm25_topk(spark, sf):
    r = bm25.rank_documents(notes(spark, sf), requests(spark, sf), 10)
    return r.select("query_id", "id", F.round("score", 4).alias("score"))


#: Query vectors that are compared with all rows in one go, and rows that a task compares them with at once.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 4096, 1024


def _padded(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, their lengths and norms; those longer than width, which match no query, are zero."""
    out, size = np.zeros((len(vectors), width)), np.array([len(v or ()) for v in vectors], np.int64)
    for row, v in zip(out, vectors, strict=True):
        if v and len(v) <= width:
            row[: len(v)] = v
    return out, size, np.sqrt((out * out).sum(axis=1)) + 1e-12


def _nearest(shared, k: int):
    """For mapInArrow over (vec_id, embedding): the task's k nearest rows of each query, kept up while rows stream by."""

    def run(batches):
        ids, vectors = shared.value
        width = max(len(v or ()) for v in vectors)
        q, size, norm = _padded(vectors, width)
        slot, vec, cos, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(ids), -np.inf)
        for part in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            at = part.column(0).to_numpy()
            rows, rows_size, rows_norm = _padded(part.column(1).to_pylist(), width)
            c = q @ rows.T / (norm[:, None] * rows_norm)
            c[(size[:, None] != rows_size) | (size[:, None] == 0)] = 0.0
            c[ids[:, None] == at] = -np.inf
            if len(at) >= k:
                least = np.maximum(least, np.partition(c, -k, axis=1)[:, -k])
            s, r = np.nonzero((c >= least[:, None] - 2e-6) & (c > -np.inf))
            slot, vec, cos = np.concatenate((slot, s)), np.concatenate((vec, at[r])), np.concatenate((cos, c[s, r]))
            order = np.lexsort((vec, -np.round(cos, 6), slot))
            first = np.searchsorted(slot[order], np.arange(len(ids)))
            order = order[np.arange(len(order)) - first[slot[order]] < k]
            slot, vec, cos = slot[order], vec[order], cos[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids[slot], pa.int64()), pa.array(vec, pa.int64()), pa.array(cos, pa.float64())], names=["query_id", "vec_id", "cosine"])

    return run


def cosine_topk(spark, sf):
    """The five nearest of all other rows, whatever their label, for each query vector."""
    from pyspark.sql.window import Window

    e = table(spark, sf, "embeddings").filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    q = e.filter("vec_id % 50 = 0")
    blocks, found = -(-q.count() // QUERIES_AT_ONCE), []
    for b in range(max(1, blocks)):
        some = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))) == b).collect()
        if some:
            shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in some], np.int64), [r["embedding"] for r in some]))
            found.append(e.mapInArrow(_nearest(shared, 5), "query_id long, vec_id long, cosine double"))
    near = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("cosine", F.round("cosine", 6)).withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


def temporal_decay(spark, sf):
    n = notes(spark, sf)
    return n.select("id", F.round(scoring.decay(F.col("created_at"), now()), 6).alias("decay"), F.round(scoring.recency(F.col("created_at"), now()), 6).alias("recency"))


def hybrid_rank(spark, sf):
    r = rank.hybrid_rank(notes(spark, sf), requests(spark, sf, WEIGHTS), now(), top_n=F.lit(25), vectors=False)
    return r.select("query_id", "id", F.round("score", 4).alias("score"))


def _ranked(spark, sf) -> DataFrame:
    asked = requests(spark, sf, WEIGHTS)
    found = rank.hybrid_rank(notes(spark, sf), asked, now(), top_n=F.lit(25), vectors=False)
    found = found.withColumn("score", F.round("score", 4))
    return rank.rerank(found.join(asked.select("query_id", "query"), "query_id"), now())


def utility_rerank(spark, sf):
    return _ranked(spark, sf).select("query_id", "id", F.round("utility", 6).alias("utility"))


def gate_package(spark, sf):
    kept = rank.gate(_ranked(spark, sf))
    return kept.select("query_id", "id", F.sha2(rank.package(F.col("card"), F.col("content"), F.lit("L1")), 256).alias("packaged"))


def package_levels(spark, sf):
    n = notes(spark, sf)
    level = lambda x: rank.package(F.col("card"), F.col("content"), F.lit(x))
    return n.select("id", level("L0").alias("l0"), F.sha2(level("L1"), 256).alias("l1"), F.length(level("L2")).alias("l2_chars"))


def near_duplicate(spark, sf):
    index, asked = bm25.index_of(notes(spark, sf)), requests(spark, sf)
    s = staged(bm25.scores(index, asked), "scores")
    return rank.near_duplicate_flags(s, asked.select("query_id", "user_id").join(index.users, "user_id").select("query_id", "n"))


def search_pipeline(spark, sf):
    """The flagship: the whole search chain, symbols included, for every benchmark item."""
    n = notes(spark, sf)
    syms = n.select("user_id", F.explode("card.files_symbols").alias("file"), F.concat(F.lit("def s"), F.col("doc_id") % 5, F.lit("():\n  pass\n")).alias("content")).groupBy("user_id", "file").agg(F.concat_ws("\n", F.array_sort(F.collect_set("content"))).alias("content"))
    out = pipelines.search(requests(spark, sf), n, now(), graph.extract_symbols(syms))
    return out.select("query_id", "final_rank", "id", F.round("score", 4).alias("score"), F.round("utility", 6).alias("utility"), "memory_type")


def search_symbols(spark, sf):
    """The search chain with twenty results a request over 211 files, so that the symbol graph lifts notes that are
    recalled but name none of the seeds."""
    n = notes(spark, sf).withColumn("card", F.col("card").withField("files_symbols", F.array(F.concat(F.lit("src/g"), F.col("doc_id") % 211, F.lit(".py")))))
    syms = n.select("user_id", F.explode("card.files_symbols").alias("file"), F.concat(F.lit("def sym"), F.col("doc_id") % 31, F.lit("():\n  pass\n")).alias("content")).groupBy("user_id", "file").agg(F.concat_ws("\n", F.array_sort(F.collect_set("content"))).alias("content"))
    asked = requests(spark, sf).withColumn("top_k", F.lit(20))
    out = pipelines.search(asked, n, now(), graph.extract_symbols(syms), replace(DEFAULT, recall_multiplier=2))
    return out.select("query_id", "final_rank", "id", F.round("score", 4).alias("score"), F.round("utility", 6).alias("utility"), "memory_type")


def revision_fold(spark, sf):
    """Every document as a candidate of its source, in order of doc_id, against an empty store."""
    n = notes(spark, sf)
    empty = store.decoded(n.limit(0))
    c = n.select("user_id", F.lit("s").alias("session_id"), F.lit("r").alias("request_id"), F.col("doc_id").cast("int").alias("segment_id"), "id", "content", "embedding", "memory_type", "card", "created_at", F.col("created_at").alias("request_ts"))
    return revise.revise(c, empty).groupBy("user_id", "action").agg(F.count("*").alias("n"))


def upsert_history(spark, sf):
    """Decisions of the fold as versions: the number of active and retired notes of each user."""
    n = notes(spark, sf)
    c = n.select("user_id", F.lit("s").alias("session_id"), F.lit("r").alias("request_id"), F.col("doc_id").cast("int").alias("segment_id"), "id", "content", "embedding", "memory_type", "card", "created_at", F.col("created_at").alias("request_ts"))
    rows = revise.latest(revise.revise(c, store.decoded(n.limit(0))))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("superseded").cast("int")).alias("retired"), F.max("version").alias("versions"))


def revision_judged(spark, sf):
    """The fold with a judge that merges, supersedes and lets stand by the texts' lengths, in requests of 25 documents, and
    what it leaves active and retired, over every document."""
    n = notes(spark, sf)
    c = n.select("user_id", F.lit("s").alias("session_id"), F.lpad(F.floor(F.col("doc_id") / 500).cast("string"), 12, "0").alias("request_id"), (F.col("doc_id") % 500).cast("int").alias("segment_id"), "id", "content", "embedding", "memory_type", "card", "created_at", F.col("created_at").alias("request_ts"))
    decided = revise.revise(c.withColumn("request_ts", F.lit(NOW).cast("timestamp")), store.decoded(n.limit(0)), judge=_by_length)
    return decided.groupBy("user_id", "action").agg(F.count("*").alias("n"), F.max("version").alias("versions"), F.sum(F.col("superseded").cast("int")).alias("retired"))


def _by_length(candidate: str, note: str) -> tuple[str, dict]:
    return ("supports", "contradicts", "unrelated", "refines")[(len(candidate) + len(note)) % 4], {}


def _supply(spark, sf) -> DataFrame:
    """Suppliers by the parts that they supply, as one user's file graph: two are linked by as many parts as they share."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return li.select(F.lit("u").alias("user_id"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").alias("via"), F.lit(1.0).alias("w"))


def pagerank(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.lit("u").alias("user_id"), F.col("s_suppkey").cast("string").alias("file"))
    seeds = nodes.filter("file = '1'")
    return graph.pagerank_large(nodes, _supply(spark, sf), seeds).select("file", F.round("score", 6).alias("score"))


def _judged(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("instance_id"), F.element_at(F.array(F.lit("easy"), F.lit("medium")), (F.col("item_id") % 2 + 1).cast("int")).alias("tier"))
    top = bm25.rank_documents(notes(spark, sf), requests(spark, sf), 5).withColumn("doc_id", F.col("id").cast("long"))
    lab = table(spark, sf, "labels")
    grade = F.when(F.col("quality") == 0, "none").when(F.col("toxic") == 1, "weak").when(F.col("quality") == 1, "strong").otherwise("none")
    return t, top.join(lab, "doc_id", "left").select(F.col("query_id").alias("instance_id"), "rank", grade.alias("relevance"))


def eval_metrics_by_tier(spark, sf):
    t, hits = _judged(spark, sf)
    out = evaluate.summary(evaluate.task_metrics(t, hits))
    return out.select("tier", "n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "hit1", "mrr")])


def relevance_join(spark, sf):
    diff = lambda n: F.concat(F.lit("diff --git a/src/f"), F.col("doc_id") % n, F.lit(".py b/x\n"))
    d = table(spark, sf, "labels")
    tasks = evaluate.tasks(d.filter("doc_id % 50 = 0").select(F.col("doc_id").cast("string").alias("instance_id"), F.concat(F.lit("r"), F.col("doc_id") % 4).alias("repo"), F.lit("").alias("problem_statement"), diff(9).alias("patch")))
    exps = d.select(F.col("doc_id").cast("string").alias("instance_id"), F.concat(F.lit("r"), F.col("doc_id") % 4).alias("repo"), F.array(text.source_path(F.concat(F.lit("./swebench_9_15/testbed/src/f"), F.col("doc_id") % 5, F.lit(".py")))).alias("source_files"))
    return evaluate.relevance(tasks, exps).groupBy("instance_id", "relevance").agg(F.count("*").alias("n"))


def eval_run(spark, sf):
    """From tasks (benchmark items) over experiences (documents) by search, labels and metrics to the summary."""
    b = table(spark, sf, "benchmark")
    diff = F.concat(F.lit("diff --git a/src/f"), F.col("item_id") % 9, F.lit(".py b/x\n"))
    rows = b.select("item_id", F.concat(F.lit("t"), F.col("item_id")).alias("instance_id"), F.concat(F.lit("org/r"), F.col("item_id") % 4).alias("repo"), F.col("text").alias("problem_statement"), diff.alias("patch"))
    users = b.select(F.concat(F.lit("t"), F.col("item_id")).alias("instance_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("user_id"))
    tasks = evaluate.tasks(rows).join(users, "instance_id")
    d = table(spark, sf, "documents")
    paths = F.array(F.concat(F.lit("./swebench_9_15/testbed/src/f"), F.col("doc_id") % 5, F.lit(".py")), F.lit("src/tests/test_x.py"))
    known = evaluate.experiences(d.select(F.concat(F.lit("e"), F.col("doc_id")).alias("instance_id"), F.concat(F.lit("org/r"), F.floor(F.col("doc_id") / 20) % 4).alias("repo"), paths.alias("paths")))
    marked = notes(spark, sf).withColumn("content", F.concat(F.lit("[e"), "id", F.lit("] "), "content"))
    _, found = evaluation.run(tasks, known, marked, now())
    return found.select("tier", "n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "hit1", "mrr")])


def session_windows(spark, sf):
    from .streaming.ingest import sessions

    s = sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return s.select("user_id", "began", "n")


QUERIES = {
    f.__name__: f
    for f in (
        search_pipeline, search_symbols, tokenize_terms, fingerprint_dups, word_overlap, first_sentence, scan_recent_per_user, scan_by_type, upsert_latest_version, validate_rejects, transcript_events, events_to_text,
        segment_idle, segment_todo, segment_caps, bm25_scores, bm25_topk, cosine_topk, temporal_decay, hybrid_rank, utility_rerank, gate_package, package_levels, near_duplicate, revision_fold, revision_judged,
        upsert_history, pagerank, eval_metrics_by_tier, eval_run, relevance_join, session_windows,
    )
} | session_queries.QUERIES | store_queries.QUERIES

_DECAY = "exp(-0.0077 * greatest(0, (epoch_us(TIMESTAMP '2025-03-01') - epoch_us(created_at)) / 86400e6))"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'), lambda w: {}))"
_MSG = "msgs AS (SELECT conv_id::VARCHAR AS session_id, turn, role, trim(text, E' \\n\\t\\r') AS text FROM conversations WHERE text <> '')"
_HYBRID = f"""WITH {NOTES}, {REQUESTS}, {BM25},
  raw AS (SELECT q.query_id, n.*, coalesce(bm25, 0) + CASE memory_type WHEN 'event' THEN 0.3 * 0.6 WHEN 'record' THEN 0.3 ELSE 0 END AS raw
    FROM requests q JOIN notes n USING (user_id) LEFT JOIN bm25 USING (query_id, user_id, id)),
  scored AS (SELECT *, (raw - min(raw) OVER (PARTITION BY query_id)) * greatest(0.5, {_DECAY}) AS score FROM raw),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank FROM scored QUALIFY rank <= 25)"""
_OVER = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"
_UTILITY = f"""{_HYBRID},
  sets AS (SELECT ranked.*, query, {_WORDS.format('query', 'len(w) > 1')} AS q, {_WORDS.format("substr(content, 1, 60) || ' ' || substr(content, 1, 30) || ' ' || substr(content, 1, 400)", 'len(w) > 1')} AS act,
      {_WORDS.format("substr(content, 61, 60) || ' '", 'len(w) > 1')} AS risk, ['the', lang] AS scope FROM ranked JOIN requests USING (query_id)),
  used AS (SELECT *, 0.35 * ({_OVER('q', 'act')}) + 0.25 * ({_OVER('q', 'risk')}) + 0.2 * CASE WHEN list_has_any(scope, q) THEN 1.0 WHEN contains(lower(query), 'the') OR contains(lower(query), lang) THEN 0.3 ELSE 0 END
      + 0.1 * greatest(0.1, {_DECAY}) + 0.1 * CASE memory_type WHEN 'event' THEN 0.6 WHEN 'record' THEN 1.0 ELSE 0 END AS utility FROM sets)"""
#: Without intent weights: no type bonus, no type weight, an open gate. {0}: results, {1}: recalled at most, a request.
_FOUND = f"""WITH RECURSIVE {NOTES}, {REQUESTS}, {BM25},
  sizes AS (SELECT user_id, count(*) AS notes_ FROM notes GROUP BY user_id),
  raw AS (SELECT q.query_id, n.*, coalesce(bm25, 0) AS raw, notes_ FROM requests q JOIN notes n USING (user_id) JOIN sizes USING (user_id) LEFT JOIN bm25 USING (query_id, user_id, id)),
  scored AS (SELECT *, (raw - min(raw) OVER (PARTITION BY query_id)) * greatest(0.5, {_DECAY}) AS score FROM raw),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id) AS rank FROM scored QUALIFY rank <= greatest({{0}}, least({{1}}, notes_)))"""
_CHOSEN = f"""
  sets AS (SELECT found.*, query, {_WORDS.format('query', 'len(w) > 1')} AS q, {_WORDS.format("substr(content, 1, 60) || ' ' || substr(content, 1, 30) || ' ' || substr(content, 1, 400)", 'len(w) > 1')} AS act,
      {_WORDS.format("substr(content, 61, 60) || ' '", 'len(w) > 1')} AS risk, ['the', lang] AS scope FROM found JOIN requests USING (query_id)),
  used AS (SELECT *, 0.35 * ({_OVER('q', 'act')}) + 0.25 * ({_OVER('q', 'risk')}) + 0.2 * CASE WHEN list_has_any(scope, q) THEN 1.0 WHEN contains(lower(query), 'the') OR contains(lower(query), lang) THEN 0.3 ELSE 0 END
      + 0.1 * greatest(0.1, {_DECAY}) AS utility FROM sets)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, score DESC, rank) AS final_rank, id, round(score, 4) AS score, round(utility, 6) AS utility, memory_type FROM used"""
#: The same for tasks over notes whose content begins with a marker that their cards haven't.
_EVALUATED = (
    _FOUND.format(5, 25).replace(", text AS content, ", ", '[e' || doc_id || '] ' || text AS content, text AS body, ").replace("text AS query FROM", "trim('r' || item_id % 4 || ' ' || substr(text, 1, 600), E' \\n\\t\\r') AS query FROM")
    + ", found AS (SELECT * FROM ranked),"
    + _CHOSEN.replace("substr(content, 1, 60)", "substr(body, 1, 60)").replace("substr(content, 1, 30)", "substr(body, 1, 30)").replace("substr(content, 61, 60)", "substr(body, 61, 60)").replace("\n  SELECT query_id,", ", top AS (SELECT doc_id, query_id,")
    + " QUALIFY final_rank <= 5)"
)
#: PageRank from each request's own seeds: the files of its 20 best notes. Requests name no file or symbol.
_LIFTED = """,
  file AS (SELECT DISTINCT user_id, 'src/g' || (doc_id % 211) || '.py' AS file FROM notes),
  def AS (SELECT DISTINCT user_id, 'src/g' || (doc_id % 211) || '.py' AS file, doc_id % 31 AS name FROM notes),
  edge AS (SELECT a.user_id, a.file AS src, b.file AS dst, count(*)::DOUBLE AS w FROM def a JOIN def b ON a.user_id = b.user_id AND a.name = b.name AND a.file <> b.file GROUP BY ALL),
  total AS (SELECT user_id, src, sum(w) AS total FROM edge GROUP BY ALL),
  many AS (SELECT user_id, count(*) AS n FROM file GROUP BY ALL),
  move AS (SELECT user_id, src, dst, 0.85 * w / total AS p FROM edge JOIN total USING (user_id, src)
    UNION ALL SELECT a.user_id, a.file, b.file, 0.85 / (n - 1) FROM file a JOIN file b ON a.user_id = b.user_id AND a.file <> b.file JOIN many ON many.user_id = a.user_id ANTI JOIN total ON total.user_id = a.user_id AND total.src = a.file
    UNION ALL SELECT user_id, file, file, NULL FROM file),
  seed AS (SELECT DISTINCT query_id, 'src/g' || (doc_id % 211) || '.py' AS file FROM ranked WHERE rank <= 20),
  seeds AS (SELECT query_id, count(*) AS k FROM seed GROUP BY ALL),
  start AS (SELECT query_id, user_id, f.file, CASE WHEN s.file IS NULL THEN 0.0 ELSE 1.0 / k END AS p0, s.file IS NOT NULL AS is_seed
    FROM requests JOIN seeds USING (query_id) JOIN file f USING (user_id) LEFT JOIN seed s USING (query_id, file)),
  walk(i, query_id, user_id, file, rk) AS (SELECT 0, query_id, user_id, file, 1.0::DOUBLE / n FROM start JOIN many USING (user_id)
    UNION ALL SELECT w.i + 1, w.query_id, w.user_id, m.dst, sum(CASE WHEN m.p IS NULL THEN 0.15 * s.p0 ELSE w.rk * m.p END)
      FROM walk w JOIN move m ON m.user_id = w.user_id AND m.src = w.file JOIN start s ON s.query_id = w.query_id AND s.file = m.dst WHERE w.i < 40 GROUP BY w.i, w.query_id, w.user_id, m.dst),
  related AS (SELECT query_id, file FROM walk JOIN start USING (query_id, user_id, file) WHERE i = 40 AND NOT is_seed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rk, 10) DESC, file) <= 10),
  found AS (SELECT ranked.* REPLACE (ranked.score + CASE WHEN related.file IS NULL THEN 0 ELSE 0.15 END AS score) FROM ranked LEFT JOIN related ON related.query_id = ranked.query_id AND related.file = 'src/g' || (doc_id % 211) || '.py'),"""
_L1 = "concat_ws(E'\\n', CASE WHEN substr(content, 1, 60) <> '' THEN 'action: ' || substr(content, 1, 60) END, 'files: src/f' || (doc_id % 7) || '.py', CASE WHEN substr(content, 61, 60) <> '' THEN 'risk: ' || substr(content, 61, 60) END)"
_EDGES = """supply AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
  edges AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS w FROM supply a JOIN supply b USING (l_partkey) WHERE a.l_suppkey <> b.l_suppkey GROUP BY ALL)"""
_ACTIONS = "a AS (SELECT user_id, event_id, event_type, ts, row_number() OVER w AS rn, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"

ORACLES = {
    # every recalled note's file is a seed there, and related files are none of the seeds: nothing is lifted
    "search_pipeline": f"{_FOUND.format(5, 25)}, found AS (SELECT * FROM ranked), {_CHOSEN} QUALIFY final_rank <= 5",
    "search_symbols": f"{_FOUND.format(20, 40)}{_LIFTED}{_CHOSEN} QUALIFY final_rank <= 20",
    "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({_tokens_sql('text')}) AS term FROM documents) GROUP BY term",
    "fingerprint_dups": "SELECT * FROM (SELECT sha256(concat(source, chr(0), text)) AS fingerprint, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1) WHERE copies > 1",
    "word_overlap": f"""WITH {NOTES}, {REQUESTS}, s AS (SELECT query_id, id, {_WORDS.format('query', "w <> ''")} AS a, {_WORDS.format('content', "w <> ''")} AS b, {_WORDS.format('query', 'len(w) > 1')} AS c, {_WORDS.format('content', 'len(w) > 1')} AS d FROM requests JOIN notes USING (user_id)),
      j AS (SELECT *, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END AS j FROM s)
      SELECT query_id, id, round(j, 6) AS jaccard, round({_OVER('c', 'd')}, 6) AS overlap, CASE WHEN j >= 0.85 THEN 'duplicate' WHEN j >= 0.4 THEN 'supports' ELSE 'unrelated' END AS relation FROM j""",
    "first_sentence": r"""WITH t AS (SELECT doc_id, trim(text, E' \n\t\r') AS t FROM documents)
      SELECT doc_id, CASE WHEN contains(t, '. ') THEN substr(t, 1, instr(t, '. ')) WHEN contains(t, E'.\n') THEN substr(t, 1, instr(t, E'.\n')) WHEN contains(t, E'!\n') THEN substr(t, 1, instr(t, E'!\n'))
        WHEN contains(t, E'?\n') THEN substr(t, 1, instr(t, E'?\n')) WHEN contains(t, E'\n') THEN trim(substr(t, 1, instr(t, E'\n')), E' \n\t\r') ELSE substr(t, 1, 300) END AS sentence FROM t""",
    "scan_recent_per_user": f"WITH {NOTES} SELECT user_id, id, created_at FROM notes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 10",
    "scan_by_type": f"WITH {NOTES} SELECT user_id, count(*) AS n, max(created_at) AS newest FROM notes WHERE memory_type = 'event' GROUP BY ALL",
    "upsert_latest_version": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "validate_rejects": r"SELECT conv_id, CASE WHEN count(*) FILTER (role NOT IN ('user', 'assistant')) > 0 THEN 'role' WHEN count(*) FILTER (trim(text, E' \n\t\r') = '') > 0 THEN 'content' ELSE 'ok' END AS reason FROM conversations GROUP BY conv_id",
    "transcript_events": f"WITH {_MSG} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS event_index, role, 'text' AS kind, text FROM msgs",
    "events_to_text": f"WITH {_MSG} SELECT session_id, coalesce(string_agg('[' || role || '] ' || text, E'\\n' ORDER BY turn) FILTER (text <> ''), '') AS segment_text FROM msgs GROUP BY session_id",
    "segment_idle": f"WITH {_ACTIONS} SELECT user_id, event_id, sum(CASE WHEN epoch_us(ts) - epoch_us(before) > 21600e6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn)::INT AS segment_id FROM a",
    "segment_todo": f"WITH {_ACTIONS} SELECT user_id, event_id, sum(CASE WHEN rn > 1 AND event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn)::INT AS segment_id FROM a",
    "segment_caps": r"""WITH RECURSIVE m AS (SELECT conv_id, turn, row_number() OVER w AS rn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words,
        count(*) OVER (PARTITION BY conv_id) > 3 OR sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) OVER (PARTITION BY conv_id) > 60 AS large FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      f(conv_id, turn, rn, seg, n, w) AS (SELECT conv_id, turn, rn, 0, 1, words FROM m WHERE rn = 1
        UNION ALL SELECT m.conv_id, m.turn, m.rn, CASE WHEN large AND (n >= 3 OR w + words > 60) THEN seg + 1 ELSE seg END, CASE WHEN large AND (n >= 3 OR w + words > 60) THEN 1 ELSE n + 1 END,
          CASE WHEN large AND (n >= 3 OR w + words > 60) THEN words ELSE w + words END FROM f JOIN m ON m.conv_id = f.conv_id AND m.rn = f.rn + 1)
      SELECT conv_id, turn, seg AS segment_id FROM f""",
    "bm25_scores": f"WITH {NOTES}, {REQUESTS}, {BM25} SELECT query_id, id, round(bm25, 4) AS bm25 FROM bm25",
    "bm25_topk": f"""WITH {NOTES}, {REQUESTS}, {BM25}, s AS (SELECT query_id, id, coalesce(bm25, 0) - min(coalesce(bm25, 0)) OVER (PARTITION BY query_id) AS score FROM requests JOIN notes USING (user_id) LEFT JOIN bm25 USING (query_id, user_id, id))
      SELECT query_id, id, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "cosine_topk": """WITH c AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c QUALIFY rank <= 5""",
    "temporal_decay": f"WITH {NOTES} SELECT id, round(greatest(0.5, {_DECAY}), 6) AS decay, round(greatest(0.1, {_DECAY}), 6) AS recency FROM notes",
    "hybrid_rank": f"{_HYBRID} SELECT query_id, id, round(score, 4) AS score FROM ranked",
    "utility_rerank": f"{_UTILITY} SELECT query_id, id, round(utility, 6) AS utility FROM used",
    "gate_package": f"""{_HYBRID}, m AS (SELECT query_id, list_sort(list(round(score, 4)))[len(list(score)) // 2 + 1] AS median FROM ranked GROUP BY query_id)
      SELECT query_id, id, sha256({_L1}) AS packaged FROM ranked JOIN m USING (query_id) WHERE memory_type <> 'profile' OR round(score, 4) >= median""",
    "package_levels": rf"""WITH {NOTES}, t AS (SELECT *, '→ ' || substr(content, 1, 60) AS l0, {_L1} AS l1, trim(content, E' \n\t\r') AS body FROM notes)
      SELECT id, CASE WHEN content = '' THEN content ELSE l0 END AS l0, sha256(l1) AS l1, CASE WHEN body = '' THEN length(l1) ELSE length(l1) + 5 + length(body) END AS l2_chars FROM t""",
    "near_duplicate": f"""WITH {NOTES}, {REQUESTS}, {BM25}, s AS (SELECT query_id, coalesce(bm25, 0) AS b FROM requests JOIN notes USING (user_id) LEFT JOIN bm25 USING (query_id, user_id, id)),
      h AS (SELECT query_id, max(b) AS hi, min(b) AS lo FROM s GROUP BY 1), o AS (SELECT query_id, hi, lo, avg(b) FILTER (b < hi) AS others FROM s JOIN h USING (query_id) GROUP BY ALL)
      SELECT query_id, CASE WHEN hi - lo < 1e-9 THEN hi > 0 ELSE coalesce((hi - others) / greatest(abs(hi), abs(others), 1e-9) >= 0.85, true) END AS near_duplicate FROM o""",
    "pagerank": f"""WITH RECURSIVE {_EDGES}, o AS (SELECT src, sum(w) AS total FROM edges GROUP BY src), n AS (SELECT count(*) AS n FROM supplier),
      r(i, file, rk) AS (SELECT 0, s_suppkey, 1.0::DOUBLE / n FROM supplier, n
        UNION ALL SELECT i, file, rk / sum(rk) OVER () FROM (SELECT r.i + 1 AS i, x.file, sum(x.p) AS rk FROM r JOIN (
          SELECT e.src, e.dst AS file, 0.85 * e.w / o.total AS p FROM edges e JOIN o USING (src)
          UNION ALL SELECT a.s_suppkey, b.s_suppkey, 0.85 / (n.n - 1) FROM supplier a, supplier b, n WHERE a.s_suppkey NOT IN (SELECT src FROM o) AND a.s_suppkey <> b.s_suppkey
          UNION ALL SELECT s_suppkey, 1, NULL FROM supplier) x0(src, file, p) ON r.file = x0.src, LATERAL (SELECT x0.file, CASE WHEN x0.p IS NULL THEN 0.15 * r.rk ELSE r.rk * x0.p END AS p) x WHERE r.i < 40 GROUP BY r.i, x.file))
      SELECT file::VARCHAR AS file, round(rk, 6) AS score FROM r WHERE i = 40""",
    "eval_metrics_by_tier": f"""WITH {NOTES}, {REQUESTS}, {BM25}, s AS (SELECT query_id, id, coalesce(bm25, 0) - min(coalesce(bm25, 0)) OVER (PARTITION BY query_id) AS score FROM requests JOIN notes USING (user_id) LEFT JOIN bm25 USING (query_id, user_id, id)),
      top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5),
      g AS (SELECT query_id, rank, CASE WHEN quality = 0 THEN 'none' WHEN toxic = 1 THEN 'weak' WHEN quality = 1 THEN 'strong' ELSE 'none' END AS rel FROM top LEFT JOIN labels ON doc_id = id::BIGINT),
      a AS (SELECT query_id, max((rel = 'strong')::INT) AS recall, sum((rel <> 'none')::INT) / count(*) AS prec, max((rel = 'strong' AND rank = 1)::INT) AS hit1, 1.0 / min(rank) FILTER (rel = 'strong') AS rr FROM g GROUP BY 1),
      t AS (SELECT CASE item_id % 2 WHEN 0 THEN 'easy' ELSE 'medium' END AS tier, coalesce(recall, 0) AS recall, coalesce(prec, 0) AS prec, coalesce(hit1, 0) AS hit1, coalesce(rr, 0) AS rr FROM benchmark LEFT JOIN a ON query_id = item_id::VARCHAR),
      u AS (SELECT 'all' AS tier, * EXCLUDE tier FROM t UNION ALL FROM t)
      SELECT tier, count(recall) AS n, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(prec), 0), 6) AS precision, round(coalesce(avg(hit1), 0), 6) AS hit1, round(coalesce(avg(rr), 0), 6) AS mrr
      FROM (VALUES ('all'), ('easy'), ('medium'), ('hard')) v(tier) LEFT JOIN u USING (tier) GROUP BY tier""",
    "eval_run": f"""{_EVALUATED},
      g AS (SELECT query_id, final_rank AS rank, CASE WHEN query_id::BIGINT % 4 <> doc_id // 20 % 4 THEN 'none' WHEN query_id::BIGINT % 9 = doc_id % 5 THEN 'strong' ELSE 'weak' END AS rel FROM top),
      a AS (SELECT query_id, max((rel = 'strong')::INT) AS recall, sum((rel <> 'none')::INT) / count(*) AS prec, max((rel = 'strong' AND rank = 1)::INT) AS hit1, 1.0 / min(rank) FILTER (rel = 'strong') AS rr FROM g GROUP BY 1),
      t AS (SELECT 'easy' AS tier, coalesce(recall, 0) AS recall, coalesce(prec, 0) AS prec, coalesce(hit1, 0) AS hit1, coalesce(rr, 0) AS rr FROM benchmark LEFT JOIN a ON query_id = item_id::VARCHAR),
      u AS (SELECT 'all' AS tier, * EXCLUDE tier FROM t UNION ALL FROM t)
      SELECT tier, count(recall) AS n, round(coalesce(avg(recall), 0), 6) AS recall, round(coalesce(avg(prec), 0), 6) AS precision, round(coalesce(avg(hit1), 0), 6) AS hit1, round(coalesce(avg(rr), 0), 6) AS mrr
      FROM (VALUES ('all'), ('easy'), ('medium'), ('hard')) v(tier) LEFT JOIN u USING (tier) GROUP BY tier""",
    "relevance_join": """SELECT t.doc_id::VARCHAR AS instance_id, CASE WHEN t.doc_id % 9 = e.doc_id % 5 THEN 'strong' ELSE 'weak' END AS relevance, count(*) AS n FROM labels t JOIN labels e ON t.doc_id % 4 = e.doc_id % 4 WHERE t.doc_id % 50 = 0 GROUP BY ALL""",
    "session_windows": """WITH a AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600e6 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""",
} | session_queries.ORACLES | store_queries.oracles(BM25)
