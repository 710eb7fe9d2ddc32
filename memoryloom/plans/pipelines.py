"""The two operations: ingest (transcripts to revised memories) and search (a batch of ranked queries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.adapters import card_reader, classifier, embedder, enhancer, extractor, utility_scorer
from ..functions.card import content_of, heuristic_card, profile_pairs
from ..functions.text import memory_id, seed_files, strip
from ..operators import bm25, graph, rank, revise, segment, transcript
from ..params import DEFAULT, Params
from ..sources import store as stores
from ..sources.checkpoints import staged

_SESSION = ["user_id", "session_id", "request_id"]


def cards_of_events(events: DataFrame, now: Column, params: Params = DEFAULT, embed=None, extract=None) -> DataFrame:
    """One candidate note for each segment: two shuffles, by session for the segments and (later) by user for the fold.

    extract: a model's reply to a segment's text and its context (see adapters.extractor); where it has none that can be
    read, the card is the heuristic one. A profile card has the pairs that the text shows, whoever wrote it.
    """
    parts = segment.segment_events(events, _SESSION, params=params)
    texts = transcript.render(parts, [*_SESSION, "segment_id"], params).filter("segment_text <> ''")
    context = transcript.task_context(events)
    joined = texts.join(context, _SESSION).withColumn("segment_text", F.substring("segment_text", 1, params.transcript_max_segment_chars))
    card = heuristic_card(F.col("segment_text"), F.col("repo"), F.col("language"), F.col("files_touched"), F.col("base_commit"), F.col("instance_id"))
    if extract is not None:
        joined = joined.withColumn("_reply", extractor(extract, params)(F.col("segment_text"), F.col("repo"), F.col("language"), F.col("files_touched")))
        read = card_reader(F.col("_reply"), F.col("instance_id"), F.concat_ws("/", F.nullif("repo", F.lit("")), F.nullif("language", F.lit(""))), F.col("base_commit"))
        read = F.when(read["memory_type"] == "profile", read.withField("pairs", profile_pairs(F.col("segment_text")))).otherwise(read)
        card = F.coalesce(read, card)
    out = joined.withColumn("card", card).withColumn("content", content_of(F.col("card"), F.col("segment_text")))
    ids = memory_id(*[F.col(c) for c in _SESSION], F.col("segment_id").cast("string"))
    return out.select(*_SESSION, "segment_id", ids.alias("id"), "content", embedder(embed, params)(F.col("content")).alias("embedding"), F.col("card.memory_type").alias("memory_type"), "card", now.cast("timestamp").alias("created_at"), now.cast("timestamp").alias("request_ts"))


def ingest(events: DataFrame, store: stores.Store, now: Column, params: Params = DEFAULT, judge=None, embed=None, extract=None) -> DataFrame:
    """Fold the events' cards into the store. Returns the decisions; replaying the same events adds no rows.

    Cards and decisions are staged, so that models are asked once and all tables hold the same answers. Of inserted record
    segments whose card names files, the symbols of the files they read are stored. All tables change in one commit, or
    none does; where another writer was first, the candidates are decided anew on what it has left.
    """
    candidates = staged(cards_of_events(events, now, params, embed, extract=extract), "candidates")
    users = staged(candidates.select("user_id").distinct(), "users")
    while True:
        with store.change() as change:
            known = change.before.decided(users).withColumnRenamed("candidate_id", "id")
            fresh = candidates.join(known, ["user_id", "id"], "left_anti")
            decisions = staged(revise.revise(fresh, change.before.memories(users), params, judge, embed), "decisions")
            change.write_memories(revise.latest(decisions))
            change.write_decisions(decisions)
            inserted = decisions.filter("action = 'INSERT' and memory_type = 'record' and size(card.files_symbols) > 0").select("user_id", F.col("candidate_id").alias("id"))
            kept = candidates.join(inserted, ["user_id", "id"], "left_semi").select(*_SESSION, "segment_id")
            parts = segment.segment_events(events, _SESSION, params=params)
            bodies = transcript.tool_contents(parts, (*_SESSION, "segment_id")).withColumnRenamed("body", "content")
            symbols = graph.extract_symbols(bodies.join(kept, [*_SESSION, "segment_id"], "left_semi"))
            change.write_file_symbols(stores.nest_symbols(symbols, now.cast("timestamp")))
        if change.made:
            return decisions


def validate_searches(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): user and query must be given, top_k must be 1 or more."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    reason = F.coalesce(F.when(blank("user_id"), "user_id"), F.when(blank("query"), "query"), F.when(F.coalesce(F.col("top_k"), F.lit(0)) < 1, "top_k"))
    marked = queries.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def search(queries: DataFrame, memories: DataFrame, now: Column, symbols: DataFrame | None = None, params: Params = DEFAULT, granularity: str = "L1", enhance=None, classify=None, embed=None, score=None, index: bm25.Index | None = None) -> DataFrame:
    """(query_id, final_rank, id, content, score, utility, memory_type, created_at) for queries (query_id, user_id, query,
    top_k, options); queries of users without memories, and those that validate_searches rejects, have no rows.

    Recall keeps top_k times a multiple of notes, the symbol graph nudges their scores, utility orders them, the first
    top_k pass the gate and are packaged. index: the store's; else the notes are tokenised for this batch. With one, and
    without vectors, no text is read but those of the notes that are recalled.
    """
    active = stores.active(memories)
    ready, _rejected = validate_searches(queries)
    ready = ready.withColumn("weights", classifier(classify, params)(F.col("query"))).withColumn("query", enhancer(enhance, params)(F.col("query"), F.col("options")))
    ready = ready.withColumn("embedding", embedder(embed, params)(F.col("query")))
    if classify or enhance or embed:
        ready = staged(ready, "asked")  # models are asked once
    index = index or bm25.index_of(active)
    ready = ready.join(index.users.select("user_id", F.col("n").alias("_notes")), "user_id").withColumn("_recall", rank.recall_size(F.col("top_k"), F.col("_notes"), params))
    found = rank.hybrid_rank(active, ready, now, params, F.col("_recall"), index=index, vectors=embed is not None)
    if symbols is not None and params.symbol_expand_enabled:
        found, symbols = staged(found, "recalled"), staged(symbols, "symbols")
        named = found.filter(F.col("rank") <= params.recall_multiplier * 10).select("query_id", "user_id", F.explode("card.files_symbols").alias("seed"))
        wanted = ready.select("query_id", "user_id", F.explode(seed_files(F.col("query"))).alias("seed"))
        seeds = named.union(wanted).distinct()
        nodes = symbols.filter("kind = 'def'").select("user_id", "file").distinct()
        asked = seeds.select("query_id", "user_id").distinct().join(nodes.select("user_id").distinct(), "user_id", "left_semi")
        ranked = graph.pagerank(nodes, graph.build_edges(symbols), graph.seed_files(seeds, symbols), params, asked)
        found = graph.boosted(found, graph.related_files(ranked, params), symbols, params)
    found = found.join(ready.select("query_id", "query", "top_k"), "query_id")
    ordered = rank.rerank(found, now, params, utility_scorer(score, params)).filter(F.col("final_rank") <= F.col("top_k"))
    gated = rank.gate(ordered)
    return gated.select("query_id", "user_id", "final_rank", "id", rank.package(F.col("card"), F.col("content"), F.lit(granularity), params).alias("content"), "score", "utility", "memory_type", "created_at")
