"""Two-stage ranking: hybrid recall, utility re-ranking, gate and packaging. All windows are per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import cosine, decay, type_bonus, utility, utility_axes
from ..functions.text import strip, text_of
from ..params import DEFAULT, Params
from ..sources.checkpoints import staged
from . import bm25


def _by_query():
    return Window.partitionBy("query_id")


def _by_vectors(index: bm25.Index, matched: DataFrame, queries: DataFrame, now: Column, params: Params, apply_decay: bool) -> DataFrame:
    """Every note of each query's user with raw score and cosine: vectors break ties among all of them."""
    narrow = index.docs.select("user_id", "id", "memory_type", "created_at", "embedding")
    scored = queries.withColumnRenamed("embedding", "_q").join(narrow, "user_id").join(matched, ["query_id", "user_id", "id"], "left")
    raw = F.coalesce("bm25", F.lit(0.0)) + type_bonus(F.col("weights"), F.col("memory_type"), params)
    shifted = scored.withColumn("_raw", raw).withColumn("_least", F.min("_raw").over(_by_query()))
    if params.dense_anchor == "first_note":
        newest = _by_query().orderBy(F.desc("created_at"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        shifted = shifted.withColumn("_q", F.first("embedding").over(newest))
    return shifted.withColumn("dense", cosine(F.col("_q"), F.col("embedding")))


def _by_lists(index: bm25.Index, matched: DataFrame, queries: DataFrame, params: Params) -> DataFrame:
    """The notes that share a term with a query, and as many of the others as may be wanted, with raw score.

    Without vectors notes of one type that share no term come newest first: the first of each type are enough. How many
    notes of each type there are, and how many matched, tells whether another one has the least raw score.
    """
    docs = index.docs.select("user_id", "id", F.coalesce("memory_type", F.lit("")).alias("memory_type"), "created_at", F.col("created_at").isNull().alias("_undated"))
    docs = docs.join(queries.select("user_id").distinct(), "user_id", "left_semi")  # of those who ask
    kinds = ["user_id", "memory_type", "_undated"]
    met = staged(matched.join(docs, ["user_id", "id"]), "met")
    counted = met.groupBy("query_id", "memory_type", "_undated").agg(F.count("*").alias("_met"))
    sizes = docs.groupBy(*kinds).agg(F.count("*").alias("_notes"))
    reach = queries.select("query_id", "user_id", "weights", "_n").join(sizes, "user_id").join(counted, ["query_id", "memory_type", "_undated"], "left").fillna(0, ["_met"])
    reach = staged(reach, "reach")
    bonus = type_bonus(F.col("weights"), F.col("memory_type"), params)
    lists = bm25.placed(docs, kinds, [F.desc("created_at"), F.col("id").asc()])
    wanted = reach.filter("_met < _notes").select("query_id", *kinds, F.least(F.col("_met") + F.coalesce("_n", F.col("_notes")), F.col("_notes")).alias("reach"))
    others = bm25.first_others(wanted, lists, matched, kinds)
    every = met.select("query_id", *kinds, "id", "created_at", "bm25").unionByName(others.select("query_id", *kinds, "id", "created_at", F.lit(0.0).alias("bm25")))
    every = staged(every.join(queries.select("query_id", "weights", "_n"), "query_id").withColumn("_raw", F.col("bm25") + bonus), "recallable")
    low = every.groupBy("query_id").agg(F.min("_raw").alias("_low"))
    free = reach.filter("_met < _notes").groupBy("query_id").agg(F.min(bonus).alias("_free"))
    least = staged(low.join(free, "query_id", "left").select("query_id", F.least("_low", "_free").alias("_least")), "least")
    return every.join(least, "query_id").withColumn("dense", F.lit(0.0))


def hybrid_rank(notes: DataFrame, queries: DataFrame, now: Column, params: Params = DEFAULT, top_n: Column | None = None, apply_decay: bool = True, index: bm25.Index | None = None, vectors: bool = True) -> DataFrame:
    """Stage 1: every active note of a query's user, by (BM25 + type bonus - their minimum) * decay.

    notes: user_id, id, content, memory_type, created_at, embedding; queries: query_id, user_id, query, embedding and
    weights (map of memory type to intent weight). Ties go to the note nearest to the query's vector (or, with
    dense_anchor first_note, to the newest note's), then the newest, then the least id. top_n per query: None keeps all.

    index: the stored one, if there is one; else the notes are tokenised here. vectors=False says that there are none to
    break ties: then a query meets only notes that share a term with it and the first of the others.
    """
    index = index or bm25.index_of(notes)
    asked = staged(queries.select("query_id", "user_id", "weights", "embedding", (F.lit(None).cast("int") if top_n is None else top_n).alias("_n")), "asked")
    matched = staged(bm25.scores(index, queries, params=params), "matched")
    found = _by_vectors(index, matched, asked, now, params, apply_decay) if vectors else _by_lists(index, matched, asked, params)
    aged = decay(F.col("created_at"), now, params) if apply_decay else F.lit(1.0)
    found = found.withColumn("score", (F.col("_raw") - F.col("_least")) * aged)
    ranked = found.withColumn("rank", F.row_number().over(_by_query().orderBy(bm25.descending("score"), bm25.descending("dense"), F.desc("created_at"), "id")))
    columns = ["user_id", "id", "query_id", "weights", "score", "dense", "rank"]
    if top_n is None:
        return ranked.select(*columns).join(notes, ["user_id", "id"])
    # a bound that the planner sees: each task keeps the first of its rows alone, and no query's rows are shuffled whole
    most = asked.agg(F.max("_n")).first()[0] or 0
    ranked = ranked.filter((F.col("rank") <= F.lit(int(most))) & (F.col("rank") <= F.col("_n")))
    # of a size that the planner knows: few rows go to the notes, whose texts aren't shuffled for them
    return staged(ranked.select(*columns), "ranked").join(notes, ["user_id", "id"])


def recall_size(k: Column, n: Column, params: Params = DEFAULT) -> Column:
    return F.greatest(k, F.least(params.recall_multiplier * k, n))


def rerank(candidates: DataFrame, now: Column, params: Params = DEFAULT, scorer=None) -> DataFrame:
    """Stage 2: candidates (query, content, card, created_at, memory_type, weights, score, rank) by utility.

    The stage-1 score stays as score; ties keep its order. A utility has no sums in a changing order, so its digits all
    count, unlike a score's. scorer: a function from (query, card, content) columns to
    a struct of the first four axes, null where it has none; then the deterministic axes are used.
    """
    weight = F.element_at("weights", F.col("memory_type"))
    axes = utility_axes(F.col("query"), F.col("card"), F.col("content"), F.col("created_at"), weight, now, params)
    if scorer is not None:
        candidates = candidates.withColumn("_judged", scorer(F.col("query"), F.col("card"), F.col("content")))
        clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        axes |= {k: F.coalesce(clamp(F.col("_judged")[k]), axes[k]) for k in ("action_relevance", "failure_match", "scope_match", "recency")}
    out = candidates.withColumn("utility", utility(axes, params))
    return out.withColumn("final_rank", F.row_number().over(_by_query().orderBy(F.desc("utility"), bm25.descending("score"), "rank"))).drop("_judged")


def gate(results: DataFrame, keep_min: int = 1) -> DataFrame:
    """Without weights all stay; else a result stays if its type's weight isn't given as 0 or less, or if its score is at
    least the upper median. If fewer than keep_min stay, all do."""
    at = F.row_number().over(_by_query().orderBy("score"))
    placed = results.withColumns({"_at": at, "_n": F.count("*").over(_by_query())})
    weight = F.element_at("weights", F.col("memory_type"))
    upper = F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2) + 1, F.col("score"))).over(_by_query())
    marked = placed.withColumn("_median", upper).drop("_at", "_n")
    passes = (F.coalesce(F.size("weights"), F.lit(0)) <= 0) | F.coalesce(weight > 0, F.lit(True)) | (F.col("score") >= F.col("_median"))
    marked = marked.withColumn("_passes", passes).withColumn("_kept", F.sum(F.col("_passes").cast("int")).over(_by_query()))
    return marked.filter(F.col("_passes") | (F.col("_kept") < keep_min)).drop("_median", "_passes", "_kept")


def _line(label: str, c: Column) -> Column:
    return F.when(text_of(c) != "", F.concat(F.lit(label), c))


def _listed(label: str, c: Column) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, 8), ", ")))


def level0(card: Column, content: Column, params: Params = DEFAULT) -> Column:
    hint = F.when(text_of(card["action_hint"]) != "", F.concat(F.lit("→ "), card["action_hint"]))
    parts = F.concat_ws(" ", F.when(text_of(card["instance_id"]) != "", F.concat(F.lit("["), card["instance_id"], F.lit("]"))), F.nullif(text_of(card["trigger"]), F.lit("")), hint)
    text = F.coalesce(F.nullif(parts, F.lit("")), F.nullif(text_of(card["gist"]), F.lit("")), content)
    cut = F.concat(F.regexp_replace(F.substring(text, 1, params.l0_max_chars - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(text) > params.l0_max_chars, cut).otherwise(text)


def level1(card: Column) -> Column:
    lines = F.concat_ws(
        "\n", _line("instance: ", card["instance_id"]), _line("trigger: ", card["trigger"]), _line("root_cause: ", card["root_cause"]),
        _line("action: ", card["action_hint"]), _listed("files: ", card["files_symbols"]), _line("risk: ", card["failure_if_ignored"]),
    )
    return F.when(lines != "", lines).otherwise(F.concat_ws("\n", _line("", card["gist"]), _listed("entities: ", card["entities"])))


def package(card: Column, content: Column, level: Column, params: Params = DEFAULT) -> Column:
    """The text of a result at granularity L0, L1 or L2; other levels mean the default, notes without card their content."""
    wanted = F.when(F.upper(level).isin("L0", "L1", "L2"), F.upper(level)).otherwise(params.default_granularity)
    head, body = level1(card), strip(content)
    full = F.when((head != "") & (body != ""), F.concat(head, F.lit("\n---\n"), body)).otherwise(F.coalesce(F.nullif(body, F.lit("")), head))
    return F.when(card.isNull(), content).when(wanted == "L0", level0(card, content, params)).when(wanted == "L2", full).otherwise(F.coalesce(F.nullif(head, F.lit("")), content))


def near_duplicate_flags(scores: DataFrame, sizes: DataFrame, candidate: str = "query_id", threshold: float = DEFAULT.near_dup_threshold) -> DataFrame:
    """(candidate, near_duplicate) from its BM25 scores (column bm25) against the notes that share a term with it, and the
    number n of all notes (sizes: candidate, n), the others scoring 0: the best one dominates the mean of those below it;
    scores that are all alike count if they are positive. Candidates without notes have no row."""
    met = scores.groupBy(candidate).agg(F.max("bm25").alias("_hi"), F.min("bm25").alias("_lo"), F.count("*").alias("_met"))
    every = sizes.filter("n > 0").join(met, candidate, "left").fillna(0, ["_met"]).withColumn("_zeros", F.col("n") - F.col("_met"))
    zero = F.when(F.col("_zeros") > 0, F.lit(0.0))
    every = every.select(candidate, "_zeros", F.greatest("_hi", zero).alias("_hi"), F.least("_lo", zero).alias("_lo"))
    below = scores.join(every.select(candidate, "_hi"), candidate).filter("bm25 < _hi").groupBy(candidate).agg(F.sum("bm25").alias("_sum"), F.count("*").alias("_below"))
    zeros = F.when(F.col("_hi") > 0, F.col("_zeros")).otherwise(0)
    rest = every.join(below, candidate, "left").fillna(0, ["_sum", "_below"]).withColumn("_others", F.try_divide(F.col("_sum"), F.col("_below") + zeros))
    dominance = (F.col("_hi") - F.col("_others")) / F.greatest(F.abs("_hi"), F.abs("_others"), F.lit(1e-9))
    return rest.select(candidate, F.when(F.col("_hi") - F.col("_lo") < 1e-9, F.col("_hi") > 0).otherwise(F.coalesce(dominance >= threshold, F.lit(True))).alias("near_duplicate"))
