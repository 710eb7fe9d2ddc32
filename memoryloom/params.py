"""All tunables in one place; every operator takes them as an argument."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    # recall
    top_k: int = 100
    recall_multiplier: int = 5
    type_bonus: float = 0.3
    temporal_decay: float = 0.0077
    temporal_floor: float = 0.5
    dense_anchor: str = "query"  # or "first_note": anchor the dense tie-break on the newest note
    # utility
    w_action_relevance: float = 0.35
    w_failure_match: float = 0.25
    w_scope_match: float = 0.20
    w_recency: float = 0.10
    w_type_weight: float = 0.10
    # segmentation
    chunk_max_messages: int = 30
    chunk_max_words: int = 3000
    chunk_boundary_on_todo: bool = True
    idle_gap_seconds: float = 600.0
    # revision
    near_dup_threshold: float = 0.85
    dedup_neighbor_cap: int = 100
    revision_sim_threshold: float = 0.78
    jaccard_duplicate: float = 0.85
    jaccard_supports: float = 0.4
    exact_dedup_scope: str = "recent"  # or "all": against every stored note of the user
    # graph
    pagerank_edited_boost: float = 50.0  # the same for every seed, so it cancels out when normalised
    pagerank_damping: float = 0.85
    pagerank_iterations: int = 40
    pagerank_top_n: int = 10
    symbol_expand_enabled: bool = True
    symbol_boost: float = 0.15
    # packaging
    default_granularity: str = "L1"
    l0_max_chars: int = 160
    # adapters and rendering
    embedding_dim: int = 1536
    llm_failure_threshold: int = 3
    transcript_tool_result_cap: int = 1200
    transcript_max_segment_chars: int = 8000
    # BM25
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    @classmethod
    def from_conf(cls, spark: SparkSession, prefix: str = "memoryloom.", **overrides) -> Params:
        """Defaults, then session settings memoryloom.<name>, then overrides."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(prefix + f.name, None)
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() == "true" if kind is bool else kind(value)
        return replace(cls(), **found, **overrides)


DEFAULT = Params()
