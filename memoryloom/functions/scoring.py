"""Scoring expressions: cosine, decay, recency, utility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .text import overlap, scope_tokens, text_of, token_set


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null or empty vectors and for vectors of different lengths."""
    norm = lambda v: F.sqrt(dot(v, v)) + 1e-12
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def age_days(created: Column, now: Column) -> Column:
    """Days from created to now; 0 for null and future times."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86_400e6)
    return F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0))


def decay(created: Column, now: Column, params: Params = DEFAULT) -> Column:
    return F.greatest(F.lit(params.temporal_floor), F.exp(-params.temporal_decay * age_days(created, now)))


def recency(created: Column, now: Column, params: Params = DEFAULT) -> Column:
    """At least 0.1; 0.3 where the time is unknown."""
    return F.when(created.isNull(), F.lit(0.3)).otherwise(F.greatest(F.lit(0.1), F.exp(-params.temporal_decay * age_days(created, now))))


def type_bonus(weights: Column, memory_type: Column, params: Params = DEFAULT) -> Column:
    """weights: map of memory type to intent weight, or null."""
    w = F.coalesce(F.element_at(weights, memory_type), F.lit(0.0))
    return F.when(w > 0, params.type_bonus * w).otherwise(F.lit(0.0))


def utility_axes(query: Column, card: Column, content: Column, created: Column, weight: Column, now: Column, params: Params = DEFAULT) -> dict[str, Column]:
    q = token_set(query)
    actionable = F.concat_ws(" ", text_of(card["action_hint"]), text_of(card["gist"]), F.substring(text_of(content), 1, 400))
    risky = F.concat_ws(" ", text_of(card["failure_if_ignored"]), text_of(card["trigger"]))
    scope = scope_tokens(card["scope"])
    inside = F.exists(scope, lambda t: F.contains(F.lower(text_of(query)), t))
    return {
        "action_relevance": overlap(q, token_set(actionable)),
        "failure_match": overlap(q, token_set(risky)),
        "scope_match": F.when(F.arrays_overlap(scope, q), 1.0).when(inside, 0.3).otherwise(0.0),
        "recency": recency(created, now, params),
        "type_weight": F.coalesce(weight, F.lit(0.0)),
    }


def utility(axes: dict[str, Column], params: Params = DEFAULT) -> Column:
    return sum((getattr(params, f"w_{k}") * v for k, v in axes.items()), F.lit(0.0))
