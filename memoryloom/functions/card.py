"""Experience cards as struct expressions: classification, extraction, composition, merging, legacy reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CARD, CARD_LISTS, CARD_TEXTS
from .text import first_sentence, strip, text_of

#: Fixed patterns and word lists.
EVENT_VERBS = r"(?iU)\b(fixed|fixes|resolved|patched|migrated|refactored|deployed|upgraded|added|removed|replaced|reverted|disabled|enabled)\b"
PROFILE_HINTS = r"(?iU)\b(uses?|built with|written in|framework|library|version|database|deployed on|auth(?:entication)? with)\b"
ERROR_HINTS = r"(?iU)\b(error|exception|traceback|npe|nullpointer|failed|failure|bug|crash|attributeerror|typeerror|valueerror|keyerror|importerror)\b"
PATH_TOKEN = r"(?U)[\w./\-]+/[./\w\-]*\.(?:py|js|ts|java|go|c|cpp|rb|php|rs)\b"
SYMBOL = r"(?U)\b([A-Z][a-zA-Z0-9_]{2,}(?:\.[A-Z][a-zA-Z0-9_]+)*)\b"
IDENTIFIER = r"(?U)\b([A-Za-z_][A-Za-z0-9_]{3,})\b"
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "have", "was", "are", "but", "not", "you", "your", "use", "using", "can", "all")
PROFILE_PATTERNS = (
    ("language", r"(?iU)\b(?:uses?|written in|built with|implemented in)\s+(python|java|javascript|typescript|go|rust|c\+\+|c#|ruby|php|swift|kotlin|scala)\b"),
    ("framework", r"(?U)\b(?:uses?|using|built with|on top of)\s+([A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)?)\s+(?:framework|library|sdk)"),
    ("database", r"(?iU)\b(?:uses?|with|stored in|backend)\s+(postgres(?:ql)?|mysql|mariadb|mongodb|redis|sqlite|elasticsearch|dynamodb|cassandra|influxdb|clickhouse)\b"),
    ("auth", r"(?iU)\bauth(?:entication)?\s+(?:uses?|with)\s+(jwt|oauth2?|oauth|session|basic|saml|api[_ ]?key|cookie)"),
    ("version", r"(?iU)\b(?:version|v)\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)\b"),
    ("deployment", r"(?iU)\b(?:deploy(?:ed|ment)?\s+(?:on|to|via|using))\s+(docker|kubernetes|k8s|aws|gcp|azure|vercel|fly\.io|heroku|railway)"),
)


def classify(text: Column) -> Column:
    t = text_of(text)
    return F.when(t.rlike(EVENT_VERBS), "event").when(t.rlike(PROFILE_HINTS) & ~t.rlike(ERROR_HINTS), "profile").otherwise("record")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(pattern), F.lit(group))


def files_symbols(text: Column, known: Column) -> Column:
    """Known files, then paths in the text; distinct, at most 20."""
    each = F.transform(F.concat(F.coalesce(known, F.array().cast("array<string>")), _all(text, PATH_TOKEN, 0)), strip)
    return F.slice(F.array_distinct(F.filter(each, lambda f: f != "")), 1, 20)


def symbols(text: Column) -> Column:
    return F.slice(F.filter(F.array_distinct(_all(text, SYMBOL, 1)), lambda s: F.length(s) <= 40), 1, 15)


def keywords(text: Column, files: Column) -> Column:
    words = F.filter(_all(text, IDENTIFIER, 1), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.slice(F.array_distinct(F.concat(files, words)), 1, 10)


def profile_pairs(text: Column) -> Column:
    """The first five distinct (attr, value) pairs, in the patterns' order."""
    found = [F.transform(_all(text, p, 1), lambda v: F.struct(F.lit(attr).alias("attr"), F.lower(strip(v)).alias("value"))) for attr, p in PROFILE_PATTERNS]
    return F.slice(F.filter(F.array_distinct(F.concat(*found)), lambda p: p["value"] != ""), 1, 5)


def merge_pairs(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def heuristic_card(text: Column, repo: Column, language: Column, files: Column, anchor: Column, instance: Column) -> Column:
    """A card of what the text and its context show, nothing made up; for profiles the pairs are in it too."""
    kind, sentence = classify(text), first_sentence(text)
    listed = files_symbols(text, files)
    none, empty = F.array().cast("array<string>"), F.lit("")
    scope = F.concat_ws("/", F.when(text_of(repo) != "", repo), F.when(text_of(language) != "", language))
    return F.struct(
        kind.alias("memory_type"), text_of(instance).alias("instance_id"),
        F.when((kind == "event") & text_of(text).rlike(ERROR_HINTS), sentence).otherwise(empty).alias("trigger"), empty.alias("root_cause"),
        F.when(kind == "event", sentence).otherwise(empty).alias("action_hint"), listed.alias("files_symbols"), empty.alias("failure_if_ignored"), scope.alias("scope"),
        text_of(anchor).alias("temporal_anchor"), F.coalesce(F.nullif(sentence, empty), F.substring(text_of(text), 1, 200)).alias("gist"),
        F.when(kind == "record", symbols(text)).otherwise(none).alias("entities"), F.when(kind == "record", keywords(text, listed)).otherwise(none).alias("keywords"),
        F.when(kind == "profile", profile_pairs(text)).otherwise(F.array().cast("array<struct<attr:string,value:string>>")).alias("pairs"),
    ).cast(CARD)


def _given(c: Column) -> Column:
    return text_of(c) != ""


def _list(label: str, c: Column, n: int) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ", ")))


def compose(card: Column) -> Column:
    """The retrievable text of a card."""
    return F.concat_ws(
        " | ",
        F.when(_given(card["instance_id"]), F.concat(F.lit("["), card["instance_id"], F.lit("]"))), F.when(_given(card["gist"]), card["gist"]),
        F.when(_given(card["action_hint"]) & ~card["action_hint"].eqNullSafe(card["gist"]), F.concat(F.lit("Action: "), card["action_hint"])),
        F.when(_given(card["root_cause"]), F.concat(F.lit("Root cause: "), card["root_cause"])),
        F.when(_given(card["failure_if_ignored"]), F.concat(F.lit("Risk: "), card["failure_if_ignored"])),
        _list("Files: ", card["files_symbols"], 12), _list("Entities: ", card["entities"], 12), _list("Keywords: ", card["keywords"], 8),
    )


def content_of(card: Column, segment_text: Column) -> Column:
    """The composed text; an empty one falls back to 500 characters of the segment."""
    return F.coalesce(F.nullif(compose(card), F.lit("")), F.substring(text_of(segment_text), 1, 500))


def merge(old: Column, new: Column, override: Column, fields: Column | None = None) -> Column:
    """new merged into old. override: new texts replace old ones, else they only fill empty ones. fields: a judge's texts
    by name, which win. The type stays, the instance too if there is one; lists become ordered unions."""
    text = lambda f: F.when(_given(new[f]) & (override | ~_given(old[f])), new[f]).otherwise(old[f])
    judged = lambda f: text(f) if fields is None else F.coalesce(F.nullif(F.element_at(fields, F.lit(f)), F.lit("")), text(f))
    union = lambda f: F.array_distinct(F.concat(old[f], new[f]))
    out = {"memory_type": old["memory_type"], "instance_id": F.when(_given(old["instance_id"]), old["instance_id"]).otherwise(new["instance_id"]), "temporal_anchor": text("temporal_anchor"), "gist": text("gist")}
    out |= {f: judged(f) for f in CARD_TEXTS} | {f: union(f) for f in CARD_LISTS}
    order = [part.split(":")[0] for part in ("memory_type", "instance_id", "trigger", "root_cause", "action_hint", "files_symbols", "failure_if_ignored", "scope", "temporal_anchor", "gist", "entities", "keywords", "pairs")]
    return F.struct(*[out[f].alias(f) for f in order]).cast(CARD)


def to_legacy(card: Column) -> Column:
    """The older columns that readers of plain notes expect, beside the card."""
    return F.struct(
        card["trigger"].alias("trigger"), card["action_hint"].alias("action"), F.coalesce(F.nullif(card["root_cause"], F.lit("")), card["failure_if_ignored"]).alias("outcome"),
        F.coalesce(F.nullif(card["temporal_anchor"], F.lit("")), F.lit("unspecified")).alias("anchor"), card.alias("card"),
    )


def from_legacy(row: Column) -> Column:
    """A card from a stored row, empty texts filled from the older columns."""
    card, filled = row["card"], {"trigger": "trigger", "action_hint": "action", "failure_if_ignored": "outcome", "temporal_anchor": "anchor"}
    for f, old in filled.items():
        card = card.withField(f, F.coalesce(F.nullif(card[f], F.lit("")), row[old], F.lit("")))
    return card
