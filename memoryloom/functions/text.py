"""Text functions as Column expressions: code-aware tokens, fingerprints, overlaps, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
TOKEN = "[A-Za-z_][A-Za-z0-9_]++|[一-鿿]{2,}+"
JOINER = r"[._\-]+"
ACRONYM = "([A-Z]+)([A-Z][a-z])"
CAMEL = "(?<=[a-z0-9])(?=[A-Z])"
SPLIT = "_|[a-z0-9][A-Z]|[A-Z]{2}"
FILE_LIKE = r"(?U)[\w./\-]+\.[A-Za-z]{1,4}\b|[A-Za-z_][A-Za-z0-9_./\-]{2,}"
DIFF_FILE = r"(?m)^diff --git a/(.+?) b/(.+)$"
#: Fixed, in order of precedence.
SENTENCE_ENDS = (". ", ".\n", "!\n", "?\n", "\n")
TESTBED_PREFIXES = ("./swebench_9_15/testbed/", "swebench_9_15/testbed/", "./swebench_9_15/")
EXCLUDED_PATHS = ("/tests/", "/test_", "test_", "/tests", "manual.yaml", "/output/", "swebench_", "conftest", ".pyc")

SPACE = r"(?U)\s+"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?U)^\s+|\s+$", "")


def split_identifier(token: Column) -> Column:
    """The distinct lower-cased parts of an identifier: at joiners, acronym ends and camel humps, and each joined part."""
    parts = F.filter(F.split(token, JOINER), lambda p: p != "")
    humps = F.flatten(F.transform(parts, lambda p: F.split(F.regexp_replace(F.regexp_replace(p, ACRONYM, "$1 $2"), CAMEL, " "), " ")))
    pieces = F.array_distinct(F.filter(F.transform(F.concat(parts, humps), F.lower), lambda p: p != ""))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lower(token)))


def tokenize(text: Column) -> Column:
    """array<string>: parts of every identifier or CJK run of two or more characters, with repeats; [] for null."""
    found = F.regexp_extract_all(text_of(text), F.lit(TOKEN), F.lit(0))
    rest = lambda t: F.substring(t, F.lit(2), F.length(t))
    # most words have nothing to split: no underscore, and no capital after the first letter
    plain = lambda t: ~F.contains(t, F.lit("_")) & (F.lower(rest(t)) == rest(t))
    split = F.flatten(F.transform(found, lambda t: F.when(plain(t), F.array(F.lower(t))).otherwise(split_identifier(t))))
    # and most texts have no such word at all
    return F.when(text_of(text).rlike(SPLIT), split).otherwise(F.transform(found, F.lower))


def fingerprint(user: Column, content: Column) -> Column:
    """sha256 of user, a zero byte and content."""
    return F.sha2(F.concat(F.encode(text_of(user), "UTF-8"), F.unhex(F.lit("00")), F.encode(text_of(content), "UTF-8")), 256)


def memory_id(*parts: Column) -> Column:
    """A replayable id: mem_ and 16 hex digits of the parts' hash."""
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text_of(text)), SPACE), lambda t: F.length(t) > 1))


def scope_tokens(scope: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text_of(scope)), r"[/#\-_.]+"), lambda t: F.length(t) > 1))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text_of(text)), SPACE), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of word sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def first_sentence(text: Column) -> Column:
    """Up to the first separator in order of precedence (not of place), its first character included; else 300 chars."""
    t = strip(text)
    ends = [F.when(F.instr(t, s) > 0, strip(F.substring(t, F.lit(1), F.instr(t, s)))) for s in SENTENCE_ENDS]
    return F.coalesce(*ends, F.substring(t, 1, 300))


def seed_files(query: Column) -> Column:
    """The first 20 file-like tokens or identifiers of three or more characters."""
    return F.slice(F.regexp_extract_all(text_of(query), F.lit(FILE_LIKE), F.lit(0)), 1, 20)


def source_path(raw: Column) -> Column:
    """A repository path without testbed prefix; empty for tests, artifacts and globs."""
    p = strip(F.replace(text_of(raw), F.lit("\\"), F.lit("/")))
    chain = p
    for prefix in reversed(TESTBED_PREFIXES):
        chain = F.when(p.startswith(prefix), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(chain)
    chain = F.regexp_replace(chain, r"^[./]+", "")
    low = F.lower(chain)
    bad = chain.contains("*")
    for x in EXCLUDED_PATHS:
        bad = bad | low.contains(x)
    return F.when(bad, "").otherwise(chain)


def diff_files(patch: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text_of(patch), F.lit(DIFF_FILE), F.lit(1)))


def task_query(repo: Column, statement: Column) -> Column:
    """The repository's short name and 600 characters of the statement."""
    tail = F.substring_index(text_of(repo), "/", -1)
    return strip(F.concat_ws(" ", F.when(tail != "", tail), F.substring(text_of(statement), 1, 600)))


def repaired_json(reply: Column) -> Column:
    """A model's reply as JSON text: without code fences, else from the first { to the last }; null if neither parses."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(reply), r"^```[A-Za-z]*\s*", ""), r"```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull() & (c != ""), c)
    return F.coalesce(good(bare), good(inner))
