"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over by every document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy

#: Fixed: everything in ASCII but digits and letters separates words; A-Z become a-z.
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Items go to one automaton up to so many bytes of text; more items are dealt to several, each streamed over in turn.
BLOCK_BYTES = 4 << 20


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of word ids.

    longest(ids) gives, for each position, the length of the longest run of words ending there that occurs in an item.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.last = [-1], [0], 0

    def add(self, ids: list[int]) -> None:
        self.last = 0
        for c in ids:
            self.last = self._extend(self.last, c)

    def _clone(self, p: int, q: int, c: int) -> int:
        k = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:  # the run so far is in an earlier item
            return q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        cur = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[p] + 1)
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return cur

    def longest(self, ids) -> list[int]:
        state, n, out, nxt, link, length = 0, 0, [], self.next, self.link, self.len
        for c in ids:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


class Matcher:
    """The automaton of a block of items, and which items each of their windows belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.vocab, self.sam, self.owners = window, {}, SuffixAutomaton(), {}
        pairs, self.short = set(), {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in normal_words(text)]
            self.sam.add(ids)
            pairs.update(zip(ids, ids[1:], strict=False))
            k = min(window, len(ids))
            for i in range(len(ids) - k + 1) if k else ():
                self.owners.setdefault(tuple(ids[i : i + k]), set()).add(item)
                if k < window:
                    self.short[k] = True
        self.single = np.zeros(len(self.vocab) + 1, bool)
        for key in self.owners:
            if len(key) == 1:
                self.single[key[0]] = True
        self.pairs = np.array(sorted(a * len(self.vocab) + b for a, b in pairs), np.int64)
        self.least = min(self.short, default=window)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence of a window, and the items with occurring windows.

        A window of k words can only occur where k-1 neighbouring pairs of words are pairs of the items, so the
        automaton streams over such stretches alone; elsewhere the longest match is known to be too short.
        """
        n, found = len(words), set()
        hit = np.zeros(n, bool)
        if not n or not self.owners:
            return hit, found
        missing = len(self.vocab)
        ids = np.fromiter(map(self.vocab.get, words, (missing for _ in words)), np.int64, n)
        if self.least == 1:
            for i in np.flatnonzero(self.single[ids]).tolist():
                hit[i] = True
                found |= self.owners[(int(ids[i]),)]
        if n < 2 or not len(self.pairs):
            return hit, found
        code = np.where((ids[:-1] == missing) | (ids[1:] == missing), -1, ids[:-1] * missing + ids[1:])
        known = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
        edge = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        need = max(1, min((k for k in (*self.short, self.window) if k > 1)) - 1)
        for a, b in zip(starts[ends - starts >= need].tolist(), ends[ends - starts >= need].tolist(), strict=True):
            run = ids[a : b + 1].tolist()
            for i, longest in enumerate(self.sam.longest(run)):
                for k in (*self.short, self.window):
                    if 1 < k <= longest and (owners := self.owners.get(tuple(run[i - k + 1 : i + 1]))):
                        hit[a + i - k + 1 : a + i + 1] = True
                        found |= owners
        return hit, found


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size. Only the benchmark, a fixed set of test items, goes to the driver."""
    blocks, size = [[]], 0
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).toLocalIterator():
        if row["i"] is None:
            continue
        if size and size + len(row["t"]) > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row["i"], bytes(row["t"])))
        size += len(row["t"])
    return blocks


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends, flat, of the stretches of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def _unruns(runs: list[int], n: int) -> np.ndarray:
    hit = np.zeros(n, bool)
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        hit[a:b] = True
    return hit


def _scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, last=None, schema=None) -> DataFrame:
    """docs with three more columns at its end: _n words, _hit runs and _items; or what last, a further step on batches,
    makes of that (schema). All blocks are looked for in one worker a task, one after another on each batch."""
    spark, steps = docs.sparkSession, []
    out = docs.withColumns({"_n": F.lit(0).cast("long"), "_hit": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        at = out.columns.index(text)

        def look(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, window)
            for batch in batches:
                n_words, runs, items = [], [], []
                for body, before, owners in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column("_hit").to_pylist(), batch.column("_items").to_pylist(), strict=True):
                    words = normal_words(body or b"")
                    hit, found = matcher.hits(words)
                    n_words.append(len(words))
                    runs.append(_runs(hit | _unruns(before, len(words)) if before else hit))
                    items.append(sorted(found | set(owners)))
                k = batch.num_columns - 3
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

        steps.append(look)
    if last:
        steps.append(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return out.mapInArrow(tidy(run), schema or out.schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(key, n_words long, hit_runs array<int>: starts and ends of hit stretches, in words, items array<string>).

    A word is hit if it is inside any occurrence of a window: that many consecutive words of an item, or all words of a
    shorter item. Null and empty texts have no words; items without words or id never occur; repeated items count
    once; other columns are not read. Nothing is shuffled: a block of items is broadcast, as an automaton of bounded
    size, and each block's pass over the text widens the same columns.
    """
    found = _scan(docs.select(key, text), benchmark, text, **limits)
    return found.select(key, F.col("_n").alias("n_words"), F.col("_hit").alias("hit_runs"), F.col("_items").alias("items"))


def overlap_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the counts and the digest of the items found in it.

    Null and empty texts have no words; repeated rows are treated alike; an empty table of documents gives an empty one, an
    empty benchmark hits nothing; other columns aren't read, whatever they are called; a text of any length is streamed whole.
    """
    found = find_overlaps(docs, benchmark)
    span = F.expr("aggregate(sequence(0, size(hit_runs) - 1, 2), 0L, (s, i) -> s + hit_runs[i + 1] - hit_runs[i])")
    n_hit = F.when(F.size("hit_runs") == 0, F.lit(0).cast("long")).otherwise(span)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"),
    )


def remove_overlaps(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the hit stretches; a document of which more than max_coverage is hit goes as a whole.

    Text outside the hit stretches stays byte for byte; a removed stretch leaves one space. Untouched documents are
    unchanged.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("_body").to_pylist(), []
            for i, (n, runs) in enumerate(zip(batch.column("_n").to_pylist(), batch.column("_hit").to_pylist(), strict=True)):
                keep.append(not runs or sum(runs[1::2]) - sum(runs[::2]) <= max_coverage * n)
                if runs and keep[-1]:
                    texts[i] = cut_words(texts[i].encode(), runs).decode()
            columns = [batch.column("_row"), pa.array(texts, batch.column("_body").type)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_body"]).filter(pa.array(keep, pa.bool_()))

    return _scan(packed, benchmark, "_body", last=cut, schema=packed.schema).select(*[F.col("_body").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def cut_words(text: bytes, runs: list[int]) -> bytes:
    """text without the words of the runs and what stands between them; each run leaves a space."""
    word = np.frombuffer(text.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        parts += [text[at : starts[a]], b" "]
        at = ends[b - 1]
    return b"".join([*parts, text[at:]])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
