"""Substring dedup: repeated passages located by sharded Aho-Corasick automata over word ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import drop, stage, tidy
from .words import byte_slices, gram_hashes, hashed_words, spaced_words

#: A passage is a window of so many consecutive words.
WINDOW = 20
#: Each window is represented by the least hash among its runs of GRAM words (its anchor), so equal windows share one.
GRAM = 6
#: An anchor with more occurrences is dealt to several tasks.
HEAVY = 512
#: Stretches of text that one automaton is compiled for and streamed over.
CHUNK = 4000
#: Bytes of text that are parsed at once.
BYTES_AT_ONCE = 4 << 20
ALL = -1
_HIGH = np.uint64(0xFFFFFFFF00000000)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: the anchors' positions and hashes, and the first and last window of each."""
    if len(hashes) < WINDOW:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    grams = gram_hashes(hashes, GRAM)
    # high bits order the runs, low bits are their places: the least of both is the leftmost least run
    least, width, span = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return at[first], grams[at[first]], first, last


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a, b in byte_slices(whole.column(2), BYTES_AT_ONCE):
            batch = whole.slice(a, b - a)
            hashes, bounds, _, _ = hashed_words(batch.column(2).to_pylist())
            found = [anchors(hashes[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            grams, places = (np.concatenate([x[i] for x in found]) for i in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(places.astype(np.int32))], names=["gram", "doc_id", "tkey", "pos"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text under the windows of each recurring anchor: a row for each anchor of a document."""
    for whole in batches:
        for a, b in byte_slices(whole.column(2), BYTES_AT_ONCE):
            batch = whole.slice(a, b - a)
            texts, hits = batch.column(2).to_pylist(), batch.column(3)
            pos, parts = (hits.flatten().field(i).to_numpy() for i in (0, 1))
            offsets = (hits.offsets.to_numpy() - hits.offsets[0].as_py()).tolist()
            hashes, bounds, start, end = hashed_words(texts)
            data, rows, grams, dealt, lows, bodies = b" ".join(texts), [], [], [], [], []
            for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                at, gram, first, last = anchors(hashes[x:y])
                own = pos[offsets[i] : offsets[i + 1]]
                near = np.searchsorted(own, at)
                near[near == len(own)] = 0
                hit = np.flatnonzero(own[near] == at)
                rows.append(np.full(len(hit), i))
                grams.append(gram[hit])
                dealt.append(parts[offsets[i] + near[hit]])
                lows.append(first[hit])
                bodies += [data[f:t] for f, t in zip(start[x + first[hit]].tolist(), end[x + last[hit] + WINDOW - 1].tolist(), strict=True)]
            take, gram, part, low = (np.concatenate(c) for c in (rows, grams, dealt, lows))
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(part, pa.int32()), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take)), pa.array(low.astype(np.int32)), pa.array(bodies, pa.binary())], names=["gram", "parts", "doc_id", "tkey", "lo", "body"])


_LOCATED = "gram long, passage long, doc_id long, tkey long, spans array<int>"


def _located(gram, passage, doc, tkey, first, last) -> pa.RecordBatch:
    """Rows of _LOCATED; gram and passage None: null."""
    n = len(doc)
    pair = np.empty(2 * n, np.int32)
    pair[::2], pair[1::2] = first, last
    column = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    spans = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, np.int32)), pa.array(pair))
    return pa.RecordBatch.from_arrays([column(gram), column(passage), column(doc), column(tkey), spans], names=["gram", "passage", "doc_id", "tkey", "spans"])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later occurrences of passages, from stretches ordered by gram, salt, doc_id and place.

    For each chunk the windows whose hash recurs in it, or occurred before in the group still open, are compiled into
    one automaton of word sequences, which the chunk's stretches are streamed through; what it matches, word by word,
    is an occurrence of the passage, and nothing else is. Only the open group's distinct passages are carried over.
    Rows with passage null: words [start, end) to remove; others: the first place of a passage in a part of a heavy
    group, to be held against the other parts.
    """
    seen: dict[int, tuple[int, int]] = {}  # the open group's passages -> their first places
    group = None
    for whole in batches:
        for i in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(i, CHUNK)
            gram, salt, parts, doc, tkey, lo = (batch.column(c).to_numpy() for c in ("gram", "salt", "parts", "doc_id", "tkey", "lo"))
            words, bounds, _, _ = hashed_words(batch.column("body").to_pylist())
            offsets, sizes = bounds[:-1], np.diff(bounds)
            # every window: its stretch, its place in the chunk and in its document, its hash
            counts = sizes - WINDOW + 1
            row = np.repeat(np.arange(len(sizes)), counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at, start = offsets[row] + place, lo[row] + place
            key = gram_hashes(words, WINDOW)[at]
            mark = salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # parts of a heavy group are apart
            name = key ^ mark[row]
            unique, first, times = np.unique(name, return_index=True, return_counts=True)
            first_doc, first_start = doc[row[first]].copy(), start[first].astype(np.int64)
            recurs, fresh = times > 1, np.ones(len(unique), bool)
            if seen:
                for u in np.flatnonzero((gram[row[first]] == group[0]) & (salt[row[first]] == group[1])).tolist():
                    before = seen.get(int(unique[u]))
                    if before is not None:
                        recurs[u], fresh[u] = True, False
                        first_doc[u], first_start[u] = before
            if recurs.any():
                _, ids = np.unique(words, return_inverse=True)
                listed = (ids + 1).tolist()
                machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
                for u, p in zip(np.flatnonzero(recurs).tolist(), at[first[recurs]].tolist(), strict=True):  # in any part
                    machine.add_word(tuple(listed[p : p + WINDOW]), u)
                machine.make_automaton()
                stream = np.zeros(len(words) + len(sizes), np.int64)  # a 0 after each stretch: nothing matches across
                stream[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = ids + 1
                found = np.array(list(machine.iter(tuple(stream.tolist()))), np.int64).reshape(-1, 2)
                owner = np.searchsorted(offsets + np.arange(len(sizes)), found[:, 0], side="right") - 1
                begin = found[:, 0] - WINDOW + 1 - owner - offsets[owner] + lo[owner]
                own = key[first[found[:, 1]]] ^ mark[owner]  # the passage in the owner's part
                which = np.minimum(np.searchsorted(unique, own), len(unique) - 1)
                owner, begin, which = (x[unique[which] == own] for x in (owner, begin, which))
                later = (doc[owner] > first_doc[which]) | ((doc[owner] == first_doc[which]) & (begin > first_start[which]))
                owner, begin = owner[later], begin[later]  # ascending, as the stream is
                new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (begin[1:] > begin[:-1] + WINDOW)))) if len(owner) else np.empty(0, np.int64)
                last = np.concatenate((new[1:], [len(owner)]))[: len(new)] - 1
                yield _located(None, None, doc[owner[new]], tkey[owner[new]], begin[new], begin[last] + WINDOW)
            heads = first[(parts[row[first]] > 1) & fresh]
            if len(heads):
                r, p = row[heads], start[heads]
                yield _located(gram[r], key[heads].view(np.int64), doc[r], tkey[r], p, p + WINDOW)
            tail = int(gram[-1]), int(salt[-1])
            ends = np.flatnonzero((gram[row[first]] == tail[0]) & (salt[row[first]] == tail[1]))
            kept = dict(zip(unique[ends].tolist(), zip(first_doc[ends].tolist(), first_start[ends].tolist(), strict=True), strict=True))
            seen, group = (seen | kept if tail == group else kept), tail


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tkey, spans) of documents with later occurrences of a passage; staged.

    spans: starts and ends, in words, of every window of 20 words whose sequence also starts earlier: in a document of
    smaller doc_id, or earlier in the same one; [-1] for a later copy of a whole text. tkey is the text's hash, as
    doc_ids may repeat; copies of whole texts are told by 128 bits and their length.

    Anchors that occur once are dropped after a pre-aggregated count. The text around the others is dealt out by
    anchor, so that equal windows meet in one shard; an anchor with many occurrences is dealt to several, whose first
    places are then compared.
    """
    body = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tkey"), F.col(text).cast("binary").alias("text"))
    # a later copy of a whole text goes as a whole; only the first one takes part in what follows
    same = ["tkey", "_more", "_size"]
    told = body.withColumns({"_more": F.xxhash64(F.lit(1), "text"), "_size": F.octet_length("text")}).select("doc_id", *same)
    texts = told.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).filter("first < _last").select(*same, "first")
    copies = stage(told.distinct().join(texts, same).filter("doc_id > first").select("doc_id", "tkey").distinct(), "copies")
    found = body.mapInArrow(tidy(_anchor_rows), "gram long, doc_id long, tkey long, pos int")
    # what occurs at one place of one text alone recurs in its copies only
    counted = found.groupBy("gram").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("tkey", "pos")])
    recurring = stage(counted.filter("min_tkey <> max_tkey or min_pos <> max_pos").select("gram", F.ceil(F.col("n") / HEAVY).cast("int").alias("parts")), "anchors")
    hits = stage(found.join(recurring, "gram").join(copies, ["doc_id", "tkey"], "left_anti").groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set(F.struct("pos", "parts"))).alias("hits")), "anchor-places")
    drop(recurring)
    parts = body.join(hits, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "hits").mapInArrow(tidy(_stretches), "gram long, parts int, doc_id long, tkey long, lo int, body binary")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tkey"), F.col("parts")).cast("int"))
    located = stage(parts.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "doc_id", "lo").mapInArrow(tidy(_locate), _LOCATED), "located")
    drop(hits)
    place = F.struct("doc_id", F.col("spans")[0])
    heavy = located.filter("passage is not null").withColumn("_first", F.min(place).over(Window.partitionBy("gram", "passage"))).filter(place > F.col("_first"))
    spans = located.filter("passage is null").select("doc_id", "tkey", "spans").union(heavy.select("doc_id", "tkey", "spans"))
    spans = spans.union(copies.select("doc_id", "tkey", F.array(F.lit(ALL)).alias("spans")))
    out = stage(spans.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    drop(located, copies)
    return out


def covered(spans: list[int] | None, n: int) -> np.ndarray:
    """Which of n words the spans cover; ALL alone stands for all words of a text that has a window at all."""
    if spans and spans[0] == ALL:
        return np.full(n, n >= WINDOW)
    delta = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(delta, spans[::2], 1)
        np.add.at(delta, spans[1::2], -1)
    return np.cumsum(delta[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = spaced_words(text)
            gone = covered(spans, len(words))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs, without the words that repeated_spans cover.

    Null and empty texts have no words. Rows without doc_id have no place in the order: they keep their words and make
    no other row lose any. Rows that repeat a doc_id and its text lose the same words. Other columns are not read, whatever
    they are called; an empty table gives an empty one; a text of any length is taken whole and must fit into a row.
    """
    spans = repeated_spans(docs, key, text)
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tkey"), F.col(text).cast("binary").alias("text"))
    joined = body.join(spans, ["doc_id", "tkey"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(tidy(_kept), "doc_id long, n_words long, n_removed long, kept_sha256 string")
