"""Language-model scoring: corpus-wide word counts, a gated recurrent network over them, whole-document likelihoods."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gru import Gru, log_likelihoods, train
from .scratch import drop, stage, tidy
from .words import Table, byte_slices, hashed_words

#: The most frequent words, whose counts every task holds; counts of rarer ones are joined.
HEAD_WORDS = 1 << 16
#: The most frequent of those are told apart by the network, in so many classes of equal mass.
NEURAL_WORDS, WORD_CLASSES = 1024, 32
#: Rarer words are in a class by their last three bytes, and told apart in it by their counts.
TAIL_CLASSES = 32
#: Training passes, each over other documents, so that every training document is learned from once.
PASSES = 2
#: The corpus is dealt to one trainer for so many of its tokens, whatever its layout.
TRAINER_TOKENS = 4_000_000
#: Partitions that trainers are dealt to at most; trainers of one partition take turns.
TRAINER_TASKS = 4096
#: Tokens that a trainer gathers before it trains on them.
TRAINED_AT_ONCE = 1_000_000
#: Bytes of text that are parsed at once.
BYTES_AT_ONCE = 8 << 20
#: Words that a counting task holds before it hands them on.
COUNTED_AT_ONCE = 300_000
#: Documents that are scored at once are bounded by their tokens.
SCORED_AT_ONCE = 2_000_000
PIECE = 16_384
END = b""


def tail_classes(last: np.ndarray, before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Classes of words by their last three bytes (0 where there is none)."""
    x = last.astype(np.uint32) | before.astype(np.uint32) << np.uint32(8) | earlier.astype(np.uint32) << np.uint32(16)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % TAIL_CLASSES


def tail_class(word: bytes) -> int:
    last = np.frombuffer(word[:-4:-1].ljust(3, b"\0"), np.uint8)
    return int(tail_classes(last[:1], last[1:2], last[2:])[0])


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _tails(words: list[bytes]) -> np.ndarray:
    last = np.frombuffer(b"".join(w[:-4:-1].ljust(3, b"\0") for w in words), np.uint8).reshape(-1, 3)
    return tail_classes(last[:, 0], last[:, 1], last[:, 2])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(_tails(words), pa.int32()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "tail", "n"])

    for batch in batches:
        for a, b in byte_slices(batch.column(0), BYTES_AT_ONCE):
            texts = [(t or b"").lower() for t in batch.column(0).slice(a, b - a).to_pylist()]
            hashes, _, start, end = hashed_words(texts)
            _, first, times = np.unique(hashes, return_index=True, return_counts=True)
            data = b" ".join(texts)
            for x, y, n in zip(start[first].tolist(), end[first].tolist(), times.tolist(), strict=True):
                counts[data[x:y]] += n
            counts[END] += len(texts)
            if len(counts) > COUNTED_AT_ONCE:
                yield out()
                counts.clear()
    yield out()


@dataclass
class Lexicon:
    """Corpus totals, the head words with their counts, and each tail class's tokens and words outside of the network."""

    tokens: int
    words: int
    head: list[bytes]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    def __post_init__(self) -> None:
        n = min(NEURAL_WORDS, len(self.head))
        mass = self.counts[:n] + 0.5
        cls = np.minimum(WORD_CLASSES - 1, ((np.cumsum(mass) - mass / 2) / mass.sum() * WORD_CLASSES).astype(np.int64))
        _, cls = np.unique(cls, return_inverse=True)
        size = np.bincount(cls)
        self.first = np.concatenate(([0], np.cumsum(size)[:-1], np.zeros(TAIL_CLASSES, np.int64))).astype(np.int64)
        self.size = np.concatenate((size, np.zeros(TAIL_CLASSES, np.int64)))
        self.class_of = np.concatenate((cls, len(size) + np.arange(TAIL_CLASSES)))
        self.member_of = np.concatenate((np.arange(n) - self.first[cls], np.zeros(TAIL_CLASSES, np.int64)))
        self.member_mass, self.neural = mass, n
        self.class_mass = np.concatenate((np.bincount(cls, mass), self.tail_tokens + self.tail_words + 1))
        self.end = self.head.index(END)
        # by place in the head, then by tail class: the network's id, log10(count + 1), and what is added to its likelihood
        rare = -np.log10(self.tail_tokens + self.tail_words + 1)
        tails = _tails(self.head[n:])
        log_counts = np.log10(self.counts + 1.0)
        self.ids = np.concatenate((np.arange(n), n + tails, n + np.arange(TAIL_CLASSES))).astype(np.uint16)
        self.log_counts = np.concatenate((log_counts, np.zeros(TAIL_CLASSES)))
        self.added = np.concatenate((np.zeros(n), log_counts[n:] + rare[tails], rare))

    def start(self) -> Gru:
        return Gru.start(self.neural + TAIL_CLASSES, self.class_mass, self.member_mass, self.first, self.size)


def lexicon(counts: DataFrame) -> Lexicon:
    """From staged (word, tail, n). At most HEAD_WORDS words and a row for each tail class go to the driver."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    often = counts
    if total["v"] > HEAD_WORDS:  # each task would send the driver a head of its own: cut by count first
        least = counts.agg(F.percentile_approx("n", 1 - HEAD_WORDS / total["v"], 100_000)).first()[0]
        often = counts.filter(F.col("n") > least)
    top = often.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(HEAD_WORDS - 1).collect()
    ends = counts.filter(F.length("word") == 0).agg(F.sum("n")).first()[0]  # however few, the end is in the head
    rows = [(END, ends or 0), *sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda r: (-r[1], r[0]))]
    tokens, words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["tail"]], words[r["tail"]] = r["n"], r["v"]
    for w, n in rows[:NEURAL_WORDS]:
        if n:
            tokens[tail_class(w)] -= n
            words[tail_class(w)] -= 1
    return Lexicon(int(total["n"] or 0), int(total["v"]), [w for w, _ in rows], np.array([n for _, n in rows], float), tokens, words)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("trainer")
    weight = pdf["weight"].sum()
    mean = sum(np.frombuffer(v, np.float32) * np.float32(w / weight) for v, w in zip(pdf["part"], pdf["weight"], strict=True))
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "trainer": [pdf["trainer"].iloc[0] >> 6], "weight": [weight], "part": [mean.astype(np.float32).tobytes()]})


def train_pass(texts: DataFrame, lex: Lexicon, model: Gru, trainers: int) -> Gru:
    """The mean, weighted by tokens, of what each trainer makes of the model from all of its texts (deal, ids), in the
    order of deal. Means are taken in a tree, 64 at a time. So the layout of texts makes no difference."""
    shared = texts.sparkSession.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value
        docs, size, weight, trainer, now = [], 0, 0, None, None

        def learn() -> None:
            nonlocal docs, size, weight, trainer
            trainer = train(model, docs, lex.class_of, lex.member_of, lex.end, trainer)
            docs, size, weight = [], 0, weight + size

        def out() -> pa.RecordBatch:
            nonlocal trainer, weight
            if docs:
                learn()
            vector = trainer.m.vector()
            parts = [vector[i : i + PIECE].tobytes() for i in range(0, len(vector), PIECE)]
            k, total = len(parts), float(weight)
            trainer, weight = None, 0
            return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([now] * k, pa.int64()), pa.array([total] * k, pa.float64()), pa.array(parts, pa.binary())], names=["piece", "trainer", "weight", "part"])

        for batch in batches:
            for own, ids in zip(batch.column("trainer").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if now is not None and own != now:
                    yield out()
                now = own
                docs.append(np.frombuffer(ids, np.uint16).astype(np.int32))
                size += len(docs[-1])
                if size >= TRAINED_AT_ONCE:
                    learn()
        if now is not None:
            yield out()

    schema = "piece int, trainer long, weight double, part binary"
    tasks = min(trainers, TRAINER_TASKS)
    dealt = texts.withColumn("trainer", F.pmod("deal", F.lit(trainers))).repartitionById(tasks, F.pmod("trainer", F.lit(tasks)).cast("int"))
    parts = stage(dealt.sortWithinPartitions("trainer", "deal", "ids").select("trainer", "ids").mapInArrow(tidy(run), schema), "lm-parts")
    merged, width = parts, trainers
    while width > 1 or merged is parts:
        merged, width = merged.groupBy("piece", F.shiftright("trainer", 6).alias("_group")).applyInPandas(_merge, schema), -(-width // 64)
    vector = [np.frombuffer(r["part"], np.float32) for r in merged.orderBy("piece").collect()]
    drop(parts)
    return model.replaced(np.concatenate(vector)) if vector else model


_ENCODED = "uid long, doc_id long, held_out boolean, deal long, n_tokens long, n_known long, base double, added double, ids binary, rare array<struct<word:binary,n:int>>"


def _encoder(shared):
    """Documents as the network's ids, with what their words add to both scores, and the counts of their rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        heads, end = len(lex.head), lex.end
        known = [i for i in range(heads) if i != end]
        places = Table((hashed_words([lex.head[i] for i in known])[0] >> np.uint64(1)).astype(np.int64), np.array(known, np.int32))
        uid, floor = TaskContext.get().partitionId() << 40, np.log10(lex.tokens + lex.words + 1.0)
        for whole in batches:
            for a, b in byte_slices(whole.column("text"), BYTES_AT_ONCE):
                batch = whole.slice(a, b - a)
                texts = [(t or b"").lower() for t in batch.column("text").to_pylist()]
                hashes, bounds, start, stop = hashed_words(texts)
                data, n = b" ".join(texts), len(texts)
                found = places.get((hashes >> np.uint64(1)).astype(np.int64)).astype(np.int64)
                rare = np.flatnonzero(found < 0)
                raw, size = np.frombuffer(data, np.uint8), stop[rare] - start[rare]
                byte = lambda k: np.where(size >= k, raw[np.maximum(stop[rare] - k, 0)], 0)
                found[rare] = heads + tail_classes(byte(1), byte(2), byte(3))
                # an end after each document's words
                begin = bounds[:-1] + np.arange(n)
                place = np.full(len(hashes) + n, end, np.int64)
                doc = np.repeat(np.arange(n), np.diff(bounds))
                place[np.arange(len(hashes)) + doc] = found
                tokens = np.diff(bounds) + 1
                base = np.add.reduceat(lex.log_counts[place], begin) - tokens * floor
                added = np.add.reduceat(lex.added[place], begin)
                unknown = np.bincount(doc[rare], minlength=n) + (not lex.counts[end])
                order = rare[np.lexsort((hashes[rare], doc[rare]))]
                new = np.flatnonzero(np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])))) if len(order) else order
                times, one = np.diff(np.append(new, len(order))), order[new]
                words = [data[x:y] for x, y in zip(start[one].tolist(), stop[one].tolist(), strict=True)]
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[one], minlength=n)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times.astype(np.int32))], names=["word", "n"]))
                spelled = lex.ids[place]
                ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(2 * tokens))).astype(np.int32)), pa.py_buffer(spelled)])
                uids = pa.array(np.arange(uid, uid + n))
                uid += n
                yield pa.RecordBatch.from_arrays(
                    [uids, *(batch.column(c) for c in ("doc_id", "held_out", "deal")), pa.array(tokens), pa.array(tokens - unknown), pa.array(base), pa.array(added), ids, lists],
                    names=["uid", "doc_id", "held_out", "deal", "n_tokens", "n_known", "base", "added", "ids", "rare"],
                )

    return run


_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double"


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value

        def out(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            docs = [np.frombuffer(x, np.uint16).astype(np.int32) for x in rows.column("ids").to_pylist()]
            lls = log_likelihoods(model, docs, lex.class_of, lex.member_of, lex.end) / np.log(10) + rows.column("added").to_numpy()
            return rows.select(["uid", "doc_id", "held_out", "n_tokens", "n_known", "base"]).append_column("lm", pa.array(lls)).to_batches()[0]

        waiting, size = [], 0
        for whole in batches:
            if not whole.num_rows:
                continue
            # runs of rows of bounded length
            part = (np.cumsum(whole.column("n_tokens").to_numpy()) + size) // SCORED_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                batch = whole.slice(a, b - a)
                waiting.append(batch)
                size += int(batch.column("n_tokens").to_numpy().sum())
                if size >= SCORED_AT_ONCE:
                    yield out(waiting)
                    waiting, size = [], 0
        if waiting:
            yield out(waiting)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", trainer_tokens: int = TRAINER_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Words are lower-cased (A-Z) and one end follows them; null texts are empty. Counts cover all documents that aren't
    held out, and the network is trained on all of theirs: they are dealt to one trainer for each trainer_tokens of the
    corpus by a hash of key and text, ordered by it, and the trainers' weights averaged in a fixed order, so the score
    doesn't follow the layout of docs. score is the log10 probability of the whole text: the network's P(class) times,
    for frequent words, its P(word in class), for others add-one counts in their class; all unseen words of a class
    share one count. Without training documents, the counts are 0 and the network stays as it starts. Repeated rows are
    scored alike; an empty table gives an empty one; only the two columns are read.

    Documents are parsed once more after counting, and kept as the network's ids. Rare words alone, pre-counted by
    document, are shuffled to be joined with the corpus counts.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    counts = stage(body.filter(~F.col("held_out")).select("text").mapInArrow(tidy(_count), "word binary, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n")), "lm-counts")
    lex = lexicon(counts)
    ready = body.withColumn("deal", F.xxhash64("text", "doc_id"))
    encoded = stage(ready.mapInArrow(tidy(_encoder(spark.sparkContext.broadcast(lex))), _ENCODED), "lm-encoded")
    model, trainers = lex.start(), max(1, -(-lex.tokens // trainer_tokens))
    learned = encoded.filter(~F.col("held_out")).select("deal", "ids")
    for i in range(PASSES):
        model = train_pass(learned.filter(F.pmod(F.xxhash64("deal"), F.lit(PASSES)) == i), lex, model, trainers)
    shared = spark.sparkContext.broadcast((lex, model))
    scored = encoded.drop("rare", "deal").mapInArrow(tidy(_scorer(shared)), _SCORED)
    rare = encoded.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    logs = rare.join(counts.select("word", F.col("n").alias("c")), "word").groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("_log"), F.sum("n").alias("_seen"))
    more = F.coalesce("_log", F.lit(0.0))
    return scored.join(logs, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("lm") + more).alias("score"),
    )
