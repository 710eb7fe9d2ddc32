"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy
from .words import Table

#: Fixed: what stands for a space in pieces.
SPACE = "▁"
#: A piece of rank r has a weight of (r + RANK_SHIFT) ** -alpha; a byte counts as the rank after the last.
RANK_SHIFT = 10
#: Characters that are sampled at once.
CHARS_AT_ONCE = 200_000
#: Steps of a forward pass that fewer lattices than this still take are done one node at a time.
NARROW = 4
#: Pieces hold spaces only at their start, or nothing but spaces; none holds a line feed. So no piece crosses a unit.
_UNIT = re.compile(r" *[^ \n]+| +|\n")
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def default_model() -> str:
    """The public 32k model's path on this machine; any other SentencePiece model's path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    def __init__(self, path: str, alpha: float) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(byte) < 256:
            raise ValueError("the model must have a piece for every byte")
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        weigh = lambda rank: (rank + RANK_SHIFT) ** -alpha
        self.weights = {model.id_to_piece(i).replace(SPACE, " "): (i, weigh(rank)) for rank, i in enumerate(ranked)}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32)
        self.byte_weight = weigh(len(ranked))
        self.longest = max(map(len, self.weights))
        self.bytes = {i: model.id_to_piece(i).replace(SPACE, " ").encode() for i in plain} | {i: bytes([b]) for b, i in byte.items()}
        # a trie: node and character -> node; at a node, the piece that ends there (or -1) and its log weight
        steps, ends = {}, {}
        for piece, (i, w) in self.weights.items():
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = i, math.log(w)
        self.steps = Table(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32))
        self.piece_at, self.log_at = np.full(len(steps) + 1, -1, np.int32), np.zeros(len(steps) + 1)
        for node, (i, w) in ends.items():
            self.piece_at[node], self.log_at[node] = i, w

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes: the pieces' bytes without the space that encoding puts before the text."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


class Lattices:
    """The piece lattices of some units, filtered forwards in whole arrays.

    A unit has a node after each of its characters; nodes are numbered by their distance from the start, so that those
    of one distance, and the edges into them, are neighbours. Edges carry the chance, given the node, that the piece
    into it is theirs. Node and cumulated chance are one ascending array (node + chance), so that one binary search
    samples an edge for any number of nodes at once. An edge gives one piece, or (-1 - code point) a character's bytes.
    """

    def __init__(self, vocab: Vocabulary, units: list[str]) -> None:
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes, rank = sizes[order], np.empty(len(units), np.int64)
        rank[order] = np.arange(len(units))
        points = np.frombuffer("".join([units[i] for i in order.tolist()]).encode("utf-32-le"), np.uint32).astype(np.int64)
        unit, ends = np.repeat(np.arange(len(units)), sizes), np.repeat(np.cumsum(sizes), sizes)
        place = np.arange(len(points)) - (ends - sizes[unit])
        wide = np.bincount(place, minlength=1)  # nodes of each distance
        first = np.concatenate(([0], np.cumsum(wide)))
        node = first[place] + unit
        self.last = node[np.cumsum(sizes) - 1][rank] if len(units) else np.empty(0, np.int64)
        into, alive, state = np.zeros(len(points), np.int64), np.arange(len(points)), np.zeros(len(points), np.int64)
        found, plain = [], np.zeros(len(points), bool)
        for length in range(1, vocab.longest + 1):
            state = vocab.steps.get(state << 21 | points[alive + length - 1])
            on = state >= 0
            alive, state = alive[on], state[on].astype(np.int64)
            piece = vocab.piece_at[state]
            whole = piece >= 0
            start = alive[whole]
            to = node[start + length - 1]
            into[to] += 1
            if length == 1:
                plain[start] = True
            found.append((start, to, piece[whole], vocab.log_at[state[whole]]))
            on = alive + length < ends[alive]
            alive, state = alive[on], state[on]
            if not len(alive):
                break
        other = np.flatnonzero(~plain)
        into[node[other]] += 1
        found.insert(0, (other, node[other], -1 - points[other], math.log(vocab.byte_weight) * _utf8_size(points[other])))
        self.edges = np.concatenate(([0], np.cumsum(into)))
        at, total = self.edges[:-1].copy(), int(self.edges[-1])
        self.back, self.out, log = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total)
        for start, to, piece, weight in reversed(found):  # the earliest start first; a character's bytes last
            edge = at[to]
            at[to] += 1
            self.back[edge] = np.where(place[start] > 0, node[start - 1], -1)
            self.out[edge], log[edge] = piece, weight
        chance, filtered = np.empty(total), np.zeros(len(points) + 1)  # the last is the start of all
        done = 0
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a < NARROW:
                break
            own = slice(self.edges[a], self.edges[b])
            heads, n = self.edges[a:b] - self.edges[a], into[a:b]
            x = log[own] + filtered[self.back[own]]
            most = np.maximum.reduceat(x, heads)
            x -= np.repeat(most, n)
            np.exp(x, out=x)
            mass = np.add.reduceat(x, heads)
            filtered[a:b] = most + np.log(mass)
            chance[own] = x / np.repeat(mass, n)
            done = b
        self._rest(done, len(points), log, chance, filtered)
        cum = np.cumsum(chance)
        heads = self.edges[:-1]
        self.cdf = cum - np.repeat(cum[heads] - chance[heads] - np.arange(len(points)), into)
        self.cdf[self.edges[1:] - 1] = np.arange(1, len(points) + 1)

    def _rest(self, a: int, b: int, log: np.ndarray, chance: np.ndarray, filtered: np.ndarray) -> None:
        """The forward pass over nodes a to b, one after another."""
        if a == b:
            return
        edges, low = self.edges[a : b + 1].tolist(), int(self.edges[a])
        back, weight, new = self.back[low:].tolist(), log[low:].tolist(), []
        before = {i: float(filtered[i]) for i in {x for x in back if x < a}}
        for k in range(b - a):
            x = [weight[e] + (before[i] if (i := back[e]) < a else new[i - a]) for e in range(edges[k] - low, edges[k + 1] - low)]
            most = max(x)
            x = [math.exp(v - most) for v in x]
            mass = sum(x)
            new.append(most + math.log(mass))
            chance[edges[k] : edges[k + 1]] = [v / mass for v in x]
        filtered[a:b] = new

    def sample(self, last: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling from the last nodes: the edges of all units one after another, and their numbers."""
        active, at, steps, step = np.arange(len(last)), last, [], 0
        counts = np.zeros(len(last), np.int64)
        while len(active):
            u = (mixed(seeds[active] + np.uint64(step * _STEP % 2**64)) >> np.uint64(11)) * 2.0**-53
            edge = np.minimum(np.searchsorted(self.cdf, at + u, side="right"), self.edges[at + 1] - 1)
            steps.append((active, edge))
            counts[active] += 1
            before = self.back[edge]
            more = before >= 0
            active, at, step = active[more], before[more], step + 1
        ends = np.cumsum(counts)
        edges = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (who, edge) in enumerate(steps):
            edges[ends[who] - 1 - k] = edge
        return edges, counts


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{key}".encode(), seed=seed)


def encode_batch(vocab: Vocabulary, keys: list, texts: list[str | None], seed: int) -> list[np.ndarray]:
    """Sampled piece ids of each text; the same for a key, text and seed wherever the row is."""
    units, sizes, seeds = [], [], []
    for key, text in zip(keys, texts, strict=True):
        own = _UNIT.findall(f" {text}") if text else []
        units += own
        sizes.append(len(own))
        seeds.append(row_seed(key, seed))
    known: defaultdict[str, int] = defaultdict(count().__next__)
    which = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
    sizes = np.array(sizes, np.int64)
    place = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = mixed(np.repeat(np.array(seeds, np.uint64), sizes) + place.astype(np.uint64) * _MIX1)
    lattices = Lattices(vocab, list(known))
    edges, counts = lattices.sample(lattices.last[which], own)
    out = lattices.out[edges]
    cuts = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(sizes)))]
    spelled = out < 0
    if spelled.any():
        points = -1 - out[spelled]
        times = np.ones(len(out), np.int64)
        times[spelled] = _utf8_size(points)
        raw = np.frombuffer(points.astype(np.uint32).tobytes().decode("utf-32-le").encode(), np.uint8)
        cuts = np.concatenate(([0], np.cumsum(times)))[cuts]
        spelled, out = np.repeat(spelled, times), np.repeat(out, times)
        out[spelled] = vocab.byte_ids[raw]
    return np.split(out.astype(np.int32), cuts[1:-1])


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS_AT_ONCE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """docs' columns without text, then n_pieces long, pieces array<int> and lossless boolean (decoding gives the text);
    columns of these three names are replaced, others are kept whatever their names.

    Each text is segmented by sampling its piece lattice: chances are filtered forwards and pieces drawn backwards,
    with numbers seeded by the row's key, so a rerun or another partitioning gives the same pieces. alpha flattens
    (under 1) or sharpens the pieces' weights. Null and empty texts have no pieces; a character that is no piece is
    encoded as its bytes; rows without key share a seed. Rows that repeat a key and text get the same pieces; an empty
    table gives an empty one. No row needs another one, so nothing is shuffled. model is the path of a SentencePiece model on the executors.
    """
    kept = [c for c in docs.columns if c not in (text, "n_pieces", "pieces", "lossless")]
    path, body = model or default_model(), "_" * (1 + max(map(len, docs.columns)))
    ready = docs.select(*kept, F.col(text).alias(body))
    fields = docs.select(*kept).withColumns({"n_pieces": F.lit(0).cast("long"), "pieces": F.array().cast("array<int>"), "lossless": F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, alpha)
        for batch in batches:
            keys, texts = batch.column(kept.index(key)).to_pylist(), batch.column(len(kept)).to_pylist()  # a few MB
            for part in _slices(texts):
                ids = encode_batch(vocab, keys[part], texts[part], seed)
                fine = [vocab.decode(i.tolist()) == (t or "").encode() for i, t in zip(ids, texts[part], strict=True)]
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                rows = batch.slice(part.start, len(ids))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(sizes), lists, pa.array(fine, pa.bool_())], names=fields.names)

    return ready.mapInArrow(tidy(run), fields)


def pieces_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256 of the comma-joined ids, lossless) for every row of docs."""
    found = encode(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_pieces", F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ","), 256).alias("pieces_sha256"), "lossless")


def log_chance(vocab: Vocabulary, unit: str) -> float:
    """The log of the summed weights of all segmentations of a unit (for tests)."""
    a = [1.0]
    for j in range(1, len(unit) + 1):
        total = sum(a[i] * vocab.weights[unit[i:j]][1] for i in range(j) if unit[i:j] in vocab.weights)
        if unit[j - 1 : j] not in vocab.weights:
            total += a[j - 1] * vocab.byte_weight ** len(unit[j - 1].encode())
        a.append(total)
    return math.log(a[-1])


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
