"""Near-duplicate documents by SetSketch registers: banded, estimated jointly by likelihood, then verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, stage, tidy
from .words import byte_slices, gram_hashes, hashed_words

SHINGLE = 5
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Registers; a band is ROWS neighbouring ones. At a similarity of 0.75 all BANDS bands miss once in 10^7 pairs.
ROWS, BANDS = 5, 60
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base, rate and the largest register value (two bytes).
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Pairs estimated below this go unverified, and pairs with a smaller share of equal registers than LEAST_EQUAL are not
#: estimated at all: both are five standard errors under the threshold.
LEAST_ESTIMATE, LEAST_EQUAL = 0.62, 0.62
#: Members of a bucket that are compared at once.
BLOCK = 256
#: Members of a hub that one task holds against it.
HUB_MEMBERS = 2000
#: Bytes of text, or of sets, that are worked on at once.
BYTES_AT_ONCE = 4 << 20
_HASH_ROWS = 1024

_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 2**32, REGISTERS, np.uint32)
_MUL = _rng.integers(0, 2**31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The distinct shingle hashes, ascending, of each text, lower-cased (A-Z only)."""
    hashes, bounds, _, _ = hashed_words(texts, fold=True)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        grams = gram_hashes(hashes[a:b], SHINGLE)
        grams.sort()
        yield grams[np.concatenate(([True], grams[1:] != grams[:-1]))] if len(grams) else grams


def set_digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: for each of REGISTERS hashes, the least exponential of a set on a logarithmic scale.

    The least of exponentials is the exponential of the least uniform, so one minimum a register is all that is kept;
    the registers of a union are the larger ones of its parts'.
    """
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), _HASH_ROWS):
        block = x[i : i + _HASH_ROWS, None] ^ _XOR
        block *= _MUL
        np.minimum(low, block.min(axis=0), out=low)
    least = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cells: int = 100) -> np.ndarray:
    """Likeliest similarity of pairs, from rows of registers (a, b) and the sets' sizes (na, nb).

    The likelihood of how many registers are larger, smaller and equal is maximised over a grid of similarities.
    """
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.arange(cells + 1)[None, :] / cells * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * grid), p(v - u * grid)
    tiny = 1e-9
    score = up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, 0) + tiny)
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs may be similar enough. Sizes too different for it are ruled out exactly, the rest by estimate."""
    out = 100 * np.minimum(na, nb) >= THRESHOLD * np.maximum(na, nb)
    out[out] = (a[out] == b[out]).sum(axis=1) >= LEAST_EQUAL * REGISTERS
    at = np.flatnonzero(out)
    for i in range(0, len(at), 4096):
        k = at[i : i + 4096]
        out[k] = estimate(a[k], b[k], na[k], nb[k]) >= LEAST_ESTIMATE
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in byte_slices(batch.column(1), BYTES_AT_ONCE):
            sizes, digests, sketches = [], [], []
            for s in shingle_sets(batch.column(1).slice(a, b - a).to_pylist()):
                sizes.append(len(s))
                digests.append(set_digest(s))
                sketches.append(registers(s).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, sketch): set size, 128-bit digest of the set, registers as big-endian bytes.

    Empty and null texts have size 0 and no digest.
    """
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(_sketch), "doc_id long, n_shingles long, digest binary, sketch binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, body): the shingle hashes of texts whose set is that of the class."""
    for batch in batches:
        for a, b in byte_slices(batch.column(2), BYTES_AT_ONCE):
            ids, digests, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
            own = [(i, s.tobytes()) for i, d, s in zip(ids, digests, shingle_sets(texts), strict=True) if set_digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["class_id", "body"])


def shingle_table(docs: DataFrame, classes: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(class_id, body) of the classes in ids; staged. A doc_id may have several texts, of which one has the class's set."""
    wanted = classes.select("class_id", "digest").join(ids, "class_id", "left_semi")
    body = docs.select(F.col(key).cast("long").alias("class_id"), F.col(text).cast("binary").alias("text"))
    return stage(wanted.join(body, "class_id").select("class_id", "digest", "text").mapInArrow(tidy(_sets), "class_id long, body binary").dropDuplicates(["class_id"]), "sets")


def _beside_hubs(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(hub, salt, member, n, body) with the hub's own row (member null) ahead of its members', sorted in partitions.

    A hub with many members is dealt to several tasks, with a row of its own in each.
    """
    load = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
    body = lambda x: bodies.withColumnRenamed("class_id", x)
    members = pairs.join(load, "hub").select("hub", F.pmod(F.xxhash64("member"), "parts").cast("int").alias("salt"), "member").join(body("member"), "member")
    hubs = load.join(body("hub"), "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("member", F.lit(None).cast("long"))
    rows = hubs.unionByName(members, allowMissingColumns=True).drop("parts")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, member) of those pairs that may be similar enough, from sketches beside hubs."""
    own, n_own = np.empty(0, np.uint16), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sketches = np.frombuffer(b"".join(batch.column("body").to_pylist()), ">u2").reshape(-1, REGISTERS).astype(np.uint16)
        is_hub, n = np.asarray(batch.column("member").is_null()), batch.column("n").to_numpy()
        at = np.cumsum(is_hub) - 1
        hubs, sizes = np.vstack((sketches[is_hub], own[None] if len(own) else np.zeros((1, REGISTERS), np.uint16))), np.append(n[is_hub], n_own)
        member = np.flatnonzero(~is_hub)  # at -1: the hub that the last batch ended with
        keep = np.concatenate([member[i : i + 4096][likely(hubs[at[member[i : i + 4096]]], sketches[member[i : i + 4096]], sizes[at[member[i : i + 4096]]], n[member[i : i + 4096]])] for i in range(0, len(member), 4096)] or [member])
        own, n_own = hubs[at[-1]].copy(), int(sizes[at[-1]])
        yield batch.select(["hub", "member"]).take(pa.array(keep))


def _each_beside_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Of each batch: (hub, member, the hub's set, the member's, where its parts are in the hub's, whether they are)."""
    own = np.empty(0, np.uint64)
    for batch in batches:
        for a, b in byte_slices(batch.column("body"), BYTES_AT_ONCE):
            found = []
            for hub, member, body in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("hub", "member", "body")), strict=True):
                s = np.frombuffer(body, np.uint64)
                if member is None:
                    own = s
                else:
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    found.append((hub, member, own, s, at, own[at] == s))
            yield found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _each_beside_hub(batches):
        links = [(hub, member) for hub, member, own, s, _, hit in rows if 100 * int(hit.sum()) >= THRESHOLD * (len(own) + len(s) - int(hit.sum()))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, class_id, n, bits, rest): a member's set as a bit for each part of its hub's, and the hashes of the rest."""
    for rows in _each_beside_hub(batches):
        bits, rest = [], []
        for _, _, own, s, at, hit in rows:
            has = np.zeros(len(own), bool)
            has[at[hit]] = True
            bits.append(np.packbits(has).tobytes())
            rest.append(s[~hit].tobytes())
        ids = [pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array([len(x[3]) for x in rows], pa.int64()), pa.array(bits, pa.binary()), pa.array(rest, pa.binary())], names=["hub", "class_id", "n", "bits", "rest"])


def links_across(ids: np.ndarray, side: np.ndarray, component: np.ndarray, n: np.ndarray, bits: np.ndarray, rest: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """Links that join the components of some sets: of rows of different sides, or of any two (same).

    Intersections are exact: shared bits, and shared hashes of the rest, which are looked at only where as many as the
    smaller rest has would make a link. Components that a link has joined aren't held against each other again.
    """
    group, left, out = component.copy(), np.array([len(x) for x in rest]), []
    for k in range(len(ids)):
        others = np.arange(k + 1, len(ids))
        others = others[(group[others] != group[k]) & (same | (side[others] != side[k])) & (100 * np.minimum(n[others], n[k]) >= THRESHOLD * np.maximum(n[others], n[k]))]
        if not len(others):
            continue
        both = np.bitwise_count(bits[others] & bits[k]).sum(axis=1, dtype=np.int64)
        most = both + np.minimum(left[others], left[k])
        near = 100 * most >= THRESHOLD * (n[others] + n[k] - most)
        for o, shared in zip(others[near].tolist(), both[near].tolist(), strict=True):
            if group[o] != group[k]:
                shared += len(np.intersect1d(rest[k], rest[o], assume_unique=True))
                if 100 * shared >= THRESHOLD * (n[o] + n[k] - shared):
                    out.append((int(ids[k]), int(ids[o])))
                    group[group == group[o]] = group[k]
    return out


_BLOCK_KEY = ["bucket", "home", "i", "j"]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components, block by block; rows come sorted by block, and the last block waits for its end."""
    waiting: list[pa.RecordBatch] = []

    def links(block: pa.Table) -> list[tuple[int, int]]:
        side, component, ids, n = (block.column(c).to_numpy() for c in ("side", "component", "class_id", "n"))
        bits = np.frombuffer(b"".join(block.column("bits").to_pylist()), np.uint8).reshape(len(ids), -1)
        rest = [np.frombuffer(x, np.uint64) for x in block.column("rest").to_pylist()]
        return links_across(ids, side, component, n, bits, rest, block.column("i")[0] == block.column("j")[0] and not block.column("home")[0].as_py())

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*waiting, batch])
        keys = [table.column(c).to_numpy() for c in _BLOCK_KEY]
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]
        yield out([x for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for x in links(table.slice(a, b - a))])
        waiting = table.slice(cuts[-1]).to_batches()
    if waiting:
        yield out(links(pa.Table.from_batches(waiting)))


def _open_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of members of one bucket, neither of them its hub, that are in different components so far; staged.

    Members in the hub's component (home) are held against the others, and the others against each other, in blocks.
    """
    named = members.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    named = named.filter("members > 2").select("bucket", "hub", "class_id", "component")
    at_home = F.col("component") == F.col("home")
    sums = named.groupBy("bucket").agg(F.max(F.when(F.col("class_id") == F.col("hub"), F.col("component"))).alias("home"), *[f(F.when(F.col("class_id") != F.col("hub"), F.col("component"))).alias(x) for f, x in ((F.min, "_lo"), (F.max, "_hi"))])
    rows = named.join(sums.filter("_lo <> _hi").select("bucket", "home"), "bucket").filter("class_id <> hub")
    rows = stage(rows.withColumn("side", at_home).drop("home"), "open-members")
    pairs = rows.select("hub", F.col("class_id").alias("member")).distinct()
    deltas = stage(_beside_hubs(pairs, sets).mapInArrow(tidy(_deltas), "hub long, class_id long, n long, bits binary, rest binary"), "deltas")
    size = rows.groupBy("bucket").agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(x) for c, x in ((F.col("side"), "homes"), (~F.col("side"), "strays"))])
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("side"), F.col("homes")).otherwise(F.col("strays"))).cast("int")
    all_of = lambda c: F.filter(F.sequence(F.lit(0), F.col(c)), lambda x: x < F.col(c))
    place = lambda home, i, j: F.struct(F.lit(home).alias("home"), i.alias("i"), j.alias("j"))
    with_home = F.transform(all_of("homes"), lambda x: place(True, x, F.col("_own")))
    apart = F.transform(all_of("strays"), lambda x: place(False, F.least(x, F.col("_own")), F.greatest(x, F.col("_own"))))
    places = F.when(F.col("side"), F.transform(all_of("strays"), lambda x: place(True, F.col("_own"), x))).otherwise(F.concat(with_home, apart))
    dealt = rows.join(size, "bucket").withColumn("_own", own).withColumn("_at", F.explode(places))
    # sides: home or not; of two blocks of strays, the one or the other
    dealt = dealt.select("bucket", "hub", "_at.*", "class_id", "component", F.when(F.col("_at.home"), F.col("side").cast("int")).otherwise(F.col("_own")).alias("side"))
    blocks = dealt.join(deltas, ["hub", "class_id"]).select(*_BLOCK_KEY, "side", "class_id", "component", "n", "bits", "rest")
    links = stage(blocks.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY).mapInArrow(tidy(_across), "a long, b long").distinct(), "open-links")
    drop(rows, deltas)
    return links


def _least_shared(n: Column) -> Column:
    """The least intersection, in shingles, of a set of n with any set it is linked to."""
    return F.ceil(n * THRESHOLD / 100)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in byte_slices(batch.column("body"), BYTES_AT_ONCE):
            ids, bodies = (batch.column(c).slice(a, b - a).to_pylist() for c in ("class_id", "body"))
            sizes = np.array([len(x) // 8 for x in bodies], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.frombuffer(b"".join(bodies), np.int64))], names=["class_id", "n", "shingle"])


def rarest_shingles(sets: DataFrame) -> DataFrame:
    """(class_id, n, bucket): of each set of n so many of its rarest shingles that two linked sets share one of them.

    Linked sets share at least _least_shared(n) shingles, so the first n - _least_shared(n) + 1 of each, in any one order
    of all shingles, have one in common. The order is by how many sets have a shingle, so that buckets stay small.
    """
    rows = sets.mapInArrow(tidy(_exploded), "class_id long, n long, shingle long")
    many = rows.groupBy("shingle").agg(F.count("*").alias("sets"))
    some = rows.join(many, "shingle").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("all"))
    some = some.withColumn("first", F.slice("all", F.lit(1), (F.col("n") - _least_shared(F.col("n")) + 1).cast("int")))
    return some.select("class_id", "n", F.explode("first").alias("x")).select("class_id", "n", F.col("x.shingle").alias("bucket"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A document's set: the distinct five-word shingles of its lower-cased words; fewer words are one shingle; texts
    without words (or null) are linked with nothing. Documents whose sets have a similarity of 0.75 or more are linked;
    component_id is the least doc_id that can be reached. Rows of one doc_id are one document; rows without doc_id are
    linked with nothing and have no component_id. Only the two columns are read, whatever the others are called; an empty
    table gives an empty one; a text of any length is one set, whose hashes must fit into a row.

    Equal sets are one class from the start. In each bucket of a band the members are first paired with a hub of the
    bucket alone: the likely pairs are verified on the full sets, and what is linked is united. Members of one bucket
    that are then in different components are held against each other on their full sets, in blocks, each set written
    as its difference from the hub's; so a large group costs its size and not its square.

    Bands and the estimate lose a link of exactly 0.75 a few times in 10^7. exact leaves out both: buckets are the rarest
    shingles of each set, of which linked sets share one, and every pair with a hub is verified. No link is lost then, but
    every shingle is shuffled, and about a quarter of them make buckets.
    """
    sketches = stage(sketch_documents(docs, key, text), "sketches")
    known = sketches.filter("digest is not null and doc_id is not null")
    classes = stage(known.groupBy("digest", "n_shingles", "sketch").agg(F.min("doc_id").alias("class_id")), "classes")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("band", "part")
    if exact:
        every = shingle_table(docs, classes, classes.select("class_id"), key, text)
        bands = stage(rarest_shingles(every), "rarest")
        drop(every)
    else:
        bands = classes.select("class_id", F.col("n_shingles").alias("n"), band).select("class_id", "n", F.xxhash64("band", "part").alias("bucket"))
    shared = stage(bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    met = stage(bands.join(shared, "bucket"), "met")
    drop(shared)
    # the hub of a bucket is the member that meets most others in all its buckets, as an original does its copies
    fame = met.groupBy("class_id").agg((F.sum("members") * (1 << 20) + F.pmod(F.xxhash64("class_id"), F.lit(1 << 20))).alias("fame"))
    hubs = met.join(fame, "class_id").groupBy("bucket").agg(F.max_by(F.struct(F.col("class_id").alias("hub"), F.col("n").alias("n_hub")), F.struct("fame", "class_id")).alias("h")).select("bucket", "h.*")
    members = stage(met.join(hubs, "bucket"), "members")
    drop(met)

    alike = 100 * F.least("n", "n_hub") >= THRESHOLD * F.greatest("n", "n_hub")
    stars = members.filter("hub <> class_id").filter(alike).select("hub", F.col("class_id").alias("member")).distinct()
    bodies = classes.select("class_id", F.col("n_shingles").alias("n"), F.col("sketch").alias("body"))
    stars = stage(stars if exact else _beside_hubs(stars, bodies).mapInArrow(tidy(_likely), "hub long, member long").distinct(), "stars")
    ends = stars.select(F.col("hub").alias("class_id")).union(stars.select("member")).union(members.filter("members > 2").select("class_id")).distinct()
    sets = shingle_table(docs, classes, ends, key, text)
    links = stage(_beside_hubs(stars, sets).mapInArrow(tidy(_verified), "a long, b long"), "confirmed")
    drop(stars)
    labels = components(links)
    more = _open_links(members, labels, sets)
    drop(sets)

    classed = sketches.join(classes.select("digest", "class_id"), "digest", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    classed = classed.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component"))
    # what joins components: links across, and doc_ids with several texts
    across = more
    for x in ("a", "b"):
        across = across.join(labels.select(F.col("node").alias(x), F.col("component").alias("_c")), x, "left").withColumn(x, F.coalesce("_c", x)).select("a", "b")
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).filter("_lo <> _hi").select("doc_id")
    again = classed.join(twice, "doc_id").select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
    top = components(across.union(again)).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    out = classed.join(top, "component", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_top", "component")))
    drop(members, links, more)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
