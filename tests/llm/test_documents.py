import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from memoryloom.llm import components, decontaminate, fingerprints, lm, neardup, order, pieces, quality, repeats, sharding
from memoryloom.llm.gru import Gru, log_likelihoods, train

from .helpers import corpus, frame, lower_words, sentence, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


def shingles(text):
    w = lower_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_match_brute_force(docs, rows):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and (i == j or (a and b and 100 * len(a & b) >= 75 * len(a | b))):
                    label[i] = label[j] = min(label[i], label[j])
    want = Counter((i, len(s), label.get(i), i == label.get(i)) for i, s in sets)
    assert Counter(tuple(r) for r in neardup.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("block, members", [(256, 2000), (3, 2)])
def test_near_duplicates_in_large_groups(spark, block, members, monkeypatch):
    """Groups whose members are linked with their original, with each other alone, or with nothing: no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "HUB_MEMBERS", members)
    rng, rows = np.random.default_rng(11), []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        for cut in [0] * 2 + [8] * 8 + [14] * 8 + [17] * 12 + [25] * 4:  # so many words' shingles differ, in one run
            at = int(rng.integers(0, 120 - cut))
            rows.append((int(rng.integers(0, 10**9)), " ".join([*base[:at], *(f"x{x}" for x in rng.integers(0, 10**6, cut)), *base[at + cut :]])))
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if label[j] < label[i] and 100 * len(a & b) >= 75 * len(a | b):
                    label[i], changed = label[j], True
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, rows).repartition(5)).collect()}
    assert got == label and 20 < len(set(label.values())) < len(rows)


def test_pairs_over_the_threshold_are_found(spark):
    """2,000 planted pairs with a similarity of 0.75 to 0.8: all are linked."""
    rng, rows, want = np.random.default_rng(12), [], 0
    for p in range(2000):
        n = int(rng.integers(60, 140))
        base = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        size, most = n - 4, max(c for c in range(n) if 100 * (n - 4 - c) >= 75 * (n - 4 + c)) - 4  # a run of k words at the inside changes k + 4 shingles
        at = int(rng.integers(5, n - most - 5))
        other = [*base[:at], *(f"x{x}" for x in rng.integers(0, 10**9, most)), *base[at + most :]]
        both = size - most - 4
        want += 0.75 <= both / (2 * size - both) < 0.8
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(other))]
    got = neardup.near_duplicates(frame(spark, rows).repartition(4)).filter("doc_id % 2 = 1").collect()
    assert want == 2000 and all(r["component_id"] == r["doc_id"] - 1 for r in got)


def test_exact_near_duplicates_lose_no_link(spark, docs, rows, monkeypatch):
    """Pairs at the threshold and just under it, found without bands and estimate, which would find none here."""
    want = Counter(tuple(r) for r in neardup.near_duplicates(docs).collect())
    monkeypatch.setattr(neardup, "LEAST_EQUAL", 2.0)
    assert Counter(tuple(r) for r in neardup.near_duplicates(docs, exact=True).collect()) == want
    texts, linked, common = [], {}, sentence(random.Random(1), 60)
    for i in range(60):
        # a text of n shingles, and one that lacks its last k of them: a similarity of (n - k) / n
        rng = random.Random(100 + i)
        n = 4 * rng.randint(10, 50)
        k = n // 4 + i % 2
        body = (common + " " + sentence(rng, 200)).split(" ")[: n + 4] if i % 3 else sentence(rng, n + 4).split(" ")
        assert len({tuple(body[j : j + 5]) for j in range(n)}) == n
        texts += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body[: n + 4 - k]))]
    sets = {i: {tuple(w) for w in zip(*(t.split(" ")[j:] for j in range(5)), strict=False)} for i, t in texts}
    linked = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and linked[a] != linked[b]:
                low, high = sorted((linked[a], linked[b]))
                linked = {i: low if x == high else x for i, x in linked.items()}
    assert 30 <= sum(linked[2 * i + 1] == linked[2 * i] for i in range(60)) < 60
    got = neardup.near_duplicates(frame(spark, texts).repartition(3), exact=True).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == linked


def test_links_across_components_match_brute_force():
    rng = np.random.default_rng(13)
    for same in (True, False):
        hub = np.unique(rng.integers(0, 2**63, 60, np.uint64))
        sets = [np.union1d(hub[rng.random(len(hub)) < rng.choice([0.4, 0.93])], rng.integers(0, 2**63, int(rng.integers(0, 9)), np.uint64)) for _ in range(40)]
        sets += [np.union1d(s[1:], hub[:2]) for s in sets[:10]]
        ids, side, component = np.arange(50), rng.integers(0, 2, 50), rng.integers(0, 30, 50)
        n, has = np.array([len(s) for s in sets]), np.array([np.isin(hub, s) for s in sets])
        got = neardup.links_across(ids, side, component, n, np.packbits(has, axis=1), [np.setdiff1d(s, hub) for s in sets], same)
        alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))
        want = [(i, j) for i in range(50) for j in range(i + 1, 50) if (same or side[i] != side[j]) and alike(i, j)]

        def joined(links, c=component):
            c = c.copy()
            for i, j in links:
                c[c == c[j]] = c[i]
            return len(set(c.tolist()))

        assert set(got) <= set(want) and joined(got) == joined(want) < len(set(component.tolist()))


@pytest.mark.parametrize("fold", [False, True])
def test_word_hashes_tell_words_apart(fold, monkeypatch):
    from memoryloom.llm import words as w

    monkeypatch.setattr(w, "BLOCK_BYTES", 50)
    texts = [None, b"", b" \t", b"one Two one", sentence(__import__("random").Random(2), 300).encode(), b"x" * 200 + b"\x0by", b"TWO\n"]
    hashes, bounds, start, end = w.hashed_words(texts, fold)
    plain = [(x.lower() if fold else x) for t in texts for x in (t or b"").split()]
    assert np.diff(bounds).tolist() == [len((t or b"").split()) for t in texts]
    assert len(set(zip(plain, hashes.tolist(), strict=True))) == len(set(plain)) == len(set(hashes.tolist()))
    data = b" ".join(t or b"" for t in texts)
    assert [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)] == [x for t in texts for x in (t or b"").split()]
    assert w.hashed_words([], fold)[1].tolist() == [0]


def test_near_duplicates_of_nothing(docs):
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**64, 400, np.uint64)) for _ in range(2))
    assert (neardup.registers(np.union1d(a, b)) == np.maximum(neardup.registers(a), neardup.registers(b))).all()
    c = np.concatenate((a[:350], b[:50]))
    est = neardup.estimate(neardup.registers(a)[None], neardup.registers(c)[None], np.array([len(a)]), np.array([len(c)]))
    assert abs(est[0] - 350 / 450) < 0.15


def test_pairs_at_the_threshold_are_not_cut():
    assert (1 - 0.75**neardup.ROWS) ** neardup.BANDS < 2e-7
    rng = np.random.default_rng(4)
    a = rng.integers(20_000, 30_000, (20_000, neardup.REGISTERS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.75, a, a + rng.choice([-50, 50], a.shape)).astype(np.uint16)
    n = np.full(len(a), 400)
    assert neardup.likely(a, b, n, n).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 19 if i is not None else 0):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19 if i is not None else 0):
            if (i, s) > first[tuple(w[s : s + 20])]:
                gone[s : s + 20] = [True] * 20
        yield i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()


@pytest.mark.parametrize("heavy", [4000, 2])
def test_repeats_match_brute_force(docs, rows, heavy, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)  # 2: every anchor is dealt to several tasks
    assert Counter(tuple(r) for r in repeats.remove_repeats(docs).collect()) == Counter(brute_repeats(rows))


@pytest.mark.parametrize("heavy, chunk", [(2, 4000), (5, 7), (512, 3)])
def test_repeats_of_heavy_passages_match_brute_force(spark, heavy, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = __import__("random").Random(8)
    passages, rows = [sentence(rng, 30) for _ in range(3)], []
    for i in range(80):
        parts = [sentence(rng, rng.randint(1, 25)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = p.split(" ")[rng.randint(0, 9) : rng.randint(22, 30)]
            parts.insert(rng.randint(0, len(parts)), " ".join(cut))
        rows.append((rng.randint(0, 10**6) * 100 + i, "  ".join(parts)))
    assert Counter(tuple(r) for r in repeats.remove_repeats(frame(spark, rows).repartition(4)).collect()) == Counter(brute_repeats(rows))


def test_repeats_across_chunks():
    import pyarrow as pa

    rng = __import__("random").Random(5)
    body = sentence(rng, 20).encode()
    cols = {"gram": [1] * 9000, "salt": [0] * 9000, "parts": [1] * 9000, "doc_id": list(range(9000)), "tkey": [0] * 9000, "lo": [0] * 9000, "body": [body] * 9000}
    types = {"salt": pa.int32(), "parts": pa.int32(), "lo": pa.int32(), "body": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()], names=list(cols))
    found = [r for b in repeats._locate(iter([batch])) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in found) == list(range(1, 9000))


def test_sharding_is_balanced_and_gapless(docs, rows):
    got = sharding.shard_by_bytes(docs, 4, rows_per_bucket=5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, target = Counter(), sum(r["size"] for r in got) / 4
    for shard in range(4):
        own = [r for r in got if r["shard"] == shard]
        sizes[shard] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sizes[shard] - target) <= max(r["size"] for r in got)
    assert sharding.shard_by_bytes(docs.limit(0), 4).collect() == []


def test_buckets_are_found_by_binary_search(spark):
    cuts = [-5, 0, 3, 9, 10]
    got = spark.range(-7, 13).withColumn("b", order.bucket_of(__import__("pyspark").sql.functions.col("id"), cuts)).collect()
    assert all(r["b"] == sum(c <= r["id"] for c in cuts) for r in got)


def brute_overlaps(rows, items):
    norm = lambda t: decontaminate.normal_words((t or "").encode())
    wins = {}
    for item, t in items:
        w = norm(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k and item is not None else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    for i, t in rows:
        w, found = norm(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if owners := wins.get(tuple(w[s : s + k])):
                    hit[s : s + k] = [True] * k
                    found |= owners
        yield i, len(w), sum(hit), len(found), decontaminate.items_digest(list(found)), any(hit)


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_overlaps_match_brute_force(spark, rows, block):
    passage = corpus()[-1][1]
    items = [(1, passage), (2, " ".join(passage.split()[5:30]).upper()), (3, "One, two"), (4, None), (5, "..."), (3, "one two"), (None, "x x"), (6, "x"), (7, sentence(__import__("random").Random(9), 40))]
    rows = [*rows, (90, passage.replace(" ", "-")), (91, "two one two three"), (92, "prefix " + " ".join(passage.split()[:15]) + " break " + " ".join(passage.split()[20:31]))]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_overlaps(docs, bench, block_bytes=block).collect()
    got = Counter((r["doc_id"], r["n_words"], sum(r["hit_runs"][1::2]) - sum(r["hit_runs"][::2]), len(r["items"]), decontaminate.items_digest(r["items"]), bool(r["hit_runs"])) for r in found)
    assert got == Counter(brute_overlaps(rows, items))
    if block > 1000:
        assert Counter(tuple(r) for r in decontaminate.overlap_digest(docs, bench).collect()) == got


def test_overlaps_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = frame(spark, [(1, "Keep this, please. " + item + " And THIS stays here for a good while, as it is clean text."), (2, item), (3, "Nothing; to do"), (4, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_overlaps(docs, bench).collect()}
    assert got == {1: "Keep this, please.   And THIS stays here for a good while, as it is clean text.", 3: "Nothing; to do", 4: None}
    assert decontaminate.remove_overlaps(docs, bench).columns == docs.columns
    assert decontaminate.remove_overlaps(docs, bench.limit(0)).count() == 4


def test_suffix_automaton_lengths():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 4, n).tolist() for n in (9, 30, 1, 17)]
    sam = decontaminate.SuffixAutomaton()
    for x in items:
        sam.add(x)
    text = rng.integers(0, 5, 200).tolist()
    inside = lambda run: any(run == x[i : i + len(run)] for x in items for i in range(len(x)))
    for i, n in enumerate(sam.longest(text)):
        assert n == max((k for k in range(1, i + 2) if inside(text[i + 1 - k : i + 1])), default=0)


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_documents(docs).collect()
    prints = {}
    for r in got:
        prints.setdefault(r["fingerprint"], 0)
    by = {}
    for i, t in rows:
        by.setdefault(i, set()).add(t or "")
    chain = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: x[0])
    assert len(got) == len(rows)
    same = {}
    for r in got:
        for t in by[r["doc_id"]]:
            same.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())  # equal texts, equal fingerprints
    found = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 24)
    for k, (i, t) in enumerate(chain):
        if i < 23:
            nxt, q = chain[k + 1][1], len(t) // 4
            assert found[i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()]
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))


def test_fingerprint_likeness_is_unbiased(spark):
    rng = __import__("random").Random(4)
    rows, truth = [], []
    for i in range(60):
        a = sentence(rng, 300).split()
        cut = rng.randint(50, 280)
        b = a[:cut] + sentence(rng, 300 - cut).split()
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (a, b))
        truth.append(len(x & y) / len(x | y))
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()}
    error = np.array([got[2 * i] - t for i, t in enumerate(truth)])
    assert abs(error.mean()) < 0.025 and error.std() < 0.07
    assert fingerprints.fingerprint_documents(frame(spark, [(7, "only one here")])).first()["near_next"] == 1.0


def plain_fingerprint(text):
    """One-permutation MinHash, one shingle and one bin after another."""
    import re

    import xxhash

    def chain(*parts):
        seed = 42
        for p in parts:
            if p is not None:
                seed = xxhash.xxh64_intdigest(p, seed=seed)
        return seed

    bins, shift = fingerprints.BINS, 63 - (fingerprints.BINS - 1).bit_length()
    words = [chain(w.encode()).to_bytes(8, "little") for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    least = [None] * bins
    for i in range(max(len(words) - 5, 0) + 1 if words else 0):
        h = chain(*words[i : i + 5]) >> 1
        least[h >> shift] = min(h, least[h >> shift] or h)
    out, small = [], lambda x: x.to_bytes(4, "little")
    for i in range(bins):
        found = least[i]
        tries = [chain(small(i), small(t)) for t in range(fingerprints.PROBES)]
        step = chain(small(i))
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        order = [signed(t) % bins for t in tries] + [(i + t * (signed(step) % bins * 2 + 1)) % bins for t in range(bins)]
        found = next((least[b] for b in order if least[b] is not None), 0) if found is None else found
        out.append(f"{found & 255:02x}")
    return "".join(out)


def test_fingerprints_match_brute_force(spark):
    rng = __import__("random").Random(14)
    rows = [(0, None), (1, ""), (2, " \x0b "), (3, "one"), (4, "four words are here"), *((i, sentence(rng, rng.choice([5, 6, 9, 60, 800]))) for i in range(5, 40)), (50, "lo ng " * 40_000)]
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    texts = dict(rows)
    order = sorted(texts)
    for r in got:
        text, after = texts[r["doc_id"]] or "", texts[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        q = len(text) // 4
        own, edited, follows = plain_fingerprint(text), plain_fingerprint(text[: len(text) - q] + after[:q]), plain_fingerprint(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, edited)
        like = lambda a, b: max(0.0, (sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128 - 2**-8) / (1 - 2**-8))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(like(own, edited)), pytest.approx(like(own, follows)))


def test_quality_scores_match_brute_force(spark):
    import zstandard

    rng = __import__("random").Random(15)
    good, junk = (lambda n: sentence(rng, n)), (lambda n: " ".join(rng.choice(["%%%", "###", "!!"]) + rng.choice("XYZ") for _ in range(n)))
    rows = [(i, (good if i % 2 else junk)(rng.choice([10, 80, 300]))) for i in range(200)] + [(900, None), (901, ""), (902, good(30_000)), (903, junk(30_000))]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, marks).collect()}
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good)]
    for i, t in rows:
        data = (t or "").encode()
        cuts = [data[a : a + quality.PIECE] for a in range(0, len(data), quality.PIECE)] or [b""]
        bad, fine = (sum(len(p.compress(c)) for c in cuts) for p in packers)
        gap, density = (bad - fine) / (bad + fine), min(2.0, (bad + fine) / 2 / max(1, len(data)))
        x = [gap, density, gap**2, density**2, gap * density, 1 / (1 + len(data) / 64)]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-6)
    assert got[902] > 0.5 > got[903]


def test_quality_learns_from_long_texts(spark):
    """All labelled texts are longer than the sample holds of one: pieces from all through them are learned from."""
    rng = __import__("random").Random(16)
    rows = [(i, (sentence(rng, 3000) if i % 2 else " ".join(rng.choice(["%%%", "!!"]) + rng.choice("XYZ") for _ in range(3000)))) for i in range(24)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.fit(docs, marks, sample_bytes=4096)
    got = quality.score(docs.select("doc_id", "text"), model).collect()
    assert model and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)
    body = bytes(range(256)) * 40
    cut = spark.createDataFrame([(body,)], "b binary").select(quality.sampled(__import__("pyspark").sql.functions.col("b"), 1600).alias("x")).first()["x"]
    assert len(cut) == 1600 and bytes(cut[:100]) == body[:100] and bytes(cut[-100:]) == body[-100:]


def test_quality_counts_a_repeated_labelled_id_once(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"{'spam' if i % 2 else 'prose'}{rng.randint(0, 60)}" for _ in range(40))) for i in range(300)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    plain = quality.fit(frame(spark, rows), marks)
    hot = rows + [rows[i] for i in (2, 3) for _ in range(2000)]
    again = marks.union(marks.filter("doc_id in (2, 3)")).union(spark.createDataFrame([(10_000 + i, 1) for i in range(500)], marks.schema))
    assert quality.fit(frame(spark, hot), again) == plain  # repeated rows, repeated labels, and labels of no document


def test_quality_learns_and_bears_all_rows(spark):
    rng = __import__("random").Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        rows.append((i, sentence(rng, 60) if good else " ".join(rng.choice(["%%%", "###", "!!"]) + rng.choice("XYZ") for _ in range(80))))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "abc " * 40_000), (5, rows[5][1])]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (2000, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in quality.classify(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, marks).columns == docs.columns


@pytest.mark.parametrize("head", [1 << 16, 40])
def test_language_model_base_and_gain(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "NEURAL_WORDS", 30)
    rng = __import__("random").Random(8)
    rows = [(i, " ".join(rng.choice(["aa bb cc dd", "ee ff gg hh"][i % 2].split()) for _ in range(60)) + f" rare{i}") for i in range(150)]
    rows += [(200, None), (201, ""), (None, "aa bb"), (3, rows[3][1]), (202, "new NEW aa")]
    docs = frame(spark, rows).repartition(2)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*lower_words(t), b""])
    n, v, want = sum(counts.values()), len(counts), Counter()
    for i, t in rows:
        w = [*lower_words(t), b""]
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    got = lm.score_documents(docs).collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    if head > 40:
        assert lm.score_documents(docs.limit(0)).collect() == []


def test_language_model_counts_the_end_of_few_long_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 40)
    docs = frame(spark, [(i, " ".join(f"w{k} " * (10 + k) for k in range(200))) for i in (2, 3, 4)])
    assert not docs.filter(lm.held_out(docs.doc_id)).count()
    counts = Counter({f"w{k}": 3 * (10 + k) for k in range(200)} | {"": 3})
    n, v = sum(counts.values()), len(counts)
    want = sum(c // 3 * np.log10((c + 1) / (n + v + 1)) for c in counts.values())
    for r in lm.score_documents(docs).collect():
        assert r["n_known"] == r["n_tokens"] == n // 3 and r["base_score"] == pytest.approx(want)


def test_language_model_learns_from_all_documents(spark):
    rng = __import__("random").Random(9)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(1000))) for i in range(300)] + [(i, "ee ff " * 500) for i in range(300, 400)]
    got = lm.score_documents(frame(spark, rows).coalesce(1)).filter("doc_id >= 300").collect()
    assert all(r["score"] * np.log(10) / r["n_tokens"] > -0.5 for r in got)  # a model of the first rows alone knows neither word


@pytest.mark.parametrize("trainer_tokens", [700, 4_000_000])
def test_language_model_does_not_follow_partitions(spark, trainer_tokens):
    rng = __import__("random").Random(21)
    rows = [(i, " ".join(rng.choice(["the", "a", "of", "to", "in", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    two, eight = ({r["doc_id"]: r["score"] for r in lm.score_documents(frame(spark, x).repartition(n), trainer_tokens=trainer_tokens).collect()} for x, n in ((rows, 2), (rows[::-1], 8)))
    assert two == pytest.approx(eight, rel=1e-5)


def plain_log_likelihood(m, ids, class_of, member_of, end):
    """One token after another, in double precision."""
    f = np.float64
    state, total, before = np.zeros(m.h.shape[0]), 0.0, end
    k = len(state)
    for i in ids:
        x, g = m.x[before].astype(f), state @ m.h.astype(f)
        z, r = (1 / (1 + np.exp(-(x[j : j + k] + g[j : j + k]))) for j in (0, k))
        n = np.tanh(x[2 * k :] + r * g[2 * k :])
        state = (1 - z) * n + z * state
        logits = state @ m.c.astype(f) + m.cb
        c = class_of[i]
        total += logits[c] - np.log(np.exp(logits).sum())
        if m.size[c] > 1:
            own = m.w[m.first[c] : m.first[c] + m.size[c]].astype(f) @ state + m.wb[m.first[c] : m.first[c] + m.size[c]]
            total += own[member_of[i]] - np.log(np.exp(own).sum())
        before = i
    return total


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    model = Gru.start(6, np.array([7.0, 3.0, 2.0]), np.array([4.0, 3, 2, 1]), np.array([0, 2, 0]), np.array([2, 2, 0]))
    for name, scale in (("x", 1), ("h", 0.6), ("c", 0.7), ("w", 0.7)):
        a = getattr(model, name)
        a[:] = rng.normal(0, scale, a.shape)
    return model, np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 0])


def test_whole_documents_match_a_plain_network(monkeypatch):
    model, class_of, member_of = small_model()
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 6, n), 0).astype(np.int32) for n in (0, 1, 15, 16, 17, 333, 40, 5, 2, 90)]
    want = [plain_log_likelihood(model, d, class_of, member_of, 0) for d in docs]
    for lanes, tokens in ((512, 1 << 21), (2, 100), (1, 1)):
        monkeypatch.setattr("memoryloom.llm.gru.LANES", lanes)
        monkeypatch.setattr("memoryloom.llm.gru.LAYOUT_TOKENS", tokens)
        assert log_likelihoods(model, docs, class_of, member_of, 0) == pytest.approx(want, rel=1e-4)


def test_backpropagation_through_time_matches_differences():
    from memoryloom.llm.gru import Trainer

    model, class_of, member_of = small_model(3)
    rng = np.random.default_rng(4)
    ids, want = rng.integers(0, 6, (3, 8)), rng.integers(0, 6, (3, 8))
    fresh, live = np.zeros((3, 8), bool), np.ones((3, 8), bool)
    fresh[0, 3] = fresh[1, 0] = True
    live[2, 6:] = False
    state = rng.normal(0, 0.3, (3, model.h.shape[0])).astype(np.float32)
    _, dx, dh, grads = Trainer(model).gradients(state, ids, fresh, live, class_of[want], member_of[want])

    def loss():
        out, _ = model.steps(state, ids, fresh)
        lit = live.T.ravel()
        return -float(model.losses(out.reshape(-1, state.shape[1])[lit], class_of[want].T.ravel()[lit], member_of[want].T.ravel()[lit])[0].astype(np.float64).sum())

    summed = np.zeros_like(model.x)
    np.add.at(summed, ids.T.ravel(), dx.reshape(-1, dx.shape[2]))
    for name, got in (("h", dh), ("x", summed), ("c", grads["c"]), ("cb", grads["cb"])):
        a = getattr(model, name).reshape(-1)
        for i in rng.integers(0, a.size, 25).tolist():
            was, ends = a[i], []
            for step in (0.02, -0.02):
                a[i] = was + step
                ends.append(loss())
            a[i] = was
            assert abs((ends[0] - ends[1]) / 0.04 - got.reshape(-1)[i]) < 5e-3 + 5e-3 * abs(got.reshape(-1)[i]), (name, i)


def test_a_training_window_steps_each_table_once(monkeypatch):
    from memoryloom.llm.gru import Trainer

    model, class_of, member_of = small_model(3)
    stepped, step, trainer = [], Trainer._step, Trainer(model)
    monkeypatch.setattr(Trainer, "_step", lambda self, name, *a: stepped.append(name) or step(self, name, *a))
    ids = np.zeros((3, 8), int)
    trainer.window(np.zeros((3, model.h.shape[0]), np.float32), ids, np.zeros((3, 8), bool), np.ones((3, 8), bool), class_of[ids], member_of[ids])
    assert sorted(stepped) == sorted(Gru.NAMES)
    of = class_of[0]
    others = [i for i in range(len(model.w)) if not model.first[of] <= i < model.first[of] + model.size[of]]
    assert (trainer.m.w[others] == model.w[others]).all() and (trainer.m.wb[others] == model.wb[others]).all()


def test_language_model_does_not_follow_file_layout(spark):
    rng = __import__("random").Random(10)
    rows = [(i, sentence(rng, 40)) for i in range(60)]
    one, other = ({r["doc_id"]: r["score"] for r in lm.score_documents(frame(spark, x).coalesce(n)).collect()} for x, n in ((rows, 1), (rows[::-1], 2)))
    assert one == pytest.approx(other, abs=1e-2)


def test_recurrent_model_is_a_distribution_and_carries_state():
    mass, first, size = np.array([4.0, 3, 2, 1]), np.array([0, 2]), np.array([2, 2])
    model = Gru.start(4, np.array([7.0, 3.0]), mass, first, size)
    class_of, member_of = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    docs = [np.array([1, 2] * 200 + [0], np.int32) for _ in range(40)]
    model = train(model, docs, class_of, member_of, 0).m
    # after any beginning, the chances of all that may follow sum to one
    chance = lambda *ids: np.exp(log_likelihoods(model, [np.array(ids, np.int32)], class_of, member_of, 0)[0])
    for begin in ((), (1,), (1, 2), (3, 3, 1)):
        assert abs(sum(chance(*begin, x) for x in range(4)) / (chance(*begin) if begin else 1) - 1) < 1e-4
    # one step's probabilities sum to one
    state = np.zeros((4, model.h.shape[0]), np.float32)
    assert abs(np.exp(model.losses(state, class_of, member_of)[0]).sum() - 1) < 1e-5
    # a document scores the same alone and among others
    alone, among = log_likelihoods(model, [docs[0]], class_of, member_of, 0)[0], log_likelihoods(model, [docs[0][:50], *docs, docs[0][3:9]], class_of, member_of, 0)[1]
    assert abs(alone - among) < 1e-2 and alone > -100


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = Gru.start(4, np.array([7.0, 3.0]), np.array([4.0, 3, 2, 1]), np.array([0, 2]), np.array([2, 2]))
    model.c[:] = rng.normal(0, 0.5, model.c.shape)
    model.w[:] = rng.normal(0, 0.5, model.w.shape)
    hidden, cls, mem = rng.normal(0, 0.5, (6, model.h.shape[0])).astype(np.float32), np.array([0, 1, 0, 1, 1, 0]), np.array([0, 1, 1, 0, 1, 0])
    grads = {}
    _, back = model.losses(hidden, cls, mem, grads)
    for i, j in ((0, 0), (3, 5)):
        up, down = hidden.copy(), hidden.copy()
        up[i, j] += 1e-2
        down[i, j] -= 1e-2
        slope = (model.losses(down, cls, mem)[0].sum() - model.losses(up, cls, mem)[0].sum()) / 2e-2
        assert abs(slope - back[i, j]) < 1e-2


def test_pieces_are_lossless_and_reproducible(spark, docs, rows):
    extra = [(50, " lead  two   three "), (51, "a▁b ▁▁"), (52, "\r\n\x00​ 梦 😀😀"), (53, "z" * 5000)]
    frame_ = frame(spark, [*rows, *extra])
    got = pieces.encode(frame_.select("doc_id", "text", "lang")).collect()
    assert len(got) == len(rows) + len(extra) and all(r["lossless"] and len(r["pieces"]) == r["n_pieces"] for r in got)
    again = pieces.encode(frame_.select("doc_id", "text", "lang").repartition(5)).collect()
    key = lambda found: Counter((r["doc_id"], tuple(r["pieces"])) for r in found)
    assert key(got) == key(again)
    other = pieces.encode(frame_.select("doc_id", "text", "lang"), seed=2).collect()
    assert key(got) != key(other)
    assert pieces.encode(frame_.select("doc_id", "text").limit(0)).collect() == []


def test_sampled_pieces_follow_the_lattice():
    vocab = pieces.Vocabulary(pieces.default_model(), 1.0)
    unit = " then"
    paths = [[]]
    done = []
    while paths:
        p = paths.pop()
        at = sum(map(len, p))
        if at == len(unit):
            done.append(tuple(p))
        paths += [[*p, unit[at:j]] for j in range(at + 1, len(unit) + 1) if unit[at:j] in vocab.weights]
    weight = {p: float(np.prod([vocab.weights[x][1] for x in p])) for p in done}
    assert abs(np.log(sum(weight.values())) - pieces.log_chance(vocab, unit)) < 1e-9
    found = Counter(tuple(x.tolist()) for x in pieces.encode_batch(vocab, list(range(20_000)), ["then"] * 20_000, 1))
    for p, w in weight.items():
        share = w / sum(weight.values())
        ids = tuple(vocab.weights[x][0] for x in p)
        assert abs(found[ids] / 20_000 - share) < 5 * np.sqrt(share / 20_000) + 1e-3


@pytest.mark.parametrize("narrow", [0, 1, 4, 10**9])
def test_lattices_match_brute_force(narrow, monkeypatch):
    """Every node's chances against sums over all segmentations, with bytes, CJK, emoji and repeated characters."""
    monkeypatch.setattr(pieces, "NARROW", narrow)
    vocab = pieces.Vocabulary(pieces.default_model(), 1.0)
    units = [" then", " a", "\n", "   ", " 中文字", " ééß", " 😀x😀", " internationals", "zz\x07q", " \u4e2d\U0001f9ec"]
    lattices = pieces.Lattices(vocab, units)

    def mass(text):
        """The summed weights of all segmentations."""
        if not text:
            return 1.0
        total = sum(mass(text[:i]) * vocab.weights[text[i:]][1] for i in range(len(text)) if text[i:] in vocab.weights)
        return total if text[-1] in vocab.weights else total + mass(text[:-1]) * vocab.byte_weight ** len(text[-1].encode())

    for unit, last in zip(units, lattices.last.tolist(), strict=True):
        texts = {last: unit}  # nodes that can be reached backwards, and what is before them
        while texts:
            at, text = texts.popitem()
            a, b = int(lattices.edges[at]), int(lattices.edges[at + 1])
            got, low = {}, float(at)
            for e in range(a, b):
                out = int(lattices.out[e])
                tail = chr(-1 - out) if out < 0 else vocab.bytes[out].decode()
                assert text.endswith(tail)
                w = vocab.byte_weight ** len(tail.encode()) if out < 0 else vocab.weights[tail][1]
                got[tail, out < 0] = float(lattices.cdf[e]) - low
                low = float(lattices.cdf[e])
                assert abs(got[tail, out < 0] - mass(text[: -len(tail)]) * w / mass(text)) < 1e-9
                if lattices.back[e] >= 0:
                    texts[int(lattices.back[e])] = text[: -len(tail)]
                else:
                    assert tail == text
            assert len(got) == sum(text[i:] in vocab.weights for i in range(len(text))) + (text[-1] not in vocab.weights)


def test_long_units_and_any_text_survive():
    vocab = pieces.Vocabulary(pieces.default_model(), 1.0)
    texts = ["a" * 5000, "中" * 3000, "\U0001f9ec" * 700, "x\n\n  y \t z", " ", None, "", "é" * 10 + " then" * 50]
    ids = pieces.encode_batch(vocab, list(range(len(texts))), texts, 3)
    assert [vocab.decode(i.tolist()) for i in ids] == [(t or "").encode() for t in texts]
    alone = [pieces.encode_batch(vocab, [k], [t], 3)[0].tolist() for k, t in enumerate(texts)]
    assert alone == [i.tolist() for i in ids]


def test_pieces_bear_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "y", 5), (1, "a b", "x", "y", 5)], "doc_id long, text string, _text string, _ string, n_pieces int")
    got = pieces.encode(rows).collect()
    assert got[0].asDict().keys() == {"doc_id", "_text", "_", "n_pieces", "pieces", "lossless"} and got[0] == got[1] and got[0]["_text"] == "x"
