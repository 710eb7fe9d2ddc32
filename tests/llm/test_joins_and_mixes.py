import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memoryloom.llm import asof, middle, mixing

from .helpers import SCHEMA, corpus, frame, words

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def moved(text, key):
    """Fill-in-middle by plain slices of the list of units."""
    h = [int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("ab <PSM>\n\t\x0b\x1c\xa0é😀"), max_size=60), st.integers(0, 400), st.integers(1, 9))
def test_ropes_move_and_restore(text, key, leaf):
    data = text.encode()
    n, form, first, second, out = middle.rearranged(data, key, leaf_bytes=leaf)
    assert (n, form, first, second, out.decode()) == moved(text, key)
    assert middle.rebuilt(out, form, leaf) == data


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("ab \né😀"), max_size=50), st.integers(0, 60), st.integers(1, 9))
def test_rope_counts_and_cuts(text, at, leaf):
    whole = middle.rope(text.encode(), leaf)
    units = UNIT.findall(text)
    assert (whole.units, whole.chars, whole.text().decode()) == (len(units), len(text), text)
    for kind, head in (("units", "".join(units[:at])), ("chars", text[:at])):
        a, b = whole.cut(at, kind)
        assert (a.text().decode(), b.text().decode()) == (head, text[len(head) :])
        assert (a.chars, b.chars) == (len(head), len(text) - len(head))
    assert (a.units + b.units) >= len(units)


def test_fill_in_middle_over_a_table(spark):
    rows = [*corpus(), (77, "a" * 3_000_000), (78, "wörd " * 400_000), (79, "has <M> in it"), (80, "🙂 " * 10)]
    df = frame(spark, rows)
    want = Counter((k, *moved(t or "", k)) for k, t in rows)
    found = middle.fill_in_middle(df, restored=True).collect()
    assert Counter(tuple(r)[:6] for r in found) == want
    texts = Counter((k, t or "") for k, t in rows)
    assert Counter((r["doc_id"], r["restored"]) for r in found) == texts
    again = middle.restore(middle.fill_in_middle(df)).select("doc_id", "restored").collect()
    assert Counter(map(tuple, again)) == texts
    digest = middle.middle_digest(df).filter("doc_id = 80").first()
    assert digest["output_sha256"] == hashlib.sha256(moved("🙂 " * 10, 80)[4].encode()).hexdigest()
    assert digest["restored_sha256"] == hashlib.sha256(("🙂 " * 10).encode()).hexdigest()
    assert middle.fill_in_middle(df.limit(0)).count() == 0


def best_of(question, versions):
    """The best version by looking at all of them."""
    key, at = question
    usable = [(e, -a, v, p) for k, v, e, a, x, p in versions if None not in (k, v, e, a, key, at) and k == key and e <= at and a <= at and (x is None or at < x)]
    return max(usable, default=None)


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_point_in_time_matches_brute_force(spark, block):
    rng = random.Random(5)
    versions = []
    for i in range(400):
        key = rng.choice(["hot"] * 4 + ["a", "b", None])
        e = rng.randint(-50, 300)
        versions.append((key, rng.choice([i, i, i // 2, None]), rng.choice([e] * 9 + [None]), e + rng.randint(-20, 60), rng.choice([e + rng.randint(-5, 120)] * 9 + [None]), rng.choice([1, 2, None])))
    versions += versions[:40]
    questions = [(rng.choice(["hot", "a", "b", "none", None]), rng.choice([rng.randint(-60, 400)] * 9 + [None])) for _ in range(300)]
    questions += questions[:20]
    v = spark.createDataFrame(versions, "key string, version long, event long, arrival long, expiry long, p int")
    q = spark.createDataFrame([(*x, "kept") for x in questions], "key string, at long, _best string")
    out = asof.point_in_time(q, v, payload=("p",), block=block).collect()
    # a null payload is less than any
    filled = [(k, n, e, a, x, -1 if p is None else p) for k, n, e, a, x, p in versions]
    want = Counter()
    for x in questions:
        b = best_of(x, filled)
        want[(*x, b and (b[0], -b[1], b[2], None if b[3] == -1 else b[3]))] += 1
    assert Counter((r["key"], r["at"], r["found"] and tuple(r["found"])) for r in out) == want
    assert {r["_best"] for r in out} == {"kept"}
    for few in (asof.point_in_time(q, v.limit(0), block=block), asof.point_in_time(q.filter("key is null"), v, block=block)):
        assert few.filter("found is not null").count() == 0
    assert asof.point_in_time(q.limit(0), v, block=block).count() == 0


def test_label_features_handle_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(i, None, "en" if (i or 1) % 3 else None, None if (i or 1) % 7 == 0 else f"s{(i or 1) % 2}", i, "d", 1, 2, 3, 0.5) for i in [*range(1, 300), 5, 5, None]], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in [*range(0, 340, 3), 3, 3, None]], "doc_id long, quality int, toxic int, event string")
    h = lambda i: [int(hashlib.sha256(str(i).encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    versions = []
    for r in docs.collect():
        if r["doc_id"] is not None:
            a, b, c, _ = h(r["doc_id"])
            versions.append((r["source"], r["doc_id"], a % 50000, a % 50000 - 60 + b % 600, a % 50000 + c % 900, (r["n_chars"], r["lang"] or "")))
    of = {v[1]: v[0] for v in versions}
    want = Counter()
    for (i,) in labels.select("doc_id").collect():
        t = None if i is None else h(i)[3] % 50000
        b = best_of((of.get(i), t), versions)
        fresh = b is not None and t - b[0] <= 120
        want[(i, t, b and b[2], b and t - b[0], "none" if b is None else "fresh" if fresh else "stale", b[3][0] if fresh else None, (b[3][1] or None) if fresh else None)] += 1
    assert Counter(map(tuple, asof.label_features(docs, labels).collect())) == want
    assert asof.label_features(docs, labels.limit(0)).count() == 0
    assert {r["status"] for r in asof.label_features(docs.limit(0), labels).collect()} == {"none"}


def aims(sizes, weights=(5, 2, 1), share=Fraction(3, 2), passes=2):
    """Targets by giving out what is over again and again, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = Fraction(left) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > passes * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = Fraction(passes * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def mixed_rows(rng, n=300):
    rows = [(i, " ".join(["w"] * rng.randint(0, 120)), rng.choice(["big"] * 6 + ["é", "a", "b", None])) for i in range(n)]
    rows += [(None, "null id here", "a")] * 3 + [(7, "x y z " * 30, "copies")] * 40 + [(n, None, "a"), (n + 1, "", "hollow"), (n + 2, "long " * 50_000, "b")]
    return rows


@pytest.mark.parametrize("slots, bucket", [(3000, 20_000), (97, 5)])
def test_mix_meets_its_targets(spark, monkeypatch, slots, bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(mixing, "_COPIES", 7)
    rows = mixed_rows(random.Random(2))
    df = spark.createDataFrame([(i, t, "en", s, 1, "d", 1, 2, 3, 0.5) for i, t, s in rows], SCHEMA)
    mix = mixing.Mix(df, slots=slots)
    found = mix.taken().collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = aims(sizes)
    source = {(r["source_size"], round(r["target"], 6)): s for r, s in ((r, r["source"]) for r in mix.sources.collect())}
    for r in mix.sources.collect():
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6 * max(1, r["target"])
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(words(t))) for i, t, s in rows)
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[(r["source_size"], round(r["target"], 6))]] += r["taken"]
    for s, total in taken.items():
        assert abs(total - want[s]) <= 6 * mix.words_a_slot, (s, total, float(want[s]))
    # no slot takes more than its words, and a slot's words come from one source
    a_slot = mix.pieces.groupBy("slot").agg(F.sum("words").alias("w"), F.countDistinct("number").alias("s")).collect()
    assert all(r["w"] <= mix.words_a_slot and r["s"] == 1 for r in a_slot)
    assert mix.pieces.filter("first_word < 0 or first_word + words > size or words < 1").count() == 0
    again = mixing.mix_documents(df.repartition(7), slots=slots).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mix_follows_its_shares_all_along(spark):
    rows = [(i, "w " * 50, s) for i, s in enumerate(["a"] * 40 + ["b"] * 40 + ["c"] * 40)]
    df = spark.createDataFrame([(i, t, "en", s, 1, "d", 1, 2, 3, 0.5) for i, t, s in rows], SCHEMA)
    mix = mixing.Mix(df, slots=1000)
    shares = {r["number"]: r["high"] - r["low"] for r in mix.sources.collect()}
    plan = mixing.schedule(mix.sources, mix.slots).orderBy("slot").collect()
    assert [r["slot"] for r in plan] == list(range(mix.slots))
    seen = Counter()
    for r in plan:
        assert r["rank"] == seen[r["number"]]
        seen[r["number"]] += 1
        if r["slot"] % 100 == 99:
            assert all(abs(seen[k] - share * (r["slot"] + 1)) < 4 for k, share in shares.items())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 0, "d", 1, 2, 3, 0.5), (1, " ", "en", "s", 0, "d", 1, 2, 3, 0.5)], SCHEMA)
    assert Counter(map(tuple, mixing.mix_documents(blank).collect())) == {(1, 0, 0, 0.0, 0): 2}
