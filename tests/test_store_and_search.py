"""The store's commits and index, and search over it."""

import random
from collections import Counter

import plain
import pytest
from pyspark.sql import functions as F

from memoryloom.functions import adapters, text
from memoryloom.operators import bm25, rank, revise, transcript
from memoryloom.params import DEFAULT, Params
from memoryloom.plans import pipelines
from memoryloom.schema import CARD, WIRE
from memoryloom.sources.store import Change, Store

EMPTY = dict(memory_type="record", instance_id="", trigger="", root_cause="", action_hint="", files_symbols=[], failure_if_ignored="", scope="", temporal_anchor="", gist="g", entities=[], keywords=[], pairs=[])


def now():
    return F.lit("2025-01-01").cast("timestamp")


def versions(spark, rows):
    """Note versions from (user, id, content, version, superseded, kind, day)."""
    data = [(u, i, c, v, x, k, EMPTY, d) for u, i, c, v, x, k, d in rows]
    df = spark.createDataFrame(data, f"user_id string, id string, content string, version int, superseded boolean, memory_type string, card {CARD}, day string")
    return df.withColumns({"created_at": F.col("day").cast("timestamp"), "embedding": F.array().cast("array<float>")}).drop("day")


def words(rng, n=12):
    return " ".join(rng.choices([f"term{i}" for i in range(20)] + ["the"] * 8, k=rng.randint(0, n)))


def test_stored_index_follows_upserts(spark, tmp_path):
    """After inserts, merges, retirements and replays the stored index scores as one that is built anew."""
    rng, store, log = random.Random(7), Store(spark, str(tmp_path / "s")), {}
    for round_ in range(3):
        rows = []
        for i in range(12):
            key = (rng.choice("uv"), f"n{rng.randint(0, 14)}")
            before = log.get(key)
            version = before[3] + 1 if before else 1
            row = (*key, words(rng), version, bool(before) and rng.random() < 0.3, rng.choice(["event", "record"]), f"2024-0{1 + round_}-1{i % 10}")
            log[key] = row
            rows = [r for r in rows if r[:2] != key] + [row]
        store.write_memories(versions(spark, rows))
        store.write_memories(versions(spark, rows))  # a replay adds nothing
        if round_ == 1:
            store.compact()
    active = [r for r in log.values() if not r[4]]
    asked = spark.createDataFrame([("q1", "u", "term1 term2 the the"), ("q2", "v", "the term3"), ("q3", "w", "the")], "query_id string, user_id string, query string")
    got = {(r["query_id"], r["id"]): r["bm25"] for r in bm25.scores(store.index(), asked).collect()}
    for q, u, t in asked.collect():
        own = [r for r in active if r[0] == u]
        for r, s in zip(own, plain.bm25([revise.tokens(r[2]) for r in own], revise.tokens(t)), strict=True):
            assert got.pop((q, r[1]), 0.0) == pytest.approx(s)
    assert not got
    assert Counter((r["user_id"], r["id"], r["memory_type"]) for r in store.index().docs.collect()) == Counter((r[0], r[1], r[5]) for r in active)
    assert {r["user_id"]: r["n"] for r in store.index().users.collect()} == Counter(r[0] for r in active)
    assert store.snapshot(1).memories().count() <= 12  # older versions stay readable


def test_a_write_costs_what_it_changes(spark, tmp_path, monkeypatch):
    """Replays write no tables, versions that come late no index rows, and no log of keys is broadcast, however small its files are."""
    store, plans, write = Store(spark, str(tmp_path / "s")), [], Change.write

    def watched(self, name, rows):
        if name == "memories":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, name, rows)

    monkeypatch.setattr(Change, "write", watched)
    row = lambda i, version, text="term1 the": ("u", i, text, version, False, "event", "2024-01-01")
    store.write_memories(versions(spark, [row("a", 3), row("b", 1), row("a", 2)]))
    first = store.snapshot()
    store.write_memories(versions(spark, [row("b", 1), row("a", 2)]))
    assert store.snapshot().folders == first.folders
    store.write_memories(versions(spark, [row("a", 1, "late words"), row("b", 2, "term2"), row("c", 1)]))
    now = store.snapshot()
    assert sorted((r["id"], r["sign"]) for r in now.log("index_docs").collect()) == [("a", 1), ("b", -1), ("b", 1), ("b", 1), ("c", 1)]
    assert now.log("memories").count() == 6 and {(r["id"], r["version"], r["content"]) for r in now.memories().collect()} == {("a", 3, "term1 the"), ("b", 2, "term2"), ("c", 1, "term1 the")}
    joins = [[x for x in p.splitlines() if "LeftAnti" in x] for p in plans]
    assert [len(x) for x in joins] == [0, 1, 1] and all("SortMergeJoin" in x[0] for x in joins[1:])


def test_the_changes_are_worked_out_once(spark, tmp_path, monkeypatch):
    """All commits of a store read one staged table of versions, not the changes themselves."""
    from memoryloom import store_queries

    read, write = [], Store.write_memories
    monkeypatch.setattr(Store, "write_memories", lambda self, rows: read.append(rows.inputFiles()) or write(self, rows))
    store_queries.changed_store(spark, "/root/testdata/sf0.001")
    assert len(read) == store_queries.COMMITS + 1 and not any("client_changes" in f for files in read for f in files)


def test_a_search_of_the_store_reads_no_text_to_rank(spark, tmp_path):
    rng, store = random.Random(3), Store(spark, str(tmp_path / "s"))
    rows = [("u", f"n{i:03}", words(rng), 1, False, rng.choice(["event", "record"]), f"2024-{1 + i % 12:02}-01") for i in range(150)]
    store.write_memories(versions(spark, rows))
    asked = spark.createDataFrame([("q1", "u", "term1 term2", 3, ["a"]), ("q2", "u", "nothing known", 4, ["a"])], "query_id string, user_id string, query string, top_k int, options array<string>")
    shown = lambda **k: sorted(map(tuple, pipelines.search(asked, store.memories(), now(), **k).select("query_id", "final_rank", "id", F.round("score", 6), F.round("utility", 6)).collect()))
    assert shown() == shown(index=store.index())
    plan = bm25.scores(store.index(), asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "index_postings" in "".join(bm25.scores(store.index(), asked).inputFiles())


@pytest.mark.parametrize("top, block", [(5, 64), (3, 1), (None, 64)])
def test_ranking_by_lists_equals_ranking_of_all_notes(spark, monkeypatch, top, block):
    monkeypatch.setattr(bm25, "BLOCK", block)
    rng = random.Random(11)
    days = [None, "2025-03-01", "2024-12-01", "2024-12-20", "2023-01-01", "2022-05-05"]  # unknown, to come, aging, older than the floor
    rows = [("uvw"[i % 3 % 2], f"n{i:03}", words(rng, 6), 1, False, rng.choice(["event", "record", "profile"]), rng.choice(days)) for i in range(120)] + [("w", "n999", "", 1, False, "record", None)]
    notes = versions(spark, rows)
    data = [(f"q{i}", "uvwx"[i % 4], words(rng, 4), w) for i, w in enumerate([{}, {"event": 0.5}, {"record": 1.0, "profile": 0.0}, {"profile": 0.1, "event": 1.0, "record": 0.2}] * 3)]
    asked = spark.createDataFrame(data, "query_id string, user_id string, query string, weights map<string,double>").withColumn("embedding", F.array().cast("array<float>"))
    n = None if top is None else F.lit(top)
    shown = lambda vectors, **k: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rank.hybrid_rank(notes, asked, now(), top_n=n, vectors=vectors, **k).collect())
    assert shown(False) == shown(True)
    assert shown(False, apply_decay=False) == shown(True, apply_decay=False)


def test_terms_are_counted_as_the_expression_cuts_them(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aAbBzZ09__ \n的一鿿䷿éKİ.-😀TP") for _ in range(rng.randrange(16))) for _ in range(600)] + [None, "", "_bT b _A HTTPServer fooBar 9abc __"]
    rows = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)], "user_id string, id string, content string")
    wanted = {r["id"]: Counter(r["x"]) for r in rows.select("id", text.tokenize(F.col("content")).alias("x")).collect()}
    found = bm25.token_bags(rows, "user_id", "id", "content").collect()
    assert {r["id"]: {x["term"]: x["tf"] for x in r["bag"]} for r in found} == wanted
    assert all(r["dl"] == wanted[r["id"]].total() for r in found)


def test_ranking_shuffles_neither_tokens_nor_texts(spark):
    notes = versions(spark, [("u", f"n{i:02}", "one two", 1, False, "event", "2025-01-01") for i in range(40)])
    asked = spark.createDataFrame([("q", "u", "one")], "query_id string, user_id string, query string").withColumns({"weights": F.lit(None).cast("map<string,double>"), "embedding": F.array().cast("array<float>")})
    index = bm25.index_of(notes)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scored = plan(bm25.scores(index, asked))
    assert scored.count("hashpartitioning(query_id") == 1 and scored.count("hashpartitioning(user_id") == 1  # sums, and the distinct terms asked for
    found = rank.hybrid_rank(notes, asked, now(), top_n=F.lit(5), vectors=False, index=index)
    assert "hashpartitioning" not in plan(found) and found.count() == 5


def test_ranked_documents_equal_a_sort_of_all(spark):
    rng = random.Random(5)
    docs = [("uv"[i % 2], f"n{i:02}", words(rng, 5)) for i in range(60)] + [("w", "n99", "")]
    queries = [(f"q{i}", "uvwx"[i % 4], words(rng, 4)) for i in range(12)]
    got = {}
    for r in bm25.rank_documents(spark.createDataFrame(docs, "user_id string, id string, content string"), spark.createDataFrame(queries, "query_id string, user_id string, query string"), 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    sizes = spark.createDataFrame([(q, sum(d[0] == u for d in docs)) for q, u, _ in queries], "query_id string, n long")
    scored = []
    want_flags = {}
    for q, u, t in queries:
        own = [d for d in docs if d[0] == u]
        s = plain.bm25([revise.tokens(d[2]) for d in own], revise.tokens(t)) if own else []
        order = sorted(zip(s, own, strict=True), key=lambda x: (-round(x[0], 9), x[1][1]))[:7]
        least = min(s, default=0)
        assert sorted(got.get(q, [])) == [(k + 1, d[1], round(x - least, 9)) for k, (x, d) in enumerate(order)]
        scored += [(q, float(x)) for x, d in zip(s, own, strict=True) if set(revise.tokens(t)) & set(revise.tokens(d[2]))]
        if own:
            hi, lo = max(s), min(s)
            others = [x for x in s if x < hi]
            mean = sum(others) / len(others) if others else None
            want_flags[q] = hi > 0 if hi - lo < 1e-9 else mean is None or (hi - mean) / max(abs(hi), abs(mean), 1e-9) >= 0.85
    flags = {r["query_id"]: r["near_duplicate"] for r in rank.near_duplicate_flags(spark.createDataFrame(scored, "query_id string, bm25 double"), sizes).collect()}
    assert flags == want_flags


def wire(spark, *rows):
    good, _ = transcript.validate(spark.createDataFrame([(r, u, s, [("user", c, 1), ("assistant", "Fixed the crash in a/b.py. Done", 2)]) for r, u, s, c in rows], WIRE))
    return transcript.events_of_messages(transcript.explode_wire(good))


def state(store):
    one = store.snapshot()
    return [Counter(map(str, x.collect())) for x in (one.memories(), one.decided(), one.file_symbols(), one.index().docs, one.index().counts, one.index().users, one.log("index_terms").groupBy("user_id", "term").agg(F.sum("df").alias("df")).filter("df > 0"))]


class Died(Exception):
    pass


def test_a_writer_that_dies_between_writes_leaves_no_trace(spark, tmp_path, monkeypatch):
    first = wire(spark, ("r1", "u", "s1", "why does the parser fail on unicode input"), ("r2", "v", "s2", "network timeouts in the scheduler"))
    second = wire(spark, ("r3", "u", "s3", "why does the parser fail on unicode input again and again"), ("r4", "u", "s4", "other things altogether"))
    whole, broken = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    for s in (whole, broken):
        pipelines.ingest(first, s, F.lit("2024-05-01"))
    pipelines.ingest(second, whole, F.lit("2024-05-02"))
    before, write, writes = state(broken), Change.write, 8
    for k in (1, 7, writes):
        left = [k]

        def until(self, name, rows, left=left):
            if left[0] == 0:
                raise Died
            left[0] -= 1
            write(self, name, rows)

        monkeypatch.setattr(Change, "write", until)
        if k < writes:
            with pytest.raises(Died):
                pipelines.ingest(second, broken, F.lit("2024-05-02"))
            assert broken.version() == 1 and (k < 7 or state(broken) == before)
        else:
            pipelines.ingest(second, broken, F.lit("2024-05-02"))
    assert state(broken) == state(whole) and broken.version() == 2
    monkeypatch.setattr(Change, "write", write)
    broken.compact()
    broken.vacuum()
    assert state(broken) == state(whole)
    broken.reset()
    assert broken.version() == 0 and broken.count() == 0


def test_the_second_of_two_writers_begins_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, two = store.change(), store.change()
    row = lambda i: versions(spark, [("u", i, "some text", 1, False, "record", "2024-01-01")])
    with one:
        one.write_memories(row("a"))
    with two:
        two.write_memories(row("b"))
    assert one.made and not two.made and store.count() == 1
    store.write_memories(row("b"))
    assert store.count() == 2 and store.index().users.first()["n"] == 2
    store.compact("memories")
    assert store.snapshot().log("memories").count() == 2 and store.index().users.first()["n"] == 2


def test_vectors_of_a_model_decide_ties(spark, tmp_path):
    """An 8-wide model's vectors are stored, searched with, and refused where their width is wrong."""
    p = Params(embedding_dim=8)
    model = lambda t: [1.0 if ch in t else 0.0 for ch in "abcdefgh"]
    store = Store(spark, str(tmp_path / "s"))
    events = wire(spark, ("r1", "u", "s1", "zzz bbbb"), ("r2", "u", "s2", "zzz ffff"), ("r3", "u", "s3", "zzz cccc"))
    pipelines.ingest(events, store, F.lit("2024-05-01"), p, judge=lambda a, b: ("unrelated", {}), embed=model)
    assert all(len(r["embedding"]) == 8 and sum(r["embedding"]) > 0 for r in store.memories().collect())
    asked = spark.createDataFrame([("q", "u", "gggg hhhh", 1, ["a"])], "query_id string, user_id string, query string, top_k int, options array<string>")
    notes = store.memories().withColumn("embedding", F.when(F.col("content").contains("ffff"), F.array(*[F.lit(float(c in "gh")) for c in "abcdefgh"])).otherwise(F.array(*[F.lit(float(c in "ab")) for c in "abcdefgh"])).cast("array<float>"))
    found = rank.hybrid_rank(notes, asked.withColumns({"weights": F.create_map().cast("map<string,double>"), "embedding": adapters.embedder(model, p)(F.col("query"))}), now(), p, F.lit(1)).first()
    assert "ffff" in found["content"] and found["dense"] == pytest.approx(1.0)
    assert pipelines.search(asked, notes, now(), params=p, embed=model).count() == 1
    wrong = asked.select(adapters.embedder(lambda t: [1.0], p)(F.col("query")).alias("v")).first()["v"]
    assert wrong == [0.0] * 8 and len(adapters.vectors_of(model, p)("abc")) == 8
    merged = list(revise.fold(p, lambda a, b: ("supports", {}), lambda t: [1.0] * 3)([dict(stored=False, user_id="u", id=f"c{i}", session_id="s", request_id="r", segment_id=i, request_ts=1, content=c, embedding=[1.0] * 8, memory_type="record", card={**EMPTY, "gist": c}, created_at=None, version=1, known_pairs=None) for i, c in enumerate(["one two", "one two three"])]))
    assert merged[-1]["action"] == "MERGE" and merged[-1]["embedding"] == [0.0] * 8


def test_a_dead_model_is_asked_a_few_times_a_task(spark, tmp_path, monkeypatch):
    """One breaker a task, however many Arrow batches it has."""
    log = tmp_path / "calls"

    def broken(text):
        with open(log, "a") as f:
            f.write("x")
        error = RuntimeError("gone")
        error.status = 400  # not tried again
        raise error

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("t"))
        assert [r["w"] for r in rows.select(adapters.classifier(broken)(F.col("t")).alias("w")).collect()] == [{}] * 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(log.read_text()) == DEFAULT.llm_failure_threshold


def test_invalid_searches_find_nothing(spark):
    notes = versions(spark, [("u", "a", "some text", 1, False, "record", "2024-01-01")])
    asked = spark.createDataFrame([("ok", "u", "text", 1, []), ("none", "u", "text", 0, []), ("blank", "u", " ", 1, [])], "query_id string, user_id string, query string, top_k int, options array<string>")
    assert [r["query_id"] for r in pipelines.search(asked, notes, now()).collect()] == ["ok"]


def test_a_stream_with_keyed_state_equals_batches_and_restarts(spark, tmp_path, monkeypatch):
    """Three batches of candidates, a crash before the commit of the second and a restart: as one fold after another."""
    from memoryloom.streaming import fold as streams

    rng = random.Random(9)
    judge = lambda a, b: (["supports", "contradicts", "unrelated"][(len(a) + len(b)) % 3], {})
    kind = "user_id string, session_id string, request_id string, segment_id int, id string, content string, embedding array<float>, memory_type string, card " + CARD + ", created_at timestamp, request_ts timestamp"

    def batch(k):
        import datetime as dt

        at = dt.datetime(2024, 5, k + 1, tzinfo=dt.UTC)
        return spark.createDataFrame([("uv"[i % 2], "s", f"r{k}", i, f"c{k}-{i}", words(rng), [], rng.choice(["event", "profile"]), {**EMPTY, "gist": f"g{k}{i}", "pairs": [{"attr": f"a{i % 3}", "value": "v"}]}, at, at) for i in range(9)], kind)

    batches = [batch(k) for k in range(3)]
    plainly, stream = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    early = versions(spark, [("u", "old", "term1 term2 the", 1, False, "event", "2024-01-01")])
    for s in (plainly, stream):
        s.write_memories(early)
    for b in batches:
        plainly.write_memories(revise.latest(revise.revise(b, plainly.memories(), judge=judge)))
    commit, tries = Store._commit, []
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        start = lambda: streams.fold_stream(spark.readStream.schema(kind).json(str(tmp_path / "in")), stream, str(tmp_path / "c"), judge=judge).awaitTermination()
        if k == 1:

            def broken(self, change):
                tries.append(1)
                raise Died

            monkeypatch.setattr(Store, "_commit", broken)
            with pytest.raises(Exception):  # noqa: B017, PT011
                start()
            monkeypatch.setattr(Store, "_commit", commit)
        start()
    assert tries
    # the pairs of profiles that were stored at one time come in any order
    pairs = lambda r: tuple(sorted(map(tuple, r["card"]["pairs"])))
    shown = lambda s: sorted((r["user_id"], r["id"], r["version"], r["superseded"], r["content"], r["superseded_by"] or "", r["card"]["gist"], pairs(r)) for r in s.memories().collect())
    assert shown(stream) == shown(plainly) and any(x[3] for x in shown(stream))
