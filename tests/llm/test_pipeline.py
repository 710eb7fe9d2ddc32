import random

import corpus_pipeline
from memoryloom.llm import neardup, pieces, queries

from .helpers import frame, sentence


def tables(spark, path):
    rng = random.Random(12)
    bench = [sentence(rng, 30) for _ in range(3)]
    good = [(i, sentence(rng, 80)) for i in range(160)]
    junk = [(1000 + i, " ".join(rng.choice(["%%%", "!!"]) + rng.choice("XYZ") for _ in range(80))) for i in range(60)]
    copies = [(2000 + i, good[0][1]) for i in range(10)] + [(2100 + i, good[1][1] + " more") for i in range(5)]
    leaks = [(3000, sentence(rng, 70) + " " + bench[0]), (3001, bench[1] + " end"), (3002, sentence(rng, 60) + " mail me at someone@host.example.com today")]
    rows = [*good, *junk, *copies, *leaks, (4000, None), (4001, "")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(rows), bench


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rows, bench = tables(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        assert name == "pieces" or docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
    kept = set(seen["quality"])
    assert not kept & set(range(1000, 1060)) and len(kept & set(range(160))) >= 157
    grouped = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.read.parquet(f"{tmp_path}/quality")).collect()}
    assert set(seen["near_duplicates"]) == set(grouped.values())
    assert 3001 not in seen["decontamination"] and bench[0] not in seen["decontamination"][3000]["text"]
    assert all(seen["decontamination"][i]["text"] == rows[i] for i in seen["decontamination"] if i < 160)
    assert "[EMAIL]" in seen["personal_data"][3002]["text"]
    vocab = pieces.Vocabulary(pieces.default_model(), 1.0)
    for i, r in seen["pieces"].items():
        assert r["lossless"] and vocab.decode(r["pieces"]).decode() == (seen["personal_data"][i]["text"] or "")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["pieces"])


def test_repeated_ids_and_clashing_names(spark, tmp_path):
    """Rows of one doc_id stay for each of their texts; equal rows once; columns of any names are kept."""
    rng = random.Random(13)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    names = "doc_id long, text string, lang string, source string, n_chars long, _least int, _key string, _row string, _n int, _text string, kept boolean, component_id long"
    rows = [(1, a, "en"), (1, a, "de"), (1, b, "en"), (2, a, "en"), (3, c, "en"), (3, c, "en"), (None, c, "en"), (None, c, "en"), (5, None, "en"), (6, "", "en"), (6, "", "en")]
    docs = spark.createDataFrame([(*r, "s", 1, 7, "k", "r", 8, "t", True, 9) for r in rows], names)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (3, c), (None, c), (None, c), (5, None), (6, "")], key=str)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        assert out.count() and (name == "pieces" or out.columns == docs.columns)
        assert name == "pieces" or all(r["_least"] == 7 and r["_row"] == "r" and r["_text"] == "t" for r in out.collect())


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    nothing = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, nothing, str(tmp_path)).collect() == []
    for name in ("op1_quality", "op2_language_model", "op3_fingerprints", "op4_near_duplicates", "op5_sharding", "op6_repeats", "op7_pieces", "op8_decontamination", "op9_personal_data"):
        nothing.write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{other}.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/{other}.parquet")
        assert queries.QUERIES[name](spark, f"{tmp_path}/empty").collect() == [], name
