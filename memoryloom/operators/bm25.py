"""BM25 over one corpus per user, by an index: texts tokenised once, postings read by the queries' terms alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import tokenize
from ..params import DEFAULT, Params
from ..sources.checkpoints import staged
from .revise import utf8_counts


#: A table of fewer bytes a core may come in fewer parts than there are cores, such as one row group.
SPLIT_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew over the cores if it is small; a large table is read in many splits as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # the planner's estimate
    return df.repartition(4 * cores) if int(str(size)) < cores * SPLIT_BYTES else df


#: Bytes of text whose terms a task holds before it hands them on.
COUNTED_AT_ONCE = 4 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the last column, a text in UTF-8, becomes its terms, each with how often it stands, and their sum."""
    def out(rows: pa.RecordBatch, bags: list[dict[bytes, int]]) -> pa.RecordBatch:
        ends = [0]
        for b in bags:
            ends.append(ends[-1] + len(b))
        terms, times = pa.array([t for b in bags for t in b], pa.binary()).cast(pa.string()), pa.array([n for b in bags for n in b.values()], pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([terms, times], names=["term", "tf"]))
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], lists, pa.array([sum(b.values()) for b in bags], pa.int32())], names=[*rows.schema.names[:-1], "bag", "dl"])

    for batch in batches:
        first, bags, size, seen = 0, [], 0, {}  # copies that stand together are counted once
        for i, t in enumerate(batch.columns[-1]):
            text = t.as_py() or b""
            if text not in seen:
                seen[text] = utf8_counts(text)
            bags.append(seen[text])
            size += len(text)
            if size >= COUNTED_AT_ONCE:
                yield out(batch.slice(first, i + 1 - first), bags)
                first, bags, size, seen = i + 1, [], 0, {}
        if bags:
            yield out(batch.slice(first), bags)


def token_bags(docs: DataFrame, corpus: str, doc: str, text: str, *keep: str) -> DataFrame:
    """(corpus, doc, *keep, bag, dl): the terms of each document, once each with their number tf, and the number of all;
    staged, as the statistics and the scores all read them."""
    named = spread(docs.select(corpus, doc, *keep, F.col(text).cast("binary").alias("_text")))
    schema = StructType([*named.schema.fields[:-1], *StructType.fromDDL("bag array<struct<term:string,tf:int>>, dl int")])
    return staged(named.mapInArrow(_counted, schema), "tokens")


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def mean_frequency(counts: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, mean): the mean idf of a corpus' terms, from how many terms have each document count (df, terms)."""
    each = counts.join(users.select("user_id", "n"), "user_id").withColumn("idf", inverse_frequency(F.col("n"), F.col("df")))
    return each.groupBy("user_id").agg((F.sum(F.col("idf") * F.col("terms")) / F.sum("terms")).alias("mean"))


@dataclass(frozen=True)
class Index:
    """What ranking needs of the notes of each user.

    docs: (user_id, id, memory_type, created_at, embedding), as far as the source has them; users: (user_id, n, tokens);
    counts: (user_id, df, terms); postings and frequencies: from asked (user_id, term) to (user_id, term, id, tf, dl) and
    (user_id, term, df).
    """

    docs: DataFrame
    users: DataFrame
    counts: DataFrame
    postings: Callable[[DataFrame], DataFrame]
    frequencies: Callable[[DataFrame], DataFrame]


def index_of(docs: DataFrame, corpus: str = "user_id", doc: str = "id", text: str = "content") -> Index:
    """An index of documents that aren't stored with one, (corpus, doc) being their key. Terms are counted by document where
    it is read, so neither tokens nor postings are shuffled."""
    kept = [c for c in ("memory_type", "created_at", "embedding") if c in docs.columns]
    named = docs.select(F.col(corpus).alias("user_id"), F.col(doc).alias("id"), *kept, F.col(text).alias("content"))
    bags = token_bags(named, "user_id", "id", "content", *kept)
    df = staged(bags.select("user_id", F.explode("bag.term").alias("term")).groupBy("user_id", "term").agg(F.count("*").alias("df")), "frequencies")

    def postings(asked: DataFrame) -> DataFrame:
        return bags.select("user_id", "id", "dl", F.inline("bag")).join(asked, ["user_id", "term"], "left_semi")

    return Index(
        bags.drop("bag", "dl"), bags.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")), df.groupBy("user_id", "df").agg(F.count("*").alias("terms")),
        postings, lambda asked: df.join(asked, ["user_id", "term"], "left_semi"),
    )


def scores(index: Index, queries: DataFrame, query: str = "query_id", query_text: str = "query", params: Params = DEFAULT) -> DataFrame:
    """(query, user_id, id, bm25) of documents that share a term with a query of their corpus; the others score 0.

    A query's repeated tokens count each time. The corpus is a join key throughout: no user's notes meet another's
    queries. A negative idf becomes epsilon times the mean over all terms of the corpus. Only postings of terms that some
    query of their corpus has are read.
    """
    terms = staged(queries.select(query, "user_id", F.explode(tokenize(F.col(query_text))).alias("term")).groupBy(query, "user_id", "term").agg(F.count("*").alias("qtf")), "query-terms")
    asked = terms.select("user_id", "term").distinct()
    users = index.users.filter("tokens > 0")
    idf = inverse_frequency(F.col("n"), F.col("df"))
    weights = index.frequencies(asked).join(users, "user_id").join(mean_frequency(index.counts, users), "user_id")
    weights = weights.select("user_id", "term", F.when(idf < 0, params.epsilon * F.col("mean")).otherwise(idf).alias("idf"), (F.col("tokens") / F.col("n")).alias("avgdl"))
    length = 1 - params.b + params.b * F.col("dl") / F.col("avgdl")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * length)
    # of a size that the planner knows: few terms go to the postings, which then are shuffled as sums by document
    weighed = staged(terms.join(weights, ["user_id", "term"]), "term-weights")
    return index.postings(asked).join(weighed, ["user_id", "term"]).groupBy(query, "user_id", "id").agg(F.sum(part).alias("bm25"))


def bm25_scores(docs: DataFrame, queries: DataFrame, corpus: str = "user_id", doc: str = "id", text: str = "content", query: str = "query_id", query_text: str = "query", params: Params = DEFAULT) -> DataFrame:
    """(query, corpus, doc, bm25): scores over an index of docs."""
    asked = queries.select(F.col(query).alias("_query"), F.col(corpus).alias("user_id"), query_text)
    found = scores(index_of(docs, corpus, doc, text), asked, "_query", query_text, params)
    return found.select(F.col("_query").alias(query), F.col("user_id").alias(corpus), F.col("id").alias(doc), "bm25")


#: Digits that scores are compared by: those of copies differ by the order of their sums alone, and are equal.
TIE_DIGITS = 9


def descending(score: str) -> Column:
    return F.desc(F.round(score, TIE_DIGITS))


#: Places of a list that a query reads at once.
BLOCK = 64


def placed(docs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """docs with place, from 0, in the order of each key, and block (place / BLOCK).

    Rows are range-partitioned by key and order, so that a large key is spread; places are those within a part and the
    counts of the parts before.
    """
    # what orders the rows takes part in the range, or a large key would be one part
    cut = docs.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    cut = staged(cut, "placed")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_rows")).withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    out = cut.withColumn("place", inside).join(offsets, [*keys, "_part"]).withColumn("place", F.col("place") + F.col("_offset"))
    return out.drop("_part", "_offset").withColumn("block", F.floor(F.col("place") / BLOCK))


def first_others(wanted: DataFrame, lists: DataFrame, matched: DataFrame, keys: list[str], query: str = "query_id") -> DataFrame:
    """The first rows of lists (see placed) for each of wanted (query, *keys, reach) that matched (query, id) hasn't.

    reach is how many are wanted and how many matched rows may stand among them: no query meets more of a list.
    """
    blocks = F.sequence(F.lit(0), F.floor((F.col("reach") - 1) / BLOCK))
    asked = wanted.filter("reach > 0").withColumn("block", F.explode(blocks))
    near = asked.join(lists, [*keys, "block"]).filter("place < reach").drop("block", "place", "reach")
    return near.join(matched.select(query, "id"), [query, "id"], "left_anti")


def rank_documents(docs: DataFrame, queries: DataFrame, top_n: int, corpus: str = "user_id", doc: str = "id", text: str = "content", query: str = "query_id", query_text: str = "query", params: Params = DEFAULT) -> DataFrame:
    """The top_n documents (at least one) of each query by min-shifted score, all documents of its corpus considered.

    Those that share no term score 0; of them the first by doc are enough, and how many they are tells the least score.
    """
    n = max(1, top_n)
    index = index_of(docs, corpus, doc, text)
    asked = queries.select(F.col(query).alias("_query"), F.col(corpus).alias("user_id"), query_text)
    matched = staged(scores(index, asked, "_query", query_text, params), "matched")
    met = matched.groupBy("_query").agg(F.count("*").alias("_met"), F.min("bm25").alias("_least"))
    sizes = asked.select("_query", "user_id").join(index.users.select("user_id", "n"), "user_id").join(met, "_query", "left").fillna(0, ["_met"])
    least = sizes.select("_query", F.when(F.col("_met") < F.col("n"), F.least(F.coalesce("_least", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_least")).alias("_least"))
    lists = placed(index.docs.select("user_id", "id").join(asked.select("user_id").distinct(), "user_id", "left_semi"), ["user_id"], [F.col("id").asc()])
    others = first_others(sizes.select("_query", "user_id", (F.col("_met") + n).alias("reach")), lists, matched, ["user_id"], "_query")
    every = matched.select("_query", "user_id", "id", "bm25").unionByName(others.select("_query", "user_id", "id", F.lit(0.0).alias("bm25")))
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(descending("bm25"), "id"))
    top = every.withColumn("rank", rank).filter(F.col("rank") <= n).join(least, "_query")
    return top.select(F.col("_query").alias(query), F.col("user_id").alias(corpus), F.col("id").alias(doc), "rank", (F.col("bm25") - F.col("_least")).alias("score"))
