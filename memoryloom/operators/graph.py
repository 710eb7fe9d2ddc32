"""Symbols of source files, the graph of files that share or import them, and personalised PageRank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..params import DEFAULT, Params
from ..sources.checkpoints import staged

#: Fixed maps and patterns: the language of a suffix; (node type, pattern, group) of definitions; import patterns.
SUFFIXES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp"}
_SCRIPT = (("function_declaration", r"(?U)\bfunction\s+(\w+)\s*\("), ("class_declaration", r"(?U)\bclass\s+(\w+)\b"), ("method_definition", r"(?mU)^\s*(\w+)\s*\([^)]*\)\s*\{"))
DEFINITIONS = {
    "python": (("function_definition", r"(?mU)^\s*def\s+(\w+)\s*\("), ("class_definition", r"(?mU)^\s*class\s+(\w+)\b")),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "java": (("class_declaration", r"(?U)\bclass\s+(\w+)\b"), ("method_declaration", r"(?U)\b(?:public|private|protected|static|\s)+\s+\w+\s+(\w+)\s*\([^)]*\)\s*\{")),
    "go": (("function_declaration", r"(?mU)^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\("), ("type_declaration", r"(?mU)^type\s+(\w+)\b")),
}
_SCRIPT_IMPORTS = r"(?:import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\))"
IMPORTS = {
    "python": (r"(?mU)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", 2),
    "javascript": (_SCRIPT_IMPORTS, 2),
    "typescript": (_SCRIPT_IMPORTS, 2),
    "java": (r"(?mU)^\s*import\s+([\w.]+);", 1),
    "go": (r"(?m)^\s*import\s+(?:\(\s*)?['\"]([^'\"]+)['\"]", 1),
}
_MARK = ""


def language_of(file: Column) -> Column:
    by_suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.element_at(by_suffix, F.lower(F.regexp_extract(file, r"\.([A-Za-z]+)$", 1)))


def _definitions(content: Column, node_type: str, pattern: str) -> Column:
    """array<struct<name, kind, line, node_type>> of a pattern's matches; a match's line is where it begins."""
    names = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    before = F.split(F.regexp_replace(content, pattern, f"{_MARK}$0"), _MARK)
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda i: F.array_join(F.slice(before, 1, i), ""))
    line = lambda i: (F.length(F.get(starts, i)) - F.length(F.replace(F.get(starts, i), F.lit("\n"), F.lit(""))) + 1).cast("int")
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), F.lit("def").alias("kind"), line(i).alias("line"), F.lit(node_type).alias("node_type")))


def extract_symbols(files: DataFrame, content: str = "content") -> DataFrame:
    """(user_id, file, lang, name, kind, line, node_type): definitions and import targets by pattern.

    Line-number prefixes of tool output are removed first. Files of other languages have none.
    """
    body = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"(?m)^\s*[0-9]+→", "")
    typed = files.withColumn("lang", language_of(F.col("file"))).withColumn("_body", body).filter("lang is not null")
    empty = F.array().cast("array<struct<name:string,kind:string,line:int,node_type:string>>")
    found = empty
    for lang, patterns in DEFINITIONS.items():
        found = F.when(F.col("lang") == lang, F.concat(*[_definitions(F.col("_body"), t, p) for t, p in patterns])).otherwise(found)
    targets = F.array().cast("array<string>")
    for lang, (pattern, groups) in IMPORTS.items():
        each = [F.regexp_extract_all(F.col("_body"), F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        both = F.zip_with(each[0], each[1], lambda a, b: F.when(a != "", a).otherwise(b)) if groups == 2 else each[0]
        targets = F.when(F.col("lang") == lang, both).otherwise(targets)
    refs = F.transform(F.filter(targets, lambda t: t != ""), lambda t: F.struct(t.alias("name"), F.lit("ref").alias("kind"), F.lit(0).alias("line"), F.lit("import").alias("node_type")))
    return typed.select("user_id", "file", "lang", F.explode(F.concat(found, refs)).alias("s")).select("user_id", "file", "lang", "s.*")


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(user_id, inner, outer) of all texts of inner (user_id, inner) and outer (user_id, outer) of one user of which the
    first stands in the second; empty texts stand in none.

    An index of the runs of three characters of outer: an inner text looks only at the texts that hold the rarest of its
    runs (a text shorter than a run: at those that hold itself, which only users with such texts are indexed for), so no
    user's texts all meet. Exploded runs are many times what the planner reckons with, so these joins are never broadcast.
    """
    inner, held = inner.filter("inner <> ''").distinct(), outer.filter("outer <> ''").distinct()
    runs = held.filter(F.length("outer") >= 3).select("user_id", "outer", F.explode(_grams(F.col("outer"), 3)).alias("gram"))
    often = runs.groupBy("user_id", "gram").agg(F.count("*").alias("n"))
    sought = inner.filter(F.length("inner") >= 3).select("user_id", "inner", F.explode(_grams(F.col("inner"), 3)).alias("gram"))
    # a run that no outer text has tells that there is no match
    key = sought.join(often.hint("merge"), ["user_id", "gram"], "left").fillna(0, ["n"]).groupBy("user_id", "inner").agg(F.min(F.struct("n", "gram")).alias("k")).filter("k.n > 0")
    key = key.select("user_id", "inner", F.col("k.gram").alias("gram"))
    short = inner.filter(F.length("inner") < 3).withColumn("gram", F.col("inner"))
    both = F.concat(*[F.when(F.length("outer") >= n, _grams(F.col("outer"), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2)])
    few = held.join(short.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "outer", F.explode(both).alias("gram"))
    found = [k.join(i.hint("merge"), ["user_id", "gram"]).filter(F.contains("outer", "inner")).select("user_id", "inner", "outer") for k, i in ((key, runs), (short, few))]
    return found[0].union(found[1])


def build_edges(symbols: DataFrame) -> DataFrame:
    """(user_id, src, dst, w), both ways: 1 for each symbol that two files define, 0.5 for each import that matches a file.

    An import's last part matches a file whose stem equals it, contains it or is contained in it; empty parts match
    nothing. Only files with definitions are nodes.
    """
    defs = symbols.filter("kind = 'def'").select("user_id", "file", "name").distinct()
    shared = defs.alias("a").join(defs.alias("b").hint("merge"), ["user_id", "name"]).filter("a.file < b.file").select("user_id", F.col("a.file").alias("src"), F.col("b.file").alias("dst"), F.lit(1.0).alias("w"))
    nodes = defs.select("user_id", "file").distinct().withColumn("stem", F.lower(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")))
    tail = F.lower(F.substring_index(F.regexp_replace("name", r"[/\\]", "."), ".", -1))
    imports = symbols.filter("kind = 'ref'").select("user_id", "file", "name").distinct().withColumn("tail", tail).filter("tail <> ''")
    imports = imports.join(nodes.select("user_id", "file").hint("merge"), ["user_id", "file"], "left_semi").select("user_id", F.col("file").alias("src"), "tail", "name")
    tails, stems = imports.select("user_id", "tail"), nodes.select("user_id", "stem")
    within = contained(tails.withColumnRenamed("tail", "inner"), stems.withColumnRenamed("stem", "outer")).select("user_id", F.col("inner").alias("tail"), F.col("outer").alias("stem"))
    around = contained(stems.withColumnRenamed("stem", "inner"), tails.withColumnRenamed("tail", "outer")).select("user_id", F.col("outer").alias("tail"), F.col("inner").alias("stem"))
    matches = within.union(around).distinct()
    met = imports.join(matches.hint("merge"), ["user_id", "tail"]).join(nodes.withColumnRenamed("file", "dst").hint("merge"), ["user_id", "stem"])
    imported = met.filter(F.col("src") != F.col("dst")).select("user_id", "src", "dst", F.lit(0.5).alias("w"))
    one_way = shared.unionByName(imported)
    both = one_way.unionByName(one_way.select("user_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("user_id", "src", "dst").agg(F.sum("w").alias("w"))


def _keys(df: DataFrame) -> list[str]:
    """query_id and user_id where seeds are a query's own, else user_id."""
    return [c for c in ("query_id", "user_id") if c in df.columns]


def seed_files(seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """([query_id,] user_id, file) that seeds ([query_id,] user_id, seed) name: a file, or else those that define a symbol."""
    keys, defs = _keys(seeds), symbols.filter("kind = 'def'")
    files = defs.select("user_id", F.col("file").alias("seed")).distinct()
    as_file = seeds.join(files, ["user_id", "seed"], "left_semi").select(*keys, F.col("seed").alias("file"))
    others = seeds.join(files, ["user_id", "seed"], "left_anti")
    as_symbol = others.join(defs.select("user_id", "file", F.col("name").alias("seed")), ["user_id", "seed"]).select(*keys, "file")
    return as_file.union(as_symbol).distinct()


def power_iteration(files: list[str], edges: list[tuple[str, str, float]], seeds: set[str], params: Params = DEFAULT) -> np.ndarray:
    """Ranks after a fixed number of steps; a file without edges hands its rank to all others alike."""
    n, at = len(files), {f: i for i, f in enumerate(files)}
    src, dst, w = (np.array([at[e[0]] for e in edges], int), np.array([at[e[1]] for e in edges], int), np.array([e[2] for e in edges], float)) if edges else (np.empty(0, int), np.empty(0, int), np.empty(0))
    out = np.bincount(src, w, n) if n else np.empty(0)
    start = np.array([1.0 if f in seeds else 0.0 for f in files])
    start = start / start.sum() if start.sum() else np.full(n, 1.0 / max(n, 1))
    rank, loose = np.full(n, 1.0 / max(n, 1)), out <= 0
    share = w / out[src] if len(w) else w
    for _ in range(params.pagerank_iterations):
        new = (1 - params.pagerank_damping) * start + params.pagerank_damping * np.bincount(dst, share * rank[src], n)
        if loose.any() and n > 1:
            spread = params.pagerank_damping * rank[loose] / (n - 1)
            new += spread.sum()
            new[loose] -= spread
        rank = new / new.sum() if new.sum() > 0 else new
    return rank


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, params: Params = DEFAULT, asked: DataFrame | None = None) -> DataFrame:
    """([query_id,] user_id, file, score, is_seed) over each user's graph of nodes (user_id, file).

    Where seeds have a query_id each query is ranked from its own; asked (query_id, user_id) are the queries to rank,
    those without a seed in the graph from everywhere alike. A user's graph is one group, read once for all of the user's
    queries; graphs too large for a task go through pagerank_large.
    """
    none, by_query = F.lit(None).cast("string"), "query_id" in seeds.columns
    query = F.col("query_id") if by_query else none
    parts = nodes.select("user_id", F.col("file").alias("src"), none.alias("dst"), F.lit(0.0).alias("w"), F.lit("node").alias("part"), none.alias("query_id"))
    parts = parts.unionByName(edges.select("user_id", "src", "dst", "w", F.lit("edge").alias("part"), none.alias("query_id")))
    parts = parts.unionByName(seeds.select("user_id", F.col("file").alias("src"), none.alias("dst"), F.lit(0.0).alias("w"), F.lit("seed").alias("part"), query.alias("query_id")))
    if asked is not None:
        parts = parts.unionByName(asked.select("user_id", none.alias("src"), none.alias("dst"), F.lit(0.0).alias("w"), F.lit("ask").alias("part"), "query_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        files = sorted(pdf.loc[pdf["part"] == "node", "src"].unique())
        known = set(files)
        links = [(s, d, w) for s, d, w, p in zip(pdf["src"], pdf["dst"], pdf["w"], pdf["part"], strict=True) if p == "edge" and s in known and d in known]
        chosen: dict = {q: set() for q in pdf.loc[pdf["part"] == "ask", "query_id"]} if by_query else {None: set()}
        for q, f in pdf.loc[pdf["part"] == "seed", ["query_id", "src"]].itertuples(index=False):
            chosen.setdefault(q if by_query else None, set()).add(f)
        user, out = pdf["user_id"].iloc[0], []
        for q, own in sorted(chosen.items(), key=lambda x: str(x[0])):
            out.append(pd.DataFrame({"query_id": q, "user_id": user, "file": files, "score": power_iteration(files, links, own, params), "is_seed": [f in own for f in files]}))
        names = ["query_id", "user_id", "file", "score", "is_seed"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    found = parts.groupBy("user_id").applyInPandas(run, "query_id string, user_id string, file string, score double, is_seed boolean")
    return found if by_query else found.drop("query_id")


#: Edges, or members of groups, of a large graph that a part holds.
EDGE_ROWS = 4 << 20
_PACKED = pa.schema([("part", pa.int32()), ("s", pa.int64()), ("i", pa.int32()), ("own", pa.float64()), *[(c, pa.binary()) for c in ("of", "at", "w")]])


def _packed(rows: pa.Table) -> pa.Table:
    """The members (user_id, via, s, w) of a part's groups as numbered arrays: one row of them all, and for each node
    (s, i: its number here) a row with its edges' weight. Groups of one member have no edges and are left out."""
    user, via = (rows[c].combine_chunks().dictionary_encode() for c in ("user_id", "via"))
    key, s, w = user.indices.to_numpy().astype(np.int64) * len(via.dictionary) + via.indices.to_numpy(), rows["s"].to_numpy(), rows["w"].to_numpy()
    of = np.unique(key, return_inverse=True)[1]
    linked = np.bincount(of)[of] > 1
    of, (nodes, at), w = np.unique(of[linked], return_inverse=True)[1], np.unique(s[linked], return_inverse=True), w[linked]
    own = np.bincount(at, w * (np.bincount(of, w)[of] - w), len(nodes)) if len(w) else np.zeros(0)
    part = rows["part"][0].as_py()
    each = pa.table({"part": np.full(len(nodes), part, np.int32), "s": nodes.astype(np.int64), "i": np.arange(len(nodes), dtype=np.int32), "own": own} | dict.fromkeys(("of", "at", "w"), pa.nulls(len(nodes), pa.binary())))
    whole = pa.table({"part": [part], "s": [None], "i": [None], "own": [None], "of": [of.astype(np.int32).tobytes()], "at": [at.astype(np.int32).tobytes()], "w": [w.tobytes()]})
    return pa.concat_tables([whole.cast(_PACKED), each.cast(_PACKED)])


def _passed(groups: pa.Table, ranks: pa.Table) -> pa.Table:
    """(node, _in) of one part: what each node gets from the others of its groups, whose ranks are shares y of their edges."""
    i, node, y = ranks["i"].to_numpy(), np.zeros(ranks.num_rows, np.int64), np.zeros(ranks.num_rows)
    node[i], y[i] = ranks["s"].to_numpy(), ranks["y"].to_numpy()
    of, at = (np.frombuffer(groups[c][0].as_py(), np.int32) for c in ("of", "at"))
    w = np.frombuffer(groups["w"][0].as_py(), float)
    given = w * y[at]
    return pa.table({"node": node, "_in": np.bincount(at, w * (np.bincount(of, given)[of] - given), len(y)) if len(w) else y})


def _through_groups(members: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], list[DataFrame]]:
    """For members (user_id, via, s, w) of groups: (s, _out), the weight of each node's edges; a function from (node, score)
    to (node, _in); and what is persisted. Pairs of members are never made: a group's sum, less a member's own, is what
    that member gets. Groups are dealt to parts once; a step shuffles a rank for each part that a node has groups in."""
    members = staged(members, "members")
    parts = max(members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // EDGE_ROWS))
    packs = staged(members.withColumn("part", F.pmod(F.xxhash64("user_id", "via"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_packed, from_arrow_schema(_PACKED)), "packs")
    groups = packs.filter("s is null").select("part", "of", "at", "w").repartition(parts, "part").persist(StorageLevel.DISK_ONLY)
    routes = packs.filter("s is not null").select(F.col("part").alias("to"), "s", "i", "own")
    out = staged(routes.groupBy("s").agg(F.sum("own").alias("_out")), "out")
    routes = routes.join(out, "s").select("to", "s", "i", "_out").repartition(parts, "s").persist(StorageLevel.DISK_ONLY)

    def flow(score: DataFrame) -> DataFrame:
        ranks = routes.join(score.withColumnRenamed("node", "s").hint("shuffle_hash"), "s").select("to", "s", "i", (F.col("score") / F.col("_out")).alias("y"))
        given = groups.groupBy("part").cogroup(ranks.groupBy("to")).applyInArrow(_passed, "node long, _in double")
        return given.groupBy("node").agg(F.sum("_in").alias("_in"))

    return out, flow, [groups, routes]


def _through_edges(known: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], list[DataFrame]]:
    """The same for edges (s, d, w), kept on disk by source, so that a step shuffles ranks and partial sums but no edges."""
    known = staged(known, "edges")
    out = staged(known.groupBy("s").agg(F.sum("w").alias("_out")).filter("_out > 0"), "out")
    parts = max(known.sparkSession.sparkContext.defaultParallelism, -(-known.count() // EDGE_ROWS))
    share = known.join(out, "s").select("s", "d", (F.col("w") / F.col("_out")).alias("p")).repartition(parts, "s").persist(StorageLevel.DISK_ONLY)

    def flow(score: DataFrame) -> DataFrame:
        return share.join(score.withColumnRenamed("node", "s").hint("shuffle_hash"), "s").groupBy(F.col("d").alias("node")).agg(F.sum(F.col("p") * F.col("score")).alias("_in"))

    return out, flow, [share]


def pagerank_large(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The same by joins and aggregates, for graphs that no task can hold.

    edges: (user_id, src, dst, w), or members of groups (user_id, src, via, w), each once with w above 0: any two of a group
    are linked both ways by the product of their weights, summed over the groups that both are in.

    Nodes are numbered and the graph is dealt once and kept on disk. Each step is staged, as it is read more than once.
    Ranks keep their sum but for rounding, so they are made to add up to 1 at each step only where some hand theirs to all.
    """
    d = params.pagerank_damping
    nodes = nodes.select("user_id", "file").distinct()
    numbered = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    ends = lambda n: numbered.select("user_id", F.col("file").alias(n), F.col("node").alias(n[0]))
    if "via" in edges.columns:
        members = edges.filter("via is not null").join(ends("src"), ["user_id", "src"]).select("user_id", "via", "s", "w")
        out, flow, kept = _through_groups(members)
    else:
        known = edges.select("user_id", "src", "dst", "w").join(ends("src"), ["user_id", "src"]).join(ends("dst"), ["user_id", "dst"])
        out, flow, kept = _through_edges(known.select("s", "d", "w"))
    picked = seeds.select("user_id", "file").distinct().withColumn("is_seed", F.lit(True))
    base = numbered.join(picked, ["user_id", "file"], "left").fillna(False, ["is_seed"])
    counts = base.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("is_seed").cast("double")).alias("_seeds"))
    start = F.when(F.col("_seeds") > 0, F.col("is_seed").cast("double") / F.col("_seeds")).otherwise(1 / F.col("n"))
    base = base.join(counts, "user_id").join(out.withColumnRenamed("s", "node"), "node", "left")
    base = staged(base.select("user_id", "node", "is_seed", "n", F.col("_out").isNull().alias("_loose"), start.alias("_start")), "base")
    raw, loose = base.select("user_id", "node", "_loose", (1 / F.col("n")).alias("raw")), bool(base.filter("_loose").head(1))
    try:
        for _ in range(params.pagerank_iterations):
            score = raw.select("node", F.col("raw").alias("score"), F.lit(0.0).alias("_spread"))
            if loose:
                totals = raw.groupBy("user_id").agg(F.sum("raw").alias("_sum"), F.sum(F.when(F.col("_loose"), F.col("raw")).otherwise(0.0)).alias("_spread"))
                score = raw.join(totals, "user_id").select("node", F.when(F.col("_sum") > 0, F.col("raw") / F.col("_sum")).otherwise(F.col("raw")).alias("score"), F.try_divide("_spread", "_sum").alias("_spread"))
            spread = (F.coalesce("_spread", F.lit(0.0)) - F.when(F.col("_loose"), F.col("score")).otherwise(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
            new = (1 - d) * F.col("_start") + d * (F.coalesce("_in", F.lit(0.0)) + F.when(F.col("n") > 1, spread).otherwise(0.0))
            raw = staged(base.join(score, "node").join(flow(score.select("node", "score")), "node", "left").select("user_id", "node", "_loose", new.alias("raw")), "ranks")
    finally:
        for df in kept:
            df.unpersist()
    totals = raw.groupBy("user_id").agg(F.sum("raw").alias("_sum"))
    last = raw.join(totals, "user_id").select("node", F.when(F.col("_sum") > 0, F.col("raw") / F.col("_sum")).otherwise(F.col("raw")).alias("score"))
    return numbered.join(last, "node").join(base.select("node", "is_seed"), "node").select("user_id", "file", "score", "is_seed")


def related_files(ranked: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The best files of each query (or user) that aren't seeds. Scores that differ by rounding alone count as equal."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*_keys(ranked)).orderBy(F.desc(F.round("score", 10)), "file")
    return ranked.filter(~F.col("is_seed")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= params.pagerank_top_n)


def boosted(recalled: DataFrame, related: DataFrame, symbols: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """recalled with symbol_boost added to the score of notes whose card names a file related to their query, or one of
    its symbols. related without query_id holds for all queries of its user."""
    keys = _keys(related)
    defined = related.select(*keys, "file").join(symbols.filter("kind = 'def'").select("user_id", "file", "name"), ["user_id", "file"])
    names = related.select(*keys, F.col("file").alias("name")).union(defined.select(*keys, "name")).distinct()
    hits = recalled.select("query_id", "user_id", "id", F.explode("card.files_symbols").alias("name")).join(names, [*keys, "name"], "left_semi").select("query_id", "id").distinct().withColumn("_hit", F.lit(True))
    return recalled.join(hits, ["query_id", "id"], "left").withColumn("score", F.col("score") + F.when(F.col("_hit"), params.symbol_boost).otherwise(0.0)).drop("_hit")
