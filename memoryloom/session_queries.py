"""Queries over transcripts and source files that Spark derives from the given tables, with DuckDB SQL.

Sessions: every conversation becomes a transcript of JSON lines (task header, plain messages, blocks of thinking, text and
tool calls, results that come after the next message, snapshots, broken lines), is written as text files and read back by
the transcript source. Source files: every part becomes a file of one of five languages that defines and imports things
named after it. Texts for cards: every item in one of several phrases. The SQL states what comes out of the tables, and
knows nothing of the JSON, the files or the patterns.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import card
from .operators import graph, segment, transcript
from .params import DEFAULT
from .sources import store
from .sources.checkpoints import shared_folder, staged


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(pattern: str, **parts: Column) -> Column:
    """pattern with {names} filled in by columns."""
    head, *pieces = pattern.split("{")
    out = [F.lit(head)]
    for piece in pieces:
        name, found, rest = piece.partition("}")
        out += [parts[name].cast("string"), F.lit(rest)] if found and name in parts else [F.lit("{" + piece)]
    return F.concat(*out)


HEADER = "instance_id: proj__c{c}-1\nrepo: {repo}\nbase_commit: a{c}f\nproblem_statement: case {c} of many\nDescription\nsome words"
BODY = "     1→package m{m}\n     2→func Load{c}() {\n     3→}\n     4→// generated for conversation {c}"


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(session, pos, line): the conversations as JSON lines."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", (1_700_000_000 + F.col("conv_id") * 100_000 + F.col("turn") * 100 + F.floor((F.col("turn") + 1) / 4) * 700).alias("ts"))
    conv, turn = F.col("conv_id"), F.col("turn")
    call = _text("call-{c}-{t}", c=conv, t=turn)
    none = F.lit(None).cast("string")
    row = lambda kind, content, ts: F.to_json(F.struct(F.lit(kind).alias("type"), ts.alias("timestamp"), conv.cast("string").alias("sessionId"), F.lit("/w").alias("cwd"), F.struct(F.lit(kind).alias("role"), content.alias("content")).alias("message")))
    block = lambda kind, **k: F.struct(F.lit(kind).alias("type"), *[k.get(n, none).alias(n) for n in ("thinking", "text", "id", "name")], k.get("input", F.lit(None).cast("struct<file_path:string,todos:string>")).alias("input"))
    reads = turn % 3 != 2
    inputs = F.struct(F.when(reads, _text("src/m{m}.go", m=turn % 3)).alias("file_path"), F.when(~reads, F.lit("next steps")).alias("todos"))
    says = row("assistant", F.array(block("thinking", thinking=_text("plan {t}", t=turn)), block("text", text=F.col("text")), block("tool_use", id=call, name=F.when(reads, F.lit("Read")).otherwise("TodoWrite"), input=inputs)), F.col("ts"))
    result = F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.array(F.struct(F.lit("text").alias("type"), _text(BODY, m=turn % 3, c=conv).alias("text"))).alias("content"))
    summary = F.to_json(F.struct(F.lit("summary").alias("type"), conv.cast("string").alias("sessionId"), F.col("ts").alias("timestamp"), F.col("text").alias("summary")))
    spoken = c.select("conv_id", (turn * 10).alias("pos"), F.when(F.col("role") == "user", row("user", F.col("text"), F.col("ts"))).when(F.col("role") == "assistant", says).otherwise(summary).alias("line"))
    results = c.filter((F.col("role") == "assistant") & reads).select("conv_id", (turn * 10 + 25).alias("pos"), row("user", F.array(result), F.col("ts") + 150).alias("line"))
    repo = F.when(conv % 5 == 0, F.lit("django/django")).otherwise(_text("org/p{p}", p=conv % 5))
    first = c.select("conv_id").distinct().withColumn("ts", 1_700_000_000 + conv * 100_000)
    heads = first.select("conv_id", F.lit(-10).cast("long").alias("pos"), row("user", _text(HEADER, c=conv, repo=repo), F.col("ts")).alias("line"))
    broken = first.select("conv_id", F.lit(-5).cast("long").alias("pos"), F.lit('{"type": "user", broken').alias("line"))
    return spoken.union(results).union(heads).union(broken).withColumnRenamed("conv_id", "session")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the transcripts, through files of JSON lines and the transcript source."""
    path = f"{shared_folder(spark)}/memoryloom-{spark.sparkContext.applicationId}/transcripts-{uuid.uuid4().hex}"
    transcript_lines(spark, sf).repartition("session").sortWithinPartitions("session", "pos").select("line").write.text(path)
    return transcript.events_of_raw(store.read_transcripts(spark, path, session="$.sessionId"))


def raw_transcripts(spark, sf):
    return sessions(spark, sf).select("session_id", "event_index", "role", "kind", "text", "tool_name", F.element_at("tool_input", F.lit("file_path")).alias("file"), "tool_result", "ts")


def task_context(spark, sf):
    found = transcript.task_context(sessions(spark, sf))
    return found.select("session_id", "instance_id", "repo", "base_commit", "problem_statement", F.array_join("files_touched", ",").alias("files"), "language")


def tool_join(spark, sf):
    return transcript.tool_contents(sessions(spark, sf)).select("session_id", "file", "body")


def segment_sessions(spark, sf):
    """All boundaries at once: todo calls, idle gaps, both caps, and results that stay with their calls."""
    p = replace(DEFAULT, chunk_max_messages=6, chunk_max_words=150)
    return segment.segment_events(sessions(spark, sf), ["user_id", "session_id", "request_id"], params=p).select("session_id", "event_index", "segment_id")


def wire_export(spark, sf):
    return transcript.to_wire(sessions(spark, sf)).select("session_id", "event_index", "role", "content")


#: Phrases for cards: {n} is an item's name, {b} its brand, {i} its id, {s} its size.
PHRASES = (
    "Fixed the KeyError in Store{b}.Load of {n}. See src/app/store{i}.py for more",
    "This service uses python and uses postgres with version {s}.2.3",
    "A plain note on HTTPServer and Request{b} handling of {n}",
    "built with Django framework, auth uses jwt, deployed on kubernetes in {b}",
    "The crash uses a library badly: {n}\nwritten in rust",
    "Refactored lib{i}/b/c.go and lib/util{s}.js!\nIt was an error",
)


def _phrases(spark, sf) -> DataFrame:
    i = table(spark, sf, "items").filter("item_id is not null and name is not null and brand is not null and size is not null")
    said = F.element_at(F.array(*[_text(p, n=F.col("name"), b=F.col("brand"), i=F.col("item_id"), s=F.col("size")) for p in PHRASES]), (F.col("item_id") % len(PHRASES) + 1).cast("int"))
    return i.select("item_id", said.alias("text"))


def card_parts(spark, sf):
    t, none, blank = F.col("text"), F.array().cast("array<string>"), F.lit("")
    c = card.heuristic_card(t, F.lit("org/app"), F.lit("python"), none, F.lit("a1"), F.lit("task-1"))
    shown = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["attr"], p["value"])), ",")
    return _phrases(spark, sf).withColumn("c", c).select(
        "item_id", F.col("c.memory_type").alias("kind"), F.array_join(card.symbols(t), ",").alias("symbols"), shown(card.profile_pairs(t)).alias("pairs"), shown(F.col("c.pairs")).alias("kept_pairs"), F.array_join("c.files_symbols", ",").alias("files"),
        F.col("c.gist").alias("gist"), F.col("c.trigger").alias("trigger"), F.array_join("c.entities", ",").alias("entities"), F.array_join("c.keywords", ",").alias("keywords"), card.content_of(F.col("c"), blank).alias("content"),
    )


#: A source file of each language: {w} and {a} are a part's noun and adjective, {k} its key, {o} another part's.
SOURCES = {
    "py": "import os\nfrom pkg.{w}_{o} import x\n\ndef load_{w}(a):\n  pass\nclass {a}{k}:\n  def save(self):\n    pass\n",
    "js": "import a from './{w}_{o}'\nfunction run{w}(a) {\n}\nclass {a}Box {\n}\n",
    "java": "import q.{w}_{o};\npublic class {a}{k} {\n  public void turn{w}() {\n  }\n}\n",
    "go": 'package p\nimport "x/{w}_{o}"\nfunc Turn{w}() {\n}\ntype {a}{k} struct {\n}\n',
    "txt": "def none_{w}():\n",
}
#: Parts of one user: a user's file graph stays small, however many parts there are.
PARTS = 250


def _sources(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").filter("p_partkey is not null and p_name is not null")
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    fill = {"w": F.get(words, F.lit(1)), "a": F.initcap(F.get(words, F.lit(0))), "k": key, "o": F.floor(key / 10)}
    kinds = list(SOURCES)
    ext = F.element_at(F.array(*map(F.lit, kinds)), (key % len(kinds) + 1).cast("int"))
    content = F.element_at(F.array(*[_text(SOURCES[k], **fill) for k in kinds]), (key % len(kinds) + 1).cast("int"))
    return p.select(F.floor(key / PARTS).cast("string").alias("user_id"), F.concat(F.lit("src/"), fill["w"], F.lit("_"), key.cast("string"), F.lit("."), ext).alias("file"), content.alias("content"))


def symbol_defs_imports(spark, sf):
    return graph.extract_symbols(_sources(spark, sf))


def graph_edges(spark, sf):
    return graph.build_edges(staged(symbol_defs_imports(spark, sf), "symbols"))


def symbol_boost(spark, sf):
    """Related files of each user, from the files that define two of its symbols."""
    s = staged(symbol_defs_imports(spark, sf), "symbols")
    users = s.select("user_id").distinct()
    seeds = graph.seed_files(users.select("user_id", F.explode(F.array(F.lit("load_ring"), F.lit("Turnbolt"))).alias("seed")), s)
    nodes = s.filter("kind = 'def'").select("user_id", "file").distinct()
    best = graph.related_files(graph.pagerank(nodes, graph.build_edges(s), seeds))
    return best.select("user_id", "file", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (raw_transcripts, task_context, tool_join, segment_sessions, wire_export, card_parts, symbol_defs_imports, graph_edges, symbol_boost)}

_BODY = "'package m' || turn % 3 || chr(10) || 'func Load' || conv_id || '() {' || chr(10) || '}' || chr(10) || '// generated for conversation ' || conv_id"
_EVENTS = """
  c AS (SELECT *, 1700000000 + conv_id * 100000 + turn * 100 + (turn + 1) // 4 * 700 AS t, turn % 3 <> 2 AS reads FROM conversations),
  parts AS (
    SELECT conv_id, -10 AS pos, 0 AS part, 'user' AS role, 'text' AS kind, 'instance_id: proj__c' || conv_id || '-1' || chr(10) || 'repo: ' || CASE WHEN conv_id % 5 = 0 THEN 'django/django' ELSE 'org/p' || conv_id % 5 END || chr(10)
      || 'base_commit: a' || conv_id || 'f' || chr(10) || 'problem_statement: case ' || conv_id || ' of many' || chr(10) || 'Description' || chr(10) || 'some words' AS text,
      NULL AS tool_name, NULL AS file, NULL AS tool_result, 0 AS extra, 1700000000 + conv_id * 100000 AS t FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT conv_id, turn * 10, 0, 'user', 'text', text, NULL, NULL, NULL, 0, t FROM c WHERE role = 'user'
    UNION ALL SELECT conv_id, turn * 10, 0, 'assistant', 'thinking', 'plan ' || turn, NULL, NULL, NULL, 0, t FROM c WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn * 10, 1, 'assistant', 'text', text, NULL, NULL, NULL, 0, t FROM c WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn * 10, 2, 'assistant', 'tool_use', '', CASE WHEN reads THEN 'Read' ELSE 'TodoWrite' END, CASE WHEN reads THEN 'src/m' || turn % 3 || '.go' END, NULL, CASE WHEN reads THEN 1 ELSE 2 END, t FROM c WHERE role = 'assistant'
    UNION ALL SELECT conv_id, turn * 10 + 25, 0, 'user', 'tool_result', '', NULL, NULL, '     1→package m' || turn % 3 || chr(10) || '     2→func Load' || conv_id || '() {' || chr(10) || '     3→}' || chr(10) || '     4→// generated for conversation ' || conv_id, 0, t + 150
      FROM c WHERE role = 'assistant' AND reads
    UNION ALL SELECT conv_id, turn * 10, 0, 'summary', 'snapshot', '', NULL, NULL, NULL, 0, t FROM c WHERE role NOT IN ('user', 'assistant')),
  events AS (SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos, part) - 1 AS event_index, role, kind, text, tool_name, file, tool_result, extra, t FROM parts)"""
_COUNT = r"len(list_filter(string_split_regex({}, '\s+'), lambda x: x <> ''))"
# a pattern's match begins with the blank line before it, and so does its line
_FILES = f"""p AS (SELECT (p_partkey // {PARTS})::VARCHAR AS user_id, p_partkey AS k, p_partkey // 10 AS o, p_partkey % 5 AS kind, split_part(p_name, ' ', 2) AS w, upper(p_name[1]) || lower(substr(split_part(p_name, ' ', 1), 2)) AS a FROM part),
  f AS (SELECT *, 'src/' || w || '_' || k || ['.py', '.js', '.java', '.go', '.txt'][kind + 1] AS file, ['python', 'javascript', 'java', 'go', NULL][kind + 1] AS lang FROM p),
  s AS (
    SELECT user_id, file, lang, unnest([{{'name': 'load_' || w, 'line': 3, 'node_type': 'function_definition'}}, {{'name': a || k, 'line': 6, 'node_type': 'class_definition'}}, {{'name': 'save', 'line': 7, 'node_type': 'function_definition'}},
      {{'name': 'os', 'line': 0, 'node_type': 'import'}}, {{'name': 'pkg.' || w || '_' || o, 'line': 0, 'node_type': 'import'}}]) AS x FROM f WHERE kind = 0
    UNION ALL SELECT user_id, file, lang, unnest([{{'name': 'run' || w, 'line': 2, 'node_type': 'function_declaration'}}, {{'name': a || 'Box', 'line': 4, 'node_type': 'class_declaration'}}, {{'name': './' || w || '_' || o, 'line': 0, 'node_type': 'import'}}]) FROM f WHERE kind = 1
    UNION ALL SELECT user_id, file, lang, unnest([{{'name': a || k, 'line': 2, 'node_type': 'class_declaration'}}, {{'name': 'turn' || w, 'line': 3, 'node_type': 'method_declaration'}}, {{'name': 'q.' || w || '_' || o, 'line': 0, 'node_type': 'import'}}]) FROM f WHERE kind = 2
    UNION ALL SELECT user_id, file, lang, unnest([{{'name': 'Turn' || w, 'line': 3, 'node_type': 'function_declaration'}}, {{'name': a || k, 'line': 5, 'node_type': 'type_declaration'}}, {{'name': 'x/' || w || '_' || o, 'line': 0, 'node_type': 'import'}}]) FROM f WHERE kind = 3),
  symbols AS (SELECT user_id, file, lang, x.name AS name, CASE WHEN x.line = 0 THEN 'ref' ELSE 'def' END AS kind, x.line AS line, x.node_type AS node_type FROM s)"""
_GRAPH = f"""{_FILES},
  def AS (SELECT DISTINCT user_id, file, name FROM symbols WHERE kind = 'def'),
  node AS (SELECT DISTINCT user_id, file, lower(regexp_replace(split_part(file, '/', -1), '\\.[^.]*$', '')) AS stem FROM def),
  imp AS (SELECT DISTINCT user_id, file, name, lower(split_part(regexp_replace(name, '[/\\\\]', '.', 'g'), '.', -1)) AS tail FROM symbols WHERE kind = 'ref'),
  one AS (SELECT a.user_id, a.file AS src, b.file AS dst, 1.0::DOUBLE AS w FROM def a JOIN def b ON a.user_id = b.user_id AND a.name = b.name AND a.file < b.file
    UNION ALL SELECT imp.user_id, imp.file, node.file, 0.5::DOUBLE FROM imp JOIN node ON imp.user_id = node.user_id AND imp.file <> node.file AND (contains(tail, stem) OR contains(stem, tail)) WHERE tail <> ''),
  edge AS (SELECT user_id, src, dst, sum(w) AS w FROM (SELECT * FROM one UNION ALL SELECT user_id, dst, src, w FROM one) GROUP BY ALL)"""

ORACLES = {
    "raw_transcripts": f"WITH {_EVENTS} SELECT session_id, event_index, role, kind, text, tool_name, file, tool_result, t::VARCHAR AS ts FROM events",
    "task_context": """WITH touched AS (SELECT conv_id, string_agg(file, ',' ORDER BY begun) AS files FROM (SELECT conv_id, 'src/m' || turn % 3 || '.go' AS file, min(turn) AS begun FROM conversations WHERE role = 'assistant' AND turn % 3 <> 2 GROUP BY ALL) GROUP BY conv_id)
      SELECT DISTINCT conv_id::VARCHAR AS session_id, 'proj__c' || conv_id || '-1' AS instance_id, CASE WHEN conv_id % 5 = 0 THEN 'django/django' ELSE 'org/p' || conv_id % 5 END AS repo, 'a' || conv_id || 'f' AS base_commit, 'case ' || conv_id || ' of many' AS problem_statement,
        coalesce(files, '') AS files, CASE WHEN conv_id % 5 = 0 THEN 'python' WHEN files IS NULL THEN '' ELSE 'go' END AS language FROM conversations LEFT JOIN touched USING (conv_id)""",
    "tool_join": f"SELECT conv_id::VARCHAR AS session_id, 'src/m' || turn % 3 || '.go' AS file, {_BODY} AS body FROM (SELECT conv_id, turn % 3 AS turn FROM conversations WHERE role = 'assistant' AND turn % 3 <> 2 GROUP BY ALL)",
    "segment_sessions": f"""WITH RECURSIVE {_EVENTS},
      e AS (SELECT *, {_COUNT.format('text')} + {_COUNT.format("coalesce(tool_result, '')")} + extra AS words FROM events),
      g(session_id, event_index, kind, t, seg, n, w) AS (SELECT session_id, event_index, kind, t, 0, 1, words FROM e WHERE event_index = 0
        UNION ALL SELECT session_id, event_index, kind, t, CASE WHEN cut THEN seg + 1 ELSE seg END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN words ELSE w + words END
          FROM (SELECT e.session_id, e.event_index, e.kind, e.t, g.seg, g.n, g.w, e.words,
              NOT (e.kind = 'tool_result' AND g.kind = 'tool_use') AND (coalesce(e.tool_name = 'TodoWrite', false) OR e.t - g.t > 600 OR g.n >= 6 OR g.w + e.words > 150) AS cut
            FROM g JOIN e ON e.session_id = g.session_id AND e.event_index = g.event_index + 1))
      SELECT session_id, event_index, seg AS segment_id FROM g""",
    "wire_export": f"""WITH {_EVENTS} SELECT * FROM (SELECT session_id, event_index, role, CASE kind WHEN 'text' THEN trim(text, E' \\n\\t\\r') WHEN 'tool_use' THEN '[tool_use: ' || tool_name || '(' || coalesce('file_path=' || file, '') || ')]'
      WHEN 'tool_result' THEN '[tool_result] ' || substr(trim(tool_result), 1, 600) ELSE '' END AS content FROM events) WHERE content <> ''""",
    "card_parts": """WITH i AS (SELECT item_id, item_id % 6 AS m, name AS n, brand AS b, size AS s FROM items WHERE item_id IS NOT NULL AND name IS NOT NULL AND brand IS NOT NULL AND size IS NOT NULL),
      c AS (SELECT item_id, m, ['event', 'profile', 'record', 'event', 'record', 'event'][m + 1] AS kind,
        ['Fixed,KeyError,Store' || b || '.Load,See', 'This', 'HTTPServer,Request' || b, CASE WHEN len(b) > 2 THEN 'Django,' || b ELSE 'Django' END, 'The', 'Refactored'][m + 1] AS symbols,
        ['', 'language=python,database=postgres,version=' || s || '.2.3', '', 'framework=django,auth=jwt,deployment=kubernetes', 'language=rust', ''][m + 1] AS pairs,
        ['src/app/store' || item_id || '.py', '', '', '', '', 'lib' || item_id || '/b/c.go,lib/util' || s || '.js'][m + 1] AS files,
        ['Fixed the KeyError in Store' || b || '.Load of ' || n || '.', 'This service uses python and uses postgres with version ' || s || '.2.3', 'A plain note on HTTPServer and Request' || b || ' handling of ' || n, 'built with Django framework, auth uses jwt, deployed on kubernetes in ' || b,
          'The crash uses a library badly: ' || n, 'Refactored lib' || item_id || '/b/c.go and lib/util' || s || '.js!'][m + 1] AS gist,
        CASE m WHEN 2 THEN 'HTTPServer,Request' || b WHEN 4 THEN 'The' ELSE '' END AS entities,
        CASE m WHEN 2 THEN array_to_string((list_concat(['plain', 'note', 'HTTPServer', 'Request' || b, 'handling'], list_filter(string_split(n, ' '), lambda w: len(w) >= 4)))[1:10], ',')
          WHEN 4 THEN array_to_string((list_concat(['crash', 'uses', 'library', 'badly'], list_filter(string_split(n, ' '), lambda w: len(w) >= 4), ['written', 'rust']))[1:10], ',') ELSE '' END AS keywords FROM i)
      SELECT item_id, kind, symbols, pairs, CASE kind WHEN 'profile' THEN pairs ELSE '' END AS kept_pairs, files, gist, CASE WHEN m IN (0, 5) THEN gist ELSE '' END AS trigger, entities, keywords,
        '[task-1] | ' || gist || CASE WHEN files = '' THEN '' ELSE ' | Files: ' || replace(files, ',', ', ') END || CASE WHEN entities = '' THEN '' ELSE ' | Entities: ' || replace(entities, ',', ', ') END
          || CASE WHEN keywords = '' THEN '' ELSE ' | Keywords: ' || array_to_string(string_split(keywords, ',')[1:8], ', ') END AS content FROM c""",
    "symbol_defs_imports": f"WITH {_FILES} SELECT * FROM symbols",
    "graph_edges": f"WITH {_GRAPH} SELECT * FROM edge",
    "symbol_boost": f"""WITH RECURSIVE {_GRAPH},
      total AS (SELECT user_id, src, sum(w) AS total FROM edge GROUP BY ALL),
      many AS (SELECT user_id, count(*) AS n FROM node GROUP BY ALL),
      move AS (SELECT user_id, src, dst, 0.85 * w / total AS p FROM edge JOIN total USING (user_id, src)
        UNION ALL SELECT a.user_id, a.file, b.file, 0.85 / (n - 1) FROM node a JOIN node b ON a.user_id = b.user_id AND a.file <> b.file JOIN many ON many.user_id = a.user_id ANTI JOIN total ON total.user_id = a.user_id AND total.src = a.file
        UNION ALL SELECT user_id, file, file, NULL FROM node),
      seed AS (SELECT DISTINCT user_id, file FROM def WHERE name IN ('load_ring', 'Turnbolt')),
      start AS (SELECT node.user_id, node.file, CASE WHEN k IS NULL THEN 1.0 / n WHEN seed.file IS NULL THEN 0.0 ELSE 1.0 / k END AS p0, seed.file IS NOT NULL AS is_seed
        FROM node JOIN many USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS k FROM seed GROUP BY ALL) USING (user_id) LEFT JOIN seed ON seed.user_id = node.user_id AND seed.file = node.file),
      walk(i, user_id, file, rk) AS (SELECT 0, user_id, file, 1.0::DOUBLE / n FROM node JOIN many USING (user_id)
        UNION ALL SELECT w.i + 1, w.user_id, m.dst, sum(CASE WHEN m.p IS NULL THEN 0.15 * s.p0 ELSE w.rk * m.p END)
          FROM walk w JOIN move m ON m.user_id = w.user_id AND m.src = w.file JOIN start s ON s.user_id = w.user_id AND s.file = m.dst WHERE w.i < 40 GROUP BY w.i, w.user_id, m.dst)
      SELECT user_id, file, round(rk, 6) AS score, rank FROM (SELECT user_id, file, rk, row_number() OVER (PARTITION BY user_id ORDER BY round(rk, 10) DESC, file) AS rank FROM walk JOIN start USING (user_id, file) WHERE i = 40 AND NOT is_seed) WHERE rank <= 10""",
}
