"""Transcripts to typed events: raw rows (nested JSON), wire messages, inline tool tags, task context, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, text_of
from ..params import DEFAULT, Params

#: Fixed patterns, keys and maps.
TOOL_TAG = r"(?s)<tool_use\s+name=[\"']?([A-Za-z_]+)[\"']?\s*>(.*?)</tool_use>"
FILE_KEYS = ("file_path", "path", "filename", "file")
QUOTED_FILE = r"[\"']([^\"']+\.[A-Za-z]{1,4})[\"']"
RENDERED_KEYS = ("file_path", "path", "command", "pattern", "query")
INSTANCE = r"instance_id:\s*([A-Za-z0-9_.\-/]+)"
REPO = r"(?m)^\s*repo:\s*([A-Za-z0-9_.\-/]+)\s*$"
COMMIT = r"base_commit:\s*([0-9a-fA-F]+)"
STATEMENT = r"(?s)problem_statement:\s*[\"']?(.*?)(?=\n[A-Za-z_]+:|\nDescription\b|\z)"
PYTHON_REPOS = (
    "django/django", "astropy/astropy", "matplotlib/matplotlib", "mwaskom/seaborn", "pallets/flask", "psf/requests",
    "pydata/xarray", "pylint-dev/pylint", "pytest-dev/pytest", "scikit-learn/scikit-learn", "sphinx-doc/sphinx", "sympy/sympy",
)
EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "go": "go", "c": "c",
    "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "rs": "rust",
}
ROW_TYPES = ("user", "assistant", "file-history-snapshot", "summary")

_SESSION = ("user_id", "session_id", "request_id")
_INPUT = "map<string,string>"


def tool_files(tool: Column, inputs: Column) -> Column:
    """The file paths of a tool call: known keys in order, then quoted files of a shell command; distinct."""
    named = F.array_compact(F.array(*[F.nullif(strip(F.element_at(inputs, F.lit(k))), F.lit("")) for k in FILE_KEYS]))
    quoted = F.when(tool == "Bash", F.regexp_extract_all(text_of(F.element_at(inputs, F.lit("command"))), F.lit(QUOTED_FILE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named, quoted))


def _inputs(body: Column) -> Column:
    """Lines `key: value` of a tool tag's body as a map; a later key wins."""
    lines = F.filter(F.split(body, r"\r\n|\n|\r"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def _event(role: Column, kind: Column, text: Column, tool: Column | None = None, inputs: Column | None = None, result: Column | None = None, tool_id: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    empty = F.from_json(F.lit("{}"), _INPUT)
    return F.struct(
        role.alias("role"), kind.alias("kind"), text.alias("text"), (none if tool is None else tool).alias("tool_name"), (empty if inputs is None else inputs).alias("tool_input"),
        (none if result is None else result).alias("tool_result"), (none if tool_id is None else tool_id).alias("tool_id"),
    )


def message_events(role: Column, content: Column) -> Column:
    """array<event> of a plain message: the text between inline tool tags, stripped, and the calls in the tags.

    A message of nothing else is one text event; an empty one has none.
    """
    names, bodies = (F.regexp_extract_all(text_of(content), F.lit(TOOL_TAG), F.lit(g)) for g in (1, 2))
    around = F.split(text_of(content), TOOL_TAG, -1)
    n = F.size(around)
    texts = F.transform(around, lambda t: F.array(_event(role, F.lit("text"), strip(t))))
    calls = F.zip_with(names, bodies, lambda name, body: F.array(_event(role, F.lit("tool_use"), F.lit(""), name, _inputs(body))))
    woven = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get(texts, i), F.coalesce(F.get(calls, i), F.slice(F.get(texts, i), 2, 1)))))
    events = F.filter(woven, lambda e: (e["kind"] == "tool_use") | (e["text"] != ""))
    whole = F.array(_event(role, F.lit("text"), content))
    return F.when(text_of(content) == "", F.slice(whole, 2, 1)).when(F.size(events) > 0, events).otherwise(whole)


def _finish(exploded: DataFrame, place: list[str]) -> DataFrame:
    w = Window.partitionBy(*_SESSION).orderBy(*place)
    out = exploded.select(*_SESSION, (F.row_number().over(w) - 1).alias("event_index"), "event.*", "cwd", "git_branch", "ts")
    return out.withColumn("files_touched", F.when(F.col("kind") == "tool_use", tool_files(F.col("tool_name"), F.col("tool_input"))).otherwise(F.array().cast("array<string>")))


def events_of_messages(messages: DataFrame) -> DataFrame:
    """Events of wire messages (user_id, session_id, request_id, position, role, content, ts), in list order."""
    out = messages.select(*_SESSION, "position", F.lit("").alias("cwd"), F.lit("").alias("git_branch"), F.col("ts").cast("string").alias("ts"), F.posexplode(message_events(F.col("role"), F.col("content"))).alias("part", "event"))
    return _finish(out, ["position", "part"])


def explode_wire(requests: DataFrame) -> DataFrame:
    """Rows for events_of_messages from requests with a list of messages."""
    out = requests.select(*_SESSION, F.posexplode("messages").alias("position", "m"))
    return out.select(*_SESSION, "position", "m.role", "m.content", F.col("m.timestamp").cast("string").alias("ts"))


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): ids and messages must be given, roles known, contents not blank."""
    blank = lambda c: text_of(strip(F.col(c))) == ""
    reason = F.coalesce(
        F.when(blank("user_id"), "user_id"), F.when(blank("session_id"), "session_id"), F.when(blank("request_id"), "request_id"),
        F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "messages"),
        F.when(F.exists("messages", lambda m: ~F.coalesce(m["role"], F.lit("")).isin("user", "assistant")), "role"),
        F.when(F.exists("messages", lambda m: strip(m["content"]) == ""), "content"),
    )
    marked = requests.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def _json(row: Column, path: str) -> Column:
    return F.get_json_object(row, path)


def events_of_raw(rows: DataFrame) -> DataFrame:
    """Events of raw transcript rows (user_id, session_id, request_id, row_pos, raw JSON); malformed rows are skipped.

    Raw rows have a type; their message's content is text or a list of blocks. Rows with a role alone are plain
    messages. Ids of tool calls and results are kept, so that they can be joined.
    """
    raw = F.col("raw")
    base = rows.filter(F.try_parse_json(raw).isNotNull()).withColumns({
        "type": _json(raw, "$.type"), "role": F.coalesce(_json(raw, "$.message.role"), _json(raw, "$.role"), _json(raw, "$.type")), "content": F.coalesce(_json(raw, "$.message.content"), _json(raw, "$.content")),
        "cwd": F.coalesce(_json(raw, "$.cwd"), _json(raw, "$.message.cwd"), F.lit("")), "git_branch": F.coalesce(_json(raw, "$.gitBranch"), F.lit("")), "ts": F.coalesce(_json(raw, "$.timestamp"), F.lit("")),
    })
    block = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"
    kind_of = lambda path: F.expr(f"schema_of_variant(variant_get(try_parse_json(raw), '{path}'))")
    listed = F.coalesce(kind_of("$.message.content").startswith("ARRAY"), kind_of("$.content").startswith("ARRAY"), F.lit(False))
    blocks = F.from_json("content", block)
    role = F.col("role")

    def of_block(b: Column) -> Column:
        items = F.from_json(b["content"], "array<struct<type:string,text:string>>")
        joined = F.array_join(F.transform(F.filter(items, lambda i: i["type"] == "text"), lambda i: text_of(i["text"])), "\n")
        inputs = F.coalesce(F.from_json(b["input"], _INPUT), F.create_map(F.lit("value"), text_of(b["input"])))
        result = F.when(b["content"].startswith("["), F.coalesce(joined, b["content"])).otherwise(text_of(b["content"]))
        return (
            F.when(b["type"] == "text", _event(role, F.lit("text"), text_of(b["text"])))
            .when(b["type"] == "thinking", _event(role, F.lit("thinking"), text_of(F.coalesce(b["thinking"], b["text"]))))
            .when(b["type"] == "tool_use", _event(role, F.lit("tool_use"), F.lit(""), text_of(b["name"]), inputs, tool_id=b["id"]))
            .when(b["type"] == "tool_result", _event(role, F.lit("tool_result"), F.lit(""), result=result, tool_id=b["tool_use_id"]))
        )

    typed = F.col("type").isin(*ROW_TYPES)
    events = (
        F.when(F.col("type").isin("file-history-snapshot", "summary"), F.array(_event(F.col("type"), F.lit("snapshot"), F.lit(""))))
        .when(listed & (typed | _json(raw, "$.role").isNotNull()), F.filter(F.transform(blocks, of_block), lambda e: e.isNotNull()))
        .when(typed & F.col("content").isNotNull(), F.array(_event(role, F.lit("text"), F.col("content"))))
        .when(_json(raw, "$.role").isNotNull(), message_events(role, F.col("content")))
    )
    out = base.select(*_SESSION, "row_pos", "cwd", "git_branch", "ts", F.posexplode(events).alias("part", "event"))
    return _finish(out, ["row_pos", "part"])


def language(repo: Column, files: Column) -> Column:
    """A known repository's language, else that of most files (ties: the first seen); empty if unknown."""
    by_extension = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    found = F.filter(F.transform(files, lambda f: F.element_at(by_extension, F.lower(F.regexp_extract(f, r"\.([A-Za-z]+)$", 1)))), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(found), lambda x: F.struct(F.size(F.filter(found, lambda y: y == x)).alias("n"), (-F.array_position(found, x)).alias("place"), x.alias("lang")))
    return F.when(repo.isin(*PYTHON_REPOS), "python").otherwise(F.coalesce(F.array_max(counted)["lang"], F.lit("")))


def context_fields(text: Column) -> dict[str, Column]:
    statement = F.regexp_replace(strip(F.regexp_extract(text_of(text), STATEMENT, 1)), r"^[\"']+|[\"']+$", "")
    return {"instance_id": F.regexp_extract(text_of(text), INSTANCE, 1), "repo": F.regexp_extract(text_of(text), REPO, 1), "base_commit": F.regexp_extract(text_of(text), COMMIT, 1), "problem_statement": statement}


def task_context(events: DataFrame) -> DataFrame:
    """One row for each request: what the first user text says of the task, files touched in order, language."""
    first = F.min_by("text", F.when((F.col("role") == "user") & (F.col("kind") == "text"), F.col("event_index")))
    touched = F.array_sort(F.collect_list(F.when(F.size("files_touched") > 0, F.struct("event_index", "files_touched"))))
    out = events.groupBy(*_SESSION).agg(first.alias("_first"), F.array_distinct(F.flatten(F.transform(touched, lambda t: t["files_touched"]))).alias("files_touched"))
    out = out.withColumns(context_fields(F.col("_first")))
    out = out.withColumn("problem_statement", F.coalesce(F.nullif("problem_statement", F.lit("")), F.substring(text_of(F.col("_first")), 1, 2000)))
    return out.withColumn("language", language(F.col("repo"), F.col("files_touched"))).drop("_first")


def event_line(params: Params = DEFAULT) -> Column:
    """An event as a line of text; null for snapshots and empty ones."""
    role, body = F.col("role"), strip(F.col("text"))
    shown = [F.when(text_of(F.element_at("tool_input", F.lit(k))) != "", F.concat(F.lit(f"{k}="), F.substring(F.element_at("tool_input", F.lit(k)), 1, 200))) for k in RENDERED_KEYS]
    result = strip(F.col("tool_result"))
    return (
        F.when((F.col("kind") == "text") & (body != ""), F.concat(F.lit("["), role, F.lit("] "), body))
        .when((F.col("kind") == "thinking") & (body != ""), F.concat(F.lit("["), role, F.lit(":thinking] "), F.substring(body, 1, 600)))
        .when(F.col("kind") == "tool_use", F.rtrim(F.concat(F.lit("["), role, F.lit(":tool:"), F.col("tool_name"), F.lit("] "), F.concat_ws(", ", *shown))))
        .when((F.col("kind") == "tool_result") & (result != ""), F.concat(F.lit("[tool_result] "), F.substring(result, 1, params.transcript_tool_result_cap)))
    )


def render(events: DataFrame, keys: list[str], params: Params = DEFAULT) -> DataFrame:
    """The events of each group of keys as one text, in order."""
    lined = events.withColumn("_line", event_line(params))
    lines = F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("event_index", "_line"))))
    return lined.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("segment_text"))


def tool_contents(events: DataFrame, keys: tuple[str, ...] = _SESSION) -> DataFrame:
    """(*keys, file, body), keys being a session's or a segment's: file-reading calls joined with their results by tool id; bodies of more than 40 characters.

    Where ids are missing the next result of the group answers the call. Line-number prefixes are removed; of several
    results of a file the last stays.
    """
    w = Window.partitionBy(*keys).orderBy("event_index").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("kind") == "tool_result", F.struct("event_index", "tool_id", "tool_result")), ignorenulls=True).over(w)
    marked = events.withColumn("_next", following)
    path = strip(F.coalesce(F.element_at("tool_input", F.lit("file_path")), F.element_at("tool_input", F.lit("path"))))
    calls = marked.filter((F.col("kind") == "tool_use") & F.col("tool_name").isin("Read", "Edit", "Write", "View") & (path != "")).select(*keys, "tool_id", path.alias("file"), "_next")
    results = events.filter("kind = 'tool_result' and tool_id is not null").select(*keys, "tool_id", F.col("event_index").alias("_at"), F.col("tool_result").alias("_body"))
    joined = calls.join(results, [*keys, "tool_id"], "left")
    by_next = F.col("tool_id").isNull()
    out = joined.select(*keys, "file", F.when(by_next, F.col("_next.event_index")).otherwise(F.col("_at")).alias("_at"), strip(F.when(by_next, F.col("_next.tool_result")).otherwise(F.col("_body"))).alias("body"))
    out = out.filter(F.length("body") > 40).groupBy(*keys, "file").agg(F.max_by("body", "_at").alias("body"))
    return out.withColumn("body", F.regexp_replace("body", r"(?m)^\s*[0-9]+→", ""))


def to_wire(events: DataFrame) -> DataFrame:
    """Events flattened to plain messages, as an exporter would: calls and results in brackets, thinking dropped."""
    shown = [F.when(text_of(F.element_at("tool_input", F.lit(k))) != "", F.concat(F.lit(f"{k}="), F.element_at("tool_input", F.lit(k)))) for k in ("file_path", "path", "pattern", "command", "query", "url")]
    content = (
        F.when(F.col("kind") == "text", strip(F.col("text")))
        .when(F.col("kind") == "tool_use", F.concat(F.lit("[tool_use: "), F.col("tool_name"), F.lit("("), F.concat_ws(", ", *shown), F.lit(")]")))
        .when(F.col("kind") == "tool_result", F.concat(F.lit("[tool_result] "), F.substring(strip(F.col("tool_result")), 1, 600)))
    )
    return events.select(*_SESSION, "event_index", "role", content.alias("content")).filter(text_of(F.col("content")) != "")
