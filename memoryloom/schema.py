"""Fixed schemas of the engine's tables."""

from __future__ import annotations

CARD = (
    "struct<memory_type:string,instance_id:string,trigger:string,root_cause:string,action_hint:string,files_symbols:array<string>,"
    "failure_if_ignored:string,scope:string,temporal_anchor:string,gist:string,entities:array<string>,keywords:array<string>,"
    "pairs:array<struct<attr:string,value:string>>>"
)
CARD_TEXTS = ("trigger", "root_cause", "action_hint", "failure_if_ignored", "scope")
CARD_LISTS = ("files_symbols", "entities", "keywords", "pairs")
MEMORY_TYPES = ("profile", "event", "record")
MEMORIES = (
    f"id string, user_id string, session_id string, request_id string, content string, embedding array<float>, memory_type string, card {CARD}, "
    "created_at timestamp, version int, supersedes_id string, superseded_by string, superseded boolean"
)
FILE_SYMBOLS = "user_id string, file string, lang string, updated_at timestamp, symbols array<struct<name:string,kind:string,line:int,node_type:string>>"
EVENTS = (
    "user_id string, session_id string, request_id string, event_index int, role string, kind string, text string, tool_name string, "
    "tool_input map<string,string>, tool_result string, tool_id string, files_touched array<string>, cwd string, git_branch string, ts string"
)
RAW_ROWS = "user_id string, session_id string, request_id string, row_pos int, raw string"
WIRE = "request_id string, user_id string, session_id string, messages array<struct<role:string,content:string,timestamp:long>>"
SEARCHES = "query_id string, user_id string, query string, top_k int, options array<string>"
