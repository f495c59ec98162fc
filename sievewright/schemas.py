"""Schemas of every stage. Nothing is inferred."""

from __future__ import annotations

FILES = "path string, ord bigint, text string, parseable boolean"
SKELETONS = "path string, text string"
IR = "path string, type string, node_type string, start int, end int, text string"
GROUPS = "group_id bigint, is_large boolean, path string, ord bigint, t int"
CHUNKS = "path string, chunk_no int, chunk string"
MESSAGES = "array<struct<role:string,content:string>>"
REQUESTS = f"cache_key string, model string, messages {MESSAGES}, path string"
ANSWERS = "cache_key string, answer string, from_cache boolean"
CACHE = "cache_key string, response string, ts timestamp, seq bigint"
ERRORS = "kind string, message string, path string, cause string"
