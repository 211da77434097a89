"""Keys of events: from their own columns first, else from the raw record of a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.transcripts import blocks_of, flattened
from . import text as T

#: Commands of the harness itself, which are no skills.
BUILTIN = (
    "login", "logout", "effort", "model", "rate-limit-options", "reload-skills", "reload-plugins", "insights", "compact", "clear", "help", "status", "plugin", "mcp", "resume", "rename", "permissions", "btw", "fast",
    "exit", "cost", "doctor", "config", "memory", "hooks", "agents", "context", "terminal-setup", "vim", "bug", "release-notes", "upgrade", "privacy-settings", "stats", "usage", "add-dir", "ide", "install-github-app",
)


def builtin_command(name: Column) -> Column:
    return F.lower(F.regexp_replace(T.trimmed(name), "^/", "")).isin(*BUILTIN)


def json_equal(a: Column, b: Column) -> Column:
    """Two JSON texts with the same value, whatever their spacing and order of keys."""
    plain = lambda x: F.to_json(F.try_parse_json(x))
    return F.coalesce(plain(a) == plain(b), a.eqNullSafe(b))


def keys_of(events: DataFrame) -> DataFrame:
    """The event's keys: its own values, else those of its transcript record; values over 256 bytes are none."""
    raw = F.when((F.col("origin") == "transcript") & F.get_json_object("raw", "$.hook_event_name").isNull(), F.col("raw"))
    paths = {"prompt_id": "$.promptId", "record_uuid": "$.uuid", "parent_record_uuid": "$.logicalParentUuid", "request_id": "$.requestId", "message_id": "$.message.id"}
    own = lambda c: F.when(F.col(c) != "", F.col(c))
    out = events.withColumns({c: T.key_or_null(F.coalesce(own(c), F.get_json_object(raw, path))) for c, path in paths.items()})
    return out.withColumn("tool_use_id", T.key_or_null(F.coalesce(own("tool_use_id"), tool_use_id(F.col("type"), F.get_json_object(raw, "$.message.content"), F.col("tool_name"), F.col("tool_input"), F.col("tool_output")))))


def tool_use_id(kind: Column, content: Column, name: Column, given: Column, output: Column) -> Column:
    """The id of the block that a tool event comes from: the one block that matches it, or the only block of its sort; null if that is not clear."""
    blocks = blocks_of(content)
    call = kind == "tool_call"
    sort = F.filter(blocks, lambda b: F.when(call, b["type"] == "tool_use").otherwise(b["type"] == "tool_result"))
    like = F.filter(sort, lambda b: F.when(call, (b["name"] == name) & json_equal(b["input"], given)).otherwise(flattened(b["content"]) == F.coalesce(output, F.lit(""))))
    chosen = F.when(F.size(like) > 0, like).otherwise(sort)
    one = F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0)))
    return F.when(kind.isin("tool_call", "tool_result", "tool_failed"), F.when(call, one["id"]).otherwise(one["tool_use_id"]))


def kind_of(events: DataFrame) -> Column:
    """What a text-bearing event is; null for others.  A subagent's first prompt is its task."""
    agent = F.coalesce("agent_id", F.lit("")) != ""
    return (
        F.when(F.col("type") == "user_prompt", T.user_kind(F.col("text"), agent_first=agent & (F.col("seq") <= 1)))
        .when(F.col("type") == "assistant_turn", T.assistant_kind(F.col("text")))
        .when(F.col("type").isin("tool_result", "tool_failed"), "tool")
    )


def args_bytes(raw: Column) -> Column:
    """Bytes of an argument: of the string itself where it is a JSON string, else of its JSON text."""
    value = F.when(raw.rlike(r'(?s)^\s*".*"\s*$'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    return F.coalesce(F.octet_length(F.coalesce(value, raw)), F.lit(0))
