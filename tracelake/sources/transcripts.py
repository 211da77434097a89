"""Transcript records, rollout items and hook payloads as events.

Lines of a file are ordered by where their split starts in the file and by their
place in the split, so it does not matter how Spark packs splits into tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Most bytes of a tool's output and of one side of a change, record types that carry content, and hook events by type.
OUTPUT_MOST, SIDE_MOST = 512 << 10, 1 << 20
CONTENT = ("user", "assistant")
HOOKS = {
    "SessionStart": "session_started",
    "SessionEnd": "session_ended",
    "UserPromptSubmit": "user_prompt",
    "Stop": "assistant_turn",
    "PreToolUse": "tool_call",
    "PostToolUse": "tool_result",
    "PostToolUseFailure": "tool_failed",
    "SubagentStart": "subagent_start",
    "SubagentStop": "subagent_end",
    "PreCompact": "compaction",
}
CALLS = ("function_call", "custom_tool_call", "tool_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")

_USAGE = "struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>"
RECORD = (
    "type string, uuid string, promptId string, sessionId string, requestId string, timestamp string, entrypoint string, cwd string, aiTitle string, agentId string, isCompactSummary boolean, isMeta boolean, "
    f"message struct<id: string, role: string, model: string, content: string, usage: {_USAGE}>"
)
BLOCKS = "array<struct<type: string, text: string, thinking: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>"
ROLLOUT = (
    "type string, timestamp string, payload struct<type: string, id: string, role: string, call_id: string, name: string, arguments: string, input: string, output: string, content: string, "
    "info: struct<last_token_usage: struct<input_tokens: long, cached_input_tokens: long, output_tokens: long>>>"
)
HOOK = "hook_event_name string, session_id string, prompt_id string, agent_id string, tool_use_id string, tool_name string, tool_input string, tool_response string, error string, prompt string, response string, source string, reason string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; line counts from 1."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value")
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("start", "place")).cast("bigint").alias("line"), "value")


def records(lines: DataFrame, schema: str = RECORD) -> DataFrame:
    """Parsed lines with a clock (at) that carries the last time forward; lines that are no record go."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("file", "line", F.col("value").alias("raw"), F.from_json("value", schema).alias("r")).where("r.type is not null")
    return rows.select("file", "line", "raw", "r.*").withColumn("at", F.last(F.try_to_timestamp("timestamp"), ignorenulls=True).over(w))


def flattened(content: Column) -> Column:
    """A content that is a string as it is; one that is an array of blocks as their texts, a line each."""
    blocks = F.from_json(content, "array<struct<text: string>>")
    return F.when(content.isNull(), "").when(content.startswith("[") & blocks.isNotNull(), F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t != ""), "\n")).otherwise(content)


def blocks_of(content: Column) -> Column:
    """The content's blocks; a plain string has none."""
    return F.when(content.startswith("["), F.coalesce(F.from_json(content, BLOCKS), F.array().cast(BLOCKS))).otherwise(F.array().cast(BLOCKS))


_EVENT = "struct<type: string, text: string, part: string, tool_use_id: string, tool_name: string, tool_input: string, tool_output: string, truncated: boolean>"


def _event(kind: Column, text: Column | None = None, part: Column | None = None, **more: Column) -> Column:
    none = F.lit(None).cast("string")
    values = {"type": kind, "text": text if text is not None else none, "part": part if part is not None else none, "tool_use_id": none, "tool_name": none, "tool_input": none, "tool_output": none, "truncated": F.lit(False), **more}
    return F.struct(*[v.alias(k) for k, v in values.items()]).cast(_EVENT)


def capped(output: Column, most: int = OUTPUT_MOST) -> Column:
    return T.safe_cut(output, most)


def record_events(rows: DataFrame) -> DataFrame:
    """Events of content records, in order: prose (with the record's usage), tool calls, tool results; a compaction summary is one event."""
    content = F.col("message.content")
    rows = rows.where(F.col("type").isin(*CONTENT)).withColumn("blocks", blocks_of(content))
    texts = F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n")
    prose = F.when(content.startswith("[") & F.from_json(content, BLOCKS).isNotNull(), texts).otherwise(F.coalesce(content, F.lit("")))
    thinks = F.exists("blocks", lambda b: (b["type"] == "thinking") & (F.coalesce(b["thinking"], F.lit("")) != ""))
    results = F.exists("blocks", lambda b: b["type"] == "tool_result")
    usage = (F.col("type") == "assistant") & F.col("message.usage").isNotNull() & (F.coalesce("message.model", F.lit("")) != "<synthetic>")
    summary = F.coalesce("isCompactSummary", F.lit(False)) | ((F.col("type") == "user") & ~results & (T.user_kind(prose) == "compact_summary"))
    rows = rows.withColumns({"prose": prose, "usage": usage, "summary": summary})
    args = T.trimmed(F.regexp_extract("prose", r"(?s)<command-args>(.*?)</command-args>", 1))
    name = T.command(F.col("prose"))
    said = F.when((F.col("type") == "user") & F.col("prose").startswith("<command-"), F.when(args != "", F.concat(name, F.lit(" "), args)).otherwise(name)).otherwise(F.col("prose"))
    turn = F.when((F.col("prose") != "") | thinks | F.col("usage"), F.array(_event(F.when(F.col("type") == "user", "user_prompt").otherwise("assistant_turn"), said, F.lit("turn"))))
    none = F.array().cast(f"array<{_EVENT}>")

    def tool(b: Column, i: Column) -> Column:
        output = flattened(b["content"])
        cut = capped(output)
        call = _event(F.lit("tool_call"), part=F.concat_ws(":", F.lit("tool_use"), i.cast("string"), b["id"]), tool_use_id=b["id"], tool_name=b["name"], tool_input=b["input"])
        kind = F.when(F.coalesce(b["is_error"], F.lit(False)), "tool_failed").otherwise("tool_result")
        result = _event(kind, part=F.concat_ws(":", F.lit("tool_result"), i.cast("string"), b["tool_use_id"]), tool_use_id=b["tool_use_id"], tool_output=cut, truncated=F.octet_length(output) > OUTPUT_MOST)
        return F.when(b["type"] == "tool_use", call).when(b["type"] == "tool_result", result)

    events = F.when(F.col("summary"), F.array(_event(F.lit("compaction"), F.col("prose"), F.lit("compaction")))).otherwise(F.concat(F.coalesce(turn, none), F.array_compact(F.transform("blocks", tool))))
    out = rows.select("file", "line", "uuid", F.col("sessionId").alias("session_id"), F.col("agentId").alias("agent_id"), F.col("promptId").alias("prompt_id"), "at", "raw", F.col("message.id").alias("message_id"), F.col("requestId").alias("request_id"), F.col("message.model").alias("model"), F.when(F.col("usage"), F.col("message.usage")).alias("u"), F.posexplode(events).alias("place", "e"))
    # the record's usage rides its first event that is a turn or a call
    first = (F.col("place") == 0) & F.col("e.type").isin("assistant_turn", "tool_call")
    order = Window.partitionBy("file").orderBy("line", "place")
    out = out.withColumn("seq", F.row_number().over(order).cast("bigint"))
    return out.select("file", "line", "seq", "session_id", "agent_id", "uuid", "prompt_id", "at", "raw", "e.*", *[F.when(first, F.col(c)).alias(c) for c in ("message_id", "request_id")], "model", *[F.when(first, F.col(f"u.{c}")).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")])


def rollout_usage(u: Column) -> tuple[Column, Column, Column]:
    """Input without the cached part, output, and the cached part; reasoning is part of the output already."""
    cached = F.coalesce(u["cached_input_tokens"], F.lit(0))
    return F.greatest(F.coalesce(u["input_tokens"], F.lit(0)) - cached, F.lit(0)), F.coalesce(u["output_tokens"], F.lit(0)), cached


def rollout_events(rows: DataFrame) -> DataFrame:
    """Events of rollout items; the first token count after an event is that event's usage, later ones before the next event are repeats."""
    p = F.col("payload")
    item, role = p["type"], p["role"]
    kind = (
        F.when((F.col("type") == "response_item") & (item == "message") & (role == "user"), "user_prompt")
        .when((F.col("type") == "response_item") & (((item == "message") & (role == "assistant")) | (item == "agent_message")), "assistant_turn")
        .when((F.col("type") == "response_item") & item.isin(*CALLS), "tool_call")
        .when((F.col("type") == "response_item") & item.isin(*OUTPUTS), "tool_result")
    )
    usage = F.when((F.col("type") == "event_msg") & (item == "token_count"), p["info"]["last_token_usage"])
    rows = rows.withColumn("kind", kind).withColumn("usage", usage)
    order = Window.partitionBy("file").orderBy("line")
    rows = rows.withColumn("n", F.sum(F.col("kind").isNotNull().cast("bigint")).over(order))
    first = rows.where("usage is not null and n > 0").groupBy("file", "n").agg(F.min_by("usage", "line").alias("usage"))
    spent = first.select("file", "n", *[c.alias(name) for c, name in zip(rollout_usage(F.col("usage")), ("input_tokens", "output_tokens", "cached_tokens"), strict=True)])
    called = F.coalesce(F.when(p["call_id"] != "", p["call_id"]), p["id"])
    part = F.when(item == "message", F.concat_ws(":", item, p["id"], role)).when(item == "agent_message", F.concat_ws(":", item, p["id"])).otherwise(F.concat_ws(":", item, called))
    events = rows.where("kind is not null").select(
        "file", "line", "n", F.col("kind").alias("type"), "at", part.alias("part"), F.when(F.col("kind").isin("user_prompt", "assistant_turn"), flattened(p["content"])).alias("text"),
        F.when(F.col("kind") == "tool_call", p["name"]).alias("tool_name"), F.when(F.col("kind") == "tool_call", F.coalesce(p["arguments"], p["input"])).alias("tool_input"), F.when(F.col("kind") == "tool_result", capped(flattened(p["output"]))).alias("tool_output"),
    )
    return events.join(spent, ["file", "n"], "left").withColumnRenamed("n", "seq")


def hook_events(payloads: DataFrame) -> DataFrame:
    """One event per hook payload (column value, JSON) of a known name; names that are not known give none."""
    names = F.create_map(*[F.lit(x) for pair in HOOKS.items() for x in pair])
    rows = payloads.withColumn("h", F.from_json("value", HOOK)).withColumn("type", F.try_element_at(names, F.col("h.hook_event_name"))).where("type is not null")
    said = F.when(F.col("type") == "user_prompt", F.col("h.prompt")).when(F.col("type").isin("assistant_turn", "subagent_end"), F.col("h.response")).when(F.col("type") == "session_started", F.col("h.source")).when(F.col("type") == "session_ended", F.col("h.reason"))
    tool = F.col("type").isin("tool_call", "tool_result", "tool_failed")
    output = F.when(F.col("type") == "tool_result", F.col("h.tool_response")).when(F.col("type") == "tool_failed", F.coalesce("h.error", "h.tool_response"))
    return rows.select(
        *payloads.columns, "type", F.col("h.session_id").alias("session_id"), F.col("h.prompt_id").alias("prompt_id"), F.col("h.agent_id").alias("agent_id"), said.alias("text"),
        F.when(tool, F.col("h.tool_use_id")).alias("tool_use_id"), F.when(tool, F.col("h.tool_name")).alias("tool_name"), F.when(F.col("type") == "tool_call", F.col("h.tool_input")).alias("tool_input"), capped(output).alias("tool_output"),
    )


def heads(rows: DataFrame, lines: int = 200) -> DataFrame:
    """Per file, from its first lines: session, entrypoint, working folder, title, and the first content record."""
    top = rows.where(F.col("line") <= lines)
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("line"))).alias(c)
    content = F.when(F.col("type").isin(*CONTENT) & (F.coalesce("uuid", F.lit("")) != ""), F.col("line"))
    return top.groupBy("file").agg(
        first("sessionId"), first("entrypoint"), first("cwd"), F.max_by("aiTitle", F.when((F.col("type") == "ai-title") & (F.col("aiTitle") != ""), F.col("line"))).alias("title"),
        F.min_by("uuid", content).alias("first_uuid"), F.min_by("promptId", content).alias("first_prompt_id"), F.min_by("at", content).alias("first_at"),
    )


def tails(rows: DataFrame) -> DataFrame:
    """Per file the last model call that spent something (synthetic answers did not), and the prompt it belongs to."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("prompt", F.last(F.when(F.col("type") == "user", F.when(F.col("promptId") != "", F.col("promptId"))), ignorenulls=True).over(w))
    u = F.col("message.usage")
    spent = F.coalesce(u["input_tokens"], F.lit(0)) + F.coalesce(u["output_tokens"], F.lit(0))
    call = F.when((F.col("type") == "assistant") & (F.coalesce("message.model", F.lit("")) != "<synthetic>") & (spent > 0), F.col("line"))
    return rows.groupBy("file").agg(F.max_by("uuid", call).alias("uuid"), F.max_by("message.id", call).alias("message_id"), F.max_by("prompt", call).alias("prompt_id"), F.max_by(spent, call).alias("tokens"), F.max("at").alias("last_at"))


def anchored(stops: DataFrame, tails_: DataFrame) -> DataFrame:
    """Hook answers with the record that the transcript's tail proves to be theirs: the same prompt id, or none on the hook's side."""
    rows = stops.join(tails_.select("file", F.col("uuid").alias("record_uuid"), F.col("prompt_id").alias("tail_prompt"), F.col("message_id").alias("tail_message")), "file", "left")
    ok = (F.coalesce("prompt_id", F.lit("")) == "") | (F.col("prompt_id") == F.col("tail_prompt"))
    return rows.withColumns({"record_uuid": F.when(ok, F.col("record_uuid")), "message_id": F.when(ok, F.col("tail_message"))}).drop("tail_prompt", "tail_message")
