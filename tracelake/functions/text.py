"""Scalar functions over records: message kinds, titles, keys, names, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings by which a user-side record is told, in order.
COMPACT = ("This session is being continued from a previous conversation",)
COMPACT_WHOLE = "Conversation compacted"
OUTPUTS = ("<local-command-stdout>", "<bash-input>", "<bash-stdout>", "<bash-stderr>")
IDE = ("<ide_opened_file>", "<ide_selection>")
ENVIRONMENT = ("<codex_internal_context", "<in-app-browser-context", "The following is the Codex agent history")
INJECTED = ("# AGENTS.md instructions", "<user_instructions>", "<recommended_plugins>", "<skill>", "<heartbeat>", "<system_instruction>", "<permissions")
DOC_HOSTS = ("notion.so", "docs.google.com", "drive.google.com", "atlassian.net", "linear.app", "figma.com", "getoutline.com")
TITLE_MOST, URL_MOST, KEY_MOST = 200, 2048, 256

_REMINDER = r"<system-reminder>(?s:.*?)</system-reminder>"


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_reminders(text: Column) -> Column:
    """Complete reminder blocks at both ends go; quoted in the middle they stay."""
    steps = F.sequence(F.lit(1), F.size(F.split(text, "<system-reminder>")))

    def peel(core: Column, _: Column) -> Column:
        first = F.when(core.startswith("<system-reminder>"), F.regexp_replace(core, rf"^{_REMINDER}", "")).otherwise(core)
        return bound(trimmed(first), lambda c: F.when(c.endswith("</system-reminder>"), trimmed(F.regexp_replace(c, r"(?s)^(.*)<system-reminder>.*?</system-reminder>$", "$1"))).otherwise(c))

    return F.aggregate(steps, trimmed(text), peel)


def _starts(text: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def user_kind(text: Column, meta: Column | None = None, origin: Column | None = None, agent_first: Column | None = None) -> Column:
    """Kind of a user-side record, from its text and the flags of its record (null: not set)."""
    no = F.lit(False)
    meta, agent_first = F.coalesce(meta, no) if meta is not None else no, F.coalesce(agent_first, no) if agent_first is not None else no
    origin = F.coalesce(origin, F.lit("")) if origin is not None else F.lit("")
    return bound(trimmed(F.coalesce(text, F.lit(""))), lambda t: bound(without_reminders(t), lambda core: _kind(t, core, meta, origin, agent_first)))


def _kind(t: Column, core: Column, meta: Column, origin: Column, agent_first: Column) -> Column:
    task = t.rlike(r"(?s)^<task-notification>.*<task-id>\s*[^<\s].*</task-notification>\s*$")
    dump = t.rlike(r"(?s)^<environment_context>.*<cwd>[^<]+</cwd>.*<shell>[^<]+</shell>.*</environment_context>$")
    return (
        F.when(_starts(t, COMPACT) | (t == COMPACT_WHOLE), "compact_summary")
        .when(t.startswith("[Request interrupted") | t.startswith("<turn_aborted>"), "interrupted")
        .when(t.startswith("<local-command-caveat>"), "caveat")
        .when(_starts(t, OUTPUTS), "command_output")
        .when(task, "task_notification")
        .when(t.startswith("[SYSTEM NOTIFICATION]"), "system_notification")
        .when(t.rlike(r"(?s)^<teammate-message[\s>].*</teammate-message>$"), "teammate_message")
        .when(_starts(t, IDE), "ide_context")
        .when(_starts(t, ENVIRONMENT) | dump, "env_context")
        .when(_starts(t, INJECTED) | (t == "Warmup"), "harness_injected")
        .when((core == "") & t.contains("<system-reminder>"), "system_reminder")
        .when((core == "<system-reminder>") | core.startswith("<system-reminder>\n"), "system_reminder")
        .when(origin == "task-notification", "task_notification")
        .when(origin == "peer", "teammate_message")
        .when(meta | (origin == "auto-continuation"), "harness_injected")
        .when((core.startswith("<command-name>") | core.startswith("<command-message>")) & (command(core) == ""), "harness_injected")
        .when(command(core) != "", "slash_command")
        .when(agent_first, "subagent_task")
        .otherwise("human")
    )


def assistant_kind(text: Column) -> Column:
    return F.when(trimmed(F.coalesce(text, F.lit(""))) != "", "assistant_text").otherwise("assistant_usage_only")


def command(text: Column) -> Column:
    """The command of a typed line or of the record's envelope, with its slash; empty if there is none."""
    wrapped = F.regexp_extract(text, r"(?s)<command-name>\s*(.*?)\s*</command-name>", 1)
    typed = F.regexp_extract(text, r"^(/[A-Za-z0-9_:.-]+)(?:[ \t\r\n]|$)", 1)
    return F.when(text.startswith("<command-name>") | text.startswith("<command-message>"), wrapped).otherwise(typed)


def command_args(text: Column) -> Column:
    return trimmed(F.regexp_extract(text, r"(?s)^/[A-Za-z0-9_:.-]+(.*)$", 1))


def title(text: Column) -> Column:
    """First line, 200 characters at most."""
    return F.left(trimmed(F.split_part(trimmed(text), F.lit("\n"), F.lit(1))), F.lit(TITLE_MOST))


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(8))


def deterministic_id(session: Column, seq: Column, kind: Column, part: Column) -> Column:
    nul = F.decode(F.unhex(F.lit("00")), "utf-8")
    return F.left(F.sha2(F.concat(session, nul, seq.cast("string"), nul, kind, nul, part), 256), F.lit(32))


def canonical_thread(agent: Column) -> Column:
    """The sixteen hex digits that two spellings of an agent id share, else the id; empty for the main thread."""
    core = F.regexp_extract(agent, r"(?:^|-)([0-9a-f]{16})$", 1)
    return F.when(agent.isNull(), "").when(core != "", core).otherwise(agent)


def key_or_null(value: Column) -> Column:
    return F.when((value != "") & (F.octet_length(value) <= KEY_MOST), value)


def skill_name(raw: Column) -> tuple[Column, Column]:
    """(plugin, skill) in lower case, control characters gone, split at the last colon; null if it is no name."""
    clean = F.lower(F.regexp_replace(raw, r"[\x00-\x1f\x7f]", ""))
    ok = clean.rlike(r"^[a-z0-9][a-z0-9:_./-]*$") & (F.length(clean) <= 200)
    skill = F.substring_index(clean, ":", -1)
    plugin = F.left(clean, F.length(clean) - F.length(skill) - 1)
    return F.when(ok & clean.contains(":"), plugin), F.when(ok, skill)


def dedupe_key(tool_use: Column, invocation: Column, session: Column, prompt: Column, skill: Column, event: Column) -> Column:
    """What makes two rows one invocation, the strongest evidence first."""
    return F.coalesce(F.concat(F.lit("tu:"), tool_use), F.concat(F.lit("inv:"), invocation), F.concat(F.lit("pr:"), session, F.lit(":"), prompt, F.lit(":"), skill), F.concat(F.lit("ev:"), event))


def project_slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def repo_of(cwd: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(cwd, "/+$", ""), "([^/]+)$", 1)


def safe_cut(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, no character cut in two."""
    raw = F.encode(text, "utf-8")
    lead = lambda k: F.substring(raw, most + 1 - k, 1)
    goes_on = lambda k: F.hex(lead(k)).between("80", "BF")
    cut = F.when(~goes_on(0), 0).when(~goes_on(1), 1).when(~goes_on(2), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most) - cut), "utf-8"))


def links(text: Column) -> Column:
    """URLs in order, each once: trailing marks and unbalanced closing brackets trimmed, longer than 2,048 dropped."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"'`\\|^{}]+)"))

    def count(u: Column, mark: str) -> Column:
        return F.length(u) - F.length(F.replace(u, F.lit(mark), F.lit("")))

    def step(u: Column, _: Column) -> Column:
        mark = F.right(u, F.lit(1))
        over = mark.isin(*".,;:!?") | ((mark == ")") & (count(u, "(") < count(u, ")"))) | ((mark == "]") & (count(u, "[") < count(u, "]")))
        return F.when(over, F.left(u, F.length(u) - 1)).otherwise(u)

    def trim(u: Column) -> Column:
        tail = F.length(F.regexp_extract(u, r"[.,;:!?)\]]*$", 0))
        return F.aggregate(F.sequence(F.lit(0), tail), u, step)

    return F.array_distinct(F.filter(F.transform(found, trim), lambda u: (F.length(u) <= URL_MOST) & u.rlike("^https?://[^/?#]")))


def link_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^https?://(?:[^/?#@]*@)?([^/?#]+)", 1))


def link_kind(url: Column) -> Column:
    """(kind, reference) of a URL."""
    host, path = link_host(url), F.regexp_extract(url, "^https?://[^/?#]+/*([^?#]*)", 1)
    git = (host == "github.com") | host.endswith(".github.com")
    part = lambda i: F.split_part(path, F.lit("/"), F.lit(i))
    repo = F.concat(part(1), F.lit("/"), part(2))
    has = git & (part(1) != "") & (part(2) != "")
    digits = part(4).rlike("^[0-9]+$")
    doc = F.lit(False)
    for d in DOC_HOSTS:
        doc = doc | (host == d) | host.endswith(f".{d}")
    none = F.lit("")
    return (
        F.when(has & part(3).isin("pull", "pulls") & digits, F.struct(F.lit("pr").alias("kind"), F.concat(repo, F.lit("#"), part(4)).alias("ref")))
        .when(has & (part(3) == "issues") & digits, F.struct(F.lit("issue").alias("kind"), F.concat(repo, F.lit("#"), part(4)).alias("ref")))
        .when(has & part(3).isin("commit", "commits") & (part(4) != ""), F.struct(F.lit("commit").alias("kind"), F.concat(repo, F.lit("@"), F.left(part(4), F.lit(7))).alias("ref")))
        .when(has, F.struct(F.lit("repo").alias("kind"), repo.alias("ref")))
        .when(git, F.struct(F.lit("other").alias("kind"), none.alias("ref")))
        .when(host.endswith(".slack.com"), F.struct(F.lit("slack").alias("kind"), none.alias("ref")))
        .when(doc, F.struct(F.lit("doc").alias("kind"), none.alias("ref")))
        .otherwise(F.struct(F.lit("other").alias("kind"), none.alias("ref")))
    )
