"""The turn fold: a session's events, captured by hook and by transcript, as conversation turns.

Sessions are dealt to tasks and sorted by Spark; one pass over a task's rows then
folds one session after the other, however few rows each has.  A session is
bounded by what one conversation can hold.  The result does not depend on the
order of the input.

Input: session_id, id, seq, type, origin, agent_id, occurred_at, prompt_id,
message_id, tool_use_id, kind, has_text, has_usage, text_hash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of prompts that people type, kinds that open a turn, rows that only mark; in microseconds, how far
# copies of one moment may be apart, and the longest gap that still counts as activity.
HUMAN = ("human", "slash_command")
OPENING = (*HUMAN, "", "subagent_task")
MARKERS = ("subagent_start", "subagent_end", "compaction")
TWIN, ACTIVE = 5_000_000, 300_000_000

TURN = (
    "session_id string, thread string, turn_index long, key string, started_at timestamp_ntz, last_activity_at timestamp_ntz, prompt_id string, kind string, "
    "prompts long, answers long, tools long, errors long, files long, merged long, prompt_event_id string, final_event_id string, first_activity_at timestamp_ntz, answered_at timestamp_ntz, "
    "active_ms long, wall_ms long, idle_ms long, waiting_ms long, subagents long, origins string, outcome string"
)
EVENT = "session_id string, thread string, turn_index long, event_id string, role string, superseded_by string"
_CORE = re.compile(r"([0-9a-f]{16})$")
_FIELDS = ("occurred_at", "seq", "id", "type", "origin", "prompt_id", "message_id", "tool_use_id", "kind", "has_text", "has_usage", "text_hash")


class Row(NamedTuple):
    at: int
    seq: int
    id: str
    type: str
    origin: str
    prompt: str
    message: str
    tool: str
    kind: str
    text: bool
    usage: bool
    hash: str

    @property
    def hook(self) -> bool:
        return self.origin == "hook"


_order = itemgetter(0, 1, 2)


@dataclass(eq=False)
class Prompt:
    """One prompt with its copies; the transcript's comes first and stands for it."""

    rows: list[Row]
    copy_of: Prompt | None = None
    turn: Turn | None = None

    def __post_init__(self) -> None:
        self.head = self.rows[0]
        self.ids = [r.prompt for r in self.rows if r.prompt]
        self.kind = next((r.kind for r in self.rows if r.kind), "")
        self.hash = next((r.hash for r in self.rows if r.hash), "")
        first = min(self.rows, key=itemgetter(0))
        self.at, self.seq = first.at, first.seq
        self.opens = self.kind in OPENING
        self.stamp = (self.head.origin, self.head.at // 1_000_000, self.hash) if self.hash and not self.ids else None

    @property
    def name(self) -> str:
        return f"pid:{self.ids[0]}" if self.ids else f"ts:{self.at // 1_000_000}:{self.hash or 'notext'}"


@dataclass(eq=False)
class Turn:
    key: str
    at: int
    kind: str = ""
    last: int | None = None
    prompts: list[Prompt] = field(default_factory=list)
    work: list[Row] = field(default_factory=list)
    counted: int = 0
    opened: bool = False
    answered: bool = False
    interrupted: int | None = None
    subagents: int = 0

    def touch(self, at: int) -> None:
        self.last = at if self.last is None else max(self.last, at)

    def take(self, row: Row) -> None:
        self.work.append(row)
        self.touch(row.at)


def thread_of(agent: str | None) -> str:
    agent = (agent or "").strip()
    m = _CORE.search(agent)
    return m[1] if m else agent


def _agree(a: Row, b: Row) -> bool:
    return not a.kind or not b.kind or a.kind == b.kind or (a.kind in HUMAN and b.kind in HUMAN)


def paired(rows: list[Row]) -> list[Prompt]:
    """Prompts of a thread, in order.  Each hook copy, in turn, takes the nearest free transcript copy: first by prompt id, then by text within TWIN."""
    hooks, scripts = [r for r in rows if r.hook], [r for r in rows if not r.hook]
    by_id, by_hash = defaultdict(list), defaultdict(list)
    for s in scripts:
        by_id[s.prompt].append(s)
        by_hash[s.hash].append(s)
    mate: dict[str, Row] = {}  # id of the transcript copy: hook copy
    done: set[str] = set()

    def choose(h: Row, options: list[Row], fits) -> None:
        free = [(abs(s.at - h.at), i) for i, s in enumerate(options) if s.id not in mate and fits(s)]
        if free:
            mate[options[min(free)[1]].id] = h
            done.add(h.id)

    for h in hooks:
        if h.prompt:
            choose(h, by_id[h.prompt], lambda s, h=h: _agree(h, s))
    for h in hooks:
        if h.hash and h.id not in done:
            same = by_hash[h.hash]
            near = same[bisect_left(same, h.at - TWIN, key=itemgetter(0)) : bisect_left(same, h.at + TWIN + 1, key=itemgetter(0))]
            choose(h, near, lambda s, h=h: _agree(h, s) and not (s.prompt and h.prompt and s.prompt != h.prompt and s.kind in HUMAN and h.kind in HUMAN))
    found = [Prompt([s, mate[s.id]] if s.id in mate else [s]) for s in scripts] + [Prompt([h]) for h in hooks if h.id not in done]
    return sorted(found, key=lambda p: (p.at, p.seq, p.head.id))


class Thread:
    """Folds the rows of one thread; what is left are its turns, and the turn that each prompt id names."""

    def __init__(self, name: str, rows: list[Row], ended: bool):
        self.name, self.turns, self.by_prompt, self.stamps = name, [], {}, {}
        self.names: dict[str, int] = defaultdict(int)
        self.waiting: list[Row] = []
        self.head: Turn | None = None
        self.ended = ended or any(r.type == "subagent_end" for r in rows)
        others = [r for r in rows if r.type not in ("user_prompt", "session_started", "session_ended")]
        items = [(p.at, 0, p.seq, p.head.id, p) for p in paired([r for r in rows if r.type == "user_prompt"])]
        items += [(r.at, 1, r.seq, r.id, r) for r in others]
        for *_, item in sorted(items, key=itemgetter(0, 1, 2, 3)):
            self._prompt(item) if isinstance(item, Prompt) else self._row(item)
        if self.waiting:
            self._settle(self._before_all(self.waiting[0].at))

    def _settle(self, turn: Turn) -> Turn:
        for r in self.waiting:
            turn.take(r)
        self.waiting = []
        return turn

    def _before_all(self, at: int) -> Turn:
        """The turn of rows before the first prompt."""
        if self.head is None:
            self.names["head"] += 1
            self.head = Turn("head", at)
            self.turns.insert(0, self.head)
        return self.head

    def _open(self, p: Prompt) -> Turn:
        self.names[p.name] += 1
        n = self.names[p.name]
        turn = Turn(p.name if n == 1 else f"{p.name}#{n}", p.at, p.kind)
        self.turns.append(turn)
        return self._settle(turn)

    def _named(self, ids) -> Turn | None:
        return next((self.by_prompt[i] for i in ids if i in self.by_prompt), None)

    def _prompt(self, p: Prompt) -> None:
        twin = self.stamps.get(p.stamp) if p.stamp else None
        if twin:
            turn, p.copy_of = twin.turn, twin
        elif p.opens:
            turn = self.by_prompt.get(p.ids[0]) if p.ids else None
            if turn is None or turn.key != p.name:
                turn = self._open(p)
            if turn.opened:
                p.copy_of = turn.prompts[0]
            else:
                turn.opened, turn.counted = True, turn.counted + 1
        else:
            turn = self._named(p.ids)
            if turn is None and p.kind != "interrupted":
                turn = next((t for t in reversed(self.turns) if t.answered), None)
            turn = turn or (self.turns[-1] if self.turns else self._open(p))
            turn.counted += 1
        turn.prompts.append(p)
        p.turn = turn
        for i in p.ids:
            self.by_prompt.setdefault(i, turn)
        if p.stamp:
            self.stamps.setdefault(p.stamp, p)
        turn.touch(p.at)
        if p.kind == "interrupted":
            turn.interrupted = p.at

    def _row(self, r: Row) -> None:
        turn = self._named([r.prompt]) if r.prompt else None
        turn = turn or (self.turns[-1] if self.turns else None)
        if turn is None:
            if r.type in MARKERS:
                self.waiting.append(r)
                return
            turn = self._settle(self._before_all(r.at))
        turn.take(r)
        turn.answered |= r.type == "assistant_turn" and r.text

    def spawner(self, first: Row) -> Turn | None:
        """The turn that a subagent with this first row belongs to."""
        if first.prompt in self.by_prompt:
            return self.by_prompt[first.prompt]
        return next((t for t in reversed(self.turns) if t.at <= first.at), None)


def _twin_of_answer(h: Row, answers: list[Row]) -> Row | None:
    scripts = [a for a in answers if a.origin == "transcript"]
    if h.message:
        options = [a for a in scripts if a.message == h.message]
    elif h.text:
        options = [a for a in scripts if a.text and a.hash == h.hash and abs(a.at - h.at) <= TWIN]
    else:
        options = [] if h.usage else scripts
    return min(options, key=lambda a: abs(a.at - h.at), default=None)


def _tools(rows: list[Row], counted: str, roles: dict[str, str]) -> int:
    """How many of a type there were: of the two captures the larger count.  Transcript rows with a hook twin, by id or else by place, are superseded."""
    hooks, scripts = [r for r in rows if r.hook], [r for r in rows if not r.hook]
    by_id = defaultdict(list)
    for s in reversed(scripts):
        by_id[s.tool].append(s)
    taken, single = set(), []
    for h in hooks:
        if h.tool and by_id[h.tool]:
            taken.add(by_id[h.tool].pop().id)
        else:
            single.append(h)
    free = [s.id for s in scripts if s.id not in taken]
    roles.update(dict.fromkeys([*taken, *free[: len(single)]], "superseded"))
    return max(sum(r.type == counted for r in hooks), sum(r.type == counted for r in scripts))


def closed(turn: Turn, last: bool, ended: bool) -> tuple[dict, dict[str, str], dict[str, str]]:
    """A turn's values, each event's role, and the event that stands for a superseded one."""
    roles: dict[str, str] = {}
    instead: dict[str, str] = {}
    merged, prompt_event = 0, None
    for i, p in enumerate(turn.prompts):
        leader = p.copy_of.head if p.copy_of else p.head
        for r in p.rows:
            if p.copy_of is None and r is p.head:
                roles[r.id] = "prompt" if i == 0 and p.opens else "work"
                prompt_event = r.id if roles[r.id] == "prompt" else prompt_event
            else:
                roles[r.id] = "superseded"
                merged += p.copy_of is not None or r.hook
                if r.hook:
                    instead[r.id] = leader.id
    roles.update((r.id, "work") for r in turn.work)
    answers = [r for r in turn.work if r.type == "assistant_turn"]
    for h in answers:
        twin = _twin_of_answer(h, answers) if h.hook else None
        if twin:
            roles[h.id], instead[h.id] = "superseded", twin.id
            merged += 1
    left = [a for a in answers if roles[a.id] != "superseded"]
    final = max((a for a in left if a.text), key=_order, default=None)
    if final:
        roles[final.id] = "final"
    tools = _tools([r for r in turn.work if r.type == "tool_call"], "tool_call", roles)
    errors = _tools([r for r in turn.work if r.type in ("tool_result", "tool_failed")], "tool_failed", roles)
    rows = sorted([r for p in turn.prompts for r in p.rows] + turn.work, key=_order)
    live = [r for r in rows if r.at >= turn.at]
    first = next((r.at for r in live if r.type != "user_prompt" and roles[r.id] != "superseded"), None)
    active = sum((b.at - a.at) // 1000 for a, b in zip(live, live[1:], strict=False) if b.at - a.at <= ACTIVE)
    end = turn.at if turn.last is None else turn.last
    wall = max((end - turn.at) // 1000, 0)
    if turn.interrupted is not None and (final is None or turn.interrupted > final.at):
        outcome = "interrupted"
    elif final:
        outcome = "answered"
    elif last and not ended:
        outcome = "in_progress"
    else:
        outcome = "no_answer_captured" if turn.work else "no_work"
    values = {
        "key": turn.key,
        "started_at": turn.at,
        "last_activity_at": end,
        "prompt_id": next((p.ids[0] for p in turn.prompts if p.ids), ""),
        "kind": turn.kind,
        "prompts": turn.counted,
        "answers": len(left),
        "tools": tools,
        "errors": errors,
        "files": sum(r.type == "file_changed" for r in turn.work),
        "merged": merged,
        "prompt_event_id": prompt_event,
        "final_event_id": final.id if final else None,
        "first_activity_at": first,
        "answered_at": final.at if final else None,
        "active_ms": active,
        "wall_ms": wall,
        "idle_ms": max(wall - active, 0),
        "waiting_ms": None,
        "subagents": turn.subagents,
        "origins": ",".join(sorted({r.origin for r in rows})),
        "outcome": outcome,
    }
    return values, {r.id: roles[r.id] for r in rows}, instead


def fold_session(rows: list[tuple[str | None, Row]]) -> tuple[list[dict], list[dict]]:
    """Turns of one session, and the role of each event; rows: (agent_id, row)."""
    threads: dict[str, list[Row]] = defaultdict(list)
    for agent, r in rows:
        threads[thread_of(agent)].append(r)
    ended = any(r.type == "session_ended" for _, r in rows)
    folded: list[tuple[Thread, list[Row]]] = []
    for members in threads.values():
        members.sort(key=_order)
    for name in sorted(threads, key=lambda t: (t != "", threads[t][0].at, t)):
        folded.append((Thread(name, threads[name], ended), threads[name]))
    main = folded[0][0] if folded and folded[0][0].name == "" else None
    for thread, members in folded:
        parent = main.spawner(members[0]) if main and thread is not main else None
        if parent:
            parent.subagents += 1
    turns, events = [], []
    for thread, _ in folded:
        done = [closed(t, i + 1 == len(thread.turns), thread.ended) for i, t in enumerate(thread.turns)]
        for i, (values, roles, instead) in enumerate(done):
            if i + 1 < len(done):
                gap = (done[i + 1][0]["started_at"] - values["last_activity_at"]) // 1000
                values["waiting_ms"] = gap if gap > 0 else None
            turns.append({"thread": thread.name, "turn_index": i, **values})
            events += [{"thread": thread.name, "turn_index": i, "event_id": e, "role": role, "superseded_by": instead.get(e)} for e, role in roles.items()]
    return turns, events


def _sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
    """Rows of one session after the other; the rows of a session adjoin."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(c).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist() if c == "occurred_at" else batch.column(c).to_pylist() for c in _FIELDS]
        for session, agent, *values in zip(batch.column("session_id").to_pylist(), batch.column("agent_id").to_pylist(), *columns, strict=True):
            if session != now:
                if rows:
                    yield now, rows
                now, rows = session, []
            at, seq, id_, *texts = values
            rows.append((agent, Row(at, seq, str(id_), *[x if type(x) is bool else x or "" for x in texts])))
    if rows:
        yield now, rows


def _folded(events: DataFrame, schema: str, which: int) -> DataFrame:
    names = [(c.split()[0], c.split()[1]) for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "timestamp_ntz": pa.timestamp("us")}
        out: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_moment(r[n]) if k == "timestamp_ntz" else r[n] for r in out], kinds[k]) for n, k in names], names=[n for n, _ in names])

        for session, rows in _sessions(batches):
            out += [{"session_id": session, **x} for x in fold_session(rows)[which]]
            if len(out) > 5000:
                yield batch()
                out = []
        yield batch()

    rows = events.select("session_id", "agent_id", *_FIELDS).repartition("session_id").sortWithinPartitions("session_id")
    rows = rows.withColumns({"has_text": F.coalesce("has_text", F.lit(False)), "has_usage": F.coalesce("has_usage", F.lit(False)), "occurred_at": F.col("occurred_at").cast("timestamp_ntz")})
    return rows.mapInArrow(run, schema)


def _moment(value: int | None) -> datetime | None:
    return None if value is None else datetime(1970, 1, 1) + timedelta(microseconds=value)


def turns(events: DataFrame) -> DataFrame:
    """Turns of every session."""
    return _folded(events, TURN, 0)


def turn_events(events: DataFrame) -> DataFrame:
    """The turn and role (prompt, final, work, superseded) of every event, and the event that stands for a superseded one."""
    return _folded(events, EVENT, 1)
