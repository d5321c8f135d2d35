"""Chat formatting with minimum-cost role repair.

A conversation is legal when it starts with an optional system message, then
alternates user and assistant, and ends with the assistant.  Every turn is
either emitted (under its own role, or relabelled, after empty messages that
make the step legal) or merged into the message before it.  Dynamic programming
over the automaton finds the cheapest repair, and the result is rendered.

Plan
----
1. Turns are range-partitioned by conversation and turn and sorted once
   (reliable checkpoint), so a conversation of any length spreads over tasks.
2. Costs compose: a run of turns is a min-plus matrix over the four states.
   Tasks report the matrices of their first and last conversation only, the
   driver folds at most two of them a partition into the costs with which each
   run starts.
3. Where conversations cross partitions, tasks report how the final states of
   their run lead back to its first; the driver follows that chain backwards.
4. Tasks then repair and render their turns on their own.  A merged text is a
   continuation piece: joining the pieces of a conversation in order gives its
   rendering, so no task holds a whole conversation.

Of equally cheap repairs the one is taken whose last state comes first in
``STATES``, then the state before, and so on; in a step, emitting goes before
merging.  The result does not depend on the partitions.

Defined results: null roles and unknown names may be relabelled cheaply; a
null text counts as empty.  Repeated turns are turns of their own.  Only the four
named columns are read, so others, whatever their names, play no part; an empty
table gives an empty result.  Rows with a null conversation id form one
conversation.  Turns with equal numbers are ordered by role, then text; null
numbers come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ruleframe.llm.common import BATCH_BYTES, checkpointed, mapped, partitions_for

ROLES = ("system", "user", "assistant")
#: The automaton's states: before the first message, or the last message's role.
STATES = ("start", *ROLES)
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ALIASES = {"human": "user", "customer": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "developer": "system"}

RELABEL, RELABEL_UNKNOWN, INSERT = 3, 1, 2
MERGE_SAME, MERGE_OTHER, MERGE_UNKNOWN = 1, 4, 2
NEVER = 1 << 40
#: Text of a partition, on average.
PART_BYTES = 32 << 20


def role_of(name: str | None) -> str | None:
    """The known role behind a name, or None."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def _inserts(before: str, to: str) -> tuple[str, ...] | None:
    """Fewest empty messages that make a step to ``to`` legal."""
    paths: list[tuple[str, tuple[str, ...]]] = [(before, ())]
    for at, path in paths:
        if to in LEGAL[at]:
            return path
        if len(path) < 3:
            paths += [(n, (*path, n)) for n in LEGAL[at] if n != "system"]
    return None


INSERTS = {(p, q): _inserts(p, q) for p in STATES for q in ROLES}
#: Empty messages that end a conversation legally.
CLOSING = {"start": (), "system": ("user", "assistant"), "user": ("assistant",), "assistant": ()}


def step(role: str | None, before: str, after: str) -> tuple[int, str] | None:
    """Cost and action of a turn that leads from one state to another."""
    options = []
    empty = INSERTS.get((before, after))
    if empty is not None:
        change = 0 if role == after else RELABEL_UNKNOWN if role is None else RELABEL
        options.append((change + INSERT * len(empty), 0, "keep" if role == after else "relabel"))
    if before == after:
        options.append((MERGE_SAME if role == before else MERGE_UNKNOWN if role is None else MERGE_OTHER, 1, "merge"))
    return (min(options)[0], min(options)[2]) if options else None


def _matrix(role: str | None) -> np.ndarray:
    out = np.full((4, 4), NEVER, dtype=np.int64)
    for i, p in enumerate(STATES):
        for j, q in enumerate(STATES):
            done = step(role, p, q) if q != "start" else None
            if done:
                out[i, j] = done[0]
    return out


MATRIX = {r: _matrix(r) for r in (*ROLES, None)}
CLOSE = np.array([INSERT * len(CLOSING[s]) for s in STATES], dtype=np.int64)
START = np.array([0, NEVER, NEVER, NEVER], dtype=np.int64)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, None] + b[None, :, :]).min(axis=-2), NEVER)


def forward(costs: np.ndarray, roles: list[str | None]) -> list[np.ndarray]:
    """Least costs of each state before every turn, and after the last."""
    out = [costs]
    for r in roles:
        out.append(np.minimum((out[-1][:, None] + MATRIX[r]).min(axis=0), NEVER))
    return out


def backward(costs: list[np.ndarray], roles: list[str | None], last: int) -> list[int]:
    """States before every turn and after the last, first ones on ties."""
    path = [last]
    for i in range(len(roles) - 1, -1, -1):
        path.append(int(np.argmin(costs[i] + MATRIX[roles[i]][:, path[-1]])))
    return path[::-1]


def final_state(costs: np.ndarray) -> int:
    return int(np.argmin(costs + CLOSE))


def render_turn(text: str | None, before: str, after: str, action: str, last: bool) -> str:
    text = text or ""
    if action == "merge":
        out = "\n" + text
    else:
        end = "" if before == "start" else "<|end|>\n"
        out = end + "".join(f"<|{r}|>\n<|end|>\n" for r in INSERTS[before, after]) + f"<|{after}|>\n{text}"
    if last:
        out += "<|end|>\n" + "".join(f"<|{r}|>\n<|end|>\n" for r in CLOSING[after])
    return out


def _runs(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive turns of one conversation in this partition."""
    key, rows = None, []
    for batch in source:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _edges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of the first and the last run; 4 x 4 longs each."""
    part, ends = TaskContext.get().partitionId(), []
    for key, rows in _runs(source):
        m = None
        for r in rows:
            m = MATRIX[role_of(r[2])] if m is None else compose(m, MATRIX[role_of(r[2])])
        ends = [*ends[:1], (None if key is None else str(key), m)]
    for i, (key, m) in enumerate(ends):
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": pa.array([i if len(ends) > 1 else 2], pa.int32()), "conv": pa.array([key], pa.string()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.int64()))})


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations as text: ``<conv_id>, part, text``.

    A conversation has one part for each partition that holds some of its turns
    (one, unless it crosses a boundary); its parts joined in their order are its
    rendering, so one of any length is never in one row.
    """
    return repair(turns, conv_id, turn, role, text, rendered=True)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rendered: bool = False) -> DataFrame:
    """One row per turn: ids, ``action``, ``role``, ``inserted``, ``cost``, ``piece``.

    ``inserted`` counts empty messages before the turn (after it as well for
    the last turn of a conversation, ``is_last``).  ``rendered`` gives what
    ``render`` says instead.
    """
    spark = turns.sparkSession
    source = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    # A run of one conversation is held in memory, so partitions have a bound.
    size = source.agg(F.sum(F.coalesce(F.octet_length("x"), F.lit(0)) + F.lit(32)).alias("n")).first().n or 0
    parts = max(partitions_for(spark), int(size) // PART_BYTES + 1)
    ordered = source.repartitionByRange(parts, "c", "t", "r", F.xxhash64("x")).sortWithinPartitions("c", "t", "r", "x")
    ordered = checkpointed(ordered)
    edges = ordered.transform(mapped, _edges, "part int, run int, conv string, m array<bigint>").collect()
    # Runs at the ends of partitions in order; run 2 stands for a partition with one run.
    segments = sorted(((e.part, e.run, e.conv, np.array(e.m).reshape(4, 4)) for e in edges), key=lambda e: (e[0], e[1]))
    incoming: dict[tuple[int, int], np.ndarray] = {}
    chain: list[list[tuple[int, int]]] = []
    before = None
    for part, run, conv, m in segments:
        joins = before is not None and before[0] != part and before[2] == conv
        costs = np.minimum((incoming[before[:2]][:, None] + before[3]).min(axis=0), NEVER) if joins else START
        incoming[part, run] = costs
        if joins:
            chain[-1].append((part, run))
        else:
            chain.append([(part, run)])
        before = (part, run, conv, m)
    matrices = {(p, r): m for p, r, _, m in segments}
    crossing = [c for c in chain if len(c) > 1]
    goal: dict[tuple[int, int], int] = {}
    if crossing:
        leads = _lead_back(ordered, incoming)
        for c in crossing:
            state = final_state(np.minimum((incoming[c[-1]][:, None] + matrices[c[-1]]).min(axis=0), NEVER))
            for at in reversed(c):
                goal[at] = state
                state = leads[at][state]
    ends = {c[-1] for c in crossing}
    shared = spark.sparkContext.broadcast((incoming, goal, ends))
    id_kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in (conv_id, turn))
    schema = f"`{conv_id}` {id_kind}, part bigint, text string" if rendered else f"`{conv_id}` {id_kind}, `{turn}` {turn_kind}, action string, role string, inserted int, cost bigint, is_last boolean, piece string"

    def batch(rows: list[tuple], types: tuple) -> pa.RecordBatch:
        if rendered:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((types[0], pa.int64(), pa.string()))], names=[conv_id, "part", "text"])
        return _batch(rows, types, conv_id, turn)

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, goals, last_parts = shared.value
        part, types, out, number, held = TaskContext.get().partitionId(), None, [], 0, 0
        runs = _numbered(_runs(_typed(source, kinds := [])))
        for place, rows in runs:
            types = kinds[0]
            roles = [role_of(r[2]) for r in rows]
            costs = forward(starts.get((part, place), START), roles)
            at = goals.get((part, place))
            ends_here = at is None or (part, place) in last_parts
            path = backward(costs, roles, final_state(costs[-1]) if at is None else at)
            pieces = []
            for i, r in enumerate(rows):
                p, q = STATES[path[i]], STATES[path[i + 1]]
                cost, action = step(roles[i], p, q)
                last = ends_here and i == len(rows) - 1
                extra = len(CLOSING[q]) if last else 0
                inserted = (0 if action == "merge" else len(INSERTS[p, q])) + extra
                piece = render_turn(r[3], p, q, action, last)
                if rendered:
                    pieces.append(piece)
                else:
                    out.append((r[0], r[1], action, q, inserted, cost + INSERT * extra, last, piece))
            if rendered:
                out.append((rows[0][0], (part << 32) + number, "".join(pieces)))
                number += 1
            held += sum(len(r[3] or "") for r in rows)
            if len(out) > 2000 or held > BATCH_BYTES:
                yield batch(out, types)
                out, held = [], 0
        if out:
            yield batch(out, types)

    return ordered.transform(mapped, write, schema)


def _typed(source: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    for batch in source:
        if not kinds:
            kinds.append((batch.schema.field(0).type, batch.schema.field(1).type))
        yield batch


def _numbered(runs: Iterator[tuple[object, list[tuple]]]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs with their place: 0 first, 1 last, 2 the only one, 3 any other."""
    held, first = None, True
    for _, rows in runs:
        if held is not None:
            yield 0 if first else 3, held
            first = False
        held = rows
    if held is not None:
        yield 2 if first else 1, held


def _lead_back(ordered: DataFrame, incoming: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], list[int]]:
    """For the end runs of each partition: first state by final state."""
    shared = ordered.sparkSession.sparkContext.broadcast(incoming)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for place, rows in _numbered(_runs(source)):
            if place == 3:
                continue
            roles = [role_of(r[2]) for r in rows]
            costs = forward(shared.value[part, place], roles)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": pa.array([place], pa.int32()), "lead": pa.array([[backward(costs, roles, s)[0] for s in range(4)]], pa.list_(pa.int32()))})

    return {(r.part, r.run): list(r.lead) for r in ordered.transform(mapped, run, "part int, run int, lead array<int>").collect()}


def _batch(rows: list[tuple], types: tuple, conv_id: str, turn: str) -> pa.RecordBatch:
    kinds = (*types, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[conv_id, turn, "action", "role", "inserted", "cost", "is_last", "piece"])
