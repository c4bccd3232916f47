"""Operator 9: chat formatting with role repair of least cost.

A conversation is legal if it begins with at most one system turn and then alternates user, assistant, user
and so on, in the end after either. Repair keeps all texts in order and chooses for each turn: keep its
role, take another role (relabel), join the turn before it (merge), and before any turn insert an empty one.
The choice of least total cost is found by dynamic programming over the automaton: a turn's role decides a
fixed table of costs from state to state, so a run of turns is the min-plus product of their tables. That
lets a long conversation lie over many partitions: each gives the table of its piece, the pieces are
stitched, and each then finds its own best path between its first and last state.

Texts can be had back from the rows, one a turn: "<|" in them is written with a second bar. In the joined text
merged turns stand two line breaks apart, as a text's own paragraphs may.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: States: nothing yet, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant", "developer": "system"}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of the repairs; a turn whose role is unknown takes any role for RELABEL_UNKNOWN.
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 3, 1, 4
BEGIN, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"


def role_state(role: str | None) -> int:
    """The state of a role's name, START if it is not known."""
    name = (role or "").strip().lower()
    return ROLES.get(ALIASES.get(name, name), START)


def _step(state: int, role: int) -> dict[int, tuple[int, str, tuple[int, ...]]]:
    """For a turn of a role in a state: next state -> (cost, action, roles of inserted turns), the least of each."""
    out: dict[int, tuple[int, str, tuple[int, ...]]] = {}

    def offer(to: int, cost: int, action: str, inserted: tuple[int, ...]) -> None:
        if to not in out or cost < out[to][0]:
            out[to] = (cost, action, inserted)

    ways = [((), state)] + [((a,), a) for a in LEGAL[state]] + [((a, b), b) for a in LEGAL[state] for b in LEGAL[a]]
    for inserted, at in ways:
        for to in LEGAL[at]:
            change = 0 if to == role else RELABEL_UNKNOWN if role == START else RELABEL
            offer(to, INSERT * len(inserted) + change, "relabel" if change else "keep", inserted)
    if state != START:
        change = 0 if role == state else RELABEL_UNKNOWN if role == START else RELABEL
        offer(state, MERGE + change, "merge", ())
    return out


STEPS = {(s, r): _step(s, r) for s in range(4) for r in range(4)}
COSTS = np.full((4, 4, 4), np.inf)  # role, from, to
for (_s, _r), _ways in STEPS.items():
    for _t, (_cost, _, _) in _ways.items():
        COSTS[_r, _s, _t] = _cost


def product(roles: list[int]) -> np.ndarray:
    """Least costs from state to state over a run of turns."""
    total = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        total = (total[:, :, None] + COSTS[r][None]).min(axis=1)
    return total


def best_path(roles: list[int], first: int, last: int | None) -> list[int]:
    """States after each turn of a least-cost path from first (to last, if given); of equals the lowest states from the end."""
    ahead = [np.where(np.arange(4) == first, 0.0, np.inf)]
    for r in roles:
        ahead.append((ahead[-1][:, None] + COSTS[r]).min(axis=0))
    state = int(np.argmin(ahead[-1])) if last is None else last
    path = [state]
    for k in range(len(roles) - 1, 0, -1):
        state = int(np.argmin(ahead[k] + COSTS[roles[k]][:, state]))
        path.append(state)
    return path[::-1]


def escaped(text: str) -> str:
    """A text in which no marker begins: every "<|" has a second bar."""
    return text.replace("<|", "<||")


def unescaped(text: str) -> str:
    """The text that escaped() was given."""
    return text.replace("<||", "<|")


def stitch(pieces: list[tuple]) -> dict[int, tuple[int, int]]:
    """piece -> (first, last state), of rows (conv_id, piece, table) that are whole conversations in pieces."""
    out = {}
    for _, run in groupby(sorted(pieces, key=lambda p: (p[0] is not None, p[0], p[1])), key=lambda p: p[0]):
        run = list(run)
        ahead = [np.where(np.arange(4) == START, 0.0, np.inf)]
        for _, _, table in run:
            ahead.append((ahead[-1][:, None] + np.array(table).reshape(4, 4)).min(axis=0))
        state = int(np.argmin(ahead[-1]))
        for k in range(len(run) - 1, -1, -1):
            table = np.array(run[k][2]).reshape(4, 4)
            before = int(np.argmin(ahead[k] + table[:, state]))
            out[run[k][1]] = (before, state)
            state = before
    return out


SCHEMA = "pos long, conv_id long, turn long, role string, action string, inserted array<string>, cost int, rendered string"


def format_chats(turns: DataFrame) -> DataFrame:
    """A row per row of turns(conv_id, turn, role, text), repaired and rendered; other columns are ignored.

    pos orders the rows of a conversation (by turn, nulls first, then role and text), role is the role
    after repair, action is keep, relabel or merge, inserted the roles of empty turns put before it, cost
    its share of the least cost. rendered is the turn's part of the conversation's text: joined in order of
    pos the parts give it whole. A null text is empty, an unknown or null role takes the cheapest role,
    a null conv_id is a conversation of its own. A piece of text that would begin a control token is broken.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", "turn", "role", "text", "row"]  # dealt and sorted alike, so ties too fall the same way over any partitions
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = written(ordered.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"), "turns")
    part = F.shiftrightunsigned("pos", 33)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, (first, last) in _ends(batches):
            found = [(c, piece * 2 + k, product(r).ravel().tolist()) for k, (c, r) in enumerate((first, last)) if r]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "piece", "costs"])

    roles = ordered.select("pos", "conv_id", "role").repartition(part).sortWithinPartitions("pos")
    ends = roles.mapInArrow(tables, "conv_id long, piece long, costs array<double>").collect()  # two rows a partition at most
    last_piece = {r.conv_id: r.piece for r in sorted(ends, key=lambda r: r.piece)}
    known = spark.sparkContext.broadcast((stitch([tuple(r) for r in ends]), last_piece))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, final = known.value
        out = []
        for piece, conv, held, is_first, is_last in _conversations(batches):
            name, at_end = piece * 2 + (not is_first), is_first or is_last
            first, last = states[name] if at_end else (START, None)
            run = [role_state(r[3]) for r in held]
            before = first
            for n, (row, role, state) in enumerate(zip(held, run, best_path(run, first, last), strict=True)):
                cost, action, inserted = STEPS[before, role][state]
                done = n == len(held) - 1 and (not at_end or final[conv] == name)
                text = (END + BREAK if before != START and action != "merge" else "") + "".join(f"{BEGIN}{NAMES[i]}\n{END}{BREAK}" for i in inserted)
                text += ("\n\n" if action == "merge" else f"{BEGIN}{NAMES[state]}\n") + escaped(row[4] or "") + (END + BREAK if done else "")
                out.append((row[0], conv, row[2], NAMES[state], action, [NAMES[i] for i in inserted], cost, text))
                before = state
                if len(out) >= 4096:
                    yield _rendered(out)
                    out = []
        if out:
            yield _rendered(out)

    whole = ordered.select("pos", "conv_id", "turn", "role", "text").repartition(part).sortWithinPartitions("pos")
    return whole.mapInArrow(render, SCHEMA)


def _rendered(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(partition, ((conv_id, roles) of its first conversation, of its last if another)) of each partition in a task's rows."""
    rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
    for piece, held in groupby(rows, key=lambda r: r[0] >> 33):
        first, last = None, (None, [])
        for conv, run in groupby(held, key=lambda r: r[1]):
            last = (conv, [role_state(r[2]) for r in run])
            first = first or last
        yield piece, (first, last if first is not last else (None, []))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(partition, conv_id, rows, is its first, is its last) of each conversation; no more than two are held."""
    rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
    ready, piece_before = None, None
    for (piece, conv), run in groupby(rows, key=lambda r: (r[0] >> 33, r[1])):
        if ready:
            yield *ready, ready[0] != piece
        ready, piece_before = (piece, conv, list(run), piece != piece_before), piece
    if ready:
        yield *ready, True
