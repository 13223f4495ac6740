"""Chat formatting: minimum-cost role repair of conversations, then rendering.

A legal sequence is an optional system turn, then user and assistant in turn, and ends with the assistant. Each turn, in
order, is emitted or merged into the output turn before it, with its own role or a relabelled one, and empty turns may
be inserted before it or at the end. The cheapest repair is a shortest path over the states start, after system, after
user, after assistant; ties go to the first choice in the order keep, merge, relabel, merge with relabel, without
inserting before inserting, and system, user, assistant.

A step is a 4 x 4 table of costs, and tables of consecutive turns combine by (min, +). Turns are range-partitioned by
conversation and turn, so a conversation of any length is a few fragments in neighbouring partitions. A first pass gives the
table of the first and the last fragment of every partition; the driver combines those, two small rows a partition, into
the states in which fragments begin and end; a second pass repairs and renders each fragment. So one conversation with a
third of all rows is repaired in as many tasks as its rows fill, and the result is one row per turn or insertion, in the
order (place, piece), whose ``rendered`` strings concatenate to the text of the conversation.

Defined results: turns of equal number are ordered by a hash of role and text, null turns come first; a null or unknown role must
be relabelled; a null text is empty; rows with a null conv_id are one conversation; repeated rows are turns of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, NAME, INSERT = 1, 3, 2, 4  # NAME: giving a role to a turn without a known one
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATE_OF = {"system": _SYSTEM, "user": _USER, "assistant": _ASSISTANT}
_FAR = 1 << 40
_ENDS = {_START: (0, ()), _SYSTEM: (2 * INSERT, ("user", "assistant")), _USER: (INSERT, ("assistant",)), _ASSISTANT: (0, ())}


def _needed(state: int, role: str) -> tuple[str, ...] | None:
    """Empty turns that make ``role`` legal after ``state``; None where nothing does."""
    if role == "system":
        return () if state == _START else None
    if role == "user":
        return ("assistant",) if state == _USER else ()
    return () if state == _USER else ("user",)


def _choices(role: str | None) -> list[list[tuple[int, int, str, bool, tuple[str, ...]]]]:
    """For each state: (cost, next state, role given, merged, inserted roles), in the order of preference."""
    found = []
    for state in range(4):
        own = []
        for given in ROLES:
            change = 0 if given == role else RELABEL if role in ROLES else NAME
            inserted = _needed(state, given)
            if inserted is not None:
                own.append((change + INSERT * len(inserted), _STATE_OF[given], given, False, inserted))
            if state == _STATE_OF[given]:
                own.append((change + MERGE, _STATE_OF[given], given, True, ()))
        own.sort(key=lambda c: (c[0], len(c[4]), c[2] != role, c[3], ROLES.index(c[2])))
        found.append(own)
    return found


_CHOICES = {role: _choices(role) for role in (*ROLES, None)}
_TABLES: dict[str | None, np.ndarray] = {}
for _role, _by_state in _CHOICES.items():
    _TABLES[_role] = np.full((4, 4), _FAR, np.int64)
    for _from, _own in enumerate(_by_state):
        for _cost, _to, *_rest in _own:
            _TABLES[_role][_from, _to] = min(_TABLES[_role][_from, _to], _cost)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product of two tables."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def repair(roles: list[str | None], entry: int = _START, leave: int | None = None) -> list[tuple[str, bool, tuple[str, ...]]]:
    """(role given, merged, inserted before) of each turn on the cheapest path; to state ``leave``, or to a legal end."""
    cost = [_FAR] * 4
    cost[entry] = 0
    steps = []
    for role in roles:
        following, step = [_FAR] * 4, [None] * 4
        for state in range(4):
            if cost[state] < _FAR:
                for choice in _CHOICES[_known(role)][state]:
                    if cost[state] + choice[0] < following[choice[1]]:
                        following[choice[1]], step[choice[1]] = cost[state] + choice[0], (state, choice)
        cost = following
        steps.append(step)
    state = leave if leave is not None else min(range(4), key=lambda s: cost[s] + _ENDS[s][0])
    made = []
    for step in reversed(steps):
        state, choice = step[state]
        made.append(choice[2:])
    return made[::-1]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one conversation."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["conv"] != row["conv"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Table of the first and of the last fragment of each partition."""
    first = last = None
    for rows in _fragments(batches):
        table = _TABLES[_known(rows[0]["role"])]
        for row in rows[1:]:
            table = combine(table, _TABLES[_known(row["role"])])
        last = (rows[0]["part"], rows[0]["conv"], len(rows), table.ravel().tolist())
        first = first or last
    found = [] if first is None else [first] if first is last else [first, last]
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
         pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.int64()))],
        names=["part", "conv", "turns", "cost"],
    )


def join_fragments(found: list[tuple[int, int | None, int, list[int]]]) -> dict[tuple[int, int | None], tuple[int, int, int, bool]]:
    """(part, conv) -> (entry, exit, place of the first turn, whether it is the last) of conversations in several partitions."""
    by_conv: dict[int | None, list] = {}
    for part, conv, turns, cost in found:
        by_conv.setdefault(conv, []).append((part, turns, np.array(cost).reshape(4, 4)))
    joined = {}
    for conv, pieces in by_conv.items():
        if len(pieces) < 2:
            continue
        pieces.sort(key=lambda p: p[0])
        cost, back = np.array([0, _FAR, _FAR, _FAR]), []
        for _, _, table in pieces:
            reach = cost[:, None] + table
            back.append(reach.argmin(axis=0))
            cost = np.minimum(reach.min(axis=0), _FAR)
        state = min(range(4), key=lambda s: cost[s] + _ENDS[s][0])
        states = [state]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        states.reverse()
        place = 0
        for i, (part, turns, _) in enumerate(pieces):
            leave = states[i + 1]
            joined[part, conv] = (states[i], leave, place, i == len(pieces) - 1)
            place += turns
    return joined


def _header(role: str, first: bool) -> str:
    return ("" if first else "\n") + f"<|{role}|>\n"


def render(rows: list[dict], entry: int, leave: int | None, place: int, closes: bool) -> Iterator[tuple]:
    """(conv, place, piece, turn, role, given, action, rendered) of a fragment."""
    begun = entry != _START
    state = entry
    for i, (row, (given, merged, inserted)) in enumerate(zip(rows, repair([r["role"] for r in rows], entry, leave), strict=True)):
        conv, at = row["conv"], place + i
        for n, role in enumerate(inserted):
            yield conv, at, n, None, None, role, "insert", _header(role, not begun)
            begun = True
        action = ("merge" if merged else "keep") if given == row["role"] else ("merge_relabel" if merged else "relabel")
        head = "\n\n" if merged else _header(given, not begun)
        yield conv, at, 2, row["turn"], row["role"], given, action, head + (row["text"] or "")
        begun, state = True, _STATE_OF[given]
    if closes:
        for n, role in enumerate(_ENDS[state][1]):
            yield rows[0]["conv"], place + len(rows), n, None, None, role, "insert", _header(role, False)


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, place, piece, turn, role, given, action, rendered): a row per turn and per inserted turn."""
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    # equal rows are interchangeable; their place in the input tells them apart, so that a range can end among them
    placed = rows.withColumns({"_hash": F.xxhash64("role", "text"), "_row": F.monotonically_increasing_id()})
    order = ["conv", "turn", "_hash", "role", "_row"]
    fixed = materialize(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_hash", "_row").withColumn("part", F.spark_partition_id())
    )
    found = fixed.select("part", "conv", "role").mapInArrow(_tables, "part int, conv bigint, turns bigint, cost array<bigint>")
    joined = join_fragments([tuple(r) for r in found.collect()])  # two rows a partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", "place", "piece", "turn", "role", "given", "action", "rendered"]
        pack = lambda h: pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*h, strict=True), kinds, strict=True)], names=names)
        for rows in _fragments(batches):
            entry, leave, place, closes = joined.get((rows[0]["part"], rows[0]["conv"]), (_START, None, 0, True))
            for made in render(rows, entry, leave, place, closes):
                held.append(made)
                if len(held) >= 4096:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return fixed.mapInArrow(
        run, "conv_id bigint, place bigint, piece int, turn bigint, role string, given string, action string, rendered string"
    )
