"""Conversation structure repair: run-length dynamic programming over role and fault symbols.

A repaired conversation is empty, or an optional system turn and then user and assistant in turn, ending with the assistant.
Turns are kept (0), given the role user or assistant (3) or deleted (4; a must for blank and duplicate turns), and
empty turns are inserted anywhere (3); a truncated turn that stays adds 3. The cheapest edits win, ties go to the audit
(initials of the edits in order) that is least in ASCII.

* Equal turns are counted, not sorted: the first stands for all, its copies are deletions. Equal consecutive symbols (role
  initial, fault) are one run. A run of n turns moves the costs of the four states by the (min, +) powers of its
  symbol's table, kept for 1, 2, 4, ... turns, so it takes log n small products. The choices inside are then unrolled.
* Turns are range-partitioned by conversation and turn, without their texts, so a conversation of any length is a few
  fragments. Costs to the end run backwards over fragments, states forwards: passes over the end fragments of each
  partition give a table, then a map of states, and the driver joins those, two small rows a partition each time.
* Texts join the turns that stay by the turn's own key; nothing but the audit string and the digest is gathered per conversation.

Defined results: nulls count as one space, so a null text is blank and a null role is no legal role; rows with a null conv_id
are one conversation; turns of equal number go by role, then by a hash of role and text; repeated rows are duplicates of the
first; conversations left without turns have zeros, an empty audit and no repaired turn; other columns are not read; an
empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, hash_pair, materialize
from .scans import group_starts, join_split, longs, sort_by_range

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = ".!?"
ROLES = ("system", "user", "assistant")
_FAR = 1 << 50
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_GIVEN = (_USER, _USER, _ASSISTANT, _USER)  # the one state that user or assistant leads to
_KEPT = {0: {_START: _SYSTEM}, 1: {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, 2: {_USER: _ASSISTANT}, 3: {}}
_MUST_GO = 8  # symbols 0 to 7: 2 * role class + truncated; role classes: s, u, a, other
_KEY = ["conv", "turn", "role", "h1", "h2"]
Costs = tuple[int, int, int, int]
_AT_END: Costs = (0, 2 * INSERT, INSERT, 0)


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn, in ASCII order; insertions apart."""
    found = [("D", DELETE, state)]
    if symbol != _MUST_GO:
        extra = TRUNCATED * (symbol & 1)
        if state in _KEPT[symbol >> 1]:
            found.append(("K", extra, _KEPT[symbol >> 1][state]))
        found.append(("R", REROLE + extra, _GIVEN[state]))
    return found


def _step(symbol: int) -> np.ndarray:
    """Table of a turn with any insertions before it: cheapest cost from state to state."""
    table = np.full((4, 4), _FAR, np.int64)
    for begin in range(4):
        state, spent = begin, 0
        for _ in range(4):  # states repeat after three insertions
            for _, cost, following in _options(symbol, state):
                table[begin, following] = min(table[begin, following], spent + cost)
            state, spent = _GIVEN[state], spent + INSERT
    return table


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product of two tables."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


@lru_cache(maxsize=9 * 64)
def power(symbol: int, k: int) -> np.ndarray:
    """Table of 2 ** k turns of one symbol."""
    return _step(symbol) if k == 0 else combine(power(symbol, k - 1), power(symbol, k - 1))


def table_of(symbol: int, length: int) -> np.ndarray:
    """Table of a run."""
    made = None
    for k in range(length.bit_length()):
        if length >> k & 1:
            made = power(symbol, k) if made is None else combine(made, power(symbol, k))
    return made


@lru_cache(maxsize=1 << 16)
def advance(symbol: int, length: int, costs: Costs) -> Costs:
    """Costs to the end from before a run, out of those from behind it."""
    now = np.array(costs, np.int64)
    for k in range(length.bit_length()):
        if length >> k & 1:
            now = np.minimum((power(symbol, k) + now[None, :]).min(axis=1), _FAR)
    return tuple(int(c) for c in now)


def _inside(symbol: int, length: int, costs: Costs) -> np.ndarray:
    """Costs to the end behind the last, the last but one, ... turn of a run: length + 1 rows, by doubling."""
    made = np.array([costs], np.int64)
    k = 0
    while len(made) <= length:
        shifted = np.minimum((power(symbol, k)[None, :, :] + made[:, None, :]).min(axis=2), _FAR)
        made = np.concatenate([made, shifted])
        k += 1
    return made[: length + 1]


def _choice(symbol: int, state: int, before: list[int], behind: list[int]) -> tuple[str, int]:
    """The least of the cheapest edits in a state, in the order D, I, K, R, and the state that it leads to."""
    for name, cost, following in _options(symbol, state):
        if name > "I" and INSERT + before[_GIVEN[state]] == before[state]:
            break
        if cost + behind[following] == before[state]:
            return name, following
    return "I", _GIVEN[state]


def _unroll(symbol: int, length: int, costs: Costs, state: int) -> tuple[list[str], list[int], int]:
    """Edits of each turn of a run (insertions before it included), the state before each, and the state behind the run."""
    if symbol == _MUST_GO:  # D is least and insertions can wait
        return ["D"] * length, [state] * length, state
    inside = _inside(symbol, length, costs).tolist()
    edits, states = [], []
    for at in range(length):
        before, behind, edit = inside[length - at], inside[length - at - 1], ""
        states.append(state)
        while edit[-1:] in ("", "I"):
            name, state = _choice(symbol, state, before, behind)
            edit += name
        edits.append(edit)
    return edits, states, state


_short_runs = lru_cache(maxsize=1 << 16)(_unroll)


def unroll(symbol: int, length: int, costs: Costs, state: int) -> tuple[list[str], list[int], int]:
    return _short_runs(symbol, length, costs, state) if length <= 64 else _unroll(symbol, length, costs, state)


def closing(state: int) -> str:
    """Insertions behind the last turn."""
    return "I" * (_AT_END[state] // INSERT)


class Fragment(NamedTuple):
    """Consecutive turns of one conversation in one partition: their runs and where each begins."""

    part: int
    conv: int | None
    symbols: list[int]
    lengths: list[int]


def runs_of(symbols: np.ndarray, copies: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of equal symbols; a turn with n copies is itself and n - 1 deletions."""
    spread = np.stack([symbols, np.full_like(symbols, _MUST_GO)], axis=1).ravel()
    lengths = np.stack([np.ones_like(copies), copies - 1], axis=1).ravel()
    spread, lengths = spread[lengths > 0], lengths[lengths > 0]
    starts = np.flatnonzero(np.r_[True, spread[1:] != spread[:-1]])
    return spread[starts].tolist(), np.add.reduceat(lengths, starts).tolist()


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each conversation of a partition, as slices of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = [*group_starts(batch.column(0)).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(starts, starts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != batch.column(0)[a].as_py():
                yield held
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _read(slices: list[pa.RecordBatch]) -> tuple[Fragment, np.ndarray, np.ndarray]:
    symbols = np.concatenate([longs(s.column(2))[0] for s in slices])
    copies = np.concatenate([longs(s.column(3))[0] for s in slices])
    first = slices[0]
    return Fragment(first.column(1)[0].as_py(), first.column(0)[0].as_py(), *runs_of(symbols, copies)), symbols, copies


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[Fragment]:
    """The first and the last fragment of a partition."""
    first = last = None
    for slices in _fragments(batches):
        last = slices
        first = first or last
    if first is not None:
        yield _read(first)[0]
        if last is not first:
            yield _read(last)[0]


def _fragment_table(fragment: Fragment) -> np.ndarray:
    made = None
    for symbol, length in zip(fragment.symbols, fragment.lengths, strict=True):
        own = table_of(symbol, length)
        made = own if made is None else combine(made, own)
    return made


def _costs_behind(fragment: Fragment, costs: Costs) -> list[Costs]:
    """Costs to the end behind each run."""
    found = [costs]
    for symbol, length in zip(reversed(fragment.symbols[1:]), reversed(fragment.lengths[1:]), strict=True):
        found.append(advance(symbol, length, found[-1]))
    return found[::-1]


def _edits(fragment: Fragment, costs: Costs, state: int) -> tuple[list[str], list[int], int]:
    """Edits of each turn and the state before it, and the state behind the fragment."""
    edits, states = [], []
    for symbol, length, behind in zip(fragment.symbols, fragment.lengths, _costs_behind(fragment, costs), strict=True):
        own, before, state = unroll(symbol, length, behind, state)
        edits += own
        states += before
    return edits, states, state


def _pieces(edit: str, state: int) -> Iterator[tuple[int, int | None]]:
    """(piece, given state) of what an edit leaves: a given state for insertions and new roles, None for a kept turn."""
    for piece, name in enumerate(edit):
        if name == "I":
            yield piece, _GIVEN[state]
            state = _GIVEN[state]
        elif name != "D":
            yield piece, _GIVEN[state] if name == "R" else None


class Place(NamedTuple):
    """What a fragment of a conversation in several partitions has to know of the others."""

    state: int
    costs: Costs
    first: bool
    last: bool


_WHOLE = Place(_START, _AT_END, True, True)


def join_fragments(symbols: DataFrame) -> dict[tuple[int, int | None], Place]:
    """(part, conv) -> place, for conversations in several partitions; two small rows a partition reach the driver."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(f.part, f.conv, _fragment_table(f).ravel().tolist()) for f in _ends(batches)]
        yield _rows(found, [pa.int32(), pa.int64(), pa.list_(pa.int64())], ["part", "conv", "cost"])

    pieces: dict[int | None, list[tuple[int, np.ndarray]]] = {}
    for part, conv, cost in symbols.mapInArrow(tables, "part int, conv bigint, cost array<bigint>").collect():
        pieces.setdefault(conv, []).append((part, np.array(cost).reshape(4, 4)))
    behind: dict[tuple[int, int | None], Costs] = {}
    for conv, own in pieces.items():
        if len(own) > 1:
            costs = np.array(_AT_END)
            for part, table in sorted(own, key=lambda p: p[0], reverse=True):
                behind[part, conv] = tuple(int(c) for c in costs)
                costs = np.minimum((table + costs[None, :]).min(axis=1), _FAR)
    if not behind:
        return {}

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(f.part, f.conv, [_edits(f, behind[f.part, f.conv], s)[2] for s in range(4)])
                 for f in _ends(batches) if (f.part, f.conv) in behind]
        yield _rows(found, [pa.int32(), pa.int64(), pa.list_(pa.int64())], ["part", "conv", "state"])

    maps = {(r[0], r[1]): r[2] for r in symbols.mapInArrow(states, "part int, conv bigint, state array<bigint>").collect()}
    places = {}
    for conv, own in pieces.items():
        if len(own) > 1:
            state, parts = _START, sorted(p for p, _ in own)
            for part in parts:
                places[part, conv] = Place(state, behind[part, conv], part == parts[0], part == parts[-1])
                state = maps[part, conv][state]
    return places


def _rows(found: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _role_class(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def faulty_turns(turns: DataFrame) -> DataFrame:
    """Distinct turns (conv, turn, role, h1, h2) with copies, role class, blank, truncated and whether the first is seen earlier."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    h1, h2 = hash_pair(F.col("role"), F.col("text"))
    light = turns.select(
        "conv", "turn", "role", h1.alias("h1"), h2.alias("h2"), (trimmed == "").alias("blank"),
        ((trimmed != "") & ~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("truncated"),
    )
    light = materialize(light.groupBy(*_KEY).agg(
        F.count("*").alias("copies"), F.any_value("blank").alias("blank"), F.any_value("truncated").alias("truncated")))
    same = ["conv", "role", "h1", "h2"]
    firsts = materialize(light.where("NOT blank").groupBy(*same).agg(
        F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    joined = join_split(light, firsts, same, F.col("n"), light.count(), "left")
    seen = F.coalesce(F.struct("turn") > F.col("earliest"), F.lit(False))
    return joined.select(*_KEY, "copies", "blank", "truncated", _role_class(F.col("role")).alias("kind"), seen.alias("seen"))


class Repair(NamedTuple):
    """Results of ``repair_structure``."""

    faults: DataFrame  # conv_id, gaps, blank, duplicate, truncated
    audits: DataFrame  # conv_id, illegal, cost, audit
    turns: DataFrame  # conv_id, part, at, piece, role, text: the repaired turns, in the order (part, at, piece)


def repair_structure(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """Faults, cheapest edits and repaired turns of every conversation that has turns."""
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    found = faulty_turns(rows)
    must_go = F.col("blank") | F.col("seen")
    symbol = F.when(must_go, _MUST_GO).otherwise(2 * F.col("kind") + F.col("truncated").cast("int"))
    fixed = sort_by_range(found.withColumn("symbol", symbol.cast("bigint")), _KEY)
    several = join_fragments(fixed.select("conv", "_part", "symbol", "copies"))
    edges = _edge_pairs(fixed)
    decided = materialize(fixed.select("conv", "_part", "symbol", "copies", "kind", "turn", "role", "h1", "h2").mapInArrow(
        _decide(several, edges), ", ".join(f"{name} {kind}" for name, kind, _ in _DECIDED)))
    pieces = decided.where("audit IS NOT NULL")
    audits = pieces.groupBy(F.col("conv").alias("conv_id")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    return Repair(_faults(fixed), audits, _repaired(decided, rows))


_DECIDED = [
    ("conv", "bigint", pa.int64()), ("turn", "bigint", pa.int64()), ("role", "string", pa.string()), ("h1", "bigint", pa.int64()),
    ("h2", "bigint", pa.int64()), ("part", "int", pa.int32()), ("at", "bigint", pa.int64()), ("piece", "int", pa.int32()),
    ("given", "string", pa.string()), ("inserted", "boolean", pa.bool_()), ("audit", "string", pa.string()),
    ("cost", "bigint", pa.int64()), ("illegal", "bigint", pa.int64()),
]


def _decide(several: dict[tuple[int, int | None], Place], edges: dict[tuple[int, int | None], int]):
    """Task: a row per turn that stays and per insertion, and one per fragment with its audit, cost and illegal pairs."""
    names, kinds_out = [d[0] for d in _DECIDED], [d[2] for d in _DECIDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for slices in _fragments(batches):
            fragment, symbols, copies = _read(slices)
            kinds = np.concatenate([longs(s.column(4))[0] for s in slices])
            place = several.get((fragment.part, fragment.conv), _WHOLE)
            edits, states, state = _edits(fragment, place.costs, place.state)
            tail = closing(state) if place.last else ""
            at = np.cumsum(np.r_[0, copies[:-1]])
            stays = symbols != _MUST_GO
            audit = "".join(edits) + tail
            cost = INSERT * audit.count("I") + REROLE * audit.count("R") + DELETE * audit.count("D")
            cost += TRUNCATED * sum(edits[i][-1] != "D" for i in at[stays & (symbols % 2 == 1)].tolist())
            legal = ((kinds[:-1] == 0) & (kinds[1:] == 1)) | ((kinds[:-1] + kinds[1:] == 3) & (kinds[:-1] % 3 != 0))
            illegal = int(copies.sum() - len(copies) + (~legal).sum()) + edges.get((fragment.part, fragment.conv), 0)
            keys = [[v for s in slices for v in s.column(i).to_pylist()] for i in (5, 6, 7, 8)]
            for i in np.flatnonzero(stays).tolist():
                own = tuple(k[i] for k in keys)
                for piece, given in _pieces(edits[at[i]], states[at[i]]):
                    new = piece < len(edits[at[i]]) - 1
                    role = own[1] if given is None else ROLES[given - 1]
                    made.append((fragment.conv, *(_NO_KEY if new else own), fragment.part, i, piece, role, new, None, None, None))
            for piece, given in _pieces(tail, state):
                made.append((fragment.conv, *_NO_KEY, fragment.part, len(symbols), piece, ROLES[given - 1], True, None, None, None))
            made.append((fragment.conv, *_NO_KEY, fragment.part, None, None, None, None, audit, cost, illegal))
            if len(made) > 4096:
                yield _rows(made, kinds_out, names)
                made = []
        yield _rows(made, kinds_out, names)

    return run


_NO_KEY = (None, None, None, None)


def _edge_pairs(fixed: DataFrame) -> dict[tuple[int, int | None], int]:
    """(part, conv) -> 1 where the first turn of a partition and the last one of that before are an illegal pair of one conversation."""
    edges = fixed.select("_part", "conv", "kind", F.monotonically_increasing_id().alias("at")).groupBy("_part").agg(
        F.min(F.struct("at", "conv", "kind")).alias("first"), F.max(F.struct("at", "conv", "kind")).alias("last"))
    found, held = {}, None
    for part, first, last in sorted(tuple(r) for r in edges.collect()):  # one row a partition
        if held is not None and held[1] == first[1]:
            found[part, first[1]] = int((held[2], first[2]) not in ((0, 1), (1, 2), (2, 1)))
        held = last
    return found


def _faults(found: DataFrame) -> DataFrame:
    """Counts of each turn's first fault, and missing turn numbers."""
    once = F.when(F.col("blank") | F.col("seen") | ~F.col("truncated"), 0).otherwise(1)
    again = F.when(F.col("blank"), 0).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1)
    by_turn = found.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(again).alias("duplicate"),
        F.sum(once).alias("truncated"))
    return by_turn.groupBy(F.col("conv").alias("conv_id")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
    )


def _repaired(decided: DataFrame, rows: DataFrame) -> DataFrame:
    """The turns that stay, with their texts, and the inserted ones, which are empty."""
    h1, h2 = hash_pair(F.col("role"), F.col("text"))
    texts = rows.withColumns({"h1": h1, "h2": h2}).groupBy(*_KEY).agg(F.min("text").alias("text"))
    right = texts.select(*[F.col(k).alias(f"_r_{k}") for k in _KEY], "text")
    on = F.lit(True)
    for k in _KEY:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = [F.col("conv").alias("conv_id"), "part", "at", "piece", F.col("given").alias("role")]
    return decided.where("NOT inserted").join(right, on).select(*out, "text").unionByName(
        decided.where("inserted").select(*out, F.lit("").alias("text")))


def damage_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a planted fault in five rows of twenty, by a checksum of the row's number.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user turn. Nulls are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), code.alias("code")).where(
        "code <> 0"
    ).select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
