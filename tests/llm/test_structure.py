"""Structure repair on hand-made conversations, against a plain search."""

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest

structure = pytest.importorskip("chainlens.llm.structure")
from chainlens.llm import queries, scans  # noqa: E402

WHITE = " \t\n\x0b\f\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, symbol string, at int"
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def damage(rows):
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code:
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            yield from [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def cheapest(turns):
    """(cost, audit, repaired lines) by trying everything, ties to the least audit."""

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(turns):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, gone, cut = turns[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((4 + cost, "D" + audit, lines))
            if not gone:
                ways = [("K", 0, KEEPS[state][role[:1]], role)] if role[:1] in KEEPS[state] else []
                for name, price, to, given in [*ways, ("R", 3, *NEXT[state])]:
                    cost, audit, lines = best(i + 1, to, 0)
                    found.append((price + 3 * cut + cost, name + audit, (f"{given}:{text}", *lines)))
        if inserted < 4:
            to, given = NEXT[state]
            cost, audit, lines = best(i, to, inserted + 1)
            found.append((3 + cost, "I" + audit, (f"{given}:", *lines)))
        return min(found, key=lambda f: f[:2], default=(1 << 40, "", ()))

    return best(0, 0, 0)


def expected(rows):
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, seen, blank, again, short = [], set(), 0, 0, 0
        for _, _, role, text in own:
            bare = text.rstrip(WHITE)
            is_blank, dup = not bare, (role, text) in seen
            cut = not is_blank and not dup and bare[-1] not in ".!?"
            seen.add((role, text))
            blank, again, short = blank + is_blank, again + (dup and not is_blank), short + cut
            turns.append((role, text, is_blank or dup, cut))
        numbers = {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(tuple(turns))
        yield conv, gaps, blank, again, short, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def run(spark, monkeypatch, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(queries, "_table", lambda *a: table)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in queries.op12_structure_repair(spark, "").select(*names).collect()), key=str)


def made(seed, convs, long_turns):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        texts = [f"t{k}" + rng.choice([".", "!", "?", "", " \n", ". \t"]) for k in range(5)] + ["", None, " \r\n", "é?", "x" * 20000]
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 2]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]),
                         texts[turn % len(texts)], "clash", 1))
    # a third of all rows are one conversation, half of it copies of one turn
    long = [(10**6, k, rng.choice(["user", "assistant", "system"]), f"m{k}" + rng.choice([".", "", "?"]), "c", 2) for k in range(long_turns)]
    return rows + long + [(10**6, 9000, "user", "again.", "c", 2)] * long_turns


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, monkeypatch, seed):
    rows = made(seed, 60, 110)
    rows += [(None, None, None, None, None, None), (None, 3, "user", "null id.", None, None), (None, 4, "assistant", "yes", None, None)]
    rows += rows[:40]  # repeated rows
    # different turns of one number and role go by a hash, so such rows are made equal
    role = {(r[0], r[1]): next(damage([(*r[:2], "", "x")]), (0, 0, ""))[2] for r in rows}
    settled = {}
    for r in rows:
        settled.setdefault((r[0], r[1], role[r[0], r[1]] or r[2]), r)
    rows = [settled[r[0], r[1], role[r[0], r[1]] or r[2]] for r in rows]
    assert run(spark, monkeypatch, rows) == sorted(expected(rows), key=str)


def test_fragments_are_joined(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        rows = [(5, k, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["a.", f"b{k}", f"c{k}?", ""]), None, 1) for k in range(400)]
        sizes = []
        monkeypatch.setattr(structure, "join_fragments", lambda df, real=structure.join_fragments: sizes.append(real(df)) or sizes[-1])
        assert run(spark, monkeypatch, rows) == sorted(expected(rows), key=str)
        assert len(sizes[0]) > 8  # one conversation in many partitions
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark, monkeypatch):
    assert run(spark, monkeypatch, []) == []


def test_powers_and_long_runs():
    for symbol in range(9):
        one, many = structure._step(symbol), structure._step(symbol)
        for length in range(1, 40):
            assert (structure.table_of(symbol, length) == many).all()
            many = structure.combine(many, one)
        costs = structure._AT_END
        for _ in range(77):
            costs = structure.advance(symbol, 1, costs)
        assert costs == structure.advance(symbol, 77, structure._AT_END)
        assert (structure._inside(symbol, 77, structure._AT_END)[-1] == np.array(costs)).all()
    assert structure.advance(0, 10**12, structure._AT_END)[0] >= 10**12  # forty products, not 10**12 steps


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), i, rng.getrandbits(62)) for i in range(3000)]
    from pyspark.sql import functions as F
    found = scans.running_totals(spark.createDataFrame(rows, "g bigint, o bigint, v bigint"), "g", ["o"],
                                 {"n": (F.lit(1), "sum"), "x": (F.col("v"), "xor")}).collect()
    assert len(found) == len(rows)
    totals = {}
    for g, o, v, n, x in sorted((tuple(r) for r in found), key=lambda r: r[1]):
        at = totals.get(g, (0, 0))
        totals[g] = (at[0] + 1, at[1] ^ v)
        assert (n, x) == totals[g]
