"""The rule ledger on hand-made texts, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

rules = pytest.importorskip("chainlens.llm.quality_rules")


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    held = {}
    for w in windows:
        held[w] = held.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if held[w] > 1 for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(lines), sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words),
            sum(c.isascii() and c.isupper() for c in text))


ROUND = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    None, "", " \t\r\n ", "word", ROUND, f"{ROUND} {ROUND}", f"{ROUND} and {ROUND} or {ROUND}", "a " * 9, "a " * 7, "éß " * 30,
    "same line\nsame line\n\nother\nsame line ", "# ** <b> 12 34 A1", " wide space", "\U0001f600 " * 25 + "x|y",
    "SHOUT " * 3 + " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 700}" for i in range(20000)),
    " ".join(f"u{i}" for i in range(3000)), "ab c " * 6, "abc " * 6 + "x",
]


def test_measures(spark):
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)] * 2 + [(None, "word", "clash", 1)],
                                  "doc_id bigint, text string, failed string, n_words int")
    found = rules.build_ledger(table).collect()
    assert len(found) == 2 * len(TEXTS) + 1
    for r in found:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "word"
        assert tuple(r)[1:9] == counted(text), text and text[:50]
        n, chars, symbols, dup, repeat, lines, letters, upper = counted(text)
        fails = [n < 20, 100 * repeat > 30 * n, chars < 3 * n, chars > 10 * n, 10 * symbols > n, 2 * dup > lines,
                 10 * letters < 8 * n, 10 * upper > 4 * chars]
        assert r["failed"] == sum(1 << i for i, f in enumerate(fails) if f)


def test_policies_and_ablations(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    ledger = rules.write_ledger(rules.build_ledger(table), str(tmp_path / "ledger"))
    masks = {r["doc_id"]: r["failed"] for r in ledger.collect()}

    def keeps(mask, hard, soft, borne):
        return not mask & hard and (mask & soft).bit_count() <= borne

    for policy in rules.POLICIES.values():
        hard, soft = rules.mask_of(policy.hard), rules.mask_of(policy.soft)
        for r in rules.judge(ledger, policy).collect():
            assert r["base_failed"] == bool(masks[r["doc_id"]] & 3)
            assert r["kept"] == keeps(masks[r["doc_id"]], hard, soft, policy.borne)
        found = {r["rule"]: tuple(r)[1:] for r in rules.ablations(ledger, policy).collect()}
        assert list(found) == [*policy.hard, *policy.soft]
        for name, got in found.items():
            bit = rules.mask_of([name])
            assert got == (
                sum(bool(m & bit) for m in masks.values()), sum(m & (hard | soft) == bit for m in masks.values()),
                sum(keeps(m, hard & ~bit, soft & ~bit, policy.borne) and not keeps(m, hard, soft, policy.borne)
                    for m in masks.values()))
    with pytest.raises(KeyError):
        rules.mask_of(["unheard of"])


def test_empty_table_and_one_pass(spark):
    empty = rules.build_ledger(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.count() == 0
    assert {tuple(r)[1:] for r in rules.ablations(empty, rules.POLICIES["3"]).collect()} == {(0, 0, 0)}
    plan = rules.build_ledger(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert rules.judge(empty.withColumn("failed", F.lit(0)), rules.POLICIES["1"]).columns[-2:] == ["base_failed", "kept"]
