"""Quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Main path: DataFrame functions only.

* ``measure`` takes every measurement of a text once, inside its row: nothing is shuffled, whatever the text's length.
* ``build_ledger`` evaluates every rule once on the measurements and sets one bit of ``failed`` a rule. The ledger holds no
  text, so it is stored (``write_ledger``) beside the documents and judged again without reading them.
* A policy is a version, the rules that reject alone (hard), the rules that count (soft) and how many soft failures it
  bears. ``judge`` applies any version to a stored ledger with two masks and a bit count.
* ``ablations`` says what each rule does under a policy. Rows are first counted per value of ``failed``, at most
  2 ** rules of them; everything else is arithmetic on those masks.

Repeated windows: words are hashed to 64 bits, hashes paired to those of 8-word windows, and these sorted with their places; equal neighbours are
repeats, and the words that they cover are added up along the places.

Defined results: a null text is the empty text and has no words; an empty text has one empty line, which has no word;
rows that repeat an id are rows of their own; a null id stays null; columns other than id and text are not read, so
their names cannot clash; an empty table gives an empty ledger, and ablations of zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WHITE

WINDOW = 8
SYMBOLS = "#*$%&|<>"  # fixed value
SPACES = r"[\x20\x09-\x0D]+"
LETTER = r"[^\x00-@\[-`{-\x7F]"  # an ASCII letter, or any character beyond ASCII


class Rule(NamedTuple):
    """A named condition on the measurements; its place in ``RULES`` is its bit."""

    name: str
    fails: str


# Bits are never given to another rule: new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", "10 * n_letter_words < 8 * n_words"),
    Rule("shouting", "10 * n_upper > 4 * word_chars"),
)
BASE = ("few_words", "repeated_windows")


class Policy(NamedTuple):
    """Rejects on any hard failure, and on more soft failures than it bears."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    borne: int = 0


POLICIES = {
    p.version: p
    for p in (
        Policy("1", BASE),
        Policy("2", BASE, ("short_words", "long_words", "many_symbols", "repeated_lines", "few_letters", "shouting"), 1),
        Policy("3", (*BASE, "short_words", "long_words", "many_symbols", "repeated_lines", "few_letters", "shouting")),
    )
}
CURRENT = "3"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, x: total + x)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur at least twice among ``words``."""
    if width & (width - 1):
        raise ValueError("the width is a power of two")

    def paired(hashes: Column, step: int) -> Column:
        """Hashes of windows of 2 * step words from those of step words; the last ones run over the end."""
        return _let(hashes, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for k in range(width.bit_length() - 1):
        hashes = paired(hashes, 1 << k)
    hashes = F.slice(hashes, 1, F.greatest(F.size(words) - (width - 1), F.lit(0)))

    def covered(repeats: Column) -> Column:
        return _let(F.sort_array(repeats), lambda p: _total(F.transform(
            p, lambda at, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - at, F.lit(width))).cast("bigint"))))

    def repeats(sorted_windows: Column) -> Column:
        same = F.filter(sorted_windows, lambda x, i: (F.get(sorted_windows, i - 1)["h"] == x["h"])
                        | (F.get(sorted_windows, i + 1)["h"] == x["h"]))
        return F.transform(same, lambda x: x["at"])

    def search(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            covered(_let(F.sort_array(marked), repeats)))

    return _let(hashes, search)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements): one row a document, all of them whole numbers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(
        "doc_id", "_text", F.filter(F.split("_text", SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda line: F.trim(line, F.lit(WHITE)) != "").alias("_lines"),
    )
    without = lambda letters: F.char_length("_text") - F.char_length(F.translate("_text", letters, ""))
    measures = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.translate("_text", WHITE, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_letter_words": F.size(F.filter("_words", lambda w: w.rlike(LETTER))),
        "n_upper": without(UPPER),
    }
    return rows.select("doc_id", *[value.cast("bigint").alias(name) for name, value in measures.items()])


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules; an unknown name is an error."""
    bits = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(bits[name] for name in set(names))


def build_ledger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(doc_id, measurements, failed): bit i of ``failed`` is set where rule i fails."""
    failed = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs, id_col, text_col).withColumn("failed", failed)


def write_ledger(ledger: DataFrame, path: str) -> DataFrame:
    """The ledger, written once to a folder and read back from there."""
    ledger.write.parquet(path)
    return ledger.sparkSession.read.schema(ledger.schema).parquet(path)


def _keeps(failed: Column, hard: int, soft: int, borne: int) -> Column:
    return (failed.bitwiseAND(F.lit(hard)) == 0) & (F.bit_count(failed.bitwiseAND(F.lit(soft))) <= borne)


def judge(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``base_failed`` (a rule of ``BASE`` fails) and ``kept`` (the policy's verdict, false where base_failed)."""
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE, rules))) != 0
    kept = _keeps(F.col("failed"), mask_of(policy.hard, rules), mask_of(policy.soft, rules), policy.borne)
    return ledger.withColumns({"base_failed": base, "kept": ~base & kept})


def ablations(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, n_failed, n_alone, n_freed): rows failing the rule, failing no other rule of the policy, kept only without it."""
    hard, soft = mask_of(policy.hard, rules), mask_of(policy.soft, rules)
    counted = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    now = _keeps(F.col("failed"), hard, soft, policy.borne)
    sums = []
    for name in (*policy.hard, *policy.soft):
        bit = mask_of([name], rules)
        without = _keeps(F.col("failed"), hard & ~bit, soft & ~bit, policy.borne)
        fails = F.col("failed").bitwiseAND(F.lit(bit)) != 0
        count = lambda chosen: F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0))
        sums.append(F.struct(
            F.lit(name).alias("rule"), count(fails).alias("n_failed"),
            count(F.col("failed").bitwiseAND(F.lit(hard | soft)) == bit).alias("n_alone"),
            count(without & ~now).alias("n_freed"),
        ))
    return counted.agg(F.array(*sums).alias("found")).select(F.explode("found").alias("f")).select("f.*")
