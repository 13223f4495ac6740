"""Columns and small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, remove_path, scratch_path

# The white space of the contracts, [\x20\x09-\x0D], and the letters that are lower-cased.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["LOWER", "UPPER", "WHITE", "WORD", "ascii_lower", "fingerprint", "hash_pair", "materialize", "remove_path",
           "rest_of", "scratch_path", "word_count"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the contracts' white space; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes: 128 bits, so that even 10**12 keys do not meet by chance."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def fingerprint(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Identity of a row by content: equal rows share it, whatever partition they are in."""
    return hash_pair(*columns)


def rest_of(df: DataFrame, *taken: str) -> list[str]:
    """Columns of ``df`` other than ``taken``."""
    return [c for c in df.columns if c not in taken]
