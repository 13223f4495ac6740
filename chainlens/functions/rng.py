"""Reproducible uniforms: a hash of the row's identity, never of the partition it is in.

Draws are SQL text, so that loops over many hops build each expression in one call. ``row`` is one expression or a
list of them; each is hashed whole, so rows never share draws by packing.
"""

from __future__ import annotations

from collections.abc import Sequence

_HEX_DIGITS = 13
_CELLS = 16**_HEX_DIGITS


def _listed(row: str | Sequence[str]) -> list[str]:
    return [row] if isinstance(row, str) else list(row)


def _digits(row: str | Sequence[str], draw: str | int, seed: int) -> str:
    parts = [f"CAST({part} AS STRING)" for part in (*_listed(row), draw, seed)]
    return f"substr(md5(concat_ws(':', {', '.join(parts)})), 1, {_HEX_DIGITS})"


def portable_uniform(row: str | Sequence[str], draw: str | int, seed: int) -> str:
    """Uniform in [0, 1) from the first 52 bits of the MD5 of (row, draw, seed): equal in every engine with MD5."""
    return f"CAST(CAST(conv({_digits(row, draw, seed)}, 16, 10) AS BIGINT) AS DOUBLE) / {float(_CELLS)!r}D"


def checking_uniform(row: str | Sequence[str], draw: str | int, seed: int) -> str:
    """``portable_uniform`` in the words of the checking engine."""
    return f"CAST(CAST('0x' || {_digits(row, draw, seed)} AS BIGINT) AS DOUBLE) / CAST({_CELLS} AS DOUBLE)"


def hashed_uniform(row: str | Sequence[str], draw: str | int, seed: int) -> str:
    """Uniform in [0, 1) from a 64-bit hash of (row, draw, seed): the default, cheaper than MD5."""
    hashed = ", ".join([*_listed(row), f"CAST({draw} AS BIGINT)", f"CAST({seed} AS BIGINT)"])
    return f"CAST(shiftrightunsigned(xxhash64({hashed}), 11) AS DOUBLE) / {float(1 << 53)!r}D"


UNIFORMS = {"portable": portable_uniform, "hashed": hashed_uniform}
