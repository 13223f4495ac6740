"""Vectorised word and shingle hashes of Arrow text columns, in bounded pieces (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 21  # bytes hashed at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=2)
def _tables(marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte, A-Z as a-z; and its kind: 0 for white space [\\x20\\x09-\\x0D], else 1, or 2 for marks.

    Marks are ASCII characters other than letters and digits; without ``marks`` they are no kind of their own.
    """
    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)
    kinds = np.ones(256, np.uint8)
    if marks:
        kinds[[c for c in range(128) if not chr(c).isalnum()]] = 2
    kinds[[32, 9, 10, 11, 12, 13]] = 0
    return mix(codes + np.uint64(1)), kinds


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the tables grow to the longest piece seen."""
    if 0 not in _powers or len(_powers[0][0]) < size:
        length = max(size, PIECE + 4096)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(length, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[0] = tuple(made)
    return _powers[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first: offsets[-1] if len(offsets) else 0], offsets - first


def _word_hashes(data: np.ndarray, starts_at: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of one piece; ``starts_at`` are positions where a new text begins."""
    values, kinds = _tables(marks)
    kind = kinds[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind])
    after = np.concatenate([kind, np.zeros(1, np.uint8)])
    border = before != after
    border[starts_at] = True
    begins = np.flatnonzero(border & (after != 0))
    ends = np.flatnonzero(border & (before != 0))
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[: len(data)])])
    hashes = (sums[ends] - sums[begins]) * inverse[begins]
    return mix(hashes + (ends - begins).astype(np.uint64)), begins


def word_hashes(column: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and n + 1 offsets into them.

    With ``marks``, runs of marks are words of their own: ``a!!`` is two.
    """
    data, offsets = text_bytes(column)
    white_table = _tables()[1] == 0
    found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):  # go on to the next white space or the next text
            step = white_table[data[end: end + 4096]]
            near = int(np.argmax(step)) if step.any() else len(step)
            border = offsets[np.searchsorted(offsets, end)]
            end = int(min(end + near, border))
            if step.any() or end == border:
                break
        inner = offsets[(offsets >= at) & (offsets < end)] - at
        hashes, begins = _word_hashes(data[at:end], inner, marks)
        found.append(hashes)
        places.append(begins + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles of one text; a shorter text is one shingle; no words, none."""
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * _BASE + words[i: len(words) - size + 1 + i]
    return mix(total)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, offsets = word_hashes(column)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield np.unique(shingle_hashes(words[a:b], width))
