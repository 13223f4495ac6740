"""Packing: order-preserving dynamic programming over document and sentence boundaries.

Documents are tokenised, closed with an end id and laid end to end in the order of their partition (sorted by doc_id,
then text, so that a retried task packs alike). Of that stream, a shortest path chooses the window cuts: a window of n ids
costs ``window - n`` (its padding) plus the penalty of the cut at its end, 0 at the end of a document, ``sentence`` after
one, ``inside`` elsewhere. Positions inside, 64 ids apart, are offered only in sentences of more than 128
ids (of a window of 4,096). The best
predecessor within the last ``window`` ids comes from a monotone queue, so each boundary is handled once. The path runs over
about a million ids at a time; what follows its last cut is carried on. The last window of a partition is cut at powers
of two, whose lengths need no padding, so many small partitions cost no padding either.

Nothing is shuffled: every partition packs its own rows, and memory holds one stretch of ids besides the longest document.

Defined results: null texts are empty and give the end id only; rows with equal or null ids are packed as documents of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
STRETCH = 1 << 20  # ids per run of the dynamic programme
_SLICE = 1 << 20  # characters tokenised at a time
_KNOWN_WORDS = 300_000  # words, and runs of letters, whose ids a worker remembers; it starts anew beyond
_MARKS = ".,;:!?#$%&*|"
_NOT_WHITE = "\x1c\x1d\x1e\x1f"  # white space to str.split, but not to tokenizers
_SEQUENCE_SHIFT = 32


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


# The steps before the model of a file whose words can be encoded one by one.
_FORM = (
    ["NFC", "Replace", "Lowercase"], [r"\s+"], ["Split", "ByteLevel"],
    [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"], "BPE", "</w>", None,
)


def _form(file: dict) -> tuple:
    """Normaliser and splitter of a tokenizer file, their patterns, kind of model, end of word, step behind the model."""
    before = (file.get("normalizer") or {}).get("normalizers") or []
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    patterns = lambda steps: [s["pattern"].get("Regex") for s in steps if "pattern" in s]
    return ([s["type"] for s in before], patterns(before), [s["type"] for s in splits], patterns(splits), file["model"]["type"],
            file["model"].get("end_of_word_suffix"), file.get("post_processor"))


class Encoder:
    """Ids of texts, by the file's tokenizer.

    Where the file normalises and splits as ``_FORM`` says, white space separates words for it, and letters from the marks that
    follow them, so each run of letters is encoded once: normalised by the tokenizer and handed to its model. All other
    words go through the whole tokenizer, and so do whole texts with any other file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.by_words = _form(json.loads(self.tokenizer.to_str())) == _FORM
        self.characters = _byte_characters()
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.closes[number] = set(token.removesuffix("</w>")) <= set(".!?") and token != "</w>"

    def forget(self) -> None:
        """Drop the remembered words: a worker that goes on to other work holds the tokenizer alone."""
        self.known, self.runs = {}, {}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        run = word.rstrip(_MARKS)
        if not run.isalpha():
            return self._whole(word)
        lower = run.lower() if run.isascii() else self.normalizer.normalize_str(run)
        found = self.runs.get(lower)
        if found is None:
            if not lower.isalpha():
                return self._whole(word)
            if len(self.runs) > _KNOWN_WORDS:
                self.runs.clear()
            spelt = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.characters)
            found = self.runs[lower] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(run) == len(word):
            return found
        tail = word[len(run):]
        marks = self.runs.get(tail)
        if marks is None:
            marks = self.runs[tail] = self._whole(tail)
        return found + marks

    def _words(self, text: str) -> bytes:
        odd = any(c in text for c in _NOT_WHITE)
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w] if odd else text.split()
        known = self.known
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self._word(word)
        return b"".join([known[w] for w in words])

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.frombuffer(self._whole(text), "<u4")
        found, at = [], 0
        while len(text) - at > _SLICE:
            cut = max(text.rfind(" ", at, at + _SLICE), text.rfind("\n", at, at + _SLICE))
            if cut <= at:  # a word longer than a slice is encoded whole
                cuts = [c for c in (text.find(" ", at + _SLICE), text.find("\n", at + _SLICE)) if c >= 0]
                cut = min(cuts, default=len(text))
            found.append(self._words(text[at:cut]))
            at = cut
        found.append(self._words(text[at:]))
        return np.frombuffer(b"".join(found), "<u4")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def candidate_cuts(
    ids: np.ndarray, document_ends: np.ndarray, closes: np.ndarray, sentence: int, inside: int, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, from 0, and the penalty of each."""
    at_sentence = np.flatnonzero(closes[ids]) + 1
    positions = np.unique(np.concatenate([[0], at_sentence, document_ends]))
    gaps = np.diff(positions)
    wide = np.flatnonzero(gaps > window // 32)
    extra = [np.arange(positions[g] + window // 64, positions[g + 1], window // 64) for g in wide]
    forced = np.concatenate([np.zeros(0, np.int64), *extra]).astype(np.int64)
    every = np.concatenate([positions, forced])
    penalties = np.full(len(every), sentence, np.int64)
    penalties[np.isin(every, document_ends)] = 0
    penalties[len(positions):] = inside
    penalties[every == 0] = 0
    order = np.argsort(every, kind="stable")
    return every[order], penalties[order]


def cheapest_cuts(positions: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The cuts of the cheapest path from position 0 into the last window of the stretch.

    With g = cost + position, a window from i to j costs g[j] = window + penalty[j] + g[i]: only the least g of the last
    ``window`` positions matters, and a monotone queue keeps it in front.
    """
    count = len(positions)
    cost = [0] * count
    back = [0] * count
    queue, front = [0], 0
    for j in range(1, count):
        low = positions[j] - window
        while positions[queue[front]] < low:
            front += 1
        best = queue[front]
        own = window + penalties[j] + cost[best]
        cost[j], back[j] = own, best
        while len(queue) > front and cost[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    first = count - 1
    while first > 1 and positions[first - 1] >= positions[-1] - window:
        first -= 1
    # where a path may end in the last window, ids that it leaves over are not lost: they open the next stretch
    last = min(range(first, count), key=lambda j: (cost[j] - positions[j], -j))
    cuts = []
    while last:
        cuts.append(positions[last])
        last = back[last]
    return cuts[::-1]


def powers_of_two(length: int) -> list[int]:
    """The ends of pieces of falling powers of two that make up ``length``."""
    ends, at = [], 0
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class Packer:
    """Takes documents in order, gives the pieces of finished windows."""

    def __init__(self, closes: np.ndarray, sentence: int, inside: int, window: int, first_sequence: int):
        self.closes, self.sentence, self.inside, self.window = closes, sentence, inside, window
        self.sequence = first_sequence
        self.held: list[tuple[object, np.ndarray, int]] = []  # document, ids not yet packed, their start
        self.size = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc, ids, 0))
        self.size += len(ids)
        if self.size >= STRETCH:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._pack(True)

    def _pack(self, final: bool) -> Iterator[tuple]:
        ids = np.concatenate([i for _, i, _ in self.held])
        ends = np.cumsum([len(i) for _, i, _ in self.held])
        positions, penalties = candidate_cuts(ids, ends, self.closes, self.sentence, self.inside, self.window)
        cuts = cheapest_cuts(positions.tolist(), penalties.tolist(), self.window)
        if final and cuts[-1] < len(ids):
            cuts.append(len(ids))
        if final:
            before = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + [before + e for e in powers_of_two(cuts[-1] - before)]
        yield from self._pieces(cuts)

    def _pieces(self, cuts: list[int]) -> Iterator[tuple]:
        at = number = taken = 0  # place in the stream, document, ids of it already in windows
        for cut in cuts:
            offset = 0
            while at < cut:
                doc, ids, start = self.held[number]
                size = min(cut - at, len(ids) - taken)
                part = ids[taken: taken + size]
                yield doc, start + taken, part, start + len(ids), self.sequence, offset
                at, offset, taken = at + size, offset + size, taken + size
                if taken == len(ids):
                    number, taken = number + 1, 0
            self.sequence += 1
        rest = self.held[number:]
        if rest and taken:
            doc, ids, start = rest[0]
            rest[0] = (doc, ids[taken:], start + taken)
        self.held = rest
        self.size -= at


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    end_id: int = END_ID, sentence: int = 4, inside: int = 16, with_ids: bool = False, remember: bool = True,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` on request.

    ``tokenizer`` is the path of a tokenizer file that every machine has. Without ``remember`` a worker forgets the ids of
    known words at the end of a task, so that it holds little when it takes up another stage.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encoder = _encoder(tokenizer)
        task = TaskContext.get()
        packer = Packer(encoder.closes, sentence, inside, window, (task.partitionId() if task else 0) << _SEQUENCE_SHIFT)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from packer.add(doc, np.concatenate([encoder.ids(text.as_py() or ""), end]))
        yield from packer.finish()
        if not remember:
            encoder.forget()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def made(held: list[tuple]) -> pa.RecordBatch:
        doc, start, part, total, sequence, offset = zip(*held, strict=True)
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(p) for p in part], pa.int64()),
                   pa.array([zlib.crc32(p) for p in part], pa.int64()), pa.array(total, pa.int64()),
                   pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        if with_ids:
            offsets = np.cumsum([0, *map(len, part)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(part).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[2])
            if size >= STRETCH or len(held) >= 4096:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)
        if not remember:
            pa.default_memory_pool().release_unused()

    fields = ", ".join(f"{n} bigint" for n in chain(names)) + ", ids array<int>" * with_ids
    rows_in = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows_in.sortWithinPartitions("doc_id", "text").mapInArrow(run, fields)
