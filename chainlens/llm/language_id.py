"""Language ID by rank-order profiles and the out-of-place distance.

* A text's profile: its ``size`` most frequent letter n-grams (1 to 3 letters of lower-cased words, word ends marked),
  most frequent first, ties by code.
* A language's profile: the same over the labelled training rows. At most about ``sample`` documents of a language
  (``SAMPLE`` by default; rows with the smallest hashes of id and text) are counted. Counts are added per task and
  summed by Spark; only ``size`` n-grams a language reach the driver.
* The distance is the sum over the text's profile of the difference in rank, or ``size`` where the language lacks the
  n-gram. The language with the smallest distance is predicted, ties to the smaller name by code point; the score is
  1 - distance / (size * profile length).

Whole texts are counted, in pieces of a million characters cut at white space (a run of letters longer than that is
cut there). Defined results: a null text or one without a letter gives ``und`` and score 0, and so does every text if
nothing was learned; a null lang or doc_id is not learned from and a null doc_id is not held out; repeated rows count
as often as they occur; clashing columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small

SIZE = 300
SAMPLE = 4_000
MOST_LANGUAGES = 1_000  # every task holds all profiles; more labels than languages exist are refused
UNKNOWN = "und"
_PIECE = 1_000_000
_EDGE = 1
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point of each letter; _EDGE for all that is not a letter."""
    return np.fromiter((c if chr(c).isalpha() else _EDGE for c in range(0x110000)), np.int32, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _PIECE:
        cut = max(text.rfind(" ", at, at + _PIECE), text.rfind("\n", at, at + _PIECE))
        end = cut + 1 if cut > at else at + _PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def ngram_codes(piece: str) -> np.ndarray:
    """Codes of all n-grams of one to three symbols: letters, and the edge of a word in the longer ones."""
    points = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[_EDGE], _letters()[points], [_EDGE]])
    x = x[np.concatenate([[True], (x[1:] != _EDGE) | (x[:-1] != _EDGE)])]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    pairs = (x[:-1] << _BITS) | x[1:]
    triples = ((pairs[:-1] << _BITS) | x[2:])[x[1:-1] != _EDGE]
    return np.concatenate([x[x != _EDGE], pairs, triples])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a whole text and their counts."""
    found = [np.unique(ngram_codes(p), return_counts=True) for p in _pieces(text)]
    if len(found) == 1:
        return found[0]
    return _add([c for c, _ in found], [n for _, n in found])


def _add(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def top_codes(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code (``codes`` are sorted)."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        likely = np.flatnonzero(counts >= least)
        codes, counts = codes[likely], counts[likely]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _sampled(rows: DataFrame, sample: int) -> DataFrame:
    """All rows of a language with at most ``sample`` rows; else about that many, chosen by hash."""
    sizes = broadcast_if_small(rows.groupBy("lang").agg(F.count("*").alias("_rows")))  # a row for each language
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return rows.join(sizes, "lang").where(draw * F.col("_rows") < sample).drop("_rows")


def learn_profiles(rows: DataFrame, size: int = SIZE, sample: int = SAMPLE) -> DataFrame:
    """(lang, code, rank): ``size`` n-grams of each language of ``rows`` (id, lang, text), ranks from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1)
            for lang in sorted(set(langs)):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for own, text in zip(langs, texts, strict=True):
                    if own == lang:
                        held.append(ngram_counts(text.as_py()))
                    if len(held) > 200:
                        held = [_add([c for c, _ in held], [n for _, n in held])]
                codes, counts = _add([c for c, _ in held], [n for _, n in held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                    names=["lang", "code", "n"],
                )
        pa.default_memory_pool().release_unused()  # reused workers would hold it through the next stages

    labelled = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    counted = _sampled(labelled, sample).select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return summed.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).drop("n")


class Profiles:
    """Ranks of the known n-grams in every language; ``size`` where a language lacks one."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.codes = np.unique(np.array([code for _, code, _ in rows], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, code), number[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs:
            return UNKNOWN, 0.0
        own = top_codes(*ngram_counts(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with lang_pred and score; columns already so named are replaced."""
    learned = [tuple(r) for r in profiles.select("lang", "code", "rank").limit(MOST_LANGUAGES * size + 1).collect()]
    if len(learned) > MOST_LANGUAGES * size:
        raise ValueError(f"the labels name more than {MOST_LANGUAGES} languages")
    known = Profiles(learned, size)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [known.predict(text.as_py()) for text in batch.column(kept.index(text_col))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )
        pa.default_memory_pool().release_unused()

    return docs.select(*kept).mapInArrow(run, f"{fields}, lang_pred string, score double")


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text has a letter: those that ``identify`` would not call ``und`` for their text."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (text.as_py() for text in batch.column(place))
            yield batch.filter(pa.array([t is not None and any(len(ngram_codes(p)) for p in _pieces(t)) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def predict_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2,
    size: int = SIZE, sample: int = SAMPLE,
) -> DataFrame:
    """(id, text, held_out, lang_pred, score); learned from the labelled rows outside the held-out fold."""
    fold = remainder(id_col, folds)
    training = docs.where(fold != held).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(fold == held, F.lit(False)).alias("held_out")
    )
    return identify(rows, learn_profiles(training, size, sample), "text", size)
