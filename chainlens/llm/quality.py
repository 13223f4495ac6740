"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

* Words are lower-cased runs of letters, digits and non-ASCII characters, or runs of other marks; a word equal to the one before
  is read as a repeat. The features of a text are the hashes of its 1 to 3 word n-grams in 2**20 buckets; a bucket's value is
  the square root of its share of them, so the vector has length 1.
* Training takes at most about ``sample`` labelled rows of a label (SAMPLE by default, smallest hashes), weighted so that the
  labels keep their shares (a drawn id that repeats in the documents gives one row, the text with the smallest hash), and makes ``epochs`` passes of FTRL-Proximal updates with L1 and L2 in one task: the bound holds
  for its rows and the buckets for its model. Only non-zero weights reach the driver, at most 2**20.
* Every whole text is scored as a sparse dot product in its own task; nothing is shuffled.

Defined results: null and empty texts have no features and get the score of the bias; a null doc_id is not learned from
and not held out; null labels are not learned from; without labelled rows every score is 0.5; repeated labels count
once; labels, language and source are never read when scoring, nor are other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_by
from .hashing import mix, shingle_hashes, word_hashes
from .language_id import remainder

BITS = 20
WIDTHS = (1, 2, 3)
SAMPLE = 6_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
_REPEAT = np.uint64(1)
_BIAS = 1 << BITS


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct buckets of each row and their values."""
    words, offsets = word_hashes(column, marks=True)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = words[a:b]
        own = np.where(np.concatenate([[False], own[1:] == own[:-1]]), _REPEAT, own) if len(own) else own
        grams = [shingle_hashes(own, w) for w in WIDTHS if len(own) >= w]
        found = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        buckets, counts = np.unique((mix(found) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        yield buckets, np.sqrt(counts / max(len(found), 1))


class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss."""

    def __init__(self, size: int = _BIAS + 1):
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        made = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, made)

    def update(self, at: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        at, value = np.append(at, _BIAS), np.append(value, 1.0)
        w = self.weights(at)
        chance = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35.0, 35.0)))
        gradient = weight * (chance - label) * value
        grown = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def train(rows: DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all buckets and the bias. ``rows``: text, label 0 or 1, weight; a bounded sample."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(text_features(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.astype(np.int32) for f, _ in made], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32())), *batch.columns[1:]],
                names=["f", "v", "label", "weight", "place"])

    def learn(table: pa.Table) -> pa.Table:
        model = Ftrl()
        table = table.sort_by([("place", "ascending"), ("label", "ascending")])
        rows = zip(table.column("f"), table.column("v"), table.column("label").to_pylist(),
                   table.column("weight").to_pylist(), strict=True)
        held = [(f.values.to_numpy(), v.values.to_numpy(), label, weight) for f, v, label, weight in rows]
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(held)):
                model.update(*held[i])
        every = np.arange(_BIAS + 1)
        weights = model.weights(every)
        kept = np.flatnonzero(weights)
        return pa.table({"bucket": pa.array(kept), "w": pa.array(weights[kept])})

    listed = rows.select("text", F.col("label").cast("int"), F.col("weight").cast("double"),
                         F.xxhash64("text", "label").alias("place"))
    featured = listed.mapInArrow(featurise, "f array<int>, v array<float>, label int, weight double, place bigint")
    learned = featured.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "bucket bigint, w double").toArrow()
    weights = np.zeros(_BIAS + 1)
    weights[learned.column("bucket").to_numpy()] = learned.column("w").to_numpy()
    return weights


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, label, weight) of a bounded sample of the labelled documents."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two labels
    total = sum(counts.values())
    taken = sum(min(sample, n) for n in counts.values())
    rate, weight = F.lit(0.0), F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, sample / n).otherwise(rate)
        weight = F.when(F.col("label") == label, n / min(sample, n) * taken / total).otherwise(weight)
    draw = F.pmod(F.xxhash64("_id", "label"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    drawn = F.broadcast(known.where(draw < rate).withColumn("weight", weight))  # about 2 * sample rows
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(drawn, "_id")
    return first_by(found, ["_id", "label"], [F.xxhash64("text")]).select("text", "label", "weight")


def score_texts(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None) -> DataFrame:
    """(id, *extra, score) for every row; ``extra`` holds boolean columns by name."""
    extra = extra or {}
    names = [id_col, *extra, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at, value in text_features(batch.column(batch.num_columns - 1)):
                sums = weights[at] @ value + weights[_BIAS]
                scores.append(1.0 / (1.0 + np.exp(-np.clip(sums, -35.0, 35.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=names)

    rows = docs.select(id_col, *[c.alias(n) for n, c in extra.items()], F.col(text_col).cast("string").alias("_text"))
    fields = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}" + "".join(f", `{n}` boolean" for n in extra)
    return rows.mapInArrow(run, f"{fields}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3,
    held: int = 1, sample: int = SAMPLE,
) -> DataFrame:
    """(id, held_out, score, predicted) of every row; learned from the labelled rows outside the held-out fold."""
    fold = remainder(id_col, folds)
    drawn = training_sample(docs, labels.where(fold != held), id_col, text_col, label_col, sample)
    scored = score_texts(docs, train(drawn), id_col, text_col, {"held_out": F.coalesce(fold == held, F.lit(False))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
