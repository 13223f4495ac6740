"""Multi-class gradient boosting on histograms: softmax objective, all classes of a round together.

Rows are cut into bins once: a byte a feature. A round grows a tree a class, all of them level by level. Of a level, every
task adds the gradients and curvatures of its rows to one histogram per (class, node); the histograms meet by (class,
node), where the sums are taken and the best split is chosen, so the driver sees a row a node. Trees are the only model
state that travels; margins stay with the rows and are brought up to date from the trees since the last checkpoint.

Gradients are whole numbers of 2**-20, so sums do not depend on the order of tasks, and reruns give the same trees.

Split gain, leaf weights with L1 and L2 penalties, the least child weight, pruning by gamma, and sampling of rows a round and
of features a tree follow the usual second-order boosting. Nulls and NaN lie below all numbers. Rows without a label or an
id take no part in training; a class that has no row keeps its margin.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .metrics import classification_report

UNIT = float(1 << 20)
CHECKPOINT_ROUNDS = 10
CELLS = 4 << 20  # numbers of a histogram, or of an index, held at a time
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """Parameters of a training; the names and defaults of the usual libraries are given in the README."""

    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    row_share: float = 1.0
    feature_share: float = 1.0
    child_weight: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    penalty: float = 1.0
    bins: int = 64
    seed: int = 42


# The candidate values of the parameter search.
SEARCH_SPACE = {
    "rounds": [300, 500, 800, 1200],
    "depth": [4, 6, 7, 9, 12],
    "step": [0.01, 0.03, 0.05, 0.08, 0.1],
    "row_share": [0.6, 0.7, 0.8, 0.9, 1.0],
    "feature_share": [0.6, 0.7, 0.8, 0.9, 1.0],
    "child_weight": [1, 3, 5, 8, 12],
    "gamma": [0.0, 0.1, 0.2, 0.5, 1.0],
    "alpha": [0.0, 1e-4, 1e-3, 1e-2, 0.1],
    "penalty": [0.5, 1.0, 2.0, 5.0, 10.0],
}
SEARCH_DRAWS = 40


class Tree:
    """Nodes of one tree: the feature and last left bin of a split, its children, the weight of a leaf."""

    def __init__(self):
        self.feature, self.bin, self.left, self.gain, self.weight = [-1], [0], [0], [0.0], [0.0]

    def split(self, node: int, feature: int, last_left: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, last_left, gain, len(self.feature)
        for column, start in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.gain, 0.0), (self.weight, 0.0)):
            column += [start, start]
        return self.left[node], self.left[node] + 1

    def prune(self, gamma: float) -> None:
        """From the leaves up, undo splits that gain less than ``gamma``."""
        for node in range(len(self.feature) - 1, -1, -1):  # children come behind their parents
            if self.feature[node] >= 0 and self.gain[node] < gamma:
                left = self.left[node]
                if self.feature[left] < 0 and self.feature[left + 1] < 0:
                    self.feature[node] = -1

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf, or the open node, of each row of bins."""
        feature, last_left, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at = np.zeros(len(codes), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = left[node] + (codes[inner, feature[node]] > last_left[node])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.weight)[self.nodes_of(codes)]


def _soft_threshold(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _score(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    return _soft_threshold(g, settings.alpha) ** 2 / np.maximum(h + settings.penalty, 1e-12)


def leaf_weight(g: float, h: float, settings: Settings) -> float:
    return float(-settings.step * _soft_threshold(np.array(g), settings.alpha) / max(h + settings.penalty, 1e-12))


def best_split(sums: np.ndarray, allowed: np.ndarray, settings: Settings) -> tuple[int, int, float, np.ndarray]:
    """(feature, last left bin, gain, (g, h) of both sides) from a (2, features, bins) histogram; feature -1 without a split."""
    whole = sums[:, 0, :].sum(axis=1)
    none = -1, 0, 0.0, np.array([*whole, 0.0, 0.0])
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    if not left.size:
        return none
    right = whole[:, None, None] - left
    gain = _score(*left, settings) + _score(*right, settings) - _score(*whole, settings)
    fits = (left[1] >= settings.child_weight) & (right[1] >= settings.child_weight) & allowed[:, None]
    gain = np.where(fits, gain, -np.inf)
    at = int(np.argmax(gain))  # ties go to the first feature and the first bin
    feature, last_left = divmod(at, gain.shape[1])
    if not gain[feature, last_left] > _LEAST_GAIN:
        return none
    return feature, last_left, float(gain[feature, last_left]), np.array([*left[:, feature, last_left], *right[:, feature, last_left]])


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the softmax loss for each row and class, in whole units."""
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    h = np.maximum(2.0 * p * (1.0 - p), 1e-16)
    p[np.arange(len(labels)), labels] -= 1.0
    return np.round(p * UNIT), np.maximum(np.round(h * UNIT), 1.0)


def drawn(keys: np.ndarray, settings: Settings, number: int) -> np.ndarray:
    """Which rows take part in a round; a hash of (row, round, seed)."""
    if settings.row_share >= 1.0:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 + settings.seed * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) < int(settings.row_share * (1 << 53))


def chosen_features(features: int, settings: Settings, number: int, label: int) -> list[int]:
    """The features a tree may use."""
    count = max(1, math.ceil(settings.feature_share * features))
    return sorted(random.Random(f"{settings.seed} {number} {label}").sample(range(features), count))


def bin_edges(rows: DataFrame, features: str, bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """Rising inner edges of each feature's bins, half-way between approximate quantiles; at most ``bins`` - 1, a row a feature."""
    values = rows.select(F.posexplode(F.col(features).cast("array<double>")).alias("at", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    cuts = [i / (bins - 1) for i in range(bins)]
    found = values.groupBy("at").agg(F.percentile_approx("x", cuts, accuracy).alias("marks"))
    width = rows.agg(F.max(F.size(features))).first()[0] or 0
    edges: list[list[float]] = [[] for _ in range(width)]
    for at, marks in found.collect():
        marks = sorted(set(marks))
        edges[at] = [(a + b) / 2 for a, b in zip(marks, marks[1:], strict=False)]
    return edges


def code_rows(values: Sequence[Sequence[float | None]], edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: the number of edges that are not above it; nulls and NaN in bin 0."""
    table = np.array([[np.nan if x is None else x for x in row] for row in values], np.float64).reshape(-1, len(edges))
    codes = np.zeros(table.shape, np.uint8)
    for f, own in enumerate(edges):
        codes[:, f] = np.where(np.isnan(table[:, f]), 0, np.searchsorted(own, table[:, f], side="right"))
    return codes


def _table(column: pa.Array, width: int) -> np.ndarray:
    """Numbers of an array column, a row each; nulls as NaN."""
    flat = column.flatten()
    if len(flat) != len(column) * width:
        raise ValueError(f"every row needs {width} features")
    return np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, width)


def _coded(column: pa.Array, edges: list[list[float]]) -> np.ndarray:
    return code_rows(_table(column, len(edges)), edges)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.nbytes // max(len(data), 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class BoostedTrees:
    """A trained model: edges of the bins, settings, and for each round a tree a class."""

    def __init__(self, edges: list[list[float]], settings: Settings, classes: int, rounds: list[list[Tree]]):
        self.edges, self.settings, self.classes, self.rounds = edges, settings, classes, rounds

    def margins(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(codes), self.classes))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                total[:, k] += tree.values(codes)
        return total

    def transform(self, df: DataFrame, features: str = "features", out: str = "prediction_index", chances: str | None = None) -> DataFrame:
        """``df`` with the index of the likeliest class (ties: the first), and the chances of all on request."""
        kept = [c for c in df.columns if c not in (out, chances)]
        model = df.sparkSession.sparkContext.broadcast(self)  # rounds x classes trees of at most 2 ** (depth + 1) nodes
        fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out}` double"]
        fields += [f"`{chances}` array<double>"] if chances else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margins = model.value.margins(_coded(batch.column(kept.index(features)), model.value.edges))
                made = [*batch.columns, pa.array(margins.argmax(axis=1).astype(np.float64))]
                if chances:
                    p = np.exp(margins - margins.max(axis=1, keepdims=True))
                    made.append(pa.array(list(p / p.sum(axis=1, keepdims=True)), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(made, names=[*kept, out, *([chances] if chances else [])])

        return df.select(*kept).mapInArrow(run, ", ".join(fields))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes, bin edges and settings as tables below ``path``."""
        nodes = [(r, k, n, t.feature[n], t.bin[n], t.left[n], t.weight[n]) for r, trees in enumerate(self.rounds)
                 for k, t in enumerate(trees) for n in range(len(t.feature))]
        spark.createDataFrame(nodes, "round int, class int, node int, feature int, bin int, left int, weight double").write.mode(
            "overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(list(enumerate(self.edges)), "feature int, edges array<double>").write.mode("overwrite").parquet(f"{path}/edges")
        text = json.dumps({"settings": asdict(self.settings), "classes": self.classes, "rounds": len(self.rounds)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        known = json.loads(spark.read.text(f"{path}/settings").first()[0])
        edges = [list(r["edges"]) for r in spark.read.parquet(f"{path}/edges").orderBy("feature").collect()]
        rounds = [[Tree() for _ in range(known["classes"])] for _ in range(known["rounds"])]
        for r in spark.read.parquet(f"{path}/nodes").orderBy("round", "class", "node").collect():
            tree = rounds[r["round"]][r["class"]]
            if r["node"]:
                for column in (tree.feature, tree.bin, tree.left, tree.gain, tree.weight):
                    column.append(0)
            tree.feature[-1], tree.bin[-1], tree.left[-1], tree.weight[-1] = r["feature"], r["bin"], r["left"], r["weight"]
        return BoostedTrees(edges, Settings(**known["settings"]), known["classes"], rounds)


def histograms(codes: np.ndarray, node: np.ndarray, nodes: int, bins: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(nodes, 2, features, bins) sums of one class; rows of node -1 are left out."""
    features = codes.shape[1]
    sums = np.zeros((2, nodes * features * bins))
    places = np.arange(features, dtype=np.int64) * bins
    kept = np.flatnonzero(node >= 0)
    slab = max(1, CELLS // max(features, 1))
    for a in range(0, len(kept), slab):
        rows = kept[a: a + slab]
        cell = (node[rows, None] * (features * bins) + places[None, :] + codes[rows]).ravel()
        for i, weight in enumerate((g, h)):
            sums[i] += np.bincount(cell, np.repeat(weight[rows], features), nodes * features * bins)
    return sums.reshape(2, nodes, features, bins).swapaxes(0, 1)


def train(
    rows: DataFrame, settings: Settings = Settings(), features: str = "features", label: str = "label_index", id_col: str = "id",
    classes: int | None = None, edges: list[list[float]] | None = None,
) -> BoostedTrees:
    """Fit on all labelled ``rows``; ``classes`` is one more than the largest label index if not given."""
    labelled = rows.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    classes = classes or int((labelled.agg(F.max(label)).first()[0] or 0) + 1)
    edges = edges if edges is not None else bin_edges(labelled, features, settings.bins)
    width, bins = len(edges), max([len(e) for e in edges], default=0) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), _binary(_coded(batch.column(2), edges)),
                     _binary(np.zeros((batch.num_rows, classes)))], names=["key", "y", "codes", "margins"])

    state = materialize(labelled.select(F.xxhash64(id_col).alias("key"), F.col(label).cast("int").alias("y"), features).mapInArrow(
        encode, "key bigint, y int, codes binary, margins binary"))
    model = BoostedTrees(edges, settings, classes, [])
    if not width or not state.limit(1).count():
        return model
    pending: list[list[Tree]] = []
    for number in range(settings.rounds):
        trees = [Tree() for _ in range(classes)]
        allowed = np.zeros((classes, width), bool)
        for k in range(classes):
            allowed[k, chosen_features(width, settings, number, k)] = True
        open_nodes = [(k, 0) for k in range(classes)]
        for level in range(settings.depth):
            found = _level(state, pending, trees, open_nodes, allowed, settings, number, bins, classes)
            open_nodes = _grow(trees, open_nodes, found, settings)
            if not open_nodes:
                break
        for tree in trees:
            tree.prune(settings.gamma)
        model.rounds.append(trees)
        pending = [*pending, trees]
        if len(pending) >= CHECKPOINT_ROUNDS and number + 1 < settings.rounds:
            state, pending = materialize(_brought_up(state, pending, classes, width)), []
    return model


def _grow(trees: list[Tree], open_nodes: list[tuple[int, int]], found: dict, settings: Settings) -> list[tuple[int, int]]:
    """Split the open nodes that gain, set the weights of both sides, and give the new nodes."""
    following = []
    for k, node in open_nodes:
        if (k, node) not in found:  # no row came here
            continue
        feature, last_left, gain, sides = found[k, node]
        if node == 0 and feature < 0:
            trees[k].weight[0] = leaf_weight(sides[0], sides[1], settings)
        if feature < 0:
            continue
        if node == 0:
            trees[k].weight[0] = leaf_weight(sides[0] + sides[2], sides[1] + sides[3], settings)
        left, right = trees[k].split(node, feature, last_left, gain)
        trees[k].weight[left], trees[k].weight[right] = leaf_weight(*sides[:2], settings), leaf_weight(*sides[2:], settings)
        following += [(k, left), (k, right)]
    return following


def _margins(batch: pa.RecordBatch, pending: list[list[Tree]], codes: np.ndarray, classes: int) -> np.ndarray:
    margins = _rows_of(batch.column(3), np.float64, classes).copy()
    for trees in pending:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.values(codes)
    return margins


def _brought_up(state: DataFrame, pending: list[list[Tree]], classes: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = _margins(batch, pending, _rows_of(batch.column(2), np.uint8, width), classes)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(margins)], names=["key", "y", "codes", "margins"])

    return state.mapInArrow(run, "key bigint, y int, codes binary, margins binary")


def _level(
    state: DataFrame, pending: list[list[Tree]], trees: list[Tree], open_nodes: list[tuple[int, int]], allowed: np.ndarray,
    settings: Settings, number: int, bins: int, classes: int,
) -> dict[tuple[int, int], tuple[int, int, float, np.ndarray]]:
    """(class, node) -> best split of every open node that has rows."""
    width = allowed.shape[1]
    by_class: dict[int, list[int]] = {}
    for k, node in open_nodes:
        by_class.setdefault(k, []).append(node)
    cells = 2 * width * bins
    block = max(1, CELLS // cells)  # nodes of a histogram at a time
    whole = len(open_nodes) * cells <= 4 * CELLS  # a task adds all its rows up first, or else every batch's

    def rows_of(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in held], pa.int32()), pa.array([n for _, n in held], pa.int32()),
             pa.array([s.tobytes() for s in held.values()], pa.binary())], names=["k", "node", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One histogram per (class, node)."""
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _rows_of(batch.column(2), np.uint8, width)
            g, h = gradients(_margins(batch, pending, codes, classes), np.asarray(batch.column(1)))
            taken = drawn(np.asarray(batch.column(0)), settings, number)
            for k, nodes in by_class.items():
                at = np.where(taken, trees[k].nodes_of(codes), -1)
                for a in range(0, len(nodes), block):
                    own = nodes[a: a + block]
                    slot = np.full(len(trees[k].feature) + 1, -1, np.int64)
                    slot[own] = np.arange(len(own))
                    sums = histograms(codes, slot[at], len(own), bins, g[:, k], h[:, k])
                    for i in np.flatnonzero(sums[:, 1, 0, :].any(axis=1)).tolist():
                        if (k, own[i]) in held:
                            held[k, own[i]] += sums[i]
                        else:
                            held[k, own[i]] = sums[i].copy()
                    if not whole:
                        yield rows_of(held)
                        held.clear()
        if held:
            yield rows_of(held)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the histograms of each node, which come one behind the other, and give its best split."""
        held, total, found = None, None, []

        def close() -> None:
            if held is not None:
                feature, last_left, gain, sides = best_split(total / UNIT, allowed[held[0]], settings)
                found.append((*held, feature, last_left, gain, sides.tolist()))

        for batch in batches:
            for k, node, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(data).reshape(2, width, bins)
                if held == (k, node):
                    total += own
                else:
                    close()
                    held, total = (k, node), own.copy()
        close()
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        columns = list(zip(*found, strict=True)) if found else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                         names=["k", "node", "feature", "bin", "gain", "sides"])

    sums = state.mapInArrow(add, "k int, node int, sums binary")
    parts = max(1, min(len(open_nodes), int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = sums.repartition(parts, "k", "node").sortWithinPartitions("k", "node").mapInArrow(
        choose, "k int, node int, feature int, bin int, gain double, sides array<double>")
    return {(r[0], r[1]): (r[2], r[3], r[4], np.array(r[5])) for r in found.collect()}  # a row a node


def draw_settings(space: Mapping[str, Sequence] = SEARCH_SPACE, n: int = SEARCH_DRAWS, seed: int = 42, base: Settings = Settings()) -> list[Settings]:
    """``n`` different random points of the grid (all of a smaller one)."""
    size = math.prod(len(values) for values in space.values())
    made = []
    for position in random.Random(seed).sample(range(size), min(n, size)):
        picked = {}
        for name in sorted(space):
            position, at = divmod(position, len(space[name]))
            picked[name] = space[name][at]
        made.append(replace(base, **picked))
    return made


@dataclass(frozen=True)
class Search:
    """Result of ``search``: each draw's mean macro F1 over the folds, the best draw, and its model on all rows."""

    draws: list[Settings]
    scores: list[float]
    best: Settings
    model: BoostedTrees


def search(folded: DataFrame, draws: Sequence[Settings], folds: int = 5, fold: str = "fold", features: str = "features",
           label: str = "label_index", id_col: str = "id", parallelism: int = 4) -> Search:
    """Cross-validate the draws by macro F1 and refit the best (ties: the first) on all rows. Fits run as concurrent Spark jobs."""
    rows = materialize(folded.select(id_col, label, features, fold))
    classes = int((rows.agg(F.max(label)).first()[0] or 0) + 1)
    edges = {bins: bin_edges(rows, features, bins) for bins in {s.bins for s in draws}}

    def score(task: tuple[Settings, int]) -> float:
        settings, held = task
        model = train(rows.where(F.col(fold) != held), settings, features, label, id_col, classes, edges[settings.bins])
        scored = model.transform(rows.where(F.col(fold) == held), features)
        frame = scored.select(F.col(label).cast("int").cast("string").alias("label"),
                              F.col("prediction_index").cast("int").cast("string").alias("prediction"))
        return float(classification_report(frame).where(F.col("class") == "macro avg").first()["f1"])

    tasks = [(settings, held) for settings in draws for held in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(score, tasks))
    scores = [sum(found[i * folds:(i + 1) * folds]) / folds for i in range(len(draws))]
    best = draws[scores.index(max(scores))]
    return Search(list(draws), scores, best, train(rows, best, features, label, id_col, classes, edges[best.bins]))
