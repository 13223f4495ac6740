"""Training pairs for node embeddings: vocabulary codes, windows, noise draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.rng import UNIFORMS
from ..session import materialize, remove_path, scratch_path
from .ranking import running_sum
from .walks import first_at_least, vocab_counts

_LIST_SIZE = 32  # tokens of a cell beside the few that a cell's edges add
NOISE_ROWS = 16_000_000  # tokens, 256 MB, that every Python worker may hold
_MOST_TURNS = 16
_PAIRS_A_TURN = 250_000  # pairs of an epoch, by the square of the parts, that pay for a turn


def encode_walks(walks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Walks as vocabulary indexes; tokens outside the vocabulary drop out of the sequence."""
    codes = vocab.select(F.col("id").alias("_token"), F.col("index").alias("_code"))
    tokens = walks.select("walk_id", F.posexplode("path").alias("_pos", "_token")).join(codes, "_token")
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_code")))
    return tokens.groupBy("walk_id").agg(ordered.alias("_seq")).select("walk_id", F.col("_seq._code").alias("path"))


def skipgram_pairs(walks: DataFrame, window: int = 8, seed: int = 42, uniform: str = "hashed") -> DataFrame:
    """(walk_id, pos, ctx_pos, center, context): each centre draws its own half-window from 1..window.

    Pairs are made inside the row, so their number per row is at most 2 * window * path length.
    """
    reach = f"CAST(floor({UNIFORMS[uniform]('walk_id', 'i', seed)} * {window}) AS INT) + 1"
    spots = f"sequence(greatest(0, i - ({reach})), least(size(path) - 1, i + {reach}))"
    pair = "named_struct('pos', i, 'ctx_pos', j, 'center', get(path, i), 'context', get(path, j))"
    pairs = f"flatten(transform(sequence(0, size(path) - 1), i -> transform(filter({spots}, j -> j <> i), j -> {pair})))"
    return walks.filter("size(path) >= 2").selectExpr("walk_id", f"inline_outer({pairs})")


def noise_distribution(vocab: DataFrame, power: float = 0.75, block_width: int = 65536) -> DataFrame:
    """(id, index, p, low, cume): p proportional to count^power, cumulated in index order."""
    weighted = vocab.withColumn("_w", F.pow(F.col("count").cast("double"), F.lit(power))).withColumn(
        "_block", F.floor(F.col("index") / F.lit(block_width))
    )
    summed = running_sum(weighted, [], "_block", ["index"], "_w", "_cume", total="_total")
    return summed.select(
        "id", "index", (F.col("_w") / F.col("_total")).alias("p"),
        ((F.col("_cume") - F.col("_w")) / F.col("_total")).alias("low"),
        (F.col("_cume") / F.col("_total")).alias("cume"),
    )


def sample_negatives(
    pairs: DataFrame, noise: DataFrame, k: int, seed: int = 42, uniform: str = "hashed", min_cells: int = 256,
    limit: int = NOISE_ROWS,
) -> DataFrame:
    """``k`` noise tokens per pair: for a draw u, the first token whose cumulated chance reaches u.

    A distribution of at most ``limit`` tokens goes to every worker, and no pair is shuffled or copied before its draws are
    found. Give ``noise`` materialized. A longer one is joined: the unit interval is cut into cells of equal probability, so draws spread evenly over the join
    keys however frequent one token is; a token that spans several cells is listed in each.
    """
    if noise.limit(limit + 1).count() <= limit:
        return _negatives_in_place(pairs, noise, k, seed, uniform)
    smallest = noise.agg(F.min("p")).first()[0]
    cells = max(min_cells, int(1.0 / (smallest * _LIST_SIZE)) + 1) if smallest else min_cells
    last = F.lit(cells - 1)
    spans = F.sequence(
        F.least(last, F.greatest(F.lit(0), F.floor(F.col("low") * cells).cast("int") - 1)),
        F.least(last, F.floor(F.col("cume") * cells).cast("int") + 1),
    )
    ordered = F.array_sort(F.collect_list(F.struct("cume", "id")))
    lists = noise.withColumn("cell", F.explode(spans)).groupBy("cell").agg(ordered.alias("_list"))
    lists = lists.select("cell", F.col("_list.cume").alias("_cumes"), F.col("_list.id").alias("_ids"))
    draws = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "_u", F.expr(UNIFORMS[uniform](("walk_id", "pos", "ctx_pos"), "draw", seed))
    )
    draws = draws.withColumn("cell", F.floor(F.col("_u") * cells).cast("int"))
    at = F.expr(first_at_least("_cumes", "_u", 4 * _LIST_SIZE))
    return draws.join(lists, "cell").withColumn("negative", F.get("_ids", at)).drop("cell", "_u", "_cumes", "_ids")


def _negatives_in_place(pairs: DataFrame, noise: DataFrame, k: int, seed: int, uniform: str) -> DataFrame:
    """``sample_negatives`` with the cumulated chances in every Python worker."""
    spark, columns = pairs.sparkSession, pairs.columns
    table = noise.select("cume", "id").toArrow().sort_by([("cume", "ascending"), ("id", "ascending")]).combine_chunks()
    shared = spark.sparkContext.broadcast((table["cume"].to_numpy(), table["id"].combine_chunks()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cumes, ids = shared.value
        for batch in batches:
            draws = batch.column(len(columns))
            at = np.searchsorted(cumes, draws.flatten().to_numpy())
            found = ids.take(pa.array(at, mask=at == len(ids)))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, found)], names=[*columns, "_negatives"])

    draws = F.array(*[F.expr(UNIFORMS[uniform](("walk_id", "pos", "ctx_pos"), draw, seed)) for draw in range(k)])
    schema = StructType([*pairs.schema.fields, StructField("_negatives", ArrayType(noise.schema["id"].dataType))])
    drawn = pairs.withColumn("_u", draws).mapInArrow(find, schema)
    return drawn.select(*columns, F.posexplode_outer("_negatives").alias("draw", "negative"))


_PART_FIELDS = "part int, side string, ids binary, vectors binary, noise binary"


def initial_parts(noise: DataFrame, dim: int, parts: int, seed: int = 42) -> DataFrame:
    """(part, side, ids, vectors, noise): two rows a part, single precision: small random centre vectors (side u), zero context vectors (v).

    ``noise`` holds the chance of each node of the part to be drawn as noise.
    """
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        part = table.column("part")[0].as_py()
        start = ((np.random.default_rng((seed, part)).random((len(ids), dim)) - 0.5) / dim).astype(np.float32)
        chances = table.column("p").to_numpy()
        return _part_rows(part, ids, start, np.zeros_like(start), chances)

    return noise.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.col("id").cast("bigint").alias("id"), "p").groupBy(
        "part").applyInArrow(build, _PART_FIELDS)


def _part_rows(part: int, ids: np.ndarray, u: np.ndarray, v: np.ndarray, chances: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part, part], pa.int32()), "side": ["u", "v"], "ids": [ids.tobytes()] * 2,
                     "vectors": [u.tobytes(), v.tobytes()], "noise": [chances.tobytes()] * 2})


def descend(u: np.ndarray, v: np.ndarray, center: np.ndarray, other: np.ndarray, cumulated: np.ndarray, negatives: int,
            rate_from: float, rate_to: float, batch: int, draws: np.random.Generator) -> None:
    """Stochastic gradient steps on u and v, in place, with a rate that falls over the pairs.

    A step takes ``batch`` pairs. Its noise is drawn once for all of them, at least four times ``negatives`` nodes, and
    weighted so that a pair meets ``negatives`` of them in expectation; so the noise is two small matrix products.
    """
    noise = max(4 * negatives, 64)
    for at in range(0, len(center), batch):
        rate = rate_from + (rate_to - rate_from) * at / len(center)
        c, o = center[at: at + batch], other[at: at + batch]
        n = np.searchsorted(cumulated, draws.random(noise) * cumulated[-1], side="right").clip(0, len(v) - 1)
        left, right, away = u[c], v[o], v[n]
        miss = rate * (1.0 - _sigmoid((left * right).sum(axis=1)))
        push = (rate * negatives / noise) * _sigmoid(left @ away.T)
        np.add.at(u, c, miss[:, None] * right - push @ away)
        np.add.at(v, o, miss[:, None] * left)
        np.subtract.at(v, n, push.T @ left)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def block_step(vectors: DataFrame, pairs: DataFrame, dim: int, parts: int, turn: int, negatives: int, rate_from: float, rate_to: float,
               seed: int) -> DataFrame:
    """One pass over the pairs of this turn, whose parts are ``turn`` apart; the parts after it.

    Group g holds the centre vectors of part g, the context vectors of part g + turn and the pairs between them, so no two
    groups share a vector and each group takes many small steps on its own. Noise is drawn in the group from the context part,
    so it is never stored; every context part is met once an epoch.
    """
    group = F.when(F.col("side") == "u", F.col("part")).otherwise(F.pmod(F.col("part") - turn, F.lit(parts)))

    def learn(table: pa.Table, found: pa.Table) -> pa.Table:
        held = {row["side"]: row for row in table.to_pylist()}
        if len(held) < 2 or not found.num_rows:
            return table.drop_columns("g")
        ids = {side: np.frombuffer(row["ids"], np.int64) for side, row in held.items()}
        u, v = (np.frombuffer(held[side]["vectors"], np.float32).reshape(-1, dim).copy() for side in "uv")
        found = found.sort_by([("center", "ascending"), ("other", "ascending")])
        draws = np.random.default_rng((seed, turn, held["u"]["part"]))
        order = draws.permutation(found.num_rows)
        center = np.searchsorted(ids["u"], found.column("center").to_numpy())[order]
        other = np.searchsorted(ids["v"], found.column("other").to_numpy())[order]
        batch = max(16, min(1024, len(u), len(v)))
        descend(u, v, center, other, np.cumsum(np.frombuffer(held["v"]["noise"])), negatives, rate_from, rate_to, batch, draws)
        made = {"u": u, "v": v}
        return pa.table({c: [made[side].tobytes() if c == "vectors" else row[c] for side, row in held.items()] for c in
                         ("part", "side", "ids", "vectors", "noise")}, schema=_PART_SCHEMA)

    return vectors.withColumn("g", group).groupBy("g").cogroup(pairs.groupBy("center_part")).applyInArrow(learn, _PART_FIELDS)


_PART_SCHEMA = pa.schema([("part", pa.int32()), ("side", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary()), ("noise", pa.binary())])


def unpacked(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) of the centre vectors, a row a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                ids, flat = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(data.as_py(), np.float32).astype(np.float64)
                for at in range(0, len(ids), 10_000):
                    own = flat[at * dim:(at + 10_000) * dim]
                    offsets = np.arange(0, len(own) + 1, dim, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at: at + 10_000]), pa.ListArray.from_arrays(offsets, pa.array(own))], names=["id", "embedding"])

    return vectors.where("side = 'u'").select("ids", "vectors").mapInArrow(run, "id bigint, embedding array<double>")


def subsampled(walks: DataFrame, vocab: DataFrame, sample: float, seed: int) -> DataFrame:
    """Walks without a random share of their frequent tokens: one of share f stays with sqrt(sample / f) + sample / f."""
    total = vocab.agg(F.sum("count")).first()[0] or 1
    share = F.col("count") / F.lit(float(total))
    stays = vocab.select(F.col("id").alias("_token"), (F.sqrt(F.lit(sample) / share) + F.lit(sample) / share).alias("_stays"))
    tokens = walks.select("walk_id", F.posexplode("path").alias("_pos", "_token")).join(stays, "_token")
    kept = tokens.filter(F.expr(UNIFORMS["hashed"](("walk_id", "_pos"), 0, seed)) < F.col("_stays"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_token")))
    return kept.groupBy("walk_id").agg(ordered.alias("_seq")).select("walk_id", F.col("_seq._token").alias("path"))


def part_of(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int").alias(f"{column}_part")


def part_count(nodes: int, pairs: int, part_nodes: int, most_nodes: int = 500_000) -> int:
    """Parts of about ``part_nodes`` nodes, or more where the pairs of an epoch pay for more turns.

    A turn is a Spark job, and an epoch has as many as parts, so there are at most ``_MOST_TURNS`` while the parts stay below ``most_nodes``
    nodes. Parts also are the tasks of a turn: with one part a single task would take all pairs.
    """
    wanted = max(-(-nodes // part_nodes), math.isqrt(pairs // _PAIRS_A_TURN))
    return max(1, -(-nodes // max(most_nodes, part_nodes)), min(wanted, _MOST_TURNS, nodes))


def largest_group(pairs: DataFrame, parts: int) -> int:
    """Pairs of the fullest (centre part, other part)."""
    counted = pairs.groupBy(part_of("center", parts), part_of("context", parts)).agg(F.count("*").alias("n"))
    return counted.agg(F.max("n")).first()[0] or 0


class PairStore:
    """The pairs of one share in the shared folder, by turn: a turn reads its own folder, 1 / parts of them."""

    schema = "center bigint, other bigint, center_part int, turn int"

    def __init__(self, pairs: DataFrame, parts: int):
        self.spark = pairs.sparkSession
        self.path = scratch_path(self.spark, "pairs")
        keyed = pairs.select("center", F.col("context").alias("other"), part_of("center", parts),
                             part_of("context", parts).alias("_to"))
        keyed = keyed.withColumn("turn", F.pmod(F.col("_to") - F.col("center_part"), F.lit(parts))).drop("_to")
        if parts > 1:
            keyed = keyed.repartition("turn", "center_part")
        keyed.write.partitionBy("turn").parquet(self.path)

    def of_turn(self, turn: int) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        return stored.where(F.col("turn") == turn).select("center", "other", "center_part")

    def remove(self) -> None:
        remove_path(self.spark, self.path)


def train_vectors(
    walks: DataFrame, dim: int = 64, window: int = 8, negatives: int = 15, epochs: int = 10, alpha: float = 0.025,
    min_alpha: float = 0.0001, sample: float = 0.0, min_count: int = 1, seed: int = 42, power: float = 0.5,
    part_nodes: int = 500_000, group_pairs: int = 4_000_000,
) -> DataFrame:
    """(id, embedding): skip-gram with negative sampling over (walk_id, path), the vectors kept as a distributed table of parts.

    Nodes are cut into parts of about ``part_nodes`` (see ``part_count``), a row a part and side. Every epoch draws new windows and noise (and drops
    frequent tokens, if ``sample`` > 0), deals the walks to shares small enough that no group of two parts gets over about
    ``group_pairs`` pairs (counted for the fullest group), stores a share's pairs by turn, and takes the pairs of parts in turns. The rate
    falls from ``alpha`` to ``min_alpha``. Parts are checkpointed after each turn. Nothing of vocabulary size passes
    through the driver or one task.
    """
    vocab = materialize(vocab_counts(walks, min_count))
    noise = materialize(noise_distribution(vocab, power))
    kept = walks if min_count <= 1 else encode_kept(walks, vocab)
    parts = part_count(vocab.count(), skipgram_pairs(kept, window, seed).count(), part_nodes)
    vectors = materialize(initial_parts(noise, dim, parts, seed))
    most = largest_group(skipgram_pairs(kept, window, seed), parts)
    shares = max(1, math.ceil(most / group_pairs))
    steps = epochs * shares
    for epoch in range(epochs):
        whole = subsampled(kept, vocab, sample, seed + epoch) if sample else kept
        for number in range(shares):
            mine = whole if shares == 1 else whole.filter(F.pmod(F.xxhash64(F.lit(epoch), "walk_id"), F.lit(shares)) == number)
            store = PairStore(skipgram_pairs(mine, window, seed + epoch), parts)
            at = epoch * shares + number
            rates = [alpha + (min_alpha - alpha) * (at + e) / steps for e in (0, 1)]
            for turn in range(parts):
                vectors = materialize(block_step(vectors, store.of_turn(turn), dim, parts, turn, negatives, *rates, seed + at))
            store.remove()
    return unpacked(vectors, dim)


def encode_kept(walks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Walks without the tokens missing from the vocabulary."""
    return encode_walks(walks, vocab.select("id", F.col("id").alias("index")))
