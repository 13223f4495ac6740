"""Weighted random walks over the cumulative-weight table, one join per hop for all walks at once."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import UNIFORMS
from ..session import broadcast_if_small, materialize, materialize_bucketed
from .ranking import dense_ids

POLICIES = ("restart", "terminate", "teleport")
# Draw numbers of the dead-end jumps start above those of the hops.
_TELEPORT_DRAW = 1_000_003


@dataclass(frozen=True)
class Adjacency:
    """Neighbour lists ready for hops.

    ``lists``: (node, block, salt, wsum, cumes[], dsts[], hots[]).
    ``wide``: (node, salt, wide_wsum, ends[], blocks[]) for sources cut into several blocks, else None.
    ``hot``: nodes whose rows are copied ``salts`` times because many walks may stand on them.
    ``split``: whether there are any, or any wide source; if not, ``node`` alone is the key.
    ``longest``: the most entries that a list has; a search takes enough steps for it.
    """

    lists: DataFrame
    wide: DataFrame | None
    hot: DataFrame
    split: bool
    salts: int
    longest: int


def _salted(df: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """Rows of hot nodes once per salt, all others once with salt 0."""
    flagged = df.join(hot.withColumn("_hot", F.lit(True)), "node", "left")
    copies = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0))
    return flagged.withColumn("salt", F.explode(F.sequence(F.lit(0), copies))).drop("_hot")


def hot_nodes(cdf: DataFrame, hot_degree: int, rounds: int = 4) -> DataFrame:
    """(node) on which more than ``hot_degree`` walks may arrive in one hop, counted as one walk from every source.

    Nodes with that many in-edges come first. The walks then move on from these: a node that they reach with enough
    probability is hot as well, whatever its in-degree, for up to ``rounds`` steps. At most edges / ``hot_degree`` nodes
    start; a node without either is never copied.
    """
    arrivals = cdf.groupBy(F.col("dst").alias("node")).agg(F.count("*").cast("double").alias("n"))
    found = newest = materialize(arrivals.filter(F.col("n") > hot_degree))
    for _ in range(rounds):
        if newest.isEmpty():
            break
        leaving = cdf.join(broadcast_if_small(newest.withColumnRenamed("node", "src")), "src")
        moved = leaving.groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("n") * F.col("weight") / F.col("wsum")).alias("n"))
        fresh = moved.filter(F.col("n") > hot_degree).join(found.select("node"), "node", "left_anti")
        newest = materialize(fresh)
        found = found.unionByName(newest)
    return materialize(found.select("node"))


def build_adjacency(
    cdf: DataFrame, hot_degree: int = 1_000_000, salts: int = 64, partitions: int | None = None
) -> Adjacency:
    """Collapse the cumulative weights to one row per (source, block), partitioned for the hops.

    Only the lists of nodes where many walks arrive are copied (``hot_nodes``). A long list alone is no reason: it is cut
    into blocks, and its walks spread over them.
    """
    spread = cdf.groupBy(F.col("src").alias("node")).agg(F.min("block").alias("a"), F.max("block").alias("b"))
    wide_nodes = spread.filter(F.col("a") != F.col("b")).select("node")
    hot = hot_nodes(cdf, hot_degree)
    known_hot = broadcast_if_small(hot)
    flagged = cdf.join(known_hot.select(F.col("node").alias("dst"), F.lit(True).alias("hot")), "dst", "left").withColumn(
        "hot", F.coalesce("hot", F.lit(False))
    )
    entries = F.array_sort(F.collect_list(F.struct("cume", "dst", "hot")))
    lists = (
        flagged.groupBy(F.col("src").alias("node"), "block")
        .agg(F.max("wsum").alias("wsum"), entries.alias("entries"))
        .select(
            "node", "block", "wsum",
            F.col("entries.cume").alias("cumes"), F.col("entries.dst").alias("dsts"), F.col("entries.hot").alias("hots"),
        )
    )
    any_wide = not wide_nodes.isEmpty()
    split = any_wide or not hot.isEmpty()
    lists = materialize_bucketed(
        _salted(lists, known_hot, salts), ["node", "block", "salt"] if split else ["node"], partitions
    )
    wide = None
    if any_wide:
        ends = F.array_sort(F.collect_list(F.struct(F.element_at("cumes", -1).alias("end"), "block")))
        per_node = (
            lists.join(wide_nodes, "node", "left_semi")
            .filter(F.col("salt") == 0)
            .groupBy("node")
            .agg(F.max("wsum").alias("wide_wsum"), ends.alias("ends"))
            .select("node", "wide_wsum", F.col("ends.end").alias("ends"), F.col("ends.block").alias("blocks"))
        )
        wide = materialize_bucketed(_salted(per_node, hot, salts), ["node", "salt"], partitions)
    longest = lists.agg(F.max(F.size("cumes"))).first()[0] or 1
    if wide is not None:
        longest = max(longest, wide.agg(F.max(F.size("ends"))).first()[0] or 1)
    return Adjacency(lists, wide, hot, split, salts, longest)


def first_at_least(values: str, target: str, longest: int) -> str:
    """SQL for the 0-based position of the first element >= ``target`` in an ascending array (its size if none)."""
    steps = max(1, math.ceil(math.log2(longest + 1)) + 1)
    middle = "CAST((s.low + s.high) DIV 2 AS INT)"
    return (
        f"aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', size({values})), (s, step) -> CASE"
        f" WHEN s.low >= s.high THEN s"
        f" WHEN get({values}, {middle}) >= {target} THEN named_struct('low', s.low, 'high', {middle})"
        f" ELSE named_struct('low', {middle} + 1, 'high', s.high) END, s -> s.low)"
    )


def next_hop(frontier: DataFrame, adjacency: Adjacency, u: str, key: str) -> DataFrame:
    """``frontier`` (node, hot, u, ...) plus next_node and next_hot; null next_node at a dead end.

    The target is the first neighbour whose cumulative weight reaches u * wsum.
    ``key`` is a row id that spreads the rows standing on a hot node over its copies. The short rows of the frontier are hashed
    and the lists stream past them: merging would sort all lists for every hop.
    """
    columns = frontier.columns
    if not adjacency.split:
        joined = frontier.hint("shuffle_hash").join(adjacency.lists.drop("block", "salt"), "node", "left")
    else:
        copy = f"CASE WHEN hot THEN CAST(pmod(xxhash64({key}), {adjacency.salts}) AS INT) ELSE 0 END AS salt"
        salted = frontier.selectExpr(*columns, copy)
        block = "0L AS block"
        if adjacency.wide is not None:
            salted = salted.join(adjacency.wide, ["node", "salt"], "left")
            at = first_at_least("ends", f"{u} * wide_wsum", adjacency.longest)
            block = f"coalesce(get(blocks, {at}), 0L) AS block"
        joined = salted.selectExpr(*columns, "salt", block).hint("shuffle_hash").join(adjacency.lists, ["node", "block", "salt"], "left")
    at = first_at_least("cumes", f"{u} * wsum", adjacency.longest)
    return joined.selectExpr(*columns, "dsts", "hots", f"{at} AS _at").selectExpr(
        *columns, "get(dsts, _at) AS next_node", "get(hots, _at) AS next_hot"
    )


def random_walks(
    seeds: DataFrame,
    adjacency: Adjacency,
    length: int = 40,
    walks_per_seed: int = 1,
    policy: str = "restart",
    seed: int = 42,
    uniform: str = "hashed",
    checkpoint_every: int = 10,
) -> DataFrame:
    """Walks of at most ``length`` hops from every seed: (walk_id, path).

    A dead end is handled by ``policy``: go back to the seed, stop, or jump to a uniform seed.
    Draws depend only on (walk_id, hop, seed), so the result is the same on any partitioning.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    draw = UNIFORMS[uniform]
    hot = adjacency.hot.withColumn("hot", F.lit(True))
    numbered = dense_ids(seeds.select("node_id").distinct(), [F.col("node_id")], "seed_index")
    numbered = numbered.join(hot.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn(
        "hot", F.coalesce("hot", F.lit(False))
    )
    if policy == "teleport":
        numbered = materialize(numbered)
        pool = numbered.select(
            F.col("seed_index").alias("_pool"), F.col("node_id").alias("_jump"), F.col("hot").alias("_jump_hot")
        )
        pool_size = numbered.count()
    copies = F.explode(F.sequence(F.lit(0), F.lit(walks_per_seed - 1)))
    frontier = numbered.withColumn("_copy", copies).select(
        (F.col("seed_index") * walks_per_seed + F.col("_copy")).alias("walk_id"),
        F.col("node_id").alias("home"), F.col("hot").alias("home_hot"),
        F.col("node_id").alias("node"), "hot", F.array("node_id").alias("part"),
    )
    segments: list[DataFrame] = []
    for hop in range(length):
        drawn = frontier.selectExpr("*", f"{draw('walk_id', hop, seed)} AS u")
        moved = next_hop(drawn, adjacency, "u", "walk_id")
        target, flag = "next_node", "next_hot"
        if policy == "restart":
            target, flag = "coalesce(next_node, home)", "coalesce(next_hot, home_hot)"
        elif policy == "teleport":
            jump = f"CAST(floor({draw('walk_id', _TELEPORT_DRAW + hop, seed)} * {pool_size}) AS BIGINT)"
            moved = moved.selectExpr("*", f"CASE WHEN next_node IS NULL THEN {jump} END AS _pool")
            moved = moved.join(pool, "_pool", "left")
            target, flag = "coalesce(next_node, _jump)", "coalesce(next_hot, _jump_hot)"
        frontier = moved.selectExpr(
            "walk_id", "home", "home_hot", f"{target} AS node", f"{flag} AS hot",
            f"CASE WHEN {target} IS NOT NULL THEN concat(part, array({target})) ELSE part END AS part",
        )
        if hop + 1 == length or (hop + 1) % checkpoint_every == 0:
            frontier = materialize(frontier)
            segments.append(frontier.select("walk_id", F.lit(len(segments)).alias("_order"), "part"))
            frontier = frontier.filter(F.col("node").isNotNull()).withColumn(
                "part", F.array().cast("array<bigint>")
            )
    if not segments:
        return frontier.select("walk_id", F.col("part").alias("path"))
    parts = segments[0]
    for segment in segments[1:]:
        parts = parts.union(segment)
    if len(segments) == 1:
        return parts.select("walk_id", F.col("part").alias("path"))
    ordered = F.array_sort(F.collect_list(F.struct("_order", "part")))
    return parts.groupBy("walk_id").agg(ordered.alias("_parts")).select(
        "walk_id", F.flatten(F.col("_parts.part")).alias("path")
    )


def split_even(ids: DataFrame, n_parts: int, mode: str = "contiguous", index: str = "seed_index") -> DataFrame:
    """Parts whose sizes differ by at most one, from a dense 0-based index and the row count."""
    total = ids.count()
    n_parts = max(1, min(n_parts, total))
    position = F.col(index)
    if mode == "roundrobin":
        return ids.withColumn("part", (position % n_parts).cast("bigint"))
    if mode != "contiguous":
        raise ValueError("mode must be contiguous or roundrobin")
    small, larger = divmod(total, n_parts)
    cut = larger * (small + 1)
    early = F.floor(position / F.lit(small + 1))
    late = F.floor((position - cut) / F.lit(max(small, 1))) + larger
    return ids.withColumn("part", F.when(position < cut, early).otherwise(late).cast("bigint"))


def parse_walks(lines: DataFrame, column: str = "value") -> DataFrame:
    """Walk lines to (path); blank lines give no row and tokens that are no integers are skipped."""
    tokens = F.split(F.trim(column), r"\s+")
    numbers = F.filter(F.transform(tokens, lambda t: t.try_cast("bigint")), lambda n: n.isNotNull())
    return lines.filter(F.trim(column) != "").select(numbers.alias("path"))


def drop_short(walks: DataFrame, min_len: int = 2) -> DataFrame:
    return walks.filter(F.size("path") >= min_len)


def shuffle_walks(walks: DataFrame, seed: int, min_len: int = 2) -> DataFrame:
    """Walks in a reproducible random order, without those too short to train on."""
    mixed = drop_short(walks, min_len).withColumn("_mix", F.xxhash64("walk_id", F.lit(seed)))
    return mixed.repartitionByRange("_mix", "walk_id").sortWithinPartitions("_mix", "walk_id").drop("_mix")


def walk_stats(walks: DataFrame) -> DataFrame:
    """Count, shortest, longest, mean length and distinct first nodes over non-empty walks."""
    size = F.size("path")
    return walks.filter(size > 0).agg(
        F.count("*").alias("walks"),
        F.min(size).cast("bigint").alias("min_len"),
        F.max(size).cast("bigint").alias("max_len"),
        F.avg(size).alias("avg_len"),
        F.count_distinct(F.get("path", F.lit(0))).alias("first_nodes"),
    )


def vocab_counts(walks: DataFrame, min_count: int = 1) -> DataFrame:
    """(id, count, index): tokens at or above ``min_count``, indexed by falling count, then id."""
    counts = (
        walks.select(F.explode("path").alias("id"))
        .groupBy("id")
        .agg(F.count("*").alias("count"))
        .filter(F.col("count") >= min_count)
    )
    return dense_ids(counts, [F.col("count").desc(), F.col("id")], "index")
