"""Prefix trie of conversations by a splitter skeleton.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Sequences are told apart by
128-bit hashes that are running xors of (turn, depth) hashes, so they are running totals along a conversation of any
length, and no text is shuffled.

* Nodes and members are one aggregate over (depth, hash). A chain of nodes with the same members is one link: nodes of one
  smallest member and one member count. A conversation's path is the list of its links, so it is short even if the
  conversation is not: a link ends only where a conversation ends or leaves.
* Distinct paths are range-partitioned and sorted, so a link's paths are neighbours. The first paths of the partitions are
  the splitters; a link that several partitions share lies on one of them. Their trie, the skeleton, is broadcast behind a
  check of its size. Each partition runs through its paths with a stack and finishes every link outside the skeleton; for
  skeleton links it gives the sums of its own part, which one aggregate adds up. A link that a partition shares with the one
  before (their neighbouring paths tell) counts in the earlier one. Should the skeleton pass its bound, all links are added up.
* Links give their nodes leaves, children and saved tokens by a join on the link; hot keys are split off and broadcast.

Defined results: a null turn comes first, turns of equal number go by role, then by a hash of role and text; a null role or text
is empty; repeated rows are turns of their own; rows with a null conv_id belong to no conversation and are left out; other
columns are not read; an empty table gives no node, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .common import hash_pair, materialize
from .scans import SUM, XOR, join_split, ordered_digests, running_totals, sort_by_range

_NODE = ["depth", "h1", "h2"]
_LINK = ["lead", "n"]


def ordered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, t1, t2, chars): every turn with its place from 1, the hashes of role and text, and the text's code points."""
    read = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    t1, t2 = hash_pair(F.col("role"), F.col("text"))
    rows = read.select("conv", "turn", "role", t1.alias("t1"), t2.alias("t2"), F.char_length("text").cast("bigint").alias("chars"))
    # equal rows are counted and numbered, so that a range can end among them
    same = ["conv", "turn", "role", "t1", "t2"]
    counted = rows.groupBy(*same).agg(F.any_value("chars").alias("chars"), F.count("*").alias("copies"))
    numbered = counted.select(*same, "chars", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    placed = running_totals(numbered, "conv", ["turn", "role", "t1", "t2", "copy"], {"pos": (F.lit(1), SUM)})
    return materialize(placed.select("conv", "pos", "t1", "t2", "chars"))


def _with_last(rows: DataFrame, length: Column) -> DataFrame:
    return rows.withColumn("last", F.col("depth") == length)


def rebuilt_turns(placed: DataFrame, group: int = 100, kinds: int = 6) -> DataFrame:
    """(conv, depth, t1, t2, chars, last): each conversation begins with the first turns of its group's first one.

    Depth 0 is a row of its own, the root. Fewer than ``kinds`` turns are copied, so a conversation gives few rows to others.
    """
    lengths = placed.groupBy("conv").agg(F.count("*").alias("own"))
    heads = placed.where((F.col("pos") < kinds) & (F.col("conv") % group == 0)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("head"))
    skipped = F.crc32(F.col("conv").cast("string").cast("binary")) % kinds
    convs = lengths.select("conv", "own", skipped.alias("skipped"), (F.col("conv") - F.col("conv") % group).alias("base")).join(
        heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("skipped").cast("int")), F.array().cast(heads.schema["head"].dataType))
    convs = convs.select("conv", "own", "skipped", taken.alias("head"))
    convs = materialize(convs.withColumn("taken", F.size("head").cast("bigint")).withColumn(
        "length", F.col("taken") + F.greatest(F.col("own") - F.col("skipped"), F.lit(0))))
    keyed = convs.select("conv", "own", "skipped", "taken", "length")
    own = join_split(placed, keyed, ["conv"], F.col("own"), placed.count()).where("pos > skipped")
    own = own.withColumn("depth", F.col("pos") - F.col("skipped") + F.col("taken"))
    lent = convs.select("conv", "length", F.explode("head").alias("t")).select(
        "conv", "length", F.col("t.pos").alias("depth"), "t.t1", "t.t2", "t.chars")
    roots = convs.select("conv", "length", *[F.lit(0).cast("bigint").alias(c) for c in ("depth", "t1", "t2", "chars")])
    columns = ["conv", "length", "depth", "t1", "t2", "chars"]
    rows = own.select(*columns).unionByName(lent.select(*columns)).unionByName(roots.select(*columns))
    return _with_last(rows, F.col("length")).drop("length")


def _walk(rows: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, p1, p2, chars, total, last): node and parent of each turn, and code points from the root on."""
    root = F.col("depth") == 0
    a1, a2 = hash_pair(F.col("t1"), F.col("t2"), F.col("depth"))
    own = rows.withColumns({"a1": F.when(root, F.lit(0)).otherwise(a1), "a2": F.when(root, F.lit(0)).otherwise(a2)})
    found = running_totals(own.drop("t1", "t2"), "conv", ["depth"], {
        "h1": (F.col("a1"), XOR), "h2": (F.col("a2"), XOR), "total": (F.col("chars"), SUM)})
    return materialize(found.select("conv", *_NODE, "chars", "total", "last"))


def _edges(fixed: DataFrame) -> DataFrame:
    """(_part, path, before, behind): a partition's first path, and the links that it shares with the partitions beside it."""
    ends = fixed.groupBy("_part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    beside = Window.orderBy("_part")  # one row a partition
    shared = lambda a, b: F.coalesce(
        F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False) - 1, F.lit(0))
    return ends.select(
        "_part", F.col("first").alias("path"), shared(F.lag("last").over(beside), F.col("first")).alias("before"),
        shared(F.col("last"), F.lead("first").over(beside)).alias("behind"))


def _stack(shared: dict[int, tuple[int, int]], skeleton: set[tuple[int, int]] | None):
    """Task: links of the sorted paths of a partition, finished or, on the skeleton, the sums of this partition."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["lead", "n", "parent_lead", "leaves", "saved", "children", "partial"]
    LEAD, COUNT, LEAVES, SAVED, CHILDREN, GROWN = range(6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        made: list[tuple] = []
        before, behind, opened = 0, 0, False

        def close(keep: int, continued: int = 0) -> None:
            while len(stack) > keep:
                link = stack.pop()
                if not link[GROWN] and len(stack) >= continued:
                    link[LEAVES] += 1
                if stack:
                    stack[-1][LEAVES] += link[LEAVES]
                    stack[-1][SAVED] += link[SAVED]
                partial = skeleton is None or (link[LEAD], link[COUNT]) in skeleton
                made.append((link[LEAD], link[COUNT], stack[-1][LEAD] if stack else None, link[LEAVES], link[SAVED],
                             link[CHILDREN], partial))

        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not opened:
                    before, behind = shared[part]
                same = 0
                while same < min(len(stack), len(path)) and (path[same]["lead"], path[same]["n"]) == tuple(stack[same][:2]):
                    same += 1
                close(same)
                for i in range(same, len(path)):
                    link = path[i]
                    mine = opened or i >= before  # an earlier partition has counted the others
                    if stack:
                        stack[-1][GROWN] = True
                        stack[-1][CHILDREN] += mine
                    stack.append([link["lead"], link["n"], 0, link["saved"] if mine else 0, 0, False])
                opened = True
                if len(made) > 8192:
                    yield _links(made, kinds, names)
                    made.clear()
        close(0, behind)
        yield _links(made, kinds, names)

    return run


def _links(made: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) if made else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def link_sums(paths: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(lead, n, parent_lead, leaves, saved, children) of every link; ``paths`` are distinct arrays of links.

    ``most`` bounds the links of the broadcast skeleton.
    """
    fixed = sort_by_range(paths.select("path"), ["path"])
    edges = materialize(_edges(fixed))
    shared = {r["_part"]: (r["before"], r["behind"]) for r in edges.select("_part", "before", "behind").collect()}
    splitters = edges.select(F.explode("path").alias("l")).select("l.lead", "l.n").distinct().limit(most + 1).collect()
    skeleton = None if len(splitters) > most else {tuple(r) for r in splitters}
    found = materialize(fixed.select("_part", "path").mapInArrow(
        _stack(shared, skeleton),
        "lead bigint, n bigint, parent_lead bigint, leaves bigint, saved bigint, children bigint, partial boolean"))
    reduced = found.where("partial").groupBy(*_LINK).agg(
        F.max("parent_lead").alias("parent_lead"), *[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
    return found.where("NOT partial").drop("partial").unionByName(reduced)


def _joined_ends(ends: DataFrame) -> DataFrame:
    """(node, _part, piece): ids that end at a node, in ranges, so that many are joined in many tasks and digested as few rows."""
    ranged = sort_by_range(ends, [*_NODE, "conv"])
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    return ranged.groupBy(*_NODE, "_part").agg(F.array_join(ids, ",").alias("piece"))


def prefix_trie(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A row a node of the trie over (conv, depth, t1, t2, chars, last): smallest member, depth, parent's smallest member, counts,
    saved tokens and the digest of the members that end there."""
    walked = _walk(rows)
    nodes = materialize(walked.groupBy(*_NODE).agg(
        F.min("conv").alias("lead"), F.count("*").alias("n"), F.any_value("chars").alias("chars"),
        F.any_value("total").alias("total"), F.min(F.when(F.col("last"), F.col("conv"))).alias("ender")))
    begins = F.col("total") - F.col("chars")
    links = materialize(nodes.groupBy(*_LINK).agg(
        F.min(F.struct("depth", "h1", "h2", begins.alias("total"))).alias("top"), F.max("depth").alias("bottom"),
        F.max("total").alias("end"),
    ).withColumn("own", (F.col("n") - 1) * (F.col("end") - F.col("top.total"))))
    tops = links.select(F.col("top.depth").alias("depth"), F.col("top.h1").alias("h1"), F.col("top.h2").alias("h2"), *_LINK, "own")
    steps = join_split(walked.select("conv", *_NODE), tops, _NODE, F.col("n"), walked.count())
    enders = nodes.where("ender IS NOT NULL").select(F.col("ender").alias("conv"))
    link = F.struct(*_NODE, *_LINK, F.col("own").alias("saved"))
    paths = steps.join(enders, "conv").groupBy("conv").agg(F.sort_array(F.collect_list(link)).alias("path"))
    sums = link_sums(paths, most).join(links.select(*_LINK, F.col("top.depth").alias("top"), "bottom", "end", "own"), _LINK)
    placed = join_split(nodes, sums, _LINK, F.col("bottom") - F.col("top") + 1, nodes.count())
    ended = ordered_digests(_joined_ends(walked.where("last").select(*_NODE, "conv")), _NODE, ["_part"], "piece", ",")
    return placed.join(ended, _NODE, "left").select(
        F.col("lead").alias("conv_id"), "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent_lead")).otherwise(F.col("lead")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("end") - F.col("total") + F.col("chars")) + F.col("saved") - F.col("own")).alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
