"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

* A document's signature has 32 slots of 16 bits (the low bits of 32 minima over its shingle hashes). The distance
  of two signatures is the number of slots that differ.
* The slots are split into 8 chunks of 4. Of two signatures that differ in at most 15 slots, some chunk differs in at
  most one (8 chunks with two errors each would be 16). That error is enumerated: each chunk gives 4 keys, each
  leaving one slot out, so the two meet under a key. All pairs within the distance are found. A pair of similarity
  0.8 differs in more than 15 slots with probability 0.0002, and even then meets under a key but for one case in
  10**6, because pairs up to 18 slots apart that do meet are confirmed as well.
* Equal shingle sets are one class, found by a partial aggregate; only class representatives are joined.
* Of the documents that share a key with another, u counts the shingles that no other of them has. Partners share keys, so
  none of these u shingles is in a partner's set: sets of n and n' shingles have m = min(n - u, n' - u') in common at most,
  and their similarity is at most m / (n + n' - m). Pairs below the threshold by this bound, and documents that are in
  any pair, as (n - u) / n is too small, are left out without loss.
* Within a bucket every member is first compared with the member that has the fewest such shingles (the likely original of a
  group of copies), and confirmed links are merged into components. Then only members of different components are
  compared with each other. Their counts of shingles shared with that original bound m from above once more: common
  shingles are either in the original or not. Both bounds and the signature distance are part of the join. So a large
  group of copies costs a few rows a member, not all pairs, and yet every pair under the distance is confirmed,
  ruled out or already connected.
* Links are confirmed on the full sets: 100 * intersection >= percent * union.

Defined results: without words a document has an empty set and no link; with fewer words than a shingle its whole
word sequence is one; rows that repeat a doc_id are one document, linked to all that any of its rows is linked to;
rows with a null doc_id take no part, have a null component and are kept; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import dense_ids
from ..session import broadcast_if_small
from .common import hash_pair, materialize
from .components import connected_components
from .hashing import mix, shingle_sets

SLOTS = 32
SLOT_BITS = 16
CHUNK = 4
DISTANCE = 15  # every pair within it is found
CONFIRMED = 18  # pairs found beyond it are confirmed up to here

_SLOT_SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_SLOT_FACTORS = mix(np.arange(101, SLOTS + 101, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS 16-bit values for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    found = np.empty((len(sets), SLOTS), np.int32)
    for i in range(SLOTS):
        low = np.minimum.reduceat((flat ^ _SLOT_SEEDS[i]) * _SLOT_FACTORS[i], starts)
        found[:, i] = (mix(low) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32)
    return found


def _keys() -> Column:
    """Exact 64-bit keys: for each chunk and each slot left out, the other slots' values and which those are."""
    keys = []
    for first in range(0, SLOTS, CHUNK):
        for out in range(first, first + CHUNK):
            text = f"{out}L"
            for slot in range(first, first + CHUNK):
                if slot != out:
                    text = f"({text} * {1 << SLOT_BITS}L + sig[{slot}])"
            keys.append(F.expr(text))
    return F.explode(F.array(*keys))


def _in_slices(sets: Iterator[np.ndarray], most: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for s in sets:
        held.append(s)
        size += len(s)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _lists(values: np.ndarray, present: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with the rows of ``values`` where ``present``, else empty lists."""
    offsets = np.concatenate([[0], np.cumsum(np.where(present, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.reshape(-1), kind))


def shingle_features(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, s1, s2, sig): set size, 128-bit hash of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _in_slices(shingle_sets(batch.column(1), width)):
                sizes = np.array([len(s) for s in sets], np.int64)
                present = sizes > 0
                full = [s for s in sets if len(s)]
                with np.errstate(over="ignore"):
                    s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    s2 = np.array([mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
                    sig = signatures(full) if full else np.zeros((0, SLOTS), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)), pa.array(sizes), pa.array(s1.view(np.int64)),
                     pa.array(s2.view(np.int64)), _lists(sig, present, pa.int32())],
                    names=["id", "n", "s1", "s2", "sig"],
                )
                at += len(sets)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id bigint, n bigint, s1 bigint, s2 bigint, sig array<int>"
    )


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _in_slices(shingle_sets(batch.column(1), width)):
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                made = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), made], names=["id", "set"])
                at += len(sets)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id bigint, set array<bigint>"
    )


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, both, linked): how many shingles the pairs' full sets share, and whether they are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, good = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                shared[i], good[i] = both, 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(good)],
                                             names=["u", "v", "both", "linked"])

    joined = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v"
    )
    return materialize(joined.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint, both bigint, linked boolean"))


def _close(a: str, b: str, percent: int, hub: bool = False) -> Column:
    """Whether two rows (n, alone, sig), named by prefixes, may be similar enough: own shingles, signature distance.

    With ``hub``, the rows also have how many shingles of one and the same hub they have at most, and how many others
    that are not their own.
    """
    n_a, n_b, own_a, own_b = (F.col(f"{x}{c}") for c in ("n", "alone") for x in (a, b))
    most = F.least(n_a - own_a, n_b - own_b)
    if hub:
        most = F.least(most, F.least(f"{a}in_hub", f"{b}in_hub") + F.least(f"{a}beside", f"{b}beside"))
    fits = most * 100 >= (n_a + n_b - most) * percent
    unlike = F.aggregate(F.zip_with(f"{a}sig", f"{b}sig", lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x)
    return fits & (unlike <= CONFIRMED)


def _first_key(a: str, b: str) -> Column:
    """Number of the first key under which two signatures meet; null if they meet under none."""
    found = []
    for first in range(0, SLOTS, CHUNK):
        unlike = [f"{a}sig[{i}] <> {b}sig[{i}]" for i in range(first, first + CHUNK)]
        errors = " + ".join(f"CAST({u} AS INT)" for u in unlike)
        left_out = " ".join(f"WHEN {u} THEN {first + i}" for i, u in enumerate(unlike))
        found.append(f"CASE WHEN {errors} <= 1 THEN CASE {left_out} ELSE {first} END END")
    return F.expr(f"coalesce({', '.join(found)})")


def _alone(sets: DataFrame) -> DataFrame:
    """(id, alone): how many shingles of a document no other of these documents has; 0 for an id with several texts."""
    spread = sets.select("id", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    single = spread.where("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    texts = sets.groupBy("id").agg(F.count("*").alias("texts"))
    return texts.join(single, "id", "left").select(
        "id", F.when(F.col("texts") == 1, F.coalesce("alone", F.lit(0))).otherwise(0).alias("alone"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component): one row per row of ``docs``; the component is the smallest id reachable."""
    features = materialize(shingle_features(docs, id_col, text_col, width))
    known = features.where("id IS NOT NULL AND n > 0")
    classes = materialize(known.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep")))
    whole = known.join(classes.withColumnRenamed("rep", "id"), ["s1", "s2", "n", "id"], "left_semi")
    whole = materialize(whole.dropDuplicates(["s1", "s2", "n"]).select("id", "n", "sig"))
    keyed = whole.select("id", _keys().alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    members = materialize(keyed.join(shared, "key"))

    wanted = members.select(F.col("id").alias(id_col)).distinct()
    sets = materialize(full_sets(docs.join(wanted, id_col, "left_semi"), id_col, text_col, width))
    facts = whole.join(_alone(sets), "id").where((F.col("n") - F.col("alone")) * 100 >= F.col("n") * percent)
    rows = materialize(members.join(facts, "id").select("key", "id", "n", "alone", "sig"))

    fields = ["id", "n", "alone", "sig"]
    centre = F.min_by(F.struct(*fields), F.struct("alone", "id")).alias("hub")
    hubs = rows.groupBy("key").agg(centre, F.count("*").alias("c")).where("c > 1")
    hubs = materialize(hubs.select("key", *[F.col(f"hub.{c}").alias(f"b_{c}") for c in fields]))
    named = rows.select("key", *[F.col(c).alias(f"a_{c}") for c in fields])
    beside = named.join(hubs, "key").where((F.col("a_id") != F.col("b_id")) & _close("a_", "b_", percent))
    near = F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v")
    tested = materialize(beside.select(*near).distinct())
    checked = _confirm(tested, sets, percent)
    links = checked.where("linked").select("u", "v")

    labels = materialize(rows.select("id").distinct().join(connected_components(links), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")))
    marked = rows.join(labels, "id")
    spread = marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = marked.join(materialize(spread.where("low < high").select("key")), "key")
    rest = rest.join(hubs.select("key", F.col("b_id").alias("hub")), "key")
    rest = rest.withColumn("u", F.least("id", "hub")).withColumn("v", F.greatest("id", "hub"))
    rest = rest.join(checked.select("u", "v", "both"), ["u", "v"], "left")
    shared = F.col("n") - F.col("alone")  # with anyone; the hub has all of its own
    rest = materialize(rest.select(
        "key", *fields, "component", F.coalesce("both", shared).alias("in_hub"),
        F.when(F.col("id") == F.col("hub"), 0).otherwise(shared - F.coalesce("both", F.lit(0))).alias("beside"),
    ))
    every = (*fields, "component", "in_hub", "beside")
    a = rest.select("key", *[F.col(c).alias(f"a_{c}") for c in every])
    b = rest.select(F.col("key").alias("b_key"), *[F.col(c).alias(f"b_{c}") for c in every])
    across = (F.col("key") == F.col("b_key")) & (F.col("a_component") < F.col("b_component"))
    across = across & _close("a_", "b_", percent, hub=True)
    across = across & (F.shiftright("key", 3 * SLOT_BITS) == _first_key("a_", "b_"))  # a pair comes once, not under every key
    pairs = materialize(a.join(b, across).select(*near).distinct().join(tested, ["u", "v"], "left_anti"))
    links = links.unionByName(_confirm(pairs, sets, percent).where("linked").select("u", "v"))

    copies = known.join(classes, ["s1", "s2", "n"]).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    found = connected_components(links.unionByName(copies))
    return features.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component")
    )


def told_apart(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with a new column ``name``, an id of its own for each text of each id; equal (id, text) rows become one.

    Ids that belong to one row stay. Rows with a null id, or an id that repeats, get ids behind all others, in the order of
    (id, hash of id and text) with null ids last. Only those rows are ranked; of rows equal in (id, text) the one with
    the smallest hash of all columns stays.
    """
    own = F.col(id_col).cast("bigint")
    odd = materialize(docs.groupBy(own.alias("_odd")).agg(F.count("*").alias("_n")).where("_odd IS NULL OR _n > 1").select("_odd"))
    few = broadcast_if_small(odd)
    same = own.eqNullSafe(F.col("_odd"))
    plain = docs.join(few, same, "left_anti").withColumn(name, own)
    if odd.isEmpty():
        return plain
    last = plain.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    k1, k2 = hash_pair(own, F.col(text_col))
    row = F.struct(F.xxhash64(*[F.col(c) for c in docs.columns]).alias("_row_hash"), *[F.col(c) for c in docs.columns])
    single = docs.join(few, same, "left_semi").groupBy(own.alias("_id"), k1.alias("_k1"), k2.alias("_k2")).agg(F.min(row).alias("_row"))
    ranked = dense_ids(single, [F.col("_id").isNull(), F.col("_id"), F.col("_k1"), F.col("_k2")], name, start=int(last) + 1)
    return plain.unionByName(ranked.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], name))
