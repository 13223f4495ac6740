"""Mixing sources to target weights by entropy balancing.

Main path: DataFrame functions only.

* Sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words. A target stops at ``most`` times
  its source's words; the excess is shared again by weight until no target is above its stop.
* Each document gets a rate between 0 and ``most``, the rates nearest to one copy each (in relative entropy) under which
  every source meets its target in words. The convex dual has one multiplier a source, and the rates are
  least(most, exp(multiplier * size / mean size)). Newton steps, kept inside a shrinking bracket, run over the table of
  (source, size) counts for all sources at once; every step is one aggregate of partial sums.
* Rates become whole copies along the order of sizes: a document takes floor(R + own) - floor(R), where R is the sum of the
  rates before it. So the copies of any range of sizes differ from its rates by less than one, and a source misses its
  target by less than its largest document. R comes from the counts, and the place among documents of one size
  from a hash of the row in two levels, so no source meets in one task. Rows that are equal in every column and many are
  counted, and one of them stands for all.
* Sums are of whole numbers (rates in units of 2**-20, words times such rates), so reruns agree to the last copy.

Defined results: a null or empty text has size 0, rate 0 and no copies; a source without words has target 0; a null source
is a source of its own; rows that repeat a doc_id are documents of their own; an empty table gives an empty
result; columns named size, source_size, target, copies or taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import dense_ids
from ..session import BROADCAST_ROWS
from .common import fingerprint, materialize, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
_UNIT = 1 << 20
_STEPS = 60
_PARTS = 256
_BLOCK = 1 << 12
_ADDED = ("size", "source_size", "target", "copies", "taken")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, docs, target) from (source, source_size, docs), one row a source.

    Weighted shares of all words with a stop at ``most`` times the own words. Each round only adds up the stopped and
    the open sources, and ends when no more stop.
    """
    ranked = dense_ids(sources, [F.col("source").isNull(), F.col("source")], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).withColumn("stop", F.col("source_size") * float(most)))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("stop")
        sums = ranked.agg(
            F.sum(F.when(above, F.col("stop"))).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count(F.when(above, F.lit(1))).alias("n"),
        ).first()
        if not sums["open"] or sums["n"] == stopped:
            break
        stopped = sums["n"]
        level = (total - (sums["fixed"] or 0.0)) / sums["open"]
    return materialize(
        ranked.withColumn("target", F.least("stop", F.col("weight") * F.lit(level))).drop("weight", "stop")
    )


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    """Rate of a document in units of 2**-20."""
    tilted = F.exp(F.least(multiplier * size / mean, F.lit(30.0)))
    return F.round(F.least(F.lit(float(most)), tilted) * _UNIT).cast("bigint")


def _beside(rows: DataFrame, table: DataFrame, sources: int) -> DataFrame:
    """``rows`` joined by sid with a table of one row a source; broadcast if so many rows are few."""
    return rows.join(F.broadcast(table) if sources <= BROADCAST_ROWS else table, "sid")


def balance(counts: DataFrame, targets: DataFrame, sources: int, most: int = MOST) -> DataFrame:
    """(sid, multiplier, mean): the dual solution of every source. ``counts`` is (sid, size, n)."""
    mean = F.col("source_size") / F.col("docs")
    reach = F.lit(18.0) * mean  # exp(18) is over most * 2**20, so even a size of 1 can reach either end
    state = materialize(targets.where("source_size > 0").select(
        "sid", "target", mean.alias("mean"), F.lit(0.0).alias("multiplier"), (-reach).alias("low"), reach.alias("high"),
        F.lit(False).alias("done"),
    ))
    for _ in range(_STEPS):
        open_now = state.where("NOT done").select("sid", "multiplier", "mean")
        rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most)
        slope = F.when(rate < most * _UNIT, F.round(rate * F.col("size") * F.col("size") / F.col("mean")))
        got = _beside(counts.where("size > 0"), open_now, sources).groupBy("sid").agg(
            (F.sum((rate * F.col("size")).cast("decimal(20,0)") * F.col("n")).cast("double") / _UNIT).alias("words"),
            (F.sum(slope.cast("decimal(20,0)") * F.col("n")).cast("double") / _UNIT).alias("slope"),
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - F.try_divide(gap, F.col("slope"))
        ended = F.col("done") | F.coalesce((F.abs(gap) <= F.col("target") * 1e-6 + 0.5) | (high - low < 1e-9), F.lit(False))
        state = materialize(state.join(got, "sid", "left").select(
            "sid", "target", "mean",
            F.when(ended, F.col("multiplier")).when((F.col("slope") > 0) & (step > low) & (step < high), step)
            .otherwise((low + high) / 2).alias("multiplier"),
            low.alias("low"), high.alias("high"), ended.alias("done"),
        ))
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("sid", "multiplier", "mean")


def _hot_classes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(k1, k2, home, hot_part, copies) of equal rows that are 1/1,024 of all or more, at most 1,024 classes, each a part of its own."""
    total = max(int(parts.agg(F.sum("n")).first()[0] or 0), 1 << 12)
    large = parts.where(F.col("n") * 1024 >= total).select("source", "size", "part", F.lit(True).alias("_large"))
    same = rows.select("source", "size", "part", "k1", "k2").alias("r").join(
        F.broadcast(large.alias("l")),  # at most 1,024 parts
        F.col("r.source").eqNullSafe(F.col("l.source")) & (F.col("r.size") == F.col("l.size")) & (F.col("r.part") == F.col("l.part")),
        "left_semi",
    )
    classes = same.groupBy("source", "size", "part", "k1", "k2").agg(F.count("*").alias("copies")).where(F.col("copies") * 1024 >= total)
    place = F.row_number().over(Window.orderBy("source", "size", "k1", "k2"))  # at most 1,024 rows
    return materialize(classes.withColumn("hot_part", (place + _PARTS).cast("bigint")).withColumnRenamed("part", "home"))


def _without(parts: DataFrame, hot: DataFrame) -> DataFrame:
    """``parts`` with the hot classes as parts of their own."""
    own = hot.select("source", "size", F.col("home").alias("part"), (-F.col("copies")).alias("n")).unionByName(
        hot.select("source", "size", F.col("hot_part").alias("part"), F.col("copies").alias("n")))
    return parts.unionByName(own).groupBy("source", "size", "part").agg(F.sum("n").alias("n")).where("n > 0")


def _repeated(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of the hot classes with their places: one row of a class stands for all, as they are equal."""
    ones = rows.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"]).groupBy("source", "size", "k1", "k2").agg(F.any_value("_row").alias("_row"))
    named = ones.join(F.broadcast(hot.select("k1", "k2", "copies", "hot_part")), ["k1", "k2"])
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(_BLOCK).cast("bigint")))
    spread = named.withColumn("_from", blocks).repartition("k1", "_from")  # a block of copies a task
    ends = F.least(F.col("_from") + _BLOCK, F.col("copies")) - 1
    return spread.withColumn("at", F.explode(F.sequence(F.col("_from"), ends))).withColumn("part", F.col("hot_part"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies (whole, 0 to ``most``) and taken (copies * size)."""
    kept = [c for c in docs.columns if c not in _ADDED]
    k1, k2 = fingerprint([F.col(c) for c in kept])
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), k1.alias("k1"), k2.alias("k2"),
    ).withColumn("part", F.pmod(F.xxhash64("k2", "k1"), F.lit(_PARTS)).cast("bigint"))
    parts = materialize(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")))
    hot = _hot_classes(rows, parts)
    parts = materialize(_without(parts, hot))
    sources = parts.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"),
    )
    targets = source_targets(sources, weights, most)
    number = targets.count()
    named = targets.select(F.col("source").alias("_source"), "sid", "source_size", "target")

    def numbered(df: DataFrame) -> DataFrame:
        table = F.broadcast(named) if number <= BROADCAST_ROWS else named
        return df.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    parts = materialize(numbered(parts).select("sid", "size", "part", "n"))
    counts = materialize(parts.groupBy("sid", "size").agg(F.sum("n").alias("n")))
    solved = balance(counts, targets, number, most)
    rated = _beside(counts.where("size > 0"), solved, number).select(
        "sid", "size", "n", _rate(F.col("multiplier"), F.col("size"), F.col("mean"), most).alias("rate")
    )
    # one row for each size that a source has
    sizes = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = materialize(rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(sizes), F.lit(0))))
    earlier = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        parts.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(rated.select("sid", "size", "rate", "before"), ["sid", "size"], "left")
        .select("sid", "size", "part", F.coalesce("rate", F.lit(0)).alias("rate"),
                (F.coalesce("before", F.lit(0)) + F.coalesce("rate", F.lit(0)) * F.col("first") + _UNIT // 2).alias("from"))
    )
    inside = Window.partitionBy("sid", "size", "part").orderBy("k1", "k2")
    few = rows.join(F.broadcast(hot), ["k1", "k2"], "left_anti")
    placed = numbered(few).withColumn("at", (F.row_number().over(inside) - 1).cast("bigint"))
    placed = placed.unionByName(numbered(_repeated(rows, hot)).select(*placed.columns)).join(starts, ["sid", "size", "part"])
    reached = F.col("from") + F.col("rate") * F.col("at")
    copies = F.shiftright(reached + F.col("rate"), 20) - F.shiftright(reached, 20)
    return placed.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    mixed = mix_sources(docs.withColumns({f"_{i}": F.col(c) for i, c in enumerate(docs.columns) if c in _ADDED}), **names)
    own = [F.col(f"_{i}").alias(c) if c in _ADDED else F.col(c) for i, c in enumerate(docs.columns)]
    return mixed.where("copies > 0").select(*own, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
