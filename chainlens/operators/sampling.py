"""Reproducible class-wise splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import UNIFORMS
from ..session import broadcast_if_small, materialize
from .ranking import hash_rank


def _draw(df: DataFrame, key: str, seed: int, uniform: str) -> DataFrame:
    return df.withColumn("_u", F.expr(UNIFORMS[uniform](key, 0, seed)))


def _ranked(df: DataFrame, label: str, key: str, seed: int, uniform: str) -> DataFrame:
    return hash_rank(_draw(df, key, seed, uniform), [label], "_u", [key], "_rank", total="_size").drop("_u")


def _lowest(df: DataFrame, label: str, draw: str, k: int) -> DataFrame:
    """Rows that can be among the ``k`` lowest draws of their class: those below a limit from the class's size.

    The limit leaves about k + 6 sqrt(k) rows of a class; classes that fall short of k all the same keep all their rows. So only
    rows near the kept ones are ranked and shuffled, and the result is exact.
    """
    room = F.lit(float(k) + 6.0 * float(k) ** 0.5 + 20.0)
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_rows"))
    limits = materialize(sizes.withColumn("_limit", F.least(F.lit(1.0), room / F.col("_rows"))))

    def below(table: DataFrame) -> DataFrame:
        same = F.col(label).eqNullSafe(F.col("_class"))
        return df.join(broadcast_if_small(table), same).filter(F.col(draw) <= F.col("_limit"))

    found = below(limits.filter("_limit < 1")).groupBy(F.col("_class").alias("_found")).agg(F.count("*").alias("_left"))
    both = limits.join(found, F.col("_class").eqNullSafe(F.col("_found")), "left")
    settled = both.select("_class", F.when(F.col("_left") >= k, F.col("_limit")).otherwise(F.lit(1.0)).alias("_limit"))
    return below(materialize(settled)).drop("_class", "_limit")


def capped_split(df: DataFrame, label: str, key: str, n_train: int = 10_000, n_test: int = 10_000, seed: int = 42,
                 uniform: str = "hashed") -> DataFrame:
    """Adds ``split``: the first ``n_train`` rows of each class in random order, then the next ``n_test``; others leave."""
    rank = F.col("_rank")
    part: Column = F.when(rank <= n_train, F.lit("train")).when(rank <= n_train + n_test, F.lit("test"))
    drawn = _lowest(_draw(df, key, seed, uniform), label, "_u", n_train + n_test)
    ranked = hash_rank(drawn, [label], "_u", [key], "_rank").drop("_u").withColumn("split", part)
    return ranked.filter(F.col("split").isNotNull()).drop("_rank")


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.3, seed: int = 42,
                     uniform: str = "hashed") -> DataFrame:
    """Adds ``split``: the same exact share of every class goes to test."""
    cut = F.round(F.col("_size") * F.lit(test_fraction))
    ranked = _ranked(df, label, key, seed, uniform)
    return ranked.withColumn("split", F.when(F.col("_rank") <= cut, "test").otherwise("train")).drop("_rank", "_size")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, uniform: str = "hashed",
                     out: str = "fold") -> DataFrame:
    """Adds ``fold`` 0..k-1 with class counts that differ by at most one between folds."""
    ranked = _ranked(df, label, key, seed, uniform)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")
