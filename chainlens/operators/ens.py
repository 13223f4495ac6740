"""Domain-name records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ens_owner(records: DataFrame) -> DataFrame:
    """Adds ``resolved_owner``: the wrapped owner if present, else the owner; needs a name and one of them."""
    owner = F.coalesce(F.col("wrappedOwner.id"), F.col("owner.id"))
    return records.withColumn("resolved_owner", owner).filter(
        (F.col("name") != "") & F.col("resolved_owner").isNotNull()
    )


def last_wins(records: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """One row per key with the value of the last record in ``order`` (which must be unique per key)."""
    return records.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
