"""Sinks: Parquet, CSV per key, text lines, JSON rows, rebuilt tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import assert_not_null

# Fixed value: rows per file that keep a transfer file near 512 MB.
ROWS_PER_FILE = 5_000_000


def write_parquet(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv_shards(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """CSV files in one folder per value of ``key``."""
    df.write.mode(mode).partitionBy(key).option("header", "true").csv(path)


def write_lines(df: DataFrame, path: str, column: str = "address", ordered: bool = True, mode: str = "overwrite") -> None:
    """One value per line; sorted lines continue from file to file."""
    lines = df.select(F.col(column).cast("string").alias("value"))
    (lines.orderBy("value") if ordered else lines).write.mode(mode).text(path)


def write_json_map(df: DataFrame, path: str, key: str, value: str, mode: str = "overwrite") -> None:
    """The map as one JSON row per key."""
    df.select(key, value).write.mode(mode).json(path)


def write_walks(walks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One walk per line, nodes separated by blanks; the folder is the merged file."""
    lines = walks.select(F.array_join(F.col("path").cast("array<string>"), " ").alias("value"))
    lines.write.mode(mode).text(path)


def copy_table(spark: SparkSession, source: str, target: str, columns: Sequence[str], mode: str = "append") -> DataFrame:
    """Load chosen columns of a Parquet path into another; returns the source rows that break NOT NULL.

    Nothing is written when there is such a row.
    """
    rows = spark.read.parquet(source).select(*columns)
    broken = assert_not_null(rows, columns)
    if broken.isEmpty():
        write_parquet(rows, target, mode=mode)
    return broken


def rebuild_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as a new version of ``name`` and point the view ``name`` at it in one statement; returns the version's name.

    Readers find the version before or the new one, whole, at any time. The version before stays for those that still read
    it; older ones are dropped. ``name`` is a view: a table of that name is an error, and nothing is written.
    """
    spark = df.sparkSession
    if any(t.name == name and t.tableType != "VIEW" for t in spark.catalog.listTables()):
        raise ValueError(f"{name} is a table, not a view over versions")
    before = _versions(spark, name)
    fresh = f"{name}_v{len(before) and int(before[-1].rpartition('_v')[2]) + 1}"
    df.write.mode("errorifexists").saveAsTable(fresh)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fresh}")
    for old in before[:-1]:
        spark.sql(f"DROP TABLE {old}")
    return fresh


def _versions(spark: SparkSession, name: str) -> list[str]:
    """Tables behind a rebuilt view, oldest first."""
    found = [t.name for t in spark.catalog.listTables(pattern=f"{name}_v*") if t.name[len(name) + 2:].isdigit()]
    return sorted(found, key=lambda n: int(n.rpartition("_v")[2]))


def drop_rebuilt(spark: SparkSession, name: str) -> None:
    """Drop a rebuilt view and its versions."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for version in _versions(spark, name):
        spark.sql(f"DROP TABLE {version}")
