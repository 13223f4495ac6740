"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, and bytes as JSON, that are safe to hold on every executor.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20


def build_session(app_name: str = "chainlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting on; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go with the tables they hold
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``; a local folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="chainlens-"))  # one for the session
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps the partitioning of ``df``."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize_bucketed(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed on ``keys``.

    Later equality joins on the keys read it in place: only the other side is shuffled, however
    often the table is joined.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"chainlens_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", scratch_path(spark, "bucketed"))
        .saveAsTable(name)
    )
    return spark.table(name)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its counted rows and bytes prove it small, else unchanged.

    Counting stops after ``max_rows`` rows; the bytes are those of the rows as JSON, an upper bound of their size but for
    long numbers. Without the mark a short table behind joins or aggregates is estimated as large, and the raw
    transfers it meets would be shuffled first. Give a materialized table where the plan behind it is long.
    """
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this library through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Drop this library's bucketed tables and their folders, at the end of a run."""
    for table in spark.catalog.listTables():
        if table.name.startswith("chainlens_") and table.tableType == "VIEW":
            spark.sql(f"DROP VIEW {table.name}")
        elif table.name.startswith("chainlens_"):
            place = spark.sql(f"DESCRIBE FORMATTED {table.name}").where("col_name = 'Location'").first()
            spark.sql(f"DROP TABLE {table.name}")
            if place and "/bucketed-" in place["data_type"]:
                remove_path(spark, place["data_type"])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
