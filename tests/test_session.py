"""Broadcast checks and clean-up."""

from pyspark.sql import functions as F

from chainlens.session import broadcast_if_small, clean_up, materialize_bucketed


def marked(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert marked(broadcast_if_small(df))
    assert not marked(broadcast_if_small(df, max_rows=99))
    assert not marked(broadcast_if_small(df, max_bytes=50_000))
    assert marked(broadcast_if_small(df.limit(0)))


def test_clean_up_drops_bucketed_tables(spark):
    table = materialize_bucketed(spark.range(20), ["id"], 2)
    assert table.count() == 20
    clean_up(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chainlens_")]
