"""Readers, writers and resumable loads."""

import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.functions import requests
from chainlens.sources import readers, schemas, writers
from chainlens.streaming import incremental


def test_positional_rename_checks_the_column_count(spark, tmp_path):
    path = str(tmp_path / "token")
    spark.range(3).select(*[F.lit(str(i)).alias(f"c{i}") for i in range(24)]).write.parquet(path)
    assert readers.read_transfers(spark, path, "token").columns == schemas.TOKEN_TRANSFER
    with pytest.raises(Exception):
        readers.read_transfers(spark, path, "native")


def test_column_pruning_survives_the_rename(spark, tmp_path):
    path = str(tmp_path / "token")
    spark.range(3).select(*[F.lit(str(i)).alias(f"c{i}") for i in range(24)]).write.parquet(path)
    plan = readers.read_transfers(spark, path, "token").select("from_address")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c5:string>" in plan


def test_gzip_json_lines(spark, tmp_path):
    record = {"id": "1", "name": "a.eth", "createdAt": "5", "owner": {"id": "0x1"}, "wrappedOwner": None}
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as file:
        file.write(json.dumps(record) + "\n")
    row = readers.read_jsonl(spark, str(tmp_path / "d.jsonl.gz"), schemas.ENS_RECORD, 2).first()
    assert (row["name"], row["owner"]["id"], row["wrappedOwner"]) == ("a.eth", "0x1", None)


def test_csv_encoding_and_preamble(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("Location,Curaçao\nnote,\n2020-01-01,5\n".encode("latin1"))
    df = readers.read_csv(spark, str(tmp_path / "x.csv"), preamble="^note")
    assert df.columns == ["Location", "Curaçao"] and df.count() == 1


def test_wide_directory(spark, tmp_path):
    for exchange, header, line in (("okx", "Location, Japan ,Japan.1,Japan,\"Korea, South\"", "2020-01-01,5,6,7,\"8\""), ("gate io", "Location,India", "2020-01-01,<1")):
        folder = tmp_path / exchange
        folder.mkdir()
        (folder / "t.csv").write_text(f"{header}\nMetric,x,x\n,,\n{line}\n")
    long = readers.read_wide_dir(spark, [str(tmp_path / "okx" / "t.csv"), str(tmp_path / "gate io" / "t.csv")])
    assert [(r[0], str(r[1]), r[2], r[3]) for r in rows(long, "cex", "date", "country", "traffic")] == [
        ("gate io", "2020-01-01", "India", 0.0), ("okx", "2020-01-01", "Japan", 5.0), ("okx", "2020-01-01", "Korea, South", 8.0)]


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "UTF-16LE"])
def test_wide_directory_splits_a_file(spark, tmp_path, encoding):
    """Rows of a file are read by several tasks, whichever block they are in; line ends may have a carriage return."""
    folder = tmp_path / "okx"
    folder.mkdir()
    for name, country in (("a", "Cura\u00e7ao"), ("b", "Japan")):
        lines = [f"Location,{country}"] + [f"2020-01-01,{i}" for i in range(2000)]
        (folder / f"{name}.csv").write_bytes("\r\n".join(lines).encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        long = readers.read_wide_dir(spark, [str(tmp_path)], encoding=encoding)
        if encoding == "ISO-8859-1":
            assert long.rdd.getNumPartitions() > 4
        found = rows(long, "country", "traffic")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == sorted((c, float(i)) for c in ("Cura\u00e7ao", "Japan") for i in range(2000))


def test_tagged_csv(spark, tmp_path):
    (tmp_path / "OKX.csv").write_text("Category: All\n\nCountry,trend\nJapan,<1\nIndia,7\n")
    df = readers.read_tagged_csv(spark, str(tmp_path), ["country", "trend"], "exchange", "file", "^(Category|Country)")
    assert rows(df) == [("India", "7", "OKX"), ("Japan", "<1", "OKX")]


def test_lines_and_walk_files(spark, tmp_path):
    walks = spark.createDataFrame([([1, 2],), ([3],)], "path array<bigint>")
    writers.write_walks(walks, str(tmp_path / "w"))
    from chainlens.operators.walks import drop_short, parse_walks

    assert rows(parse_walks(spark.read.text(str(tmp_path / "w")))) == [([1, 2],), ([3],)]
    assert rows(drop_short(parse_walks(spark.createDataFrame([("4 x 5",), (" ",)], "value string")))) == [([4, 5],)]


def test_copy_table_refuses_nulls(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    spark.createDataFrame([("a", "b", 1.0), (None, "b", 1.0)], "f string, t string, v double").write.parquet(source)
    assert writers.copy_table(spark, source, target, ["f", "t", "v"]).count() == 1
    assert not (tmp_path / "t").exists()
    assert writers.copy_table(spark, source, target, ["t", "v"]).isEmpty()
    assert spark.read.parquet(target).count() == 2


EVENT = "id int, ts int"


def test_incremental_load_keeps_ties_and_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 10), (2, 10)], EVENT)
    later = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 11), (4, 11)], EVENT)
    assert incremental.incremental_load(spark, first, path, "ts", "id") == 2
    assert incremental.incremental_load(spark, later, path, "ts", "id") == 2
    assert incremental.incremental_load(spark, later, path, "ts", "id") == 0
    assert rows(spark.read.parquet(path)) == [(1, 10), (2, 10), (3, 10), (4, 11)]


def test_file_stream_takes_each_file_once(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType())])
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(ids):
        spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", F.timestamp_seconds(F.col("id") * 60).alias("ts")).write.mode("append").parquet(source)

    add([1, 2, 2])
    incremental.load_new_files(spark, source, target, state, schema, "ts", "id")
    add([2, 3])
    incremental.load_new_files(spark, source, target, state, schema, "ts", "id")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_requests_are_json(spark):
    df = spark.createDataFrame([(1, 'say "hi"\n')], "k int, m string")
    schema = {"name": "answer", "strict": True}
    with_heat = json.loads(requests.build_requests(df, "k", "m", "sys", schema, "small", 0.0).first()["request"])
    assert with_heat["body"]["temperature"] == 0.0 and with_heat["custom_id"] == "1"
    assert with_heat["body"]["messages"][1] == {"role": "user", "content": 'say "hi"\n'}
    assert with_heat["body"]["response_format"]["json_schema"] == schema
    without = json.loads(requests.build_requests(df, "k", "m", "sys", schema, "small", None).first()["request"])
    assert "temperature" not in without["body"]


def test_responses(spark):
    df = spark.createDataFrame([("a", '{"result": "Europe"}'), ("b", "oops"), ("c", "{}")], "k string, r string")
    assert rows(requests.parse_responses(df, "k", "r")) == [("a", "Europe"), ("b", None), ("c", None)]


def test_readers_always_find_a_whole_table(spark):
    """Versions behind a view: a reader that planned on the one before still finds it whole; older ones go."""
    name = "rebuilt_view"
    try:
        assert writers.rebuild_table(spark.range(10), name) == f"{name}_v0"
        before = spark.table(name)
        assert writers.rebuild_table(spark.range(20), name) == f"{name}_v1"
        assert before.count() == 10 and spark.table(name).count() == 20
        writers.rebuild_table(spark.range(30), name)
        assert spark.table(name).count() == 30
        assert sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(name)) == [name, f"{name}_v1", f"{name}_v2"]
    finally:
        writers.drop_rebuilt(spark, name)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(name)]
    spark.range(3).write.saveAsTable("plain_one")
    try:
        with pytest.raises(ValueError):
            writers.rebuild_table(spark.range(5), "plain_one")
        assert spark.table("plain_one").count() == 3
    finally:
        spark.sql("DROP TABLE plain_one")


def test_footers_count_rows_and_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "t" / "day=1").mkdir(parents=True)
    pq.write_table(pa.table({"a": list(range(1000))}), tmp_path / "t" / "one file.parquet", row_group_size=300)
    pq.write_table(pa.table({"a": list(range(50))}), tmp_path / "t" / "day=1" / "b.parquet")
    pq.write_table(pa.table({"a": pa.array([], pa.int64())}), tmp_path / "t" / "none.parquet")
    found = readers.parquet_footers(spark, str(tmp_path / "t")).collect()
    assert sorted((r["n_rows"], r["n_row_groups"]) for r in found)[1:] == [(50, 1), (1000, 4)]
    stats = readers.table_stats(spark, str(tmp_path / "t")).first()
    assert (stats["total_rows"], stats["n_files"]) == (1050, 3) and stats["n_row_groups"] >= 5


def test_capped_split_ranks_few_rows(spark, monkeypatch):
    """A class of 40,000 rows of which 200 stay: few rows reach the ranking, and the split is the exact one."""
    from pyspark.sql import functions as F

    from chainlens.operators import sampling

    df = spark.range(41000).select(F.col("id"), F.when(F.col("id") < 40000, "big").when(F.col("id") < 40900, "small").alias("label"))
    ranked = []
    inner = sampling.hash_rank
    monkeypatch.setattr(sampling, "hash_rank", lambda rows, *rest, **more: ranked.append(rows.count()) or inner(rows, *rest, **more))
    found = {r["id"]: r["split"] for r in sampling.capped_split(df, "label", "id", 100, 100).collect()}
    assert ranked[0] < 1000
    drawn = {r["id"]: (r["label"], r["_u"]) for r in sampling._draw(df, "id", 42, "hashed").collect()}
    for label in ("big", "small", None):
        order = sorted((u, i) for i, (own, u) in drawn.items() if own == label)
        assert [found.get(i) for _, i in order] == (["train"] * 100 + ["test"] * 100 + [None] * len(order))[:len(order)]


def test_classes_that_fall_short_of_their_limit_are_ranked_whole(spark, monkeypatch):
    from pyspark.sql import functions as F

    from chainlens.operators import sampling

    df = spark.range(5000).withColumn("label", F.lit("one"))
    monkeypatch.setattr(sampling, "_draw", lambda rows, *rest: rows.withColumn("_u", 0.9 + F.col("id") / 100000))  # none below the limit
    found = {r["id"]: r["split"] for r in sampling.capped_split(df, "label", "id", 10, 5).collect()}
    assert found == {i: "train" if i < 10 else "test" for i in range(15)}
