"""Sources and sinks, as round trips of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import requests
from ..session import materialize, scratch_path
from ..sources import readers, writers
from ..sources.schemas import ENS_RECORD
from ..streaming import incremental
from .registry import query
from ..operators import relational, traffic

_LINE_COLUMNS = (
    "order_id part_id supplier_id line quantity price discount tax return_flag line_status ship_date"
).split()


@query("s1_read_transfers", """
    SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, l_extendedprice AS price FROM lineitem""")
def _(t):
    lines = readers.read_positional(t.spark, t.path("lineitem"), _LINE_COLUMNS)
    return lines.select("order_id", "supplier_id", "price")


@query("s2_read_union", """
    SELECT from_address, to_address, block_timestamp FROM token_transfer UNION ALL
    SELECT from_address, to_address, block_timestamp FROM native_transfer""")
def _(t):
    folder = scratch_path(t.spark, "union")
    for kind in ("token", "native"):
        writers.write_parquet(t[f"{kind}_transfer"].select("from_address", "to_address", "block_timestamp"), f"{folder}/{kind}")
    return readers.read_union(t.spark, [f"{folder}/token", f"{folder}/native"])


@query("s3_read_contracts", "SELECT DISTINCT address FROM contract WHERE address IS NOT NULL")
def _(t):
    path = scratch_path(t.spark, "contract")
    writers.write_parquet(t["contract"], path)
    return readers.read_contracts(t.spark, path)


@query("s4_read_jsonl", """
    SELECT CAST(created_at AS VARCHAR) AS created_at, name, owner_id, wrapped_owner_id FROM ens_domain""")
def _(t):
    path = scratch_path(t.spark, "records")

    def ref(column):
        return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("id")))

    records = t["ens_domain"].select(
        F.col("created_at").cast("string").alias("createdAt"), "name", ref("owner_id").alias("owner"),
        ref("wrapped_owner_id").alias("wrappedOwner"),
    )
    records.write.option("compression", "gzip").json(path)
    back = readers.read_jsonl(t.spark, path, ENS_RECORD)
    return back.select(
        F.col("createdAt").alias("created_at"), "name", F.col("owner.id").alias("owner_id"),
        F.col("wrappedOwner.id").alias("wrapped_owner_id"),
    )


@query("s5_read_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t):
    path = scratch_path(t.spark, "customers")
    t["customer"].select("c_custkey", "c_name", "c_acctbal").write.option("header", "true").option(
        "encoding", "ISO-8859-1").csv(path)
    return readers.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("s6_read_wide_dir", """
    SELECT cex, country, date, traffic FROM traffic WHERE country <= 'NATION_2'
    UNION ALL SELECT cex, country, date, traffic * 3 FROM traffic WHERE country > 'NATION_2'""")
def _(t):
    """Two files an exchange: one with the early countries, one with all; headers repeat a country, with blanks."""
    from .traffic_queries import COUNTRIES

    path = scratch_path(t.spark, "traffic")
    early = [c for c in COUNTRIES if c <= "NATION_2"]
    for name, axis, factor in (("a", early, 1), ("b", COUNTRIES, 3)):
        wide = relational.pivot(t["traffic"].withColumn("traffic", F.col("traffic") * factor), ["cex", "date"], "country", axis, "traffic")
        repeated = wide.select("cex", "date", *axis, F.lit(7.0).alias(f" {axis[0]}"), F.lit(8.0).alias(f"{axis[-1]}.1"))
        repeated.repartition("cex").sortWithinPartitions("cex", "date").write.partitionBy("cex").option("header", "true").csv(f"{path}/{name}")
    long = traffic.first_file_wins(readers.read_wide_dir(t.spark, [path]))
    return long.filter(F.col("traffic").isNotNull()).select(
        F.regexp_replace("cex", "^cex=", "").alias("cex"), "country", "date", "traffic"
    )


@query("s8_read_lines", "SELECT trim(line) AS address FROM text_line WHERE trim(line) <> ''")
def _(t):
    path = scratch_path(t.spark, "lines")
    t["text_line"].select("line").write.text(path)
    return readers.read_lines(t.spark, path)


@query("s9_write_parquet", "SELECT * FROM orders")
def _(t):
    path = scratch_path(t.spark, "orders")
    writers.write_parquet(t["orders"], path)
    return t.spark.read.parquet(path)


@query("s10_write_csv_shards", "SELECT contract_address, from_address, to_address, amount FROM token_transfer")
def _(t):
    path = scratch_path(t.spark, "shards")
    writers.write_csv_shards(
        t["token_transfer"].select("contract_address", "from_address", "to_address", "amount"), path, "contract_address"
    )
    schema = "from_address string, to_address string, amount double, contract_address string"
    return t.spark.read.schema(schema).option("header", "true").csv(path)


@query("s11_write_lines", "SELECT address FROM stable_user")
def _(t):
    from .graph_queries import stable_users_of

    path = scratch_path(t.spark, "users")
    writers.write_lines(stable_users_of(t), path)
    return readers.read_lines(t.spark, path)


@query("s12_write_json_map", "SELECT address, country FROM address_country")
def _(t):
    path = scratch_path(t.spark, "map")
    writers.write_json_map(t["address_country"], path, "address", "country")
    return readers.read_jsonl(t.spark, path, t["address_country"].schema)


@query("s13_copy_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "copy")
    writers.copy_table(t.spark, t.path("orders"), path, ["o_orderkey", "o_custkey", "o_totalprice"])
    return t.spark.read.parquet(path)


@query("s14_rebuild_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    name = f"chainlens_rebuilt_{uuid.uuid4().hex}"
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_totalprice")
    writers.rebuild_table(orders.withColumn("o_totalprice", F.lit(0.0)), name)
    writers.rebuild_table(orders, name)
    rebuilt = materialize(t.spark.table(name))
    writers.drop_rebuilt(t.spark, name)
    return rebuilt


@query("s15_write_walks", """
    SELECT string_agg(CAST(node AS VARCHAR), ' ' ORDER BY step) AS line FROM walk_rec_restart GROUP BY walk_id""")
def _(t):
    from .walk_queries import walks_of

    path = scratch_path(t.spark, "walks")
    writers.write_walks(walks_of(t), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@query("s16_table_columns", """
    SELECT c.ordinal_position AS ordinal, c.column_name, CASE c.data_type WHEN 'BIGINT' THEN 'bigint' ELSE 'string' END AS data_type,
           CASE c.column_name WHEN 'created_at' THEN n.a WHEN 'name' THEN n.b WHEN 'owner_id' THEN n.c ELSE n.d END AS n_nulls
    FROM (VALUES (1, 'created_at', 'BIGINT'), (2, 'name', 'VARCHAR'), (3, 'owner_id', 'VARCHAR'), (4, 'wrapped_owner_id', 'VARCHAR'))
           AS c(ordinal_position, column_name, data_type),
         (SELECT count(*) - count(created_at) AS a, count(*) - count(name) AS b, count(*) - count(owner_id) AS c,
                 count(*) - count(wrapped_owner_id) AS d FROM ens_domain) n""")
def _(t):
    return readers.table_columns(t["ens_domain"])


@query("s17_incremental_load", "SELECT event_id, ts, user_id FROM events")
def _(t):
    path = scratch_path(t.spark, "events")
    events = t["events"].select("event_id", "ts", "user_id")
    early = events.filter(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    incremental.incremental_load(t.spark, early, path, "ts", "event_id")
    incremental.incremental_load(t.spark, events, path, "ts", "event_id")
    return t.spark.read.parquet(path)


@query("s17_load_new_files", "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id FROM events")
def _(t):
    """Files in two rounds, the second with late rows and with repeats of the first; a third round finds nothing new."""
    source, target, state = (scratch_path(t.spark, label) for label in ("incoming", "loaded", "state"))
    events = t["events"].select("event_id", "ts", "user_id")
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.pmod("event_id", F.lit(7)) == 0
    stamped.where(~late).write.mode("append").parquet(source)
    for more in (stamped.where(late | (F.pmod("event_id", F.lit(11)) == 0)), None):
        incremental.load_new_files(t.spark, source, target, state, stamped.schema, "ts", "event_id", "10000 days")
        if more is not None:
            more.write.mode("append").parquet(source)
    incremental.load_new_files(t.spark, source, target, state, stamped.schema, "ts", "event_id", "10000 days")
    return t.spark.read.schema(stamped.schema).parquet(target).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_PROMPT = "Classify the message."
_SCHEMA = {"name": "answer", "schema": {"type": "object", "required": ["result"]}, "strict": True}


@query("s18_build_requests", """
    SELECT conv_id || '-' || turn AS custom_id, text AS content, 'Classify the message.' AS prompt, 'json_schema' AS kind,
           'answer' AS schema_name, CAST(NULL AS VARCHAR) AS temperature FROM conversations""")
def _(t):
    turns = t["conversations"].withColumn("row_id", F.concat_ws("-", "conv_id", "turn"))
    built = requests.build_requests(turns, "row_id", "text", _PROMPT, _SCHEMA, "small", None)

    def part(path):
        return F.get_json_object("request", path)

    return built.select(
        "custom_id", part("$.body.messages[1].content").alias("content"), part("$.body.messages[0].content").alias("prompt"),
        part("$.body.response_format.type").alias("kind"), part("$.body.response_format.json_schema.name").alias("schema_name"),
        part("$.body.temperature").alias("temperature"),
    )


@query("s19_parse_responses", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def _(t):
    return requests.parse_responses(t["events"], "event_id", "props", "k")


@query("a29_row_counts", """
    SELECT l_returnflag AS category, 'lineitem.parquet' AS file, count(*) AS n FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, NULL, count(*) FROM lineitem GROUP BY 1
    UNION ALL SELECT NULL, NULL, count(*) FROM lineitem""")
def _(t):
    return readers.row_counts(t["lineitem"], "l_returnflag")


# The given files hold up to 1,048,576 rows a row group.
@query("a31_table_stats", """
    SELECT count(*) AS total_rows, CAST(1 AS BIGINT) AS n_files, CAST(ceil(count(*) / 1048576.0) AS BIGINT) AS n_row_groups
    FROM lineitem""")
def _(t):
    return readers.table_stats(t.spark, t.path("lineitem"))
