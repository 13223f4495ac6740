"""Sources: Parquet folders, CSV folders, JSON lines, text lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transfers import contract_addresses
from ..session import broadcast_if_small
from .schemas import KINDS


def read_positional(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Parquet files with columns renamed by position; a different column count is an error."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.toDF(*columns)


def read_transfers(spark: SparkSession, path: str | Sequence[str], kind: str) -> DataFrame:
    """A folder of unloaded files of one kind: token, native, label or contract."""
    return read_positional(spark, path, KINDS[kind])


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many Parquet paths as one table, columns matched by name."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_contracts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Distinct contract addresses."""
    return contract_addresses(read_union(spark, [paths] if isinstance(paths, str) else paths))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip; a gzip file is one task to read, so its rows can be spread afterwards."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
             encoding: str = "ISO-8859-1", preamble: str | None = None) -> DataFrame:
    """CSV with a header. ``preamble`` is a pattern of leading lines that are no data (matched on the first column)."""
    reader = spark.read.option("header", "true").option("encoding", encoding)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.filter(~F.coalesce(F.col(f"`{df.columns[0]}`").rlike(preamble), F.lit(False))) if preamble else df


def read_tagged_csv(spark: SparkSession, path: str, columns: Sequence[str], tag: str, tag_from: str = "folder",
                    skip: str | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless positional CSV of a whole directory tree, tagged with its folder or file name.

    Lines before the data are recognised by the pattern ``skip`` on the first column, not by line number.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("encoding", encoding).option("recursiveFileLookup", "true").csv(path)
    pattern = r"([^/]+)/[^/]+$" if tag_from == "folder" else r"([^/]+)\.[^./]+$"
    df = df.withColumn(tag, F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), pattern, 1))
    return df.filter(~F.coalesce(F.col(columns[0]).rlike(skip), F.lit(False))) if skip else df


# Marks of the columns that a repeated header leaves behind in re-saved files.
_REPEATED = (".1", ".2", ".3")
_CELLS = r""",(?=(?:[^"]*"[^"]*")*[^"]*$)"""


def _cells(line: F.Column) -> F.Column:
    """Cells of a CSV line, without quotes and outer blanks."""
    return F.transform(F.split(line, _CELLS, -1), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")))


def read_wide_dir(spark: SparkSession, paths: Sequence[str], tag: str = "cex", header_rows: str = r"^\d",
                  encoding: str = "ISO-8859-1") -> DataFrame:
    """Wide traffic CSVs (first column a date, one column per country) as long rows (tag, file, date, country, traffic).

    One scan of any number of files and folders for the rows, split as Spark splits text; the first line of each file is taken into
    a small table (a row a file) by a scan of the files' first blocks, and names that file's columns, so files of one folder may
    have different countries. A country that a header repeats, with or without blanks around it, is read from its first
    column. Only rows whose first column matches ``header_rows`` are data. Encodings whose line feed is not the one byte 10
    (UTF-16, UTF-32) cannot be split: there each file is one row.
    """
    from ..functions.dates import parse_date
    from ..operators.relational import to_number

    split = "\n".encode(encoding) == b"\n"
    reader = spark.read.option("recursiveFileLookup", "true")
    read = reader.text(list(paths), lineSep="\n") if split else reader.text(list(paths), wholetext=True)
    decoded = F.decode(F.col("value").cast("binary"), encoding)
    read = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                       decoded.alias("_line"))
    if not split:
        read = read.withColumn("_line", F.explode(F.split("_line", "\r?\n", -1)))
    read = read.withColumn("_line", F.regexp_replace("_line", "\r$", ""))
    # One task reads a file's first block in order.
    first = read.where("_start = 0").withColumn("_at", F.monotonically_increasing_id())
    files = first.groupBy("file").agg(F.min_by("_line", "_at").alias("_first")).withColumn("_header", _cells(F.col("_first")))
    marked = F.transform("_header", lambda c, i: F.named_struct(F.lit("place"), i, F.lit("country"), c))
    kept = F.filter(marked, lambda h: (h["place"] > 0) & (h["country"] != "")
                    & (F.array_position("_header", h["country"]) == h["place"] + 1)
                    & ~F.exists(F.array(*[F.lit(m) for m in _REPEATED]), lambda m: F.contains(h["country"], m)))
    headers = broadcast_if_small(files.select("file", kept.alias("_kept")))
    rows = read.where(F.col("_line").rlike(header_rows)).join(headers, "file")
    cells = rows.select("file", _cells(F.col("_line")).alias("_values"), "_kept")
    long = cells.select("file", "_values", F.get("_values", F.lit(0)).alias("_date"), F.inline("_kept"))
    return long.select(
        F.regexp_extract(F.url_decode("file"), r"([^/]+)/[^/]+$", 1).alias(tag), "file", parse_date(F.col("_date")).alias("date"),
        "country", to_number(F.get("_values", F.col("place"))).alias("traffic"),
    )


def read_lines(spark: SparkSession, path: str, out: str = "address") -> DataFrame:
    """One stripped, non-blank value per line."""
    return spark.read.text(path).select(F.trim("value").alias(out)).filter(F.col(out) != "")


def row_counts(df: DataFrame, category: str | F.Column, file: F.Column | None = None) -> DataFrame:
    """Rows per (category, file), per category, and in total; null marks a total."""
    group = F.col(category) if isinstance(category, str) else category
    source = F.col("_metadata.file_name") if file is None else file
    tagged = df.select(group.alias("category"), source.alias("file"))
    return tagged.rollup("category", "file").agg(F.count("*").alias("n"))


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_rows, n_row_groups) of every Parquet file below ``path``, from its footer alone.

    Files are listed as rows and dealt to tasks; a task reads the end of each of its files and no data. The file system has
    to be one that Arrow opens (local paths, HDFS, S3, GCS).
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    files = listed.select("path").repartition("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                system, place = FileSystem.from_uri(uri)
                with system.open_input_file(place) as source:
                    known = parquet.read_metadata(source)
                found.append((uri, known.num_rows, known.num_row_groups))
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                names=["file", "n_rows", "n_row_groups"])

    return files.mapInArrow(read, "file string, n_rows bigint, n_row_groups bigint")


def table_stats(spark: SparkSession, path: str) -> DataFrame:
    """Total rows, number of files and of row groups of a Parquet path, without a scan."""
    return parquet_footers(spark, path).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"), F.count("*").alias("n_files"),
        F.coalesce(F.sum("n_row_groups"), F.lit(0)).alias("n_row_groups"))


def table_columns(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, n_nulls) of a table; nulls are counted in one scan."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("n_nulls"))
            for i, f in enumerate(df.schema.fields)]
    return counts.select(F.inline(F.array(*rows)))
