"""Line dedup: sorted runs of line hashes, levelled and compacted; each batch of documents is merged against them.

Main path: DataFrame functions only.

* Documents are cut into batches of rising doc_id. A batch's distinct keys are anti-joined with the runs kept so
  far (hash-partitioned and sorted by key, so that side is read in place); what is left becomes a new run of
  level 0. When ``fanout`` runs of a level exist, they are merged into one run of the next level.
* A run holds (key hash, smallest doc_id). A line goes if its key's run entry names a smaller document.
* Only hashes move until the very end; the texts are shuffled once, beside the positions to drop.
* Keys with a 1/1,024 share of all lines are at most 1,024: they are joined by broadcast. The rest is joined by key.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points always stay;
rows with a null doc_id count together as one last document; rows that repeat a doc_id belong to one document and
keep its lines; other columns are passed through, but for a column named like one that is added, which is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, fingerprint, hash_pair, materialize, remove_path, rest_of, scratch_path

_KEY = ["_h1", "_h2"]
_ROW = ["_k1", "_k2"]
_HOT_SHARE = 1024


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def _batch_of(docs: DataFrame, id_col: str, batches: int) -> Column:
    """Number of the doc_id range that a row falls into; null ids come last."""
    cuts = docs.agg(
        F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000).alias("cuts")
    ).first()["cuts"] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col(id_col) > F.lit(cut)).cast("int")
    return F.coalesce(number, F.lit(batches - 1))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(batch, key hash, doc_id, row identity, position) of every line whose key is long enough."""
    k1, k2 = fingerprint([F.col(id_col), F.col(text_col)])
    lines = docs.select(
        F.col(id_col).alias("_id"), k1.alias("_k1"), k2.alias("_k2"),
        _batch_of(docs, id_col, batches).alias("_batch"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"),
    ).withColumn("_key", line_key(F.col("_line")))
    h1, h2 = hash_pair(F.col("_key"))
    return lines.where(F.char_length("_key") >= min_chars).select(
        "_batch", "_id", "_k1", "_k2", "_pos", h1.alias("_h1"), h2.alias("_h2")
    )


class LineRuns:
    """Levelled runs of (key, smallest doc_id, number of lines, whether two documents hold it)."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Anti-join a batch's distinct keys with every run and keep the rest as a new run."""
        for run in self.runs():
            keys = keys.join(run.select(*_KEY), _KEY, "left_anti")
        self._push(0, self._sorted(keys))

    def _sorted(self, keys: DataFrame) -> DataFrame:
        parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return materialize(keys.repartition(parts, *_KEY).sortWithinPartitions(*_KEY))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            self.levels[level] = []
            self._push(level + 1, self._sorted(merged))

    def all_keys(self) -> DataFrame:
        runs = self.runs()
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged


def dropped_positions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """(_k1, _k2, _drops): row identity and the positions of the lines that go; only rows that lose some."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    _occurrences(docs, id_col, text_col, min_chars, batches).write.partitionBy("_batch").parquet(path)
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _k1 bigint, _k2 bigint, _pos int, " \
             "_h1 bigint, _h2 bigint, _batch int"
    stored = spark.read.schema(schema).parquet(path)
    runs = LineRuns(fanout)
    for batch in range(batches):
        rows = stored.where(F.col("_batch") == batch)
        runs.add(rows.groupBy(*_KEY).agg(F.min("_id").alias("_first")))
    firsts = runs.all_keys().where(F.col("_first").isNotNull())
    later = stored.select(*_ROW, "_pos", "_id", *_KEY)
    counts = later.groupBy(*_KEY).agg(F.count("*").alias("_n"))
    total = later.count()
    hot_keys = counts.where(F.col("_n") * _HOT_SHARE >= F.lit(max(total, _HOT_SHARE * 2))).select(*_KEY)
    hot_keys = materialize(hot_keys)
    hot = F.broadcast(firsts.join(F.broadcast(hot_keys), _KEY, "left_semi"))
    goes = F.col("_id").isNull() | (F.col("_id") > F.col("_first"))
    hits = (
        later.join(hot, _KEY).where(goes).select(*_ROW, "_pos")
        .unionByName(
            later.join(F.broadcast(hot_keys), _KEY, "left_anti").join(firsts, _KEY).where(goes).select(*_ROW, "_pos")
        )
    )
    drops = materialize(hits.groupBy(*_ROW).agg(F.collect_set("_pos").alias("_drops")))
    remove_path(spark, path)
    return drops


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``docs`` with the text's surviving lines joined by newline, plus n_lines (before) and n_dropped."""
    drops = dropped_positions(docs, id_col, text_col, min_chars, batches, fanout)
    k1, k2 = fingerprint([F.col(id_col), F.col(text_col)])
    rest = rest_of(docs, text_col, "n_lines", "n_dropped")
    rows = docs.select(
        F.struct(*[F.col(c) for c in rest]).alias("_rest"), k1.alias("_k1"), k2.alias("_k2"),
        F.col(text_col).isNull().alias("_null"), _lines(F.col(text_col)).alias("_all"),
    )
    joined = rows.join(drops, _ROW, "left")
    keep = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_drops")), lambda i: F.get("_all", i)
    )
    kept = F.array_join(F.when(F.col("_drops").isNull(), F.col("_all")).otherwise(keep), "\n")
    made = joined.select(
        "_rest", F.when(~F.col("_null"), kept).alias("_text"), F.size("_all").cast("bigint").alias("_n"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("bigint").alias("_d"),
    )
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return made.select(
        *[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in order],
        F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped"),
    )
