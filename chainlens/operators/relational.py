"""General filters, deduplication, mapping, checks, set operations and reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_by


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str], **literals) -> DataFrame:
    """Renamed columns plus literal columns such as a source tag."""
    return df.withColumnsRenamed(dict(mapping)).withColumns({k: F.lit(v) for k, v in literals.items()})


def filter_isin(df: DataFrame, column: str, values: Iterable | DataFrame, negate: bool = False) -> DataFrame:
    """Membership in a short literal list or in the first column of a table; nulls are no member of anything."""
    if isinstance(values, DataFrame):
        key = values.columns[0]
        other = values.select(F.col(key).alias(column)).filter(F.col(column).isNotNull())
        return df.join(other, column, "left_anti" if negate else "left_semi")
    member = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.filter(~member if negate else member)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def drop_null_keys(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(columns))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in ``order``, which must be unique per key for a stable answer."""
    return first_by(df, keys, order)


def replace_values(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Map values, keeping those not in ``mapping`` (a dict, or a table of old and new values)."""
    if isinstance(mapping, DataFrame):
        old, new = mapping.columns[:2]
        pairs = mapping.select(F.col(old).alias(column), F.col(new).alias("_new"))
        joined = df.join(pairs, column, "left")
        return joined.withColumn(column, F.coalesce("_new", column)).select(*df.columns)
    return df.replace(dict(mapping), subset=[column])


def fill_missing(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls and NaNs become ``value``."""
    return df.fillna(value, subset=list(columns) if columns else None)


def to_number(text: Column | str, below_one: str = "<1") -> Column:
    """Text to double; the "less than one" mark is 0 and anything unreadable is null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(column == below_one, F.lit(0.0)).otherwise(column.try_cast("double"))


def drop_suffix_columns(df: DataFrame, marks: Sequence[str] = (".1", ".2", ".3")) -> DataFrame:
    """Without the columns a repeated header leaves behind; remaining headers lose outer blanks."""
    kept = [c for c in df.columns if not any(mark in c for mark in marks)]
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in kept])


def label_or_other(column: Column | str, allowed: Sequence[str], other: str = "Other") -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(other))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when the constraint holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def assert_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a null in any of ``columns``; empty when the constraint holds."""
    broken = F.lit(False)
    for column in columns:
        broken = broken | F.col(column).isNull()
    return df.filter(broken)


def map_index(df: DataFrame, index: str, axis: DataFrame, overrides: Mapping[int, str] | None = None,
              out: str = "name") -> DataFrame:
    """Position to name from a table (position, name), with manual overrides winning."""
    names = axis.select(F.col(axis.columns[0]).alias(index), F.col(axis.columns[1]).alias("_name"))
    name = F.col("_name")
    if overrides:
        pairs = [F.lit(item) for pair in overrides.items() for item in pair]
        name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(index).cast("int")), name)
    return df.join(names, index, "left").withColumn(out, name).drop("_name")


def top_n(df: DataFrame, column: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest by ``column``, ties by ``tie`` ascending."""
    return df.orderBy(F.col(column).desc(), *tie).limit(n)


def sort_axis(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def new_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str) -> DataFrame:
    """Wide to long; missing values stay as null rows."""
    return df.unpivot(list(ids), list(values), variable, value)


def pivot(df: DataFrame, rows: Sequence[str], column: str, axis: Sequence, value: str, fill=None) -> DataFrame:
    """Long to wide on a fixed axis; absent cells are null, or ``fill``."""
    wide = df.groupBy(*rows).pivot(column, list(axis)).agg(F.sum(value))
    return wide if fill is None else wide.fillna(fill, subset=[str(a) for a in axis])


def top_columns_by_mean(wide: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The ``n`` columns with the largest mean: one aggregate over the table, then a reshape of one row."""
    means = wide.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))).alias(c) for c in columns])
    return top_n(means.unpivot([], list(columns), "name", "mean").dropna(), "mean", n, ["name"])


def sort(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in zip(columns, ascending)])


def value_share(df: DataFrame, column: str, scale: float = 100.0) -> DataFrame:
    """Share of each value among the non-null rows, in percent by default."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, (F.col("n") / total * scale).alias("share"))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
