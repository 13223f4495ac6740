"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return array_sum(F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0.0 when either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def inverse_euclidean(a: Column | str, b: Column | str) -> Column:
    """1 / distance; null for equal vectors."""
    gap = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.try_divide(F.lit(1.0), norm(gap))


def inverse_quadratic(a: Column | str, b: Column | str) -> Column:
    inverse = inverse_euclidean(a, b)
    return inverse * inverse


SIMILARITIES = {
    "cosine": cosine_similarity,
    "inverse_euclidean": inverse_euclidean,
    "inverse_quadratic": inverse_quadratic,
}


def l2_normalize(a: Column | str) -> Column:
    """v / |v|; null elements for a zero vector. The length is taken once, in the final step of the sum."""
    column = _column(a)
    return F.aggregate(
        column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.transform(column, lambda x: F.try_divide(x.cast("double"), F.sqrt(total))),
    )


def softmax_array(a: Column | str) -> Column:
    """exp(x - max) / sum over one row's array; maximum and sum are taken once per row."""
    column = _column(a)

    def scaled(top: Column) -> Column:
        return F.aggregate(
            column, F.lit(0.0), lambda total, x: total + F.exp(x - top),
            lambda total: F.transform(column, lambda x: F.exp(x - top) / total),
        )

    return F.aggregate(F.array(F.lit(1)), F.array_max(column), lambda top, _: top, scaled)


def one_hot(index: Column | str, size: int) -> Column:
    """Array of ``size`` zeros with a one at the 0-based ``index``."""
    at = _column(index)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == at, 1).otherwise(0))


def argmax(values: Column | str) -> Column:
    """0-based position of the largest element; the first one wins a tie."""
    column = _column(values)
    return F.array_position(column, F.array_max(column)) - 1


def top_k_positions(values: Column | str, k: int) -> Column:
    """0-based positions of the ``k`` largest, best first; among equals the later position comes first."""
    marked = F.transform(_column(values), lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return F.transform(F.slice(F.reverse(F.array_sort(marked)), 1, k), lambda s: s["i"])
