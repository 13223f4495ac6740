"""Name cleaning and fuzzy name matching."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .name_kernels import Candidates, similarities

# Characters that separate words in an exchange name; parentheses are deleted instead.
_SEPARATORS = r"[ ,.;:|&'\"+\-/]"
# Reverse suffix, the placeholder name and the shape of hex-only domain names.
_REVERSE_SUFFIX = ".addr.reverse"
_REVERSE_NAME = "reverse"
_HEX_NAME = r"^[0-9a-fA-F]{16,}\z"

# Exchange names as they differ between the address list and the trend and traffic data.
CEX_TREND_NAMES = {
    "Biconomy": "Biconomy_com",
    "Coinbase": "Coinbase Exchange",
    "Crypto.com Exchange": "Crypto_com",
    "Gate.io": "Gate",
    "XT.COM": "XT_com",
}
CEX_TRAFFIC_NAMES = {
    "btcturk": "btcTurk kripto",
    "gate.io": "gate",
    "crypto.com exchange": "crypto.comexchange",
    "xt": "xt.com",
}

CANDIDATE_LIMIT = 5_000


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_name(name: Column | str) -> Column:
    """Lower-cased words joined by one space; separators cut words, parentheses vanish."""
    words = F.split(F.translate(F.lower(_column(name)), "()", ""), _SEPARATORS)
    joined = F.array_join(F.filter(words, lambda w: w != ""), " ")
    return F.regexp_replace(joined, r"(?U)^\s+|\s+$", "")


def clean_ens(name: Column | str) -> Column:
    """Domain name without suffixes and outer brackets; null for placeholders and pure hex."""
    value = _column(name)
    short = F.regexp_replace(value, r"\.eth\z", "")
    plain = F.when(short.endswith(_REVERSE_SUFFIX), F.replace(short, F.lit(_REVERSE_SUFFIX), F.lit(""))).otherwise(short)
    bare = F.regexp_replace(plain, r"^[\[\]]+|[\[\]]+\z", "")
    return F.when((plain != _REVERSE_NAME) & ~bare.rlike(_HEX_NAME), bare)


def levenshtein_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty names are equal."""
    a, b = _column(a), _column(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


METHODS = ("lev", "dam_lev", "jaro", "jaro_win")


def name_similarity(a: Column | str, b: Column | str, method: str = "lev") -> Column:
    """Similarity of two names in [0, 1] by edit distance, Damerau distance, Jaro or Jaro-Winkler."""
    if method == "lev":
        return levenshtein_similarity(a, b)

    @F.pandas_udf("double")
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        given = left.notna() & right.notna()
        found = pd.Series(index=left.index, dtype="float64")
        found[given] = similarities(left[given].tolist(), right[given].tolist(), method)
        return found

    return scored(_column(a), _column(b))


def match_top(names: DataFrame, candidates: DataFrame, n: int = 1, method: str = "lev",
              limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """(name, score, match): the ``n`` best candidates per distinct name, equal scores by the larger string.

    Letters in common bound a similarity from above; a name's candidates are scored by falling bound, until none can reach its
    nth score. The lists are never empty, and an outer explode keeps Spark from testing that, with the whole
    score inside the test, on the rows below the distinct. Up to ``limit`` candidates travel with the expression. Beyond it
    they are packed into lists that meet every name by key, and only the ``n`` best per list move on to the final choice.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    name, other = names.columns[0], candidates.columns[0]
    distinct_names = names.select(F.col(name).alias("name")).filter(F.col(name).isNotNull()).distinct()
    pool = candidates.select(F.col(other).alias("match")).filter(F.col(other).isNotNull()).distinct()
    taken = pool.take(limit + 1)
    if len(taken) <= limit:
        listed = sorted(row[0] for row in taken)
        if not listed:
            return distinct_names.select("name", F.lit(0.0).alias("score"), F.lit("").alias("match")).limit(0)
        ranked = distinct_names.withColumn("_best", _ranked("name", listed, n, method))
        return ranked.select("name", F.explode_outer("_best").alias("_hit")).select("name", "_hit.score", "_hit.match")
    packs = math.ceil(pool.count() / limit)
    salts = max(1, math.ceil(distinct_names.count() / limit))
    packed = pool.groupBy(F.pmod(F.xxhash64("match"), F.lit(packs)).alias("pack")).agg(
        F.collect_list("match").alias("list")
    )
    copies = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = distinct_names.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).withColumn(
        "pack", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(packs - 1).cast("bigint")))
    )

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pool_list = [c for part in right["list"] for c in part]
        asked = left["name"].tolist()
        hits = Candidates(pool_list, method).best(asked, n)
        rows = [(x, s, c) for x, own in zip(asked, hits, strict=True) for s, c in own]
        return pd.DataFrame(rows, columns=["name", "score", "match"])

    per_pack = spread.groupBy("pack", "salt").cogroup(copies.groupBy("pack", "salt")).applyInPandas(
        choose, "name string, score double, match string"
    )
    best = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "match")))), 1, n)
    merged = per_pack.groupBy("name").agg(best.alias("_best"))
    return merged.select("name", F.explode_outer("_best").alias("_hit")).select("name", "_hit.score", "_hit.match")


def _ranked(name: str, listed: list[str], n: int, method: str) -> Column:
    @F.pandas_udf("array<struct<score: double, match: string>>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pool = Candidates(listed, method)
        for values in batches:
            yield pd.Series([[{"score": s, "match": c} for s, c in own] for own in pool.best(values.tolist(), n)])

    return best(F.col(name))
