"""URL filters: allow and block rules, and a character language-model ratio for what no rule fits.

Main path: DataFrame functions only.

* The longest rule that fits a url decides. A rule ``host/path`` fits its host and all subdomains, if the url's path starts
  with the rule's path.
* Urls that a rule allows or blocks train two Markov models of variable order (contexts of 0 to 3 characters), smoothed
  by Witten-Bell: P(x | c) = (n(cx) + t(c) P(x | shorter c)) / (n(c) + t(c)), where t(c) is the number of different
  characters seen after c, down to 1 / ALPHABET. Urls are modelled from the host on, lower-cased, with runs of digits
  as 0 and unusual characters as one symbol, so there are at most ALPHABET**4 windows of four characters, whatever the input.
* A url's score is the mean over its characters of log P(allowed) - log P(blocked). The threshold lies as many standard
  deviations below the mean score of the allowed training urls as above that of the blocked ones. A score at or above it is allowed.
* Equal urls are counted once with their number; a window's log ratio is computed once and joined to the urls by
  broadcast where a count proves the table short, else by key.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the model's verdict on the empty
string; without training urls of both kinds what no rule fits is allowed; repeated rows get one result each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import ascii_lower, materialize

RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
ORDER = 3
ALPHABET = 64
# What is kept besides letters; digits become 0, anything else *, and ^ and $ are the ends.
_KEPT = r"[^a-z0./?#=&_%:~+\-]"


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    rest = F.coalesce(_after(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls where none fits. ``rules`` are a short list, part of the plan."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        own, slash, tail = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def modelled(url: Column) -> Column:
    """The string that is modelled, without its ends."""
    digits = F.regexp_replace(ascii_lower(F.coalesce(_after(url), F.lit(""))), "[0-9]+", "0")
    return F.regexp_replace(digits, _KEPT, "*")


def _windows(text: Column) -> Column:
    """ORDER + 1 characters ending at each character and at the end mark."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def window_ratios(windows: DataFrame) -> DataFrame:
    """(w, ratio): log P(allowed) - log P(blocked) of the last character. ``windows``: w and its counts good and bad."""
    split = windows.select(
        "w", "good", "bad", F.substring("w", ORDER + 1, 1).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k")
    ).withColumn("c", F.substring("w", F.lit(ORDER + 1) - F.col("k"), F.col("k")))
    grams = split.groupBy("c", "x").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    grams = materialize(grams)
    contexts = grams.groupBy("c").agg(
        *[f(kind) for kind in ("good", "bad") for f in (
            lambda k: F.sum(k).alias(f"n_{k}"), lambda k: F.sum((F.col(k) > 0).cast("bigint")).alias(f"t_{k}"))]
    )
    shares = []
    for kind in ("good", "bad"):
        size = F.col(f"n_{kind}") + F.col(f"t_{kind}")
        shares += [F.coalesce(F.try_divide(F.col(kind), size), F.lit(0.0)).alias(f"a_{kind}"),
                   F.coalesce(F.try_divide(F.col(f"t_{kind}"), size), F.lit(1.0)).alias(f"b_{kind}")]
    parts = materialize(grams.join(broadcast_if_small(contexts), "c").select("c", "x", *shares))
    found = split.select("w", "k", "c", "x").join(broadcast_if_small(parts), ["c", "x"])
    by_order = found.groupBy("w").agg(*[
        F.max(F.when(F.col("k") == k, F.col(f"{p}_{kind}"))).alias(f"{p}{k}_{kind}")
        for k in range(ORDER + 1) for p in "ab" for kind in ("good", "bad")
    ])
    chance = {}
    for kind in ("good", "bad"):
        p = F.lit(1.0 / ALPHABET)
        for k in range(ORDER + 1):
            p = F.col(f"a{k}_{kind}") + F.col(f"b{k}_{kind}") * p
        chance[kind] = p
    return by_order.select("w", (F.log(chance["good"]) - F.log(chance["bad"])).alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold), one row a page."""
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"), modelled(F.col(url_col)).alias("_text"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("_ruled", verdict)
    texts = materialize(parsed.groupBy("_text").agg(
        F.sum((F.col("_ruled") == "allow").cast("bigint")).alias("good"), F.sum((F.col("_ruled") == "block").cast("bigint")).alias("bad"),
    ).na.fill(0, ["good", "bad"]))
    spread = texts.select("_text", "good", "bad", F.explode(_windows(F.col("_text"))).alias("w"))
    windows = materialize(spread.groupBy("w").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    ratios = materialize(window_ratios(windows))
    scores = spread.join(broadcast_if_small(ratios), "w").groupBy("_text").agg(
        F.avg("ratio").alias("score"), F.first("good").alias("good"), F.first("bad").alias("bad")
    )
    scores = materialize(scores)
    fit = [scores.agg(
        F.try_divide(F.sum(F.col("score") * F.col(k)), F.sum(k)).alias("mean"),
        F.try_divide(F.sum(F.col("score") * F.col("score") * F.col(k)), F.sum(k)).alias("square"),
    ).first() for k in ("good", "bad")]
    threshold = None
    if all(f["mean"] is not None for f in fit):
        mean, spreads = [f["mean"] for f in fit], [max(f["square"] - f["mean"] ** 2, 1e-12) ** 0.5 for f in fit]
        threshold = (mean[0] * spreads[1] + mean[1] * spreads[0]) / (spreads[0] + spreads[1])
    by_model = F.when(F.lit(threshold is None) | (F.col("score") >= F.lit(threshold)), "allow").otherwise("block")
    return parsed.join(scores.select("_text", "score"), "_text", "left").select(
        id_col, "host", "path", "rule", F.coalesce("_ruled", by_model).alias("verdict"), "score",
        F.lit(threshold).cast("double").alias("threshold"),
    )
