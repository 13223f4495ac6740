"""Name cleaning and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .registry import common, query

CLEAN = r"""regexp_replace(array_to_string(list_filter(
    regexp_split_to_array(replace(replace(lower({c}), '(', ''), ')', ''), '[ ,.;:|&''"+\-/]'), lambda w: w <> ''), ' '),
    '^\s+|\s+$', '', 'g')"""
common("part_name", "SELECT DISTINCT p_name AS name FROM part")
common("type_name", "SELECT DISTINCT lower(p_type || ' ' || p_brand) AS match FROM part")
common("name_pair", "SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part")


def _pairs(t):
    return t["part"].select("p_partkey", F.col("p_name").alias("a"), F.lower("p_type").alias("b"))


@query("f1_clean_name", f"SELECT doc_id, {CLEAN.format(c='text')} AS name FROM documents")
def _(t):
    return t["documents"].select("doc_id", text.clean_name("text").alias("name"))


def _similarity_query(name, method, expression):
    @query(name, f"SELECT p_partkey, round({expression}, 6) AS similarity FROM name_pair")
    def _(t):
        return _pairs(t).select("p_partkey", F.round(text.name_similarity("a", "b", method), 6).alias("similarity"))


_LONGEST = "greatest(length(a), length(b))"
_similarity_query("f2_similarity_lev", "lev", f"1 - levenshtein(a, b) / {_LONGEST}::DOUBLE")
_similarity_query("f3_similarity_dam_lev", "dam_lev", f"1 - damerau_levenshtein(a, b) / {_LONGEST}::DOUBLE")
_similarity_query("f4_similarity_jaro", "jaro", "jaro_similarity(a, b)")
_similarity_query("f5_similarity_jaro_win", "jaro_win", "jaro_winkler_similarity(a, b)")


def _match_query(name, method, score):
    @query(name, f"""
        SELECT name, round(score, 6) AS score, match FROM (
          SELECT name, match, {score} AS score,
                 row_number() OVER (PARTITION BY name ORDER BY round({score}, 12) DESC, match DESC) AS k
          FROM part_name CROSS JOIN type_name) r WHERE k <= 3""")
    def _(t):
        names = t["part"].select(F.col("p_name").alias("name"))
        candidates = t["part"].select(F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("match"))
        best = text.match_top(names, candidates, 3, method)
        return best.select("name", F.round("score", 6).alias("score"), "match")


_match_query("f6_match_top", "lev", "1 - levenshtein(name, match) / greatest(length(name), length(match))::DOUBLE")
_match_query("f6_match_top_jaro", "jaro", "jaro_similarity(name, match)")


@query("f7_clean_ens", r"""
    SELECT page_id, CASE WHEN plain = 'reverse' OR regexp_matches(bare, '^[0-9a-fA-F]{16,}$') THEN NULL ELSE bare END AS name
    FROM (SELECT page_id, plain, regexp_replace(plain, '^[\[\]]+|[\[\]]+$', '', 'g') AS bare FROM (
      SELECT page_id, CASE WHEN s LIKE '%.addr.reverse' THEN replace(s, '.addr.reverse', '') ELSE s END AS plain
      FROM (SELECT page_id, regexp_replace(name, '\.eth$', '') AS s FROM ens_name) a) b) c""")
def _(t):
    return t["ens_name"].select("page_id", text.clean_ens("name").alias("name"))


@query("f9_string_hygiene", """
    SELECT doc_id, lower(trim(line)) AS line, replace(line, 'src', 'source ') AS replaced FROM text_line""")
def _(t):
    return t["text_line"].select(
        "doc_id", F.lower(F.trim("line")).alias("line"), F.replace("line", F.lit("src"), F.lit("source ")).alias("replaced")
    )
