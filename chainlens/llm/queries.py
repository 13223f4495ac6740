"""One query per operator with production parameters, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .chat import repair_conversations
from .exact_topk import exact_top_k
from .language_id import predict_languages
from .common import scratch_path
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dups import near_duplicates
from .packing import pack
from .prefix_trie import ordered_turns, prefix_trie, rebuilt_turns
from .quality import classify
from .scans import ordered_digests
from .structure import damage_turns, repair_structure
from .quality_rules import CURRENT, POLICIES, build_ledger, judge, write_ledger
from .url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle.strip()
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, t.pos, t.line,
         translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS pos) t
),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id > f.first_doc, FALSE) AS gone
  FROM lines l LEFT JOIN firsts f ON l.key = f.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query("op4_line_dedup", _LINES_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


_NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_have AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT u, v FROM both_have JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 85 * (x.n + y.n - c)
),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.id
)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id
JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id
"""


@_query("op10_minhash_near_dedup", _NEAR_SQL)
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), percent=85)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


@_query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def _word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), _word_tokenizer())


@_query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(
           translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'),
           '[^a-z0./?#=&_%:~+\-]', '*', 'g') AS txt
  FROM cut
),
rules(rule, decision, own, tail) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
  ('com/de/', 'block', 'com', '/de/')
),
parsed AS (
  SELECT s.*, (SELECT {'rule': r.rule, 'decision': r.decision} FROM rules r
               WHERE (s.host = r.own OR ends_with(s.host, '.' || r.own)) AND starts_with(s.path, r.tail)
               ORDER BY length(r.rule) DESC LIMIT 1) AS hit
  FROM split s
),
texts AS (
  SELECT txt, CAST(coalesce(sum(CASE WHEN hit.decision = 'allow' THEN 1 END), 0) AS BIGINT) AS good,
         CAST(coalesce(sum(CASE WHEN hit.decision = 'block' THEN 1 END), 0) AS BIGINT) AS bad
  FROM parsed GROUP BY txt
),
spread AS (
  SELECT txt, good, bad, substr('^^^' || txt || '$', i, 4) AS w
  FROM (SELECT *, unnest(range(1, length(txt) + 2)) AS i FROM texts)
),
windows AS (SELECT w, sum(good) AS good, sum(bad) AS bad FROM spread GROUP BY w),
orders AS (SELECT w, good, bad, k, substr(w, 4, 1) AS x, substr(w, 4 - k, k) AS c FROM windows, (SELECT unnest(range(0, 4)) AS k)),
grams AS (SELECT c, x, sum(good) AS good, sum(bad) AS bad FROM orders GROUP BY c, x),
contexts AS (
  SELECT c, sum(good) AS ng, sum(bad) AS nb, count(*) FILTER (WHERE good > 0) AS tg, count(*) FILTER (WHERE bad > 0) AS tb
  FROM grams GROUP BY c
),
parts AS (
  SELECT c, x, CASE WHEN ng + tg > 0 THEN CAST(good AS DOUBLE) / (ng + tg) ELSE 0 END AS ag,
         CASE WHEN ng + tg > 0 THEN CAST(tg AS DOUBLE) / (ng + tg) ELSE 1 END AS bg,
         CASE WHEN nb + tb > 0 THEN CAST(bad AS DOUBLE) / (nb + tb) ELSE 0 END AS ab,
         CASE WHEN nb + tb > 0 THEN CAST(tb AS DOUBLE) / (nb + tb) ELSE 1 END AS bb
  FROM grams JOIN contexts USING (c)
),
ratios AS (
  SELECT o.w, ln(max(p.ag) FILTER (WHERE k = 3) + max(p.bg) FILTER (WHERE k = 3) * (
             max(p.ag) FILTER (WHERE k = 2) + max(p.bg) FILTER (WHERE k = 2) * (
             max(p.ag) FILTER (WHERE k = 1) + max(p.bg) FILTER (WHERE k = 1) * (
             max(p.ag) FILTER (WHERE k = 0) + max(p.bg) FILTER (WHERE k = 0) / 64)))) -
         ln(max(p.ab) FILTER (WHERE k = 3) + max(p.bb) FILTER (WHERE k = 3) * (
             max(p.ab) FILTER (WHERE k = 2) + max(p.bb) FILTER (WHERE k = 2) * (
             max(p.ab) FILTER (WHERE k = 1) + max(p.bb) FILTER (WHERE k = 1) * (
             max(p.ab) FILTER (WHERE k = 0) + max(p.bb) FILTER (WHERE k = 0) / 64)))) AS ratio
  FROM orders o JOIN parts p ON p.c = o.c AND p.x = o.x GROUP BY o.w
),
scores AS (
  SELECT s.txt, avg(r.ratio) AS score, first(s.good) AS good, first(s.bad) AS bad FROM spread s JOIN ratios r ON r.w = s.w GROUP BY s.txt
),
means AS (
  SELECT sum(score * good) / sum(good) AS mg, sum(score * score * good) / sum(good) AS qg,
         sum(score * bad) / sum(bad) AS mb, sum(score * score * bad) / sum(bad) AS qb FROM scores
),
fit AS (
  SELECT (mg * sqrt(greatest(qb - mb * mb, 1e-12)) + mb * sqrt(greatest(qg - mg * mg, 1e-12)))
         / (sqrt(greatest(qg - mg * mg, 1e-12)) + sqrt(greatest(qb - mb * mb, 1e-12))) AS threshold FROM means
)
SELECT p.page_id, p.host, p.path, p.hit.rule AS rule,
       coalesce(p.hit.decision, CASE WHEN f.threshold IS NULL OR s.score >= f.threshold
         THEN 'allow' ELSE 'block' END) AS verdict
FROM parsed p LEFT JOIN scores s ON s.txt = p.txt, fit f
"""


@_query("op6_url_filter", _URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_TOP_SQL = r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


@_query("op9_exact_topk", _TOP_SQL)
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


@_query("op5_ann")
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


@_query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query("op1_chat_repair")
def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"))


_RULES_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t, row_number() OVER () AS rid,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
),
windows AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM parts WHERE len(w) >= 8)
),
repeats AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n >= 2),
covered AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM repeats) GROUP BY rid),
base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM parts LEFT JOIN covered c USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_letter_words < 8 * n_words
            OR 10 * n_upper > 4 * word_chars) AS kept
FROM base
"""


@_query("op11_quality_rules", _RULES_SQL)
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = write_ledger(build_ledger(_table(spark, sf_dir, "documents")), scratch_path(spark, "ledger"))
    return judge(ledger, POLICIES[CURRENT]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_GIVEN_SQL = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}  # state: state and role that an edit can give
_LEGAL_SQL = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def _turn_sql(state: int) -> str:
    """Least (cost, audit, repaired) of a turn in ``state``, without insertions."""
    edit = "{{'c': g{to}.c + {cost}, 'a': '{name}' || g{to}.a, 'r': {lines}}}".format
    following, given = _GIVEN_SQL[state]
    found = [edit(to=state, cost=4, name="D", lines=f"g{state}.r")]
    for initial, to in _LEGAL_SQL[state].items():
        kept = edit(to=to, cost="3 * CAST(cut AS INTEGER)", name="K", lines=f"list_prepend(role || ':' || text, g{to}.r)")
        found.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {kept} END")
    changed = edit(to=following, cost="3 + 3 * CAST(cut AS INTEGER)", name="R", lines=f"list_prepend('{given}:' || text, g{following}.r)")
    found.append(f"CASE WHEN NOT gone THEN {changed} END")
    return f"list_min([{', '.join(found)}])"


def _insert_sql(state: int) -> str:
    """Least with up to two insertions before the turn; more come back to a state."""
    found, at, cost, lines = [f"e{state}"], state, 0, []
    for _ in range(2):
        at, given = _GIVEN_SQL[at]
        cost, lines = cost + 3, [*lines, f"'{given}:'"]
        found.append(f"{{'c': e{at}.c + {cost}, 'a': '{'I' * len(lines)}' || e{at}.a, 'r': list_concat([{', '.join(lines)}], e{at}.r)}}")
    return f"list_min([{', '.join(found)}])"


_CRC_SQL = """xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b:
  list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b)),
  CAST(4294967295 AS BIGINT)), 4294967295)"""

_STRUCTURE_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
coded AS (SELECT *, {_CRC_SQL} % 20 AS code FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS tail,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged
),
marked AS (
  SELECT *, tail = '' AS blank, tail <> '' AND i > min(i) OVER (PARTITION BY conv_id, role, text) AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed
),
faulty AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND tail NOT IN ('.', '!', '?') AS cut FROM marked),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
         count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
steps AS (
  SELECT conv_id, max(i) + 1 AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS g0,
         {{'c': CAST(6 AS BIGINT), 'a': 'II', 'r': ['user:', 'assistant:']}} AS g1,
         {{'c': CAST(3 AS BIGINT), 'a': 'I', 'r': ['assistant:']}} AS g2,
         {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS g3
  FROM placed GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{_insert_sql(q)} AS g{q}' for q in range(4))}
  FROM (SELECT s.conv_id, f.i, {', '.join(f'{_turn_sql(q)} AS e{q}' for q in range(4))}
        FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1)
),
solved AS (SELECT conv_id, g0 FROM steps WHERE i = 1)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(s.g0.c, 0) AS cost,
       coalesce(s.g0.a, '') AS audit, sha256(coalesce(array_to_string(s.g0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
"""

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@_query("op12_structure_repair", _STRUCTURE_SQL)
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    repair = repair_structure(damage_turns(turns))
    lines = repair.turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "part", "at", "piece", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = ordered_digests(lines, ["conv_id"], ["part", "at", "piece"], "line", "\n")
    found = turns.select("conv_id").distinct()
    for other in (repair.faults, repair.audits, digests):
        found = found.unionByName(other, allowMissingColumns=True)
    return found.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTS],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


_TRIE_SQL = rf"""
WITH src AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
keyed AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS key FROM src),
convs AS (SELECT conv_id, {_CRC_SQL} % 6 AS h, conv_id - conv_id % 100 AS base FROM keyed),
turns AS (
  SELECT c.conv_id, 0 AS own, s.pos, s.role, s.text FROM convs c JOIN src s ON s.conv_id = c.base AND s.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, s.pos, s.role, s.text FROM convs c JOIN src s ON s.conv_id = c.conv_id AND s.pos > c.h
),
paths AS (
  SELECT c.conv_id, coalesce(t.path, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[])) AS path FROM convs c
  LEFT JOIN (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY own, pos) AS path FROM turns GROUP BY conv_id) t USING (conv_id)
),
members AS (
  SELECT conv_id, depth, path[1:depth] AS node, depth = len(path) AS last
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM paths)
),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(node[depth].t) END AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM members GROUP BY depth, node
),
below AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b ON b.node = n.node),
upward AS (SELECT own, n_children, node AS own_node, unnest(range(0, depth + 1)) AS k FROM full_nodes),
subtrees AS (
  SELECT own_node[1:k] AS node, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM upward GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s ON s.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""


@_query("op13_prefix_trie", _TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(ordered_turns(_table(spark, sf_dir, "conversations"))))
