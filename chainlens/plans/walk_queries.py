"""Random walks, their statistics, and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import checking_uniform as sql_uniform
from ..functions.rng import portable_uniform
from ..operators import skipgram, walks
from ..session import materialize
from .graph_queries import graph_of, seeds_of
from .registry import common, query

LENGTH = 8
LONG = 40  # the walkers' own setting; segments of a path begin after ten hops
SEED = 42
WINDOW = 8
NEGATIVES = 15


def walks_of(t, policy="restart", length=LENGTH):
    wallets, _, cdf = graph_of(t)
    cdf = materialize(cdf)
    adjacency = walks.build_adjacency(cdf)
    return walks.random_walks(seeds_of(t, wallets, cdf), adjacency, length, policy=policy, seed=SEED, uniform="portable")


def path_text(df):
    return df.select("walk_id", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


common("hop", """
    SELECT src, dst, wsum, cume, lag(cume, 1, -1.0) OVER (PARTITION BY src ORDER BY dst) AS low FROM cdf""")
for name, policy, hops in [*((p, p, LENGTH) for p in walks.POLICIES), ("long", "restart", LONG)]:
    target, join, jump = {
        "restart": ("coalesce(h.dst, w.home)", "LEFT JOIN", ""),
        "terminate": ("h.dst", "JOIN", ""),
        "teleport": (
            "coalesce(h.dst, s.node_id)", "LEFT JOIN",
            f" JOIN seed s ON s.seed_index = CAST(floor({sql_uniform('w.walk_id', '1000003 + w.step', SEED)}"
            " * (SELECT count(*) FROM seed)) AS BIGINT)",
        ),
    }[policy]
    common(f"walk_rec_{name}", f"""
        SELECT seed_index AS walk_id, 0 AS step, node_id AS home, node_id AS node FROM seed
        UNION ALL
        SELECT w.walk_id, w.step + 1, w.home, {target}
        FROM walk_rec_{name} w {join} hop h ON h.src = w.node
          AND {sql_uniform('w.walk_id', 'w.step', SEED)} * h.wsum > h.low
          AND {sql_uniform('w.walk_id', 'w.step', SEED)} * h.wsum <= h.cume{jump}
        WHERE w.step < {hops}""")
common("walk_rows", "SELECT walk_id, step, node FROM walk_rec_restart")
common("vocab", """
    SELECT node AS id, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, node) - 1 AS index
    FROM walk_rows GROUP BY node""")
common("pair", f"""
    SELECT a.walk_id, a.step AS pos, b.step AS ctx_pos, a.node AS center, b.node AS context
    FROM walk_rows a JOIN walk_rows b ON a.walk_id = b.walk_id AND a.step <> b.step
     AND abs(a.step - b.step) <= 1 + CAST(floor({sql_uniform('a.walk_id', 'a.step', SEED)} * {WINDOW}) AS INTEGER)""")
common("noise", """
    SELECT id, index, w / sum(w) OVER () AS p,
           (sum(w) OVER (ORDER BY index ROWS UNBOUNDED PRECEDING) - w) / sum(w) OVER () AS low,
           sum(w) OVER (ORDER BY index ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS cume
    FROM (SELECT id, index, pow(count, 0.75) AS w FROM vocab) v""")


def _walk_query(name, policy, hops):
    @query(f"w5_random_walks_{name}", f"""
        SELECT walk_id, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY step) AS path
        FROM walk_rec_{name} GROUP BY walk_id""")
    def _(t):
        return path_text(walks_of(t, policy, hops))


for _policy in walks.POLICIES:
    _walk_query(_policy, _policy, LENGTH)
_walk_query("long", "restart", LONG)


@query("j18_next_hop_join", f"""
    SELECT s.node_id AS node, h.dst AS next_node
    FROM seed s LEFT JOIN hop h ON h.src = s.node_id AND {sql_uniform('s.seed_index', '0', SEED)} * h.wsum > h.low
     AND {sql_uniform('s.seed_index', '0', SEED)} * h.wsum <= h.cume""")
def _(t):
    from ..operators.ranking import dense_ids

    wallets, _, cdf = graph_of(t)
    cdf = materialize(cdf)
    adjacency = walks.build_adjacency(cdf)
    numbered = dense_ids(seeds_of(t, wallets, cdf), [F.col("node_id")], "seed_index")
    frontier = numbered.select(
        F.col("node_id").alias("node"), F.lit(False).alias("hot"), "seed_index",
        F.expr(portable_uniform("seed_index", 0, SEED)).alias("u"),
    )
    return walks.next_hop(frontier, adjacency, "u", "seed_index").select("node", "next_node")


@query("w3_split_even_contiguous", """
    SELECT node_id, CAST(ntile(15) OVER (ORDER BY node_id) - 1 AS BIGINT) AS part FROM seed""")
def _(t):
    return walks.split_even(_numbered_seeds(t), 15).select("node_id", "part")


@query("w4_split_even_roundrobin", "SELECT node_id, seed_index % 15 AS part FROM seed")
def _(t):
    return walks.split_even(_numbered_seeds(t), 15, "roundrobin").select("node_id", "part")


def _numbered_seeds(t):
    from ..operators.ranking import dense_ids

    wallets, _, cdf = graph_of(t)
    return dense_ids(seeds_of(t, wallets, cdf), [F.col("node_id")], "seed_index")


@query("w12_shuffle_walks", """
    SELECT walk_id, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY step) AS path
    FROM walk_rec_terminate GROUP BY walk_id HAVING count(*) >= 2""")
def _(t):
    return path_text(walks.shuffle_walks(walks_of(t, "terminate"), SEED))


@query("p19_drop_short", """
    SELECT walk_id, count(*) AS n FROM walk_rec_terminate GROUP BY walk_id HAVING count(*) >= 6""")
def _(t):
    return walks.drop_short(walks_of(t, "terminate"), 6).select("walk_id", F.size("path").cast("bigint").alias("n"))


@query("a30_walk_stats", """
    SELECT count(*) AS walks, min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS avg_len,
           count(DISTINCT home) AS first_nodes
    FROM (SELECT walk_id, min(home) AS home, count(*) AS n FROM walk_rec_terminate GROUP BY walk_id) w""")
def _(t):
    return walks.walk_stats(walks_of(t, "terminate")).withColumn("avg_len", F.round("avg_len", 6))


@query("a32_vocab_counts", "SELECT id, count, index FROM vocab")
def _(t):
    return walks.vocab_counts(walks_of(t))


@query("m1_skipgram_pairs", "SELECT walk_id, pos, ctx_pos, center, context FROM pair")
def _(t):
    return skipgram.skipgram_pairs(walks_of(t), WINDOW, SEED, "portable")


@query("m1_encode_walks", """
    SELECT walk_id, string_agg(CAST(index AS VARCHAR), ' ' ORDER BY step) AS path
    FROM walk_rows JOIN vocab ON node = id GROUP BY walk_id""")
def _(t):
    walked = walks_of(t)
    return path_text(skipgram.encode_walks(walked, walks.vocab_counts(walked)))


@query("m2_noise_distribution", """
    SELECT id, index, round(p, 9) AS p, round(low, 9) AS low, round(cume, 9) AS cume FROM noise""")
def _(t):
    noise = skipgram.noise_distribution(walks.vocab_counts(walks_of(t)))
    return noise.select("id", "index", *[F.round(c, 9).alias(c) for c in ("p", "low", "cume")])


@query("m3_sample_negatives", f"""
    SELECT p.walk_id, p.pos, p.ctx_pos, d.draw, n.id AS negative
    FROM pair p CROSS JOIN (SELECT unnest(range(0, {NEGATIVES})) AS draw) d
    JOIN noise n ON {sql_uniform(('p.walk_id', 'p.pos', 'p.ctx_pos'), 'd.draw', SEED)} > n.low
     AND {sql_uniform(('p.walk_id', 'p.pos', 'p.ctx_pos'), 'd.draw', SEED)} <= n.cume""")
def _(t):
    walked = walks_of(t)
    noise = materialize(skipgram.noise_distribution(walks.vocab_counts(walked)))
    pairs = skipgram.skipgram_pairs(walked, WINDOW, SEED, "portable")
    drawn = skipgram.sample_negatives(pairs, noise, NEGATIVES, SEED, "portable")
    return drawn.select("walk_id", "pos", "ctx_pos", F.col("draw").cast("bigint").alias("draw"), "negative")
