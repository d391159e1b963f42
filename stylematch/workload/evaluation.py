"""Evaluation queries: precision, weight search, correlations, histograms, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.operators.aggregates import overlap_sizes
from stylematch.operators.ranking import arg_max
from stylematch.operators.sets import common_items, weight_grid
from stylematch.plans import evaluate, score
from stylematch.session import stage
from stylematch.workload.registry import query
from stylematch.workload.scoring import (
    BASE, PEOPLE, feats_sql, pairs_sql, scaled_sql,
)
from stylematch.workload.tables import clothes_colours, derived, feature_table, rating_log

ZERO = [feats_sql("null", "null"), PEOPLE, pairs_sql("points", dislikes=False), scaled_sql(zero_nulls=True)]
TOP10 = (
    "top10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ss + cs + es DESC, item_id) AS rn "
    "FROM scaled) WHERE rn <= 10)"
)
RATED = "rated AS (SELECT DISTINCT user_id, item_id FROM rating_log)"
PRECISION = (
    "prec AS (SELECT user_id, CAST(k AS INTEGER) AS k, count(r.item_id) FILTER (WHERE rn <= k) / CAST(k AS DOUBLE) AS p "
    "FROM top10 t LEFT JOIN rated r USING (user_id, item_id) CROSS JOIN range(1, 11) ks(k) GROUP BY user_id, k)"
)


def _zero_features(spark, sf):
    # nulls count 0 before scaling: a missing accord colour keeps the item, with colour score 0
    return feature_table(spark, sf, "null", "zero")


def _top10(spark, sf):
    return evaluate_top(spark, sf, 10)


def evaluate_top(spark, sf, k):
    return score.scaled_top(
        derived(spark, sf, "users"), _zero_features(spark, sf), clothes_colours(spark),
        vocab.style_scores(spark, "points"), k=k, use_dislikes=False, null_scores_zero=True,
    )


@query(
    "precision_at_k_per_user", "E1 W3 A18 U3", tables=BASE + " points rating_log",
    extra=", ".join([*ZERO, TOP10, RATED, PRECISION]),
    sql="SELECT user_id, k, round(p, 6) AS precision FROM prec",
)
def precision_at_k_per_user(spark, sf):
    """Precision at 1..10 of every user, over all items and the whole log."""
    rows = evaluate.precision_rows(_top10(spark, sf), rating_log(spark, sf), range(1, 11))
    return rows.withColumn("precision", F.round("precision", 6))


@query(
    "mean_precision_at_k", "E1", tables=BASE + " points rating_log",
    extra=", ".join([*ZERO, TOP10, RATED, PRECISION]),
    sql="SELECT k, count(*) AS n_users, round(avg(p), 6) AS mean_precision FROM prec GROUP BY k",
)
def mean_precision_at_k(spark, sf):
    """Mean precision for k = 1..10; users without ratings count 0."""
    rows = evaluate.precision_rows(_top10(spark, sf), rating_log(spark, sf), range(1, 11))
    return evaluate.mean_precision(rows).withColumn("mean_precision", F.round("mean_precision", 6))


@query(
    "mean_precision_at_3_rated_users", "E2", tables=BASE + " points rating_log",
    extra=", ".join([*ZERO, TOP10, RATED, PRECISION]),
    sql="""SELECT k, count(*) AS n_users, round(avg(p), 6) AS mean_precision FROM prec
    WHERE k = 3 AND user_id IN (SELECT user_id FROM rating_log) GROUP BY k""",
)
def mean_precision_at_3_rated_users(spark, sf):
    """Mean precision at 3 over the users that rated something."""
    rows = evaluate.precision_rows(evaluate_top(spark, sf, 3), rating_log(spark, sf), [3], rated_only=True)
    return evaluate.mean_precision(rows).withColumn("mean_precision", F.round("mean_precision", 6))


GRID = (
    "grid AS (SELECT i * 36 + j * 6 + k - 1 AS seq, i / CAST(i + j + k AS DOUBLE) AS w1, j / CAST(i + j + k AS DOUBLE) AS w2, "
    "k / CAST(i + j + k AS DOUBLE) AS w3 FROM range(6) a(i), range(6) b(j), range(6) c(k) WHERE i + j + k > 0)"
)
DIRECTIONS = "dirs AS (SELECT DISTINCT w1, w2, w3 FROM grid)"


@query(
    "weight_candidates", "U5", extra=GRID,
    sql="SELECT seq, round(w1, 9) AS w_style, round(w2, 9) AS w_color, round(w3, 9) AS w_season FROM grid",
)
def weight_candidates(spark, sf):
    """The 215 normalised weight triples."""
    return weight_grid(spark).withColumns({c: F.round(c, 9) for c in ("w_style", "w_color", "w_season")})


# Users who share style, season and outfit colour have the same scores: the check ranks one user of each group and
# weighs the hits by the users of the group.
GROUPS = (
    "groups AS (SELECT min(user_id) AS user_id, user_style, skey, c0, c1, c2, count(*) AS n_users FROM base "
    "GROUP BY user_style, skey, c0, c1, c2)"
)


def grid_all_sql(rated_only: bool = False, stored: bool = False) -> list[str]:
    """CTEs up to ``result``: the weight grid over all users, or over those who rated; scores as stored or as computed."""
    scores = [f"CAST(CAST({c} AS DECIMAL(10, 6)) AS DOUBLE) AS {c}" if stored else c for c in ("ss", "cs", "es")]
    return [
        feats_sql("null", "null"), PEOPLE, RATED,
        "base AS (SELECT * FROM people" + (" WHERE user_id IN (SELECT user_id FROM rated))" if rated_only else ")"),
        GROUPS, pairs_sql("points", "groups", dislikes=False), scaled_sql(zero_nulls=True),
        f"kept AS (SELECT user_id, item_id, {', '.join(scores)} FROM scaled)",
        "worth AS (SELECT g.user_id, r.item_id, count(*) AS n FROM groups g JOIN base p ON p.user_style = g.user_style "
        "AND p.skey = g.skey AND p.c0 = g.c0 AND p.c1 = g.c1 AND p.c2 = g.c2 JOIN rated r ON r.user_id = p.user_id "
        "GROUP BY g.user_id, r.item_id)",
        GRID, DIRECTIONS,
        "best AS (SELECT user_id, w1, w2, w3, max(struct_pack(s := ss * w1 + cs * w2 + es * w3, i := -item_id), 3) AS b "
        "FROM kept CROSS JOIN dirs GROUP BY user_id, w1, w2, w3)",
        "hits AS (SELECT w1, w2, w3, sum(coalesce(n, 0)) AS h FROM (SELECT user_id, w1, w2, w3, -unnest(b).i AS item_id FROM best) "
        "LEFT JOIN worth USING (user_id, item_id) GROUP BY w1, w2, w3)",
        "result AS (SELECT seq, w1, w2, w3, h / CAST(3 * (SELECT count(*) FROM base) AS DOUBLE) AS p FROM grid "
        "JOIN hits USING (w1, w2, w3))",
    ]


@query(
    "weight_grid_all_users", "E3 U5 F24 W3", tables=BASE + " points rating_log", extra=", ".join(grid_all_sql()),
    sql="""SELECT seq, round(w1, 9) AS w_style, round(w2, 9) AS w_color, round(w3, 9) AS w_season,
    round(p, 9) AS mean_precision FROM result""",
)
def weight_grid_all_users(spark, sf):
    """Mean precision at 3 of all 215 weight triples over all users and items."""
    grid = evaluate.search_weights_all_users(
        derived(spark, sf, "users"), _zero_features(spark, sf), clothes_colours(spark),
        vocab.style_scores(spark, "points"), rating_log(spark, sf), null_scores_zero=True,
    )
    return grid.withColumns({c: F.round(c, 9) for c in ("w_style", "w_color", "w_season", "mean_precision")})


def best_grid(spark, sf, log, **options):
    """The weight grid over all users who rated, from the tables that every search shares."""
    return evaluate.search_weights_all_users(
        derived(spark, sf, "users"), _zero_features(spark, sf), clothes_colours(spark), vocab.style_scores(spark, "points"), log,
        rated_only=True, null_scores_zero=True, **options,
    )


@query(
    "best_weights_stored_scores", "E3 O4 E2", tables=BASE + " points rating_log", extra=", ".join(grid_all_sql(True, True)),
    sql="""SELECT seq, round(w1, 9) AS w_style, round(w2, 9) AS w_color, round(w3, 9) AS w_season,
    round(p, 9) AS mean_precision FROM result ORDER BY p DESC, seq LIMIT 1""",
)
def best_weights_stored_scores(spark, sf):
    """Best weight triple for scores stored as DECIMAL(10,6), over all users who rated; the first best wins."""
    grid = best_grid(spark, sf, rating_log(spark, sf), stored_as="decimal(10,6)")
    return arg_max(grid, "mean_precision", "seq").withColumns(
        {c: F.round(c, 9) for c in ("w_style", "w_color", "w_season", "mean_precision")}
    )


_CORR = ", ".join(
    f"round(corr({x}, rating), 6) AS corr_{n}" for x, n in (("s", "style"), ("c", "color"), ("e", "season"), ("s + c + e", "myscore"))
)


def _rated_features(spark, sf):
    features = feature_table(spark, sf)
    return features.join(derived(spark, sf, "items").select("item_id", "rating"), "item_id")


@query(
    "score_rating_correlation", "E4 A12", tables=BASE + " percent",
    extra=", ".join([feats_sql(), PEOPLE, pairs_sql("percent")]),
    sql=f"SELECT count(*) AS n_pairs, {_CORR} FROM pairs JOIN items USING (item_id)",
)
def score_rating_correlation(spark, sf):
    """Correlation of each score with the item rating over all user/item pairs."""
    out = evaluate.rating_correlations(
        derived(spark, sf, "users"), _rated_features(spark, sf), clothes_colours(spark), vocab.style_scores(spark)
    )
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("corr_")})


@query(
    "score_rating_correlation_per_user", "E4 A13", tables=BASE + " percent",
    extra=", ".join([feats_sql(), PEOPLE, pairs_sql("percent")]),
    sql=f"SELECT user_id, {_CORR} FROM pairs JOIN items USING (item_id) GROUP BY user_id",
)
def score_rating_correlation_per_user(spark, sf):
    """The same per user."""
    out = evaluate.rating_correlations(
        derived(spark, sf, "users"), _rated_features(spark, sf), clothes_colours(spark), vocab.style_scores(spark),
        per_user=True,
    )
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("corr_")})


@query(
    "epsilon_histograms", "E5 F23", tables=BASE + " points",
    extra=", ".join([
        feats_sql("null", "null"), PEOPLE, "base AS (SELECT * FROM people)", GROUPS, pairs_sql("points", "groups", dislikes=False),
        scaled_sql(zero_nulls=True),
        "long AS (SELECT unnest(['style_score', 'color_score', 'season_score']) AS col, unnest([ss, cs, es]) AS v, n_users "
        "FROM scaled JOIN (SELECT user_id, n_users FROM groups) USING (user_id))",
        "moved AS (SELECT col, eps, n_users, (v + eps) / (CAST(1 AS DOUBLE) + eps) AS v FROM long "
        "CROSS JOIN (SELECT unnest([CAST(0.01 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(0.05 AS DOUBLE)]) AS eps))",
        "ends AS (SELECT col, eps, min(v) AS low, max(v) AS high FROM moved GROUP BY col, eps)",
    ]),
    sql="""SELECT col AS "column", eps AS epsilon,
    CAST(least(coalesce(floor((v - low) / nullif(high - low, 0) * CAST(30 AS DOUBLE)), 0), 29) AS INTEGER) AS bin,
    CAST(sum(n_users) AS BIGINT) AS n FROM moved JOIN ends USING (col, eps) GROUP BY ALL""",
)
def epsilon_histograms(spark, sf):
    """30-bin histograms of the scaled scores of all users under three epsilons; a row stands for the users of a profile."""
    users, colours = derived(spark, sf, "users"), clothes_colours(spark)
    profiled = score.user_profiles(users, colours)
    groups = stage(profiled.groupBy("profile").agg(F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("n_users")).drop("profile"), "groups")
    times = groups.groupBy("user_id").agg(F.sum("n_users").alias("n_users"))
    people = profiled.join(times, "user_id")
    parts = score.score_parts(people, feature_table(spark, sf, "null", "null"), colours, vocab.style_scores(spark, "points"), "n_users")
    return reduce(DataFrame.unionByName, [evaluate.epsilon_histograms(rows, [name], times="n") for name, rows in parts.items()])


@query(
    "recommended_and_rated_overlap", "A18 U3", tables=BASE + " points rating_log", extra=", ".join([*ZERO, TOP10, RATED]),
    sql="""SELECT t.user_id, count(*) AS n_a,
    (SELECT count(*) FROM rated r WHERE r.user_id = t.user_id) AS n_b, count(r2.item_id) AS n_both
    FROM top10 t LEFT JOIN rated r2 USING (user_id, item_id) GROUP BY t.user_id""",
)
def recommended_and_rated_overlap(spark, sf):
    """Per user: sizes of the recommended and the rated item set and of their intersection."""
    return overlap_sizes(_top10(spark, sf), rating_log(spark, sf), "user_id", "item_id")


@query(
    "hit_items", "U3", tables=BASE + " points rating_log", extra=", ".join([*ZERO, TOP10]),
    sql="SELECT user_id, item_id FROM top10 INTERSECT SELECT user_id, item_id FROM rating_log",
)
def hit_items(spark, sf):
    """(user, item) pairs that were both recommended and rated."""
    pairs = ["user_id", "item_id"]
    return common_items(_top10(spark, sf).select(*pairs), rating_log(spark, sf).select(*pairs))
