"""Precision at k, weight search, correlations and histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.operators.aggregates import distinct_items
from stylematch.operators.ranking import top_k
from stylematch.operators.sets import weight_grid
from stylematch.plans.score import (
    by_season, distinct_profiles, item_signatures, raw_pairs, scaled_pairs, season_scaled, user_profiles,
)
from stylematch.session import shuffle_width, stage

SCORES = ("style_score", "color_score", "season_score")


def precision_rows(best: DataFrame, log: DataFrame, ks: Sequence[int], rated_only: bool = False) -> DataFrame:
    """(user_id, k, precision) from ranked recommendations and the rating log.

    Every item a user rated is relevant, whatever the rating; the denominator is always k. Users without
    ratings count 0, or are left out with ``rated_only``.
    """
    rated = distinct_items(log, "user_id", "item_id").withColumn("_hit", F.lit(1))
    marked = best.select("user_id", "item_id", "rank").join(rated, ["user_id", "item_id"], "left")
    hits = [F.count_if((F.col("rank") <= k) & F.col("_hit").isNotNull()).alias(f"_h{k}") for k in ks]
    per_user = marked.groupBy("user_id").agg(*hits)
    if rated_only:
        per_user = per_user.join(log.select("user_id").distinct(), "user_id", "left_semi")
    entries = [F.struct(F.lit(k).alias("k"), (F.col(f"_h{k}") / F.lit(float(k))).alias("precision")) for k in ks]
    return per_user.select("user_id", F.explode(F.array(*entries)).alias("e")).select("user_id", "e.k", "e.precision")


def mean_precision(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_users"), F.avg("precision").alias("mean_precision"))


def _front_layers(df: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Rows that can be among the k best of their group for some weights of colour and season.

    Within a group the style score is constant. A row outside the first k fronts (colour down, best season so far)
    is beaten by k rows for every pair of positive weights; the k best by season, by colour and by id cover the
    weights that are 0.
    """
    colour, season, item = F.col("color_score"), F.col("season_score"), F.col("item_id")
    by_colour = Window.partitionBy(*group).orderBy(colour.desc(), season.desc(), item)
    earlier = by_colour.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_layer", F.lit(None).cast("int"))
    for layer in range(k):
        open_season = F.when(F.col("_layer").isNull(), season)
        best_before = F.max(open_season).over(earlier)
        front = F.col("_layer").isNull() & (best_before.isNull() | (season > best_before))
        out = out.withColumn("_layer", F.when(front, F.lit(layer)).otherwise(F.col("_layer")))

    def position(*order: Column) -> Column:
        return F.row_number().over(Window.partitionBy(*group).orderBy(*order))

    out = out.withColumns({
        "_by_colour": position(colour.desc(), item), "_by_season": position(season.desc(), item), "_by_id": position(item),
    })
    keep = F.col("_layer").isNotNull()
    for name in ("_by_colour", "_by_season", "_by_id"):
        keep = keep | (F.col(name) <= k)
    return out.filter(keep).drop("_layer", "_by_colour", "_by_season", "_by_id")


def score_candidates(scores: DataFrame, k: int = 3, group: str = "user_id") -> DataFrame:
    """Rows of a score table that can reach a top k under any non-negative weights."""
    rows = scores.select(group, "item_id", *[F.col(c).cast("double").alias(c) for c in SCORES])
    same = [group, "style_score", "color_score"]
    best_season = top_k(rows, same, [F.col("season_score").desc(), F.col("item_id")], k)
    lowest_id = top_k(rows, same, [F.col("item_id")], k)
    return _front_layers(best_season.unionByName(lowest_id).distinct(), [group, "style_score"], k)


def grid_hits(candidates: DataFrame, k: int, steps: int = 5, group: str = "user_id") -> DataFrame:
    """(w_style, w_color, w_season, hits): hits among the top k, one row per distinct weight direction.

    ``candidates`` carry ``n_hits``, the number of hits an item is worth. They are placed by group once, so ranking
    every direction needs no further shuffle.
    """
    spark = candidates.sparkSession
    names = ("w_style", "w_color", "w_season")
    # 175 directions for six steps: a constant of the search, not data
    directions = sorted({tuple(r) for r in weight_grid(spark, steps).select(*names).collect()})
    weights = {n: F.lit(np.array([d[i] for d in directions])) for i, n in enumerate(names)}
    placed = candidates.repartition(shuffle_width(spark), group)
    every = placed.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(len(directions) - 1))))
    at = [F.get(weights[n], F.col("_d")) for n in names]
    style, colour, season = (F.col(c) for c in SCORES)
    scored = every.select(
        group, "_d", "item_id", "n_hits", (style * at[0] + colour * at[1] + season * at[2]).alias("_score")
    )
    best = top_k(scored, [group, "_d"], [F.col("_score").desc(), F.col("item_id")], k)
    totals = best.groupBy("_d").agg(F.sum("n_hits").alias("hits"))
    return totals.select(*[F.get(weights[n], F.col("_d")).alias(n) for n in names], "hits")


def grid_table(hits: DataFrame, n_users: int, k: int, steps: int = 5) -> DataFrame:
    """(seq, w_style, w_color, w_season, mean_precision) for all weight triples in product order."""
    names = ["w_style", "w_color", "w_season"]
    mean = F.coalesce(F.try_divide(F.col("hits"), F.lit(float(k * n_users))), F.lit(0.0))
    grid = weight_grid(hits.sparkSession, steps)
    return grid.join(hits, names, "left").select("seq", *names, mean.alias("mean_precision"))


def search_weights(scores: DataFrame, log: DataFrame, k: int = 3, steps: int = 5, rated_only: bool = False) -> DataFrame:
    """Weight grid over a stored score table (user_id, item_id, three scores)."""
    rated = distinct_items(log, "user_id", "item_id").withColumn("n_hits", F.lit(1))
    users = scores.select("user_id").distinct()
    if rated_only:
        rated_users = log.select("user_id").distinct()
        users, scores = users.join(rated_users, "user_id", "left_semi"), scores.join(rated_users, "user_id", "left_semi")
    candidates = score_candidates(scores, k).join(rated, ["user_id", "item_id"], "left").fillna(0, ["n_hits"])
    return grid_table(grid_hits(candidates, k, steps), users.count(), k, steps)


def search_weights_all_users(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame, log: DataFrame,
    k: int = 3, steps: int = 5, rated_only: bool = False, use_dislikes: bool = False,
    null_scores_zero: bool = False, stored_as: str | None = None,
) -> DataFrame:
    """Weight grid for all users without a user x item score table.

    Users of one profile share their ranking, so directions are ranked per profile, and an item counts as many
    hits as users of the profile rated it. ``stored_as`` is the type that the scores have where they are stored.
    """
    profiled = stage(user_profiles(users, clothes_colours, features if use_dislikes else None), "profiled")
    rated = stage(distinct_items(log, "user_id", "item_id"), "rated")
    if rated_only:
        profiled = stage(profiled.join(rated.select("user_id").distinct(), "user_id", "left_semi"), "profiled")
    signatures = item_signatures(features, k, None)
    raw = raw_pairs(distinct_profiles(profiled), signatures, style_scores, null_scores_zero=null_scores_zero)
    pairs = scaled_pairs(raw)
    rows = pairs.withColumn("_b", F.explode("best")).select(
        "profile", F.col("_b.item_id").alias("item_id"), "style_score", "color_score",
        season_scaled(F.col("_b.share")).alias("season_score"),
    )
    if stored_as:
        rows = rows.withColumns({c: F.col(c).cast(stored_as).cast("double") for c in SCORES})
    candidates = _front_layers(rows, ["profile", "style_score"], k)
    worth = (
        rated.join(profiled.select("user_id", "profile"), "user_id")
        .groupBy("profile", "item_id").agg(F.count(F.lit(1)).alias("n_hits"))
    )
    valued = candidates.join(worth, ["profile", "item_id"], "left").fillna(0, ["n_hits"])
    return grid_table(grid_hits(valued, k, steps, "profile"), profiled.count(), k, steps)


def rating_correlations(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame, per_user: bool = False
) -> DataFrame:
    """Pearson correlation of style, colour, season and total score with the item rating over all user/item pairs.

    The sums are built from one row per (season, signature) and one per profile, weighted by the users of the
    profile; ``features`` must carry ``rating``. Ratings and shares are taken from their means over the items first,
    style and colour scores from the middle of theirs, so that large offsets do not cancel in the power sums.
    """
    profiled = stage(user_profiles(users, clothes_colours, features), "profiled")
    names = ["family", "accord1", "accord2", "accord3"]
    rows = by_season(features).filter(F.col("share").isNotNull() & F.col("rating").isNotNull() & F.col("f0").isNotNull())
    means = stage(rows.select("share", "rating", "season", *names, "f0", "f1", "f2"), "rated")
    middle = means.agg(F.avg("share").alias("e"), F.avg("rating").alias("r")).first()
    style_middle = style_scores.agg(F.avg("score")).first()[0] or 0.0
    rows = means
    e, r = F.col("share") - F.lit(middle["e"] or 0.0), F.col("rating") - F.lit(middle["r"] or 0.0)
    signatures = rows.groupBy("season", *names, "f0", "f1", "f2").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"),
        F.sum(r).alias("r"), F.sum(r * r).alias("rr"), F.sum(e * r).alias("er"),
    )
    pairs = raw_pairs(distinct_profiles(profiled), signatures, style_scores)
    n, s, c = F.col("n"), F.col("style_raw") - F.lit(float(style_middle)), F.col("color_raw") - F.lit(50.0)
    sc = s + c
    sums = {
        "n": n, "r": F.col("r"), "rr": F.col("rr"),
        "x_style": n * s, "xx_style": n * s * s, "xr_style": s * F.col("r"),
        "x_color": n * c, "xx_color": n * c * c, "xr_color": c * F.col("r"),
        "x_season": F.col("e"), "xx_season": F.col("ee"), "xr_season": F.col("er"),
        "x_my": n * sc + F.col("e"), "xx_my": n * sc * sc + F.lit(2.0) * sc * F.col("e") + F.col("ee"),
        "xr_my": sc * F.col("r") + F.col("er"),
    }
    per_profile = pairs.groupBy("profile").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])

    offsets = {"style": float(style_middle), "color": 50.0, "season": float(middle["e"] or 0.0), "rating": float(middle["r"] or 0.0)}
    offsets["my"] = offsets["style"] + offsets["color"] + offsets["season"]

    def corr(name: str, out: str) -> Column:
        total, x, xx, xr = F.col("_n"), F.col(f"_x_{name}"), F.col(f"_xx_{name}"), F.col(f"_xr_{name}")
        var_x, var_r = total * xx - x * x, total * F.col("_rr") - F.col("_r") * F.col("_r")
        # what rounding leaves of a constant: relative to the centred sums, and to the offset that was taken away
        def constant(var: Column, squares: Column, offset: float) -> Column:
            return var <= F.lit(1e-12) * total * squares + F.lit(1e-28 * offset * offset) * total * total

        flat = constant(var_x, xx, offsets[name]) | constant(var_r, F.col("_rr"), offsets["rating"])
        return F.when(~flat, (total * xr - x * F.col("_r")) / (F.sqrt(var_x) * F.sqrt(var_r))).alias(out)

    measures = [corr("style", "corr_style"), corr("color", "corr_color"), corr("season", "corr_season"), corr("my", "corr_myscore")]
    if per_user:
        values = per_profile.select("profile", *measures)
        return profiled.select("user_id", "profile").join(values, "profile").drop("profile")
    sizes = profiled.groupBy("profile").agg(F.count(F.lit(1)).alias("_users"))
    weighted_sums = [F.sum(F.col(f"_{k}") * F.col("_users")).alias(f"_{k}") for k in sums]
    return per_profile.join(sizes, "profile").agg(*weighted_sums).select(F.col("_n").cast("bigint").alias("n_pairs"), *measures)


def epsilon_histograms(
    scores: DataFrame, columns: Sequence[str] = SCORES, epsilons: Sequence[float] = (0.01, 0.02, 0.05), bins: int = 30,
    times: str | None = None,
) -> DataFrame:
    """(column, epsilon, bin, n): counts of each smoothed score in equal bins between its extremes.

    A row counts as often as its column ``times`` says, so one row can stand for all users of a profile. Every task adds
    its rows to one array of bins per column and epsilon, in one pass; the arrays of the tasks are added up. A score that
    is null, or without a range, counts in the first bin.
    """
    ends = scores.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    names, steps = list(columns), [float(e) for e in epsilons]
    reach = [(ends[f"low_{c}"], ends[f"high_{c}"]) for c in names]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(names), len(steps), bins), dtype=np.int64)
        for batch in batches:
            weight = np.asarray(batch.column(len(names)), dtype=np.int64)
            for i, (low, high) in enumerate(reach):
                value = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                for j, e in enumerate(steps):
                    slot = np.zeros(len(value), dtype=np.int64)
                    if low is not None:
                        first, last = ((end + e) / (1.0 + e) for end in (float(low), float(high)))
                        if last != first:
                            place = ((value + e) / (1.0 + e) - first) / (last - first) * float(bins)
                            slot = np.minimum(np.where(np.isnan(place), 0, np.floor(place)), bins - 1).astype(np.int64)
                    # whole numbers below 2^53 stay exact as weights
                    totals[i, j] += np.bincount(slot, weights=weight, minlength=bins).astype(np.int64)
        column, epsilon, slot = np.nonzero(totals)
        yield pa.record_batch(
            [pa.array([names[i] for i in column], pa.string()), pa.array([steps[j] for j in epsilon], pa.float64()), pa.array(slot, pa.int32()), pa.array(totals[column, epsilon, slot])],
            ["column", "epsilon", "bin", "n"],
        )

    weight = F.col(times).cast("long") if times else F.lit(1).cast("long")
    parts = scores.select(*[F.col(c).cast("double").alias(c) for c in names], weight.alias("_times"))
    parts = parts.mapInArrow(binned, "column string, epsilon double, bin int, n long")
    return parts.groupBy("column", "epsilon", "bin").agg(F.sum("n").alias("n"))
