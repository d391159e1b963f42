"""Top-k, scaling, rank points, argmax and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.functions.numbers import min_max
from stylematch.session import stage


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per group. The row_number filter plans a group limit before the shuffle."""
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = numbered.filter(F.col("_rn") <= k)
    return kept.withColumnRenamed("_rn", rank) if rank else kept.drop("_rn")


def best_rows(df: DataFrame, score: str, tie: str, k: int = 3) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def scale_by_group(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Min-max scaling of each column inside its group.

    The extremes are aggregated (combined before the shuffle) and staged, one row per group. Few groups are then
    joined back without moving the rows; with many groups, a large one is split by the skew join.
    """
    extremes = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    sides = stage(df.groupBy(group).agg(*extremes), "extremes")
    scaled = {c: min_max(F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}")) for c in columns}
    return df.join(sides, group).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in ("min", "max")])


def rank_points(scores: DataFrame, group: str = "style", value: str = "score", out: str = "points") -> DataFrame:
    """Average rank (1 = smallest) inside the group; ties share their mean rank."""
    rising = Window.partitionBy(group).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(group, value))
    return scores.withColumn(out, F.rank().over(rising) + (ties - 1) / F.lit(2.0))


def arg_max(df: DataFrame, metric: str, seq: str) -> DataFrame:
    """Row with the largest metric, lowest ``seq`` on ties."""
    every = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by(every, F.struct(F.col(metric).alias("m"), (-F.col(seq)).alias("s")))
    return df.agg(best.alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def sample_padded(df: DataFrame, group: Sequence[str], item: str, k: int = 4, seed: int = 42) -> DataFrame:
    """At most k items per group chosen by hash, padded with nulls to exactly k: (group..., picks)."""
    order = [F.xxhash64(F.col(item), F.lit(seed)), F.col(item)]
    chosen = top_k(df.select(*group, item), group, order, k, rank="_rank")
    picked = chosen.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", item))).alias("_picks"))
    blank = F.array_repeat(F.lit(None).cast(df.schema[item].dataType), k)
    padded = F.slice(F.concat(F.transform("_picks", lambda p: p[item]), blank), 1, k)
    return picked.select(*group, padded.alias("picks"))
