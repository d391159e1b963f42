"""Unions and the weight grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Row concat by name; a column absent from one frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_items(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def weight_grid(spark: SparkSession, steps: int = 5) -> DataFrame:
    """All (steps+1)^3 - 1 weight triples in product order, normalised to sum 1: (seq, w_style, w_color, w_season).

    Weights are ratios of whole steps, so equal directions get equal doubles.
    """
    side = steps + 1
    n = F.col("id")
    i, j, k = F.floor(n / (side * side)), F.floor(n / side) % side, n % side
    total = (i + j + k).cast("double")
    return spark.range(1, side**3).select(
        (n - 1).alias("seq"), (i / total).alias("w_style"), (j / total).alias("w_color"), (k / total).alias("w_season")
    )
