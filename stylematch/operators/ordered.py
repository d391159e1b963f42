"""Operators that depend on input order, without pulling the table into one partition.

The order column is cut into ranges at its quantiles. Work inside a range is a partitioned window; what must
cross a border (last row, running count) is one small row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.session import shuffle_width, stage


def _ranges(df: DataFrame, order: str, ranges: int) -> DataFrame:
    numeric = df.withColumn("_pos", F.col(order).cast("double"))
    ranges = max(ranges, 2)
    cuts = numeric.approxQuantile("_pos", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    return Bucketizer(splits=splits, inputCol="_pos", outputCol="_range").transform(numeric).drop("_pos")


def _range_count(df: DataFrame, ranges: int | None) -> int:
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_previous(df: DataFrame, order: str, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Adds ``_prev``, a struct of the columns of the row before in the whole table; null for the first row.

    ``order`` must be numeric and unique.
    """
    cut = _ranges(stage(df, "ordered"), order, _range_count(df, ranges))
    values = F.struct(*[F.col(c) for c in columns])
    inside = Window.partitionBy("_range").orderBy(order)
    last = cut.groupBy("_range").agg(F.max_by(values, order).alias("_last"))
    carried = last.select("_range", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_carry"))
    here = cut.withColumn("_prev", F.lag(values).over(inside))
    return (
        here.join(carried, "_range", "left")
        .withColumn("_prev", F.coalesce(F.col("_prev"), F.col("_carry")))
        .drop("_range", "_carry")
    )


def drop_similar(
    df: DataFrame, columns: Sequence[str], order: str, threshold: float = 0.7, ranges: int | None = None
) -> DataFrame:
    """Drop a row when the share of columns equal to the row before reaches the threshold.

    Nulls equal each other. The comparison is with the raw row before, not with the last row kept.
    """
    equal = F.lit(0)
    for c in columns:
        equal = equal + F.col(c).eqNullSafe(F.col("_prev").getField(c)).cast("int")
    similar = F.col("_prev").isNotNull() & (equal / F.lit(len(columns)) >= F.lit(threshold))
    return with_previous(df, order, columns, ranges).filter(~similar).drop("_prev")


def drop_repeated_key(df: DataFrame, keys: Sequence[Column], order: str, ranges: int | None = None) -> DataFrame:
    """Drop a row whose key equals the key of the row before; a null key part never equals."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    seen = with_previous(df.withColumns(named), order, list(named), ranges)
    same = F.lit(True)
    for name in named:
        same = same & (F.col(name) == F.col("_prev").getField(name))
    return seen.filter(~F.coalesce(same, F.lit(False))).drop("_prev", *named)


def with_position(df: DataFrame, order: str, out: str = "position", ranges: int | None = None) -> DataFrame:
    """Dense 0-based position in the order of a numeric, unique column.

    The rows are staged first: the quantiles, the counts and the numbering each read them.
    """
    df = stage(df, "positions")
    cut = _ranges(df, order, _range_count(df, ranges))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_range")
        .withColumn(out, (F.col("_before") + F.col("_rn") - 1).cast("bigint"))
        .drop("_range", "_rn", "_before")
    )


def rank_in_group(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """Dense 0-based place of each row in its group by a unique column of any type, nulls first.

    Rows are dealt by ranges of (group, order) and numbered in their range; per range and group only a count crosses
    the border, so a group with many rows is many tasks.
    """
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), group, order).sortWithinPartitions(group, order)
    placed = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "ranks")
    parts = placed.groupBy(group, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first")).cast("int").alias(out))


def first_of_group(df: DataFrame, group: str, columns: Sequence[str], order: str) -> DataFrame:
    """Every row takes the columns of its group's first row."""
    firsts = df.groupBy(group).agg(
        F.min_by(F.struct(*[F.col(c) for c in columns]), order).alias("_first")
    )
    return (
        df.drop(*columns).join(firsts, group)
        .select(*[c for c in df.columns if c not in columns], *[F.col(f"_first.{c}").alias(c) for c in columns])
        .select(*df.columns)
    )


def first_rows(df: DataFrame, key: str, order: str, keys: int | None = None) -> DataFrame:
    """First row per key, then the first ``keys`` keys in order."""
    every = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.groupBy(key).agg(F.min_by(every, order).alias("_r")).select("_r.*")
    return firsts if keys is None else firsts.orderBy(order).limit(keys)
