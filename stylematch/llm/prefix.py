"""Running totals without a task per key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(rows: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """The rows with ``out``: the sum of ``value`` over the earlier rows of the key.

    Earlier is by a hashed bucket of the ``order`` columns, then by the columns: a fixed order that does not depend on
    the partitions. There are about as many buckets as the square root of the row count, so neither a bucket nor the
    list of a key's buckets is more than a small part of a hot key. Key and order must not be null.
    """
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = rows.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, [key, "_bucket"]).withColumn(out, F.col("_own") + F.col("_offset")).drop("_own", "_offset", "_bucket")
