"""Keyed upsert, replacement, parents on demand, and load reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stylematch.operators.joins import keep_latest


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Table after the batch: a key in the batch replaces the stored row, the last batch row per key wins.

    ``seq`` orders the batch and is not part of the result. The stored rows meet only the keys of the batch; they are
    not sorted, and not moved either where the batch is small enough to be broadcast. Key parts must not be null.
    """
    latest = keep_latest(batch, keys, [F.col(seq).cast("long").desc_nulls_last()]).select(*table.columns)
    return table.join(latest.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(latest)


def load_report(df: DataFrame, key: str, ok: Column, skipped: Column | None = None) -> DataFrame:
    """Rows read, loaded, skipped, failed, and distinct loaded keys, from one pass."""
    skip = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    loaded = F.coalesce(ok, F.lit(False)) & ~skip
    return df.agg(
        F.count(F.lit(1)).alias("n_read"),
        F.count_if(loaded).alias("n_ok"),
        F.count_if(skip).alias("n_skipped"),
        F.count_if(~loaded & ~skip).alias("n_failed"),
        F.countDistinct(F.when(loaded, F.col(key))).alias("n_keys"),
    )


def load_observed(df: DataFrame, key: str, ok: Column, path: str, skipped: Column | None = None) -> DataFrame:
    """Write the rows that load to ``path`` and report on the load: one row with the columns of ``load_report``.

    Rows read, loaded, skipped and failed are counted by the job that writes, as it reads each row once; only the
    distinct keys are counted afterwards, over the loaded rows. A refused row is not written.
    """
    skip = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    loaded = F.coalesce(ok, F.lit(False)) & ~skip
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_read"), F.count_if("_ok").alias("n_ok"), F.count_if("_skip").alias("n_skipped"), F.count_if(~F.col("_ok") & ~F.col("_skip")).alias("n_failed")]
    marked = df.withColumns({"_ok": loaded, "_skip": skip}).observe(seen, *counts)
    marked.filter("_ok").drop("_ok", "_skip").write.parquet(path)
    told = seen.get
    keys = df.sparkSession.read.parquet(path).agg(F.countDistinct(key).alias("n_keys"))
    return keys.select(*[F.lit(told[c]).cast("bigint").alias(c) for c in ("n_read", "n_ok", "n_skipped", "n_failed")], "n_keys")


def replace_groups(table: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Stored rows of every group present in ``rows`` are replaced by them."""
    return table.join(rows.select(group).distinct(), group, "left_anti").unionByName(rows.select(*table.columns))


def append_version(table: DataFrame, values: Mapping[str, float], id_col: str = "weight_id") -> DataFrame:
    """One new row with the next id; only that row is returned, ready for an append."""
    following = (F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("bigint").alias(id_col)
    return table.agg(following).select(id_col, *[F.lit(float(v)).alias(k) for k, v in values.items()])


def add_missing_parents(
    dimension: DataFrame, key: str, facts: DataFrame, columns: Sequence[str], defaults: Mapping[str, str | None]
) -> DataFrame:
    """Dimension plus a default row for every value seen in the facts but not in the dimension."""
    seen = (
        facts.select(F.explode(F.array(*[F.trim(c) for c in columns])).alias(key))
        .filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    )
    missing = seen.join(dimension.select(key), key, "left_anti")
    types = {f.name: f.dataType for f in dimension.schema.fields}
    filled = missing.select(key, *[F.lit(v).cast(types[c]).alias(c) for c, v in defaults.items()])
    return dimension.unionByName(filled)
