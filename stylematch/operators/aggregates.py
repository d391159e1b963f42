"""Counts, vocabularies, fixpoint filters, modes, correlations and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.functions.text import clean_key
from stylematch.session import cut_lineage, shuffle_width, stage


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def value_shares(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values with their share of all non-null values."""
    present = df.filter(F.col(column).isNotNull())
    total = present.count()
    best = value_counts(present, column).limit(k)
    return best.withColumn("share", F.col("n") / F.lit(float(total)))


def stacked(df: DataFrame, columns: Sequence[str], out: str = "value") -> DataFrame:
    """The values of several columns in one column, nulls dropped."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias(out)).filter(
        F.col(out).isNotNull()
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return stacked(df, columns).distinct().orderBy("value")


def stacked_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return stacked(df, columns).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n) of nulls, largest first, from one aggregation."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns]
    return (
        one.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.column", "p.n")
        .orderBy(F.col("n").desc(), "column")
    )


def accord_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lowercased and trimmed; a missing accord becomes the text ``nan`` and is counted as such."""
    return df.withColumns({c: F.coalesce(clean_key(F.col(c).cast("string")), F.lit("nan")) for c in columns})


def drop_rare(df: DataFrame, columns: Sequence[str], threshold: int = 20) -> DataFrame:
    """Drop rows that hold a value counted fewer than ``threshold`` times, until none is left.

    The rounds work on the distinct value combinations with their counts, not on the rows. A row survives
    exactly when its combination does, so the rows themselves are read once for the counts and once at the end.
    """
    columns = list(columns)
    combos = cut_lineage(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")))
    while True:
        stacked_values = combos.select(F.explode(F.array(*columns)).alias("_value"), "_n")
        rare = cut_lineage(
            stacked_values.filter(F.col("_value").isNotNull())
            .groupBy("_value").agg(F.sum("_n").alias("_total"))
            .filter(F.col("_total") < threshold).select("_value")
        )
        if rare.isEmpty():
            break
        for c in columns:
            combos = combos.join(rare, F.col(c) == F.col("_value"), "left_anti")
        combos = cut_lineage(combos)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.alias("l").join(combos.alias("r"), condition, "left_semi")


def mask_rare(df: DataFrame, columns: Sequence[str], threshold: int = 20, mask: str = "None") -> DataFrame:
    """Replace values counted fewer than ``threshold`` times by the mask and keep the rows.

    Masking one value never changes the count of another, so one round reaches the fixpoint.
    """
    counts = stacked_counts(df, columns)
    # staged, so that the joins know its size: few values are broadcast and the table stays where it is
    frequent = stage(counts.filter(F.col("n") >= threshold).select(F.col("value").alias("_value")), "frequent")
    for c in columns:
        side = frequent.withColumnRenamed("_value", f"_keep_{c}")
        df = df.join(side, F.col(c) == F.col(f"_keep_{c}"), "left")
        masked = F.when(F.col(c).isNull(), F.col(c)).otherwise(F.coalesce(F.col(f"_keep_{c}"), F.lit(mask)))
        df = df.withColumn(c, masked).drop(f"_keep_{c}")
    return df


def tokens(df: DataFrame, doc_id: str, text: str, sep: str = ",") -> DataFrame:
    """(doc_id, token) in long form, tokens untrimmed; null text has one empty token."""
    return df.select(doc_id, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), sep)).alias("token"))


def vocabulary(token_rows: DataFrame, min_count: int = 25) -> DataFrame:
    """Tokens with at least ``min_count`` occurrences in total."""
    return token_rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def group_modes(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value of each column per group, smallest on ties; all-null gives null.

    Counts per (group, column, value) are combined before the shuffle, so a large group stays spread.
    """
    entries = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    counts = (
        df.select(F.col(group), F.explode(F.array(*entries)).alias("e"))
        .groupBy(group, F.col("e.c").alias("c"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("a"), F.col("v").alias("b")))
    modes = counts.groupBy(group, "c").agg(F.min_by("v", rank).alias("mode"))
    return modes.groupBy(group).pivot("c", list(columns)).agg(F.first("mode"))


def fill_modes(df: DataFrame, group: str, columns: Sequence[str], modes: DataFrame) -> DataFrame:
    """Null cells take the mode of their row's group.

    The modes (one row per group) are staged, so few groups are joined without moving the rows.
    """
    side = stage(modes.withColumnsRenamed({c: f"_mode_{c}" for c in columns}), "modes")
    filled = {c: F.coalesce(F.col(c).cast("string"), F.col(f"_mode_{c}")) for c in columns}
    return df.join(side, group, "left").withColumns(filled).drop(*[f"_mode_{c}" for c in columns])


def share_where(df: DataFrame, condition: Column, out: str = "share") -> DataFrame:
    """Share of all rows that meet the condition; null counts as not met."""
    return df.agg(F.avg(F.coalesce(condition, F.lit(False)).cast("int")).alias(out))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; null when one of them is constant."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def correlations(df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    aggs = [pearson(F.col(c), F.col(target)).alias(f"corr_{c}") for c in columns]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def largest_sides(images: DataFrame, path: str = "path", width: str = "width", height: str = "height") -> DataFrame:
    """Largest width and height and the first image (by path) that has each."""

    def holder(size: str) -> Column:
        return F.min_by(path, F.struct((-F.col(size)).alias("a"), F.col(path).alias("b")))

    return images.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.max(width).alias("max_width"), holder(width).alias("max_width_path"),
        F.max(height).alias("max_height"), holder(height).alias("max_height_path"),
    )


def next_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("bigint").alias("next_id"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight = max/n, soft_weight = sqrt(max/n))."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))  # one row per class
    weight = largest / F.col("n")
    return counts.withColumn("weight", weight).withColumn("soft_weight", F.sqrt("weight"))


def newest_row(df: DataFrame, key: str) -> DataFrame:
    """The row with the highest key."""
    every = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.max_by(every, key).alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def distinct_items(df: DataFrame, user: str, item: str) -> DataFrame:
    return df.select(user, item).distinct()


def overlap_sizes(a: DataFrame, b: DataFrame, user: str, item: str) -> DataFrame:
    """Per user of ``a``: sizes of both item sets and of their intersection.

    The rows of both tables are dealt over all tasks by user and item before they are made distinct, once for all three
    sizes: a task holds its share of the pairs, however few partitions the tables come in. A null equals no user or item
    of the other table.
    """
    def marked(df: DataFrame, in_a: bool) -> DataFrame:
        return df.select(F.col(user), F.col(item), F.lit(int(in_a)).alias("_a"), F.lit(int(not in_a)).alias("_b"))

    rows = marked(a, True).unionByName(marked(b.filter(F.col(user).isNotNull()), False))
    pairs = rows.repartition(shuffle_width(a.sparkSession), user, item).groupBy(user, item).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    both = F.when(F.col(item).isNotNull(), F.col("_a") * F.col("_b")).otherwise(0)
    sizes = pairs.groupBy(user).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(both).alias("n_both"))
    return sizes.filter("n_a > 0")
