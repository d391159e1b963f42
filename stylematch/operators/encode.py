"""Encoders, splits and resampling for the style classifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylematch.functions.text import any_list
from stylematch.operators.joins import salted_join
from stylematch.operators.ordered import rank_in_group
from stylematch.session import stage

#: Draws of one run when rows are drawn with replacement.
DRAWS = 10_000


def list_like_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, list_like): does any value look like a list (``[...]`` or a comma)?"""
    names = list(columns or df.columns)
    flags = [F.coalesce(F.bool_or(F.col(c).cast("string").rlike(r"\[.*\]|,")), F.lit(False)).alias(c) for c in names]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("list_like")) for c in names]
    return df.agg(*flags).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def multi_hot_rows(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """Distinct (row_id, class) pairs of a list column: the long form of the 0/1 matrix."""
    return df.select(row_id, F.explode(F.array_distinct(any_list(F.col(column)))).alias("class"))


def class_index(rows: DataFrame) -> DataFrame:
    """(class, place): the classes of the long form in order, numbered from 0 without gathering them anywhere."""
    named = rows.select("class", F.lit(0).alias("all")).distinct()
    return rank_in_group(named, "all", "class", "place").select("class", "place")


def multi_hot_sparse(df: DataFrame, row_id: str, column: str) -> tuple[DataFrame, DataFrame]:
    """((row_id, indices), (class, place)): the 0/1 matrix as sparse rows, for any number of classes.

    A row's indices are the places of its classes in order; a row without classes has none.
    """
    rows = multi_hot_rows(df, row_id, column)
    index = stage(class_index(rows), "classes")
    places = salted_join(rows, index, "class", row_id).groupBy(row_id).agg(F.array_sort(F.collect_set("place")).alias("indices"))
    out = df.select(row_id).distinct().join(places, row_id, "left")
    return out.select(row_id, F.coalesce("indices", F.array().cast("array<int>")).alias("indices")), index


def multi_hot(df: DataFrame, row_id: str, column: str, classes: Sequence[str]) -> DataFrame:
    """One 0/1 column per class of ``classes``, named ``column_class``. ``multi_hot_sparse`` needs no list of classes."""
    lists = F.array_distinct(any_list(F.col(column)))
    flags = [F.array_contains(lists, c).cast("int").alias(f"{column}_{c}") for c in classes]
    return df.select(row_id, *flags)


def ordinal_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dictionary (column, value, code): 0-based position of each value in sorted order."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    values = (
        df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        .filter(F.col("value").isNotNull()).distinct()
    )
    return rank_in_group(values, "column", "value", "code")


def ordinal_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame) -> DataFrame:
    """Replace values by their codes; unknown values give -1."""
    for c in columns:
        side = codes.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"_{c}"))
        df = df.join(side, c, "left").withColumn(c, F.coalesce(F.col(f"_{c}"), F.lit(-1))).drop(f"_{c}")
    return df


def label_decode(df: DataFrame, column: str, codes: DataFrame, name: str, out: str) -> DataFrame:
    side = codes.filter(F.col("column") == name).select(F.col("code").alias(column), F.col("value").alias(out))
    return df.join(side, column, "left")


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_share: float = 0.2, seed: int = 42, cell_rows: int = 10_000
) -> DataFrame:
    """Adds ``is_test``: exactly round(n * test_share) rows of each class, chosen by hash order.

    Rows are counted per (class, hash cell) and the cells of a class are chained by their counts. A cell lies
    before or behind the border of its class as a whole; only the rows of the border cell are ranked. There are as many
    cells as the largest class has ``cell_rows`` rows, so that cell does not grow with the table.
    """
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cells = largest // cell_rows + 1
    hashed = df.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    hashed = hashed.withColumn("_cell", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(cells)))
    sizes = hashed.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_size"))
    in_class = Window.partitionBy(label)
    before = in_class.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = stage(sizes.select(
        F.col(label).alias("_label"), F.col("_cell").alias("_c"), "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.round(F.sum("_size").over(in_class) * F.lit(test_share)).cast("bigint").alias("_n_test"),
    ), "cells")
    placed = hashed.join(plan, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_cell") == F.col("_c")))
    first, last, n_test = F.col("_before"), F.col("_before") + F.col("_size"), F.col("_n_test")
    border = (first < n_test) & (last > n_test)
    rank = F.row_number().over(Window.partitionBy("_label", "_c").orderBy("_h", row_id))
    whole = placed.filter(~border).withColumn("is_test", last <= n_test)
    ranked = placed.filter(border).withColumn("is_test", first + rank <= n_test)
    return whole.unionByName(ranked).select(*df.columns, "is_test")


def oversample(df: DataFrame, label: str, targets: Mapping[str, int], row_id: str, seed: int = 42) -> DataFrame:
    """Repeat rows of the named classes until each has its target count; larger classes stay as they are.

    Only classes below their target are ranked, so the ranked groups are smaller than the largest target.
    """
    pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(int(v)))]
    target = F.try_element_at(F.create_map(*pairs), F.col(label))
    counts = df.filter(F.col(label).isin(list(targets))).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    short = counts.withColumn("_target", target).filter(F.col("_n") < F.col("_target"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(row_id), F.lit(seed)), row_id))
    grown = df.join(short, label).withColumn("_rn", rank)
    copies = F.floor(F.col("_target") / F.col("_n")) + F.when(
        F.col("_rn") <= F.col("_target") % F.col("_n"), F.lit(1)
    ).otherwise(F.lit(0))
    repeated = grown.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    untouched = df.join(short.select(label), label, "left_anti")
    return untouched.unionByName(repeated.select(*df.columns))


def oversample_drawn(df: DataFrame, label: str, targets: Mapping[str, int], row_id: str, seed: int = 42) -> DataFrame:
    """Grow the named classes to exactly their target counts by draws with replacement; every row also stays once.

    Draw i of a class of n rows takes the row at place hash(class, i, seed) mod n in the order of the unique ``row_id``,
    so reruns agree whatever the partitions. Draws are made in runs of ``DRAWS`` and counted per row and run before
    they meet the rows, and rows are numbered by ranges: no class is one task, and no row carries a long list of copies.
    """
    pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
    target = F.try_element_at(F.create_map(*pairs), F.col(label))
    counts = df.filter(F.col(label).isin(list(targets))).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    short = stage(counts.withColumn("_more", target - F.col("_n")).filter("_more > 0"), "short")
    runs = short.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_more") - 1) / DRAWS))))
    first = F.col("_run") * DRAWS
    draws = runs.repartition(label, "_run").withColumn("_draw", F.explode(F.sequence(first, F.least(first + DRAWS, F.col("_more")) - 1)))
    place = F.pmod(F.xxhash64(label, "_draw", F.lit(seed)), F.col("_n")).cast("int")
    drawn = draws.withColumn("_place", place).groupBy(label, "_place", "_run").agg(F.count(F.lit(1)).cast("int").alias("_draws"))
    placed = rank_in_group(df.join(short.select(label), label, "left_semi"), label, row_id, "_place")
    repeated = placed.join(drawn, [label, "_place"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_draws"))))
    return df.unionByName(repeated.select(*df.columns))
