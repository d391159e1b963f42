"""Enrichment, lookup, parent-check and salted joins.

No join here is hinted as a broadcast: dimension sides are read with their real sizes, so
Spark broadcasts them only under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.session import shuffle_width, stage

# part -> columns taken from its clothes table
PART_COLUMNS = {
    "top": ["top_material", "top_fit", "top_print", "top_neckline", "top_sleeve_length"],
    "bottom": ["bottom_material", "bottom_fit", "bottom_length"],
    "dress": ["dress_material", "dress_fit", "dress_print", "dress_detail", "dress_neckline", "dress_length"],
}


def enrich_outfits(
    users: DataFrame, top_bottom: DataFrame, dresses: DataFrame, extra: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Left joins user -> top, bottom (same table) and dress; the sub-style is renamed per part."""
    wide = users
    for part, source in (("top", top_bottom), ("bottom", top_bottom), ("dress", dresses)):
        wanted = PART_COLUMNS[part] + list((extra or {}).get(part, ()))
        cols = [F.col(c) for c in wanted if c in source.columns]
        side = source.select(
            F.col("id").alias(f"{part}_id"), *cols, F.col("sub_style").alias(f"{part}_sub_style")
        )
        wide = outer_join_spread(wide, side, f"{part}_id", "user_id")
    return wide


def unknown_outfits(users: DataFrame, top_bottom: DataFrame, dresses: DataFrame) -> DataFrame:
    """Users that name an outfit id absent from its table: (user_id, part, missing_id)."""
    missing = None
    for part, source in (("top", top_bottom), ("bottom", top_bottom), ("dress", dresses)):
        named = users.filter(F.col(f"{part}_id").isNotNull())
        lost = named.join(source.select(F.col("id").alias(f"{part}_id")), f"{part}_id", "left_anti").select(
            "user_id", F.lit(part).alias("part"), F.col(f"{part}_id").alias("missing_id")
        )
        missing = lost if missing is None else missing.unionByName(lost)
    return missing


def known_outfits(users: DataFrame, top_bottom: DataFrame, dresses: DataFrame) -> DataFrame:
    """Users whose named outfit parts all exist."""
    lost = unknown_outfits(users, top_bottom, dresses).select("user_id").distinct()
    return users.join(lost, "user_id", "left_anti")


def lookup(
    df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str, default: Column | None = None
) -> DataFrame:
    """Dictionary lookup by left join; a missing key gives the default (null)."""
    side = table.select(F.col(table_key).alias(key), F.col(value).alias(out))
    joined = df.join(side, key, "left")
    return joined if default is None else joined.withColumn(out, F.coalesce(F.col(out), default))


def with_parent(child: DataFrame, parent: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(children with a parent, orphans)."""
    keys = parent.select(key)
    return child.join(keys, key, "left_semi"), child.join(keys, key, "left_anti")


def soft_reference(child: DataFrame, column: str, parent: DataFrame, parent_key: str, row_id: str) -> DataFrame:
    """Unmatched references become null; rows stay."""
    known = parent.select(F.col(parent_key).alias(column)).distinct().withColumn("_found", F.col(column))
    joined = outer_join_spread(child, known, column, row_id)
    return joined.withColumn(column, F.col("_found")).drop("_found")


def first_match(choices: DataFrame, table: DataFrame, on: Sequence[str], id_col: str, out: str) -> DataFrame:
    """Lowest id per key of the table, joined to the choices; no match gives null."""
    lowest = table.groupBy(*on).agg(F.min(id_col).alias(out))
    return choices.join(lowest, list(on), "left")


def first_garment(choices: DataFrame, garments: DataFrame, part: str, out: str, id_col: str = "id") -> DataFrame:
    """Lowest garment id for the chosen part: a dress by its colour, a top or bottom by category and colour.

    Tops and bottoms need both choices as columns; a row in which one of them is null matches nothing.
    """
    wanted = [f"{part}_color"] if part == "dress" else [f"{part}_category", f"{part}_color"]
    missing = [c for c in wanted if c not in choices.columns]
    if missing:
        raise ValueError(f"a {part} is chosen by {' and '.join(wanted)}: {', '.join(missing)} is missing")
    return first_match(choices, garments, wanted, id_col, out)


def agreement(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Share of keys on which two labelings agree; null never agrees."""
    joined = a.select(key, F.col(left).alias("_l")).join(b.select(key, F.col(right).alias("_r")), key)
    same = F.coalesce((F.col("_l") == F.col("_r")).cast("int"), F.lit(0))
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.sum(same).alias("n_equal"), F.avg(same).alias("match_ratio")
    )


def latest_bundle(log: DataFrame, session: str, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Rows of the newest session with their item names."""
    newest = log.agg(F.max(session).alias(session))
    return log.join(newest, session).join(items.select(item_id, "name"), item_id, "left")


SALT_ROWS = 100_000


def salted_join(big: DataFrame, small: DataFrame, key: str, row_id: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Equi-join that spreads every frequent key of ``big`` over one salt per ``SALT_ROWS`` of its rows.

    ``counts`` holds (key, n) where they are known already; only the keys that get more than one salt are used of them.
    Both sides take the number of salts from that table, so the small side is copied once per salt of a key and a
    salted key is never more than about ``SALT_ROWS`` rows in a task, however frequent it is.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = stage(counts.filter(F.col("n") > SALT_ROWS).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("_salts")), "hot")
    if hot.isEmpty():
        return big.join(small, key, how)
    salts = F.coalesce("_salts", F.lit(1))
    # fewer than rows / SALT_ROWS keys are hot; both sides learn their salts from that table
    salted = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(F.col(row_id)), salts).cast("int")).drop("_hot", "_salts")
    copied = small.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_salts")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


def fanned_join(left: DataFrame, right: DataFrame, key: str, left_id: str, fan: int | None = None) -> DataFrame:
    """Equi-join on a key with few values, in which every left row grows by the right rows of its key.

    The right side is copied once per slot and every left row goes to the slot of its id, so that a key with many rows
    is spread over all slots; the same form serves all sizes. The left side is placed with a fixed width (a width chosen
    by its own small size would put the growth into one task), and windows by (key, _slot, left_id) need no further
    shuffle.
    """
    width = shuffle_width(left.sparkSession)
    fan = fan or width
    slotted = left.withColumn("_slot", F.pmod(F.xxhash64(F.col(left_id)), F.lit(fan)).cast("int"))
    copied = right.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    return slotted.repartition(width, key, "_slot").join(copied, [key, "_slot"])


def outer_join_spread(left: DataFrame, right: DataFrame, key: str, row_id: str, spots: int = 1024) -> DataFrame:
    """Left join on one key; rows whose key is null are spread by their id instead of meeting in one task.

    The key keeps its type, so keys of two types meet as in a plain join.
    """
    spot = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(F.col(row_id)), F.lit(spots)).cast("int")).otherwise(F.lit(-1))
    keyed = left.withColumn("_spot", spot)
    side = right.withColumnRenamed(key, "_key").withColumn("_at", F.lit(-1))
    return keyed.join(side, (F.col(key) == F.col("_key")) & (F.col("_spot") == F.col("_at")), "left").drop("_key", "_spot", "_at")


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per key; the limit is applied before the shuffle as well."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1).drop("_rn")
