"""Catalogue cleaning, from raw rows to a scored-ready item table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.functions.numbers import decimal_comma, decimal_comma_int, zero_to_null
from stylematch.functions.text import blank_to_null
from stylematch.operators.aggregates import accord_text, drop_rare, mask_rare
from stylematch.operators.filters import brand_allow_list, drop_matching, exclude_term
from stylematch.operators.ordered import with_position
from stylematch.sources.delimited import column_named


def select_brands(raw: DataFrame, order: str, targets: Sequence[str], brand: str = "brand") -> DataFrame:
    """Allow-listed brands without unused columns, with a dense 0-based ``item_id`` in file order."""
    kept = drop_matching(brand_allow_list(raw, brand, targets), names=("country", "year", "perfumer1", "perfumer2"))
    return with_position(kept, order, "item_id")


def clean_catalogue(
    items: DataFrame, accords: Sequence[str], threshold: int = 20, name: str = "name", mask: bool = False
) -> DataFrame:
    """No limited editions, accords as clean text, rare accords dropped (or masked)."""
    kept = accord_text(exclude_term(items, name, "limited-edition"), accords)
    return (mask_rare if mask else drop_rare)(kept, accords, threshold)


def load_items(raw: DataFrame) -> DataFrame:
    """Typed items from untidy text columns; header names match in any case."""

    def text(*names: str):
        found = column_named(raw, *names)
        return F.trim(F.col(found)) if found else F.lit("")

    def number(*names: str):
        found = column_named(raw, *names)
        return F.col(found) if found else F.lit(None).cast("string")

    accords = [blank_to_null(number(f"mainaccord{i}")).alias(f"accord{i}") for i in range(1, 6)]
    key = number("perfume_id", "item_id")
    return raw.filter(key.isNotNull() & (key != "")).select(
        decimal_comma_int(key).alias("item_id"), text("url").alias("url"), text("perfume", "name").alias("name"),
        text("brand").alias("brand"), text("country").alias("country"), text("gender").alias("gender"),
        decimal_comma(number("ratingvalue", "rating_value")).alias("rating_value"),
        decimal_comma_int(number("ratingcount", "rating_count")).alias("rating_count"),
        zero_to_null(decimal_comma_int(number("year"))).alias("year"),
        text("top").alias("top"), text("middle").alias("middle"), text("base").alias("base"), *accords,
    )
