"""Typed tables from untidy text tables, one loader per table.

Items are loaded by ``plans.catalogue.load_items``. Load order: colours, items, seasons and families (which need their
items), garments, users and ratings (which refer to garments and items), scores, weights.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.colour import normal_accord_colour, normal_clothes_rgb
from stylematch.functions.numbers import decimal_comma, thousands_id
from stylematch.functions.text import blank_to_null
from stylematch.operators.joins import soft_reference, with_parent
from stylematch.sources.delimited import column_named

# Header names met in the files, per column.
GARMENT_HEADERS = {
    "id": ("식별자", "id"), "style": ("스타일", "style"), "sub_style": ("서브스타일", "sub_style"),
    "top_color": ("상의_색상",), "top_category": ("상의_카테고리",), "top_sleeve_length": ("상의_소매기장",),
    "top_material": ("상의_소재",), "top_print": ("상의_프린트",), "top_neckline": ("상의_넥라인",), "top_fit": ("상의_핏",),
    "bottom_length": ("하의_기장",), "bottom_color": ("하의_색상",), "bottom_category": ("하의_카테고리",),
    "bottom_material": ("하의_소재",), "bottom_fit": ("하의_핏",),
}
DRESS_HEADERS = {
    "id": ("식별자", "id"), "style": ("스타일", "style"), "sub_style": ("서브스타일", "sub_style"),
    "dress_length": ("원피스_기장",), "dress_color": ("원피스_색상",), "dress_sleeve_length": ("원피스_소매기장",),
    "dress_material": ("원피스_소재",), "dress_print": ("원피스_프린트",), "dress_neckline": ("원피스_넥라인",),
    "dress_fit": ("원피스_핏",), "dress_detail": ("원피스_디테일",),
}
USER_HEADERS = {
    "user_id": ("사용자_식별자", "user_id"), "top_id": ("상의_식별자", "top_id"), "bottom_id": ("하의_식별자", "bottom_id"),
    "dress_id": ("원피스_식별자", "dress_id"), "season": ("계절", "season"), "disliked_accord": ("비선호_향조", "disliked_accord"),
}
RATING_HEADERS = {
    "rate_id": ("rate_id",), "smelling_user_id": ("smelling_user_id",),
    "top_id": ("상의_식별자",), "top_color": ("상의_색상",), "top_category": ("상의_카테고리",), "top_img": ("상의_이미지_경로",),
    "bottom_id": ("하의_식별자",), "bottom_color": ("하의_색상",), "bottom_category": ("하의_카테고리",),
    "bottom_img": ("하의_이미지_경로",), "dress_id": ("원피스_식별자",), "dress_color": ("원피스_색상",),
    "dress_img": ("원피스_이미지_경로",), "season": ("계절",), "item_id": ("perfume_id",), "brand": ("brand",),
    "perfume_img_url": ("perfume_img_url",), "smelling_rate": ("smelling_rate",),
}


def _text(raw: DataFrame, names: Sequence[str]) -> Column:
    found = column_named(raw, *names)
    return blank_to_null(F.col(f"`{found}`").cast("string")) if found else F.lit(None).cast("string")


def _typed(raw: DataFrame, headers: Mapping[str, Sequence[str]], ids: Sequence[str]) -> DataFrame:
    cols = {name: _text(raw, names) for name, names in headers.items()}
    return raw.select(*[(thousands_id(c) if name in ids else c).alias(name) for name, c in cols.items()])


def load_accord_colours(raw: DataFrame) -> DataFrame:
    """(accord, color): any header that holds ``mainaccord``; blank colours get the default."""
    accord = next(c for c in raw.columns if "mainaccord" in c.lower())
    rows = raw.select(blank_to_null(F.col(f"`{accord}`")).alias("accord"), _text(raw, ("color",)).alias("color"))
    return rows.filter("accord IS NOT NULL").withColumn("color", normal_accord_colour(F.col("color"), vocab.DEFAULT_ACCORD_COLOUR))


def load_clothes_colours(raw: DataFrame) -> DataFrame:
    rows = raw.select(_text(raw, ("color",)).alias("color"), _text(raw, ("rgb_tuple",)).alias("rgb_tuple"))
    return rows.filter("color IS NOT NULL").withColumn("rgb_tuple", normal_clothes_rgb(F.col("rgb_tuple"), vocab.DEFAULT_CLOTHES_RGB))


def load_seasons(raw: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(season votes of known items, rows skipped because their item is unknown)."""
    key = thousands_id(_text(raw, ("perfume_id", "item_id"))).alias("item_id")
    votes = raw.select(key, *[decimal_comma(_text(raw, (s,))).alias(s) for s in vocab.SEASONS])
    return with_parent(votes.filter("item_id IS NOT NULL"), items, "item_id")


def load_families(raw: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(families of known items, rows skipped because their item is unknown)."""
    key = thousands_id(_text(raw, ("perfume_id", "item_id"))).alias("item_id")
    rows = raw.select(key, _text(raw, ("fragrance", "family")).alias("family"))
    return with_parent(rows.filter("item_id IS NOT NULL"), items, "item_id")


def load_top_bottom(raw: DataFrame) -> DataFrame:
    return _typed(raw, GARMENT_HEADERS, ("id",)).filter("id IS NOT NULL")


def load_dresses(raw: DataFrame) -> DataFrame:
    return _typed(raw, DRESS_HEADERS, ("id",)).filter("id IS NOT NULL")


def _known_parts(rows: DataFrame, top_bottom: DataFrame, dresses: DataFrame, row_id: str) -> DataFrame:
    for part, source in (("top", top_bottom), ("bottom", top_bottom), ("dress", dresses)):
        rows = soft_reference(rows, f"{part}_id", source, "id", row_id)
    return rows


def load_users(raw: DataFrame, top_bottom: DataFrame, dresses: DataFrame) -> DataFrame:
    """Users with a usable id; unknown garments become null."""
    rows = _typed(raw, USER_HEADERS, ("user_id", "top_id", "bottom_id", "dress_id"))
    users = rows.filter("user_id IS NOT NULL AND user_id <> 0")
    return _known_parts(users, top_bottom, dresses, "user_id").select(*USER_HEADERS)


def load_ratings(raw: DataFrame, top_bottom: DataFrame, dresses: DataFrame, items: DataFrame) -> DataFrame:
    """The rating log; unknown garments and items become null."""
    numbers = ("rate_id", "smelling_user_id", "top_id", "bottom_id", "dress_id", "item_id", "smelling_rate")
    rows = _known_parts(_typed(raw, RATING_HEADERS, numbers), top_bottom, dresses, "rate_id")
    return soft_reference(rows, "item_id", items, "item_id", "rate_id").select(*RATING_HEADERS)


def load_scores(raw: DataFrame) -> DataFrame:
    """Stored scores with six decimals, keyed by user and item; bad numbers are null."""
    key = {"user_id": ("user_id",), "item_id": ("perfume_id", "item_id")}
    cols = [thousands_id(_text(raw, n)).alias(c) for c, n in key.items()]
    scores = [
        _text(raw, (c,)).try_cast("double").try_cast("decimal(10,6)").alias(c)
        for c in ("color_score", "season_score", "style_score", "myscore")
    ]
    return raw.select(*cols, *scores)


def first_weights(spark: SparkSession) -> DataFrame:
    """The seed row of the weight history: all weights 1."""
    return vocab.literal_table(spark, "weight_id, style_weight, color_weight, season_weight", [(1, 1.0, 1.0, 1.0)])
