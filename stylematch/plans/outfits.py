"""Outfit label cleaning: nested documents to one-piece and two-piece tables, plus crop geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.functions.numbers import clamp_box, letterbox
from stylematch.functions.text import clean_key, name_prefix, path_safe
from stylematch.operators.filters import drop_matching, empty_to_null, one_outfit_shape, split_outfits, without_part
from stylematch.operators.ordered import drop_repeated_key, drop_similar
from stylematch.sources.outfit_labels import RECT, expand_labels, flatten_labels

COMPARED = ("top_", "bottom_", "dress_")


def clean_labels(docs: DataFrame) -> DataFrame:
    """Flat label rows: no outerwear, exactly one outfit shape, no collar and sub-colour columns."""
    wide = flatten_labels(docs)
    arrays = [c for c in wide.columns if c.startswith(("label_", "rect_"))]
    wide = without_part(empty_to_null(wide, arrays), "label_outer")
    shaped = one_outfit_shape(wide, "label_top", "label_bottom", "label_dress")
    return drop_matching(expand_labels(shaped), suffixes=("_collar", "_sub_color"))


def drop_repeats(rows: DataFrame, order: str, threshold: float = 0.7, ranges: int | None = None) -> DataFrame:
    """Both passes over neighbouring rows: similar attributes, then equal product prefix and style."""
    compared = [c for c in rows.columns if c.startswith(COMPARED)]
    first = drop_similar(rows, compared, order, threshold, ranges)
    keys = [clean_key(name_prefix(F.col("file_name"))), clean_key(F.col("style"))]
    return drop_repeated_key(first, keys, order, ranges)


def outfit_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one-piece table, two-piece table)."""
    return split_outfits(rows, "rect_dress", ("id", "file_name", "style", "sub_style"))


def crop_boxes(rows: DataFrame, part: str) -> DataFrame:
    """Usable crop boxes of a part: (id, pos, x1, y1, x2, y2)."""
    exploded = rows.select("id", "width", "height", F.posexplode(f"rect_{part}").alias("pos", "r"))
    box = clamp_box(
        *(F.col(f"r.`{RECT[k]}`") for k in ("x", "y", "w", "h")), F.col("width"), F.col("height")
    )
    return exploded.withColumns(box).filter("usable").select("id", "pos", "x1", "y1", "x2", "y2")


def fit_frames(images: DataFrame, width: int, height: int) -> DataFrame:
    placed = letterbox(F.col("width"), F.col("height"), F.lit(width), F.lit(height))
    return images.withColumns(placed)


def image_folders(rows: DataFrame, part: str) -> DataFrame:
    """File name and category/colour folder of each image of a part."""
    name = F.concat(path_safe(F.col("style")), F.lit("_"), path_safe(F.col("id")), F.lit(f"_{part}.jpg"))
    folder = F.concat_ws("/", F.lit(part), path_safe(F.col(f"{part}_category")), path_safe(F.col(f"{part}_color")))
    return rows.filter(F.col(f"{part}_category").isNotNull()).select("id", name.alias("file"), folder.alias("folder"))
