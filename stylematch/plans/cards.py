"""Recommendation cards and prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.numbers import rounded
from stylematch.functions.season import best_columns
from stylematch.functions.text import filled_list, translate_code

# The texts of cards and prompt rows.
IMAGE_FOLDER = "/static/ui/perfume_images/"
NO_GENDER = "Unisex"
OUTFIT_START, OUTFIT_END = "전체적으로 ", "의 스타일"
TOP_WORD, BOTTOM_WORD, DRESS_WORD = "상의는", "하의는", "원피스는"
ACCORD_LINE = "  · 주요 향조: "
FAMILY_LINE = "  · 향의 결: "
SEASON_LINE = {"self": "  · 잘 어울리는 계절: ", "gift": "  · 추천 계절: "}
NO_FAMILY, NO_SEASON, NO_ACCORD = "복합적인 향", "사계절", "None"
SHORT_KIND = "짧은"


def _season_values() -> dict[str, Column]:
    return {s: F.col(s) for s in vocab.SEASONS}


def with_details(scores: DataFrame, items: DataFrame, seasons: DataFrame) -> DataFrame:
    """Score rows with their item and season columns."""
    return scores.join(items, "item_id").join(seasons.select("item_id", *vocab.SEASONS), "item_id", "left")


def result_cards(scores: DataFrame, items: DataFrame, seasons: DataFrame) -> DataFrame:
    """Item, brand, gender, rounded score, best season, accords and image address per score row."""
    names = [s.capitalize() for s in vocab.SEASONS]
    return with_details(scores, items, seasons).select(
        "user_id", "item_id", "name", "brand",
        F.coalesce(F.nullif("gender", F.lit("")), F.lit(NO_GENDER)).alias("gender"),
        rounded(F.col("myscore"), 3).alias("myscore"),
        best_columns(_season_values(), 1, names).alias("top_season"),
        filled_list(F.col("accord1"), F.col("accord2"), F.col("accord3")).alias("accords"),
        F.concat(F.lit(IMAGE_FOLDER), F.col("item_id").cast("string"), F.lit(".jpg")).alias("image_url"),
    )


def outfit_sentence(prefix: str = OUTFIT_START, suffix: str = OUTFIT_END) -> Column:
    """Sentence on the outfit parts that are present."""

    def garment(label: str, colour: str, category: str | None) -> Column:
        words = [F.lit(label), F.col(colour)]
        if category:
            words.append(F.coalesce(F.col(category), F.lit("")))
        return F.when(F.nullif(F.col(colour), F.lit("")).isNotNull(), F.concat_ws(" ", *words))

    parts = F.concat_ws(
        ", ",
        garment(TOP_WORD, "top_color", "top_category"),
        garment(BOTTOM_WORD, "bottom_color", "bottom_category"),
        garment(DRESS_WORD, "dress_color", None),
    )
    return F.concat(F.lit(prefix), parts, F.lit(suffix))


def item_block(style: str) -> Column:
    """Text block on one item; ``gift`` leaves out what is unknown, ``self`` writes a default."""
    accords = F.concat_ws(", ", *[F.coalesce(F.col(f"accord{i}"), F.lit(NO_ACCORD)) for i in (1, 2, 3)])
    korean = [vocab.SEASON_KOREAN[s] for s in vocab.SEASONS]
    seasons = best_columns(_season_values(), 2, korean)
    head = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("brand"), F.lit(")\n"))
    lines = [head, F.concat(F.lit(ACCORD_LINE), accords, F.lit("\n"))]
    if style == "gift":
        lines.append(F.coalesce(F.concat(F.lit(FAMILY_LINE), F.col("family"), F.lit("\n")), F.lit("")))
        lines.append(F.coalesce(F.concat(F.lit(SEASON_LINE[style]), seasons, F.lit("\n")), F.lit("")))
    else:
        family = F.coalesce(F.col("family"), F.lit(NO_FAMILY))
        lines.append(F.concat(F.lit(FAMILY_LINE), family, F.lit("\n")))
        lines.append(F.concat(F.lit(SEASON_LINE[style]), F.coalesce(seasons, F.lit(NO_SEASON)), F.lit("\n")))
    return F.concat(*lines, F.lit("\n"))


def prompt_rows(
    users: DataFrame, best: DataFrame, items: DataFrame, families: DataFrame, seasons: DataFrame, style: str = "self"
) -> DataFrame:
    """One row per user with the outfit sentence, the season and the blocks of its best items in rank order."""
    detailed = with_details(best, items, seasons).join(families, "item_id", "left")
    blocks = detailed.select("user_id", F.struct("rank", item_block(style).alias("text"), F.col("name").alias("name")).alias("b"))
    # at most k blocks per user: the input is a top k
    listed = blocks.groupBy("user_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return (
        users.withColumn("outfit", outfit_sentence()).join(listed, "user_id")
        .select(
            "user_id", "outfit", F.col("season"),
            F.array_join(F.transform("bs", lambda b: b["text"]), "").alias("items_text"),
            F.array_join(F.transform("bs", lambda b: b["name"]), ", ").alias("item_names"),
        )
    )


def gift_rows(prompts: DataFrame, recipient: str, occasion: str, kind: str) -> DataFrame:
    """Prompt rows with recipient and occasion labels and the length of the wanted text."""
    return prompts.select(
        "user_id", "item_names",
        translate_code(F.col(recipient), vocab.RECIPIENT_LABEL, vocab.DEFAULT_RECIPIENT).alias("recipient"),
        translate_code(F.col(occasion), vocab.OCCASION_LABEL, vocab.DEFAULT_OCCASION).alias("occasion"),
        F.when(F.col(kind) == SHORT_KIND, F.lit("short")).otherwise(F.lit("long")).alias("length"),
    )
