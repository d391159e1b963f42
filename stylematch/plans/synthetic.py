"""Random users drawn from the values of the clothes tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.operators.joins import outer_join_spread
from stylematch.operators.ordered import rank_in_group, with_position

# Accords the generator lets users dislike.
DISLIKES = ["woody", "lavender", "animalic", "powdery"]


def _draw(salt: str, seed: int) -> Column:
    return F.xxhash64(F.col("user_id"), F.lit(salt), F.lit(seed))


def _pick(options: list[str], salt: str, seed: int) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(_draw(salt, seed), F.lit(len(options))).cast("int"))


def _pick_value(users: DataFrame, table: DataFrame, column: str, out: str, when: Column, seed: int) -> DataFrame:
    """Uniform pick among the distinct values of a column: the drawn position meets the numbered values."""
    values = table.select(F.col(column).alias(out)).filter(F.col(out).isNotNull()).distinct()
    if values.schema[out].dataType.typeName() == "string":
        numbered = rank_in_group(values.withColumn("_all", F.lit(0)), "_all", out, "_pos").drop("_all")
    else:
        numbered = with_position(values, out, "_pos")
    n = values.count()
    drawn = users.withColumn("_pos", F.when(when, F.pmod(_draw(out, seed), F.lit(n)).cast("bigint")))
    return outer_join_spread(drawn, numbered, "_pos", "user_id").drop("_pos")


def random_users(ids: DataFrame, top_bottom: DataFrame, dresses: DataFrame, dress_share: float = 0.4, seed: int = 42) -> DataFrame:
    """One random outfit, season and dislike per ``user_id``; the same ids and seed give the same users."""
    share = F.pmod(_draw("shape", seed), F.lit(10000)) / F.lit(10000.0)
    users = ids.select("user_id").withColumn("_dress", share < F.lit(dress_share))
    two, one = ~F.col("_dress"), F.col("_dress")
    for table, column, out, when in (
        (top_bottom, "id", "top_id", two), (top_bottom, "top_category", "top_category", two),
        (top_bottom, "top_color", "top_color", two), (top_bottom, "id", "bottom_id", two),
        (top_bottom, "bottom_category", "bottom_category", two), (top_bottom, "bottom_color", "bottom_color", two),
        (dresses, "id", "dress_id", one), (dresses, "dress_color", "dress_color", one),
    ):
        users = _pick_value(users, table, column, out, when, seed)
    korean = [vocab.SEASON_KOREAN[s] for s in vocab.SEASONS]
    return users.withColumns({
        "season": _pick(korean, "season", seed), "disliked_accord": _pick(DISLIKES, "dislike", seed),
    }).drop("_dress")
