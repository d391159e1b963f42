"""Season names and season columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylematch.functions.text import translate_code
from stylematch.vocab import SEASON_COLUMN, SEASONS


def season_column(name: Column) -> Column:
    """Korean or English season name to ``spring``/``summer``/``fall``/``winter``."""
    return translate_code(F.trim(name), SEASON_COLUMN)


def pick_season(name: Column, values: Mapping[str, Column]) -> Column:
    """Value of the column that belongs to the season name."""
    key = season_column(name)
    picked = None
    for season in SEASONS:
        picked = (F.when if picked is None else picked.when)(key == season, values[season])
    return picked


def best_columns(values: Mapping[str, Column], k: int = 1, labels: Sequence[str] | None = None) -> Column:
    """Names of the k largest columns joined by ``", "``; ties in column order, all null gives null."""
    names = list(labels or values.keys())
    entries = [
        F.struct((-col).alias("key"), F.lit(pos).alias("pos"), F.lit(name).alias("name"))
        for pos, (name, col) in enumerate(zip(names, values.values()))
    ]
    ordered = F.array_sort(F.filter(F.array(*entries), lambda e: e["key"].isNotNull()))
    best = F.transform(F.slice(ordered, 1, k), lambda e: e["name"])
    return F.when(F.size(best) > 0, F.array_join(best, ", "))
