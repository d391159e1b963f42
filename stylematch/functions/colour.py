"""Colour parsing, mixing and similarity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylematch.vocab import ACCORD_MIX, OUTFIT_MIX

FULL_DISTANCE = 255 * math.sqrt(3)


def _integers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))


def rgb(text: Column) -> Column:
    """First three integers of any string; null when there are fewer than three."""
    numbers = _integers(text)
    parts = [F.get(numbers, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when(F.size(numbers) >= 3, F.array(*parts))


def rgb_or_hex(text: Column) -> Column:
    """``#RRGGBB`` or three integers; anything else is null (see ``rgb_fault``)."""
    clean = F.trim(text)
    hex_parts = [F.conv(F.substring(clean, start, 2), 16, 10).try_cast("int") for start in (2, 4, 6)]
    well_formed = clean.rlike("^#+[0-9A-Fa-f]{6}$") & (F.length(clean) == 7)
    return F.when(clean.startswith("#"), F.when(well_formed, F.array(*hex_parts))).otherwise(rgb(clean))


def rgb_fault(text: Column) -> Column:
    """Reason a colour string is refused, or null when it is usable."""
    clean = F.trim(text)
    return (
        F.when(text.isNull() | (clean == ""), F.lit("missing"))
        .when(clean.startswith("#") & rgb_or_hex(text).isNull(), F.lit("bad hex"))
        .when(rgb_or_hex(text).isNull(), F.lit("unsupported"))
    )


def rgb_or_white(text: Column) -> Column:
    return F.coalesce(rgb(text), F.array(F.lit(255), F.lit(255), F.lit(255)))


def channels(colour: Column) -> list[Column]:
    return [F.get(colour, F.lit(i)) for i in range(3)]


def _mix(colours: Sequence[Column], shares: Sequence[float]) -> Column:
    mixed = []
    for i in range(3):
        total = F.get(colours[0], F.lit(i)) * F.lit(shares[0])
        for colour, share in zip(colours[1:], shares[1:]):
            total = total + F.get(colour, F.lit(i)) * F.lit(share)
        mixed.append(total)
    complete = mixed[0].isNotNull() & mixed[1].isNotNull() & mixed[2].isNotNull()
    return F.when(complete, F.array(*mixed))


def mix_accords(first: Column, second: Column, third: Column) -> Column:
    """6:3:1 mix of three accord colours; null when one of them is missing or damaged."""
    return _mix([first, second, third], ACCORD_MIX)


def outfit_colour(dress: Column, top: Column, bottom: Column) -> Column:
    """Dress colour when there is a dress, else a 7:3 mix of top and bottom."""
    return F.when(dress.isNotNull(), dress.cast("array<double>")).otherwise(_mix([top, bottom], OUTFIT_MIX))


def similarity(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """0..100 similarity of two colours given as three channel columns each."""
    squares = [(x - y) * (x - y) for x, y in zip(a, b)]
    distance = F.sqrt(squares[0] + squares[1] + squares[2])
    return F.lit(100.0) * (F.lit(1.0) - distance / F.lit(FULL_DISTANCE))


def normal_accord_colour(text: Column, default: str) -> Column:
    """``rgb`` prefix added unless present; blank becomes the default colour."""
    clean = F.trim(text)
    blank = text.isNull() | (text == "")
    return F.when(blank, F.lit(default)).when(clean.startswith("rgb"), clean).otherwise(F.concat(F.lit("rgb"), clean))


def normal_clothes_rgb(text: Column, default: str) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(F.trim(text))
