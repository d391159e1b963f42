"""Number parsing, shares, scaling and box geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylematch.vocab import EPSILON


# plain decimal notation only: Spark's cast would also take suffixes such as "1d"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    clean = F.trim(text)
    return F.when(clean.rlike(_NUMBER), clean.try_cast("double"))


def decimal_comma(text: Column) -> Column:
    """``"3,9"`` is 3.9; blank or bad input is 0.0."""
    return F.coalesce(_number(F.replace(text, F.lit(","), F.lit("."))), F.lit(0.0))


def decimal_comma_int(text: Column) -> Column:
    return decimal_comma(text).cast("bigint")


def thousands_id(text: Column) -> Column:
    """``"1,234"`` is 1234 and ``"100026.0"`` is 100026; bad input is null."""
    return _number(F.replace(text, F.lit(","), F.lit(""))).cast("bigint")


def zero_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(0))


def share(part: Column, *parts: Column) -> Column:
    """Percent of ``part`` in the sum of ``parts``; 0 when the sum is 0 or a value is null."""
    return F.coalesce(F.try_divide(part.cast("double"), _total(*parts)), F.lit(0.0)) * F.lit(100.0)


def share_floor_one(part: Column, *parts: Column) -> Column:
    """As ``share``, with a zero sum replaced by 1."""
    total = _total(*parts)
    return F.try_divide(part.cast("double"), F.when(total == 0, F.lit(1.0)).otherwise(total)) * F.lit(100.0)


def _total(*parts: Column) -> Column:
    total = parts[0].cast("double")
    for p in parts[1:]:
        total = total + p.cast("double")
    return total


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0..1 scaling; a constant column gives 0."""
    return F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))


def smooth(value: Column, epsilon: float = EPSILON) -> Column:
    return (value + F.lit(epsilon)) / F.lit(1 + epsilon)


def weighted(style: Column, colour: Column, season: Column, w_style, w_colour, w_season) -> Column:
    cols = [w if isinstance(w, Column) else F.lit(float(w)) for w in (w_style, w_colour, w_season)]
    return cols[0] * style + cols[1] * colour + cols[2] * season


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Integer crop box inside the image. ``usable`` is false for empty or incomplete boxes."""
    left = F.greatest(F.lit(0), x.cast("int"))
    upper = F.greatest(F.lit(0), y.cast("int"))
    box_w, box_h = w.cast("int"), h.cast("int")
    right = F.least(width, left + box_w)
    lower = F.least(height, upper + box_h)
    usable = x.isNotNull() & y.isNotNull() & (box_w > 0) & (box_h > 0) & (left < right) & (upper < lower)
    return {"x1": left, "y1": upper, "x2": right, "y2": lower, "usable": F.coalesce(usable, F.lit(False))}


def letterbox(w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Size and offset of an image fitted into a frame with its ratio kept."""
    ratio = F.least(width / w, height / h)
    new_w, new_h = (w * ratio).cast("int"), (h * ratio).cast("int")
    return {
        "new_w": new_w,
        "new_h": new_h,
        "paste_x": F.floor((width - new_w) / 2).cast("int"),
        "paste_y": F.floor((height - new_h) / 2).cast("int"),
    }


def rounded(value: Column, digits: int = 3) -> Column:
    return F.bround(value, digits)
