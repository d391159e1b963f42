"""String and list functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_list(text: Column, keep_blank: bool = True) -> Column:
    """Comma list to array of trimmed strings; null gives an empty array."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    if not keep_blank:
        parts = F.filter(parts, lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), empty).otherwise(parts)


def any_list(text: Column) -> Column:
    """List in whatever shape it was written: quoted list literal, or split on , then | / ;

    Null gives ``["nan"]``. Empty parts are dropped.
    """
    clean = F.trim(text)
    literal = clean.rlike(r"^\[\s*('[^']*'|\"[^\"]*\")(\s*,\s*('[^']*'|\"[^\"]*\"))*\s*,?\s*\]$")
    quoted = F.regexp_extract_all(clean, F.lit("'([^']*)'|\"([^\"]*)\""), F.lit(0))
    unquoted = F.transform(quoted, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x) - 2)))

    def cut(sep: str) -> Column:
        return _filled(F.transform(F.split(clean, sep), lambda x: F.trim(x)))

    return (
        F.when(text.isNull(), F.array(F.lit("nan")))
        .when(clean.rlike(r"^\[\s*\]$"), F.array().cast("array<string>"))
        .when(literal, _filled(unquoted))
        .when(clean.contains(","), cut(","))
        .when(clean.contains("|"), cut(r"\|"))
        .when(clean.contains("/"), cut("/"))
        .when(clean.contains(";"), cut(";"))
        .otherwise(F.array(clean))
    )


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def first_element(items: Column) -> Column:
    """Element 0, or null when the array is empty or null."""
    return F.try_element_at(items, F.lit(1))


def join_list(items: Column) -> Column:
    return F.array_join(items, ", ")


def filled_list(*cols: Column) -> Column:
    """Array of the columns that are not null."""
    return F.array_compact(F.array(*cols))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def clean_key(text: Column) -> Column:
    return F.trim(F.lower(text))


def name_prefix(text: Column) -> Column:
    return F.split_part(text, F.lit("_"), F.lit(1))


def path_safe(text: Column) -> Column:
    filled = F.nullif(text.cast("string"), F.lit(""))
    return F.coalesce(F.replace(F.trim(filled), F.lit("/"), F.lit("_")), F.lit("unknown"))


def pair(first: Column, second: Column, null_text: str | None = None) -> Column:
    """``first_second``; null when one is null, or with nulls written as ``null_text``."""
    if null_text is not None:
        first, second = F.coalesce(first, F.lit(null_text)), F.coalesce(second, F.lit(null_text))
    return F.concat(first, F.lit("_"), second)


def translate_code(code: Column, labels: Mapping[str, str], default: str | None = None) -> Column:
    """Code to label by a fixed mapping; unknown codes give the default (null)."""
    entries = [F.lit(v) for kv in labels.items() for v in kv]
    found = F.try_element_at(F.create_map(*entries), code)
    return found if default is None else F.coalesce(found, F.lit(default))


def percent_encode(text: Column) -> Column:
    """Percent-encoding for a path segment; ``/`` stays as it is."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    encoded = F.replace(encoded, F.lit("%2F"), F.lit("/"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def image_record(name: Column, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "webp")) -> Column:
    """``style_id_part.ext`` to its integer id; null when the name has another shape."""
    allowed = F.lower(name).rlike(r"\.(" + "|".join(extensions) + ")$")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    number = F.trim(F.get(parts, F.lit(1)))
    return F.when(allowed & (F.size(parts) >= 3) & number.rlike(r"^[+-]?\d+$"), number.try_cast("bigint"))
