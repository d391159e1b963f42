"""Row filters, gates, searches and input checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brand_allow_list(df: DataFrame, brand: str, targets: Sequence[str]) -> DataFrame:
    """Keep rows whose brand, without ``-`` and lowercased, contains any target."""
    plain = F.lower(F.replace(F.col(brand), F.lit("-"), F.lit("")))
    hit = F.lit(False)
    for target in targets:
        hit = hit | plain.contains(target)
    return df.filter(F.coalesce(hit, F.lit(False)))


def drop_matching(
    df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()
) -> DataFrame:
    """Drop columns by name, prefix or suffix."""
    gone = [
        c for c in df.columns
        if c in names or c.startswith(tuple(prefixes) or ("\0",)) or c.endswith(tuple(suffixes) or ("\0",))
    ]
    return df.drop(*gone)


def keep_columns(df: DataFrame, columns: Sequence[str | int], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Keep columns by name or position, in the given order, then rename."""
    names = [df.columns[c] if isinstance(c, int) else c for c in columns]
    return df.select(*names).withColumnsRenamed(dict(rename or {}))


def exclude_term(df: DataFrame, text: str, term: str) -> DataFrame:
    """Drop rows whose text holds the term in any case; null text is kept."""
    return df.filter(~F.coalesce(F.lower(F.col(text)).contains(term.lower()), F.lit(False)))


def empty_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``[]`` and ``[{}]`` become null in array-of-struct or array-of-map columns."""

    def cleaned(name: str) -> Column:
        element = df.schema[name].dataType.elementType
        first = F.try_element_at(F.col(name), F.lit(1))
        if element.typeName() == "struct":
            blank = F.lit(True)
            for field in element.fieldNames():
                blank = blank & first.getField(field).isNull()
        elif element.typeName() == "map":
            blank = F.size(first) == 0
        else:
            blank = F.lit(False)
        size = F.size(F.col(name))
        return F.when((size == 0) | ((size == 1) & F.coalesce(blank, F.lit(True))), None).otherwise(F.col(name))

    return df.withColumns({c: cleaned(c) for c in columns})


def without_part(df: DataFrame, part: str) -> DataFrame:
    """Reject rows that have the given outfit part."""
    return df.filter(F.col(part).isNull())


def one_outfit_shape(df: DataFrame, top: str, bottom: str, dress: str) -> DataFrame:
    """Keep top and bottom without dress, or dress without top and bottom."""
    t, b, d = (F.col(c).isNotNull() for c in (top, bottom, dress))
    return df.filter((t & b & ~d) | (d & ~t & ~b))


def split_outfits(df: DataFrame, dress_rect: str, base: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(one-piece rows, two-piece rows), each with only its own columns."""
    have = [c for c in base if c in df.columns]
    dress = [c for c in df.columns if c == dress_rect or c.startswith("dress_")]
    two = [c for c in df.columns if c.startswith(("top_", "bottom_")) or c in ("rect_top", "rect_bottom")]
    return (
        df.filter(F.col(dress_rect).isNotNull()).select(*have, *dress),
        df.filter(F.col(dress_rect).isNull()).select(*have, *two),
    )


def recode(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def exclude_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows equal to the value; nulls stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def disliked(accords: Column, dislikes: Column) -> Column:
    """True when any accord is in the dislike list; null accords never match."""
    return F.coalesce(F.arrays_overlap(F.array_compact(accords), dislikes), F.lit(False))


def top_value_gate(scores: DataFrame, values: int = 2) -> DataFrame:
    """(style, family) pairs among the ``values`` largest distinct scores of a style."""
    by_style = Window.partitionBy("style").orderBy(F.col("score").desc())
    return (
        scores.withColumn("_level", F.dense_rank().over(by_style))
        .filter(F.col("_level") <= values)
        .select("style", "family")
    )


def nonzero_gate(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("score") > 0).select("style", "family")


def id_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def _holds(text: str, needle: str) -> Column:
    return F.lower(F.col(text)).contains(needle.lower())


def search_items(df: DataFrame, query: str, item_id: str = "item_id", limit: int = 20) -> DataFrame:
    """Name or brand contains the query; the brand is also tried with blanks and ``-`` taken from the query."""
    raw = query.strip()
    plain = raw.replace(" ", "").replace("-", "")
    if not plain:
        return df.limit(0)
    hit = _holds("name", raw) | _holds("brand", raw) | _holds("brand", plain)
    return df.filter(F.coalesce(hit, F.lit(False))).orderBy(item_id).limit(limit)


def search_terms(df: DataFrame, query: str, fields: Sequence[str], item_id: str = "item_id") -> DataFrame:
    """Every term must be found in at least one field."""
    hit = F.lit(True)
    for term in query.replace(",", " ").split():
        found = F.lit(False)
        for field in fields:
            found = found | F.coalesce(_holds(field, term), F.lit(False))
        hit = hit & found
    return df.filter(hit).orderBy(item_id)


def list_filter(
    df: DataFrame, facets: Mapping[str, str | None], text: str = "", fields: Sequence[str] = ()
) -> DataFrame:
    """Facet values AND text search on the listed columns."""
    for name, value in facets.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    if text:
        found = F.lit(False)
        for field in fields:
            found = found | F.coalesce(_holds(field, text), F.lit(False))
        df = df.filter(found)
    return df


def facet_counts(df: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n) for several facets in one pass."""
    entries = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.facet", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def outfit_fault(
    season: Column, top: Column, top_color: Column, bottom: Column, bottom_color: Column,
    onepiece: Column, onepiece_color: Column,
) -> Column:
    """Reason an outfit form is refused; null when it is complete."""

    def filled(*cols: Column) -> Column:
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.coalesce(c != "", F.lit(False))
        return ok

    return F.when(~filled(season), F.lit("season missing")).when(
        ~(filled(top, top_color, bottom, bottom_color) | filled(onepiece, onepiece_color)), F.lit("outfit incomplete")
    )


def validate_outfits(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with a ``reason``)."""
    names = ("season", "top", "top_color", "bottom", "bottom_color", "onepiece", "onepiece_color")
    checked = df.withColumn("reason", outfit_fault(*(F.col(n) for n in names)))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())
