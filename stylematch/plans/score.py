"""Style, colour and season scores of users against items.

Nothing here pairs users with items. A user enters a score only through a *profile* (style, outfit colour,
season, dislikes that name an item accord), an item only through a *signature* (family and accords) and its season
share. Both consist of vocabulary values only (styles, outfit colours, seasons, sets of accords; families, accords), not
of free text. Inside a signature only the k best season shares can reach a top k, so the item side is
cut to k rows per (season, signature) before the shuffle, and profiles meet signatures instead of items.

Top lists go one step further: dislikes are no part of what is ranked. Signatures are ranked once per *base* (style,
season, outfit colour), and every profile of a base reads that list from the top, skipping what it dislikes
(``operators/exclusion.py``). However many sets of dislikes there are, the pairs are those of the bases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.functions.colour import channels, mix_accords, outfit_colour, rgb_or_white, similarity
from stylematch.functions.numbers import min_max, share, smooth, weighted
from stylematch.functions.season import season_column
from stylematch.functions.text import trimmed_list
from stylematch.operators.aggregates import newest_row
from stylematch.operators.exclusion import Ranking, first_allowed
from stylematch.operators.filters import disliked
from stylematch.operators.joins import fanned_join, lookup
from stylematch.operators.ranking import scale_by_group, top_k
from stylematch.session import shuffle_width, stage
from stylematch.vocab import EPSILON, SEASONS

ACCORDS = ["accord1", "accord2", "accord3"]
SEP = "\x1f"
NO_VALUE = "\x00"


def _white() -> Column:
    return rgb_or_white(F.lit(None).cast("string"))


def item_features(
    items: DataFrame, accord_colours: DataFrame, families: DataFrame, seasons: DataFrame,
    missing_colour: str = "drop", missing_season: str = "drop",
) -> DataFrame:
    """Items with family, mixed colour (f0, f1, f2) and the four season shares.

    ``missing_colour`` is drop, null or white; ``missing_season`` is drop, null or zero. Items without a
    family row are not scored.
    """
    out = items.select("item_id", *ACCORDS).join(families.select("item_id", "family"), "item_id")
    default = _white() if missing_colour == "white" else None
    for c in ACCORDS:
        out = lookup(out, c, accord_colours, "accord", "rgb", f"{c}_rgb", default)
    mixed = mix_accords(*[F.col(f"{c}_rgb") for c in ACCORDS])
    out = out.withColumn("_mix", mixed).withColumns(
        {f"f{i}": c for i, c in enumerate(channels(F.col("_mix")))}
    ).drop("_mix", *[f"{c}_rgb" for c in ACCORDS])
    if missing_colour == "drop":
        out = out.filter(F.col("f0").isNotNull())
    votes = seasons.select("item_id", *SEASONS)
    shares = votes.select(
        "item_id", *[share(F.col(s), *[F.col(x) for x in SEASONS]).alias(s) for s in SEASONS]
    )
    out = out.join(shares, "item_id", "inner" if missing_season == "drop" else "left")
    return out.fillna(0.0, SEASONS) if missing_season == "zero" else out


def unscored_items(items: DataFrame, accord_colours: DataFrame, families: DataFrame, seasons: DataFrame) -> DataFrame:
    """Items the strict rules refuse, with the reason."""
    known = accord_colours.select("accord")
    reasons = [
        items.join(families.select("item_id"), "item_id", "left_anti")
        .select("item_id", F.lit("no family row").alias("reason")),
        items.join(seasons.select("item_id"), "item_id", "left_anti")
        .select("item_id", F.lit("no season row").alias("reason")),
    ]
    for c in ACCORDS:
        lost = items.join(known.withColumnRenamed("accord", c), c, "left_anti")
        reasons.append(lost.select("item_id", F.lit(f"{c} has no colour").alias("reason")))
    out = reasons[0]
    for r in reasons[1:]:
        out = out.unionByName(r)
    return out


def by_season(features: DataFrame) -> DataFrame:
    """One row per (item, season) with its share."""
    entries = [F.struct(F.lit(s).alias("season"), F.col(s).alias("share")) for s in SEASONS]
    rest = [c for c in features.columns if c not in SEASONS]
    return features.select(*rest, F.explode(F.array(*entries)).alias("e")).select(*rest, "e.season", "e.share")


def known_accords(features: DataFrame) -> Column:
    """The accords of the scored items as one array: the vocabulary, whatever the number of items."""
    named = features.select(F.explode(F.array(*ACCORDS)).alias("accord")).filter(F.col("accord").isNotNull()).distinct()
    return named.agg(F.array_sort(F.collect_list("accord")).alias("accords")).scalar()


def user_profiles(users: DataFrame, clothes_colours: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Users with ``profile`` and its parts. Users without season, style or a complete outfit colour are left out.

    Dislikes count only with the items' ``features`` given, and only those that name an accord of an item: other words
    cannot exclude anything, so free text makes no profiles of its own.
    """
    out = users
    for part in ("dress", "top", "bottom"):
        out = lookup(out, f"{part}_color", clothes_colours, "color", "rgb", f"_{part}")
    vector = outfit_colour(F.col("_dress"), F.col("_top"), F.col("_bottom"))
    named_dress = F.col("dress_color").isNotNull() & F.col("_dress").isNull()
    dislikes = F.array_sort(F.array_distinct(trimmed_list(F.col("disliked_accord"), keep_blank=False)))
    none = F.array().cast("array<string>")
    parts = {
        "style": F.col("user_style"),
        "season": season_column(F.col("season")),
        "_vec": F.when(~named_dress, vector),
        "dislikes": none if features is None else F.array_intersect(dislikes, known_accords(features)),
    }
    out = out.withColumns(parts).withColumns({f"c{i}": c for i, c in enumerate(channels(F.col("_vec")))})
    key = F.concat_ws(SEP, "style", "season", "c0", "c1", "c2", F.array_join("dislikes", ","))
    return (
        out.filter(F.col("style").isNotNull() & F.col("season").isNotNull() & F.col("c0").isNotNull())
        .withColumn("profile", key)
        .select("user_id", "profile", "style", "season", "c0", "c1", "c2", "dislikes")
    )


def distinct_profiles(profiled: DataFrame) -> DataFrame:
    return profiled.select("profile", "style", "season", "c0", "c1", "c2", "dislikes").distinct()


def _share_order(season_weight: float) -> list[Column]:
    """Order of items that differ only in season share."""
    if season_weight == 0:
        return [F.col("item_id")]
    share_first = F.col("share").desc_nulls_last() if season_weight > 0 else F.col("share").asc_nulls_last()
    return [share_first, F.col("item_id")]


def item_signatures(features: DataFrame, k: int, season_weight: float | None = 1.0) -> DataFrame:
    """(season, signature) with colour, family, accords, share range and its k best items in order.

    Without a season weight the list holds every item that some non-negative weight could need: the k best
    shares and, for weight 0, the k lowest ids.
    """
    names = ["family", *ACCORDS]
    signature = F.concat_ws(SEP, *[F.coalesce(F.col(c), F.lit(NO_VALUE)) for c in names])
    rows = by_season(features).withColumn("signature", signature)
    key = ["season", "signature"]
    ranges = rows.groupBy(*key, *names, "f0", "f1", "f2").agg(
        F.min("share").alias("low_share"), F.max("share").alias("high_share")
    )
    slim = rows.select(*key, "share", "item_id")
    if season_weight is None:
        both = [top_k(slim, key, _share_order(w), k) for w in (1.0, 0.0)]
        best = both[0].unionByName(both[1]).distinct().withColumn("pos", F.lit(0))
    else:
        best = top_k(slim, key, _share_order(season_weight), k, rank="pos")
    lists = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "share"))).alias("best"))
    return ranges.join(lists, key)


def raw_pairs(
    profiles: DataFrame, signatures: DataFrame, style_scores: DataFrame, gate: DataFrame | None = None,
    null_scores_zero: bool = False, fan: int | None = None,
) -> DataFrame:
    """Profile x signature rows of the same season with raw style and colour score.

    The signatures are staged as a table, unless they are one, and copied once per slot of the profiles.
    Disliked signatures are left out where the profiles have dislikes, and with a gate so are the families the style
    does not allow.
    """
    if not hasattr(signatures, "staged_at"):
        signatures = stage(signatures, "signatures")
    met = fanned_join(profiles, signatures, "season", "profile", fan)
    if "dislikes" in profiles.columns:
        met = met.filter(~disliked(F.array(*ACCORDS), F.col("dislikes")))
    if gate is not None:
        met = met.join(gate, ["style", "family"])
    met = met.join(style_scores.withColumnRenamed("score", "style_raw"), ["style", "family"], "left")
    colour = similarity([F.col(f"c{i}") for i in range(3)], [F.col(f"f{i}") for i in range(3)])
    if null_scores_zero:
        colour = F.coalesce(colour, F.lit(0.0))
    return met.withColumns({"style_raw": F.coalesce("style_raw", F.lit(0.0)), "color_raw": colour})


GROUP = ["season", "_slot", "profile"]


#: Bases per slot that a copy of the signatures is worth.
PER_SLOT = 16
BASE = ["style", "season", "c0", "c1", "c2"]
ITEM = ["style_score", "color_score", "season_score", "myscore", "item_id"]


def _bases(profiles: DataFrame, extra: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """The distinct bases with their key as ``profile``, and over how many slots to spread them."""
    bases = profiles.select(*BASE, *extra).distinct().withColumn("profile", F.concat_ws(SEP, *BASE, *extra))
    return bases, max(1, min(shuffle_width(profiles.sparkSession), -(-bases.count() // PER_SLOT)))


def _ranked_signatures(bases: DataFrame, signatures: DataFrame, style_scores: DataFrame, fan: int, item_score, key: Sequence[str], k: int, **rules) -> Ranking:
    """Per base the signatures by their best item, each with its k best items scored by ``item_score``."""

    def rows(keys: DataFrame | None, last: int) -> DataFrame:
        asked = bases if keys is None else bases.join(keys, list(key), "left_semi")
        pairs = raw_pairs(asked, signatures, style_scores, fan=fan, **rules)
        scored = F.transform("best", lambda b: F.struct(*[v.alias(n) for n, v in item_score(b["share"]).items()], b["item_id"].alias("item_id")))
        pairs = pairs.withColumn("items", scored).withColumn("_first", F.get("items", F.lit(0)))
        best = top_k(pairs, GROUP, [F.col("_first.myscore").desc_nulls_last(), F.col("_first.item_id")], last, rank="pos")
        return best.select(*key, "pos", F.array(*ACCORDS).alias("tags"), F.struct(F.transform("items", lambda i: F.struct(*[i[c].alias(c) for c in ITEM])).alias("items")).alias("entry"))

    types = {c: "double" for c in ITEM} | {"item_id": signatures.schema["best"].dataType.elementType["item_id"].dataType.simpleString()}
    return Ranking(list(key), rows, f"struct<items:array<struct<{','.join(f'{c}:{t}' for c, t in types.items())}>>>", k)


def _best_items(found: DataFrame, k: int) -> DataFrame:
    """(profile, rank, item and scores): the k best items of the signatures that a profile found, sorted in place."""
    items = F.flatten(F.transform("found", lambda e: e["items"]))
    keyed = F.transform(items, lambda i: F.struct(i["myscore"].isNull().alias("n"), (-i["myscore"]).alias("m"), i["item_id"].alias("id"), i.alias("i")))
    ranked = found.select("profile", F.posexplode(F.slice(F.array_sort(keyed), 1, k)).alias("p", "b"))
    return ranked.select("profile", "b.i.*", (F.col("p") + 1).alias("rank"))


def _to_users(profiled: DataFrame, best: DataFrame, columns: Sequence[str]) -> DataFrame:
    return profiled.select("user_id", "profile", F.col("style").alias("user_style")).join(
        best.select("profile", *columns), "profile"
    ).drop("profile")


SCORE_COLUMNS = ["item_id", "style_score", "color_score", "season_score", "myscore", "rank"]


def _unscaled_top(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame, k: int, item_score, **rules
) -> DataFrame:
    profiled = user_profiles(users, clothes_colours, features)
    profiles = stage(distinct_profiles(profiled), "profiles")
    bases, fan = _bases(profiles)
    signatures = stage(item_signatures(features, k), "signatures")
    ranking = _ranked_signatures(bases, signatures, style_scores, fan, item_score, BASE, k, **rules)
    return _to_users(profiled, _best_items(first_allowed(profiles, {"found": ranking}), k), SCORE_COLUMNS)


def additive_top(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame, k: int = 3
) -> DataFrame:
    """Top k per user by style percent + colour + season share."""

    def score(share_value: Column) -> dict[str, Column]:
        style, colour = F.col("style_raw"), F.col("color_raw")
        return {"style_score": style, "color_score": colour, "season_score": share_value, "myscore": style + colour + share_value}

    return _unscaled_top(users, features, clothes_colours, style_scores, k, score)


def gated_top(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame, gate: DataFrame,
    k: int = 3,
) -> DataFrame:
    """Top k per user by colour + season share among the families the style allows."""

    def score(share_value: Column) -> dict[str, Column]:
        colour = F.col("color_raw")
        return {"style_score": F.col("style_raw"), "color_score": colour, "season_score": share_value, "myscore": colour + share_value}

    return _unscaled_top(users, features, clothes_colours, style_scores, k, score, gate=gate).drop("style_score")


def scaled_pairs(pairs: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Pairs with smoothed min-max style and colour scores and the season range of the profile's candidates."""
    every = Window.partitionBy(*GROUP)

    def scaled(column: str) -> Column:
        return smooth(min_max(F.col(column), F.min(column).over(every), F.max(column).over(every)), epsilon)

    return pairs.withColumns({
        "style_score": scaled("style_raw"),
        "color_score": scaled("color_raw"),
        "season_low": F.min("low_share").over(every),
        "season_high": F.max("high_share").over(every),
    })


def season_scaled(share_value: Column, epsilon: float = EPSILON) -> Column:
    return smooth(min_max(share_value, F.col("season_low"), F.col("season_high")), epsilon)


def _extremes(bases: DataFrame, signatures: DataFrame, style_scores: DataFrame, null_scores_zero: bool) -> dict[str, Ranking]:
    """Lists from which the least and the greatest allowed score of each kind are the first entries.

    Season shares depend on the season alone, style scores on style and season, colour scores on colour and season, so
    each list has the smallest key that it can have.
    """
    colours = ["season", "c0", "c1", "c2"]
    colour = similarity([F.col(f"c{i}") for i in range(3)], [F.col(f"f{i}") for i in range(3)])
    colour = F.coalesce(colour, F.lit(0.0)) if null_scores_zero else colour
    by_family = style_scores.withColumnRenamed("score", "v")
    # a list needs a set of accords once per value, so signatures that differ in nothing it looks at are one entry
    families = signatures.select("season", "family", *ACCORDS).distinct()
    tones = signatures.select("season", "f0", "f1", "f2", *ACCORDS).distinct()

    def style_rows(keys: DataFrame) -> DataFrame:
        return keys.join(families, "season").join(by_family, ["style", "family"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))

    def colour_rows(keys: DataFrame) -> DataFrame:
        return keys.join(tones, "season").withColumn("v", colour)

    def season_rows(column: str):
        return lambda keys: keys.join(signatures, "season").withColumn("v", F.col(column))

    def ranking(key: list[str], values, order: Column) -> Ranking:
        def rows(keys: DataFrame | None, last: int) -> DataFrame:
            asked = bases.select(*key).distinct() if keys is None else keys
            best = top_k(values(asked).filter("v IS NOT NULL"), key, [order, F.array(*ACCORDS)], last, rank="pos")
            return best.select(*key, "pos", F.array(*ACCORDS).alias("tags"), F.struct("v").alias("entry"))

        return Ranking(key, rows, "struct<v:double>")

    low, high = F.col("v").asc(), F.col("v").desc()
    return {
        "style_low": ranking(["style", "season"], style_rows, low), "style_high": ranking(["style", "season"], style_rows, high),
        "color_low": ranking(colours, colour_rows, low), "color_high": ranking(colours, colour_rows, high),
        "season_low": ranking(["season"], season_rows("low_share"), low), "season_high": ranking(["season"], season_rows("high_share"), high),
    }


def scaled_profile_top(
    profiles: DataFrame, features: DataFrame, style_scores: DataFrame, weights: Sequence[float], k: int,
    epsilon: float = EPSILON, null_scores_zero: bool = False,
) -> DataFrame:
    """Top k per profile by the weighted sum of the scaled scores.

    A profile's scores are scaled by the extremes of what it allows. They are found first; profiles of a base with the
    same extremes, as most are, share one ranking.
    """
    signatures = stage(item_signatures(features, k, weights[2]), "signatures")
    profiles = stage(profiles, "profiles")
    extremes = _extremes(profiles.select(*BASE).distinct(), signatures, style_scores, null_scores_zero)
    ends = list(extremes)
    known = first_allowed(profiles, extremes).withColumns({e: F.get(e, F.lit(0))["v"] for e in ends})
    known = known.withColumn("scale", F.concat_ws(SEP, *[F.coalesce(F.col(e).cast("string"), F.lit(NO_VALUE)) for e in ends]))
    scales, fan = _bases(known, ["scale", *ends])

    def scaled(value: Column, name: str) -> Column:
        return smooth(min_max(value, F.col(f"{name}_low"), F.col(f"{name}_high")), epsilon)

    def score(share_value: Column) -> dict[str, Column]:
        out = {"style_score": scaled(F.col("style_raw"), "style"), "color_score": scaled(F.col("color_raw"), "color"), "season_score": scaled(share_value, "season")}
        return out | {"myscore": weighted(*out.values(), *weights)}

    ranking = _ranked_signatures(scales, signatures, style_scores, fan, score, [*BASE, "scale"], k, null_scores_zero=null_scores_zero)
    return _best_items(first_allowed(known, {"found": ranking}), k)


def scaled_top(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame,
    weights: Sequence[float] = (1.0, 1.0, 1.0), k: int = 3, use_dislikes: bool = True, epsilon: float = EPSILON,
    null_scores_zero: bool = False,
) -> DataFrame:
    """Top k per user by scaled scores; equal weights give the plain sum.

    ``null_scores_zero`` counts a missing colour score as 0 before scaling (the batch rule).
    """
    profiled = user_profiles(users, clothes_colours, features if use_dislikes else None)
    profiles = distinct_profiles(profiled)
    best = scaled_profile_top(profiles, features, style_scores, weights, k, epsilon, null_scores_zero)
    return _to_users(profiled, best, SCORE_COLUMNS)


def newest_weights(weights: DataFrame) -> tuple[float, float, float]:
    """(style, color, season) of the newest weight row; one row reaches the driver."""
    row = newest_row(weights, "weight_id").select("style_weight", "color_weight", "season_weight").first()
    if row is None:
        raise ValueError("the weight table is empty")
    return tuple(float(x) for x in row)


def score_all_items(
    users: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame,
    use_dislikes: bool = False, gate: DataFrame | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Raw scores of every item for a *small* set of users: the result itself has users x items rows.

    Each (item, season) row meets the users of its season, so no item row is moved more than once per user. Users that
    have their profile already are taken as they are; ``keep`` names further columns of users or items to return.
    """
    profiled = users if "profile" in users.columns else user_profiles(users, clothes_colours, features if use_dislikes else None)
    met = fanned_join(by_season(features), profiled, "season", "item_id")
    if use_dislikes:
        met = met.filter(~disliked(F.array(*ACCORDS), F.col("dislikes")))
    if gate is not None:
        met = met.join(gate, ["style", "family"])
    met = met.join(style_scores.withColumnRenamed("score", "style_raw"), ["style", "family"], "left")
    colour = similarity([F.col(f"c{i}") for i in range(3)], [F.col(f"f{i}") for i in range(3)])
    return met.select(
        "user_id", F.col("style").alias("user_style"), "item_id",
        F.coalesce("style_raw", F.lit(0.0)).alias("style_score"),
        colour.alias("color_score"), F.col("share").alias("season_score"), *keep,
    )


#: What of a profile and of an item each score depends on.
PARTS = {"style_score": (["style"], ["family"]), "color_score": (["c0", "c1", "c2"], ["f0", "f1", "f2"]), "season_score": (["season"], SEASONS)}


def score_parts(people: DataFrame, features: DataFrame, clothes_colours: DataFrame, style_scores: DataFrame, times: str) -> dict[str, DataFrame]:
    """Per score its scaled values over all pairs of people and items as (score, n): n is for how many pairs a row stands.

    Without dislikes and gate every user meets every item, and each score depends on a part of the profile and a part
    of the item only. So users that share the one meet items that share the other once: styles meet families, outfit
    colours meet item colours, seasons meet items. ``people`` has profiles and the weight ``times`` of each row. Scores
    are scaled per user; an id with rows of several profiles is scaled over all of them and so keeps rows of its own.
    """
    own = ["style", "season", "c0", "c1", "c2"]
    several = people.groupBy("user_id").agg(F.countDistinct("profile").alias("_n")).filter("_n > 1").select("user_id", F.lit(True).alias("_several"))
    marked = stage(people.join(several, "user_id", "left"), "people")
    out = {}
    for name, (of_user, of_item) in PARTS.items():
        alone = F.when(F.col("_several"), F.concat(F.lit("id"), F.col("user_id").cast("string")))
        one = marked.withColumn("user_id", F.coalesce(alone, F.concat_ws(SEP, F.lit("all"), *of_user)))
        one = one.groupBy("user_id", *of_user).agg(F.sum(times).alias("_users"), F.min("profile").alias("profile"), *[F.min(c).alias(c) for c in own if c not in of_user])
        if of_item == SEASONS:
            items = features.withColumn("_items", F.lit(1).cast("long"))
        else:
            rest = [c for c in features.columns if c not in of_item]
            items = features.groupBy(*of_item).agg(F.count(F.lit(1)).alias("_items"), *[F.min(c).alias(c) for c in rest])
        scaled = batch_scaled(score_all_items(one, items, clothes_colours, style_scores, keep=["_users", "_items"]))
        out[name] = stage(scaled.select(name, (F.col("_users") * F.col("_items")).alias("n")), "scored")
    return out


def batch_scaled(raw: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Scaled scores of all rows: nulls to 0, min-max per user, smoothing, sum."""
    columns = ["style_score", "color_score", "season_score"]
    scaled = scale_by_group(raw.fillna(0.0, columns), "user_id", columns)
    scaled = scaled.withColumns({c: smooth(F.col(c), epsilon) for c in columns})
    return scaled.withColumn("myscore", F.col(columns[0]) + F.col(columns[1]) + F.col(columns[2]))
