"""Recommendation cards and prompt rows for all users."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.plans import cards, score
from stylematch.workload.registry import query
from stylematch.workload.scoring import BASE, PEOPLE, feats_sql, pairs_sql, scaled_sql
from stylematch.workload.tables import clothes_colours, derived, families, feature_table, pick, seasons

_TOP3 = (
    "top3 AS (SELECT * FROM (SELECT user_id, item_id, ss + cs + es AS my, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ss + cs + es DESC, item_id) AS rn FROM scaled) WHERE rn <= 3)"
)
_BEST = """long AS (SELECT item_id, unnest(['Spring', 'Summer', 'Fall', 'Winter']) AS s, unnest(['봄', '여름', '가을', '겨울']) AS kr,
    unnest([1, 2, 3, 4]) AS pos, unnest([spring, summer, fall, winter]) AS v FROM seasons),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY v DESC, pos) AS rn FROM long),
    best AS (SELECT item_id, max(s) FILTER (WHERE rn = 1) AS top_season,
             max(kr) FILTER (WHERE rn = 1) || ', ' || max(kr) FILTER (WHERE rn = 2) AS two FROM ranked GROUP BY item_id)"""
_EXTRA = ", ".join([feats_sql(), PEOPLE, pairs_sql("points"), scaled_sql(), _TOP3, _BEST])


def _top3(spark, sf):
    return score.scaled_top(
        derived(spark, sf, "users"), feature_table(spark, sf), clothes_colours(spark), vocab.style_scores(spark, "points")
    )


@query(
    "result_cards", "E7 J11 F27 F28 F29 O5 P21", tables=BASE + " points", extra=_EXTRA,
    sql="""
    SELECT user_id, t.item_id, name, brand, coalesce(gender, 'Unisex') AS gender, round_even(my, 3) AS myscore, top_season,
      concat_ws(', ', accord1, accord2, accord3) AS accords, '/static/ui/perfume_images/' || t.item_id || '.jpg' AS image_url
    FROM top3 t JOIN items i ON i.item_id = t.item_id LEFT JOIN best b ON b.item_id = t.item_id""",
)
def result_cards(spark, sf):
    """Card fields of every user's best three items."""
    out = cards.result_cards(_top3(spark, sf), derived(spark, sf, "items"), seasons(spark, sf))
    return out.withColumn("accords", F.array_join("accords", ", "))


_OUTFIT = """'전체적으로 ' || concat_ws(', ', CASE WHEN top_color <> '' THEN '상의는 ' || top_color || ' ' || coalesce(top_category, '') END,
    CASE WHEN bottom_color <> '' THEN '하의는 ' || bottom_color || ' ' || coalesce(bottom_category, '') END,
    CASE WHEN dress_color <> '' THEN '원피스는 ' || dress_color END) || '의 스타일' AS outfit"""
_HEAD = """'- ' || name || ' (' || brand || ')' || chr(10) || '  · 주요 향조: ' || coalesce(accord1, 'None') || ', ' || coalesce(accord2, 'None')
    || ', ' || coalesce(accord3, 'None') || chr(10)"""
_SELF = _HEAD + """ || '  · 향의 결: ' || coalesce(family, '복합적인 향') || chr(10) || '  · 잘 어울리는 계절: ' || coalesce(two, '사계절') || chr(10) || chr(10)"""
_GIFT = _HEAD + """ || coalesce('  · 향의 결: ' || family || chr(10), '') || coalesce('  · 추천 계절: ' || two || chr(10), '') || chr(10)"""


def _prompt_sql(block: str) -> str:
    return f"""
    SELECT t.user_id, any_value(outfit) AS outfit, any_value(season) AS season, string_agg({block}, '' ORDER BY rn) AS items_text,
      string_agg(name, ', ' ORDER BY rn) AS item_names
    FROM top3 t JOIN items i ON i.item_id = t.item_id LEFT JOIN best b ON b.item_id = t.item_id
    JOIN families f ON f.item_id = t.item_id JOIN (SELECT user_id, season, {_OUTFIT} FROM users) u ON u.user_id = t.user_id
    GROUP BY t.user_id"""


def _prompts(spark, sf, style):
    return cards.prompt_rows(
        derived(spark, sf, "users"), _top3(spark, sf), derived(spark, sf, "items"), families(spark, sf), seasons(spark, sf), style
    )


@query("prompt_rows_self", "E8 F30 O3", tables=BASE + " points", extra=_EXTRA, sql=_prompt_sql(_SELF))
def prompt_rows_self(spark, sf):
    """Outfit sentence and item blocks per user."""
    return _prompts(spark, sf, "self")


@query("prompt_rows_gift", "E8 F30", tables=BASE + " points", extra=_EXTRA, sql=_prompt_sql(_GIFT))
def prompt_rows_gift(spark, sf):
    """The same for a gift: unknown lines left out."""
    return _prompts(spark, sf, "gift")


_CODES = {
    "recipient": pick("user_id % 5", ["lover", "친구", "family", "boss"]),
    "occasion": pick("user_id % 4", ["birthday", "congrats", "첫만남"]),
    "kind": pick("user_id % 2", ["짧은", "긴"]),
}


@query(
    "gift_message_rows", "E8 F29 P19", tables=BASE + " points", extra=_EXTRA,
    sql=f"""
    WITH p AS ({_prompt_sql("''").strip()}), c AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _CODES.items())} FROM p)
    SELECT user_id, item_names, CASE recipient WHEN 'lover' THEN '연인' WHEN '친구' THEN '친구' WHEN 'family' THEN '가족' ELSE '소중한 분' END
      AS recipient, CASE occasion WHEN 'birthday' THEN '생일' WHEN 'congrats' THEN '축하 기념일' WHEN '첫만남' THEN '첫만남' ELSE '특별한 날' END
      AS occasion, CASE kind WHEN '짧은' THEN 'short' ELSE 'long' END AS length FROM c""",
)
def gift_message_rows(spark, sf):
    """Recipient, occasion and length per user with the names of its best items."""
    prompts = _prompts(spark, sf, "gift").selectExpr("*", *[f"{e} AS {n}" for n, e in _CODES.items()])
    return cards.gift_rows(prompts, "recipient", "occasion", "kind")
