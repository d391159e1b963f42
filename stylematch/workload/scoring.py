"""Score queries over all users and all items."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.colour import FULL_DISTANCE
from stylematch.operators.filters import nonzero_gate, top_value_gate
from stylematch.operators.ordered import first_rows
from stylematch.plans import score
from stylematch.workload.registry import query
from stylematch.workload.tables import clothes_colours, derived, feature_table, table, weight_history

DEC = "CAST({} AS DOUBLE)"


def _mix_sql(shares, sides) -> list[str]:
    return [" + ".join(f"{side.format(ch)} * CAST({w} AS DOUBLE)" for side, w in zip(sides, shares)) for ch in "rgb"]


def feats_sql(missing_colour: str = "drop", missing_season: str = "drop", name: str = "feats") -> str:
    sides = [f"a{i}.{{}}" for i in (1, 2, 3)]
    if missing_colour == "white":
        sides = [f"coalesce(a{i}.{{}}, CAST(255 AS DOUBLE))" for i in (1, 2, 3)]
    mixed = ", ".join(f"{m} AS f{i}" for i, m in enumerate(_mix_sql(vocab.ACCORD_MIX, sides)))
    total = "(s.spring + s.summer + s.fall + s.winter)"
    zero = "CAST(0 AS DOUBLE)"
    absent = {"drop": zero, "zero": zero, "null": f"CASE WHEN s.item_id IS NULL THEN NULL ELSE {zero} END"}[missing_season]
    shares = ", ".join(
        f"coalesce(s.{c} / nullif({total}, 0) * CAST(100 AS DOUBLE), {absent}) AS {c}" for c in vocab.SEASONS
    )
    join = "JOIN" if missing_season == "drop" else "LEFT JOIN"
    where = "WHERE a1.r IS NOT NULL AND a2.r IS NOT NULL AND a3.r IS NOT NULL" if missing_colour == "drop" else ""
    return (
        f"{name} AS (SELECT i.item_id, accord1, accord2, accord3, family, {mixed}, {shares} "
        "FROM items i JOIN families f ON f.item_id = i.item_id "
        "LEFT JOIN accord_rgb a1 ON a1.accord = accord1 LEFT JOIN accord_rgb a2 ON a2.accord = accord2 "
        f"LEFT JOIN accord_rgb a3 ON a3.accord = accord3 {join} seasons s ON s.item_id = i.item_id {where})"
    )


_OUTFIT = ", ".join(
    f"CASE WHEN d.r IS NOT NULL THEN d.{ch} ELSE t.{ch} * CAST(0.7 AS DOUBLE) + b.{ch} * CAST(0.3 AS DOUBLE) END AS c{i}"
    for i, ch in enumerate("rgb")
)
_SEASON_KEY = "CASE season " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SEASON_COLUMN.items()) + " END"
PEOPLE = (
    "people AS (SELECT user_id, user_style, skey, c0, c1, c2, "
    "string_split(regexp_replace(trim(coalesce(disliked_accord, '')), ' *, *', ',', 'g'), ',') AS dislikes "
    f"FROM (SELECT u.*, {_SEASON_KEY} AS skey, {_OUTFIT} FROM users u "
    "LEFT JOIN clothes_rgb d ON d.color = dress_color LEFT JOIN clothes_rgb t ON t.color = top_color "
    "LEFT JOIN clothes_rgb b ON b.color = bottom_color))"
)
SHARE = "CASE skey " + " ".join(f"WHEN '{s}' THEN f.{s}" for s in vocab.SEASONS) + " END"
COLOUR = (
    f"CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - sqrt((c0 - f0) * (c0 - f0) + (c1 - f1) * (c1 - f1) "
    f"+ (c2 - f2) * (c2 - f2)) / CAST({FULL_DISTANCE!r} AS DOUBLE))"
)


def pairs_sql(styles: str, people: str = "people", dislikes: bool = True, feats: str = "feats") -> str:
    where = (
        "WHERE NOT (" + " OR ".join(f"coalesce(list_contains(dislikes, accord{i}), false)" for i in (1, 2, 3)) + ")"
        if dislikes else ""
    )
    return (
        f"pairs AS (SELECT user_id, user_style, item_id, f.family, coalesce(st.score, CAST(0 AS DOUBLE)) AS s, "
        f"{COLOUR} AS c, {SHARE} AS e FROM {people} CROSS JOIN {feats} f "
        f"LEFT JOIN {styles} st ON st.style = user_style AND st.family = f.family {where})"
    )


BASE = "items users families accord_rgb clothes_rgb seasons"


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


SCORES = ("style_score", "color_score", "season_score", "myscore")


@query(
    "additive_top3", "R1 J3 J4 J5 J10 P11 F1 F2 F4 F5 F6 F7 F9 F10 F11 U2 W3",
    tables=BASE + " percent", extra=", ".join([feats_sql("white", "null"), PEOPLE, pairs_sql("percent")]),
    sql="""
    SELECT user_id, user_style, item_id, round(s, 6) AS style_score, round(c, 6) AS color_score,
           round(e, 6) AS season_score, round(s + c + e, 6) AS myscore, CAST(rn AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s + c + e DESC NULLS LAST, item_id) AS rn FROM pairs)
    WHERE rn <= 3""",
)
def additive_top3(spark, sf):
    """Style percent + colour + season share, top 3 per user; white stands in for a missing accord colour."""
    features = feature_table(spark, sf, "white", "null")
    users = derived(spark, sf, "users")
    out = score.additive_top(users, features, clothes_colours(spark), vocab.style_scores(spark, "percent"))
    return _round(out, *SCORES)


_GATED = """
    SELECT user_id, user_style, item_id, round(c, 6) AS color_score, round(e, 6) AS season_score,
           round(c + e, 6) AS myscore, CAST(rn AS INTEGER) AS rank
    FROM (SELECT p.*, row_number() OVER (PARTITION BY user_id ORDER BY c + e DESC, item_id) AS rn
          FROM pairs p JOIN gate g ON g.style = p.user_style AND g.family = p.family)
    WHERE rn <= 3"""


@query(
    "gated_top3_best_two_values", "R2 P12 O1", tables=BASE + " percent", sql=_GATED,
    extra=", ".join([
        feats_sql(), PEOPLE, pairs_sql("percent"),
        "gate AS (SELECT style, family FROM (SELECT *, dense_rank() OVER (PARTITION BY style ORDER BY score DESC) AS lv "
        "FROM percent) WHERE lv <= 2)",
    ]),
)
def gated_top3_best_two_values(spark, sf):
    """Colour + season among the families with the style's two largest distinct values."""
    styles = vocab.style_scores(spark, "percent")
    out = score.gated_top(
        derived(spark, sf, "users"), feature_table(spark, sf), clothes_colours(spark), styles, top_value_gate(styles)
    )
    return _round(out, *SCORES)


@query(
    "gated_top3_nonzero", "R2 P13", tables=BASE + " percent", sql=_GATED,
    extra=", ".join([
        feats_sql(), PEOPLE, pairs_sql("percent"), "gate AS (SELECT style, family FROM percent WHERE score > 0)",
    ]),
)
def gated_top3_nonzero(spark, sf):
    """Colour + season among the families with a non-zero style value."""
    styles = vocab.style_scores(spark, "percent")
    out = score.gated_top(
        derived(spark, sf, "users"), feature_table(spark, sf), clothes_colours(spark), styles, nonzero_gate(styles)
    )
    return _round(out, *SCORES)


def scaled_sql(group: str = "user_id", zero_nulls: bool = False) -> str:
    def scaled(c: str) -> str:
        v = f"coalesce({c}, CAST(0 AS DOUBLE))" if zero_nulls else c
        low, high = f"min({v}) OVER (PARTITION BY {group})", f"max({v}) OVER (PARTITION BY {group})"
        return (
            f"(coalesce(({v} - {low}) / nullif({high} - {low}, 0), CAST(0 AS DOUBLE)) + CAST(0.02 AS DOUBLE)) "
            f"/ CAST(1.02 AS DOUBLE) AS {c}s"
        )

    return f"scaled AS (SELECT *, {scaled('s')}, {scaled('c')}, {scaled('e')} FROM pairs)"


def _scaled_top(total: str, k: int, source: str = "scaled") -> str:
    return f"""
    SELECT user_id, user_style, item_id, round(ss, 6) AS style_score, round(cs, 6) AS color_score,
           round(es, 6) AS season_score, round(my, 6) AS myscore, CAST(rn AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY my DESC, item_id) AS rn
          FROM (SELECT *, {total} AS my FROM {source}))
    WHERE rn <= {k}"""


@query(
    "scaled_top3", "R3 W4 F23 J4", tables=BASE + " points", sql=_scaled_top("ss + cs + es", 3),
    extra=", ".join([feats_sql(), PEOPLE, pairs_sql("points"), scaled_sql()]),
)
def scaled_top3(spark, sf):
    """Rank points, min-max per user over the candidates left, smoothing, sum."""
    out = score.scaled_top(
        derived(spark, sf, "users"), feature_table(spark, sf), clothes_colours(spark),
        vocab.style_scores(spark, "points"),
    )
    return _round(out, *SCORES)


_WEIGHTS_SQL = """newest AS (
    SELECT CAST(1 + s_suppkey % 3 AS DOUBLE) / 6 AS w1, CAST(1 + s_suppkey % 2 AS DOUBLE) / 6 AS w2,
           CAST(1 AS DOUBLE) / 6 AS w3
    FROM supplier ORDER BY s_suppkey DESC LIMIT 1)"""


@query(
    "weighted_scaled_top3", "R4 A17 F24 W4 F23 O1", tables=BASE + " points",
    sql=_scaled_top("w1 * ss + w2 * cs + w3 * es", 3, "scaled CROSS JOIN newest"),
    extra=", ".join([feats_sql(), PEOPLE, pairs_sql("points"), scaled_sql(), _WEIGHTS_SQL]),
)
def weighted_scaled_top3(spark, sf):
    """As scaled_top3 with the newest weight row."""
    out = score.scaled_top(
        derived(spark, sf, "users"), feature_table(spark, sf), clothes_colours(spark),
        vocab.style_scores(spark, "points"), weights=score.newest_weights(weight_history(spark, sf)),
    )
    return _round(out, *SCORES)


FIRST_PEOPLE = (
    "first_people AS (SELECT p.* FROM people p JOIN (SELECT o_custkey AS user_id, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) "
    "USING (user_id) ORDER BY k LIMIT 100)"
)


@query(
    "batch_scaled_first_users", "R5 W6 J10 W4 F23", tables=BASE + " points",
    extra=", ".join([
        feats_sql("null", "null"), PEOPLE, FIRST_PEOPLE, pairs_sql("points", "first_people", dislikes=False),
        scaled_sql(zero_nulls=True),
    ]),
    sql="""
    SELECT user_id, user_style, item_id, round(ss, 6) AS style_score, round(cs, 6) AS color_score,
           round(es, 6) AS season_score, round(ss + cs + es, 6) AS myscore
    FROM scaled""",
)
def batch_scaled_first_users(spark, sf):
    """Every item scored for the first 100 distinct users of the log, with the outfit logged there; nulls become 0
    before scaling, no dislike filter."""
    return _round(_first_scores(spark, sf), *SCORES)


def _first_scores(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("logged"), F.col("o_custkey").alias("user_id"))
    users = first_rows(log.join(derived(spark, sf, "users"), "user_id"), "user_id", "logged", 100).drop("logged")
    raw = score.score_all_items(
        users, feature_table(spark, sf, "null", "null"), clothes_colours(spark), vocab.style_scores(spark, "points")
    )
    return score.batch_scaled(raw)


LAST_PEOPLE = "last_people AS (SELECT * FROM people ORDER BY user_id DESC LIMIT 1)"


@query(
    "full_ranking_latest_user", "O2 A17 R2 P12", tables=BASE + " percent",
    extra=", ".join([
        feats_sql(), PEOPLE, LAST_PEOPLE, pairs_sql("percent", "last_people"),
        "gate AS (SELECT style, family FROM (SELECT *, dense_rank() OVER (PARTITION BY style ORDER BY score DESC) AS lv "
        "FROM percent) WHERE lv <= 2)",
    ]),
    sql="""
    SELECT user_id, item_id, round(c, 6) AS color_score, round(e, 6) AS season_score, round(c + e, 6) AS myscore
    FROM pairs p JOIN gate g ON g.style = p.user_style AND g.family = p.family""",
)
def full_ranking_latest_user(spark, sf):
    """Whole ranking, without a limit, for the newest user."""
    users = derived(spark, sf, "users")
    newest = users.orderBy(F.col("user_id").desc()).limit(1)
    styles = vocab.style_scores(spark, "percent")
    gate = top_value_gate(styles)
    raw = score.score_all_items(newest, feature_table(spark, sf), clothes_colours(spark), styles, True, gate)
    ranked = raw.withColumn("myscore", F.col("color_score") + F.col("season_score"))
    ranked = ranked.select("user_id", "item_id", "color_score", "season_score", "myscore")
    return _round(ranked, *SCORES).orderBy(F.col("myscore").desc(), "item_id")
