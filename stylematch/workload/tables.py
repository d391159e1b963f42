"""Domain tables derived from the given parquet files.

Each derived column is one SQL expression that means the same in Spark and in DuckDB, so both sides read the same
inputs while the operators themselves are written twice, once here and once in the check SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.colour import rgb, rgb_or_hex
from stylematch.plans.score import item_features
from stylematch.session import stage


def pick(expr: str, values: Sequence[str | None]) -> str:
    """Value by position: ``CASE expr WHEN 0 THEN ... END``."""
    text = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} {text} END"


def word_map(expr: str, mapping: dict[str, str]) -> str:
    text = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {text} END"


def _invented(i: int) -> tuple[int, int, int]:
    return (67 * i + 29) % 256, (151 * i + 83) % 256, (211 * i + 47) % 256


# Colour dimensions with invented colours, in the notations the loaders meet: "rgb(r, g, b);", "#RRGGBB" and "(r, g, b)".
_ACCORDS = [
    "aquatic", "citrus", "warm spicy", "woody", "green", "powdery", "rose", "herbal", "smoky", "musky", "fruity", "iris", "vanilla",
    "leather", "mossy", "lavender", "amber", "floral", "sweet", "white floral", "balsamic",
]
_CLOTHES = [
    "화이트", "블랙", "베이지", "핑크", "스카이블루", "그레이", "브라운", "네이비", "레드", "옐로우", "블루", "라벤더", "와인", "실버", "오렌지", "카키", "그린",
    "퍼플", "민트", "골드", "네온",
]
ACCORD_COLOURS = {
    name: "#{:02X}{:02X}{:02X}".format(*_invented(i)) if i % 7 == 3 else "rgb({}, {}, {});".format(*_invented(i)) for i, name in enumerate(_ACCORDS)
}
CLOTHES_COLOURS = {name: "({}, {}, {})".format(*_invented(100 + i)) for i, name in enumerate(_CLOTHES)}
COLOURS = list(CLOTHES_COLOURS)
WORD_1 = {
    "blue": "aquatic", "cold": "citrus", "hot": "warm spicy", "large": "woody", "new": "green", "old": "powdery",
    "red": "rose", "small": "herbal",
}
WORD_2 = {
    "anvil": "smoky", "bolt": "musky", "gear": "fruity", "gizmo": "iris", "plate": "vanilla", "ring": "leather",
    "rod": "mossy", "widget": "lavender",
}
WORD_3 = {
    "economy": "amber", "large": "floral", "medium": "sweet", "promo": "white floral", "small": "balsamic",
    "standard": "woody",
}
TOP_CATEGORIES = ["블라우스", "티셔츠", "니트웨어", "셔츠", "브라탑", "후드티", "탑"]
BOTTOM_CATEGORIES = ["팬츠", "청바지", "스커트", "레깅스"]
MATERIALS = ["면", "면, 울", "데님|린넨", "['실크', '면']", None, "울/캐시미어"]
LENGTHS = ["미니", "미디", "롱", None]
FITS = ["노멀", "루즈", "타이트", None, "오버사이즈"]

_WORD = "split_part(p_name, ' ', 2)"

# name -> (base table, {column: expression})
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "items": ("part", {
        "item_id": "p_partkey",
        "name": "p_name",
        "brand": "p_brand",
        "gender": pick("p_size % 3", ["women", "unisex"]),
        "accord1": word_map("split_part(p_name, ' ', 1)", WORD_1),
        "accord2": f"CASE WHEN p_partkey % 17 <> 0 THEN {word_map(_WORD, WORD_2)} END",
        "accord3": word_map("lower(p_type)", WORD_3),
        "rating": "p_retailprice",
    }),
    "users": ("customer", {
        "user_id": "c_custkey",
        "season": pick("c_custkey % 4", ["봄", "여름", "가을", "겨울"]),
        "user_style": pick("c_custkey % 7", vocab.STYLES),
        "top_id": "CASE WHEN c_custkey % 5 >= 2 THEN c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1000000 ELSE 0 END END",
        "bottom_id": "CASE WHEN c_custkey % 5 >= 2 THEN c_custkey END",
        "dress_id": "CASE WHEN c_custkey % 5 < 2 THEN c_custkey + CASE WHEN c_custkey % 13 = 0 THEN 1000000 ELSE 0 END END",
        "top_category": f"CASE WHEN c_custkey % 5 >= 2 THEN {pick('c_custkey % 7', TOP_CATEGORIES)} END",
        "top_color": f"CASE WHEN c_custkey % 5 >= 2 THEN {pick('c_custkey % 21', COLOURS)} END",
        "bottom_category": f"CASE WHEN c_custkey % 5 >= 2 THEN {pick('c_custkey % 4', BOTTOM_CATEGORIES)} END",
        "bottom_color": f"CASE WHEN c_custkey % 5 >= 2 THEN {pick('c_custkey % 12', COLOURS)} END",
        "dress_color": f"CASE WHEN c_custkey % 5 < 2 THEN {pick('c_custkey % 21', COLOURS)} END",
        "disliked_accord": pick("c_custkey % 6", [None, "woody", " rose , iris ", "", "lavender,,amber", "green"]),
    }),
    "tops": ("part", {
        "id": "p_partkey",
        "style": pick("(p_size + p_partkey % 3) % 7", vocab.STYLES),
        "sub_style": pick("p_size % 7", vocab.STYLES),
        "top_color": pick("p_size % 21", COLOURS),
        "top_category": pick("p_partkey % 7", TOP_CATEGORIES),
        "top_sleeve_length": pick("p_size % 3", ["반팔", "긴팔", None]),
        "top_material": pick("p_size % 6", [m.replace("'", "''") if m else None for m in MATERIALS]),
        "top_print": pick("p_partkey % 4", ["무지", "스트라이프", "체크", None]),
        "top_neckline": pick("p_size % 4", ["라운드넥", "브이넥", None, "유넥"]),
        "top_fit": pick("p_size % 5", FITS),
        "bottom_length": pick("p_partkey % 4", LENGTHS),
        "bottom_color": pick("p_partkey % 12", COLOURS),
        "bottom_category": pick("p_partkey % 4", BOTTOM_CATEGORIES),
        "bottom_material": pick("p_partkey % 6", [m.replace("'", "''") if m else None for m in MATERIALS]),
        "bottom_print": pick("p_size % 2", ["무지", "체크"]),
        "bottom_fit": pick("p_partkey % 5", FITS),
    }),
    "dresses": ("part", {
        "id": "p_partkey",
        "style": pick("p_size % 7", vocab.STYLES),
        "sub_style": pick("p_partkey % 7", vocab.STYLES),
        "dress_category": pick("p_partkey % 3", ["드레스", "점프수트", None]),
        "dress_length": pick("p_size % 4", LENGTHS),
        "dress_color": pick("p_size % 21", COLOURS),
        "dress_sleeve_length": pick("p_partkey % 3", ["반팔", "긴팔", "민소매"]),
        "dress_material": pick("p_size % 6", [m.replace("'", "''") if m else None for m in MATERIALS]),
        "dress_print": pick("p_size % 3", ["무지", "플로럴", None]),
        "dress_neckline": pick("p_partkey % 4", ["라운드넥", "브이넥", "유넥", None]),
        "dress_fit": pick("p_partkey % 5", FITS),
        "dress_detail": pick("p_size % 3", ["셔링, 리본", "버튼", None]),
    }),
    "actions": ("events", {
        "session_id": "user_id",
        "item_id": "event_id % 50",
        "action": "event_type",
        "rate": "CAST(floor(value) AS BIGINT)",
        "event_id": "event_id",
    }),
    "garments": ("part", {
        "seq": "p_partkey",
        "file_name": "' ' || p_type || ' _' || CAST(p_partkey AS STRING)",
        "style": pick("p_size % 5", [*vocab.STYLES[:4], None]),
        "top_color": pick("(p_size / 17 - p_size / 17 % 1)", ["화이트", "블랙", None]),
        "top_category": pick("p_partkey % 2", ["셔츠", "니트웨어"]),
        "top_fit": pick("p_size % 2", ["노멀", None]),
        "bottom_color": "p_type",
        "bottom_fit": pick("(p_partkey / 5 - p_partkey / 5 % 1) % 2", ["노멀", "루즈"]),
        "bottom_length": "CASE WHEN p_size > 25 THEN '롱' END",
        "bottom_category": "'팬츠'",
        "top_print": "'무지'",
        "bottom_print": "'무지'",
        "top_neckline": "CAST(NULL AS STRING)",
    }),
}

_SELECT = {
    name: f"SELECT {', '.join(f'{expr} AS {col}' for col, expr in cols.items())} FROM {base}"
    for name, (base, cols) in DERIVED.items()
}

_VOTES = ", ".join(
    f"CAST(sum(CASE WHEN quarter(l_shipdate) = {q} AND l_partkey % 23 <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS {s}"
    for q, s in enumerate(vocab.SEASONS, 1)
)
SEASON_SQL = f"SELECT l_partkey AS item_id, {_VOTES} FROM lineitem WHERE l_partkey % 19 <> 0 GROUP BY l_partkey"
LOG_SQL = (
    "SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(l_quantity * 2 AS BIGINT) AS rate "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
)


def _values(rows) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_LITERAL = {
    "accord_colours": ("accord, color", ACCORD_COLOURS.items()),
    "clothes_colours": ("color, rgb_tuple", CLOTHES_COLOURS.items()),
    "accord_family": ("accord, family", vocab.ACCORD_FAMILY.items()),
    "percent": ("style, family, score", [
        (s, f, v) for s, vs in vocab.STYLE_PERCENT.items() for f, v in zip(vocab.FAMILIES, vs)
    ]),
    "points": ("style, family, score", [
        (s, f, v) for s, vs in vocab.STYLE_POINTS.items() for f, v in zip(vocab.FAMILIES, vs)
    ]),
}

# Check SQL for the colour dimensions as three numbers, and for classified items.
_NUM = "CAST(regexp_extract_all({0}, '[0-9]+')[{1}] AS DOUBLE)"
_HEX = "CAST(('0x' || substr({0}, {1}, 2)) AS INTEGER)::DOUBLE"
_ACC = ", ".join(
    f"CASE WHEN color LIKE '#%' THEN {_HEX.format('color', 2 * i)} ELSE {_NUM.format('color', i)} END AS {ch}"
    for i, ch in zip((1, 2, 3), "rgb")
)
_CLO = ", ".join(f"{_NUM.format('rgb_tuple', i)} AS {ch}" for i, ch in zip((1, 2, 3), "rgb"))

CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    **{k: (f"{k} AS ({v})", ()) for k, v in _SELECT.items()},
    **{k: (f"{k}({cols}) AS (VALUES {_values(rows)})", ()) for k, (cols, rows) in _LITERAL.items()},
    "seasons": (f"seasons AS ({SEASON_SQL})", ()),
    "rating_log": (f"rating_log AS ({LOG_SQL})", ()),
    "accord_rgb": (f"accord_rgb AS (SELECT accord, {_ACC} FROM accord_colours)", ("accord_colours",)),
    "clothes_rgb": (f"clothes_rgb AS (SELECT color, {_CLO} FROM clothes_colours)", ("clothes_colours",)),
    "families": (
        "families AS (SELECT item_id, family FROM items LEFT JOIN accord_family ON accord1 = accord)",
        ("items", "accord_family"),
    ),
}


def add_derived(name: str, base: str, cols: dict[str, str]) -> None:
    """Register one more derived table."""
    DERIVED[name] = (base, cols)
    CTE[name] = (f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {base})", ())


MAKERS = [
    "Jo-Malone-London", "JOMALONELONDON perfumes", None, "Chanel", "Le-Labo", "Zara", "CREED", "No-Brand",
    "Giorgio-Armani", "Brand X",
]
add_derived("makers", "part", {
    "id": "p_partkey", "brand": pick("p_size % 10", MAKERS), "url": "'u/' || p_name", "country": "p_type", "year": "p_size",
    "name": "CASE WHEN p_partkey % 13 <> 0 THEN p_name || CASE WHEN p_size % 6 = 0 THEN ' Limited-Edition' ELSE '' END END",
})


def ctes(names: Sequence[str]) -> str:
    """CTE text of the named tables with what they need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for need in CTE[name][1]:
                add(need)
            done.append(name)

    for name in names:
        add(name)
    return ",\n".join(CTE[n][0] for n in done)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    base, cols = DERIVED[name]
    return table(spark, sf, base).selectExpr(*[f"{expr} AS {col}" for col, expr in cols.items()])


def seasons(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "lineitem").filter(F.col("l_partkey") % 19 != 0).withColumn("_q", F.quarter("l_shipdate"))
    counted = F.col("l_partkey") % 23 != 0
    return votes.groupBy(F.col("l_partkey").alias("item_id")).agg(*[
        F.count_if((F.col("_q") == q) & counted).cast("double").alias(s) for q, s in enumerate(vocab.SEASONS, 1)
    ])


def rating_log(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"),
        (F.col("l_quantity") * 2).cast("bigint").alias("rate"),
    )
    return lines.join(orders, "o_orderkey").select("user_id", "item_id", "rate")


def families(spark: SparkSession, sf: str) -> DataFrame:
    named = vocab.accord_family(spark).withColumnRenamed("accord", "accord1")
    return derived(spark, sf, "items").join(named, "accord1", "left").select("item_id", "family")


def accord_colours(spark: SparkSession) -> DataFrame:
    rows = vocab.literal_table(spark, "accord, color", ACCORD_COLOURS.items())
    return rows.select("accord", rgb_or_hex(F.col("color")).alias("rgb"))


def clothes_colours(spark: SparkSession) -> DataFrame:
    rows = vocab.literal_table(spark, "color, rgb_tuple", CLOTHES_COLOURS.items())
    return rows.select("color", rgb(F.col("rgb_tuple")).alias("rgb"))


def weight_history(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only weight table derived from suppliers: the newest id wins."""
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS weight_id", "CAST(1 + s_suppkey % 3 AS DOUBLE) / 6 AS style_weight",
        "CAST(1 + s_suppkey % 2 AS DOUBLE) / 6 AS color_weight", "CAST(1 AS DOUBLE) / 6 AS season_weight",
    )


def feature_table(spark: SparkSession, sf: str, missing_colour: str = "drop", missing_season: str = "drop") -> DataFrame:
    """Scored item features, written once as a stage table because the plans read it twice."""
    features = item_features(
        derived(spark, sf, "items"), accord_colours(spark), families(spark, sf), seasons(spark, sf),
        missing_colour, missing_season,
    )
    return stage(features, "features")
