"""Fixed vocabulary of the domain: styles, scent families, seasons, label maps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# The seven outfit styles.
STYLES = ["로맨틱", "섹시", "소피스트케이티드", "스포티", "클래식", "젠더리스", "아방가르드"]

# The seven scent families, in the column order of the two tables below.
FAMILIES = [
    "플로럴향, 달콤한향",
    "싱그러운 풀 향",
    "머스크같은 중후한향",
    "파우더느낌의 부드러운향",
    "시원하고 신선한 바다 향",
    "감귤류의 상큼한 향",
    "라벤더같은 상쾌한향",
]

# Survey share in percent, one row per style, one column per family.
STYLE_PERCENT = {
    "로맨틱": [46.15, 7.69, 0.0, 30.77, 15.38, 0.0, 0.0],
    "섹시": [20.0, 40.0, 40.0, 0.0, 0.0, 0.0, 0.0],
    "소피스트케이티드": [30.0, 10.0, 10.0, 40.0, 10.0, 0.0, 0.0],
    "스포티": [14.29, 9.52, 0.0, 4.76, 57.14, 14.29, 0.0],
    "클래식": [9.09, 12.12, 6.06, 21.21, 36.36, 6.06, 9.09],
    "젠더리스": [21.43, 21.43, 0.0, 28.57, 14.29, 14.29, 0.0],
    "아방가르드": [11.11, 5.56, 0.0, 16.67, 44.44, 16.67, 5.56],
}

# Rank points (1..7), one row per style, one column per family.
STYLE_POINTS = {
    "로맨틱": [7.0, 4.0, 2.0, 6.0, 5.0, 2.0, 2.0],
    "섹시": [5.0, 6.5, 6.5, 3.0, 3.0, 3.0, 3.0],
    "소피스트케이티드": [6.0, 4.0, 4.0, 7.0, 4.0, 1.5, 1.5],
    "스포티": [5.0, 4.0, 2.0, 3.0, 7.0, 5.0, 2.0],
    "클래식": [3.5, 4.5, 2.0, 6.0, 7.0, 2.0, 3.5],
    "젠더리스": [5.5, 5.5, 2.0, 7.0, 4.0, 4.0, 2.0],
    "아방가르드": [4.0, 2.5, 1.0, 5.5, 7.0, 5.5, 2.5],
}

# Main accord -> scent family.
ACCORD_FAMILY = {
    "aldehydic": "라벤더같은 상쾌한향",
    "almond": "플로럴향, 달콤한향",
    "amber": "머스크같은 중후한향",
    "animalic": "머스크같은 중후한향",
    "aquatic": "시원하고 신선한 바다 향",
    "aromatic": "라벤더같은 상쾌한향",
    "cherry": "플로럴향, 달콤한향",
    "citrus": "감귤류의 상큼한 향",
    "coconut": "플로럴향, 달콤한향",
    "coffee": "라벤더같은 상쾌한향",
    "earthy": "싱그러운 풀 향",
    "floral": "플로럴향, 달콤한향",
    "fresh": "감귤류의 상큼한 향",
    "fresh spicy": "라벤더같은 상쾌한향",
    "fruity": "감귤류의 상큼한 향",
    "green": "싱그러운 풀 향",
    "honey": "플로럴향, 달콤한향",
    "iris": "플로럴향, 달콤한향",
    "lactonic": "플로럴향, 달콤한향",
    "lavender": "라벤더같은 상쾌한향",
    "leather": "머스크같은 중후한향",
    "marine": "시원하고 신선한 바다 향",
    "mineral": "시원하고 신선한 바다 향",
    "mossy": "싱그러운 풀 향",
    "musky": "머스크같은 중후한향",
    "oriental": "머스크같은 중후한향",
    "oud": "머스크같은 중후한향",
    "ozonic": "시원하고 신선한 바다 향",
    "patchouli": "싱그러운 풀 향",
    "powdery": "파우더느낌의 부드러운향",
    "rose": "플로럴향, 달콤한향",
    "smoky": "머스크같은 중후한향",
    "soft spicy": "파우더느낌의 부드러운향",
    "sweet": "플로럴향, 달콤한향",
    "tobacco": "머스크같은 중후한향",
    "tuberose": "플로럴향, 달콤한향",
    "vanilla": "플로럴향, 달콤한향",
    "violet": "플로럴향, 달콤한향",
    "warm spicy": "라벤더같은 상쾌한향",
    "white floral": "플로럴향, 달콤한향",
    "woody": "머스크같은 중후한향",
    "yellow floral": "플로럴향, 달콤한향",
}

# Cluster number -> scent family name (the name of 9 differs from the family on purpose).
CLUSTER_FAMILY = {
    "0": "파우더느낌의 부드러운향",
    "1": "플로럴향, 달콤한향",
    "2": "싱그러운 풀 향",
    "3": "머스크같은 중후한향",
    "4": "플로럴향, 달콤한향",
    "5": "파우더느낌의 부드러운향",
    "6": "싱그러운 풀 향",
    "7": "파우더느낌의 부드러운향",
    "8": "플로럴향, 달콤한향",
    "9": "라벤더같은 은은한 향",
    "10": "감귤류의 상큼한 향",
}

# Season names.
SEASON_COLUMN = {
    "봄": "spring", "여름": "summer", "가을": "fall", "겨울": "winter",
    "spring": "spring", "summer": "summer", "fall": "fall", "winter": "winter",
}
SEASON_KOREAN = {"spring": "봄", "summer": "여름", "fall": "가을", "winter": "겨울"}
SEASONS = ["spring", "summer", "fall", "winter"]

# Brands kept by the catalogue filter.
TARGET_BRANDS = [
    "diptyque", "lanvin", "byredo", "yvessaintlaurent", "santamarianovella", "lelabo",
    "maisonfranciskurkdjian", "chanel", "acquadiparma", "jomalonelondon", "jimmychoo",
    "guerlain", "calvinklein", "arianagrande", "versace", "exnihilo", "memoparis",
    "demeterfragrance", "elizabetharden", "creed", "giorgioarmani",
]

# Form codes -> labels.
PART_LABEL = {"top": "상의", "bottom": "하의", "onepiece": "원피스"}
ITEM_LABEL = {
    "blouse": "블라우스", "tshirt": "티셔츠", "knit": "니트웨어", "shirt": "셔츠", "sleeveless": "탑",
    "hoodie": "후드티", "sweatshirt": "맨투맨", "bratop": "브라탑",
    "pants": "팬츠", "jeans": "청바지", "skirt": "스커트", "long_skirt": "롱스커트", "leggings": "레깅스",
    "jogger": "트레이닝", "slacks": "슬랙스",
    "dress": "드레스", "onepiece": "원피스", "jumpsuit": "점프수트",
}
COLOUR_LABEL = {
    "white": "화이트", "black": "블랙", "beige": "베이지", "pink": "핑크",
    "skyblue": "스카이블루", "grey": "그레이", "brown": "브라운", "navy": "네이비",
    "red": "레드", "yellow": "옐로우", "blue": "블루", "lavender": "라벤더",
    "wine": "와인", "silver": "실버", "orange": "오렌지", "khaki": "카키",
    "green": "그린", "purple": "퍼플", "mint": "민트", "gold": "골드",
    "neon": "네온",
}

# Gift form codes -> labels, and the texts used when a code is unknown.
RECIPIENT_LABEL = {
    "lover": "연인", "friend": "친구", "family": "가족", "colleague": "직장동료",
    "연인": "연인", "친구": "친구", "가족": "가족", "직장동료": "직장동료",
}
OCCASION_LABEL = {
    "firstmeet": "첫만남", "birthday": "생일", "anniversary": "축하 기념일", "congrats": "축하 기념일",
    "첫만남": "첫만남", "생일": "생일", "축하 기념일": "축하 기념일",
}
DEFAULT_RECIPIENT = "소중한 분"
DEFAULT_OCCASION = "특별한 날"

# Defaults used by the loaders.
DEFAULT_ACCORD_COLOUR = "#CCCCCC"
DEFAULT_CLOTHES_RGB = "(204, 204, 204)"
EPSILON = 0.02
ACCORD_MIX = (0.6, 0.3, 0.1)
OUTFIT_MIX = (0.7, 0.3)


def literal_table(spark: SparkSession, columns: str, rows: Iterable[Sequence]) -> DataFrame:
    """Inline table; unlike a parallelised list it has an exact size, so Spark can choose its joins by size."""

    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, (int, float)):
            return f"{value!r}D" if isinstance(value, float) else repr(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def style_scores(spark: SparkSession, kind: str = "percent") -> DataFrame:
    """The 7 x 7 style/family table in long form: (style, family, score)."""
    table = {"percent": STYLE_PERCENT, "points": STYLE_POINTS}[kind]
    rows = [(s, f, v) for s, values in table.items() for f, v in zip(FAMILIES, values)]
    return literal_table(spark, "style, family, score", rows)


def accord_family(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "accord, family", ACCORD_FAMILY.items())


def cluster_family(spark: SparkSession) -> DataFrame:
    return literal_table(spark, "cluster, family", CLUSTER_FAMILY.items())
