"""Files written from derived tables and read back: encodings, byte order marks, nested label documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.numbers import decimal_comma, thousands_id
from stylematch.plans import catalogue, loading, outfits
from stylematch.session import scratch_path
from stylematch.sources.delimited import read_delimited, write_delimited
from stylematch.sources.outfit_labels import FIELD, LIST_FIELDS, PARTS, RECT, read_label_documents
from stylematch.workload.registry import query
from stylematch.workload.tables import derived, seasons, table


@query(
    "semicolon_cp1252_file", "S1 S7 F15",
    sql="""SELECT p_partkey AS id, p_name || ' é' AS name, p_size + CAST(0.5 AS DOUBLE) AS rating FROM part""",
)
def semicolon_cp1252_file(spark, sf):
    """Semicolon file in a legacy code page with decimal commas."""
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" é")).alias("Name "),
        F.concat(F.col("p_size").cast("string"), F.lit(",5")).alias("RatingValue"),
    )
    path = scratch_path(spark, "cp1252")
    write_delimited(raw, path, "cp1252", ";")
    read = read_delimited(spark, path, "cp1252", ";")
    return read.select(thousands_id(F.col("id")).alias("id"), F.col("Name").alias("name"), decimal_comma(F.col("RatingValue")).alias("rating"))


_GARMENT = "SELECT id, style, top_color, top_material FROM tops"


def _round_trip(spark, sf, encoding):
    path = scratch_path(spark, encoding)
    write_delimited(derived(spark, sf, "tops").select("id", "style", "top_color", "top_material"), path, encoding)
    return path


@query("cp949_file_found", "S2 S7", tables="tops", sql=_GARMENT)
def cp949_file_found(spark, sf):
    """Korean code page found from the bytes, then read."""
    read = read_delimited(spark, _round_trip(spark, sf, "cp949"), None)
    return read.withColumn("id", thousands_id(F.col("id")))


@query("utf8_file_found", "S2 S7", tables="tops", sql=_GARMENT)
def utf8_file_found(spark, sf):
    """UTF-8 found from the bytes, then read."""
    read = read_delimited(spark, _round_trip(spark, sf, "utf-8"), None)
    return read.withColumn("id", thousands_id(F.col("id")))


@query("mixed_encoding_folder", "S2 S7", tables="tops", sql=_GARMENT)
def mixed_encoding_folder(spark, sf):
    """Files of both encodings in one folder: each is read as what its bytes are."""
    path = scratch_path(spark, "mixed")
    rows = derived(spark, sf, "tops").select("id", "style", "top_color", "top_material")
    write_delimited(rows.filter("id % 2 = 0"), path, "cp949")
    write_delimited(rows.filter("id % 2 = 1"), path, "utf-8", mode="append")
    return read_delimited(spark, path, None).withColumn("id", thousands_id(F.col("id")))


@query("byte_order_mark_file", "S3 S4 S7", tables="tops", sql=_GARMENT)
def byte_order_mark_file(spark, sf):
    """File that starts with a byte order mark."""
    read = read_delimited(spark, _round_trip(spark, sf, "utf-8-sig"), None)
    return read.withColumn("id", thousands_id(F.col("id")))


@query(
    "loaded_items", "S2 S4 F15 F16 F18 F17", tables="number_texts",
    sql="""
    WITH n AS (SELECT id, trim(replace(text, ',', '.')) AS d, nullif(year, 0) AS year FROM number_texts),
    v AS (SELECT id, year, coalesce(CASE WHEN regexp_matches(d, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CAST(d AS DOUBLE) END, 0) AS v FROM n)
    SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, v AS rating_value, CAST(trunc(v) AS BIGINT) AS rating_count,
      CAST(year AS BIGINT) AS year, nullif(trim(CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END), '') AS accord1
    FROM part JOIN v ON v.id = p_partkey""",
)
def loaded_items(spark, sf):
    """Typed items from untidy text columns."""
    part = table(spark, sf, "part")
    numbers = derived(spark, sf, "number_texts")
    raw = part.join(numbers, part["p_partkey"] == numbers["id"]).select(
        F.col("p_partkey").cast("string").alias("perfume_id"), F.concat(F.lit(" "), "p_name").alias("Perfume"),
        F.col("p_brand").alias("Brand"), F.col("text").alias("RatingValue"), F.col("text").alias("rating_count"),
        F.col("year").cast("string").alias("Year"),
        F.when(F.col("p_size") % 4 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias("MainAccord1"),
    )
    return catalogue.load_items(raw).select("item_id", "name", "brand", "rating_value", "rating_count", "year", "accord1")


def _documents(spark, sf):
    """Nested label documents: one-piece for every 4th id, outerwear, top only, and two-piece."""
    tops, dresses = derived(spark, sf, "tops"), derived(spark, sf, "dresses").drop("style", "sub_style")
    rows = tops.join(dresses, "id")
    key = F.col("id")
    shown = {
        "dress": key % 4 == 0, "top": key % 4 != 0, "bottom": (key % 4 != 0) & (key % 25 != 1), "outer": key % 10 == 3,
    }

    def attribute(part, name):
        column = f"{part}_{name}"
        if column not in rows.columns:
            return F.lit(None).cast("array<string>" if name in LIST_FIELDS else "string")
        return F.split(column, ", ") if name in LIST_FIELDS else F.col(column)

    def label(part):
        values = F.struct(*[attribute(part, en).alias(kr) for en, kr in FIELD.items()])
        if part == "outer":
            values = F.struct(*[F.lit("x" if en not in LIST_FIELDS else None).cast(
                "array<string>" if en in LIST_FIELDS else "string").alias(kr) for en, kr in FIELD.items()])
        # absent parts are written as [{}] or []
        return F.when(shown[part], F.array(values)).when(key % 2 == 0, F.array(F.struct(*[
            F.lit(None).cast("array<string>" if en in LIST_FIELDS else "string").alias(kr) for en, kr in FIELD.items()
        ]))).otherwise(F.slice(F.array(values), 1, 0))

    def rect(part):
        box = F.struct(
            (key % 90 - 5).cast("double").alias(RECT["x"]), (key % 70 - 3).cast("double").alias(RECT["y"]),
            (key % 50).cast("double").alias(RECT["w"]), (key % 60 + 0.7).cast("double").alias(RECT["h"]),
        )
        return F.when(shown[part], F.array(box)).otherwise(F.slice(F.array(box), 1, 0))

    image = F.struct(
        key.alias("이미지 식별자"), F.lit(80).alias("이미지 높이"), F.concat(key.cast("string"), F.lit(".jpg")).alias("이미지 파일명"),
        F.lit(100).alias("이미지 너비"),
    )
    style = F.array(F.struct(F.col("style").alias("스타일"), F.col("sub_style").alias("서브스타일")))
    labels = F.struct(style.alias("스타일"), *[label(p).alias(kr) for p, kr in PARTS.items()])
    rects = F.struct(*[rect(p).alias(kr) for p, kr in PARTS.items()])
    detail = F.struct(F.struct(rects.alias("렉트좌표"), labels.alias("라벨링")).alias("데이터셋 상세설명"))
    return rows.select(image.alias("이미지 정보"), detail.alias("데이터셋 정보"), F.col("style").alias("folder"))


def _read_documents(spark, sf, styles):
    path = scratch_path(spark, "labels")
    _documents(spark, sf).write.partitionBy("folder").json(path)
    return read_label_documents(spark, path, styles, multiline=False)


_STYLES = "(" + ", ".join(f"'{s}'" for s in vocab.STYLES[:4]) + ")"


@query(
    "label_documents", "S5 S6 P5 P6 P7 F13 F14", tables="tops dresses",
    sql=f"""
    SELECT t.id, CAST(t.id AS VARCHAR) || '.jpg' AS file_name, t.style, t.sub_style,
      CASE WHEN t.id % 4 <> 0 THEN top_color END AS top_color, CASE WHEN t.id % 4 <> 0 THEN top_material END AS top_material,
      CASE WHEN t.id % 4 <> 0 THEN bottom_category END AS bottom_category,
      CASE WHEN t.id % 4 = 0 THEN dress_detail END AS dress_detail
    FROM tops t JOIN dresses d ON d.id = t.id
    WHERE t.style IN {_STYLES} AND t.id % 10 <> 3 AND NOT (t.id % 4 <> 0 AND t.id % 25 = 1)""",
)
def label_documents(spark, sf):
    """Documents of four style folders, flattened, cleaned and reduced to one outfit shape."""
    rows = outfits.clean_labels(_read_documents(spark, sf, vocab.STYLES[:4]))
    return rows.select("id", "file_name", "style", "sub_style", "top_color", "top_material", "bottom_category", "dress_detail")


@query(
    "label_crop_boxes", "F25 S6 P8", tables="tops",
    sql="""
    WITH b AS (SELECT id, greatest(0, id % 90 - 5) AS x, greatest(0, id % 70 - 3) AS y, id % 50 AS w, id % 60 AS h FROM tops
               WHERE id % 4 = 0 AND id % 10 <> 3),
    c AS (SELECT id, x, y, least(100, x + w) AS x2, least(80, y + h) AS y2 FROM b WHERE w > 0 AND h > 0)
    SELECT id, 0 AS pos, CAST(x AS INTEGER) AS x1, CAST(y AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2
    FROM c WHERE x < x2 AND y < y2""",
)
def label_crop_boxes(spark, sf):
    """Crop boxes of the dresses in all documents."""
    return outfits.crop_boxes(outfits.clean_labels(_read_documents(spark, sf, vocab.STYLES)), "dress")


@query(
    "image_folders", "F21 F20", tables="tops",
    sql="""
    SELECT id, coalesce(style, 'unknown') || '_' || CAST(id AS VARCHAR) || '_top.jpg' AS file,
      'top/' || coalesce(replace(top_category, '/', '_'), 'unknown') || '/' || coalesce(top_color, 'unknown') AS folder
    FROM tops WHERE top_category IS NOT NULL""",
)
def image_folders(spark, sf):
    """Target file and folder of each top image."""
    return outfits.image_folders(derived(spark, sf, "tops"), "top")


@query(
    "loaded_seasons", "S2 S4 S9 J6 F15", tables="seasons",
    sql="""
    SELECT item_id, spring + CAST(0.5 AS DOUBLE) AS spring, summer, CAST(0 AS DOUBLE) AS fall, winter FROM seasons
    WHERE item_id % 7 <> 0""",
)
def loaded_seasons(spark, sf):
    """Season votes with decimal commas and blanks; rows of unknown items are skipped."""
    key = F.col("item_id")
    raw = seasons(spark, sf).select(
        F.when(key % 7 == 0, key + 90_000_000).otherwise(key).cast("string").alias("perfume_id "),
        F.concat(F.col("spring").cast("int").cast("string"), F.lit(",5")).alias("Spring"),
        F.concat(F.lit(" "), F.col("summer").cast("string")).alias("SUMMER"), F.lit(" ").alias("fall"), F.col("winter").cast("string").alias("Winter"),
    )
    return loading.load_seasons(raw, derived(spark, sf, "items"))[0]


@query(
    "loaded_users", "S2 S4 J7 F16 F17", tables="users tops dresses",
    sql="""
    SELECT user_id, t.id AS top_id, b.id AS bottom_id, d.id AS dress_id, season, nullif(trim(disliked_accord), '') AS disliked_accord
    FROM users u LEFT JOIN tops t ON t.id = u.top_id LEFT JOIN tops b ON b.id = u.bottom_id LEFT JOIN dresses d ON d.id = u.dress_id
    WHERE user_id <> 0""",
)
def loaded_users(spark, sf):
    """Users from text columns; unknown garments become null, rows without an id are left out."""
    raw = derived(spark, sf, "users").select(
        F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("사용자_식별자"), F.col("top_id").cast("string").alias("상의_식별자"),
        F.format_number("bottom_id", 0).alias("하의_식별자"), F.coalesce(F.col("dress_id").cast("string"), F.lit(" ")).alias("원피스_식별자 "),
        F.col("season").alias("계절"), F.col("disliked_accord").alias("비선호_향조"),
    )
    return loading.load_users(raw, derived(spark, sf, "tops"), derived(spark, sf, "dresses"))


@query(
    "loaded_ratings", "S3 S4 J7 F16 F17", tables="items",
    sql="""
    SELECT l_orderkey * 10 + l_linenumber AS rate_id, o_custkey AS smelling_user_id, i.item_id, CAST(l_quantity AS BIGINT) AS smelling_rate,
      nullif(trim(l_returnflag), '') AS brand, count(*) AS n
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN items i ON i.item_id = l_partkey + CASE WHEN l_partkey % 31 = 0 THEN 90000000 ELSE 0 END
    GROUP BY ALL""",
)
def loaded_ratings(spark, sf):
    """The rating log from text columns; unknown items become null."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = F.col("l_partkey")
    raw = table(spark, sf, "lineitem").join(orders, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("rate_id"),
        F.col("o_custkey").cast("string").alias("smelling_user_id"),
        (part + F.when(part % 31 == 0, F.lit(90_000_000)).otherwise(F.lit(0))).cast("string").alias("perfume_id"),
        F.col("l_quantity").cast("string").alias("smelling_rate"), F.concat(F.lit(" "), "l_returnflag").alias("Brand"),
    )
    loaded = loading.load_ratings(raw, derived(spark, sf, "tops"), derived(spark, sf, "dresses"), derived(spark, sf, "items"))
    return loaded.groupBy("rate_id", "smelling_user_id", "item_id", "smelling_rate", "brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "loaded_colours", "S3 F19 S9", tables="messy_texts",
    sql="""
    SELECT nullif(trim(other), '') || id AS accord, CASE WHEN nullif(trim(text), '') IS NULL THEN '#CCCCCC' WHEN starts_with(trim(text), 'rgb') THEN trim(text)
      ELSE 'rgb' || trim(text) END AS color FROM messy_texts WHERE other IS NOT NULL""",
)
def loaded_colours(spark, sf):
    """Accord colours with a default for blank ones; rows without an accord are left out."""
    raw = derived(spark, sf, "messy_texts").select(
        F.concat(F.lit(" "), "other", F.col("id").cast("string")).alias("MainAccord"), F.col("text").alias("Color"),
    )
    return loading.load_accord_colours(raw)
