"""Column functions over whole derived text and number columns, edge cases included."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions import colour, numbers, season, text
from stylematch.workload.registry import query
from stylematch.workload.tables import add_derived, derived, pick, seasons, table

S = "CAST({} AS STRING)".format
SIZE, KEY = S("p_size"), S("p_partkey")


add_derived("colour_texts", "part", {
    "id": "p_partkey",
    "text": (
        f"CASE p_partkey % 9 WHEN 0 THEN 'rgb(' || {SIZE} || ', ' || {S('p_size * 3')} || ', 7);' "
        f"WHEN 1 THEN '(' || {SIZE} || ', 0, 255)' WHEN 2 THEN '#0A0B0C' WHEN 3 THEN '#FFF' WHEN 4 THEN '' "
        f"WHEN 6 THEN {SIZE} || ', 13' WHEN 7 THEN ' #a0B1c2 ' WHEN 8 THEN '12 34 56 78' END"
    ),
})
add_derived("number_texts", "part", {
    "id": "p_partkey",
    "text": (
        f"CASE p_partkey % 11 WHEN 0 THEN {SIZE} || ',9' WHEN 1 THEN '1,234' WHEN 2 THEN ' 7 ' WHEN 3 THEN '' "
        f"WHEN 4 THEN 'x' WHEN 6 THEN '100026.0' WHEN 7 THEN '-2,5' WHEN 8 THEN '1d' WHEN 9 THEN {KEY} "
        "WHEN 10 THEN '1,2,3' END"
    ),
    "year": "p_size % 4 * 500",
})
add_derived("messy_texts", "part", {
    "id": "p_partkey",
    "text": (
        f"CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN '' WHEN 3 THEN ' A/B_' || p_type || ' ' "
        f"WHEN 4 THEN p_brand || '_' || p_type WHEN 5 THEN ' ' || p_name || ' ' WHEN 6 THEN '_x' END"
    ),
    "other": pick("p_size % 4", ["노멀", "루즈", None, "타이트"]),
    "items": (
        f"CASE p_partkey % 10 WHEN 0 THEN '[''실크'', ''면'']' WHEN 1 THEN '면, 울 ,, ' WHEN 2 THEN '데님|린넨' "
        f"WHEN 3 THEN '울/캐시미어' WHEN 4 THEN 'a;b' WHEN 5 THEN '[]' WHEN 6 THEN '면' WHEN 7 THEN '[\"x\", \"y, z\"]' "
        f"WHEN 8 THEN p_type END"
    ),
    "dislikes": pick("p_size % 5", ["woody,lavender", " woody , lavender ", "woody,,", "", None]),
})


@query(
    "parse_colours", "F1 F2 F3", tables="colour_texts",
    sql="""
    WITH p AS (SELECT id, text, trim(text) AS t, regexp_extract_all(text, '[0-9]+') AS n FROM colour_texts)
    SELECT id,
      CASE WHEN len(n) >= 3 THEN n[1] || ',' || n[2] || ',' || n[3] END AS any_format,
      CASE WHEN regexp_matches(t, '^#[0-9A-Fa-f]{6}$')
             THEN CAST(CAST('0x' || substr(t, 2, 2) AS INTEGER) AS VARCHAR) || ',' ||
                  CAST(CAST('0x' || substr(t, 4, 2) AS INTEGER) AS VARCHAR) || ',' ||
                  CAST(CAST('0x' || substr(t, 6, 2) AS INTEGER) AS VARCHAR)
           WHEN t LIKE '#%' THEN NULL
           WHEN len(n) >= 3 THEN n[1] || ',' || n[2] || ',' || n[3] END AS strict,
      CASE WHEN text IS NULL OR t = '' THEN 'missing' WHEN t LIKE '#%' AND NOT regexp_matches(t, '^#[0-9A-Fa-f]{6}$')
           THEN 'bad hex' WHEN t NOT LIKE '#%' AND len(n) < 3 THEN 'unsupported' END AS fault,
      CASE WHEN len(n) >= 3 THEN n[1] || ',' || n[2] || ',' || n[3] ELSE '255,255,255' END AS lenient
    FROM p""",
)
def parse_colours(spark, sf):
    """The three colour parsers and the reject reason of the strict one."""
    t = F.col("text")

    def shown(c):
        return F.when(c.isNotNull(), F.array_join(c.cast("array<string>"), ","))

    return derived(spark, sf, "colour_texts").select(
        "id", shown(colour.rgb(t)).alias("any_format"), shown(colour.rgb_or_hex(t)).alias("strict"),
        colour.rgb_fault(t).alias("fault"), shown(colour.rgb_or_white(t)).alias("lenient"),
    )


@query(
    "colour_mix_and_similarity", "F4 F5 F6",
    sql="""
    WITH c AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 256 AS DOUBLE) AS b,
                      CAST((p_partkey * 7) % 256 AS DOUBLE) AS d FROM part),
    m AS (SELECT id, a * CAST(0.6 AS DOUBLE) + b * CAST(0.3 AS DOUBLE) + d * CAST(0.1 AS DOUBLE) AS f,
                 CASE WHEN id % 5 < 2 THEN d ELSE b * CAST(0.7 AS DOUBLE) + a * CAST(0.3 AS DOUBLE) END AS o,
                 id % 17 = 0 AS damaged FROM c)
    SELECT id, CASE WHEN damaged THEN NULL ELSE round(f, 6) END AS mixed, round(o, 6) AS outfit,
           CASE WHEN damaged THEN NULL ELSE round(100 * (1 - sqrt((o - f) * (o - f) * 3) / (255 * sqrt(3))), 6) END AS similarity
    FROM m""",
)
def colour_mix_and_similarity(spark, sf):
    """6:3:1 accord mix (damaged triples give null), 7:3 outfit mix or dress, and their similarity."""
    def grey(value):
        v = value.cast("int")
        return F.array(v, v, v)

    a, b, d = grey(F.col("p_size")), grey(F.col("p_partkey") % 256), grey((F.col("p_partkey") * 7) % 256)
    damaged = F.when(F.col("p_partkey") % 17 != 0, d)
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), colour.mix_accords(a, b, damaged).alias("m"),
        colour.outfit_colour(F.when(F.col("p_partkey") % 5 < 2, d), b, a).alias("o"),
    )
    score = colour.similarity(colour.channels(F.col("o")), colour.channels(F.col("m")))
    return rows.select(
        "id", F.round(F.get("m", F.lit(0)), 6).alias("mixed"), F.round(F.get("o", F.lit(0)), 6).alias("outfit"),
        F.round(score, 6).alias("similarity"),
    )


@query(
    "season_shares", "F7 F8 F9 A11", tables="seasons",
    sql="""
    SELECT item_id, round(coalesce(spring / nullif(spring + summer + fall + winter, 0), 0) * 100, 6) AS spring_share,
      round(winter / CASE WHEN spring + summer + fall + winter = 0 THEN 1 ELSE spring + summer + fall + winter END * 100, 6)
        AS winter_share,
      CAST(spring + summer + fall + winter AS BIGINT) AS votes,
      round(CASE item_id % 5 WHEN 0 THEN spring WHEN 1 THEN summer WHEN 2 THEN fall WHEN 3 THEN winter END, 6) AS picked
    FROM seasons""",
)
def season_shares(spark, sf):
    """Both share rules, the row sum, and the column chosen by a Korean or English season name."""
    s = [F.col(x) for x in vocab.SEASONS]
    names = F.array(*[F.lit(x) for x in ("봄", "summer", "가을", "winter", "??")])
    name = F.get(names, (F.col("item_id") % 5).cast("int"))
    return seasons(spark, sf).select(
        "item_id", F.round(numbers.share(s[0], *s), 6).alias("spring_share"),
        F.round(numbers.share_floor_one(s[3], *s), 6).alias("winter_share"),
        (s[0] + s[1] + s[2] + s[3]).cast("bigint").alias("votes"),
        F.round(season.pick_season(name, dict(zip(vocab.SEASONS, s))), 6).alias("picked"),
    )


@query(
    "parse_numbers", "F15 F16 F18", tables="number_texts",
    sql="""
    WITH n AS (SELECT *, trim(replace(text, ',', '.')) AS d, trim(replace(text, ',', '')) AS i FROM number_texts)
    SELECT id, coalesce(CASE WHEN regexp_matches(d, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CAST(d AS DOUBLE) END, 0) AS decimal_value,
      CAST(trunc(coalesce(CASE WHEN regexp_matches(d, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CAST(d AS DOUBLE) END, 0)) AS BIGINT)
        AS int_value,
      CAST(trunc(CASE WHEN regexp_matches(i, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CAST(i AS DOUBLE) END) AS BIGINT) AS id_value,
      nullif(year, 0) AS year
    FROM n""",
)
def parse_numbers(spark, sf):
    """Comma as decimal sign, comma as thousands sign, and year 0 as null."""
    t = F.col("text")
    return derived(spark, sf, "number_texts").select(
        "id", numbers.decimal_comma(t).alias("decimal_value"), numbers.decimal_comma_int(t).alias("int_value"),
        numbers.thousands_id(t).alias("id_value"), numbers.zero_to_null(F.col("year")).alias("year"),
    )


@query(
    "text_rules", "F17 F19 F20 F21 F22 F29", tables="messy_texts",
    sql="""
    SELECT id, nullif(trim(text), '') AS filled, lower(trim(text)) AS clean,
      lower(trim(split_part(text, '_', 1))) AS prefix, CAST(id AS VARCHAR) || '.jpg' AS image,
      coalesce(replace(trim(nullif(text, '')), '/', '_'), 'unknown') AS path,
      text || '_' || other AS pair_null, coalesce(text, 'nan') || '_' || coalesce(other, 'nan') AS pair_text,
      coalesce(other, 'Unisex') AS with_default,
      CASE WHEN text IS NULL OR text = '' THEN '#CCCCCC' WHEN starts_with(trim(text), 'rgb') THEN trim(text)
           ELSE 'rgb' || trim(text) END AS accord_colour,
      CASE WHEN text IS NULL OR text = '' THEN '(204, 204, 204)' ELSE trim(text) END AS clothes_colour
    FROM messy_texts""",
)
def text_rules(spark, sf):
    """Blank to null, keys, prefixes, path-safe names, interaction features, defaults, colour text."""
    t, o = F.col("text"), F.col("other")
    return derived(spark, sf, "messy_texts").select(
        "id", text.blank_to_null(t).alias("filled"), text.clean_key(t).alias("clean"),
        text.clean_key(text.name_prefix(t)).alias("prefix"), F.concat(F.col("id").cast("string"), F.lit(".jpg")).alias("image"),
        text.path_safe(t).alias("path"), text.pair(t, o).alias("pair_null"), text.pair(t, o, "nan").alias("pair_text"),
        F.coalesce(o, F.lit("Unisex")).alias("with_default"),
        colour.normal_accord_colour(t, vocab.DEFAULT_ACCORD_COLOUR).alias("accord_colour"),
        colour.normal_clothes_rgb(t, vocab.DEFAULT_CLOTHES_RGB).alias("clothes_colour"),
    )


_SPLIT = "regexp_replace(trim(items), '[ ]*[{0}][ ]*', '~', 'g')"
_TIDY = "trim(regexp_replace({0}, '~+', '~', 'g'), '~')"


@query(
    "list_rules", "F11 F12 F14 F28 F13", tables="messy_texts items",
    sql=f"""
    SELECT m.id, regexp_replace(trim(coalesce(dislikes, '')), ' *, *', '~', 'g') AS with_blanks,
      {_TIDY.format("regexp_replace(trim(coalesce(dislikes, '')), ' *, *', '~', 'g')")} AS without_blanks,
      CASE WHEN items IS NULL THEN 'nan' WHEN items = '[]' THEN '' WHEN starts_with(items, '[''') THEN
             replace(replace(replace(items, '[''', ''), ''']', ''), ''', ''', '~')
           WHEN starts_with(items, '["') THEN replace(replace(replace(items, '["', ''), '"]', ''), '", "', '~')
           WHEN contains(items, ',') THEN {_TIDY.format(_SPLIT.format(','))}
           WHEN contains(items, '|') THEN {_TIDY.format(_SPLIT.format('|'))}
           WHEN contains(items, '/') THEN {_TIDY.format(_SPLIT.format('/'))}
           WHEN contains(items, ';') THEN {_TIDY.format(_SPLIT.format(';'))}
           ELSE items END AS any_list,
      accord1 || coalesce(', ' || accord2, '') || ', ' || accord3 AS accords,
      nullif(split_part(regexp_replace(trim(coalesce(dislikes, '')), ' *, *', '~', 'g'), '~', 1), '') AS first_dislike
    FROM messy_texts m JOIN items i ON i.item_id = m.id""",
)
def list_rules(spark, sf):
    """Comma lists, lists of any shape, joining, null-free accord lists, first element."""
    rows = derived(spark, sf, "messy_texts").join(
        derived(spark, sf, "items").withColumnRenamed("item_id", "id"), "id"
    )
    tidy = text.trimmed_list(F.col("dislikes"), keep_blank=False)
    return rows.select(
        "id", F.array_join(text.trimmed_list(F.col("dislikes")), "~").alias("with_blanks"),
        F.array_join(tidy, "~").alias("without_blanks"), F.array_join(text.any_list(F.col("items")), "~").alias("any_list"),
        text.join_list(text.filled_list(F.col("accord1"), F.col("accord2"), F.col("accord3"))).alias("accords"),
        text.first_element(tidy).alias("first_dislike"),
    )


@query(
    "best_seasons", "O5", tables="seasons",
    sql="""
    WITH long AS (SELECT item_id, unnest(['Spring', 'Summer', 'Fall', 'Winter']) AS s, unnest([1, 2, 3, 4]) AS pos,
                         unnest([spring, summer, fall, winter]) AS v FROM seasons),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY v DESC, pos) AS rn FROM long)
    SELECT item_id, max(s) FILTER (WHERE rn = 1) AS top_season,
           max(s) FILTER (WHERE rn = 1) || ', ' || max(s) FILTER (WHERE rn = 2) AS top_two
    FROM r GROUP BY item_id""",
)
def best_seasons(spark, sf):
    """Best season and best two seasons of every item; ties in spring to winter order."""
    values = {s: F.col(s) for s in vocab.SEASONS}
    names = [s.capitalize() for s in vocab.SEASONS]
    return seasons(spark, sf).select(
        "item_id", season.best_columns(values, 1, names).alias("top_season"),
        season.best_columns(values, 2, names).alias("top_two"),
    )


@query(
    "crop_and_fit_boxes", "F25 F26 A14",
    sql="""
    WITH b AS (SELECT p_partkey AS id, p_size - CAST(5.5 AS DOUBLE) AS x, CAST(p_partkey % 37 AS DOUBLE) - 3.2 AS y,
                      CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 41 AS DOUBLE) - 2.7 END AS w,
                      CAST(p_size AS DOUBLE) * 1.3 AS h FROM part),
    t AS (SELECT id, greatest(0, CAST(trunc(x) AS INTEGER)) AS x1, greatest(0, CAST(trunc(y) AS INTEGER)) AS y1,
                 CAST(trunc(w) AS INTEGER) AS w, CAST(trunc(h) AS INTEGER) AS h FROM b WHERE w IS NOT NULL),
    c AS (SELECT id, x1, y1, least(50, x1 + w) AS x2, least(60, y1 + h) AS y2 FROM t WHERE w > 0 AND h > 0),
    k AS (SELECT * FROM c WHERE x1 < x2 AND y1 < y2),
    f AS (SELECT *, least(CAST(64 AS DOUBLE) / (x2 - x1), CAST(48 AS DOUBLE) / (y2 - y1)) AS ratio FROM k),
    n AS (SELECT *, CAST(trunc((x2 - x1) * ratio) AS INTEGER) AS new_w, CAST(trunc((y2 - y1) * ratio) AS INTEGER) AS new_h FROM f)
    SELECT id, x1, y1, x2, y2, new_w, new_h, CAST(floor((64 - new_w) / 2) AS INTEGER) AS paste_x,
           CAST(floor((48 - new_h) / 2) AS INTEGER) AS paste_y FROM n""",
)
def crop_and_fit_boxes(spark, sf):
    """Clamped crop boxes and their letterbox placement in a 64 x 48 frame."""
    part = table(spark, sf, "part")
    boxes = part.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") - F.lit(5.5)).alias("x"),
        ((F.col("p_partkey") % 37).cast("double") - F.lit(3.2)).alias("y"),
        F.when(F.col("p_partkey") % 13 != 0, (F.col("p_partkey") % 41).cast("double") - F.lit(2.7)).alias("w"),
        (F.col("p_size").cast("double") * F.lit(1.3)).alias("h"),
    )
    box = numbers.clamp_box(*(F.col(c) for c in "xywh"), F.lit(50), F.lit(60))
    kept = boxes.select("id", *[c.alias(n) for n, c in box.items()]).filter("usable").drop("usable")
    placed = numbers.letterbox(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(64), F.lit(48))
    return kept.withColumns(placed)


@query(
    "display_rounding", "F27",
    sql="""
    SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_discount * 12.5, 1) AS rounded, count(*) AS n,
           round_even(l_tax, 2) AS tax FROM lineitem GROUP BY ALL""",
)
def display_rounding(spark, sf):
    """Half-even rounding, as shown on the cards."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", numbers.rounded(F.col("l_discount") * F.lit(12.5), 1).alias("rounded"),
        numbers.rounded(F.col("l_tax"), 2).alias("tax"),
    ).groupBy("l_orderkey", "l_linenumber", "l_quantity", "rounded", "tax").agg(F.count(F.lit(1)).alias("n"))


@query(
    "code_translation", "P19 F29",
    sql="""
    SELECT c_custkey AS id,
      CASE c_custkey % 5 WHEN 0 THEN '블라우스' WHEN 1 THEN '탑' WHEN 2 THEN '점프수트' END AS item,
      CASE c_custkey % 4 WHEN 0 THEN '화이트' WHEN 1 THEN '네온' END AS colour,
      CASE c_custkey % 3 WHEN 0 THEN '상의' WHEN 1 THEN '원피스' END AS part,
      CASE c_custkey % 3 WHEN 0 THEN '연인' WHEN 1 THEN '친구' ELSE '소중한 분' END AS recipient
    FROM customer""",
)
def code_translation(spark, sf):
    """Form codes to labels; unknown codes give null or the default."""
    def code(options):
        return F.get(F.array(*[F.lit(o) for o in options]), (F.col("c_custkey") % len(options)).cast("int"))

    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        text.translate_code(code(["blouse", "sleeveless", "jumpsuit", "??", None]), vocab.ITEM_LABEL).alias("item"),
        text.translate_code(code(["white", "neon", "?", None]), vocab.COLOUR_LABEL).alias("colour"),
        text.translate_code(code(["top", "onepiece", "hat"]), vocab.PART_LABEL).alias("part"),
        text.translate_code(code(["lover", "친구", None]), vocab.RECIPIENT_LABEL, vocab.DEFAULT_RECIPIENT).alias("recipient"),
    )


add_derived("image_names", "part", {
    "id": "p_partkey",
    "file": (
        f"CASE p_partkey % 8 WHEN 0 THEN p_type || '_' || {KEY} || '_top.jpg' WHEN 1 THEN p_type || '_' || {KEY} || '_dress.PNG' "
        f"WHEN 2 THEN p_type || '_' || {KEY} || '.jpg' WHEN 3 THEN p_type || '_x' || {KEY} || '_top.jpg' "
        f"WHEN 4 THEN p_type || '_' || {KEY} || '_top.gif' WHEN 5 THEN p_type || '_' || {KEY} || '_top_2.webp' "
        f"WHEN 6 THEN p_name || '_' || {KEY} || '_상의.jpeg' END"
    ),
})


@query(
    "image_records", "P20 P21", tables="image_names",
    sql="""
    WITH n AS (SELECT id, file, regexp_replace(file, '[.][^.]*$', '') AS stem FROM image_names
               WHERE regexp_matches(lower(file), '[.](png|jpg|jpeg|webp)$'))
    SELECT id, file, CAST(split_part(stem, '_', 2) AS BIGINT) AS cloth_id,
           '/static/ui/clothes/' || replace(url_encode(file), '%2F', '/') AS url
    FROM n WHERE len(string_split(stem, '_')) >= 3 AND regexp_matches(split_part(stem, '_', 2), '^[0-9]+$')""",
)
def image_records(spark, sf):
    """Ids and percent-encoded addresses of well-formed image names; others are skipped."""
    named = derived(spark, sf, "image_names").withColumn("cloth_id", text.image_record(F.col("file")))
    url = F.concat(F.lit("/static/ui/clothes/"), text.percent_encode(F.col("file")))
    return named.filter(F.col("cloth_id").isNotNull()).withColumn("url", url)
