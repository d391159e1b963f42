"""Counts, fixpoints, modes, ordered operators, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.text import clean_key, name_prefix
from stylematch.operators import aggregates, encode, ordered, ranking
from stylematch.plans import catalogue, outfits
from stylematch.workload.registry import query
from stylematch.workload.tables import add_derived, derived, families, rating_log, table, weight_history


@query("accord_value_counts", "A1", tables="items", sql="SELECT accord2, count(*) AS n FROM items GROUP BY ALL")
def accord_value_counts(spark, sf):
    return aggregates.value_counts(derived(spark, sf, "items"), "accord2")


@query(
    "family_shares", "A1 M16", tables="families",
    sql="""SELECT family, count(*) AS n, round(count(*) / (SELECT count(family) FROM families), 6) AS share
    FROM families WHERE family IS NOT NULL GROUP BY family ORDER BY n DESC, family LIMIT 10""",
)
def family_shares(spark, sf):
    """Most frequent families with their normalised counts."""
    return aggregates.value_shares(families(spark, sf), "family").withColumn("share", F.round("share", 6))


@query(
    "distinct_accords", "A2", tables="items",
    sql="""SELECT DISTINCT value FROM (SELECT accord1 AS value FROM items UNION ALL SELECT accord2 FROM items
    UNION ALL SELECT accord3 FROM items) WHERE value IS NOT NULL ORDER BY value""",
)
def distinct_accords(spark, sf):
    return aggregates.distinct_values(derived(spark, sf, "items"), ["accord1", "accord2", "accord3"])


@query(
    "null_counts", "A3", tables="dresses",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n FROM dresses"
        for c in ("id", "style", "sub_style", "dress_category", "dress_length", "dress_color", "dress_sleeve_length",
                  "dress_material", "dress_print", "dress_neckline", "dress_fit", "dress_detail")
    ),
)
def null_counts(spark, sf):
    return aggregates.null_counts(derived(spark, sf, "dresses"))


@query(
    "accord_frequency", "A4", tables="items",
    sql="""SELECT value, count(*) AS n FROM (SELECT accord1 AS value FROM items UNION ALL SELECT accord2 FROM items
    UNION ALL SELECT accord3 FROM items) WHERE value IS NOT NULL GROUP BY value""",
)
def accord_frequency(spark, sf):
    return aggregates.stacked_counts(derived(spark, sf, "items"), ["accord1", "accord2", "accord3"])


add_derived("rare_items", "part", {
    "id": "p_partkey", "a1": "' ' || p_name", "a2": "CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS STRING) END",
    "a3": "p_type", "name": "p_name",
})
_CLEAN = "r0 AS MATERIALIZED (SELECT id, lower(trim(a1)) AS a1, coalesce(lower(trim(a2)), 'nan') AS a2, lower(trim(a3)) AS a3 FROM rare_items)"


def _rounds(threshold: int, n: int) -> str:
    """The fixpoint unrolled: more rounds than the data needs change nothing."""
    parts = [_CLEAN]
    for i in range(n):
        parts.append(
            f"q{i} AS MATERIALIZED (SELECT v FROM (SELECT a1 AS v FROM r{i} UNION ALL SELECT a2 FROM r{i} UNION ALL "
            f"SELECT a3 FROM r{i}) GROUP BY v HAVING count(*) < {threshold})"
        )
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT * FROM r{i} WHERE a1 NOT IN (SELECT v FROM q{i}) "
            f"AND a2 NOT IN (SELECT v FROM q{i}) AND a3 NOT IN (SELECT v FROM q{i}))"
        )
    return ", ".join(parts)


RARE_THRESHOLD = 25


@query(
    "rare_value_fixpoint", "A5 F20", tables="rare_items", extra=_rounds(RARE_THRESHOLD, 12),
    sql="SELECT id, a1, a2, a3 FROM r12",
)
def rare_value_fixpoint(spark, sf):
    """Rows with a rare value dropped until no rare value is left."""
    rows = derived(spark, sf, "rare_items").select("id", "a1", "a2", "a3")
    return catalogue.clean_catalogue(rows.withColumn("name", F.lit(None).cast("string")), ["a1", "a2", "a3"], RARE_THRESHOLD).drop("name")


@query(
    "rare_value_mask", "A6", tables="rare_items",
    extra=_CLEAN + ", q AS (SELECT v FROM (SELECT a1 AS v FROM r0 UNION ALL SELECT a2 FROM r0 UNION ALL SELECT a3 FROM r0) "
    f"GROUP BY v HAVING count(*) < {RARE_THRESHOLD + 5})",
    sql="SELECT id, " + ", ".join(f"CASE WHEN {c} IN (SELECT v FROM q) THEN 'None' ELSE {c} END AS {c}" for c in ("a1", "a2", "a3")) + " FROM r0",
)
def rare_value_mask(spark, sf):
    """Rare values replaced by None, rows kept."""
    columns = ["a1", "a2", "a3"]
    rows = aggregates.accord_text(derived(spark, sf, "rare_items").select("id", *columns), columns)
    return aggregates.mask_rare(rows, columns, RARE_THRESHOLD + 5).select("id", *columns)


@query(
    "frequent_tokens", "A7",
    sql="""SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
    GROUP BY token HAVING count(*) >= 25""",
)
def frequent_tokens(spark, sf):
    """Untrimmed tokens of all documents with at least 25 occurrences."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return aggregates.vocabulary(aggregates.tokens(docs, "doc_id", "text", " "), 25)


MODE_COLUMNS = ["top_color", "top_material", "top_fit", "top_neckline", "bottom_length", "bottom_fit"]


def _mode_ctes() -> str:
    parts = []
    for c in MODE_COLUMNS:
        parts.append(
            f"m_{c} AS (SELECT style, {c} FROM (SELECT style, {c}, row_number() OVER (PARTITION BY style ORDER BY count(*) DESC, {c}) "
            f"AS rn FROM tops WHERE {c} IS NOT NULL GROUP BY style, {c}) WHERE rn = 1)"
        )
    return ", ".join(parts)


@query(
    "modes_per_style", "A8", tables="tops", extra=_mode_ctes(),
    sql="SELECT s.style, " + ", ".join(f"m_{c}.{c}" for c in MODE_COLUMNS) + " FROM (SELECT DISTINCT style FROM tops) s "
    + " ".join(f"LEFT JOIN m_{c} ON m_{c}.style = s.style" for c in MODE_COLUMNS),
)
def modes_per_style(spark, sf):
    """Most frequent value per style and column, smallest on ties."""
    return aggregates.group_modes(derived(spark, sf, "tops"), "style", MODE_COLUMNS)


@query(
    "filled_with_modes", "M10 A8", tables="tops", extra=_mode_ctes(),
    sql="SELECT t.id, t.style, " + ", ".join(f"coalesce(t.{c}, m_{c}.{c}) AS {c}" for c in MODE_COLUMNS) + " FROM tops t "
    + " ".join(f"LEFT JOIN m_{c} ON m_{c}.style = t.style" for c in MODE_COLUMNS),
)
def filled_with_modes(spark, sf):
    """Null cells take the mode of their style."""
    tops = derived(spark, sf, "tops")
    modes = aggregates.group_modes(tops, "style", MODE_COLUMNS)
    return aggregates.fill_modes(tops, "style", MODE_COLUMNS, modes).select("id", "style", *MODE_COLUMNS)


@query(
    "rating_correlations", "A12",
    sql="""SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr_l_quantity, round(corr(l_discount, l_extendedprice), 6)
    AS corr_l_discount, round(corr(l_tax, l_extendedprice), 6) AS corr_l_tax, CAST(NULL AS DOUBLE) AS corr_one FROM lineitem""",
)
def rating_correlations(spark, sf):
    """Correlation of several columns with one; a constant column gives null."""
    lines = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    out = aggregates.correlations(lines, ["l_quantity", "l_discount", "l_tax", "one"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query(
    "rating_correlations_per_supplier", "A13",
    sql="""SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS corr_l_quantity FROM lineitem GROUP BY l_suppkey""",
)
def rating_correlations_per_supplier(spark, sf):
    out = aggregates.correlations(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", by=["l_suppkey"])
    return out.withColumn("corr_l_quantity", F.round("corr_l_quantity", 6))


add_derived("images", "lineitem", {
    "path": "'img_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '.jpg'",
    "width": "CAST(l_quantity * 20 AS INT)", "height": "CAST(l_suppkey % 97 AS INT) * 10",
})


@query(
    "largest_image_sides", "A14", tables="images",
    sql="""SELECT count(*) AS n_images, max(width) AS max_width,
    (SELECT min(path) FROM images WHERE width = (SELECT max(width) FROM images)) AS max_width_path, max(height) AS max_height,
    (SELECT min(path) FROM images WHERE height = (SELECT max(height) FROM images)) AS max_height_path FROM images""",
)
def largest_image_sides(spark, sf):
    """Largest width and height with the first image of each."""
    return aggregates.largest_sides(derived(spark, sf, "images"))


@query(
    "next_session_id", "A15", tables="actions", sql="SELECT coalesce(max(session_id), 0) + 1 AS next_id FROM actions",
)
def next_session_id(spark, sf):
    return aggregates.next_id(derived(spark, sf, "actions"), "session_id")


@query(
    "style_class_weights", "A16", tables="tops",
    sql="""WITH c AS (SELECT style, count(*) AS n FROM tops GROUP BY style)
    SELECT style, n, round((SELECT max(n) FROM c) / n, 6) AS weight, round(sqrt((SELECT max(n) FROM c) / n), 6) AS soft_weight FROM c""",
)
def style_class_weights(spark, sf):
    """Balancing weights and their softened form."""
    out = aggregates.class_weights(derived(spark, sf, "tops"), "style")
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "soft_weight")})


@query(
    "newest_weights", "A17",
    sql="""SELECT s_suppkey AS weight_id, round(CAST(1 + s_suppkey % 3 AS DOUBLE) / 6, 9) AS style_weight FROM supplier
    ORDER BY s_suppkey DESC LIMIT 1""",
)
def newest_weights(spark, sf):
    newest = aggregates.newest_row(weight_history(spark, sf), "weight_id")
    return newest.select("weight_id", F.round("style_weight", 9).alias("style_weight"))


GARMENT = ["top_color", "top_category", "top_fit", "bottom_color", "bottom_fit", "bottom_length", "bottom_category",
           "top_print", "bottom_print", "top_neckline"]
_LAG = ", ".join(f"lag({c}) OVER (ORDER BY seq) AS p_{c}" for c in GARMENT)
_EQ = " + ".join(f"CASE WHEN {c} IS NOT DISTINCT FROM p_{c} THEN 1 ELSE 0 END" for c in GARMENT)


@query(
    "similar_neighbours_dropped", "W1", tables="garments",
    sql=f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, {_LAG} FROM garments)
    SELECT seq, file_name FROM l WHERE rn = 1 OR ({_EQ}) / CAST({len(GARMENT)} AS DOUBLE) < CAST(0.7 AS DOUBLE)""",
)
def similar_neighbours_dropped(spark, sf):
    """Rows at least 70 % equal to the row before are dropped."""
    return ordered.drop_similar(derived(spark, sf, "garments"), GARMENT, "seq").select("seq", "file_name")


@query(
    "repeated_keys_dropped", "W2 F20", tables="garments",
    sql="""WITH k AS (SELECT seq, lower(trim(split_part(file_name, '_', 1))) AS p, lower(trim(style)) AS s FROM garments),
    l AS (SELECT *, lag(p) OVER (ORDER BY seq) AS pp, lag(s) OVER (ORDER BY seq) AS ps FROM k)
    SELECT seq FROM l WHERE NOT coalesce(p = pp AND s = ps, false)""",
)
def repeated_keys_dropped(spark, sf):
    """Rows whose key equals the key of the row before are dropped; a null style never equals."""
    keys = [clean_key(name_prefix(F.col("file_name"))), clean_key(F.col("style"))]
    return ordered.drop_repeated_key(derived(spark, sf, "garments"), keys, "seq").select("seq")


@query(
    "both_dedup_passes", "W1 W2", tables="garments",
    sql=f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, {_LAG} FROM garments),
    f AS (SELECT * FROM l WHERE rn = 1 OR ({_EQ}) / CAST({len(GARMENT)} AS DOUBLE) < CAST(0.7 AS DOUBLE)),
    k AS (SELECT seq, lower(trim(split_part(file_name, '_', 1))) AS p, lower(trim(style)) AS s FROM f),
    m AS (SELECT *, lag(p) OVER (ORDER BY seq) AS pp, lag(s) OVER (ORDER BY seq) AS ps FROM k)
    SELECT seq FROM m WHERE NOT coalesce(p = pp AND s = ps, false)""",
)
def both_dedup_passes(spark, sf):
    """Similarity pass, then key pass over what is left."""
    return outfits.drop_repeats(derived(spark, sf, "garments"), "seq").select("seq")


@query(
    "top5_rated_per_user", "W3", tables="rating_log",
    sql="""SELECT user_id, item_id, rate, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rate DESC, item_id) AS rn
    FROM (SELECT user_id, item_id, max(rate) AS rate FROM rating_log GROUP BY ALL)) WHERE rn <= 5""",
)
def top5_rated_per_user(spark, sf):
    """Five best rated items per user, lowest id on ties."""
    best = rating_log(spark, sf).groupBy("user_id", "item_id").agg(F.max("rate").alias("rate"))
    return ranking.top_k(best, ["user_id"], [F.col("rate").desc(), F.col("item_id")], 5, rank="rank")


@query(
    "scaled_per_group", "W4",
    sql="""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce((l_quantity - min(l_quantity) OVER w) / nullif(max(l_quantity) OVER w
    - min(l_quantity) OVER w, 0), 0), 6) AS l_quantity, round(coalesce((l_tax - min(l_tax) OVER w) / nullif(max(l_tax) OVER w - min(l_tax) OVER w, 0),
    0), 6) AS l_tax FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def scaled_per_group(spark, sf):
    """Min-max scaling inside each order; a constant column gives 0."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    scaled = ranking.scale_by_group(lines, "l_orderkey", ["l_quantity", "l_tax"])
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_tax")})


@query(
    "first_outfit_per_session", "W5", tables="actions",
    sql="""SELECT session_id, first_value(action) OVER w AS action, first_value(rate) OVER w AS rate, item_id, event_id FROM actions
    WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def first_outfit_per_session(spark, sf):
    """Every row takes the first action and rating of its session."""
    return ordered.first_of_group(derived(spark, sf, "actions"), "session_id", ["action", "rate"], "event_id")


@query(
    "first_rows_of_first_users", "W6", tables="actions",
    sql="""SELECT * FROM (SELECT session_id, item_id, action, rate, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id
    ORDER BY event_id) AS rn FROM actions) WHERE rn = 1) ORDER BY event_id LIMIT 100""",
)
def first_rows_of_first_users(spark, sf):
    """First row per session, then the first 100 sessions in input order."""
    return ordered.first_rows(derived(spark, sf, "actions"), "session_id", "event_id", 100)


@query(
    "dense_positions", "W7 P1", tables="makers",
    sql=f"""SELECT id, brand, row_number() OVER (ORDER BY id) - 1 AS item_id FROM makers
    WHERE regexp_matches(lower(replace(brand, '-', '')), '{"|".join(vocab.TARGET_BRANDS)}')""",
)
def dense_positions(spark, sf):
    """0-based position of the rows left by the brand filter, as the item id."""
    kept = catalogue.select_brands(derived(spark, sf, "makers"), "id", vocab.TARGET_BRANDS)
    return kept.select("id", "brand", "item_id")


@query(
    "rank_points", "W8", tables="percent",
    extra="scores AS (SELECT CASE o_orderpriority WHEN '5-LOW' THEN 'low' ELSE 'other' END AS style, o_orderstatus || o_orderpriority AS family, "
    "count(*) AS score FROM orders GROUP BY ALL UNION ALL SELECT style, family, CAST(score AS BIGINT) FROM percent)",
    sql="""SELECT style, family, score, rank() OVER (PARTITION BY style ORDER BY score)
    + (count(*) OVER (PARTITION BY style, score) - 1) / CAST(2 AS DOUBLE) AS points FROM scores""",
)
def rank_points(spark, sf):
    """Average ranks per style: of order counts, and of the (whole) survey percentages."""
    style = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("low")).otherwise(F.lit("other"))
    counts = table(spark, sf, "orders").groupBy(
        style.alias("style"), F.concat("o_orderstatus", "o_orderpriority").alias("family")
    ).agg(F.count(F.lit(1)).alias("score"))
    survey = vocab.style_scores(spark).withColumn("score", F.round("score").cast("bigint"))
    return ranking.rank_points(counts.unionByName(survey))


@query(
    "best_of_grid", "O4",
    sql="""SELECT l_quantity, CAST(count(*) AS BIGINT) AS n, min(l_orderkey) AS seq FROM lineitem GROUP BY l_quantity
    ORDER BY n DESC, seq LIMIT 1""",
)
def best_of_grid(spark, sf):
    """Row with the largest metric, first on ties."""
    grid = table(spark, sf, "lineitem").groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("seq")
    )
    return ranking.arg_max(grid, "n", "seq")


@query("sampled_images", "O6")
def sampled_images(spark, sf):
    """Four hash-chosen garments per category and colour, padded with nulls."""
    picks = ranking.sample_padded(derived(spark, sf, "tops"), ["top_category", "top_color"], "id", 4)
    return picks.withColumn("n_picks", F.size("picks"))


@query(
    "multi_hot_materials", "M5 F12", tables="tops",
    sql="""
    WITH l AS (SELECT id, CASE WHEN top_material IS NULL THEN ['nan']
      WHEN top_material LIKE '[%' THEN string_split(replace(replace(replace(top_material, '[''', ''), ''']', ''), ''', ''', '~'), '~')
      WHEN contains(top_material, ',') THEN string_split(replace(top_material, ', ', ','), ',')
      WHEN contains(top_material, '|') THEN string_split(top_material, '|')
      WHEN contains(top_material, '/') THEN string_split(top_material, '/') ELSE [top_material] END AS m FROM tops)
    SELECT id, """ + ", ".join(
        f"CASE WHEN list_contains(m, '{v}') THEN 1 ELSE 0 END AS \"top_material_{v}\""
        for v in ("nan", "데님", "린넨", "면", "실크", "울", "캐시미어")
    ) + " FROM l",
)
def multi_hot_materials(spark, sf):
    """One 0/1 column per material."""
    tops = derived(spark, sf, "tops")
    named = encode.class_index(encode.multi_hot_rows(tops, "id", "top_material"))
    return encode.multi_hot(tops, "id", "top_material", [r["class"] for r in named.orderBy("place").collect()])


@query(
    "multi_hot_places", "M5", tables="tops",
    sql="""
    WITH l AS (SELECT id, unnest(CASE WHEN top_material IS NULL THEN ['nan']
      WHEN top_material LIKE '[%' THEN string_split(replace(replace(replace(top_material, '[''', ''), ''']', ''), ''', ''', '~'), '~')
      WHEN contains(top_material, ',') THEN string_split(replace(top_material, ', ', ','), ',')
      WHEN contains(top_material, '|') THEN string_split(top_material, '|')
      WHEN contains(top_material, '/') THEN string_split(top_material, '/') ELSE [top_material] END) AS m FROM tops),
    c AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS place FROM (SELECT DISTINCT m FROM l))
    SELECT id, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM (SELECT DISTINCT id, place FROM l JOIN c USING (m)) GROUP BY id""",
)
def multi_hot_places(spark, sf):
    """The materials of every row as places in the list of all materials: the sparse form of the matrix."""
    rows, _ = encode.multi_hot_sparse(derived(spark, sf, "tops"), "id", "top_material")
    return rows.select("id", F.array_join(F.col("indices").cast("array<string>"), ",").alias("places"))


@query(
    "list_like_columns", "M6", tables="tops",
    sql=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(bool_or(regexp_matches({c}, '[[].*[]]|,')), false) AS list_like FROM tops"
        for c in ("style", "top_material", "bottom_material", "top_print", "bottom_fit")
    ),
)
def list_like_columns(spark, sf):
    """Columns with a value that looks like a list."""
    columns = ["style", "top_material", "bottom_material", "top_print", "bottom_fit"]
    return encode.list_like_columns(derived(spark, sf, "tops"), columns)


_CODE = "(SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS c FROM (SELECT DISTINCT {0} AS v FROM tops WHERE {0} IS NOT NULL))"


@query(
    "ordinal_codes", "M7 M8", tables="tops users",
    sql=f"""SELECT user_id, coalesce(a.c, -1) AS top_category, coalesce(b.c, -1) AS top_color, s.v AS style FROM users u
    LEFT JOIN {_CODE.format('top_category')} a ON a.v = replace(u.top_category, '셔츠', '?') LEFT JOIN {_CODE.format('top_color')} b
    ON b.v = u.top_color LEFT JOIN {_CODE.format('style')} s ON s.v = u.user_style""",
)
def ordinal_codes(spark, sf):
    """Codes learned on the garments and applied to the users, unknown values -1; the label is decoded again."""
    columns = ["top_category", "top_color", "style"]
    codes = encode.ordinal_codes(derived(spark, sf, "tops"), columns)
    users = derived(spark, sf, "users").select(
        "user_id", F.replace("top_category", F.lit("셔츠"), F.lit("?")).alias("top_category"), "top_color", F.col("user_style").alias("style")
    )
    coded = encode.ordinal_encode(users, columns, codes).withColumnRenamed("style", "y")
    return encode.label_decode(coded, "y", codes, "style", "style").select("user_id", *columns)


@query(
    "stratified_split_sizes", "M9", tables="tops",
    sql="SELECT style, count(*) AS n, CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS n_test FROM tops GROUP BY style",
)
def stratified_split_sizes(spark, sf):
    """Exact test share of every class."""
    split = encode.stratified_split(derived(spark, sf, "tops"), "style", "id", 0.2)
    return split.groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query(
    "oversampled_sizes", "M11", tables="tops",
    sql="""SELECT style, CASE style WHEN '아방가르드' THEN greatest(count(*), 800) WHEN '젠더리스' THEN greatest(count(*), 800) ELSE count(*) END AS n,
    count(DISTINCT id) AS n_rows FROM tops GROUP BY style""",
)
def oversampled_sizes(spark, sf):
    """Two named classes grown to 800 rows, every original row kept."""
    grown = encode.oversample(derived(spark, sf, "tops"), "style", {"아방가르드": 800, "젠더리스": 800}, "id")
    return grown.groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_rows"))


@query(
    "oversampled_with_replacement", "M11", tables="tops",
    sql="""SELECT style, CASE style WHEN '아방가르드' THEN greatest(count(*), 2500) WHEN '젠더리스' THEN greatest(count(*), 2500) ELSE count(*) END AS n,
    count(DISTINCT id) AS n_rows FROM tops GROUP BY style""",
)
def oversampled_with_replacement(spark, sf):
    """Two named classes grown to 2,500 rows by draws with replacement, every original row kept."""
    grown = encode.oversample_drawn(derived(spark, sf, "tops"), "style", {"아방가르드": 2500, "젠더리스": 2500}, "id")
    return grown.groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_rows"))
