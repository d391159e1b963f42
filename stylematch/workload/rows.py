"""Filters, gates, searches, checks, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions.numbers import thousands_id
from stylematch.functions.text import trimmed_list
from stylematch.operators import filters, joins, sets
from stylematch.operators.aggregates import newest_row, share_where
from stylematch.operators.ranking import best_rows
from stylematch.plans import score
from stylematch.plans.styles import add_pairs
from stylematch.session import scratch_path
from stylematch.sources import tables as maintenance
from stylematch.sources.delimited import column_named, tidy_header
from stylematch.sources.stored import StoredTable
from stylematch.sources.text_index import TextIndex
from stylematch.workload.registry import query
from stylematch.workload.scoring import PEOPLE
from stylematch.workload.tables import (
    ACCORD_COLOURS, accord_colours, add_derived, clothes_colours, derived, families, pick, rating_log, seasons, table, weight_history,
)


@query(
    "brand_allow_list", "P1 P2", tables="makers",
    sql=f"""
    SELECT id, brand, url, name FROM makers
    WHERE regexp_matches(lower(replace(brand, '-', '')), '{"|".join(vocab.TARGET_BRANDS)}')""",
)
def brand_allow_list(spark, sf):
    """Brands that contain a target brand; unused columns dropped."""
    kept = filters.brand_allow_list(derived(spark, sf, "makers"), "brand", vocab.TARGET_BRANDS)
    return filters.drop_matching(kept, names=("country", "year"))


@query(
    "drop_by_name_prefix_suffix", "P2 P3", tables="tops",
    sql="""SELECT id AS garment_id, style, top_color, top_category, top_material, top_neckline, top_fit, bottom_color
    FROM tops""",
)
def drop_by_name_prefix_suffix(spark, sf):
    """Columns dropped by suffix and name, then kept by position and renamed."""
    slim = filters.drop_matching(derived(spark, sf, "tops"), names=("sub_style",), suffixes=("_length", "_print"))
    return filters.keep_columns(slim, [0, 1, 2, 3, "top_material", "top_neckline", 6, 7], {"id": "garment_id"})


@query(
    "exclude_limited_editions", "P4", tables="makers",
    sql="SELECT id, name FROM makers WHERE name IS NULL OR NOT contains(lower(name), 'limited-edition')",
)
def exclude_limited_editions(spark, sf):
    """Names with the term in any case are dropped, null names stay."""
    return filters.exclude_term(derived(spark, sf, "makers"), "name", "Limited-Edition").select("id", "name")


@query(
    "outfit_shapes", "P5 P6 P7",
    sql="""
    WITH f AS (SELECT p_partkey AS id, p_partkey % 3 <> 0 AS t, p_size % 4 > 0 AS b, p_partkey % 3 = 0 OR p_size % 7 = 0 AS d,
                      p_partkey % 11 = 0 AS o FROM part)
    SELECT id, t AS has_top, b AS has_bottom, d AS has_dress FROM f
    WHERE NOT o AND ((t AND b AND NOT d) OR (d AND NOT t AND NOT b))""",
)
def outfit_shapes(spark, sf):
    """Empty label arrays become null, outerwear is rejected, exactly one outfit shape is kept."""
    key, size = F.col("p_partkey"), F.col("p_size")

    def label(present):
        filled = F.array(F.struct(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b")))
        blank = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
        return F.when(present, filled).when(size % 3 == 0, blank).when(size % 3 == 1, F.slice(blank, 1, 0))

    docs = table(spark, sf, "part").select(
        key.alias("id"), label(key % 3 != 0).alias("top"), label(size % 4 > 0).alias("bottom"),
        label((key % 3 == 0) | (size % 7 == 0)).alias("dress"), label(key % 11 == 0).alias("outer"),
    )
    clean = filters.empty_to_null(docs, ["top", "bottom", "dress", "outer"])
    shaped = filters.one_outfit_shape(filters.without_part(clean, "outer"), "top", "bottom", "dress")
    return shaped.select("id", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("top", "bottom", "dress")])


def _mixed(spark, sf):
    rows = derived(spark, sf, "tops").join(
        derived(spark, sf, "dresses").select("id", "dress_category", "dress_color", "dress_fit"), "id"
    )
    return rows.withColumn("rect_dress", F.when(F.col("id") % 4 == 0, F.lit("r")))


@query(
    "one_piece_rows", "P8", tables="dresses",
    sql="SELECT id, style, sub_style, 'r' AS rect_dress, dress_category, dress_color, dress_fit FROM dresses WHERE id % 4 = 0",
)
def one_piece_rows(spark, sf):
    """The one-piece subset with its own columns."""
    rows = _mixed(spark, sf).drop("style", "sub_style").join(derived(spark, sf, "dresses").select("id", "style", "sub_style"), "id")
    return filters.split_outfits(rows, "rect_dress", ("id", "style", "sub_style"))[0]


@query(
    "two_piece_rows", "P8", tables="tops",
    sql="""SELECT id, style, sub_style, top_color, top_category, top_sleeve_length, top_material, top_print, top_neckline,
    top_fit, bottom_length, bottom_color, bottom_category, bottom_material, bottom_print, bottom_fit
    FROM tops WHERE id % 4 <> 0""",
)
def two_piece_rows(spark, sf):
    """The two-piece subset with its own columns."""
    return filters.split_outfits(_mixed(spark, sf), "rect_dress", ("id", "style", "sub_style"))[1]


@query(
    "recode_and_exclude", "P9 P10", tables="tops dresses",
    sql="""
    SELECT t.id, CASE WHEN top_category = '브라탑' THEN '탑' ELSE top_category END AS top_category, dress_category
    FROM tops t JOIN dresses d ON d.id = t.id WHERE dress_category IS DISTINCT FROM '점프수트'""",
)
def recode_and_exclude(spark, sf):
    """One category recoded, one excluded with nulls kept."""
    tops = filters.recode(derived(spark, sf, "tops"), "top_category", {"브라탑": "탑"}).select("id", "top_category")
    dresses = filters.exclude_value(derived(spark, sf, "dresses"), "dress_category", "점프수트")
    return tops.join(dresses.select("id", "dress_category"), "id")


@query(
    "allowed_items_per_dislike", "P11", tables="items",
    sql="""
    WITH w AS (SELECT item_id, l, accord1, accord2, accord3 FROM items
               CROSS JOIN (SELECT unnest(['', 'woody', 'rose,iris', 'lavender,,amber', 'green']) AS l)),
    k AS (SELECT l, item_id FROM w WHERE NOT (list_contains(string_split(l, ','), accord1)
          OR coalesce(list_contains(string_split(l, ','), accord2), false) OR list_contains(string_split(l, ','), accord3)))
    SELECT l AS dislikes, count(*) AS n_items, CAST(sum(item_id) AS BIGINT) AS id_sum FROM k GROUP BY l""",
)
def allowed_items_per_dislike(spark, sf):
    """Items left per dislike list; null accords never match and an empty list excludes nothing."""
    lists = ["", "woody", " rose , iris ", "lavender,,amber", "green"]
    items = derived(spark, sf, "items").withColumn("l", F.explode(F.array(*[F.lit(x) for x in lists])))
    tidy = trimmed_list(F.col("l"), keep_blank=False)
    kept = items.filter(~filters.disliked(F.array("accord1", "accord2", "accord3"), tidy))
    return kept.groupBy(F.regexp_replace(F.trim("l"), " *, *", ",").alias("dislikes")).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("item_id").alias("id_sum")
    )


_GATES = """
    WITH g AS (SELECT style, family, score, dense_rank() OVER (PARTITION BY style ORDER BY score DESC) AS lv FROM percent),
    n AS (SELECT family, count(*) AS n_items FROM families GROUP BY family)
    SELECT style, g.family, lv <= 2 AS in_top_two, score > 0 AS nonzero, coalesce(n_items, 0) AS n_items
    FROM g LEFT JOIN n ON n.family = g.family WHERE lv <= 2 OR score > 0"""


@query("style_gates", "P12 P13 M16", tables="percent families", sql=_GATES)
def style_gates(spark, sf):
    """Families a style allows under both gates, with the items of each family."""
    scores = vocab.style_scores(spark)
    top = filters.top_value_gate(scores).withColumn("in_top_two", F.lit(True))
    some = filters.nonzero_gate(scores).withColumn("nonzero", F.lit(True))
    sizes = families(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n_items"))
    both = some.join(top, ["style", "family"], "full")
    return both.join(sizes, "family", "left").fillna(False, ["in_top_two", "nonzero"]).fillna(0, ["n_items"])


@query(
    "id_range", "P14", tables="users", sql="SELECT user_id, season FROM users WHERE user_id BETWEEN 1001 AND 1100",
)
def id_range(spark, sf):
    """Inclusive id range, the evaluation users of the stored log."""
    return filters.id_range(derived(spark, sf, "users"), "user_id", 1001, 1100).select("user_id", "season")


@query(
    "search_items", "P15", tables="items",
    sql="""SELECT item_id, name, brand FROM items WHERE contains(lower(name), 'red w') OR contains(lower(brand), 'red w')
    OR contains(lower(brand), 'redw') ORDER BY item_id LIMIT 20""",
)
def search_items(spark, sf):
    """Name or brand search, first 20 by id."""
    return filters.search_items(derived(spark, sf, "items"), " Red W").select("item_id", "name", "brand")


@query(
    "search_items_by_plain_brand", "P15", tables="items",
    sql="""SELECT item_id, name, brand FROM items WHERE contains(lower(brand), 'brand#24') ORDER BY item_id LIMIT 20""",
)
def search_items_by_plain_brand(spark, sf):
    """The brand is also tried with blanks and dashes taken from the query."""
    return filters.search_items(derived(spark, sf, "items"), "Brand -#24").select("item_id", "name", "brand")


@query(
    "search_all_terms", "P16", tables="items",
    sql="""SELECT item_id, name, brand FROM items
    WHERE (contains(lower(name), 'gear') OR contains(lower(brand), 'gear'))
      AND (contains(lower(name), '#1') OR contains(lower(brand), '#1'))""",
)
def search_all_terms(spark, sf):
    """Every term in name or brand."""
    return filters.search_terms(derived(spark, sf, "items"), "GEAR #1", ["name", "brand"]).select("item_id", "name", "brand")


def _indexed_items(spark, sf):
    items = derived(spark, sf, "items")
    return items, TextIndex.create(items, scratch_path(spark, "item-index"), "item_id", ["name", "brand"], 16)


@query(
    "indexed_search_items", "P15", tables="items",
    sql="""SELECT item_id, name, brand FROM items WHERE contains(lower(name), 'red w') OR contains(lower(brand), 'red w')
    OR contains(lower(brand), 'redw') ORDER BY item_id LIMIT 20""",
)
def indexed_search_items(spark, sf):
    """Name or brand search by trigram postings, first 20 by id."""
    items, index = _indexed_items(spark, sf)
    return index.search_items(items, " Red W").select("item_id", "name", "brand")


@query(
    "indexed_search_all_terms", "P16", tables="items",
    sql="""SELECT item_id, name, brand FROM items
    WHERE (contains(lower(name), 'gear') OR contains(lower(brand), 'gear'))
      AND (contains(lower(name), '#1') OR contains(lower(brand), '#1'))""",
)
def indexed_search_all_terms(spark, sf):
    """Every term in name or brand, by the postings of the terms that have trigrams."""
    items, index = _indexed_items(spark, sf)
    return index.search_terms(items, "GEAR #1", ["name", "brand"]).select("item_id", "name", "brand")


@query(
    "facets", "P17", tables="tops",
    sql="""
    SELECT 'top_category' AS facet, top_category AS value, count(*) AS n FROM tops GROUP BY ALL
    UNION ALL SELECT 'bottom_category', bottom_category, count(*) FROM tops GROUP BY ALL
    UNION ALL SELECT 'style', style, count(*) FROM tops GROUP BY ALL""",
)
def facets(spark, sf):
    """Value counts of the list filters, in one pass."""
    return filters.facet_counts(derived(spark, sf, "tops"), ["top_category", "bottom_category", "style"])


@query(
    "facet_filter", "P17", tables="tops",
    sql="""SELECT id, style, sub_style FROM tops WHERE top_category = '셔츠' AND bottom_category = '팬츠'
    AND (contains(lower(style), '스') OR contains(lower(sub_style), '스'))""",
)
def facet_filter(spark, sf):
    """Facet values and a text search together."""
    facets = {"top_category": "셔츠", "bottom_category": "팬츠"}
    return filters.list_filter(derived(spark, sf, "tops"), facets, "스", ["style", "sub_style"]).select("id", "style", "sub_style")


add_derived("forms", "customer", {
    "id": "c_custkey",
    "season": pick("c_custkey % 6", ["봄", "여름", "가을", "겨울", ""]),
    "top": pick("c_custkey % 3", ["shirt", "knit"]), "top_color": pick("c_custkey % 4", ["white", "black", "navy"]),
    "bottom": pick("c_custkey % 5", ["pants", "jeans", "skirt", "slacks"]), "bottom_color": pick("c_nationkey % 3", ["grey", "navy"]),
    "onepiece": pick("c_custkey % 7", ["dress", "onepiece"]), "onepiece_color": pick("c_nationkey % 2", ["red"]),
})
_FAULT = """CASE WHEN season IS NULL OR season = '' THEN 'season missing'
    WHEN NOT ((top IS NOT NULL AND top_color IS NOT NULL AND bottom IS NOT NULL AND bottom_color IS NOT NULL)
              OR (onepiece IS NOT NULL AND onepiece_color IS NOT NULL)) THEN 'outfit incomplete' END"""


@query(
    "outfit_form_check", "P18", tables="forms", sql=f"SELECT id, {_FAULT} AS reason FROM forms",
)
def outfit_form_check(spark, sf):
    """Accepted and rejected forms with the reason."""
    good, bad = filters.validate_outfits(derived(spark, sf, "forms"))
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


@query(
    "enriched_outfits", "J1", tables="users tops dresses",
    sql="""
    SELECT user_id, u.top_id, u.bottom_id, u.dress_id, t.top_material, t.top_fit, t.top_print, t.top_neckline,
      t.top_sleeve_length, t.sub_style AS top_sub_style, b.bottom_material, b.bottom_fit, b.bottom_length,
      b.sub_style AS bottom_sub_style, d.dress_material, d.dress_fit, d.dress_print, d.dress_detail, d.dress_neckline,
      d.dress_length, d.dress_sleeve_length, d.sub_style AS dress_sub_style
    FROM users u LEFT JOIN tops t ON t.id = u.top_id LEFT JOIN tops b ON b.id = u.bottom_id
    LEFT JOIN dresses d ON d.id = u.dress_id""",
)
def enriched_outfits(spark, sf):
    """Users with the attributes of their top, bottom and dress."""
    users = derived(spark, sf, "users").select("user_id", "top_id", "bottom_id", "dress_id")
    return joins.enrich_outfits(
        users, derived(spark, sf, "tops"), derived(spark, sf, "dresses"), {"dress": ["dress_sleeve_length"]}
    )


@query(
    "unknown_outfit_ids", "J2", tables="users tops dresses",
    sql="""
    SELECT user_id, 'top' AS part, top_id AS missing_id FROM users WHERE top_id NOT IN (SELECT id FROM tops)
    UNION ALL SELECT user_id, 'bottom', bottom_id FROM users WHERE bottom_id NOT IN (SELECT id FROM tops)
    UNION ALL SELECT user_id, 'dress', dress_id FROM users WHERE dress_id NOT IN (SELECT id FROM dresses)""",
)
def unknown_outfit_ids(spark, sf):
    """Users whose outfit names a missing garment: the reject side of the strict lookup."""
    return joins.unknown_outfits(derived(spark, sf, "users"), derived(spark, sf, "tops"), derived(spark, sf, "dresses"))


@query(
    "known_outfits", "J2", tables="users tops dresses",
    sql="""
    SELECT user_id FROM users WHERE (top_id IS NULL OR top_id IN (SELECT id FROM tops))
    AND (bottom_id IS NULL OR bottom_id IN (SELECT id FROM tops)) AND (dress_id IS NULL OR dress_id IN (SELECT id FROM dresses))""",
)
def known_outfits(spark, sf):
    """Users whose named garments all exist."""
    known = joins.known_outfits(derived(spark, sf, "users"), derived(spark, sf, "tops"), derived(spark, sf, "dresses"))
    return known.select("user_id")


@query(
    "season_join_policies", "J3 J4", tables="items seasons",
    sql="""
    SELECT 'left' AS policy, count(*) AS n, count(spring) AS n_scored, CAST(sum(spring) AS BIGINT) AS spring
    FROM items LEFT JOIN seasons USING (item_id)
    UNION ALL SELECT 'inner', count(*), count(spring), CAST(sum(spring) AS BIGINT) FROM items JOIN seasons USING (item_id)""",
)
def season_join_policies(spark, sf):
    """Items without season votes: kept with null, or dropped."""
    items, votes = derived(spark, sf, "items"), seasons(spark, sf)
    parts = [
        items.join(votes, "item_id", how).agg(
            F.lit(how).alias("policy"), F.count(F.lit(1)).alias("n"), F.count("spring").alias("n_scored"),
            F.sum("spring").cast("bigint").alias("spring"),
        )
        for how in ("left", "inner")
    ]
    return sets.stack_rows(*parts)


@query(
    "colour_lookup_policies", "J5", tables="items accord_rgb",
    sql="""
    SELECT item_id, CAST(a.r AS INTEGER) AS strict_red, CAST(coalesce(a.r, 255) AS INTEGER) AS white_red,
      CASE WHEN accord2 IS NULL OR a.accord IS NULL THEN true ELSE false END AS rejected
    FROM items LEFT JOIN accord_rgb a ON a.accord = accord2""",
)
def colour_lookup_policies(spark, sf):
    """Second accord to colour: null, white, or the reject table when the accord is unknown."""
    items, colours = derived(spark, sf, "items"), accord_colours(spark)
    white = F.array(F.lit(255), F.lit(255), F.lit(255))
    both = joins.lookup(items, "accord2", colours, "accord", "rgb", "strict")
    both = joins.lookup(both, "accord2", colours, "accord", "rgb", "white", white)
    first = F.lit(0)
    return both.select(
        "item_id", F.get("strict", first).alias("strict_red"), F.get("white", first).alias("white_red"),
        F.col("strict").isNull().alias("rejected"),
    )


@query(
    "unscored_items", "J5 J6 P11", tables="items families seasons accord_rgb",
    sql="""
    SELECT item_id, 'no season row' AS reason FROM items WHERE item_id NOT IN (SELECT item_id FROM seasons)
    UNION ALL SELECT item_id, 'accord2 has no colour' FROM items WHERE accord2 IS NULL OR accord2 NOT IN (SELECT accord FROM accord_rgb)
    UNION ALL SELECT item_id, 'accord1 has no colour' FROM items WHERE accord1 IS NULL OR accord1 NOT IN (SELECT accord FROM accord_rgb)
    UNION ALL SELECT item_id, 'accord3 has no colour' FROM items WHERE accord3 IS NULL OR accord3 NOT IN (SELECT accord FROM accord_rgb)
    UNION ALL SELECT item_id, 'no family row' FROM items WHERE item_id NOT IN (SELECT item_id FROM families)""",
)
def unscored_items(spark, sf):
    """Items the strict score refuses, with the reason."""
    return score.unscored_items(derived(spark, sf, "items"), accord_colours(spark), families(spark, sf), seasons(spark, sf))


@query(
    "children_with_parent", "J6 S9", tables="items seasons",
    sql="""
    WITH v AS (SELECT l_partkey + CASE WHEN l_partkey % 29 = 0 THEN 1000000 ELSE 0 END AS item_id, l_quantity FROM lineitem)
    SELECT count(*) AS n_read, count(*) FILTER (WHERE item_id IN (SELECT item_id FROM items)) AS n_ok,
      count(*) FILTER (WHERE item_id NOT IN (SELECT item_id FROM items)) AS n_skipped FROM v""",
)
def children_with_parent(spark, sf):
    """Rows with a known item are kept, the others counted as skipped."""
    key = F.col("l_partkey")
    votes = table(spark, sf, "lineitem").select(
        (key + F.when(key % 29 == 0, F.lit(1000000)).otherwise(F.lit(0))).alias("item_id"), "l_quantity"
    )
    kept, lost = joins.with_parent(votes, derived(spark, sf, "items"), "item_id")
    both = kept.withColumn("ok", F.lit(1)).unionByName(lost.withColumn("ok", F.lit(0)))
    return both.agg(
        F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("ok") == 1).alias("n_ok"), F.count_if(F.col("ok") == 0).alias("n_skipped")
    )


@query(
    "soft_references", "J7", tables="users tops",
    sql="SELECT user_id, t.id AS top_id FROM users u LEFT JOIN tops t ON t.id = u.top_id",
)
def soft_references(spark, sf):
    """Unknown tops become null, users stay."""
    users = derived(spark, sf, "users").select("user_id", "top_id")
    return joins.soft_reference(users, "top_id", derived(spark, sf, "tops"), "id", "user_id")


@query(
    "first_matching_garment", "J8", tables="users tops",
    sql="""
    SELECT user_id, top_category, top_color, m.id AS matched_id FROM users u
    LEFT JOIN (SELECT top_category AS k, top_color AS c, min(id) AS id FROM tops GROUP BY ALL) m
      ON m.k = u.top_category AND m.c = u.top_color""",
)
def first_matching_garment(spark, sf):
    """Lowest garment id of the chosen category and colour."""
    users = derived(spark, sf, "users").select("user_id", "top_category", "top_color")
    return joins.first_garment(users, derived(spark, sf, "tops"), "top", "matched_id")


@query(
    "first_matching_dress", "J8", tables="users dresses",
    sql="""
    SELECT user_id, dress_color, m.id AS matched_id FROM users u
    LEFT JOIN (SELECT dress_color AS c, min(id) AS id FROM dresses GROUP BY ALL) m ON m.c = u.dress_color""",
)
def first_matching_dress(spark, sf):
    """Lowest dress id of the chosen colour; a dress has no other choice."""
    users = derived(spark, sf, "users").select("user_id", "dress_color")
    return joins.first_garment(users, derived(spark, sf, "dresses"), "dress", "matched_id")


@query(
    "labeling_agreement", "J9 E6 M16 M17 A10", tables="items families",
    extra="cluster_family(cluster, family) AS (VALUES " + ", ".join(
        f"('{k}', '{v}')" for k, v in vocab.CLUSTER_FAMILY.items()
    ) + ")",
    sql="""
    SELECT count(*) AS n, CAST(sum(CASE WHEN f.family = c.family THEN 1 ELSE 0 END) AS BIGINT) AS n_equal,
      round(avg(CASE WHEN f.family = c.family THEN 1 ELSE 0 END), 6) AS match_ratio
    FROM families f JOIN items i USING (item_id) LEFT JOIN cluster_family c ON c.cluster = CAST(item_id % 11 AS VARCHAR)""",
)
def labeling_agreement(spark, sf):
    """Family from the accord against family from the cluster."""
    named = vocab.cluster_family(spark).withColumnRenamed("family", "cluster_family")
    clusters = derived(spark, sf, "items").select("item_id", (F.col("item_id") % 11).cast("string").alias("cluster"))
    labels = clusters.join(named, "cluster", "left")
    out = joins.agreement(families(spark, sf), labels, "item_id", "family", "cluster_family")
    return out.withColumn("match_ratio", F.round("match_ratio", 6))


@query(
    "result_details", "J11 O3", tables="items seasons rating_log",
    sql="""
    SELECT user_id, item_id, rate, name, brand, accord1, accord2, accord3, CAST(spring AS BIGINT) AS spring
    FROM (SELECT user_id, item_id, max(rate) AS rate FROM rating_log GROUP BY ALL) JOIN items USING (item_id)
    LEFT JOIN seasons USING (item_id)""",
)
def result_details(spark, sf):
    """Every scored pair with its item and season columns, best first."""
    best = rating_log(spark, sf).groupBy("user_id", "item_id").agg(F.max("rate").alias("rate"))
    wide = best.join(derived(spark, sf, "items"), "item_id").join(seasons(spark, sf), "item_id", "left")
    return wide.select(
        "user_id", "item_id", "rate", "name", "brand", "accord1", "accord2", "accord3", F.col("spring").cast("bigint").alias("spring")
    ).orderBy(F.col("rate").desc(), "user_id", "item_id")


@query(
    "latest_users_best", "O3 O1 A17", tables="rating_log items",
    sql="""
    SELECT user_id, item_id, max(rate) AS rate FROM rating_log WHERE user_id = (SELECT max(user_id) FROM rating_log)
    GROUP BY ALL ORDER BY rate DESC, item_id LIMIT 3""",
)
def latest_users_best(spark, sf):
    """Best three rows of the newest user."""
    log = rating_log(spark, sf)
    newest = newest_row(log.select("user_id"), "user_id")
    rows = log.join(newest, "user_id").groupBy("user_id", "item_id").agg(F.max("rate").alias("rate"))
    return best_rows(rows, "rate", "item_id", 3)


@query(
    "latest_session_bundle", "J12", tables="actions items",
    sql="""
    SELECT session_id, a.item_id, action, rate, event_id, name FROM actions a LEFT JOIN items i ON i.item_id = a.item_id
    WHERE session_id = (SELECT max(session_id) FROM actions)""",
)
def latest_session_bundle(spark, sf):
    """All rows of the newest session with item names."""
    return joins.latest_bundle(derived(spark, sf, "actions"), "session_id", derived(spark, sf, "items"))


@query(
    "plain_top_bottom_share", "A10", tables="tops",
    sql="SELECT round(avg(CASE WHEN top_print = '무지' AND bottom_print = '무지' THEN 1 ELSE 0 END), 6) AS share FROM tops",
)
def plain_top_bottom_share(spark, sf):
    """Share of rows with plain top and plain bottom."""
    plain = (F.col("top_print") == "무지") & (F.col("bottom_print") == "무지")
    return share_where(derived(spark, sf, "tops"), plain).withColumn("share", F.round("share", 6))


@query(
    "stacked_extracts", "U1", tables="tops dresses",
    sql="""SELECT id, style, top_color, NULL::VARCHAR AS dress_color FROM tops
    UNION ALL SELECT id, style, NULL, dress_color FROM dresses""",
)
def stacked_extracts(spark, sf):
    """Two extracts below each other; a column one of them lacks is null."""
    return sets.stack_rows(
        derived(spark, sf, "tops").select("id", "style", "top_color"),
        derived(spark, sf, "dresses").select("id", "style", "dress_color"),
    )


@query(
    "column_concat", "U4 F22", tables="tops",
    sql="SELECT id, top_color || '_' || bottom_color AS color_pair, top_fit || '_' || bottom_fit AS fit_pair FROM tops",
)
def column_concat(spark, sf):
    """Derived columns set beside the table without a join."""
    return add_pairs(derived(spark, sf, "tops")).select("id", "color_pair", "fit_pair")


@query(
    "tidy_headers", "S4", tables="seasons",
    sql="SELECT item_id, CAST(spring AS BIGINT) AS spring, CAST(winter AS BIGINT) AS winter FROM seasons",
)
def tidy_headers(spark, sf):
    """Untidy header names are trimmed and found in any case."""
    messy = seasons(spark, sf).toDF("\ufeffItem_ID ", " Spring", "SUMMER", "Fall ", " wInter ")
    clean = tidy_header(messy)
    names = {n: column_named(clean, n) for n in ("item_id", "spring", "winter")}
    return clean.select(
        F.col(names["item_id"]).alias("item_id"), *[F.col(names[n]).cast("bigint").alias(n) for n in ("spring", "winter")]
    )


def _item_batch(stored):
    """Three versions of every third item; those with odd ids are new."""
    key = F.col("item_id")
    return stored.filter(key % 3 == 0).withColumn("s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        (key + F.when(key % 2 == 0, F.lit(0)).otherwise(F.lit(5000000))).alias("item_id"),
        F.concat("name", F.lit("!"), F.col("s").cast("string")).alias("name"), "brand", (key * 10 + F.col("s")).alias("seq"),
    )


@query(
    "keyed_upsert", "S8", tables="items",
    sql="""
    WITH batch AS (SELECT item_id + CASE WHEN item_id % 2 = 0 THEN 0 ELSE 5000000 END AS item_id, name || '!' || s AS name, brand,
                          item_id * 10 + s AS seq
                   FROM items CROSS JOIN (SELECT unnest([1, 2, 3]) AS s) WHERE item_id % 3 = 0),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1)
    SELECT item_id, name, brand FROM last
    UNION ALL SELECT item_id, name, brand FROM items WHERE item_id NOT IN (SELECT item_id FROM last)""",
)
def keyed_upsert(spark, sf):
    """Stored rows replaced by the last batch row of their key, new keys added."""
    stored = derived(spark, sf, "items").select("item_id", "name", "brand")
    return maintenance.upsert(stored, _item_batch(stored), ["item_id"], "seq")


@query(
    "stored_upsert", "S8", tables="items",
    sql="""
    WITH batch AS (SELECT item_id + CASE WHEN item_id % 2 = 0 THEN 0 ELSE 5000000 END AS item_id, name || '!' || s AS name, brand,
                          item_id * 10 + s AS seq
                   FROM items CROSS JOIN (SELECT unnest([1, 2, 3]) AS s) WHERE item_id % 3 = 0),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1)
    SELECT item_id, name, brand FROM last
    UNION ALL SELECT item_id, name, brand FROM items WHERE item_id NOT IN (SELECT item_id FROM last)""",
)
def stored_upsert(spark, sf):
    """The same batch applied to a stored table, of which it rewrites the buckets of its keys."""
    stored = derived(spark, sf, "items").select("item_id", "name", "brand")
    held = StoredTable.create(stored, scratch_path(spark, "stored-items"), ["item_id"], 16)
    held.upsert(_item_batch(stored), "seq")
    return held.rows()


@query(
    "stored_user_rows", "S10", tables="rating_log",
    sql="""
    WITH fresh AS (SELECT user_id, item_id, rate + 1000 AS rate FROM rating_log WHERE rate > 98)
    SELECT * FROM fresh UNION ALL SELECT * FROM rating_log WHERE user_id NOT IN (SELECT user_id FROM fresh)""",
)
def stored_user_rows(spark, sf):
    """A stored rating table in buckets by user, in which the rows of some users are replaced."""
    log = rating_log(spark, sf)
    held = StoredTable.create(log, scratch_path(spark, "stored-ratings"), ["user_id"], 16)
    held.replace_groups(log.filter("rate > 98").withColumn("rate", F.col("rate") + 1000))
    return held.rows()


@query(
    "stored_parents", "S12", tables="items accord_colours",
    sql="""SELECT accord FROM accord_colours WHERE accord <> 'rose' UNION
    SELECT trim(a) FROM (SELECT unnest([accord1, accord2, accord3]) AS a FROM items) WHERE a IS NOT NULL AND trim(a) <> ''""",
)
def stored_parents(spark, sf):
    """A stored colour table without one accord, to which the items' missing accords are appended."""
    known = accord_colours(spark).select("accord").filter("accord <> 'rose'")
    held = StoredTable.create(known, scratch_path(spark, "stored-accords"), ["accord"], 8)
    held.add_parents(derived(spark, sf, "items"), ["accord1", "accord2", "accord3"], {})
    return held.rows()


@query(
    "load_report", "S9", tables="number_texts",
    sql="""
    WITH n AS (SELECT id, text, CAST(trunc(CASE WHEN regexp_matches(trim(replace(text, ',', '')), '^[+-]?[0-9]+[.]?[0-9]*$')
               THEN CAST(trim(replace(text, ',', '')) AS DOUBLE) END) AS BIGINT) AS k FROM number_texts)
    SELECT count(*) AS n_read, count(*) FILTER (WHERE k IS NOT NULL AND text IS NOT NULL AND text <> '') AS n_ok,
      count(*) FILTER (WHERE text IS NULL OR text = '') AS n_skipped,
      count(*) FILTER (WHERE k IS NULL AND text IS NOT NULL AND text <> '') AS n_failed,
      count(DISTINCT k) AS n_keys FROM n""",
)
def load_report(spark, sf):
    """Rows read, loaded, skipped and failed, and distinct keys."""
    rows = derived(spark, sf, "number_texts").withColumn("k", thousands_id(F.col("text")))
    blank = F.col("text").isNull() | (F.col("text") == "")
    return maintenance.load_report(rows, "k", F.col("k").isNotNull(), blank)


@query(
    "observed_load", "S9", tables="number_texts",
    sql="""
    WITH n AS (SELECT id, text, CAST(trunc(CASE WHEN regexp_matches(trim(replace(text, ',', '')), '^[+-]?[0-9]+[.]?[0-9]*$')
               THEN CAST(trim(replace(text, ',', '')) AS DOUBLE) END) AS BIGINT) AS k FROM number_texts)
    SELECT count(*) AS n_read, count(*) FILTER (WHERE k IS NOT NULL AND text IS NOT NULL AND text <> '') AS n_ok,
      count(*) FILTER (WHERE text IS NULL OR text = '') AS n_skipped,
      count(*) FILTER (WHERE k IS NULL AND text IS NOT NULL AND text <> '') AS n_failed,
      count(DISTINCT k) AS n_keys FROM n""",
)
def observed_load(spark, sf):
    """The same report from the job that writes the rows."""
    rows = derived(spark, sf, "number_texts").withColumn("k", thousands_id(F.col("text")))
    blank = F.col("text").isNull() | (F.col("text") == "")
    return maintenance.load_observed(rows, "k", F.col("k").isNotNull(), scratch_path(spark, "loaded"), blank)


@query(
    "replaced_user_rows", "S10", tables="rating_log",
    sql="""
    WITH fresh AS (SELECT user_id, item_id, rate + 1000 AS rate FROM rating_log WHERE rate > 98)
    SELECT * FROM fresh UNION ALL SELECT * FROM rating_log WHERE user_id NOT IN (SELECT user_id FROM fresh)""",
)
def replaced_user_rows(spark, sf):
    """All stored rows of the users in the new set are replaced by it."""
    stored = rating_log(spark, sf)
    fresh = stored.filter(F.col("rate") > 98).withColumn("rate", F.col("rate") + 1000)
    return maintenance.replace_groups(stored, fresh, "user_id")


@query(
    "next_weight_row", "S11 A15",
    sql="""SELECT max(s_suppkey) + 1 AS weight_id, CAST(0.5 AS DOUBLE) AS style_weight, CAST(0.3 AS DOUBLE) AS color_weight,
    CAST(0.2 AS DOUBLE) AS season_weight FROM supplier""",
)
def next_weight_row(spark, sf):
    """The row an append adds to the weight history."""
    values = {"style_weight": 0.5, "color_weight": 0.3, "season_weight": 0.2}
    return maintenance.append_version(weight_history(spark, sf), values)


@query(
    "appended_weight_version", "S11 A15",
    sql="""SELECT s_suppkey AS weight_id, CAST(1 + s_suppkey % 3 AS DOUBLE) / 6 AS style_weight,
    CAST(1 + s_suppkey % 2 AS DOUBLE) / 6 AS color_weight, CAST(1 AS DOUBLE) / 6 AS season_weight FROM supplier
    UNION ALL SELECT max(s_suppkey) + 1, CAST(0.5 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.2 AS DOUBLE) FROM supplier""",
)
def appended_weight_version(spark, sf):
    """The weight history as a stored table, after a version was appended to it and the table was read again."""
    path = scratch_path(spark, "weights")
    weight_history(spark, sf).write.parquet(path)
    values = {"style_weight": 0.5, "color_weight": 0.3, "season_weight": 0.2}
    maintenance.append_version(spark.read.parquet(path), values).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    "missing_parents", "S12 F19", tables="items accord_colours",
    sql="""
    WITH d AS (SELECT * FROM accord_colours WHERE accord NOT IN ('iris', 'woody', 'sweet')),
    seen AS (SELECT accord1 AS a FROM items UNION SELECT accord2 FROM items UNION SELECT accord3 FROM items)
    SELECT accord, color FROM d UNION ALL SELECT a, '#CCCCCC' FROM seen WHERE a IS NOT NULL AND a NOT IN (SELECT accord FROM d)""",
)
def missing_parents(spark, sf):
    """Accords used by items but absent from the colour table get a default row."""
    known = vocab.literal_table(spark, "accord, color", ACCORD_COLOURS.items())
    known = known.filter(~F.col("accord").isin("iris", "woody", "sweet"))
    return maintenance.add_missing_parents(
        known, "accord", derived(spark, sf, "items"), ["accord1", "accord2", "accord3"], {"color": vocab.DEFAULT_ACCORD_COLOUR}
    )


@query(
    "profile_sizes", "J10", tables="users clothes_rgb", extra=PEOPLE,
    sql="""
    SELECT user_style AS style, skey AS season, round(c0, 6) AS red, count(*) AS n_users
    FROM people GROUP BY ALL""",
)
def profile_sizes(spark, sf):
    """How many users share style, season and outfit colour: what replaces user x item pairing."""
    profiled = score.user_profiles(derived(spark, sf, "users"), clothes_colours(spark))
    return profiled.groupBy("style", "season", F.round("c0", 6).alias("red")).agg(F.count(F.lit(1)).alias("n_users"))
