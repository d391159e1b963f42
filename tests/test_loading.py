from decimal import Decimal

from stylematch.plans import catalogue, loading


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_items_header_case_and_year(spark):
    raw = spark.createDataFrame(
        [("7", " N ", "B", "3,9", "1,234", "0", " Rose ", None), ("", "x", "B", "1", "1", "1", "a", "b"), ("8", "M", None, "x", None, "1999", " ", "oud")],
        "perfume_id string, Perfume string, BRAND string, RatingValue string, rating_count string, YEAR string, MainAccord1 string, mainaccord2 string",
    )
    got = rows(catalogue.load_items(raw), "item_id", "name", "rating_value", "rating_count", "year", "accord1", "accord2")
    assert got == [(7, "N", 3.9, 1, None, "Rose", None), (8, "M", 0.0, 0, 1999, None, "oud")]


def test_children_of_unknown_items_are_skipped(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    raw = spark.createDataFrame([("1", "3,5", "1", "", None), ("9", "1", "1", "1", "1"), (None, "1", "1", "1", "1")],
                                "perfume_id string, Spring string, SUMMER string, fall string, winter string")
    kept, skipped = loading.load_seasons(raw, items)
    assert rows(kept, "item_id", "spring", "summer", "fall", "winter") == [(1, 3.5, 1.0, 0.0, 0.0)]
    assert rows(skipped, "item_id") == [(9,)]
    families = spark.createDataFrame([("2", " woody "), ("5", "x")], "perfume_id string, Fragrance string")
    kept, skipped = loading.load_families(families, items)
    assert rows(kept, "item_id", "family") == [(2, "woody")] and skipped.count() == 1


def test_users_keep_rows_with_unknown_garments(spark):
    tops = loading.load_top_bottom(spark.createDataFrame([("487,069", "스포티", "레드"), ("", "x", "y")], "`식별자` string, `스타일` string, `상의_색상` string"))
    assert rows(tops, "id", "style", "top_color", "bottom_fit") == [(487069, "스포티", "레드", None)]
    dresses = loading.load_dresses(spark.createDataFrame([("5", "핑크")], "`식별자` string, `원피스_색상` string"))
    raw = spark.createDataFrame(
        [("1", "487069.0", "3", "", "가을 ", "woody,lavender"), ("2", None, None, "5", "여름", " "), ("0", None, None, None, None, None), ("x", None, None, None, None, None)],
        "`사용자_식별자` string, `상의_식별자` string, `하의_식별자` string, `원피스_식별자` string, `계절` string, `비선호_향조` string",
    )
    got = rows(loading.load_users(raw, tops, dresses), "user_id", "top_id", "bottom_id", "dress_id", "season", "disliked_accord")
    assert got == [(1, 487069, None, None, "가을", "woody,lavender"), (2, None, None, 5, "여름", None)]


def test_scores_have_six_decimals(spark):
    raw = spark.createDataFrame([("3", "1", "0.1234567", "x", "", "1e-3")], "perfume_id string, user_id string, color_score string, season_score string, style_score string, myscore string")
    row = loading.load_scores(raw).first()
    assert (row["user_id"], row["item_id"], row["season_score"], row["style_score"]) == (1, 3, None, None)
    assert row["color_score"] == Decimal("0.123457") and row["myscore"] == Decimal("0.001000")


def test_colours_and_seed_weights(spark):
    accords = spark.createDataFrame([(" rose ", "(1, 2, 3)"), ("oud", "rgb(4, 5, 6);"), ("iris", None), ("", "x")], "`Main mainaccord` string, Color string")
    assert rows(loading.load_accord_colours(accords), "accord", "color") == [("iris", "#CCCCCC"), ("oud", "rgb(4, 5, 6);"), ("rose", "rgb(1, 2, 3)")]
    clothes = spark.createDataFrame([("레드", " (255, 0, 0) "), ("네온", ""), (None, "x")], "color string, rgb_tuple string")
    assert rows(loading.load_clothes_colours(clothes), "color", "rgb_tuple") == [("네온", "(204, 204, 204)"), ("레드", "(255, 0, 0)")]
    assert tuple(loading.first_weights(spark).first()) == (1, 1.0, 1.0, 1.0)
