import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylematch.operators import aggregates, encode, filters, joins, ordered, ranking, sets
from stylematch.sources import tables


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_brand_allow_list(spark):
    df = spark.createDataFrame([(1, "Jo-Malone-London"), (2, "JOMALONELONDON perfumes"), (3, None), (4, "Zara")], "id int, brand string")
    assert pairs(filters.brand_allow_list(df, "brand", ["jomalonelondon"]), "id") == [(1,), (2,)]


def test_exclusions_keep_nulls(spark):
    df = spark.createDataFrame([(1, "A Limited-Edition"), (2, None), (3, "b")], "id int, name string")
    assert pairs(filters.exclude_term(df, "name", "limited-edition"), "id") == [(2,), (3,)]
    assert pairs(filters.exclude_value(df, "name", "b"), "id") == [(1,), (2,)]


def test_empty_collections_and_shapes(spark):
    df = spark.createDataFrame(
        [(1, [("x",)], [("y",)], []), (2, [], [(None,)], [("d",)]), (3, [("x",)], [], [(None,)]), (4, [("x",)], [("y",)], [("d",)])],
        "id int, top array<struct<a:string>>, bottom array<struct<a:string>>, dress array<struct<a:string>>",
    )
    clean = filters.empty_to_null(df, ["top", "bottom", "dress"])
    assert pairs(filters.one_outfit_shape(clean, "top", "bottom", "dress"), "id") == [(1,), (2,)]


def test_dislikes(spark):
    df = spark.createDataFrame(
        [(1, ["woody", None], ["rose"]), (2, ["woody", None], ["woody"]), (3, ["a", "b"], []), (4, [None, None], ["woody"])],
        "id int, accords array<string>, dislikes array<string>",
    )
    out = df.select("id", filters.disliked(F.col("accords"), F.col("dislikes")).alias("d"))
    assert pairs(out, "id", "d") == [(1, False), (2, True), (3, False), (4, False)]


def test_search_blank_query_is_empty(spark):
    df = spark.createDataFrame([(1, "a", "b")], "item_id int, name string, brand string")
    assert filters.search_items(df, "  ").count() == 0
    assert filters.search_items(df, " - ").count() == 0


def reference_dedup(rows, columns, threshold):
    out, before = [], None
    for row in rows:
        equal = sum(before is not None and row[c] == before[c] for c in columns)
        if before is None or equal / len(columns) < threshold:
            out.append(row["seq"])
        before = row
    return out


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_similar_rows_compare_with_raw_neighbour(spark, ranges):
    random.seed(3)
    columns = [f"c{i}" for i in range(10)]
    rows = [{"seq": s * 7, **{c: random.choice(["a", "a", "a", None]) for c in columns}} for s in range(200)]
    # exactly 0.7 equal, and a chain in which every row is like the one before
    rows += [{"seq": 2000 + j, **{c: ("z" if i < 7 else f"{j}{c}") for i, c in enumerate(columns)}} for j in range(5)]
    schema = "seq long, " + ", ".join(f"{c} string" for c in columns)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(4)
    got = [r[0] for r in ordered.drop_similar(df, columns, "seq", 0.7, ranges).select("seq").orderBy("seq").collect()]
    assert got == reference_dedup(rows, columns, 0.7)
    assert 2000 in got and 2004 not in got


@pytest.mark.parametrize("ranges", [1, 4, 30])
def test_repeated_keys(spark, ranges):
    data = [(1, "p", "s"), (2, "P ", "s"), (3, "p", None), (4, "p", None), (5, "q", "s"), (6, "q", "s"), (7, "p", "s")]
    df = spark.createDataFrame(data, "seq long, p string, s string")
    keys = [F.lower(F.trim("p")), F.col("s")]
    assert pairs(ordered.drop_repeated_key(df, keys, "seq", ranges), "seq") == [(1,), (3,), (4,), (5,), (7,)]


@pytest.mark.parametrize("ranges", [1, 8, 64])
def test_dense_positions(spark, ranges):
    keys = random.Random(1).sample(range(10**6), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = dict(pairs(ordered.with_position(df, "k", "pos", ranges), "k", "pos"))
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_ordered_operators_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "seq long, c string")
    assert ordered.drop_similar(empty, ["c"], "seq").count() == 0
    assert ordered.with_position(empty, "seq").count() == 0


def test_first_rows_and_groups(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3), (4, "c", 4)], "seq int, k string, v int")
    assert pairs(ordered.first_rows(df, "k", "seq", 2), "k", "v") == [("a", 2), ("b", 3)]
    assert pairs(ordered.first_of_group(df, "k", ["v"], "seq"), "seq", "v") == [(1, 2), (2, 3), (3, 2), (4, 4)]


def reference_fixpoint(rows, threshold):
    while True:
        counts = {}
        for row in rows:
            for v in row[1:]:
                counts[v] = counts.get(v, 0) + 1
        rare = {v for v, n in counts.items() if n < threshold}
        if not rare:
            return sorted(r[0] for r in rows)
        rows = [r for r in rows if not rare & set(r[1:])]


def test_rare_fixpoint_matches_rounds(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdefgh"), rng.choice("abcxyz"), rng.choice("mnop")) for i in range(120)]
    # 'r' is rare only after the row with 'q' is gone
    rows += [(900, "q", "r", "m"), (901, "r", "a", "m"), (902, "r", "a", "n")]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    for threshold in (2, 3, 12, 20, 25):
        got = [r[0] for r in pairs(aggregates.drop_rare(df, ["a", "b", "c"], threshold), "id")]
        assert got == reference_fixpoint(rows, threshold)


def test_masking_keeps_rows(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "b", "a"), (4, None, "a")], "id int, x string, y string")
    out = aggregates.mask_rare(df, ["x", "y"], 2)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "a", "b"), (2, "a", "None"), (3, "b", "a"), (4, None, "a")]


def test_missing_accords_count_as_text(spark):
    df = spark.createDataFrame([(1, None), (2, " Rose ")], "id int, a string")
    assert pairs(aggregates.accord_text(df, ["a"]), "id", "a") == [(1, "nan"), (2, "rose")]


def test_group_modes(spark):
    df = spark.createDataFrame(
        [("s", "b", None), ("s", "a", None), ("s", None, None), ("t", "z", "k"), ("t", "z", None), ("t", "a", "k")], "g string, x string, y string"
    )
    modes = aggregates.group_modes(df, "g", ["x", "y"])
    assert [tuple(r) for r in modes.orderBy("g").collect()] == [("s", "a", None), ("t", "z", "k")]
    filled = aggregates.fill_modes(df, "g", ["x", "y"], modes)
    assert filled.filter("x IS NULL").count() == 0 and filled.filter("y IS NULL").count() == 3


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0), (None, 1.0, 5.0)], "x double, y double, z double")
    row = aggregates.correlations(df, ["y", "z"], "x").first()
    assert row["corr_y"] == pytest.approx(np.corrcoef([1.0, 2.0, 3.0], [2.0, 4.1, 5.9])[0, 1]) and row["corr_z"] is None


def test_class_weights_and_next_id(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "y string")
    assert pairs(aggregates.class_weights(df, "y"), "y", "weight", "soft_weight") == [("a", 1.0, 1.0), ("b", 4.0, 2.0)]
    assert aggregates.next_id(spark.createDataFrame([], "k long"), "k").first()[0] == 1


def test_newest_and_arg_max(spark):
    df = spark.createDataFrame([(1, 5.0), (3, 7.0), (2, 7.0)], "seq int, m double")
    assert tuple(aggregates.newest_row(df, "seq").first()) == (3, 7.0)
    assert tuple(ranking.arg_max(df, "m", "seq").first()) == (2, 7.0)
    assert aggregates.newest_row(df.limit(0), "seq").count() == 0


def test_scaling_constant_column(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 4.0, 3.0), (2, 9.0, 1.0)], "g int, x double, y double")
    assert pairs(ranking.scale_by_group(df, "g", ["x", "y"]), "g", "x", "y") == [(1, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 0.0)]


def test_rank_points_average_ties(spark):
    df = spark.createDataFrame([("s", "a", 0.0), ("s", "b", 0.0), ("s", "c", 5.0)], "style string, family string, score double")
    assert pairs(ranking.rank_points(df), "family", "points") == [("a", 1.5), ("b", 1.5), ("c", 3.0)]


def test_samples_are_padded(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, item int")
    out = {r["g"]: r["picks"] for r in ranking.sample_padded(df, ["g"], "item").collect()}
    assert len(out["a"]) == 4 and len(set(out["a"])) == 4 and None not in out["a"]
    assert out["b"] == [1, None, None, None]


def test_weight_grid(spark):
    rows = sets.weight_grid(spark).orderBy("seq").collect()
    assert len(rows) == 215 and rows[0]["w_season"] == 1.0
    assert all(abs(r["w_style"] + r["w_color"] + r["w_season"] - 1) < 1e-12 for r in rows)
    assert len({(r["w_style"], r["w_color"], r["w_season"]) for r in rows}) == 175


def test_upsert_last_row_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, seq int")
    once = tables.upsert(old, new, ["k"], "seq")
    assert pairs(once, "k", "v") == [(1, "a"), (2, "y"), (3, "z")]
    assert pairs(tables.upsert(once, new, ["k"], "seq"), "k", "v") == pairs(once, "k", "v")


def test_replace_and_parents(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "u int, v string")
    new = spark.createDataFrame([(1, "z")], "u int, v string")
    assert pairs(tables.replace_groups(old, new, "u"), "u", "v") == [(1, "z"), (2, "c")]
    dim = spark.createDataFrame([("rose", "rgb(1)")], "accord string, color string")
    facts = spark.createDataFrame([("rose", " oud "), (None, ""), ("oud", "iris")], "a string, b string")
    out = tables.add_missing_parents(dim, "accord", facts, ["a", "b"], {"color": "#CCCCCC"})
    assert pairs(out, "accord", "color") == [("iris", "#CCCCCC"), ("oud", "#CCCCCC"), ("rose", "rgb(1)")]


def test_agreement_null_is_no_match(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "k int, f string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z"), (4, "q")], "k int, g string")
    assert tuple(joins.agreement(a, b, "k", "f", "g").first()) == (3, 1, pytest.approx(1 / 3))


@pytest.mark.parametrize("hot_rows", [0, 400])
def test_salted_join_equals_plain_join(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(joins, "SALT_ROWS", 50)
    rng = random.Random(2)
    big = [(i, rng.randrange(300)) for i in range(600)] + [(1000 + i, 7) for i in range(hot_rows)]
    left = spark.createDataFrame(big, "id int, k int")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 300, 2)] + [(7, 70)], "k int, v int")
    assert pairs(joins.salted_join(left, right, "k", "id"), "id", "k", "v") == pairs(left.join(right, "k"), "id", "k", "v")


def test_fanned_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, i % 4) for i in range(100)], "id int, k int")
    right = spark.createDataFrame([(j % 4, j) for j in range(40)], "k int, v int")
    want = pairs(left.join(right, "k"), "id", "v")
    assert pairs(joins.fanned_join(left, right, "k", "id"), "id", "v") == want
    assert pairs(joins.fanned_join(left, right, "k", "id", fan=6), "id", "v") == want


def test_spread_join_keeps_key_types(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id int, k double")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k long, v string")
    got = {r["id"]: (r["k"], r["v"]) for r in joins.outer_join_spread(left, right, "k", "id").collect()}
    assert got == {1: (1.0, "a"), 2: (2.0, None), 3: (None, None)}


def test_rank_in_group_matches_sorting(spark):
    rng = random.Random(11)
    data = sorted({(rng.choice("abc"), f"v{rng.randrange(500)}") for _ in range(400)}) + [("d", None)]
    got = {(r["g"], r["v"]): r["code"] for r in ordered.rank_in_group(spark.createDataFrame(data, "g string, v string"), "g", "v", "code").collect()}
    want = {}
    for g in "abcd":
        want.update({(g, v): i for i, v in enumerate(sorted(v for h, v in data if h == g and v is not None))})
    assert got == {**want, ("d", None): 0}


def test_garments_need_their_choices(spark):
    dresses = spark.createDataFrame([(4, "red"), (2, "red"), (9, "blue")], "id int, dress_color string")
    chosen = spark.createDataFrame([(1, "red"), (2, None)], "user_id int, dress_color string")
    got = {r["user_id"]: r["m"] for r in joins.first_garment(chosen, dresses, "dress", "m").collect()}
    assert got == {1: 2, 2: None}
    with pytest.raises(ValueError, match="top_category"):
        joins.first_garment(spark.createDataFrame([("red",)], "top_color string"), dresses, "top", "m")


def test_soft_reference_and_first_match(spark):
    child = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(5,), (5,)], "pid int")
    assert sorted(map(str, pairs(joins.soft_reference(child, "ref", parent, "pid", "id").fillna(-1), "id", "ref"))) == ["(1, 5)", "(2, -1)", "(3, -1)"]
    table = spark.createDataFrame([(8, "a"), (3, "a"), (4, "b")], "gid int, c string")
    choices = spark.createDataFrame([(1, "a"), (2, "q")], "id int, c string")
    assert {r["id"]: r["m"] for r in joins.first_match(choices, table, ["c"], "gid", "m").collect()} == {1: 3, 2: None}


def test_split_is_exact_per_class_even_when_one_class_dominates(spark):
    data = [(i, "big") for i in range(1000)] + [(2000 + i, "small") for i in range(10)] + [(3000, "one")]
    df = spark.createDataFrame(data, "id int, y string")
    split = encode.stratified_split(df, "y", "id", 0.2, cell_rows=60)
    sizes = {r["y"]: (r["n"], r["t"]) for r in split.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sizes == {"big": (1000, 200), "small": (10, 2), "one": (1, 0)}


def test_oversampling_counts(spark):
    df = spark.createDataFrame([(i, "a") for i in range(7)] + [(100 + i, "b") for i in range(30)] + [(200, "c")], "id int, y string")
    out = encode.oversample(df, "y", {"a": 20, "b": 20}, "id")
    counts = {r["y"]: (r["n"], r["d"]) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()}
    assert counts == {"a": (20, 7), "b": (30, 30), "c": (1, 1)}


def test_draws_with_replacement(spark, monkeypatch):
    monkeypatch.setattr(encode, "DRAWS", 7)
    data = [(i, "a") for i in range(7)] + [(100 + i, "b") for i in range(30)] + [(200, "c"), (300, None), (301, "one")]
    df = spark.createDataFrame(data, "id int, y string")
    out = encode.oversample_drawn(df, "y", {"a": 40, "b": 20, "one": 25, "absent": 9}, "id").groupBy("y", "id").agg(F.count("*").alias("n")).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r["y"], []).append(r["n"])
    assert {y: (sum(n), len(n)) for y, n in sizes.items()} == {"a": (40, 7), "b": (30, 30), "c": (1, 1), None: (1, 1), "one": (25, 1)}
    assert len(set(sizes["a"])) > 1
    again = encode.oversample_drawn(df.repartition(3), "y", {"a": 40, "b": 20, "one": 25}, "id").groupBy("y", "id").agg(F.count("*").alias("n")).collect()
    assert set(again) == set(out)
    assert encode.oversample_drawn(df.limit(0), "y", {"a": 4}, "id").count() == 0


def test_ordinal_codes_unknown_is_minus_one(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, x string")
    coded = encode.ordinal_encode(test, ["x"], encode.ordinal_codes(train, ["x"]))
    assert pairs(coded, "id", "x") == [(1, 0), (2, 1), (3, -1), (4, -1)]


def test_overlap_deals_the_rows_before_it_makes_them_distinct(spark):
    a = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5), (3, None), (None, 7)], "u long, i long")
    b = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (3, None), (4, 1), (None, 7)], "u long, i long")
    found = aggregates.overlap_sizes(a.coalesce(1), b.coalesce(1), "u", "i")
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2, 1), (2, 1, 0, 0), (3, 1, 1, 0), (None, 1, 0, 0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
