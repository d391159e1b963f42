import math

import pytest
from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.functions import colour, numbers, season, text


@pytest.mark.parametrize("raw, loose, strict, fault", [
    ("rgb(1, 2, 3);", [1, 2, 3], [1, 2, 3], None),
    ("(1, 2, 3)", [1, 2, 3], [1, 2, 3], None),
    ("#0A0B0C", [0, 0, 0], [10, 11, 12], None),
    ("#FFF", None, None, "bad hex"),
    ("", None, None, "missing"),
    (None, None, None, "missing"),
    ("12, 13", None, None, "unsupported"),
    ("rgb(1, 2, 3, 4)", [1, 2, 3], [1, 2, 3], None),
])
def test_colour_parsers(value, raw, loose, strict, fault):
    lit = F.lit(raw).cast("string")
    assert value(lambda: colour.rgb(lit)) == loose
    assert value(lambda: colour.rgb_or_hex(lit)) == strict
    assert value(lambda: colour.rgb_fault(lit)) == fault
    assert value(lambda: colour.rgb_or_white(lit)) == (loose or [255, 255, 255])


def test_mix_and_similarity(spark):
    rows = spark.createDataFrame(
        [([10, 20, 30], [40, 50, 60], [70, 80, 90], None), ([10, 20, 30], None, [70, 80, 90], [1, 2, 3])],
        "a array<int>, b array<int>, c array<int>, d array<int>",
    )
    out = rows.select(
        colour.mix_accords(F.col("a"), F.col("b"), F.col("c")).alias("m"),
        colour.outfit_colour(F.col("d"), F.col("a"), F.col("c")).alias("o"),
    ).collect()
    assert out[0]["m"] == pytest.approx([10 * 0.6 + 40 * 0.3 + 70 * 0.1, 20 * 0.6 + 50 * 0.3 + 80 * 0.1, 30 * 0.6 + 60 * 0.3 + 90 * 0.1])
    assert out[0]["o"] == pytest.approx([10 * 0.7 + 70 * 0.3, 20 * 0.7 + 80 * 0.3, 30 * 0.7 + 90 * 0.3])
    assert out[1]["m"] is None and out[1]["o"] == [1.0, 2.0, 3.0]


def test_similarity_bounds(value):
    def score(a, b):
        return value(lambda: colour.similarity([F.lit(float(x)) for x in a], [F.lit(float(x)) for x in b]))

    assert score((0, 0, 0), (0, 0, 0)) == 100.0
    assert score((0, 0, 0), (255, 255, 255)) == pytest.approx(0.0, abs=1e-9)
    assert score((10, 0, 0), (13, 4, 0)) == pytest.approx(100 * (1 - 5 / (255 * math.sqrt(3))))


@pytest.mark.parametrize("raw, decimal, whole, key", [
    ("3,9", 3.9, 3, 39), ("1,234", 1.234, 1, 1234), (" 7 ", 7.0, 7, 7), ("", 0.0, 0, None), ("x", 0.0, 0, None),
    (None, 0.0, 0, None), ("100026.0", 100026.0, 100026, 100026), ("-2,5", -2.5, -2, -25), ("1d", 0.0, 0, None),
    ("1,2,3", 0.0, 0, 123),
])
def test_number_parsers(value, raw, decimal, whole, key):
    lit = F.lit(raw).cast("string")
    assert value(lambda: numbers.decimal_comma(lit)) == decimal
    assert value(lambda: numbers.decimal_comma_int(lit)) == whole
    assert value(lambda: numbers.thousands_id(lit)) == key


@pytest.mark.parametrize("raw, parts", [
    (None, ["nan"]), ("['a', 'b ']", ["a", "b"]), ('["x", "y, z"]', ["x", "y, z"]), ("a, b,, ", ["a", "b"]),
    ("a|b", ["a", "b"]), ("a/b", ["a", "b"]), ("a;b", ["a", "b"]), ("a,b|c", ["a", "b|c"]), ("[]", []), ("one", ["one"]),
])
def test_any_list(value, raw, parts):
    assert value(lambda: text.any_list(F.lit(raw).cast("string"))) == parts


@pytest.mark.parametrize("raw, blanks, filled", [
    (None, [], []), ("", [], []), ("woody,lavender", ["woody", "lavender"], ["woody", "lavender"]),
    (" woody , lavender ", ["woody", "lavender"], ["woody", "lavender"]), ("woody,,", ["woody", "", ""], ["woody"]),
])
def test_trimmed_list(value, raw, blanks, filled):
    lit = F.lit(raw).cast("string")
    assert value(lambda: text.trimmed_list(lit)) == blanks
    assert value(lambda: text.trimmed_list(lit, keep_blank=False)) == filled


def test_season_shares(value):
    def share(*votes):
        cols = [F.lit(v).cast("double") for v in votes]
        return value(lambda: numbers.share(cols[0], *cols)), value(lambda: numbers.share_floor_one(cols[0], *cols))

    assert share(1, 1, 2, 0) == (25.0, 25.0)
    assert share(0, 0, 0, 0) == (0.0, 0.0)
    assert share(None, 1, 1, 1) == (0.0, None)


def test_best_columns_ties_in_order(value):
    cols = dict(zip(vocab.SEASONS, [F.lit(2.0), F.lit(5.0), F.lit(5.0), F.lit(None).cast("double")]))
    assert value(lambda: season.best_columns(cols, 1)) == "summer"
    assert value(lambda: season.best_columns(cols, 2)) == "summer, fall"
    none = {s: F.lit(None).cast("double") for s in vocab.SEASONS}
    assert value(lambda: season.best_columns(none, 1)) is None


def test_boxes(value):
    def box(*v):
        cols = [F.lit(x).cast("double") for x in v]
        out = numbers.clamp_box(*cols, F.lit(100), F.lit(80))
        return value(lambda: F.array(*[out[k].cast("int") for k in ("x1", "y1", "x2", "y2", "usable")]))

    assert box(-5.9, 3.2, 20.9, 10.0) == [0, 3, 20, 13, 1]
    assert box(90, 70, 50, 50) == [90, 70, 100, 80, 1]
    assert box(100, 0, 5, 5)[-1] == 0
    assert box(1, 1, 0.9, 5)[-1] == 0
    assert box(1, 1, None, 5)[-1] == 0


def test_letterbox(value):
    placed = numbers.letterbox(F.lit(30), F.lit(10), F.lit(64), F.lit(48))
    assert value(lambda: F.array(*[placed[k] for k in ("new_w", "new_h", "paste_x", "paste_y")])) == [64, 21, 0, 13]


def test_percent_encoding(value):
    assert value(lambda: text.percent_encode(F.lit("상 의/a~b*c.jpg"))) == "%EC%83%81%20%EC%9D%98/a~b%2Ac.jpg"


@pytest.mark.parametrize("name, number", [
    ("a_12_top.jpg", 12), ("a_12_top_x.WEBP", 12), ("a_12.jpg", None), ("a_x_top.jpg", None), ("a_1_top.gif", None),
])
def test_image_record(value, name, number):
    assert value(lambda: text.image_record(F.lit(name))) == number


def test_path_safe_and_pairs(value):
    assert value(lambda: text.path_safe(F.lit(" a/b "))) == "a_b"
    assert value(lambda: text.path_safe(F.lit(""))) == "unknown"
    assert value(lambda: text.path_safe(F.lit(None).cast("string"))) == "unknown"
    assert value(lambda: text.pair(F.lit("a"), F.lit(None).cast("string"))) is None
    assert value(lambda: text.pair(F.lit("a"), F.lit(None).cast("string"), "None")) == "a_None"


def test_half_even_rounding(value):
    assert value(lambda: numbers.rounded(F.lit(2.5), 0)) == 2.0
    assert value(lambda: numbers.rounded(F.lit(3.5), 0)) == 4.0


def test_tables_have_full_size():
    assert len(vocab.ACCORD_FAMILY) == 42 and len(vocab.STYLE_PERCENT) == 7
    assert all(len(v) == 7 for t in (vocab.STYLE_PERCENT, vocab.STYLE_POINTS) for v in t.values())
