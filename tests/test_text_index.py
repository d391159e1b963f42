"""Search by trigram postings against the scan."""

import random

import pytest

from stylematch.operators import filters
from stylematch.sources.text_index import TextIndex, grams_of

FIELDS = ["name", "brand"]


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(5)
    words = ["Red Wood", "rose", "ROSE-water", "über", "musk😀moss", "a", "ab", "", None, "장미 향수", "wood red", "redwood"]
    rows = [(i, rng.choice(words) and f"{rng.choice(words)} {rng.choice(words)}", rng.choice(words)) for i in range(400)]
    return spark.createDataFrame(rows + [(1000 + i, "the common name", "the common brand") for i in range(1200)], "item_id long, name string, brand string")


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    return TextIndex.create(items, str(tmp_path_factory.mktemp("index") / "items"), "item_id", FIELDS, 8)


def ids(df):
    return [r["item_id"] for r in df.collect()]


@pytest.mark.parametrize("query", ["red wood", "Red-Wood", " ROSE ", "rose-W", "über", "k😀m", "장미 향", "ab", "a", "-", "", "nothing of it", "COMMON", "%", "red_"])
def test_search_finds_what_the_scan_finds(items, index, query):
    assert ids(index.search_items(items, query, 5000)) == ids(filters.search_items(items, query, limit=5000))
    assert ids(index.search_terms(items, query, FIELDS)) == ids(filters.search_terms(items, query, FIELDS))


@pytest.mark.parametrize("query", ["red a", "rose, wood", "common rose", "moss ab", "brand name"])
def test_every_term_is_asked_for(items, index, query):
    assert ids(index.search_terms(items, query, FIELDS)) == ids(filters.search_terms(items, query, FIELDS))


def test_candidates_are_few(items, index):
    assert index.candidates(["red wood"]).count() < 400 and index.candidates(["a"]) is None
    assert index.candidates(["zzz"]).count() == 0
    assert grams_of("RoSe") == {"ros", "ose"} and grams_of("ab") == set()
    with pytest.raises(ValueError):
        index.search_terms(items, "rose", ["notes"])


def test_only_buckets_of_the_terms_are_opened(index):
    plan = index._read("postings", {"ros"})._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "gram" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_an_empty_table(spark, items, tmp_path):
    empty = items.limit(0)
    index = TextIndex.create(empty, str(tmp_path / "none"), "item_id", FIELDS)
    assert ids(index.search_items(empty, "rose")) == [] and ids(index.search_terms(empty, "rose", FIELDS)) == []
