"""Stored tables: a batch rewrites the buckets of its keys and leaves all other files alone."""

import os

import pytest
from pyspark.sql import functions as F

from stylematch.sources.stored import BUCKET, StoredTable
from stylematch.sources.tables import load_observed


def files(path):
    return {os.path.join(os.path.basename(d), f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and BUCKET in d}


def of_bucket(names, buckets):
    return {f for f in names if f.split("/")[0] in {f"{BUCKET}={b}" for b in buckets}}


@pytest.fixture
def held(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(1000)], "id long, name string, x double")
    return StoredTable.create(rows, f"{tmp_path}/table", ["id"], 32)


def told(table):
    return sorted(tuple(r) for r in table.rows().collect())


def test_upsert_rewrites_only_its_buckets(spark, held):
    before = files(held.path)
    batch = spark.createDataFrame([(5, "old", 1.0, 1), (5, "new", 2.0, 2), (5000, "added", 3.0, 1)], "id int, name string, x double, seq int")
    touched = {r[0] for r in spark.createDataFrame([(5,), (5000,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(32))).collect()}
    assert held.upsert(batch, "seq") == len(touched) == 2
    assert told(held) == sorted([(i, f"n{i}", float(i)) for i in range(1000) if i != 5] + [(5, "new", 2.0), (5000, "added", 3.0)])
    after = files(held.path)
    assert before - of_bucket(before, touched) == after - of_bucket(after, touched)
    assert not of_bucket(before, touched) & of_bucket(after, touched)
    assert told(StoredTable(spark, held.path)) == told(held)


def test_empty_batch_changes_nothing(spark, held):
    before = files(held.path)
    assert held.upsert(spark.createDataFrame([], "id long, name string, x double, seq int"), "seq") == 0
    assert files(held.path) == before and len(told(held)) == 1000


def test_groups_are_replaced_and_moved_out_of_empty_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(g, i) for g in range(6) for i in range(5)], "g long, i int")
    table = StoredTable.create(rows, f"{tmp_path}/groups", ["g"], 4)
    assert table.replace_groups(spark.createDataFrame([(2, 90), (7, 91)], "g long, i int")) <= 2
    assert told(table) == sorted([(g, i) for g in range(6) if g != 2 for i in range(5)] + [(2, 90), (7, 91)])
    # a change that leaves nothing of a bucket leaves no file of it either
    table._rewrite(rows.filter("g = 3"), lambda held, batch: held.join(batch.select("g").distinct(), "g", "left_anti"))
    assert not [r for r in told(table) if r[0] == 3] and len([r for r in told(table) if r[0] == 1]) == 5


def test_parents_are_appended(spark, tmp_path):
    table = StoredTable.create(spark.createDataFrame([("a", "x"), ("b", "y")], "name string, kind string"), f"{tmp_path}/parents", ["name"], 4)
    before = files(table.path)
    facts = spark.createDataFrame([("a", " c "), ("d", None), ("", "c")], "one string, two string")
    assert table.add_parents(facts, ["one", "two"], {"kind": "?"}) == 2
    assert told(table) == [("a", "x"), ("b", "y"), ("c", "?"), ("d", "?")]
    assert before <= files(table.path)
    assert table.add_parents(facts, ["one", "two"], {"kind": "?"}) == 0


def test_layout_is_kept_and_paths_are_not_overwritten(spark, held):
    assert (StoredTable(spark, held.path).keys, StoredTable(spark, held.path).buckets) == (["id"], 32)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        StoredTable.create(held.rows(), held.path, ["id"])
    with pytest.raises(ValueError):
        StoredTable.create(held.rows().withColumn(BUCKET, F.lit(1)), held.path + "x", ["id"])


def test_load_is_reported_by_the_job_that_writes(spark, tmp_path):
    rows = [(1, "1"), (2, "x"), (3, None), (4, "4"), (5, ""), (6, "1")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3).withColumn("k", F.expr("try_cast(text AS INT)"))
    seen = spark.sparkContext.accumulator(0)

    def read(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    counted = df.mapInPandas(read, df.schema)
    report = load_observed(counted, "k", F.col("k").isNotNull(), f"{tmp_path}/loaded", F.col("text").isNull() | (F.col("text") == "")).first()
    assert report.asDict() == {"n_read": 6, "n_ok": 3, "n_skipped": 2, "n_failed": 1, "n_keys": 2}
    assert seen.value == 6
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/loaded").collect()) == [1, 4, 6]
    empty = load_observed(df.limit(0), "k", F.col("k").isNotNull(), f"{tmp_path}/none").first()
    assert tuple(empty) == (0, 0, 0, 0, 0)
