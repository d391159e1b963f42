"""First allowed entries of ranked lists against plain loops, over several rounds."""

import random

import pytest
from pyspark.sql import functions as F

from stylematch.operators import exclusion


@pytest.mark.parametrize("k", [1, 4])
def test_rounds_refill_until_enough_or_the_end(spark, monkeypatch, k):
    monkeypatch.setattr(exclusion, "WINDOW", 2)
    monkeypatch.setattr(exclusion, "WIDEST", 8)
    rng = random.Random(k)
    lists = {key: [(pos, [rng.choice("abcdef") for _ in range(rng.randrange(3))]) for pos in range(1, size + 1)] for key, size in (("x", 60), ("y", 3), ("z", 17))}
    ranked = spark.createDataFrame([(key, pos, tags, (pos * 10,)) for key, own in lists.items() for pos, tags in own], "key string, pos int, tags array<string>, entry struct<v:int>")
    seekers = [(i, rng.choice(["x", "y", "z", "no list", None]), rng.sample("abcdef", rng.randrange(7))) for i in range(200)]
    rounds = []

    def rows(keys, last):
        rounds.append(last)
        out = ranked if keys is None else ranked.join(keys, "key", "left_semi")
        return out.filter(F.col("pos") <= last)

    frame = spark.createDataFrame(seekers, "id long, key string, dislikes array<string>")
    got = {r.id: [e["v"] for e in r.found] for r in exclusion.first_allowed(frame, {"found": exclusion.Ranking(["key"], rows, "struct<v:int>", k)}).collect()}
    assert got == {i: [p * 10 for p, tags in lists.get(key, []) if not set(tags) & set(d)][:k] for i, key, d in seekers}
    assert len(rounds) > 1


def test_two_lists_end_apart(spark):
    ranked = spark.createDataFrame([("x", 1, ["a"], (1,)), ("x", 2, ["b"], (2,))], "key string, pos int, tags array<string>, entry struct<v:int>")
    seekers = spark.createDataFrame([(1, "x", "q", ["a"]), (2, "x", "x", ["a", "b"])], "id long, key string, other string, dislikes array<string>")
    one = exclusion.Ranking(["key"], lambda keys, last: ranked.filter(F.col("pos") <= last), "struct<v:int>")
    two = exclusion.Ranking(["other"], lambda keys, last: ranked.withColumnRenamed("key", "other").filter(F.col("pos") <= last), "struct<v:int>", 2)
    got = {r.id: ([e["v"] for e in r.a], [e["v"] for e in r.b]) for r in exclusion.first_allowed(seekers, {"a": one, "b": two}).collect()}
    assert got == {1: ([2], []), 2: ([], [])}
