"""Streams that keep keyed state: repeated deliveries and sessions that end, over restarts."""

import datetime

import pytest
from pyspark.sql import functions as F

from stylematch.streaming import ratings

DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    folder, number = f"{tmp_path}/in", iter(range(100))

    def put(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={next(number)}")
        return ratings.file_stream(spark, f"{folder}/*", spark.createDataFrame([], schema), 1)

    return put


BASKET = "event_id long, ts timestamp, basket_id long, item_id long, rate long"


def test_a_basket_delivered_twice_is_logged_once(spark, tmp_path, feed):
    sink = f"{tmp_path}/log"

    def run(stream):
        ratings.start_log(ratings.once(stream, ["event_id"], "ts", "1 hour").drop("event_id", "ts"), sink).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(sink).select("basket_id", "item_id", "smelling_user_id").collect())

    first = [(1, at(0), 7, 1, 5), (2, at(1), 7, 2, 5), (3, at(2), 9, 1, 5)]
    want = [(7, 1, 1), (7, 2, 1), (9, 1, 2)]
    assert run(feed(first + first[:1], BASKET)) == want
    assert run(feed(first, BASKET)) == want
    assert run(feed([*first, (4, at(3), 11, 3, 5)], BASKET)) == [*want, (11, 3, 3)]
    got = run(feed([(5, at(4), 12, 3, 5)], BASKET))
    ids = {b: u for b, _, u in got}
    assert len(got) == 5 and len(set(ids.values())) == 4 and ids[12] == max(ids.values())


def test_keys_expire_with_the_event_time(spark, tmp_path, feed):
    sink = f"{tmp_path}/log"

    def run(stream):
        query = ratings.start_log(ratings.once(stream, ["event_id"], "ts", "1 hour").drop("event_id", "ts"), sink)
        query.awaitTermination()
        return [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]][-1]

    run(feed([(i, at(i), i, 1, 5) for i in range(50)], BASKET))
    assert run(feed([(1000, at(500), 1000, 1, 5)], BASKET)) == 1


ACTION = "ts timestamp, session_id long, item_id long, action string, rate long, event_id long"


def test_sessions_end_and_leave_the_state(spark, tmp_path, feed):
    sink = f"{tmp_path}/sessions"

    def run(rows):
        query = ratings.start_sessions(feed(rows, ACTION), sink)
        query.awaitTermination()
        open_ = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]][-1]
        return open_, sorted((r.session_id, r.item_id, r.rate) for r in spark.read.parquet(sink).collect())

    one = [(at(0), 1, 10, "add", 3, 1), (at(5), 1, 11, "add", 4, 2), (at(6), 2, 20, "add", 1, 3)]
    assert run(one) == (2, [])
    # after a restart: session 1 goes on and changes its mind, 2 has ended by the time of 3
    two = [(at(20), 1, 10, ratings.REMOVE, 0, 4), (at(21), 1, 11, "add", 9, 5), (at(46), 3, 30, "add", 1, 6)]
    assert run(two) == (2, [(2, 20, 1)])
    assert run([(at(200), 4, 40, "add", 1, 7)]) == (1, [(1, 11, 9), (2, 20, 1), (3, 30, 1)])


def test_logs_of_earlier_versions_go_on(spark, tmp_path, feed):
    """Batches that kept no number: the ids are read from the rows."""
    sink = f"{tmp_path}/log"
    plain = "basket_id long, item_id long, rate long"
    ratings.start_log(feed([(5, 1, 1), (6, 1, 1)], plain), sink).awaitTermination()
    import shutil

    shutil.rmtree(f"{sink}/_last")
    ratings.start_log(feed([(7, 1, 1)], plain), sink).awaitTermination()
    ratings.start_log(feed([(8, 1, 1)], plain), sink).awaitTermination()
    got = {r.basket_id: r.smelling_user_id for r in spark.read.parquet(sink).collect()}
    assert got == {5: 1, 6: 2, 7: 3, 8: 4}
    assert spark.read.parquet(sink).filter(F.col("smelling_user_id").isNull()).isEmpty()
