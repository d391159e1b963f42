"""Streaming queries: the stream reads a given table to its end, the result is the table its sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch.session import scratch_path
from stylematch.streaming import ratings
from stylematch.workload.registry import query
from stylematch.workload.evaluation import best_grid, grid_all_sql
from stylematch.workload.scoring import BASE
from stylematch.workload.tables import DERIVED, table

_LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, item_id ORDER BY event_id DESC) AS rn
    FROM (SELECT session_id, item_id, CASE WHEN action = 'error' THEN 'delete' ELSE 'add' END AS action, rate, event_id FROM actions))
    WHERE rn = 1 AND action <> 'delete')"""


def _actions(events):
    cols = DERIVED["actions"][1]
    rows = events.selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
    removed = F.col("action") == "error"
    return rows.withColumn("action", F.when(removed, F.lit(ratings.REMOVE)).otherwise(F.lit("add")))


def _event_stream(spark, sf):
    return ratings.file_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events"))


@query("basket_batch", "T2", tables="actions", extra=_LAST, sql="SELECT session_id, item_id, rate FROM last")
def basket_batch(spark, sf):
    """Latest action per session and item, deletions removed."""
    return ratings.current_basket(ratings.latest_actions(_actions(table(spark, sf, "events"))))


@query("basket_stream", "T2", tables="actions", extra=_LAST, sql="SELECT session_id, item_id, rate FROM last")
def basket_stream(spark, sf):
    """The same as a stream with a keyed sink."""
    path = scratch_path(spark, "basket")
    ratings.start_basket(_actions(_event_stream(spark, sf)), path).awaitTermination()
    return ratings.read_basket(spark, path)


@query(
    "rating_log_stream", "T1 A15", tables="actions",
    sql="""SELECT session_id AS basket_id, item_id, rate, dense_rank() OVER (ORDER BY session_id) AS smelling_user_id
    FROM actions WHERE action = 'purchase'""",
)
def rating_log_stream(spark, sf):
    """Finished baskets appended to the log, one new id per basket."""
    path = scratch_path(spark, "log")
    cols = DERIVED["actions"][1]
    bought = _event_stream(spark, sf).filter("event_type = 'purchase'")
    rows = bought.selectExpr(f"{cols['session_id']} AS basket_id", f"{cols['item_id']} AS item_id", f"{cols['rate']} AS rate")
    ratings.start_log(rows, path).awaitTermination()
    return spark.read.parquet(path).select("basket_id", "item_id", "rate", "smelling_user_id")


@query(
    "rating_log_once", "T1", tables="actions",
    sql="""SELECT session_id AS basket_id, item_id, rate, dense_rank() OVER (ORDER BY session_id) AS smelling_user_id
    FROM actions WHERE action = 'purchase'""",
)
def rating_log_once(spark, sf):
    """The same from a stream that delivers every row twice: repeats within a day of event time are logged once."""
    path = scratch_path(spark, "log")
    cols = DERIVED["actions"][1]
    twice = _event_stream(spark, sf).unionByName(_event_stream(spark, sf)).filter("event_type = 'purchase'")
    rows = twice.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", f"{cols['session_id']} AS basket_id", f"{cols['item_id']} AS item_id", f"{cols['rate']} AS rate")
    ratings.start_log(ratings.once(rows, ["event_id"], "ts", "1 day").drop("event_id", "ts"), path).awaitTermination()
    return spark.read.parquet(path).select("basket_id", "item_id", "rate", "smelling_user_id")


@query(
    "closed_sessions_stream", "T2", tables="actions",
    extra="""timed AS (SELECT a.session_id, a.item_id, CASE WHEN a.action = 'error' THEN 'delete' ELSE 'add' END AS action, a.rate, a.event_id, e.ts
      FROM actions a JOIN events e USING (event_id)),
    marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM timed WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS part FROM marked),
    ended AS (SELECT session_id, part FROM numbered GROUP BY session_id, part HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM timed) - INTERVAL 10 MINUTE),
    final AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY session_id, part, item_id ORDER BY event_id DESC) AS rn
      FROM numbered n JOIN ended USING (session_id, part)) WHERE rn = 1 AND action <> 'delete')""",
    sql="SELECT session_id, item_id, rate, count(*) AS n FROM final GROUP BY session_id, item_id, rate",
)
def closed_sessions_stream(spark, sf):
    """Items in the baskets of ended sessions: open sessions are the stream's state, by event time."""
    path = scratch_path(spark, "sessions")
    events = _event_stream(spark, sf)
    timed = events.selectExpr("CAST(ts AS TIMESTAMP) AS ts", *[f"{e} AS {c}" for c, e in DERIVED["actions"][1].items()])
    removed = F.col("action") == "error"
    actions = timed.withColumn("action", F.when(removed, F.lit(ratings.REMOVE)).otherwise(F.lit("add")))
    ratings.start_sessions(actions, path).awaitTermination()
    return spark.read.parquet(path).groupBy("session_id", "item_id", "rate").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weights_refit_stream", "T3 S11 E3", tables=BASE + " points rating_log", extra=", ".join(grid_all_sql(True)),
    sql="""SELECT CAST(1 AS BIGINT) AS weight_id, round(w1, 9) AS w_style, round(w2, 9) AS w_color, round(w3, 9) AS w_season,
    round(p, 9) AS mean_precision FROM result ORDER BY p DESC, seq LIMIT 1""",
)
def weights_refit_stream(spark, sf):
    """Weights of all users searched again after new log rows; one version per batch."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = ratings.file_stream(spark, f"{sf}/lineitem.parquet*", table(spark, sf, "lineitem"))
    log = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id")).join(orders, "o_orderkey")
    path = scratch_path(spark, "refit")
    ratings.start_refit(
        log.select("user_id", "item_id"), f"{path}/log", f"{path}/weights", lambda rows: best_grid(spark, sf, rows),
    ).awaitTermination()
    found = spark.read.parquet(f"{path}/weights").select("weight_id", "w_style", "w_color", "w_season", "mean_precision")
    return found.withColumns({c: F.round(c, 9) for c in found.columns[1:]})
