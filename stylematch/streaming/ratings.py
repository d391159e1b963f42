"""Streams on rating actions.

Every sink keeps its checkpoint beside its rows and writes one folder per micro-batch. A second start on the same sink
goes on where the last one stopped: new input becomes new batches, and a batch that is run again after a failure
overwrites its own folder only. A sink that holds rows but has lost its checkpoint is refused, because its batches
would start at 0 again and overwrite what is there. Readers combine the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stylematch.operators.joins import keep_latest
from stylematch.operators.ordered import with_position
from stylematch.operators.ranking import arg_max
from stylematch.session import discard, path_exists, stage

REMOVE = "delete"


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream with the schema of ``like``; a pattern also matches a single file."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], sink: str) -> StreamingQuery:
    """Start or resume the stream of a sink; the checkpoint is a hidden folder in the sink."""
    spark, state = stream.sparkSession, f"{sink}/_checkpoint"
    if path_exists(spark, sink) and not path_exists(spark, state):
        raise ValueError(f"{sink} has no checkpoint: its batches would be numbered from 0 and overwrite stored rows")
    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(write).start()
    )


def latest_actions(actions: DataFrame) -> DataFrame:
    """Last action per (session, item); works on a table and on a stream."""
    last = F.max_by(F.struct("action", "rate", "event_id"), "event_id")
    return actions.groupBy("session_id", "item_id").agg(last.alias("last")).select("session_id", "item_id", "last.*")


def current_basket(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("action") != REMOVE).select("session_id", "item_id", "rate")


def start_basket(actions: DataFrame, path: str) -> StreamingQuery:
    """Keep the last action per (session, item) of each batch; ``read_basket`` combines the batches.

    No state is held between batches: what the batches wrote is the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_actions(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(actions, write, path)


def read_basket(spark: SparkSession, path: str) -> DataFrame:
    """The basket after all batches."""
    changes = spark.read.parquet(path)
    return current_basket(keep_latest(changes, ["session_id", "item_id"], [F.col("event_id").desc()]))


def once(rows: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The rows without those that repeat the keys of an earlier one, as long as that one is not ``delay`` behind.

    Works on a stream: the keys seen are state of its checkpoint and expire with the event time, so a file that is
    delivered again, also after a restart, adds nothing.
    """
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def start_sessions(actions: DataFrame, path: str, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """The baskets of sessions that have ended: after ``gap`` without an action, and ``delay`` for late ones.

    What is known of an open session is keyed state of the stream; it goes when the session is written, so the state holds
    open sessions only. A batch writes the last action per item of the sessions that it closed; deleted items are left out.
    """
    one = F.struct("event_id", "item_id", "action", "rate")
    opened = actions.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "session_id").agg(F.collect_list(one).alias("actions"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), F.explode("actions").alias("a")).select("session_id", "started", "ended", "a.*")
        last = keep_latest(rows, ["session_id", "started", "item_id"], [F.col("event_id").desc()])
        kept = last.filter(F.col("action") != REMOVE).select("session_id", "started", "ended", "item_id", "rate")
        kept.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(opened, write, path)


def _largest_id_before(spark: SparkSession, path: str, batch_id: int) -> int:
    """Largest id of the earlier batches, from the one number that each keeps beside its rows.

    The folder partitions keep a repeated batch from seeing its own number. Logs whose batches keep no number, as
    earlier versions wrote them, are read whole.
    """
    kept = f"{path}/_last"
    if path_exists(spark, kept):
        numbers = spark.read.option("basePath", kept).schema("last bigint, batch_id bigint").parquet(kept).filter(F.col("batch_id") < batch_id)
        if numbers.count() == batch_id:
            return numbers.agg(F.max("last")).first()[0] or 0
    rows = spark.read.schema("smelling_user_id bigint, batch_id bigint").parquet(path)
    return rows.filter(F.col("batch_id") < batch_id).agg(F.max("smelling_user_id")).first()[0] or 0


def start_log(baskets: DataFrame, path: str) -> StreamingQuery:
    """Append finished baskets to the rating log; every basket gets the next free ``smelling_user_id``.

    The ids of a batch follow the largest id of the batches before it, in the order of ``basket_id``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a batch is computed once, whatever state it takes, and then read several times
        batch = stage(batch, "baskets")
        before = _largest_id_before(spark, path, batch_id) if batch_id > 0 else 0
        numbered = with_position(batch.select("basket_id").distinct(), "basket_id", "_pos")
        rows = batch.join(numbered, "basket_id").withColumn("smelling_user_id", F.col("_pos") + F.lit(before + 1))
        rows.drop("_pos").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        last = numbered.agg((F.coalesce(F.max("_pos") + 1, F.lit(0)) + F.lit(before)).cast("bigint").alias("last"))
        last.write.mode("overwrite").parquet(f"{path}/_last/batch_id={batch_id}")
        discard(batch)

    return _run(baskets, write, path)


def start_refit(
    log: DataFrame, log_path: str, weights_path: str, search: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """After each batch of log rows search the weights on the whole log and append the best as a version.

    ``search`` maps the log to the weight grid; the batch number, which goes on over restarts, is the version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        best = arg_max(search(spark.read.parquet(log_path)), "mean_precision", "seq")
        version = best.withColumn("weight_id", F.lit(batch_id + 1).cast("bigint"))
        version.coalesce(1).write.mode("overwrite").parquet(f"{weights_path}/batch_id={batch_id}")

    return _run(log, write, weights_path)
