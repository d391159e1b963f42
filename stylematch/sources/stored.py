"""Stored tables in hash buckets, so that a batch rewrites the buckets of its keys and no others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.session import discard, stage
from stylematch.sources.tables import add_missing_parents, replace_groups, upsert

BUCKET = "bucket"


class StoredTable:
    """A Parquet folder with a sub-folder per bucket of its keys.

    Rows are dealt to ``buckets`` folders by the hash of their key columns; keys and number of buckets are kept with the
    table. A change reads the buckets that the batch's keys fall in, stages what they become, and replaces these folders
    alone; the files of all other buckets keep their names. Readers see a bucket before or after the change; one
    writer at a time is the caller's care. What reaches the driver is the list of touched buckets.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        layout = spark.read.parquet(f"{path}/_layout").first()
        self.keys, self.buckets = list(layout["keys"]), layout["buckets"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> StoredTable:
        """Write ``rows`` as a new table; a path that holds something is refused."""
        if BUCKET in rows.columns:
            raise ValueError(f"a stored table cannot have a column {BUCKET}")
        spark = rows.sparkSession
        layout = spark.range(1).select(F.array(*[F.lit(k) for k in keys]).alias("keys"), F.lit(buckets).alias("buckets"))
        _in_buckets(rows, keys, buckets).write.partitionBy(BUCKET).parquet(path)
        layout.write.parquet(f"{path}/_layout")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self._all().drop(BUCKET)

    def _all(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def _touched(self, batch: DataFrame) -> list[int]:
        return [r[0] for r in batch.select(_bucket(self.keys, self.buckets).alias(BUCKET)).distinct().collect()]

    def _rewrite(self, batch: DataFrame, change) -> int:
        """Replace the buckets of the batch by what ``change`` makes of their rows; returns how many there are."""
        columns = self.rows().columns
        types = {f.name: f.dataType for f in self.rows().schema.fields}
        batch = stage(batch, "batch")
        touched = self._touched(batch.withColumns({k: F.col(k).cast(types[k]) for k in self.keys}))
        if touched:
            held = self._all().filter(F.col(BUCKET).isin(touched)).select(*columns)
            after = stage(change(held, batch).select(*[F.col(c).cast(types[c]).alias(c) for c in columns]), "buckets")
            # a bucket that the change empties would keep its files, as only written folders are replaced
            emptied = set(touched) - set(self._touched(after))
            _in_buckets(after, self.keys, self.buckets).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(self.path)
            for bucket in emptied:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
            discard(after)
        discard(batch)
        return len(touched)

    def upsert(self, batch: DataFrame, seq: str) -> int:
        """A key of the batch replaces the stored row, the last batch row per key by ``seq`` wins, new keys are added."""
        return self._rewrite(batch, lambda held, rows: upsert(held, rows, self.keys, seq))

    def replace_groups(self, batch: DataFrame) -> int:
        """All stored rows of each key in the batch give way to the batch's rows of that key."""
        if len(self.keys) != 1:
            raise ValueError("groups are replaced by a single key column")
        return self._rewrite(batch, lambda held, rows: replace_groups(held, rows, self.keys[0]))

    def add_parents(self, facts: DataFrame, columns: Sequence[str], defaults: Mapping[str, str | None]) -> int:
        """Append a default row for every value of the facts that is no key yet; no file of the table is rewritten."""
        if len(self.keys) != 1:
            raise ValueError("parents have a single key column")
        held = self.rows()
        added = add_missing_parents(held.limit(0), self.keys[0], facts, columns, defaults).join(held.select(*self.keys), self.keys, "left_anti")
        added = stage(added.select(*held.columns), "parents")
        _in_buckets(added, self.keys, self.buckets).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        count = added.count()
        discard(added)
        return count


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _in_buckets(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows with their bucket, each bucket in one task and so in one file per write."""
    return rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(buckets, BUCKET)
