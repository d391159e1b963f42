"""Trigram postings of text columns, so that a search reads the rows that may hold its terms and no others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.operators import filters
from stylematch.session import shuffle_width, stage

GRAM = 3
BUCKET = "bucket"


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for a shorter one. Linear in the text."""
    chars = F.split(F.lower(text), "")
    runs = F.transform(chars, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, GRAM)]))
    return F.array_distinct(F.array_compact(F.filter(runs, lambda g: F.char_length(g) == GRAM)))


def grams_of(needle: str) -> set[str]:
    needle = needle.lower()
    return {needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)}


class TextIndex:
    """A Parquet folder of (gram, row id), in sub-folders by the hash of the gram and in order of grams inside.

    Rows with many grams in common make long postings: these are cut by ranges of gram and id when they are written, and
    a search asks for the rarest grams of a term, by the counts kept beside. Every row that holds a term has all its
    trigrams, so the candidates lose none; they are verified by the same condition that a scan uses.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        layout = spark.read.parquet(f"{path}/layout").first()
        self.row_id, self.fields, self.buckets = layout["row_id"], list(layout["fields"]), layout["buckets"]
        self.schemas = {"postings": f"row {layout['row_type']}, gram string, {BUCKET} int", "counts": f"gram string, n long, {BUCKET} int"}

    @classmethod
    def create(cls, rows: DataFrame, path: str, row_id: str, fields: Sequence[str], buckets: int = 64) -> TextIndex:
        """Index the text columns ``fields`` of rows with a unique id. Null and short texts have no postings."""
        spark = rows.sparkSession
        of_fields = F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams(F.col(f)), F.array().cast("array<string>")) for f in fields])))
        posted = stage(rows.select(F.col(row_id).alias("row"), F.explode(of_fields).alias("gram")), "postings")
        bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")
        width = shuffle_width(spark)
        dealt = posted.withColumn(BUCKET, bucket).repartitionByRange(width, BUCKET, "gram", "row").sortWithinPartitions(BUCKET, "gram", "row")
        dealt.write.partitionBy(BUCKET).parquet(f"{path}/postings")
        counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn(BUCKET, bucket)
        counts.repartitionByRange(width, BUCKET, "gram").sortWithinPartitions(BUCKET, "gram").write.partitionBy(BUCKET).parquet(f"{path}/counts")
        layout = spark.range(1).select(
            F.lit(row_id).alias("row_id"), F.lit(posted.schema["row"].dataType.simpleString()).alias("row_type"), F.array(*[F.lit(f) for f in fields]).alias("fields"), F.lit(buckets).alias("buckets"),
        )
        layout.write.parquet(f"{path}/layout")
        return cls(spark, path)

    def _part(self, part: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[part]).parquet(f"{self.path}/{part}")

    def _read(self, part: str, grams: set[str]) -> DataFrame:
        """The rows of some grams: only their buckets are opened, and only their runs in these."""
        named = self.spark.createDataFrame([(g,) for g in sorted(grams)], "gram string")
        places = [r[0] for r in named.select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self._part(part).filter(F.col(BUCKET).isin(places) & F.col("gram").isin(sorted(grams)))

    def candidates(self, needles: Sequence[str], rarest: int = 4) -> DataFrame | None:
        """(row): the rows that may hold every needle, or None where no needle is long enough to tell."""
        each = [g for g in (grams_of(n) for n in needles) if g]
        if not each:
            return None
        # as many rows as the needles have trigrams
        counts = {r["gram"]: r["n"] for r in self._read("counts", set().union(*each)).collect()}
        asked: set[str] = set()
        for grams in each:
            asked.update(sorted(grams, key=lambda g: (counts.get(g, 0), g))[:rarest])
        if not all(g in counts for g in asked):
            return self._part("postings").select("row").limit(0)
        found = self._read("postings", asked).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        return found.filter(F.col("n") == len(asked)).select("row")

    def _rows(self, df: DataFrame, candidates: DataFrame | None) -> DataFrame:
        if candidates is None:
            return df
        return df.join(candidates.withColumnRenamed("row", "_row"), F.col(self.row_id) == F.col("_row"), "left_semi")

    def search_items(self, df: DataFrame, query: str, limit: int = 20) -> DataFrame:
        """As ``filters.search_items``, on the rows that may match."""
        raw = query.strip()
        either = [self.candidates([needle]) for needle in {raw, raw.replace(" ", "").replace("-", "")}]
        may = None if any(c is None for c in either) else either[0]
        for other in either[1:]:
            may = may if may is None else may.unionByName(other).distinct()
        return filters.search_items(self._rows(df, may), query, self.row_id, limit)

    def search_terms(self, df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
        """As ``filters.search_terms``, on the rows that may match; ``fields`` are among the indexed ones."""
        unknown = set(fields) - set(self.fields)
        if unknown:
            raise ValueError(f"not indexed: {sorted(unknown)}")
        may = self.candidates(query.replace(",", " ").split())
        return filters.search_terms(self._rows(df, may), query, fields, self.row_id)
