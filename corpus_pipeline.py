"""A corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, and the mix of the sources.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet below
``spark.checkpoint.dir`` and reads it again for the next stage. All stages but the last return the columns of documents.
Rows with null or repeated ids, null or empty texts and an empty table pass through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from stylematch.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier line; ``n_chars`` follows the text.

    A document of which no words are left is a copy of earlier ones and goes; one that had none before stays.
    """
    gone = "lines_gone"
    while gone in docs.columns:
        gone += "_"
    out = line_dedup.drop_similar_lines(docs, count=gone).filter((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every near-duplicate group.

    Rows without an id stay. Rows that repeat an id and a text stay once; other rows of a kept id stay with it.
    """
    found = near_dedup.near_duplicates(docs)
    found = stage(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("lead"), F.count("*").alias("n")), "kept")
    # every id is found: the texts meet the few that go, not the many that stay
    kept = docs.filter("doc_id IS NOT NULL").join(found.filter("doc_id <> lead").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if not found.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its source's target and how many words the mix takes from it."""
    mixed = mixing.taken_words(*mixing.mix_sources(docs))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
]

#: The classifier and the latent search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
