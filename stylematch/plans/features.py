"""TF-IDF in long form and reports on clusters and labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylematch.operators.aggregates import tokens, vocabulary
from stylematch.operators.joins import salted_join
from stylematch.operators.ranking import top_k
from stylematch.session import cut_lineage, stage


#: Rows of a vocabulary that may be copied to every task, and bytes of text that a task counts.
COPIED_ROWS = 500_000
TASK_BYTES = 8 << 20


def _joined(rows: DataFrame, side: DataFrame, key: str, doc_id: str, counts: DataFrame | None = None) -> DataFrame:
    """The rows with those of the staged ``side``: copied to every task while it is small, so that the rows stay by document."""
    if side.count() <= COPIED_ROWS:
        return rows.join(F.broadcast(side), key)
    return salted_join(rows, side, key, doc_id, counts)


def tf_idf(docs: DataFrame, doc_id: str, text: str, sep: str = ",", min_count: int = 25) -> DataFrame:
    """(doc_id, term, weight): L2-normalised tf * (ln((1+n)/(1+df)) + 1).

    Tokens are cut at ``sep`` without trimming and kept when they occur ``min_count`` times in total; kept tokens
    are lowercased and split at blanks into terms. That is done once in the vocabulary, whose terms are numbered, so the
    occurrences are counted by number, within the task to which their document was dealt. A vocabulary of up to
    ``COPIED_ROWS`` rows is copied to the tasks; beyond that, frequent tokens get salts by their count, because a common
    token occurs in most documents.
    """
    n_docs, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
    frequent = stage(vocabulary(tokens(docs.select(doc_id, text), doc_id, text, sep), min_count), "frequent")
    cut = frequent.select("token", F.explode(F.split(F.lower("token"), r"[ \t\n\r\f]+")).alias("term")).filter(F.col("term") != "")
    numbered = stage(cut.select("term").distinct().withColumn("place", F.monotonically_increasing_id()), "terms")
    places = stage(cut.join(numbered, "term").groupBy("token").agg(F.collect_list("place").alias("places")), "places")

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = tokens(docs.select(doc_id, text).repartition(tasks, doc_id), doc_id, text, sep)
    kept = _joined(dealt, places, "token", doc_id, frequent).select(doc_id, F.explode("places").alias("place"))
    tf = stage(kept.groupBy(doc_id, "place").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = stage(tf.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "df")
    idf = (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("n"))) + 1.0).alias("idf")
    raw = _joined(tf, stage(df.join(numbered, "place").select("place", "term", idf), "idf"), "place", doc_id, df)
    raw = raw.withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return raw.select(doc_id, "term", (F.col("w") / norm).alias("weight"))


def cluster_terms(weights: DataFrame, labels: DataFrame, doc_id: str, k: int = 10) -> DataFrame:
    """Top k terms per cluster by mean weight; a document without the term counts 0."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(labels.select(doc_id, "cluster"), doc_id).groupBy("cluster", "term").agg(F.sum("weight").alias("w"))
    means = sums.join(sizes, "cluster").select("cluster", "term", (F.col("w") / F.col("size")).alias("mean_weight"))
    order = [F.round("mean_weight", 9).desc(), F.col("term")]
    return top_k(means, ["cluster"], order, k, rank="rank")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_shares(labels: DataFrame, category: str, k: int = 10) -> DataFrame:
    """Share of each category value inside its cluster, k largest."""
    counts = labels.groupBy("cluster", category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("cluster"))
    return top_k(
        counts.withColumn("share", F.col("n") / total), ["cluster"], [F.col("n").desc(), F.col(category)], k, rank="rank"
    )


def cluster_examples(labels: DataFrame, order: str, k: int = 5) -> DataFrame:
    return top_k(labels, ["cluster"], [F.col(order)], k, rank="pos")


def class_report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Works on the confusion counts, one row per (label, prediction).
    """
    counts = rows.groupBy(label, prediction).agg(F.count(F.lit(1)).cast("double").alias("n"))
    entries = F.array(
        F.struct(F.col(label).alias("class"), F.lit(1.0).alias("actual"), F.lit(0.0).alias("predicted")),
        F.struct(F.col(prediction).alias("class"), F.lit(0.0).alias("actual"), F.lit(1.0).alias("predicted")),
    )
    hit = (F.col(label) == F.col(prediction)).cast("double")
    spread = counts.select("n", hit.alias("hit"), F.explode(entries).alias("e"))
    by_class = spread.groupBy(F.col("e.class").alias("class")).agg(
        F.sum(F.col("n") * F.col("hit") * F.col("e.actual")).alias("tp"),
        F.sum(F.col("n") * F.col("e.actual")).alias("support"),
        F.sum(F.col("n") * F.col("e.predicted")).alias("predicted"),
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    # one row per class, read four times below
    scored = cut_lineage(by_class.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1))
    measures = ["precision", "recall", "f1"]
    per_class = scored.select(F.col("class").cast("string"), *measures, "support")
    total = F.sum("support")
    accuracy = scored.select("tp", "support").agg((F.sum("tp") / total).alias("a"), total.alias("support")).select(
        F.lit("accuracy").alias("class"), *[F.col("a").alias(m) for m in measures], "support"
    )
    macro = scored.agg(*[F.avg(m).alias(m) for m in measures], total.alias("support")).select(
        F.lit("macro avg").alias("class"), *measures, "support"
    )
    weighted = scored.agg(
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"_{m}") for m in measures], total.alias("support")
    ).select(F.lit("weighted avg").alias("class"), *[F.col(f"_{m}").alias(m) for m in measures], "support")
    return per_class.unionByName(accuracy).unionByName(macro).unionByName(weighted)
