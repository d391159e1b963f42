"""TF-IDF, clustering, classifiers, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stylematch import vocab
from stylematch.operators.aggregates import value_counts
from stylematch.operators.joins import enrich_outfits
from stylematch.plans import clusters, features, stored_models, styles, synthetic
from stylematch.session import scratch_path, stage
from stylematch.workload.registry import query
from stylematch.workload.tables import add_derived, derived, families, table

_TFIDF = """
    tok AS (SELECT {id} AS id, unnest(string_split(coalesce({text}, ''), '{sep}')) AS token FROM {base}),
    freq AS (SELECT token FROM tok GROUP BY token HAVING count(*) >= {min}),
    term AS (SELECT id, unnest(regexp_split_to_array(lower(token), '[ \\t\\n\\r\\f]+')) AS term FROM tok JOIN freq USING (token)),
    tf AS (SELECT id, term, count(*) AS tf FROM term WHERE term <> '' GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT id, term, tf * (ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM {base})) / (CAST(1 AS DOUBLE) + df)) + 1) AS w FROM tf JOIN df USING (term)),
    tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query(
    "document_tf_idf", "M1 A7", extra=_TFIDF.format(id="doc_id", text="text", sep=" ", base="documents", min=25),
    sql="SELECT id AS doc_id, term, round(weight, 6) AS weight FROM tfidf",
)
def document_tf_idf(spark, sf):
    """TF-IDF of all documents over the tokens with at least 25 occurrences."""
    out = features.tf_idf(table(spark, sf, "documents"), "doc_id", "text", " ", 25)
    return out.withColumn("weight", F.round("weight", 6))


add_derived("noted", "part", {
    "item_id": "p_partkey",
    "notes": "replace(p_name, ' ', ',') || ',' || p_type || ', ' || p_brand || ',' || p_type || ' absolute'",
    "gender": "CASE p_size % 3 WHEN 0 THEN 'women' WHEN 1 THEN 'unisex' END",
    "name": "p_name",
    "cluster": "CAST(p_size % 11 AS INT)",
})
_NOTES = _TFIDF.format(id="item_id", text="notes", sep=",", base="noted", min=25)


@query(
    "note_tf_idf", "M1", tables="noted", extra=_NOTES,
    sql="SELECT id AS item_id, term, round(weight, 6) AS weight FROM tfidf",
)
def note_tf_idf(spark, sf):
    """TF-IDF of the note lists; multi-word notes break into terms."""
    out = features.tf_idf(derived(spark, sf, "noted"), "item_id", "notes")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "cluster_top_terms", "A9 M4", tables="noted", extra=_NOTES,
    sql="""WITH s AS (SELECT cluster, count(*) AS n FROM noted GROUP BY cluster),
    m AS (SELECT cluster, term, sum(weight) / any_value(n) AS w FROM tfidf JOIN noted ON item_id = id JOIN s USING (cluster) GROUP BY ALL)
    SELECT cluster, term, round(w, 6) AS mean_weight, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster
    ORDER BY round(w, 9) DESC, term) AS rn FROM m) WHERE rn <= 10""",
)
def cluster_top_terms(spark, sf):
    """Ten terms with the largest mean TF-IDF per cluster."""
    noted = derived(spark, sf, "noted")
    weights = features.tf_idf(noted, "item_id", "notes")
    return features.cluster_terms(weights, noted, "item_id").withColumn("mean_weight", F.round("mean_weight", 6))


@query(
    "cluster_category_shares", "M4 A1", tables="noted",
    sql="""WITH c AS (SELECT cluster, coalesce(gender, 'unknown') AS gender, count(*) AS n FROM noted GROUP BY ALL)
    SELECT cluster, gender, n, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS share,
    CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, gender) AS INTEGER) AS rank FROM c""",
)
def cluster_category_shares(spark, sf):
    """Sizes and category shares per cluster."""
    noted = derived(spark, sf, "noted").withColumn("gender", F.coalesce("gender", F.lit("unknown")))
    return features.cluster_shares(noted, "gender").withColumn("share", F.round("share", 6))


@query(
    "cluster_examples", "O7 M4",
    sql="""SELECT label AS cluster, vec_id, CAST(rn AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn
    FROM embeddings) WHERE rn <= 5""",
)
def cluster_examples(spark, sf):
    """First five vectors of each label."""
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), "vec_id")
    return features.cluster_examples(rows, "vec_id")


def _vectors(spark, sf):
    return clusters.vector_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query("vector_clusters", "M2")
def vector_clusters(spark, sf):
    """K-Prototypes with 11 clusters on all vectors and their label."""
    rows = _vectors(spark, sf)
    model = clusters.fit(rows, [11])[11]
    return clusters.assign(rows, model)


@query("cluster_sweep", "M3 M2")
def cluster_sweep(spark, sf):
    """Cost and silhouette for k = 5..14."""
    result = clusters.sweep(_vectors(spark, sf), range(5, 15))
    return vocab.literal_table(spark, "k, cost, silhouette", result)


@query("note_clusters", "M1 M2 M4 A1")
def note_clusters(spark, sf):
    """Notes to TF-IDF vectors, K-Prototypes with gender as category, cluster sizes and families."""
    noted = derived(spark, sf, "noted")
    weights = stage(features.tf_idf(noted, "item_id", "notes"), "weights")
    rows = stage(clusters.sparse_rows(weights, noted, "item_id", "gender")[0], "vectors")
    labels = clusters.assign(rows, clusters.fit(rows, [11])[11])
    both = labels.withColumnRenamed("row_id", "item_id").join(families(spark, sf), "item_id")
    return value_counts(both.withColumn("family", F.coalesce("family", F.lit("-"))).withColumn(
        "cluster_family", F.concat_ws(" | ", F.col("cluster").cast("string"), "family")
    ), "cluster_family")


add_derived("votes", "part", {
    "id": "p_partkey", "label": "CAST(p_partkey % 3 AS INT)",
    "a0": "CAST(p_size AS DOUBLE) / 64", "a1": "CAST(50 - p_size AS DOUBLE) / 64",
    "b0": "CAST(p_partkey % 32 AS DOUBLE) / 64", "b1": "CAST(p_partkey % 17 AS DOUBLE) / 64",
})


@query(
    "soft_vote", "M13", tables="votes",
    sql="""WITH p AS (SELECT id, label, (a0 + b0) / CAST(2 AS DOUBLE) AS p0, (a1 + b1) / CAST(2 AS DOUBLE) AS p1,
      (CAST(14 AS DOUBLE) / 64 + (CAST(64 AS DOUBLE) / 64 - b0 - b1)) / CAST(2 AS DOUBLE) AS p2 FROM votes)
    SELECT id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS prediction, round(greatest(p0, p1, p2), 6) AS confidence FROM p""",
)
def soft_vote(spark, sf):
    """Mean of two probability vectors and its class."""
    rows = derived(spark, sf, "votes")
    a = F.array("a0", "a1", F.lit(14.0) / 64)
    b = F.array("b0", "b1", F.lit(64.0) / 64 - F.col("b0") - F.col("b1"))
    voted = rows.withColumn("p", styles.soft_vote([a, b]))
    return voted.select("id", styles.arg_max_class(F.col("p")).alias("prediction"), F.round(F.array_max("p"), 6).alias("confidence"))


@query(
    "class_report", "M14",
    sql="""WITH r AS (SELECT d.quality AS l, CASE WHEN d.doc_id % 5 = 0 THEN d.toxic + 1 ELSE d.quality END AS p FROM labels d),
    c AS (SELECT DISTINCT l AS c FROM r UNION SELECT DISTINCT p FROM r),
    s AS (SELECT c, CAST((SELECT count(*) FROM r WHERE l = c AND p = c) AS DOUBLE) AS tp, CAST((SELECT count(*) FROM r WHERE l = c) AS DOUBLE) AS sup,
      CAST((SELECT count(*) FROM r WHERE p = c) AS DOUBLE) AS pre FROM c),
    m AS (SELECT c, sup, tp, coalesce(tp / nullif(pre, 0), 0) AS pr, coalesce(tp / nullif(sup, 0), 0) AS re FROM s),
    f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m)
    SELECT CAST(c AS VARCHAR) AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, sup AS support FROM f
    UNION ALL SELECT 'accuracy', round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), round(sum(tp) / sum(sup), 6), sum(sup) FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(sup) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr * sup) / sum(sup), 6), round(sum(re * sup) / sum(sup), 6), round(sum(f1 * sup) / sum(sup), 6), sum(sup) FROM f""",
)
def class_report(spark, sf):
    """Accuracy and per-class measures of a labeling against another."""
    rows = table(spark, sf, "labels").select(
        F.col("quality").alias("label"),
        F.when(F.col("doc_id") % 5 == 0, F.col("toxic") + 1).otherwise(F.col("quality")).alias("prediction"),
    )
    out = features.class_report(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "item_families", "M16", tables="families", sql="SELECT item_id, family FROM families",
)
def item_families(spark, sf):
    """Family of each item by its first accord; unmapped accords give null."""
    return families(spark, sf)


def _two_piece(spark, sf):
    rows = styles.two_piece_rows(derived(spark, sf, "tops"))
    train, test = styles.split_and_fill(rows, styles.TWO_PIECE)
    return styles.train_style_model(train, styles.TWO_PIECE), test


def _one_piece(spark, sf):
    rows = styles.one_piece_rows(derived(spark, sf, "dresses"))
    train, test = styles.split_and_fill(rows, styles.ONE_PIECE)
    return styles.train_style_model(train, styles.ONE_PIECE), test


def _report(model, test):
    scored = model.predict(test).select(F.col("style").alias("label"), F.col("predicted_style").alias("prediction"))
    return features.class_report(scored)


@query("two_piece_style_report", "M12 M13 M14 M7 M9 M10 A16 F22 P9")
def two_piece_style_report(spark, sf):
    """Two-piece classifiers with soft voting, measured on the test rows."""
    return _report(*_two_piece(spark, sf))


@query("one_piece_style_report", "M12 M13 M14 P10")
def one_piece_style_report(spark, sf):
    """One-piece classifiers with soft voting, measured on the test rows."""
    return _report(*_one_piece(spark, sf))


@query("predicted_user_styles", "M15 J1 M12")
def predicted_user_styles(spark, sf):
    """Style of every user from the stored model of its outfit shape."""
    users = derived(spark, sf, "users").drop("user_style")
    tops, dresses = derived(spark, sf, "tops"), derived(spark, sf, "dresses")
    wide = enrich_outfits(users, tops, dresses, {"dress": ["dress_sleeve_length"]})
    folder = scratch_path(spark, "style-models")
    for name, fitted in (("two-piece", _two_piece), ("one-piece", _one_piece)):
        stored_models.save_style_model(fitted(spark, sf)[0], f"{folder}/{name}")
    return styles.predict_outfits(wide, *[stored_models.load_style_model(spark, f"{folder}/{name}") for name in ("two-piece", "one-piece")])


@query("stacked_style_report", "M18")
def stacked_style_report(spark, sf):
    """Logistic meta-model on out-of-fold probabilities, measured on the test rows."""
    rows = styles.one_piece_rows(derived(spark, sf, "dresses"))
    train, test = styles.split_and_fill(rows, styles.ONE_PIECE)
    model = styles.encoders(train, styles.ONE_PIECE)
    meta = styles.train_stacked(model, styles.coded_rows(model, train))
    scored = styles.predict_stacked(model, meta, styles.coded_rows(model, test))
    return features.class_report(scored.select(F.col("y").cast("int").alias("label"), F.col("prediction").cast("int")))


@query("random_users", "M19")
def random_users(spark, sf):
    """One random user per customer, drawn from the clothes tables."""
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return synthetic.random_users(ids, derived(spark, sf, "tops"), derived(spark, sf, "dresses"))
