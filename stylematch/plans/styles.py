"""Style classifiers on outfit attributes with MLlib: two base models, soft voting, stacking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch.functions.text import pair
from stylematch.operators.aggregates import class_weights, fill_modes, group_modes
from stylematch.operators.encode import label_decode, ordinal_codes, ordinal_encode, stratified_split
from stylematch.operators.filters import exclude_value, recode
from stylematch.session import stage

TWO_PIECE = [
    "top_category", "top_color", "top_sleeve_length", "top_material", "top_print", "top_fit", "top_sub_style",
    "bottom_length", "bottom_category", "bottom_color", "bottom_material", "bottom_fit", "bottom_sub_style",
]
ONE_PIECE = [
    "dress_length", "dress_color", "dress_sleeve_length", "dress_material", "dress_print", "dress_neckline",
    "dress_fit", "dress_detail", "dress_sub_style",
]
#: Rows that one part of a fitted table holds.
TASK_ROWS = 20_000
PAIRS = {"color_pair": ("top_color", "bottom_color"), "fit_pair": ("top_fit", "bottom_fit")}


def two_piece_rows(tops: DataFrame) -> DataFrame:
    """Training rows of the two-piece model: both parts take the row's sub-style."""
    rows = tops.withColumns({"top_sub_style": F.col("sub_style"), "bottom_sub_style": F.col("sub_style")})
    return recode(rows, "top_category", {"브라탑": "탑"}).select("id", "style", *TWO_PIECE)


def one_piece_rows(dresses: DataFrame) -> DataFrame:
    rows = exclude_value(dresses, "dress_category", "점프수트").withColumnRenamed("sub_style", "dress_sub_style")
    return rows.select("id", "style", *ONE_PIECE)


def add_pairs(df: DataFrame, null_text: str | None = None) -> DataFrame:
    have = {n: pair(F.col(a), F.col(b), null_text) for n, (a, b) in PAIRS.items() if a in df.columns and b in df.columns}
    return df.withColumns(have) if have else df


def soft_vote(probabilities: Sequence[Column]) -> Column:
    """Mean of the class probabilities of several models."""
    total = probabilities[0]
    for p in probabilities[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    return F.transform(total, lambda a: a / F.lit(float(len(probabilities))))


def arg_max_class(probability: Column) -> Column:
    """0-based class with the largest probability, first on ties."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def _forest(trees: int, bins: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=8, maxBins=bins, seed=42,
        probabilityCol="forest_probability", rawPredictionCol="forest_raw", predictionCol="forest_prediction",
    )


def _fit_boosted(coded: DataFrame, rounds: int, bins: int, classes: int) -> list:
    """One boosted-tree model per class against the rest, fitted side by side."""
    single = GBTClassifier(maxIter=rounds, maxDepth=4, maxBins=bins, seed=42)
    rest = OneVsRest(
        classifier=single, featuresCol="features", labelCol="y", weightCol="weight", parallelism=classes
    )
    return [
        m.setPredictionCol(f"is_{c}").setRawPredictionCol(f"raw_{c}").setProbabilityCol(f"p_{c}")
        for c, m in enumerate(rest.fit(coded).models)
    ]


def _boosted_probability(models: Sequence, df: DataFrame, out: str) -> DataFrame:
    """Adds the class probabilities, normalised over the one-against-rest models."""
    for model in models:
        df = model.transform(df)
    each = F.array(*[F.get(vector_to_array(f"p_{c}"), F.lit(1)) for c in range(len(models))])
    total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    helpers = [f"{name}_{c}" for c in range(len(models)) for name in ("raw", "p", "is")]
    return df.withColumn(out, F.transform(each, lambda p: p / total)).drop(*helpers)


@dataclass
class StyleModel:
    """Encoders and fitted models of one outfit shape."""

    features: list[str]
    codes: DataFrame
    labels: DataFrame
    bins: int
    n_classes: int
    forest: RandomForestClassificationModel | None = None
    boosted: list | None = None

    def encode(self, df: DataFrame) -> DataFrame:
        coded = ordinal_encode(add_pairs(df), self.features, self.codes)
        shifted = coded.withColumns({c: (F.col(c) + 1).cast("double") for c in self.features})
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(shifted)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds the class probabilities, ``prediction`` (code) and ``predicted_style``."""
        scored = _boosted_probability(self.boosted, self.forest.transform(self.encode(df)), "boosted_probability")
        both = [vector_to_array("forest_probability"), F.col("boosted_probability")]
        voted = scored.withColumn("probability", soft_vote(both))
        voted = voted.withColumn("prediction", arg_max_class(F.col("probability")))
        return label_decode(voted, "prediction", self.labels, "style", "predicted_style")


def split_and_fill(rows: DataFrame, features: Sequence[str], test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows; null cells take the training mode of the row's own style."""
    split = stage(stratified_split(rows, "style", "id", test_share), "split")
    modes = group_modes(split.filter("NOT is_test"), "style", features)
    filled = stage(fill_modes(split, "style", features, modes), "filled")
    return filled.filter("NOT is_test").drop("is_test"), filled.filter("is_test").drop("is_test")


def encoders(train: DataFrame, base: Sequence[str]) -> StyleModel:
    """Dictionaries of the training rows; the models are still to be fitted."""
    paired = add_pairs(train)
    features = list(base) + [c for c in paired.columns if c in PAIRS]
    codes = stage(ordinal_codes(paired, features), "codes")
    labels = stage(ordinal_codes(train, ["style"]), "labels")
    sizes = codes.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    bins = max(32, (sizes.agg(F.max("n")).first()[0] or 0) + 2)
    return StyleModel(features, codes, labels, bins, labels.count())


def coded_rows(model: StyleModel, rows: DataFrame) -> DataFrame:
    """(id, features, y, weight) with softened class weights, written once because fitting reads it many times.

    More than ``TASK_ROWS`` rows are dealt evenly first: every round of a fit is as slow as its largest part, and the
    parts of the table follow the files that it was read from.
    """
    weights = stage(class_weights(rows, "style").select("style", F.col("soft_weight").alias("weight")), "weights")
    y = model.labels.select(F.col("value").alias("style"), F.col("code").cast("double").alias("y"))
    coded = model.encode(rows).join(weights, "style").join(y, "style")
    coded = coded.select("id", "features", "y", "weight")
    tasks = -(-rows.count() // TASK_ROWS)
    return stage(coded.repartition(tasks, "id", "features") if tasks > 1 else coded, "coded")


def train_style_model(train: DataFrame, base: Sequence[str], trees: int = 50, rounds: int = 20) -> StyleModel:
    """Random forest and boosted trees on the encoded rows."""
    model = encoders(train, base)
    coded = coded_rows(model, train)
    model.forest = _forest(trees, model.bins).fit(coded)
    model.boosted = _fit_boosted(coded, rounds, model.bins, model.n_classes)
    return model


def predict_outfits(outfits: DataFrame, two_piece: StyleModel, one_piece: StyleModel) -> DataFrame:
    """(user_id, predicted_style): the model is chosen by the outfit shape, absent dress means two-piece."""
    pairs = recode(outfits.filter(F.col("dress_id").isNull()), "top_category", {"브라탑": "탑"})
    dresses = outfits.filter(F.col("dress_id").isNotNull())
    return two_piece.predict(pairs).select("user_id", "predicted_style").unionByName(
        one_piece.predict(dresses).select("user_id", "predicted_style")
    )


def train_stacked(model: StyleModel, coded: DataFrame, trees: int = 20, rounds: int = 5, folds: int = 3):
    """Logistic meta-model on out-of-fold probabilities of both base models; the base models stay in ``model``."""
    folded = coded.withColumn("_fold", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(folds)))

    def fitted(rows: DataFrame) -> tuple:
        return _forest(trees, model.bins).fit(rows), _fit_boosted(rows, rounds, model.bins, model.n_classes)

    out_of_fold = None
    for fold in range(folds):
        base = fitted(folded.filter(F.col("_fold") != fold))
        part = _meta_features(*base, folded.filter(F.col("_fold") == fold)).select("y", "weight", "meta")
        out_of_fold = part if out_of_fold is None else out_of_fold.unionByName(part)
    meta = LogisticRegression(featuresCol="meta", labelCol="y", weightCol="weight", maxIter=100)
    stacked = meta.fit(stage(out_of_fold, "meta"))
    model.forest, model.boosted = fitted(coded)
    return stacked


def _meta_features(forest, boosted: Sequence, df: DataFrame) -> DataFrame:
    scored = _boosted_probability(boosted, forest.transform(df), "boosted_probability")
    joined = F.concat(vector_to_array("forest_probability"), F.col("boosted_probability"))
    return scored.withColumn("meta", array_to_vector(joined))


def predict_stacked(model: StyleModel, meta, coded: DataFrame) -> DataFrame:
    return meta.transform(_meta_features(model.forest, model.boosted, coded))
