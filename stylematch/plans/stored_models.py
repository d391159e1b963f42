"""Style models kept by version, so that users are scored without a refit."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.plans.styles import StyleModel
from stylematch.session import path_exists


def model_versions(spark: SparkSession, folder: str) -> DataFrame | None:
    """(version, features, bins, n_classes, boosted) of the finished versions, or None where there are none."""
    path = f"{folder}/versions"
    return spark.read.parquet(path) if path_exists(spark, path) else None


def save_style_model(model: StyleModel, folder: str) -> int:
    """Store encoders and fitted models under the next version and return its number.

    The row that names the version is written last: a save that was cut short is no version, and the next one takes
    another number only if its folder is free. One writer at a time is the caller's care.
    """
    if model.forest is None or model.boosted is None:
        raise ValueError("the model is not fitted")
    spark = model.codes.sparkSession
    known = model_versions(spark, folder)
    version = 1 if known is None else known.agg(F.max("version")).first()[0] + 1
    while path_exists(spark, f"{folder}/{version}"):
        version += 1
    path = f"{folder}/{version}"
    model.codes.write.parquet(f"{path}/codes")
    model.labels.write.parquet(f"{path}/labels")
    model.forest.write().save(f"{path}/forest")
    for place, single in enumerate(model.boosted):
        single.write().save(f"{path}/boosted-{place}")
    row = spark.range(1).select(
        F.lit(version).alias("version"), F.array(*[F.lit(f) for f in model.features]).alias("features"), F.lit(model.bins).alias("bins"),
        F.lit(model.n_classes).alias("n_classes"), F.lit(len(model.boosted)).alias("boosted"))
    row.write.mode("append").parquet(f"{folder}/versions")
    return version


def load_style_model(spark: SparkSession, folder: str, version: int | None = None) -> StyleModel:
    """The named version, or the newest one; an error where it was never finished."""
    known = model_versions(spark, folder)
    asked = None if known is None else (known if version is None else known.filter(F.col("version") == version)).orderBy(F.col("version").desc()).first()
    if asked is None:
        raise ValueError(f"no version {'' if version is None else version} in {folder}".replace("  ", " "))
    path = f"{folder}/{asked['version']}"
    return StyleModel(
        list(asked["features"]), spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/labels"), asked["bins"], asked["n_classes"],
        RandomForestClassificationModel.load(f"{path}/forest"), [GBTClassificationModel.load(f"{path}/boosted-{i}") for i in range(asked["boosted"])])
