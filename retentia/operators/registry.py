"""The registry of trained models: one row per training run, its models nested in ``details``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import display_name, title_case
from retentia.operators.selection import any_element
from retentia.operators.shaping import unwind


def registry_summary(models: DataFrame) -> DataFrame:
    """Newest first, with placeholders for what is missing."""
    return models.orderBy(F.col("created_at").desc_nulls_last(), "_id").select(
        F.col("_id").alias("id"),
        F.coalesce("dataset", F.lit("Unknown Dataset")).alias("dataset"),
        F.col("created_at").alias("trained_at"),
        F.coalesce(F.col("trained_by.userId"), F.lit("N/A")).alias("trained_by_user_id"),
        F.size(F.coalesce("details", F.array().cast(models.schema["details"].dataType))).alias("n_models"))


def classification_summary(models: DataFrame) -> DataFrame:
    """One row per classification model, with the text a menu shows."""
    flat = unwind(models, "details", "d").filter(F.col("d.type") == "classification")
    dataset = F.coalesce("dataset", F.lit("Unknown Dataset"))
    kind = F.coalesce("d.type", F.lit("Unknown Type"))
    name = F.coalesce("d.model_name", F.lit("Unknown Model"))
    return flat.select(
        F.col("_id").alias("id"), dataset.alias("dataset"),
        title_case(name).alias("model_name"),
        display_name(dataset, kind, name, F.col("d.metrics")["accuracy"]).alias("combined_name"),
        title_case(kind).alias("model_type"), F.col("d.model_path").alias("model_path"),
        F.col("created_at").alias("trained_at"))


def listed_models(models: DataFrame) -> DataFrame:
    """All classification models and the first regression model of each run, titles in display form.

    The first regression is found inside each row's own array, so no shuffle is needed.
    """
    kinds = F.transform("details", lambda d: d["type"])
    first = F.array_position(kinds, "regression")
    return (models.withColumn("_first", first).select(
        "_id", "dataset", "_first", F.posexplode("details").alias("pos", "d"))
        .filter((F.col("d.type") == "classification") | (F.col("pos") + 1 == F.col("_first")))
        .select("_id", "dataset", "pos", title_case(F.col("d.type")).alias("type"),
                title_case(F.col("d.model_name")).alias("model_name"),
                title_case(F.col("d.target")).alias("target")))


def runs_with_model(models: DataFrame, model_path: str) -> DataFrame:
    """Runs that hold a model stored under the path."""
    return models.filter(any_element("details", "model_path", model_path))


def resolve_models(paths: DataFrame, models: DataFrame) -> DataFrame:
    """Owning run and dataset of each requested ``model_path``: the newest run that stored a model there.

    A path is one row on either side, so a plain join cannot be skewed; Spark broadcasts the requested paths
    when their size allows it.
    """
    asked = unwind(models, "details", "d").select(
        F.col("d.model_path").alias("model_path"), "created_at", "_id", "dataset", "is_paid").join(
        paths.select("model_path").distinct(), "model_path")
    owner = F.struct("created_at", "_id", "dataset", "is_paid")  # a null date is the oldest
    return asked.groupBy("model_path").agg(F.max(owner).alias("_o")).select(
        "model_path", F.col("_o._id").alias("_id"), F.col("_o.dataset").alias("dataset"),
        F.col("_o.is_paid").alias("is_paid"))
