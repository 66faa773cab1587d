"""Batch scoring of a whole population and model-based filling of gaps."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import age_years
from retentia.operators.explain import (
    ensemble_leaves, linear_contributions, recommendations, tree_contributions,
)
from retentia.operators.features import known_number
from retentia.operators.regressions import LinearFit
from retentia.operators.selection import with_features
from retentia.operators.training import class_one_probability, feature_names


def _with_age(flat: DataFrame, born: str, as_of: Column) -> DataFrame:
    """The age follows from the birth date when there is one."""
    known = F.col("age") if "age" in flat.columns else F.lit(None)
    return flat.withColumn("age", F.coalesce(age_years(F.col(born), as_of), known).cast("double")).drop(born)


def scoring_frame(students: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Entities with features as flat rows with their age."""
    return _with_age(with_features(students).select(key, "dateOfBirth", "ml_features.*"), "dateOfBirth", as_of)


def fill_missing(df: DataFrame, regressors: dict[str, LinearFit | PipelineModel]) -> DataFrame:
    """Fill each numeric column by its regressor, then by 0; columns filled earlier feed later ones.

    Narrow: every model is an expression or a stage of the same pass.
    """
    columns = df.columns
    for target, model in regressors.items():
        known = known_number(df, target)
        if isinstance(model, LinearFit):
            df = df.withColumn(target, F.coalesce(known, model.predicted(df), F.lit(0.0)))
        else:
            df = model.transform(df.withColumn("_known", known)).withColumn(
                target, F.coalesce("_known", "prediction", F.lit(0.0))).select(*columns)
    return df


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns without a regressor fall back to 0."""
    return df.fillna(0.0, subset=columns)


def fill_and_score(df: DataFrame, regressors: dict[str, LinearFit | PipelineModel], numeric: list[str], model: PipelineModel,
                   key: str, model_name: str, at: Column) -> DataFrame:
    """Every row scored after its gaps were filled: by the column's regressor, by 0 where there is none.

    (``key``, the filled ``numeric`` columns, prediction struct with advice by a linear model); one narrow pass.
    """
    filled = fill_zero(fill_missing(df, regressors), [c for c in numeric if c not in regressors])
    rows = model.transform(filled)
    return rows.select(key, *numeric, _prediction(class_one_probability(), _advice(rows, model), model_name, at))


def score(df: DataFrame, model: PipelineModel, key: str) -> DataFrame:
    """(key, class, probability of class 1) for every row."""
    return model.transform(df).select(
        key, F.col("prediction").cast("int").alias("prediction_class"),
        class_one_probability().alias("prediction_probability"))


def training_means(model: PipelineModel) -> list[float]:
    """Mean of every feature over the rows the model was trained on."""
    return list(next(s for s in model.stages if isinstance(s, StandardScalerModel)).mean)


def _advice(rows: DataFrame, model: PipelineModel) -> Column:
    """Advice from exact linear contributions against the training means stored with the model."""
    names = feature_names(rows)
    return recommendations(linear_contributions(names, list(model.stages[-1].coefficients), training_means(model)))


def _prediction(p: Column, advice: Column, model_name: str, at: Column) -> Column:
    return F.struct(
        F.col("prediction").cast("int").alias("class"), p.alias("probability"),
        advice.alias("recommendations"), F.lit(model_name).alias("model_used"),
        at.cast("timestamp").alias("timestamp")).alias("prediction")


def score_linear(df: DataFrame, model: PipelineModel, key: str, model_name: str, at: Column) -> DataFrame:
    """(key, prediction struct with advice); one narrow pass."""
    rows = model.transform(df)
    return rows.select(key, _prediction(class_one_probability(), _advice(rows, model), model_name, at))


def score_students(students: DataFrame, model: PipelineModel, model_name: str, at: Column) -> DataFrame:
    """Every entity, those with features with a new prediction; no join and no shuffle."""
    columns = [c for c in students.columns if c != "prediction"]
    whole = students.filter(F.col("ml_features").isNotNull()).select(
        F.struct(*columns).alias("_row"), F.col("dateOfBirth").alias("_born"), "ml_features.*")
    rows = model.transform(_with_age(whole, "_born", at))
    scored = rows.select("_row.*", _prediction(class_one_probability(), _advice(rows, model), model_name, at))
    rest = students.filter(F.col("ml_features").isNull())
    return scored.unionByName(rest, allowMissingColumns=True)


def score_trees(df: DataFrame, model: PipelineModel, saved_path: str, key: str, model_name: str,
                at: Column) -> DataFrame:
    """(key, prediction struct with advice from tree contributions).

    Every row is prepared; those that no test of the trees tells apart are scored and explained together.
    """
    rows = PipelineModel(model.stages[:-1]).transform(df)
    stage = model.stages[-1]
    leaves = ensemble_leaves(df.sparkSession, f"{saved_path}/stages/{len(model.stages) - 1}_{stage.uid}",
                             list(stage.treeWeights), "Forest" in type(stage).__name__)
    told = tree_contributions(
        rows, key, leaves, feature_names(rows), judged=("prediction", "_p"),
        judge=lambda cells: stage.transform(cells).withColumn("_p", class_one_probability()))
    return told.select(key, _prediction(F.col("_p"), recommendations(F.col("contributions")), model_name, at))


def with_predictions(students: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """Entities with their new prediction; entities that were not scored keep the old one."""
    kept = students.drop("prediction") if "prediction" not in students.columns else (
        students.withColumnRenamed("prediction", "_old"))
    joined = kept.join(scored.select(key, F.col("prediction").alias("_new")), key, "left")
    old = [F.col("_old")] if "_old" in joined.columns else []
    return joined.withColumn("prediction", F.coalesce("_new", *old)).drop("_new", "_old")
