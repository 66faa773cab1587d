"""Training: one preprocessing pipeline per model, classifiers, per-column regressors, registry rows."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import label_map, number_column
from retentia.operators import regressions
from retentia.operators.features import MISSING, in_holdout, known_number, stratified_holdout
from retentia.operators.metrics import (
    class_weights, classification_metrics, regression_metrics, roc_auc,
)
from retentia.operators.regressions import LinearFit
from retentia.schemas import MODEL_DETAIL, TRAINED_MODELS

# ---- fixed values: model settings ----------------------------------------------------------------
SEED = 42
TREES = 100
MAX_ITER = 1000
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP = 100, 3, 0.1
FOREST_DEPTH = 12  # default of an argument; Spark allows up to 30
MIN_REGRESSION_ROWS = 10
# --------------------------------------------------------------------------------------------------


def _number(value: float | None, default: float) -> str:
    return f"{default if value is None else value!r}D"


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> PipelineModel:
    """Mean-impute and standardise numbers, one-hot categories with a 'missing' value.

    Means and deviations of the imputed columns come from one aggregate and are stored as constants
    of a SQL stage. Imputing by the mean scales the variance by the share of known values. An
    unknown category maps to all zeros.
    """
    stats = train.agg(
        F.count("*").alias("rows"),
        *[F.struct(F.avg(k).alias("m"), F.var_pop(k).alias("v"), F.count(k).alias("n")).alias(f"s_{c}")
          for c, k in ((c, known_number(train, c)) for c in numeric)]).head()
    parts = []
    for c in numeric:
        s = stats[f"s_{c}"]
        spread = ((s["v"] or 0.0) * s["n"] / max(stats["rows"], 1)) ** 0.5
        mean = _number(s["m"], 0.0)
        parts.append(f"(coalesce(nanvl(cast(`{c}` AS double), null), {mean}) - {mean}) / {_number(spread or 1.0, 1.0)} AS `{c}__z`")
    parts += [f"coalesce(cast(`{c}` AS string), '{MISSING}') AS `{c}__c`" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    if categorical:
        index = [f"{c}__i" for c in categorical]
        stages += [
            StringIndexer(inputCols=[f"{c}__c" for c in categorical], outputCols=index,
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=[f"{c}__o" for c in categorical]),
        ]
    stages.append(VectorAssembler(
        inputCols=[f"{c}__z" for c in numeric] + [f"{c}__o" for c in categorical],
        outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def feature_names(transformed: DataFrame) -> list[str]:
    """Names by vector position: ``column`` or ``column_value``."""
    groups = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    attrs = sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])
    return [a["name"].replace("__z", "").replace("__o_", "_") for a in attrs]


def save_and_reload(stages: list, path: str) -> PipelineModel:
    """The model as later readers get it; evaluation uses the stored artefact.

    A freshly fitted model also drags its training summary, and with it the session, into every task.
    """
    PipelineModel(stages).write().overwrite().save(path)
    return PipelineModel.load(path)


def class_one_probability() -> Column:
    return vector_to_array("probability")[1]


def classifiers(rows: int, seed: int = SEED, forest_depth: int = FOREST_DEPTH) -> dict:
    return {
        "random_forest": RandomForestClassifier(
            labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=forest_depth, seed=seed),
        # the penalty of the whole-sample loss with unit strength, per row
        "logistic_regression": LogisticRegression(
            labelCol="label", maxIter=MAX_ITER, regParam=1.0 / max(rows, 1), standardization=False),
        "gradient_boosting": GBTClassifier(
            labelCol="label", maxIter=BOOST_ROUNDS, maxDepth=BOOST_DEPTH, stepSize=BOOST_STEP, seed=seed),
    }


def split_labelled(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a 0/1 ``label``, rows whose label is unusable)."""
    mapped = df.withColumn("label", label_map(F.col(label)).cast("double"))
    return mapped.filter(F.col("label").isNotNull()), mapped.filter(F.col("label").isNull()).drop("label")


def weighted(df: DataFrame) -> DataFrame:
    """Add balanced class weights (one row per class, broadcast)."""
    return df.join(F.broadcast(class_weights(df, "label")), "label")


def train_classifiers(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str],
                      dataset: str, root: str, names: list[str] | None = None,
                      seed: int = SEED, forest_depth: int = FOREST_DEPTH, run: str | None = None) -> list[dict]:
    """Fit, evaluate on a stratified hold-out and save each classifier with its own preprocessing.

    Models are stored below a folder of the ``run``, a new one by default, so that no run replaces another's.
    """
    run = run or uuid.uuid4().hex
    usable, _ = split_labelled(df, label)
    # the narrow frame is kept: the split reads it three times, statistics, encodings, weights and the hold-out its result
    narrow = usable.select(key, "label", *numeric, *categorical).persist()
    kept = stratified_holdout(narrow, key, "label", seed).withColumnRenamed("is_test", "_test").persist()
    train, test = kept.filter(~F.col("_test")), kept.filter("_test")
    prep = fit_preprocessor(train, numeric, categorical)
    fit_rows = weighted(prep.transform(train).select("label", "features")).persist()
    test_rows = prep.transform(test).select("label", "features").persist()
    # scales nothing: it keeps the training means of the features, the base of linear contributions
    means = StandardScaler(inputCol="features", outputCol="features_unscaled", withMean=False, withStd=False).fit(fit_rows)
    results = []
    try:
        for name, estimator in classifiers(fit_rows.count(), seed, forest_depth).items():
            if names and name not in names:
                continue
            model = estimator.fit(fit_rows)
            path = f"{root}/{dataset}/{run}/{name}/{label}_{name}"
            saved = save_and_reload([*prep.stages, means, model], path)
            scored = saved.stages[-1].transform(test_rows).select(
                "label", "prediction", class_one_probability().alias("p")).persist()
            metrics = classification_metrics(scored).head().asDict()
            metrics["roc_auc"] = roc_auc(scored, score="p").head()["roc_auc"]
            scored.unpersist()
            results.append({"type": "classification", "target": label, "model_name": name,
                            "metrics": {k: v for k, v in metrics.items() if v is not None},
                            "model_path": path})
    finally:
        for frame in (fit_rows, test_rows, kept, narrow):
            frame.unpersist()
    return results


def train_regressors(df: DataFrame, key: str, targets: list[str], numeric: list[str],
                     categorical: list[str], dataset: str, root: str, seed: int = SEED,
                     run: str | None = None) -> list[dict]:
    """A linear regression per numeric column on the other columns; short targets are skipped.

    All targets share two passes over the rows and are solved in closed form (``regressions``), so the number of jobs does
    not depend on theirs. Only where the category values are too many for that is each target fitted iteratively.
    """
    run = run or uuid.uuid4().hex
    columns = list(dict.fromkeys([*numeric, *targets]))
    typed = df.select(key, *[number_column(df, c) for c in columns], *categorical)
    rows = typed.select(*[known_number(typed, c).alias(c) for c in columns], *[F.coalesce(
        F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in categorical], in_holdout(F.col(key), seed).alias("_test"))
    layout = regressions.survey(rows, columns, categorical)
    if layout is None:
        return _fit_one_by_one(typed, key, targets, numeric, categorical, f"{root}/{dataset}/{run}/lr", seed)
    sums = regressions.products(rows, layout, targets, "_test")
    path, fits, found = f"{root}/{dataset}/{run}/{regressions.FOLDER}", [], []
    for k, target in enumerate(targets):
        train, test = sums[k, False], sums[k, True]
        if train[0, 0] + test[0, 0] < MIN_REGRESSION_ROWS:
            continue
        fit, metrics = regressions.solve(layout, target, [c for c in numeric if c != target], train, test)
        fits.append(fit)
        found.append({"type": "regression", "target": target, "model_name": "linear_regression", "metrics": metrics,
                      "model_path": f"{path}/{target}"})
    if fits:
        regressions.save_fits(df.sparkSession, fits, path)
    return found


def _fit_one_by_one(typed: DataFrame, key: str, targets: list[str], numeric: list[str], categorical: list[str], folder: str,
                    seed: int) -> list[dict]:
    """One iterative fit a target on sparse vectors."""
    typed = typed.withColumn("_test", in_holdout(F.col(key), seed)).persist()
    out = []
    try:
        known = typed.agg(*[F.count(t).alias(t) for t in targets]).head()
        for target in targets:
            if known[target] < MIN_REGRESSION_ROWS:
                continue
            rows = typed.filter(F.col(target).isNotNull()).withColumn("label", F.col(target))
            train, test = rows.filter(~F.col("_test")), rows.filter("_test")
            prep = fit_preprocessor(train, [c for c in numeric if c != target], categorical)
            model = LinearRegression(labelCol="label").fit(prep.transform(train).select("label", "features"))
            path = f"{folder}/{target}"
            scored = save_and_reload([*prep.stages, model], path).transform(test).select("label", "prediction")
            metrics = regression_metrics(scored).head().asDict()
            out.append({"type": "regression", "target": target, "model_name": "linear_regression",
                        "metrics": {k: v for k, v in metrics.items() if v is not None}, "model_path": path})
    finally:
        typed.unpersist()
    return out


def load_regressor(spark, path: str) -> LinearFit | PipelineModel:
    """A model that ``train_regressors`` has stored."""
    closed = path.rpartition("/")[0].endswith(f"/{regressions.FOLDER}")
    return regressions.load_fit(spark, path) if closed else PipelineModel.load(path)


def registry_row(spark, dataset: str, user_id: str, username: str, created_at, is_paid: bool,
                 details: list[dict]) -> DataFrame:
    """One row for the append-only registry, its models nested."""
    return spark.createDataFrame([{
        "_id": f"{dataset}@{created_at}", "dataset": dataset,
        "trained_by": {"userId": user_id, "username": username}, "created_at": created_at,
        "is_paid": is_paid, "details": details}], TRAINED_MODELS)


def details_frame(spark, details: list[dict]) -> DataFrame:
    return spark.createDataFrame(details, MODEL_DETAIL)
