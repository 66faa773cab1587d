"""Whole jobs: what a user runs from end to end."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from retentia.operators import anomaly, ingest, merge, reports, scoring
from retentia.operators.training import registry_row, train_classifiers, train_regressors
from retentia.schemas import CATEGORICAL_FEATURES, ENTITY_ID, LABEL, NUMERIC_FEATURES, REGRESSION_TARGETS
from retentia.operators.quality import require_columns
from retentia.operators.shaping import rename_columns
from retentia.session import checkpointed
from retentia.sources import deliveries, files, tables


def merge_job(spark: SparkSession, new_path: str, root: str, schema) -> tuple[str, DataFrame]:
    """Merge a delivery into the current version of a table and publish the result.

    Returns the version and the records that do not fit the schema; those never reach the merge.
    """
    new, rejected = files.split_corrupt(checkpointed(files.read_csv(spark, new_path, schema, keep_corrupt=True)))
    old = tables.current(spark, root)
    stamp = "Update_Date_ts"
    merged = merge.merge_deliveries(new.limit(0) if old is None else old.drop(stamp), new)
    return tables.publish(merged, root, "student_data"), rejected


def store_delivery(new: DataFrame, root: str) -> str:
    """Store a delivery: its new rows into the dataset with the same header, or a new dataset."""
    return deliveries.store(new, deliveries.home_of(new, root))


def upload_and_train(df: DataFrame, key: str = ENTITY_ID, label: str = LABEL,
                     numeric: list[str] = NUMERIC_FEATURES, categorical: list[str] = CATEGORICAL_FEATURES,
                     targets: list[str] = REGRESSION_TARGETS, dataset: str = "dataset", root: str = "models",
                     user_id: str = "", username: str = "", is_paid: bool = False,
                     classifiers: list[str] | None = None) -> DataFrame:
    """Check the contract, train all models, append the run to the registry and return it."""
    rows = require_columns(rename_columns(df), [key, label, *numeric, *categorical])
    run = uuid.uuid4().hex
    details = train_classifiers(rows, key, label, numeric, categorical, dataset, root, classifiers, run=run)
    details += train_regressors(rows, key, targets, numeric, categorical, dataset, root, run=run)
    entry = registry_row(df.sparkSession, dataset, user_id, username, datetime.now(timezone.utc), is_paid, details)
    tables.append_rows(entry, f"{root}/trained_models")
    return df.sparkSession.read.parquet(f"{root}/trained_models").filter(F.col("dataset") == dataset)


def score_population(students: DataFrame, model, model_name: str, as_of) -> DataFrame:
    """The whole entity table with new predictions by a linear model."""
    return scoring.score_students(students, model, model_name, F.lit(as_of).cast("timestamp"))


def ingest_job(spark: SparkSession, upload: DataFrame, root: str, as_of,
               file_name: str | None = None) -> tuple[str, DataFrame]:
    """Type an upload, merge it into the entity table by id, publish; returns the rejected rows too.

    The last row of an id in the upload wins. A row with the original file name, the rows read, the rows ingested
    and the status is appended to ``datasets`` under ``root``; the counts are gathered while the table is written.
    """
    placed = ingest.with_position(upload)
    typed, rejected = ingest.ingest_students(placed, F.lit(as_of))
    seen = Observation()
    typed = typed.observe(seen, F.count("*").alias("ingested"))
    latest = merge.latest_per_key(typed, [ENTITY_ID], ["last_updated", ingest.POSITION]).drop(ingest.POSITION)
    rejected = rejected.drop(ingest.POSITION)
    old = tables.current(spark, root)
    version = tables.publish(latest if old is None else merge.upsert(old, latest, ENTITY_ID), root, "students")
    ingested = seen.get["ingested"]
    entry = rejected.agg(F.count("*").alias("_rejected")).select(
        F.lit(file_name).cast("string").alias("original_file_name"), F.lit(as_of).cast("timestamp").alias("uploaded_at"),
        (F.lit(ingested) + F.col("_rejected")).cast("long").alias("row_count"),
        F.lit(ingested).cast("long").alias("ingested_row_count"), F.lit("processed").alias("status"))
    tables.append_rows(entry, f"{root}/datasets")
    return version, rejected


def anomaly_report(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(flagged rows with their extreme feature, one-row insights) of an uploaded table."""
    chosen, features = anomaly.choose_features(df)
    found = checkpointed(anomaly.detect(chosen, key, features))
    return anomaly.explain_flagged(found, features), reports.anomaly_insights(found)
