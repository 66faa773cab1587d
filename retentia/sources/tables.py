"""Sinks: appends, stored datasets and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from retentia.operators.quality import header_fingerprint
from retentia.sources.files import CSV_OPTIONS


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as as many files as there are partitions; ``read_csv`` reads it back, empty texts as null."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def store_dataset(df: DataFrame, root: str, name: str, user_id: str, is_paid: bool, uploaded_at) -> None:
    """Rows under ``data/dataset_name=.../upload=...`` and one metadata row in ``datasets``.

    Every upload has a folder of its own, so a second one under the same name leaves the first as it is. The row
    count is read back from the files just written, not by running the plan again.
    """
    spark = df.sparkSession
    upload = uuid.uuid4().hex
    path = f"{root}/data/dataset_name={name}/upload={upload}"
    df.write.parquet(path)
    append_rows(spark.read.parquet(path).agg(F.count("*").alias("record_count")).select(
        F.lit(name).alias("dataset_name"), F.lit(upload).alias("upload"), F.lit(user_id).alias("user_id"),
        F.lit(is_paid).alias("is_paid"), F.lit(uploaded_at).cast("timestamp").alias("uploaded_at"),
        "record_count"), f"{root}/datasets")


def store_tagged(df: DataFrame, path: str) -> str:
    """Append rows partitioned by the fingerprint of their header; returns the fingerprint."""
    tag = header_fingerprint(df)
    append_rows(df.withColumn("hash", F.lit(tag)), path, ["hash"])
    return tag


def delete_tagged(spark: SparkSession, path: str, tag: str, new_path: str) -> None:
    """Write the table without one fingerprint to a new path; the other partitions are untouched."""
    spark.read.parquet(path).filter(F.col("hash") != tag).write.partitionBy("hash").parquet(new_path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A log of JSON lines; None before the first."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    return read_log(spark, f"{root}/versions", "version int, name string")


def publish(df: DataFrame, root: str, prefix: str = "dataset") -> str:
    """Write a new numbered version, then make it current by appending to the version log.

    The input may be the current version: nothing that is being read is overwritten, and a job that
    dies half-way leaves the former version current. One writer at a time.
    """
    spark = df.sparkSession
    log = _log(spark, root)
    number = 1 if log is None else log.agg(F.count_distinct("version")).head()[0] + 1
    name = f"{prefix}_{number}"
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark.range(1).select(F.lit(number).alias("version"), F.lit(name).alias("name")).write.mode(
        "append").json(f"{root}/versions")
    return name


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, or None before the first."""
    log = _log(spark, root)
    if log is None:
        return None
    return spark.read.parquet(f"{root}/{log.agg(F.max_by('name', 'version')).head()[0]}")
