"""Incremental ingest: files dropped into a landing folder become the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.operators.merge import latest_per_key
from retentia.sources.files import CORRUPT, CSV_OPTIONS, split_corrupt
from retentia.sources.tables import current, publish


def run_incremental(spark: SparkSession, landing: str, table: str, schema: T.StructType,
                    keys: list[str], order: list[str], prepare=None, files_per_batch: int = 1000) -> None:
    """Take in every file not yet seen, then stop.

    Each micro-batch is reduced to one row per key and written under its own ``batch_id``; a retried
    batch overwrites exactly its own folder. The cost of a batch depends on the batch, not on the
    table. An older record that arrives late loses when the table is read, so no watermark is needed.
    ``prepare`` types the text rows (e.g. parses dates) before the reduction. Records that do not fit the
    schema are kept under ``rejected``.
    """
    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_corrupt(batch)
        rows = prepare(good) if prepare else good
        latest_per_key(rows, keys, order).write.mode("overwrite").parquet(
            f"{table}/deltas/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{table}/rejected/batch_id={batch_id}")

    stream = (spark.readStream.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
              .options(**CSV_OPTIONS).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT)
              .option("maxFilesPerTrigger", files_per_batch).csv(landing))
    query = (stream.writeStream.foreachBatch(merge_batch)
             .option("checkpointLocation", f"{table}/progress").trigger(availableNow=True).start())
    query.awaitTermination()


def read_incremental(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key over the compacted version and the batches after it."""
    deltas = spark.read.parquet(f"{table}/deltas")
    base = current(spark, f"{table}/base")
    if base is not None:
        upto = base.agg(F.max("_upto")).scalar()
        deltas = deltas.filter(F.col("batch_id") > upto)
        rows = deltas.drop("batch_id").unionByName(base.drop("_upto"))
    else:
        rows = deltas.drop("batch_id")
    return latest_per_key(rows, keys, order)


def compact(spark: SparkSession, table: str, keys: list[str], order: list[str]) -> None:
    """Fold the batches so far into a new version of the base."""
    upto = spark.read.parquet(f"{table}/deltas").agg(F.max("batch_id").cast("int")).head()[0]
    publish(read_incremental(spark, table, keys, order).withColumn("_upto", F.lit(upto)), f"{table}/base")
