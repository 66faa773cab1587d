"""Field catalogues that add up: counters and distinct-value sketches of every delivery.

A delivery is profiled once, by one aggregate over its own rows, and appended to the profile table: rows, filled
cells and a HyperLogLog sketch (16 KiB) per field. The catalogue of a version merges the sketches of the deliveries it is made
of, so a new version costs a scan of what is new and the old rows are never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a sketch: a relative standard error of about 0.8 %.
LOG_REGISTERS = 14
SCHEMA = "collection string, version int, field string, rows long, filled long, sketch binary"


def _cell(df: DataFrame, column: str) -> Column:
    """The value as text, as the exact catalogue counts it; an empty text is a value."""
    c = F.col(f"`{column}`")
    nested = df.schema[column].dataType.typeName() in ("struct", "array", "map")
    return F.when(c.isNotNull(), F.concat(F.lit("="), F.to_json(F.struct(c)) if nested else c.cast("string")))


def profile(df: DataFrame, collection: str, version: int) -> DataFrame:
    """One row per field of a delivery; map-side sketches are merged, so a task ships 16 KiB a field."""
    measures = [m for i, c in enumerate(df.columns) for m in (
        F.count(F.col(f"`{c}`")).alias(f"f{i}"), F.hll_sketch_agg(_cell(df, c), F.lit(LOG_REGISTERS)).alias(f"s{i}"))]
    totals = df.agg(F.count("*").alias("rows"), *measures)
    return totals.select(F.inline(F.array(*[F.struct(
        F.lit(collection).alias("collection"), F.lit(version).alias("version"), F.lit(c).alias("field"),
        F.col("rows"), F.col(f"f{i}").alias("filled"), F.col(f"s{i}").alias("sketch"))
        for i, c in enumerate(df.columns)])))


def record(df: DataFrame, home: str, collection: str, version: int) -> None:
    """Append the profile of a delivery. Versions of a collection are numbered from 1, each recorded once."""
    profile(df, collection, version).coalesce(1).write.mode("append").parquet(f"{home}/profiles")  # a row a field


def profiles(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{home}/profiles")


def catalogue(stored: DataFrame, up_to: int | None = None) -> DataFrame:
    """(collection, field, rows, filled, distinct_values) over the deliveries up to a version, all by default.

    Rows of deliveries that lack a field count as rows with a gap in it. Distinct values are estimated.
    """
    chosen = stored if up_to is None else stored.filter(F.col("version") <= up_to)
    sizes = chosen.groupBy("collection", "version").agg(F.max("rows").alias("rows")).groupBy("collection").agg(
        F.sum("rows").alias("rows"))
    fields = chosen.groupBy("collection", "field").agg(
        F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
    return fields.join(sizes, "collection").select("collection", "field", "rows", "filled", "distinct_values")


def gaps(stored: DataFrame, up_to: int | None = None) -> DataFrame:
    """(collection, field, nulls) from the same counters."""
    return catalogue(stored, up_to).select("collection", "field", (F.col("rows") - F.col("filled")).alias("nulls"))


def growth(stored: DataFrame) -> DataFrame:
    """(collection, field, version, new_values): how many values a delivery brought that no earlier one had, estimated.

    Sketches are accumulated version by version within a field: one row a delivery, not a row of data.
    """
    earlier = stored.alias("a").join(stored.alias("b"), F.expr(
        "a.collection = b.collection and a.field = b.field and b.version <= a.version"))
    upto = earlier.groupBy("a.collection", "a.field", "a.version").agg(
        F.hll_sketch_estimate(F.hll_union_agg("b.sketch")).alias("with_it"),
        F.hll_sketch_estimate(F.hll_union_agg(F.when(F.expr("b.version < a.version"), F.col("b.sketch")))).alias("before"))
    return upto.select("collection", "field", "version", F.greatest(
        F.col("with_it") - F.coalesce("before", F.lit(0)), F.lit(0)).alias("new_values"))
