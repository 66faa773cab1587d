"""From an uploaded text table to typed, nested entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import derived_label, ingest_bool, label_parse, safe_float
from retentia.operators.selection import split_on_key
from retentia.operators.shaping import rename_columns
from retentia.schemas import (
    BOOLEAN_FEATURES, CATEGORICAL_FEATURES, ENTITY_ID, LABEL, NUMERIC_FEATURES,
)

TOP_LEVEL = ["gender", "highSchoolGPA", "currentGPA"]


def typed_feature(name: str) -> Column:
    c = F.col(name)
    if name in NUMERIC_FEATURES:
        return safe_float(c).alias(name)
    if name in BOOLEAN_FEATURES:
        return ingest_bool(c).alias(name)
    return c.cast("string").alias(name)


#: Place of a row in its upload: rows later in the file overrule earlier ones.
POSITION = "_position"


def with_position(upload: DataFrame) -> DataFrame:
    """Number the rows in reading order; the numbers rise through each file and are not gapless."""
    return upload.withColumn(POSITION, F.monotonically_increasing_id())


def ingest_students(upload: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows): casts, booleans, label, nested features, one narrow pass.

    Rows without a usable id are rejected. A missing label is derived from GPA and attendance. A position
    column from ``with_position`` is kept.
    """
    named = rename_columns(upload)
    position = [POSITION] if POSITION in named.columns else []
    for c in [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, LABEL]:
        if c not in named.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    keyed, rejected = split_on_key(named, ENTITY_ID)
    nested = [c for c in [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES] if c not in TOP_LEVEL]
    label = F.coalesce(
        label_parse(F.col(LABEL)),
        derived_label(safe_float(F.col("currentGPA")), safe_float(F.col("attendance"))))
    typed = keyed.select(
        ENTITY_ID, *[typed_feature(c) for c in TOP_LEVEL],
        F.struct(*[typed_feature(c) for c in nested]).alias("ml_features"),
        label.alias(LABEL), as_of.cast("timestamp").alias("last_updated"), *position)
    return typed, rejected


def ingest_counts(upload: DataFrame, key: str) -> DataFrame:
    """Rows read, ingested and rejected for a missing key."""
    from retentia.functions.scalars import is_blank

    blank = F.count_if(is_blank(F.col(key).cast("string")))
    return upload.agg(F.count("*").alias("rows_read"), (F.count("*") - blank).alias("ingested"),
                      blank.alias("rejected"))


def observed(df: DataFrame, key: str, name: str = "ingest"):
    """(frame, observation): the same counts gathered while the frame is written, with no extra pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows_read"),
                      F.count_if(F.col(key).isNotNull()).alias("ingested")), seen
