"""Data-quality checks: contracts, row validation, field profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import (
    in_rating_range, is_blank, is_email, name_fingerprint, safe_float,
)
from retentia.schemas import NUMERIC_FEATURES, REQUIRED_COLUMNS

# ---- fixed values: messages of the form checks -------------------------------------------------
NAME_MESSAGES = {"fullname": "Full name is required.", "name": "Name is required."}
EMAIL_MISSING, EMAIL_INVALID = "Email is required.", "Invalid email format."
SUBJECT_MISSING, MESSAGE_MISSING = "Subject is required.", "Message is required."
RATING_INVALID = "Please select a rating."
# ------------------------------------------------------------------------------------------------


def absent_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    """Required columns the frame lacks, in contract order."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    absent = absent_columns(df, required)
    if absent:
        raise ValueError("missing required columns: " + ", ".join(absent))
    return df


def contract_report(df: DataFrame, required: list[str] = REQUIRED_COLUMNS,
                    numeric: list[str] = NUMERIC_FEATURES) -> DataFrame:
    """Per required column: present, rows, non-null and castable counts; one pass over the table."""
    measures, rows = [], []
    for c in required:
        present = c in df.columns
        value = F.col(c) if present else F.lit(None).cast("string")
        good = safe_float(value) if c in numeric else value
        measures += [F.count(value).alias(f"{c}|f"), F.count(good).alias(f"{c}|c")]
        rows.append((c, present))
    totals = df.agg(F.count("*").alias("rows"), *measures)
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(present).alias("present"), F.col("rows"),
                 F.col(f"`{c}|f`").alias("filled"), F.col(f"`{c}|c`").alias("castable"))
        for c, present in rows])))


def _errors(**checks: Column) -> Column:
    """Map of field -> message, with the passing fields left out."""
    pairs = reduce(lambda a, b: a + b, [[F.lit(k), v] for k, v in checks.items()])
    return F.map_filter(F.create_map(*pairs), lambda _, message: message.isNotNull())


def _email_error(c: Column) -> Column:
    return F.when(is_blank(c), EMAIL_MISSING).when(~is_email(c), EMAIL_INVALID)


def contact_errors(name: str = "fullname") -> Column:
    return _errors(
        fullname=F.when(is_blank(F.col(name)), NAME_MESSAGES["fullname"]),
        email=_email_error(F.col("email")),
        subject=F.when(is_blank(F.col("subject")), SUBJECT_MISSING),
        message=F.when(is_blank(F.col("message")), MESSAGE_MISSING))


def feedback_errors() -> Column:
    return _errors(
        name=F.when(is_blank(F.col("name")), NAME_MESSAGES["name"]),
        email=_email_error(F.col("email")),
        message=F.when(is_blank(F.col("message")), MESSAGE_MISSING),
        rating=F.when(~in_rating_range(F.col("rating")), RATING_INVALID))


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their error map."""
    checked = df.withColumn("errors", errors)
    return (checked.filter(F.size("errors") == 0).drop("errors"),
            checked.filter(F.size("errors") > 0))


def field_catalog(tables: dict[str, DataFrame], exact: bool = False) -> DataFrame:
    """Per table and field: rows, non-null rows and distinct values (estimated unless ``exact``)."""
    profile = _exact_profile if exact else _estimated_profile
    rows = [profile(df.drop("_id")).select(F.lit(name).alias("collection"), "*")
            for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _estimated_profile(df: DataFrame) -> DataFrame:
    """One aggregate of a few bytes per field; no value leaves its task."""
    measures = [m for c in df.columns for m in (
        F.count(c).alias(f"{c}|f"), F.approx_count_distinct(c, 0.02).alias(f"{c}|d"))]
    totals = df.agg(F.count("*").alias("rows"), *measures)
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col("rows"), F.col(f"`{c}|f`").alias("filled"),
                 F.col(f"`{c}|d`").alias("distinct_values")) for c in df.columns])))


def _exact_profile(df: DataFrame) -> DataFrame:
    """Cells counted per (field, value) first, so a frequent value is one row after the map side."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
        for c in df.columns])).alias("cell")).select("cell.*")
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return cells.groupBy("field", "value").agg(F.count("*").alias("n")).groupBy("field").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(known), F.lit(0)).alias("filled"),
        F.count("value").alias("distinct_values"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per column, one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in columns])))


def schema_fingerprints(names: DataFrame, file: str = "file", position: str = "position",
                        name: str = "name") -> DataFrame:
    """SHA-256 of the ordered column names of each delivered file.

    A group is the header of one file; its length is the number of columns of that file.
    """
    ordered = F.array_sort(F.collect_list(F.struct(position, name)))
    return names.groupBy(file).agg(ordered.alias("h")).select(
        file, name_fingerprint(F.transform("h", lambda e: e[name])).alias("fingerprint"))


def header_fingerprint(df: DataFrame) -> str:
    """Fingerprint of a frame's own header (names and order, not types)."""
    import hashlib

    return hashlib.sha256(",".join(df.columns).encode()).hexdigest()


def known_schemas(deliveries: DataFrame, registry: DataFrame) -> DataFrame:
    """Deliveries whose fingerprint is already registered."""
    return deliveries.join(registry.select("fingerprint").distinct(), "fingerprint", "left_semi")
