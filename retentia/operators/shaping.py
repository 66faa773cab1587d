"""Projections and reshaping of nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.schemas import HEADER_ALIASES


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; absent ones are ignored."""
    return df.drop(*names)


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename by mapping (the known header spellings by default); absent names are ignored.

    Where several columns of the table get one name, the first that is not null counts, the right spelling first.
    """
    mapping = HEADER_ALIASES if mapping is None else mapping
    names: dict[str, list[str]] = {}
    for c in df.columns:
        names.setdefault(mapping.get(c, c), []).append(c)
    if all(len(own) == 1 for own in names.values()):
        return df.withColumnsRenamed({c: mapping[c] for c in df.columns if c in mapping})
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[
        quoted(own[0]).alias(name) if len(own) == 1 else F.coalesce(
            *[quoted(c) for c in sorted(own, key=lambda c: c != name)]).alias(name) for name, own in names.items()])


def add_missing(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add each absent column as ``name -> (type, default)``."""
    absent = {n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def first_present(df: DataFrame, names: list[str], default: str) -> Column:
    """First non-null of the named columns that exist, else a literal."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))


def nest(df: DataFrame, into: str, columns: list[str]) -> DataFrame:
    """Move flat columns into one struct column."""
    return df.withColumn(into, F.struct(*columns)).drop(*columns)


def flatten(df: DataFrame, struct_column: str) -> DataFrame:
    """Struct fields become columns next to the other columns."""
    return df.select(*[c for c in df.columns if c != struct_column], f"{struct_column}.*")


def unwind(df: DataFrame, array_column: str, alias: str | None = None,
           position: str | None = None) -> DataFrame:
    """One row per element; rows with an empty or null array disappear."""
    alias = alias or array_column
    rest = [c for c in df.columns if c != array_column]
    if position:
        return df.select(*rest, F.posexplode(array_column).alias(position, alias))
    return df.select(*rest, F.explode(array_column).alias(alias))


def promote(df: DataFrame, struct_column: str) -> DataFrame:
    """The struct's fields replace the row."""
    return df.select(f"{struct_column}.*")


def set_nested(df: DataFrame, struct_column: str, **fields: Column) -> DataFrame:
    """Set fields of a struct and keep its other fields."""
    value = F.col(struct_column)
    for name, column in fields.items():
        value = value.withField(name, column)
    return df.withColumn(struct_column, value)


def push_element(df: DataFrame, array_column: str, element: Column,
                 when: Column | None = None) -> DataFrame:
    """Append one element to each row's array (created when null), optionally under a condition."""
    element_type = df.schema[array_column].dataType.elementType
    current = F.coalesce(F.col(array_column), F.array().cast(T.ArrayType(element_type)))
    pushed = F.array_append(current, element.cast(element_type))
    return df.withColumn(array_column, pushed if when is None
                         else F.when(when, pushed).otherwise(F.col(array_column)))


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature",
            value: str = "value") -> DataFrame:
    """One row per (id, column); the columns must share a type."""
    return df.unpivot(ids, columns, name, value)


def flatten_predictions(students: DataFrame) -> DataFrame:
    """Scored entities as flat rows for consumers; unscored ones are left out."""
    p = F.col("prediction")
    from retentia.functions.scalars import iso_text

    return students.filter(p["class"].isNotNull()).select(
        first_present(students, ["name"], "N/A").alias("student_name"),
        first_present(students, ["studentID", "student_id"], "N/A").alias("student_id"),
        p["class"].alias("prediction_class"),
        p["probability"].alias("prediction_probability"),
        p["recommendations"].alias("recommendations"),
        iso_text(p["timestamp"]).alias("prediction_timestamp"),
        p["model_used"].alias("model_used"),
    )
