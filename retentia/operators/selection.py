"""Filters, sorting, limits and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import blank_to_null, is_blank, strip


def matching(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of equalities."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in equal.items()]))


def push_audience(users: DataFrame, role: str | None = None) -> DataFrame:
    """Users that can be notified: notifications on and a subscription present."""
    able = F.col("notifications_enabled") & F.col("push_subscription").isNotNull()
    return users.filter(able if role is None else able & (F.col("role") == role))


def any_present(*paths: str) -> Column:
    """True when at least one (nested) path holds a value."""
    return reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in paths])


def role_in(targets: str, role: str) -> Column:
    """Membership of a role in an array column."""
    return F.coalesce(F.array_contains(targets, role), F.lit(False))


def as_array(column: str, df: DataFrame) -> Column:
    """A scalar-or-array field as an array."""
    if df.schema[column].dataType.typeName() == "array":
        return F.col(column)
    return F.when(F.col(column).isNotNull(), F.array(column))


def any_element(array: str, field: str, value) -> Column:
    """True when some struct element has ``field`` equal to ``value``."""
    return F.coalesce(F.exists(array, lambda e: e[field] == F.lit(value)), F.lit(False))


def equals_ignore_case(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.lower()


def entitled(df: DataFrame, plan: str) -> DataFrame:
    """Premium plans see everything, others only rows that are not paid."""
    return df if plan == "premium" else df.filter(~F.col("is_paid"))


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns)


def split_on_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable key (trimmed) and the rejected rest."""
    blank = is_blank(F.col(key).cast("string"))
    return df.filter(~blank).withColumn(key, strip(F.col(key).cast("string"))), df.filter(blank)


def with_features(df: DataFrame, column: str = "ml_features") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def not_expired(df: DataFrame, as_of, column: str = "expires_at", grace_seconds: int = 0) -> DataFrame:
    """Rows still valid at ``as_of``, optionally with a grace period."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(grace_seconds)} SECONDS")
    return df.filter(F.col(column) >= limit)


def search(df: DataFrame, text: str, columns: list[str] | None = None,
           status: str | None = None, status_column: str = "status") -> DataFrame:
    """Rows with some column that contains the text, in any case; all text columns by default."""
    columns = columns or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    hit = reduce(lambda a, b: a | b,
                 [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in columns])
    if status is not None and status != "all":
        hit = hit & (F.col(status_column) == status)
    return df.filter(hit)


SORTS = {  # the orders a listing offers
    "name-asc": ("name", True), "name-desc": ("name", False),
    "date-asc": ("date", True), "date-desc": ("date", False),
}


def sorted_by(df: DataFrame, option: str, name: str, date: str, tie: str) -> DataFrame:
    kind, ascending = SORTS[option]
    c = F.col(name if kind == "name" else date)
    return df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), tie)


def newest_first(df: DataFrame, column: str, tie: str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(column).desc_nulls_last(), tie)
    return out if limit is None else out.limit(limit)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a declared order (one top-n per task, merged)."""
    return df.orderBy(*order).limit(n)


def find_many(df: DataFrame, condition: Column | None = None, columns: list[str] | None = None,
              order: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Filter, project and limit, by default to 100 rows."""
    out = df if condition is None else df.filter(condition)
    if order:
        out = out.orderBy(*order)
    return (out.select(*columns) if columns else out).limit(limit)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a declared order; for far pages use ``page_after``."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last_key, size: int) -> DataFrame:
    """The next page after a unique key; its cost does not grow with the page number."""
    return df.filter(F.col(key) > F.lit(last_key)).orderBy(key).limit(size)


def empty_text_as_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: blank_to_null(F.col(c)) for c in columns})
