"""Merging deliveries: latest record per key, unions, upserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.functions.scalars import UPDATE_DATE_FORMAT, parse_update_date
from retentia.operators.joins import lookup_join

_UNORDERED = ("map", "variant")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``; null orders lowest and ties fall to the other columns.

    ``max`` of one struct combines on the map side, so a key that holds a third of the rows reaches
    the shuffle as one row per task. A struct cannot be hashed in place: each task sorts its own rows by key
    before and after the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    # anywhere inside a type: a map in an array has no order either
    unordered = [c for c in rest if any(f"{t}<" in f"{df.schema[c].dataType.simpleString()}<" for t in _UNORDERED)]
    ordered = [*order, *[c for c in rest if c not in unordered]]
    if unordered:  # maps have no order: carried along by the same maximum
        kept = df.groupBy(*keys).agg(
            F.max_by(F.struct(*order, *rest), F.struct(*ordered)).alias("_last"))
    else:
        kept = df.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_last"))
    return kept.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in df.columns])


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Union by name without exact duplicate rows."""
    return union_all(*frames).dropDuplicates()


def merge_deliveries(old: DataFrame, new: DataFrame, key: str = "Student ID",
                     stamp: str = "Update Date", fmt: str = UPDATE_DATE_FORMAT) -> DataFrame:
    """Old and new rows, the latest per key by its text date; the new delivery wins a tie."""
    both = union_all(old.withColumn("_source", F.lit(0)), new.withColumn("_source", F.lit(1)))
    dated = both.withColumn(f"{stamp.replace(' ', '_')}_ts", parse_update_date(F.col(stamp), fmt))
    order = [f"{stamp.replace(' ', '_')}_ts", "_source"]
    return latest_per_key(dated, [key], order).drop("_source")


def upsert(target: DataFrame, changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Update matching rows and insert new ones.

    Columns named in ``changes`` take its value even when null; other columns keep theirs.
    ``order`` picks the winning change when a key changes more than once.
    """
    if order:
        changes = latest_per_key(changes, [key], order)
    fresh = changes.select(F.col(key), F.struct(*[c for c in changes.columns if c != key]).alias("_new"))
    joined = target.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    named = [c for c in changes.columns if c != key]
    changed = F.col("_new").isNotNull()
    columns = [F.col(key)]
    for c in [c for c in target.columns if c != key]:
        columns.append(F.when(changed, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
                       if c in named else F.col(c))
    columns += [F.col("_new")[c].alias(c) for c in named if c not in target.columns]
    return joined.select(*columns)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Set columns where the condition holds."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def update_matching(df: DataFrame, keys: DataFrame, on: list[str], **values: Column) -> DataFrame:
    """Set columns on rows whose key appears in ``keys`` (e.g. a set of verified addresses)."""
    marks = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    out = lookup_join(df, marks, on, "left")
    return update_where(out, F.col("_hit"), **values).select(*df.columns)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; an unknown condition keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return lookup_join(df, keys.select(*on).distinct(), on, "left_anti")
