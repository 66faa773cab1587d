"""Ranks, exact quantiles and codes over whole tables without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.joins import lookup_join
from retentia.session import checkpointed

#: Rank error of the first look at a quantile; twice that share of the rows on both sides is looked at exactly.
NEAR = 1 / 2000


def ranged(values: DataFrame, *by: str) -> DataFrame:
    """``values`` cut into ranges in the order of ``by``, numbered by ``_range``.

    There are as many ranges as the session has shuffle partitions, less where adaptive execution finds little
    data. The rows are written through the shared folder, so every reader sees the same cuts.
    """
    return checkpointed(values.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))


def running_totals(values: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Add ``<measure>_before``: the total over all rows with a smaller ``by``.

    ``values`` holds one row per distinct ``by`` (aggregate first, so a hot value is one row). Each range of rows is
    summed, the range totals are accumulated, and the fine accumulation runs per range from its range's offset.
    """
    return accumulate(ranged(values, by), by, measures)


def accumulate(cut: DataFrame, by: str, measures: list[str], groups: tuple[str, ...] = ()) -> DataFrame:
    """Running totals over rows that carry an ordered ``_range``, within each of few ``groups``."""
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per group and range
    offsets = cut.groupBy(*groups, "_range").agg(*[F.sum(m).alias(m) for m in measures]).select(
        *groups, "_range", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_offset") for m in measures])
    inside = Window.partitionBy(*groups, "_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(offsets, [*groups, "_range"]).select(
        *[c for c in cut.columns if c != "_range"],
        *[(F.coalesce(F.sum(m).over(inside), F.lit(0)) + F.col(f"_{m}_offset")).alias(f"{m}_before")
          for m in measures])


def _by_feature(values: dict[str, float], kind: str) -> Column:
    """The value of the row's ``feature``."""
    table = F.create_map(*(x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast(kind))))
    return table[F.col("feature")]


def exact_quantiles(df: DataFrame, columns: list[str], p: float) -> DataFrame:
    """(feature, q) per column: the interpolated quantile over its known values; null when there is none.

    ``percentile`` would hold every distinct value in one task. Here three scans serve all columns together: an
    approximate look gives two bounds around each quantile, the rows below and between the bounds are counted, and
    only what lies between them (a few thousandths of the rows) is ranked over ranges of values.
    Bounds that turn out not to hold the wanted ranks are widened to all values. The driver sees two counts a column.
    """
    spark, names = df.sparkSession, list(dict.fromkeys(columns))
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names])
    probs = [max(p - 2 * NEAR, 0.0), min(p + 2 * NEAR, 1.0)]
    bounds = {c: b for c, b in zip(names, values.approxQuantile(names, probs, NEAR)) if b}
    every = spark.createDataFrame([(c,) for c in names], "feature string")
    if not bounds:
        return every.withColumn("q", F.lit(None).cast("double"))
    counts = values.agg(*[F.struct(
        F.count(c).alias("n"), F.count_if(F.col(c) < b[0]).alias("below"),
        F.count_if(F.col(c) <= b[1]).alias("up_to")).alias(c) for c, b in bounds.items()]).head()
    start, low, high, part = {}, {}, {}, {}
    for c, (least, most) in bounds.items():
        at = (counts[c]["n"] - 1) * p
        low[c], high[c], part[c], start[c] = math.floor(at), math.ceil(at), at - math.floor(at), counts[c]["below"]
        if not (counts[c]["below"] <= low[c] and high[c] < counts[c]["up_to"]):
            bounds[c], start[c] = [-math.inf, math.inf], 0
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).between(*b), F.col(c)).alias("value"))
                      for c, b in bounds.items()])
    near = values.select(F.inline(F.filter(cells, lambda cell: cell["value"].isNotNull())))
    each = near.groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranks = accumulate(ranged(each, "feature", "value"), "value", ["n"], ("feature",))
    first = F.col("n_before") + _by_feature(start, "long")
    holds = lambda rank: (first <= rank) & (first + F.col("n") > rank)
    ends = ranks.filter(holds(_by_feature(low, "long")) | holds(_by_feature(high, "long"))).groupBy("feature").agg(
        F.min("value").alias("a"), F.max("value").alias("b"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.col("a") + (F.col("b") - F.col("a")) * _by_feature(part, "double"))
    return every.join(ends.select("feature", q.alias("q")), "feature", "left")


def exact_quantile(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row ``q``: the interpolated quantile over all rows; null when there is none."""
    return exact_quantiles(df, [column], p).select("q")


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (feature, median) per column."""
    return exact_quantiles(df, columns, 0.5).withColumnRenamed("q", "median")


def category_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Add the position of each value among the sorted distinct values; null gets -1.

    The list of categories is range-partitioned, written through the shared folder and numbered range by
    range. The codes come back by a lookup join.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = running_totals(values.withColumn("one", F.lit(1).cast("long")), column, ["one"]).select(column, F.col("one_before").alias(code))
    joined = lookup_join(df, codes, [column], "left")
    return joined.withColumn(code, F.coalesce(F.col(code), F.lit(-1).cast("long"))).select(
        *df.columns, code)
