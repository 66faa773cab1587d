"""Feature statistics, imputation, scaling, encoding and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.scalars import hash_bucket, str_to_bool
from retentia.operators.shaping import add_missing
from retentia.schemas import BOOLEAN_FEATURES, CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES

MISSING = "missing"
HASHES, SLICES = 1 << 31, 1 << 10


def known_number(df: DataFrame, column: str) -> Column:
    """The column with NaN as null: a number that is not one is a gap."""
    c = F.col(column)
    return F.when(~F.isnan(c), c) if df.schema[column].dataType.typeName() in ("double", "float") else c


def numeric_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a struct (mean, std over the whole population) per column; NaN counts as a gap."""
    return df.agg(*[F.struct(F.avg(known_number(df, c)).alias("mean"), F.stddev_pop(known_number(df, c)).alias("std"))
                    .alias(c) for c in columns])


def impute_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls and NaN by the column's mean."""
    means = df.agg(F.struct(*[F.avg(known_number(df, c)).alias(c) for c in columns])).scalar()
    filled = df.withColumn("_means", means)
    return filled.withColumns({c: F.coalesce(known_number(df, c), F.col("_means")[c]) for c in columns}).drop("_means")


def impute_medians(df: DataFrame, columns: list[str], medians: DataFrame) -> DataFrame:
    """Fill nulls from a (feature, median) table with one row per column."""
    row = medians.groupBy().pivot("feature", columns).agg(F.first("median"))
    return (df.withColumn("_m", row.select(F.struct(*columns)).scalar())
            .withColumns({c: F.coalesce(c, F.col("_m")[c]) for c in columns}).drop("_m"))


def z_score(c: Column, mean: Column, std: Column) -> Column:
    """Population z-score; a constant column scales by 1."""
    return (c - mean) / F.when(std == 0, 1.0).otherwise(std)


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean-impute and scale to zero mean and unit population deviation of the imputed column.

    One aggregate serves both: imputing by the mean scales the variance by the share of known values.
    """
    known = {c: known_number(df, c) for c in columns}
    stats = df.agg(F.struct(*[F.struct(
        F.avg(k).alias("mean"), F.sqrt(F.var_pop(k) * F.count(k) / F.count("*")).alias("std")).alias(c)
        for c, k in known.items()])).scalar()
    return df.withColumn("_s", stats).withColumns({
        c: z_score(F.coalesce(k, F.col("_s")[c]["mean"]), F.col("_s")[c]["mean"], F.col("_s")[c]["std"])
        for c, k in known.items()}).drop("_s")


def categories(df: DataFrame, column: str) -> list[str]:
    """Sorted non-null values of a category column: the names of the columns to make, so they visit the driver."""
    values = df.select(F.col(column).cast("string").alias("v")).filter("v is not null").distinct()
    return sorted(r["v"] for r in values.collect())


def one_hot(df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None) -> DataFrame:
    """Null becomes 'missing'; one 0/1 column per known value, all zero for an unknown one.

    ``known`` declares the values of columns; those of the others are looked up, however many.
    """
    out = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})
    known = {c: (known or {}).get(c) or categories(out, c) for c in columns}
    return out.withColumns({f"{c}_{v}": (F.col(c) == v).cast("double")
                            for c in columns for v in known[c]}).drop(*columns)


def dummies(df: DataFrame, columns: list[str], known: dict[str, list[str]] | None = None) -> DataFrame:
    """One 0/1 column per value but the first sorted one; null gives zeros. ``known`` as in ``one_hot``."""
    known = {c: (known or {}).get(c) or categories(df, c) for c in columns}
    return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
                           for c in columns for v in known[c][1:]}).drop(*columns)


def training_frame(students: DataFrame) -> DataFrame:
    """Contract columns with defaults, booleans normalised, means imputed, 'missing' categories."""
    full = add_missing(students, {
        **{c: ("double", None) for c in NUMERIC_FEATURES},
        **{c: ("string", None) for c in CATEGORICAL_FEATURES}, LABEL: ("boolean", False)})
    full = full.select(*NUMERIC_FEATURES, *CATEGORICAL_FEATURES, LABEL)
    full = full.withColumns({c: str_to_bool(F.col(c).cast("string")) for c in BOOLEAN_FEATURES})
    rest = [c for c in CATEGORICAL_FEATURES if c not in BOOLEAN_FEATURES]
    return impute_means(full, NUMERIC_FEATURES).fillna(MISSING, subset=rest)


def in_holdout(key: Column, seed: int = 42, percent: int = 20) -> Column:
    """Whether a row belongs to the test share, by a stable hash of its key; rows without a key train."""
    return F.coalesce(hash_bucket(key, seed) < percent, F.lit(False))


def holdout(df: DataFrame, key: str, seed: int = 42, percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """(train, test): no shuffle, the same rows for any partitioning."""
    test = in_holdout(F.col(key), seed, percent)
    return df.filter(~test), df.filter(test)


def stratified_holdout(df: DataFrame, key: str, label: str, seed: int = 42,
                       share: float = 0.2) -> DataFrame:
    """Add ``is_test``: per class exactly the ``round(share * rows)`` rows with the smallest hashes.

    Rows are counted per class and slice of the hash range, which leaves one edge slice per class;
    only the rows of the edge slices are counted per hash to find the cut-off. No class is gathered
    in one task and the rows themselves are never shuffled. Null is a class like any other; rows whose
    31-bit hashes are equal go to the same side.
    """
    # rows without a key hash last, so they train; a struct equals another one with a null in the same place
    hashed = df.withColumn("_h", F.coalesce(hash_bucket(F.col(key), seed, HASHES), F.lit(HASHES - 1))).withColumn(
        "_slice", F.floor(F.col("_h") / (HASHES // SLICES))).withColumn("_class", F.struct(F.col(label).alias("c")))
    label = "_class"
    ordered = Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = hashed.groupBy(label, "_slice").agg(F.count("*").alias("n")).withColumns({
        "_before": F.coalesce(F.sum("n").over(ordered), F.lit(0)),
        "_quota": F.round(F.sum("n").over(Window.partitionBy(label)) * share)})
    edge = slices.filter((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("n"))
                         ).select(label, "_slice", "_before", "_quota")  # one row per class
    fine = hashed.select(label, "_slice", "_h").join(F.broadcast(edge), [label, "_slice"]).groupBy(
        label, "_h", "_before", "_quota").agg(F.count("*").alias("n"))
    inside = Window.partitionBy(label).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    cuts = fine.withColumn("_at", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter(
        F.col("_at") < F.col("_quota")).groupBy(label).agg(F.max("_h").alias("_cut"))
    return hashed.join(F.broadcast(cuts), label, "left").withColumn(
        "is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))).select(*df.columns, "is_test")


def sample_rows(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones in every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept in one aggregate."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def top_per_row(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key by an order (Spark drops the rest before the shuffle)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)
