"""Aggregates a dashboard shows: counts, shares, averages, insights and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.functions.scalars import date_text, round_even
from retentia.operators.selection import any_present, first_rows
from retentia.operators.shaping import promote, unwind

# ---- fixed values: texts and limits of the insights ----------------------------------------------
GENDER_RATIO = 1.5
LOW_SCORE = -0.2
MALE_INSIGHT = "Significantly more male students were flagged as anomalous."
FEMALE_INSIGHT = "Significantly more female students were flagged as anomalous."
BALANCED_INSIGHT = "Anomalies are relatively balanced across genders."
VERY_LOW_INSIGHT = "Most anomalies have very low scores, indicating strong deviation from the norm."
THRESHOLD_INSIGHT = "Anomalies are concentrated around the detection threshold."
# --------------------------------------------------------------------------------------------------


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def total_records(datasets: DataFrame, column: str = "record_count") -> DataFrame:
    return datasets.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("total_records"))


def accuracy_percent(accuracy: Column) -> Column:
    return round_even(F.avg(accuracy) * 100)


def average_accuracy(models: DataFrame) -> DataFrame:
    """Mean accuracy over all details that report one, in percent; null when none does."""
    accuracy = F.col("details.metrics")["accuracy"]
    return (unwind(models.select("details"), "details").filter(accuracy.isNotNull())
            .agg(accuracy_percent(accuracy).alias("avg_accuracy")))


def read_state(contacts: DataFrame) -> DataFrame:
    """Message counts; a row without ``is_read`` counts as neither read nor unread."""
    unread = F.count_if(~F.col("is_read"))
    return contacts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("is_read")).alias("read"),
        F.coalesce(F.try_divide(unread * 100.0, F.count("*")), F.lit(0.0)).alias("unread_pct"),
        date_text(F.max("created_at")).alias("last_created"),
    )


def risk_breakdown(scored: DataFrame, column: str = "prediction_class") -> DataFrame:
    """Class 1 is high risk, any other class and null is low risk."""
    high = F.count_if(F.col(column) == 1)
    return scored.agg(high.alias("high_risk"), (F.count("*") - high).alias("low_risk"))


def dataset_overview(datasets: DataFrame) -> DataFrame:
    return datasets.agg(
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("total_records"),
        date_text(F.max("uploaded_at")).alias("last_updated"))


def dataset_sample(datasets: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows held inside the stored datasets."""
    return first_rows(promote(unwind(datasets.select("data"), "data"), "data"), order, n)


def home_statistics(students: DataFrame, models: DataFrame, files: DataFrame) -> DataFrame:
    """One row with the four tiles; each input is reduced by itself to one value.

    A student counts as analysed with a prediction or a list of predictions.
    """
    paths = ["prediction.probability", *(["predictions"] if "predictions" in students.columns else [])]
    analysed = students.filter(any_present(*paths)).agg(F.count("*")).scalar()
    accuracy = average_accuracy(models).scalar()
    return models.agg(F.count("*").alias("trained_models")).select(
        analysed.alias("analyzed_students"), accuracy.alias("avg_accuracy"),
        files.agg(F.count("*")).scalar().alias("files"), "trained_models")


def gender_insight(gender: str = "gender") -> Column:
    """Aggregate: text on the balance of the flagged rows; null unless both groups occur."""
    male, female = F.count_if(F.col(gender) == "Male"), F.count_if(F.col(gender) == "Female")
    return F.when((male > 0) & (female > 0),
                  F.when(male > female * GENDER_RATIO, MALE_INSIGHT)
                  .when(female > male * GENDER_RATIO, FEMALE_INSIGHT)
                  .otherwise(BALANCED_INSIGHT))


def score_insight(score: str = "anomaly_score") -> Column:
    """Aggregate: text on how deep the flagged scores lie; null when there is no row."""
    very_low = F.count_if(F.col(score) < LOW_SCORE)
    return F.when(F.count("*") > 0,
                  F.when(very_low > F.count("*") / 2, VERY_LOW_INSIGHT).otherwise(THRESHOLD_INSIGHT))


def anomaly_insights(scored: DataFrame) -> DataFrame:
    """One row on the flagged rows (``is_anomaly = -1``) and the total."""
    total = scored.agg(F.count("*")).scalar()
    flagged = scored.filter(F.col("is_anomaly") == -1)
    texts = [score_insight().alias("score_insight")]
    if "gender" in scored.columns:
        texts.insert(0, gender_insight().alias("gender_insight"))
    return flagged.agg(*texts, F.count("*").alias("flagged")).withColumn("total", total)


def feature_frequency(flagged: DataFrame, column: str = "extreme_feature") -> DataFrame:
    """How often each feature explains a flagged row."""
    return flagged.groupBy(F.col(column).alias("feature")).agg(F.count("*").alias("n"))


def chart_series(df: DataFrame, x: str, y: str, order: list[str], limit: int = 10,
                 kind: str = "bar") -> DataFrame:
    """(x, y) of the first ``limit`` rows where both are known; a pie adds y up per x."""
    for name in (x, y):
        if name not in df.columns:
            raise ValueError(f"no column {name!r}")
    if kind == "pie" and df.schema[y].dataType.typeName() not in (
            "double", "float", "integer", "long", "short", "byte", "decimal"):
        raise ValueError(f"a pie needs a numeric y axis, {y!r} is not")
    if kind not in ("bar", "line", "pie"):
        raise ValueError(f"unknown chart type {kind!r}")
    rows = first_rows(df, order, limit).select(F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    return rows.groupBy("x").agg(F.sum("y").alias("y")) if kind == "pie" else rows


def saved_chart_series(charts: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Series of every saved chart: one ordered top-n per named table, joined to its charts.

    ``tables`` maps a table name to the frame and its row order; a chart on any other table is an error. Only as
    many rows as the table's widest chart asks for are kept, before any column is turned into text. A pie adds its
    numeric y up per x; its ``row`` is the first of that x.
    """
    asked = {r["collection"]: r["n"] for r in
             charts.groupBy("collection").agg(F.max("limit").alias("n")).collect()}
    if unknown := sorted(set(asked) - set(tables)):
        raise ValueError(f"charts name unknown tables: {', '.join(unknown)}")
    out = None
    for name in sorted(asked):
        df, order = tables[name]
        top = first_rows(df, order, asked[name])
        ranked = top.withColumn("_row", F.row_number().over(Window.orderBy(*order)))
        cells = ranked.select("_row", F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[F.col(c).cast("string") for c in df.columns])).alias("cells"))
        asked_rows = charts.filter(F.col("collection") == name).withColumn(
            "_row", F.explode(F.sequence(F.lit(1), F.col("limit").cast("int"))))
        series = asked_rows.join(cells, "_row").select(
            "collection", "x_axis", "y_axis", "chart_type", F.col("_row").cast("long").alias("row"),
            F.col("cells")[F.col("x_axis")].alias("x"), F.col("cells")[F.col("y_axis")].alias("y"))
        out = series if out is None else out.unionByName(series)
    if out is None:
        raise ValueError("no saved chart")
    rows = out.dropna(subset=["x", "y"])
    pie = F.col("chart_type") == "pie"
    head = ["collection", "x_axis", "y_axis", "chart_type"]
    total = F.sum(F.col("y").cast("double")).cast("string").alias("y")
    summed = rows.filter(pie).groupBy(*head, "x").agg(F.min("row").alias("row"), total)
    return rows.filter(~F.coalesce(pie, F.lit(False))).unionByName(summed.select(*rows.columns))


def login_history(logs: DataFrame, user_id=None) -> DataFrame:
    """Newest first, with the date, weekday and clock time as text."""
    from retentia.functions.scalars import clock_text, weekday_text

    rows = logs if user_id is None else logs.filter(F.col("user_id") == user_id)
    ts = F.col("timestamp")
    return rows.orderBy(ts.desc_nulls_last()).select(
        date_text(ts).alias("date"), weekday_text(ts).alias("day"), clock_text(ts).alias("time"),
        F.coalesce("username", F.lit("N/A")).alias("username"),
        F.coalesce("role", F.lit("N/A")).alias("role"))
