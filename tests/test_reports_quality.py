"""Reports, insights, registry, validation and ingest on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from retentia.operators import anomaly, ingest, quality, registry, reports, selection, shaping
from retentia.schemas import MODEL_DETAIL, REQUIRED_COLUMNS, SAVED_CHARTS


def runs(spark, *groups):
    data = [(str(i), f"ds{i}", None, [(t, "dropout", n, m, f"{i}/{n}") for t, n, m in g] if g is not None else None)
            for i, g in enumerate(groups)]
    schema = f"_id string, dataset string, created_at timestamp, details array<{MODEL_DETAIL.simpleString()}>"
    return spark.createDataFrame(data, schema)


def test_average_accuracy(spark):
    models = runs(spark, [("classification", "a", {"accuracy": 0.8}), ("classification", "b", {"accuracy": 0.9}),
                          ("classification", "c", {"accuracy": None})], [])
    assert reports.average_accuracy(models).head()[0] == 85.0
    assert reports.average_accuracy(runs(spark, [])).head()[0] is None


def test_first_regression_only(spark):
    models = runs(spark, [("classification", "clf_a", {}), ("regression", "reg_x", {}),
                          ("classification", "clf_b", {}), ("regression", "reg_y", {})], None)
    got = [r["model_name"] for r in registry.listed_models(models).orderBy("pos").collect()]
    assert got == ["Clf A", "Reg X", "Clf B"]


def test_unread_share(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (None,)], "is_read boolean").withColumn(
        "created_at", F.lit("2024-01-02").cast("timestamp"))
    assert tuple(reports.read_state(df).head()) == (4, 1, 50.0, "2024-01-02")
    assert tuple(reports.read_state(df.limit(0)).head()) == (0, 0, 0.0, None)


@pytest.mark.parametrize("male,female,text", [
    (4, 2, reports.MALE_INSIGHT), (3, 2, reports.BALANCED_INSIGHT), (2, 4, reports.FEMALE_INSIGHT), (3, 0, None)])
def test_gender_insight(spark, male, female, text):
    df = spark.createDataFrame([("Male", -0.1, -1)] * male + [("Female", -0.1, -1)] * female + [("Male", 0.2, 1)] * 9,
                               "gender string, anomaly_score double, is_anomaly int")
    got = reports.anomaly_insights(df).head()
    assert got["gender_insight"] == text and got["flagged"] == male + female and got["total"] == male + female + 9


@pytest.mark.parametrize("scores,text", [([-0.3, -0.25, -0.1], reports.VERY_LOW_INSIGHT),
                                         ([-0.3, -0.1], reports.THRESHOLD_INSIGHT), ([], None)])
def test_score_insight(spark, scores, text):
    df = spark.createDataFrame([(s, -1) for s in scores], "anomaly_score double, is_anomaly int")
    assert reports.anomaly_insights(df).head()["score_insight"] == text


def test_contact_and_feedback_rules(spark):
    df = spark.createDataFrame([("", "bad", "s", " "), ("n", "a@b.de", "s", "m")],
                               "fullname string, email string, subject string, message string")
    good, bad = quality.split_valid(df, quality.contact_errors())
    assert good.count() == 1
    assert bad.head()["errors"] == {"fullname": "Full name is required.", "email": "Invalid email format.",
                                    "message": "Message is required."}
    fb = spark.createDataFrame([("n", "a@b.de", "m", r) for r in ("0", "3", "")], "name string, email string, message string, rating string")
    assert quality.split_valid(fb, quality.feedback_errors())[0].count() == 1


def test_contract(spark):
    df = spark.createDataFrame([("1", "x")], "student_id string, age string")
    assert quality.absent_columns(df)[0] == "study_hours"
    with pytest.raises(ValueError, match="dropout"):
        quality.require_columns(df)
    report = {r["column"]: r for r in quality.contract_report(df).collect()}
    assert len(report) == len(REQUIRED_COLUMNS)
    assert report["age"]["filled"] == 1 and report["age"]["castable"] == 0 and not report["gender"]["present"]


def test_ingest(spark):
    df = spark.createDataFrame(
        [(" a ", "3.5", "80", "Yes", None, "20"), ("b", "x", "60", " yes ", None, None), (" ", "1", "1", None, "Yes", "1"),
         ("c", "1.0", "90", None, "No", "30")],
        ["student ID", "currentGPA", "attendance", "part_time_job", "dropout", "age"]).coalesce(1)
    typed, rejected = ingest.ingest_students(df, F.lit("2024-01-01"))
    got = {r["student_id"]: r for r in typed.collect()}
    assert rejected.count() == 1 and set(got) == {"a", "b", "c"}
    assert (got["a"]["dropout"], got["b"]["dropout"], got["c"]["dropout"]) == (False, True, False)
    assert got["a"]["ml_features"]["age"] == 20.0 and got["b"]["ml_features"]["part_time_job"] is False
    assert got["b"]["currentGPA"] is None
    assert tuple(ingest.ingest_counts(df, "student ID").head()) == (4, 3, 1)
    watched, seen = ingest.observed(typed, "student_id")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get["ingested"] == 3


def test_push_and_nested(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "id int, v array<string>").coalesce(1)
    assert [r["v"] for r in shaping.push_element(df, "v", F.lit("z")).collect()] == [["z"], ["a", "z"]]
    nested = spark.createDataFrame([((1.0, "x"),)], "f struct<age:double,g:string>")
    assert tuple(shaping.set_nested(nested, "f", age=F.lit(2.0)).head()["f"]) == (2.0, "x")


def test_charts(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "a", 2.0), (4, "b", 5.0)], "id int, x string, y double")
    assert [tuple(r) for r in reports.chart_series(df, "x", "y", ["id"], 3).collect()] == [("a", 1.0), ("a", 2.0)]
    assert [tuple(r) for r in reports.chart_series(df, "x", "y", ["id"], 3, "pie").collect()] == [("a", 3.0)]
    for bad in (dict(x="nope", y="y"), dict(x="y", y="x", kind="pie"), dict(x="x", y="y", kind="radar")):
        with pytest.raises(ValueError):
            reports.chart_series(df, bad["x"], bad["y"], ["id"], 3, bad.get("kind", "bar"))
    charts = spark.createDataFrame([("t", "x", "y", "bar", 2, "#1"), ("t", "id", "y", "line", 4, "#1")], SAVED_CHARTS)
    got = reports.saved_chart_series(charts, {"t": (df, ["id"])})
    assert sorted((r["x_axis"], r["row"]) for r in got.collect()) == [("id", 1), ("id", 3), ("id", 4), ("x", 1)]
    pie = spark.createDataFrame([("t", "x", "y", "pie", 4, "#1")], SAVED_CHARTS)
    assert sorted((r["x"], r["y"]) for r in reports.saved_chart_series(pie, {"t": (df, ["id"])}).collect()) == [
        ("a", "3.0"), ("b", "5.0")]
    with pytest.raises(ValueError):
        reports.saved_chart_series(spark.createDataFrame([("gone", "x", "y", "bar", 1, "#")], SAVED_CHARTS), {})


def test_role_and_search(spark):
    df = spark.createDataFrame([(1, "Red", "x", "on"), (2, None, "bred", "off")], "id int, a string, b string, status string")
    assert selection.search(df, "RED").count() == 2
    assert selection.search(df, "red", status="on").count() == 1 and selection.search(df, "red", status="all").count() == 2
    arr = df.withColumn("targets", F.array("a"))
    assert arr.filter(selection.role_in("targets", "Red")).count() == 1


def test_extreme_feature(spark):
    df = spark.createDataFrame([(i, 10.0, 1.0 * (i % 5), 1) for i in range(50)] + [(99, 100.0, 2.0, -1), (98, None, -30.0, -1)],
                               "id int, a double, b double, is_anomaly int")
    got = {r["id"]: r["extreme"] for r in anomaly.explain_flagged(df, ["a", "b"]).collect()}
    assert tuple(got[99]) == ("a", 100.0, "Unusually high") and tuple(got[98]) == ("b", -30.0, "Unusually low")


def test_field_catalog_estimate_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 3000).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    exact = {r["field"]: r for r in quality.field_catalog({"t": df}, exact=True).collect()}
    near = {r["field"]: r for r in quality.field_catalog({"t": df}).collect()}
    assert exact["a"]["distinct_values"] == 3000 and exact["b"]["filled"] == near["b"]["filled"] == 10000
    assert abs(near["a"]["distinct_values"] - 3000) < 200 and near["b"]["distinct_values"] == 1
