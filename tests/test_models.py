"""Training, contributions, advice and the isolation forest."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retentia.operators import anomaly, explain, scoring, training
from retentia.plans import views
from retentia.session import scratch_path


def advise(spark, pairs):
    df = spark.createDataFrame([(1,)], "id int").select(
        explain.recommendations(explain.contribution_array({k: F.lit(v) for k, v in pairs.items()})).alias("r"))
    return df.head()["r"]


def test_advice(spark):
    assert advise(spark, {"social_media_hours": 0.9, "attendance": -0.5, "age": 0.4, "currentGPA": -0.3,
                          "highSchoolGPA": -0.2, "study_hours": -0.1}) == [
        explain.SOCIAL_MEDIA, explain.ATTENDANCE, explain.GPA]
    assert advise(spark, {"age": 0.0, "currentGPA": 0.0}) == [explain.GENERAL]
    assert advise(spark, {"part_time_job_Yes": 0.1, "mental_health_score": 0.2}) == [
        explain.MENTAL_HEALTH, explain.PART_TIME_JOB]


def brute_shapley(x, leaves):
    """Definition: average marginal value over all coalitions of all features."""
    m = len(x)

    def value(inside):
        total = 0.0
        for v, steps in leaves:
            p = 1.0
            for f, kind, test, cover in steps:
                ok = {"le": x[f] <= test, "gt": x[f] > test}[kind] if kind in ("le", "gt") else (
                    (x[f] in test) == (kind == "in"))
                p *= float(ok) if f in inside else cover
            total += v * p
        return total

    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                phi[i] += w * (value({*s, i}) - value(set(s)))
    return phi


def test_shapley_equals_definition():
    leaves = [
        (1.0, [(0, "le", 0.5, 0.6), (1, "le", 0.2, 0.3), (0, "le", 0.1, 0.5)]),
        (2.0, [(0, "le", 0.5, 0.6), (1, "le", 0.2, 0.3), (0, "gt", 0.1, 0.5)]),
        (3.0, [(0, "le", 0.5, 0.6), (1, "gt", 0.2, 0.7)]),
        (-1.5, [(0, "gt", 0.5, 0.4), (2, "in", (0.0,), 0.8)]),
        (0.5, [(0, "gt", 0.5, 0.4), (2, "out", (0.0,), 0.2)]),
    ]
    x = np.random.default_rng(1).random((40, 3))
    x[:, 2] = (x[:, 2] > 0.5).astype(float)
    got = explain.shapley_values(x, leaves)
    assert np.allclose(got, [brute_shapley(r, leaves) for r in x])


@pytest.fixture(scope="module")
def students(spark):
    return spark.range(400).select(
        F.col("id").cast("string").alias("student_id"), (F.rand(1) * 10).alias("study_hours"),
        F.when(F.rand(2) < 0.9, F.rand(3) * 100).alias("attendance"),
        F.when(F.rand(4) < 0.5, "Yes").otherwise("No").alias("part_time_job")).withColumn(
        "dropout", F.when(F.coalesce("attendance", F.lit(50.0)) + 5 * F.col("study_hours") + 20 * F.rand(5) < 75, "Yes")
        .otherwise("No")).cache()


COLUMNS = (["study_hours", "attendance"], ["part_time_job"])


def test_preprocessor(spark, students):
    prep = training.fit_preprocessor(students, *COLUMNS)
    rows = prep.transform(students)
    assert training.feature_names(rows) == ["study_hours", "attendance", "part_time_job_No", "part_time_job_Yes"]
    from pyspark.ml.functions import vector_to_array
    x = np.array([r[0] for r in rows.select(vector_to_array("features")).collect()])
    assert np.allclose(x[:, :2].mean(axis=0), 0, atol=1e-9) and np.allclose(x[:, :2].std(axis=0), 1)
    odd = students.limit(1).withColumn("part_time_job", F.lit("Sometimes"))
    assert list(prep.transform(odd).select(vector_to_array("features")).head()[0])[2:] == [0.0, 0.0]


def test_classifiers_and_contributions(spark, students):
    found = training.train_classifiers(students, "student_id", "dropout", *COLUMNS, "t", scratch_path(spark, "t"))
    assert [f["model_name"] for f in found] == ["random_forest", "logistic_regression", "gradient_boosting"]
    assert all(f["metrics"]["roc_auc"] > 0.8 for f in found)
    for name in ("random_forest", "gradient_boosting"):
        path = next(f["model_path"] for f in found if f["model_name"] == name)
        model = PipelineModel.load(path)
        stage, forest = model.stages[-1], name == "random_forest"
        rows = model.transform(students)
        leaves = explain.ensemble_leaves(spark, f"{path}/stages/{len(model.stages) - 1}_{stage.uid}",
                                         list(stage.treeWeights), forest)
        told = explain.tree_contributions(rows, "student_id", leaves, training.feature_names(rows))
        total = F.aggregate("contributions", F.lit(0.0), lambda a, e: a + e["contribution"]) + explain.expected_value(leaves)
        p = training.class_one_probability()
        target = p if forest else F.log(p / (1 - p)) / 2
        gap = rows.select("student_id", target.alias("t")).join(told, "student_id").select(
            F.max(F.abs(F.col("t") - total))).head()[0]
        assert gap < 1e-6
    lr = PipelineModel.load(found[1]["model_path"])
    scored = scoring.score_linear(students, lr, "student_id", "t", F.lit("2024-01-01"))
    row = scored.head()["prediction"]
    assert scored.count() == 400 and 0 <= row["probability"] <= 1 and row["recommendations"]
    # contributions of the training rows average to zero, category columns included
    prepared = lr.transform(students)
    told = explain.linear_contributions(training.feature_names(prepared), list(lr.stages[-1].coefficients),
                                        scoring.training_means(lr))
    mean = prepared.select(F.aggregate(told, F.lit(0.0), lambda a, e: a + e["contribution"]).alias("c")).agg(
        F.avg("c"), F.stddev("c")).head()
    assert abs(mean[0]) < 0.2 * mean[1]


def test_regressors_skip_short_targets(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("a"),
                                 (2 * F.col("id") + 1).cast("double").alias("b"),
                                 F.when(F.col("id") < 9, 1.0).alias("short"), F.when(F.col("id") < 10, F.col("id") * 1.0).alias("ten"))
    found = training.train_regressors(df, "k", ["b", "short", "ten"], ["a", "b"], [], "t", scratch_path(spark, "r"))
    assert [f["target"] for f in found] == ["b", "ten"]
    assert found[0]["metrics"]["r2_score"] == pytest.approx(1.0)
    holes = df.withColumn("b", F.when(F.col("id" if "id" in df.columns else "a") % 2 == 0, F.col("b")))
    filled = scoring.fill_missing(holes, {"b": training.load_regressor(spark, found[0]["model_path"])})
    assert filled.filter(F.abs(F.col("b") - (2 * F.col("a") + 1)) > 1e-6).count() == 0


def test_regressions_equal_least_squares_with_gaps_and_categories(spark, monkeypatch):
    """Closed form and iterative fits against numpy: own means for the gaps of each target, a value only test rows have."""
    draw = np.random.default_rng(3)
    n = 600
    a, b, kind = draw.normal(50, 3, n), draw.normal(-2, 1, n), draw.integers(0, 4, n)
    y = 3 * a - 7 * b + 5 * kind + draw.normal(0, 0.5, n)
    table = [(f"k{i}", None if i % 7 == 0 else float(a[i]), float("nan") if i % 11 == 0 else float(b[i]),
              None if kind[i] == 0 else f"v{kind[i]}", None if i % 5 == 0 else float(y[i])) for i in range(n)]
    df = spark.createDataFrame(table, "k string, a double, b double, kind string, y double")
    found = training.train_regressors(df, "k", ["y", "a"], ["a", "b", "y"], ["kind"], "t", scratch_path(spark, "r"))
    held = {r["k"] for r in df.filter(training.in_holdout(F.col("k"), training.SEED)).collect()}

    def by_numpy(target, features):
        rows = [r for r in (dict(zip(df.columns, t)) for t in table) if r[target] is not None and not np.isnan(r[target])]
        get = lambda r, c: np.nan if r[c] is None else r[c]
        train, test = [r for r in rows if r["k"] not in held], [r for r in rows if r["k"] in held]
        means = {c: np.nanmean([get(r, c) for r in train]) for c in features}
        x = lambda some: np.array([[1, *(means[c] if np.isnan(get(r, c)) else get(r, c) for c in features),
                                    *((r["kind"] or "missing") == v for v in ("missing", "v1", "v2", "v3"))] for r in some], dtype=float)
        w = np.linalg.lstsq(x(train), np.array([r[target] for r in train]), rcond=None)[0]
        t = np.array([r[target] for r in test])
        mse = np.mean((t - x(test) @ w) ** 2)
        return mse, 1 - mse / t.var()

    for f, features in zip(found, (["a", "b"], ["b", "y"])):
        mse, r2 = by_numpy(f["target"], features)
        assert f["metrics"]["mse"] == pytest.approx(mse) and f["metrics"]["r2_score"] == pytest.approx(r2)
    # the stored fit gives the same error row by row
    fit = training.load_regressor(spark, found[0]["model_path"])
    rows = df.filter(F.col("y").isNotNull() & training.in_holdout(F.col("k"), training.SEED))
    error = rows.select(F.avg((F.col("y") - fit.predicted(rows)) ** 2)).head()[0]
    assert error == pytest.approx(found[0]["metrics"]["mse"])
    monkeypatch.setattr(training.regressions.survey, "__defaults__", (3,))
    slow = training.train_regressors(df, "k", ["y"], ["a", "b"], ["kind"], "t", scratch_path(spark, "r"))
    assert slow[0]["metrics"]["mse"] == pytest.approx(by_numpy("y", ["a", "b"])[0], rel=1e-4)
    filled = scoring.fill_missing(df, {"y": training.load_regressor(spark, slow[0]["model_path"])})
    assert filled.filter("y is null or isnan(y)").count() == 0


def test_regressions_need_as_many_jobs_for_six_targets_as_for_two(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), *[(F.rand(i) + F.col("id") * i).alias(f"x{i}") for i in range(6)])
    names = [f"x{i}" for i in range(6)]

    def jobs(targets, tag):
        spark.sparkContext.setJobGroup(tag, tag)
        training.train_regressors(df, "k", targets, names, [], "t", scratch_path(spark, "r"))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    try:
        assert 0 < jobs(names, "six") == jobs(names[:2], "two") <= 5
    finally:
        spark.sparkContext.setJobGroup("", "")


def points(spark):
    normal = spark.range(950).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    far = spark.range(950, 960).select("id", F.lit(12.0).alias("a"), (F.lit(-9.0) - F.col("id") / 1000).alias("b"))
    return normal.unionByName(far)


def test_isolation_forest_flags_planted_rows(spark):
    df = points(spark).cache()
    found = anomaly.detect(df, "id", ["a", "b"]).cache()
    flagged = {r["id"] for r in found.filter("is_anomaly = -1").collect()}
    assert set(range(950, 960)) <= flagged and abs(len(flagged) - 48) <= 2 and found.count() == 960
    scores = {r["id"]: r["anomaly_score"] for r in found.collect()}
    again = anomaly.detect(df.repartition(2), "id", ["a", "b"])
    assert all(scores[r["id"]] == pytest.approx(r["anomaly_score"], abs=1e-12) for r in again.collect())


def test_samples_are_bounded_and_complete(spark):
    df = spark.range(100000).withColumn("a", F.col("id") * 1.0)
    samples, n = anomaly.draw_samples(df, "id", ["a"], trees=10, sample=64)
    counts = [r["c"] for r in samples.groupBy("tree").agg(F.count("*").alias("c")).collect()]
    assert n == 64 and counts == [64] * 10


def test_average_path():
    h = lambda n: sum(1 / i for i in range(1, n + 1))
    assert list(anomaly.average_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert float(anomaly.average_path(256)) == pytest.approx(2 * h(255) - 2 * 255 / 256, rel=1e-3)


def test_gaps_and_codes(spark):
    df = points(spark).select("id", F.when(F.col("id") != 3, F.col("a")).alias("age"), F.col("b").alias("attendance"),
                              F.when(F.col("id") % 2 == 0, "Male").otherwise("Female").alias("gender"))
    found = anomaly.detect_in_file(df, "id", trees=20)
    assert found.count() == 960 and "gender_code" in found.columns
    with pytest.raises(ValueError):
        anomaly.choose_features(df.select("id"))


def test_detection_keeps_every_row_and_value(spark):
    """Null and repeated keys, gaps and NaN: as many rows out as in, values as they were."""
    rows = [(i if i >= 5 else None, float(i % 17), float("nan") if i == 20 else float(i % 5)) for i in range(90)]
    rows += [(500, 1.0, None)] * 10
    df = spark.createDataFrame(rows, "id int, a double, b double")
    found = anomaly.detect(df, "id", ["a", "b"], trees=10)
    assert found.count() == 100 and found.filter("id is null").count() == 5
    assert found.filter("b is null").count() == 10 and found.filter("isnan(b)").count() == 1
    assert found.filter("anomaly_score is null").count() == 0


def test_rows_that_no_test_tells_apart_are_explained_once(spark):
    leaves = [(1.0, [(0, "le", 2.0, 0.5), (1, "in", (1.0,), 0.25)]), (2.0, [(0, "le", 2.0, 0.5), (1, "out", (1.0,), 0.75)]),
              (5.0, [(0, "gt", 2.0, 0.5), (0, "le", 7.0, 0.5)]), (3.0, [(0, "gt", 2.0, 0.5), (0, "gt", 7.0, 0.5)])]
    x = np.array([[i % 100 / 10, i % 3 // 2] for i in range(3000)] + [[float("nan"), 1.0], [2.0, -0.0], [float("-inf"), 0.0]])
    tests = explain.tests_of(leaves)
    assert tests == ({0: [2.0, 7.0]}, [1]) and len(set(explain.cells(x, tests))) == 7
    want = explain.shapley_values(x, leaves)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").select(
        "id", array_to_vector("x").alias("features"), (-F.col("id")).alias("other"))
    told = explain.tree_contributions(df, "id", leaves, ["a", "b"], carry=("other",))
    got = {r["id"]: r for r in told.collect()}
    assert len(got) == len(x) and all(r["other"] == -i for i, r in got.items())
    assert all([c["contribution"] for c in got[i]["contributions"]] == list(want[i]) for i in range(len(x)))


def test_rows_are_prepared_once_for_their_contributions(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def number(x):
        seen.add(1)
        return float(x)

    leaves = [(1.0, [(0, "le", 20.0, 0.5)]), (3.0, [(0, "gt", 20.0, 0.5)])]
    df = spark.range(50).select(F.col("id").alias("k"), array_to_vector(F.array(number("id"))).alias("features"))
    told = {r["k"]: r["contributions"][0]["contribution"] for r in explain.tree_contributions(df, "k", leaves, ["a"]).collect()}
    assert told == {k: -1.0 if k <= 20 else 1.0 for k in range(50)}
    assert seen.value == 50


def test_rows_of_one_cell_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def side(x):
        seen.add(1)
        return float(x > 20)

    leaves = [(1.0, [(0, "le", 20.0, 0.5)]), (3.0, [(0, "gt", 20.0, 0.5)])]
    df = spark.range(50).select(F.col("id").alias("k"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    told = explain.tree_contributions(df, "k", leaves, ["a"], judged=("side",),
                                      judge=lambda rows: rows.withColumn("side", side(vector_to_array("features")[0])))
    assert {r["k"]: (r["side"], r["contributions"][0]["contribution"]) for r in told.collect()} == {
        k: (0.0, -1.0) if k <= 20 else (1.0, 1.0) for k in range(50)}
    assert seen.value == 2


def test_tree_scores_are_those_of_the_model(spark, students):
    found = training.train_classifiers(students, "student_id", "dropout", *COLUMNS, "t", scratch_path(spark, "t"),
                                       ["random_forest"], forest_depth=4)[0]
    model = PipelineModel.load(found["model_path"])
    scored = scoring.score_trees(students, model, found["model_path"], "student_id", "t", F.lit("2024-01-01"))
    got = sorted((r[0], r[1]["class"], r[1]["probability"]) for r in scored.select("student_id", "prediction").collect())
    want = model.transform(students).select("student_id", F.col("prediction").cast("int"), training.class_one_probability())
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 400


def test_labelled_texts_are_measured_before_the_join(spark, sf):
    plan = views.labelled_docs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("replace(text")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_words_are_counted_as_by_splitting(spark, ansi):
    texts = ["", " ", "a", " a", "a ", "a  b", "a\tb c\n", "é ü", "\u00a0 x", None]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
            views.n_words("text"), F.size(F.split("text", " ", -1)).cast("double")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert [a for a, _ in rows] == [b for _, b in rows]


def test_training_reads_its_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(k):
        read.add(1)
        return float(k % 7)

    df = spark.range(60).repartition(2).select(F.col("id").alias("k"), F.concat(F.lit("key"), "id").alias("key"),
                                               counted("id").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    training.train_classifiers(df, "key", "y", ["x"], [], "d", str(tmp_path), ["logistic_regression"])
    assert read.value == 60
